"""SimHash fingerprints of word shingles and groups of fingerprints that differ in few bits.

Texts with equal fingerprints are one node, so copies never meet in pairs. Candidates follow the pigeonring
principle: with the 64 bits in a ring of four segments and a budget of three bits, two linked fingerprints have
a segment from which every chain of 1, 2, 3 and 4 consecutive segments stays within its share of the budget,
that is 0, 1, 2 and 3 bits. The chain of two segments is the key on which fingerprints meet: 32 bits that differ in none
or in one of the second segment. Of two fingerprints that differ there in one bit, one has it set, so each goes to its own
key and to the keys with one of the second segment's bits cleared. Longer chains prune in the order of their length, and
only what is left is compared in full. Fingerprints that share a key are compared in tiles of bounded size, spread over
tasks, and a tile returns a spanning forest of its links instead of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stage, text_rows
from .components import components, merge_links

SEED, WORDS, DISTANCE = 42, 3, 3
SEGMENTS, SEGMENT_BITS = 4, 16
TILE = 1024
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is one if it is set in over half of the shingle hashes; a text without words has 0.

    Only A-Z are lower-cased, words are runs of characters other than ASCII white space, and a text of fewer
    words than a shingle is one shingle.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    count = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, HASHED_AT_ONCE):
        end = min(start + HASHED_AT_ONCE, count)
        runs = zip(*(tokens[start + i : end + i] for i in range(words)), strict=False)
        shingles = map(b" ".join, runs) if len(tokens) >= words else [b" ".join(tokens)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, digest: bool = False
) -> DataFrame:
    """``(id, fp)`` with one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long.

    Null texts have no words. Null and repeated ids are kept. ``digest`` adds a column with ``text_digest``.
    """

    def handle(batch: pa.RecordBatch):
        found = np.array([fingerprint(t, words) for t in text_rows(batch, "text")], dtype=np.uint64)
        own = {"digest": batch.column("digest")} if digest else {}
        yield {"id": batch.column("id"), "fp": pa.array(found.view(np.int64)), **own}

    narrow = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    if digest:
        narrow = narrow.withColumn("digest", text_digest("text"))
    return arrow_map(narrow, handle, "id long, fp long" + ", digest long" * digest)


def text_digest(text: str) -> Column:
    """Tells different texts of one id apart, a null text from an empty one too."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def chain_survivors(left: np.ndarray, right: np.ndarray, segment: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which pairs of all ``left`` x ``right`` pass every chain from ``segment`` on, the full ring at last.

    ``segment`` is one number for each row of ``left``: all pairs of a row share that segment already.
    """
    rows, columns = np.nonzero(np.ones((len(left), len(right)), dtype=bool))
    differing = left[rows] ^ right[columns]
    mask, wide = np.uint64((1 << SEGMENT_BITS) - 1), np.uint64(SEGMENT_BITS)
    so_far = np.zeros(len(rows), dtype=np.int64)
    at = segment[rows].astype(np.uint64)
    for length in range(1, SEGMENTS + 1):
        so_far = so_far + np.bitwise_count((differing >> (at * wide)) & mask)
        stay = so_far * SEGMENTS <= length * distance  # the chain's share of the budget
        rows, columns, differing, so_far, at = (x[stay] for x in (rows, columns, differing, so_far, at))
        at = (at + np.uint64(1)) % np.uint64(SEGMENTS)
    return np.stack([rows, columns])


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the first node of their component, for links given as positions."""
    parent = merge_links(np.arange(len(nodes)), left, right)
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare runs of rows with equal (key, tile); rows come sorted, and a run may span batches.

    Small runs are compared together: rows of neighbouring runs are paired by their offsets, so a
    thousand runs of three rows cost no more than one run of a thousand.
    """
    held: list[np.ndarray] = []
    rows_held = 0

    def flush(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(block) < 2:
            return
        run = np.concatenate([[0], np.cumsum((block[1:, :2] != block[:-1, :2]).any(axis=1))])
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(block)]]))
        fps = block[:, 2].view(np.uint64)
        segment = block[:, 0] >> 2 * SEGMENT_BITS
        links: list[np.ndarray] = []
        small = sizes <= 64
        # row i of a small run meets the next 1, 2, ... rows of its run
        row_end = np.repeat(starts + sizes, sizes)
        rows = np.flatnonzero(np.repeat(small, sizes))
        for offset in range(1, int(sizes[small].max(initial=1))):
            rows = rows[rows + offset < row_end[rows]]
            if not len(rows):
                break
            pairs = _rows_survive(fps, rows, rows + offset, segment)
            links.append(pairs)
        for start, size in zip(starts[~small], sizes[~small], strict=True):
            for a in range(start, start + size, TILE):
                for b in range(a, start + size, TILE):
                    first, second = fps[a : min(a + TILE, start + size)], fps[b : min(b + TILE, start + size)]
                    pairs = chain_survivors(first, second, np.full(len(first), segment[start]))
                    left, right = pairs[0] + a, pairs[1] + b
                    links.append(np.stack([left, right])[:, left < right])
        if links:
            left, right = np.concatenate(links, axis=1)
            a, b = _forest(block[:, 2], left, right)
            # nodes are compared by position, so a fingerprint in several runs may link to itself
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        block = np.stack([np.asarray(batch.column(i).to_numpy()).astype(np.int64) for i in range(3)], axis=1)
        held.append(block)
        rows_held += len(block)
        if rows_held >= 1 << 15:
            joined = np.concatenate(held)
            earlier = np.flatnonzero((joined[:, :2] != joined[-1, :2]).any(axis=1))
            cut = int(earlier[-1]) + 1 if len(earlier) else 0  # the last run may go on
            yield from flush(joined[:cut])
            held, rows_held = [joined[cut:]], len(joined) - cut
    if held:
        yield from flush(np.concatenate(held))


def _rows_survive(fps: np.ndarray, left: np.ndarray, right: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """As ``chain_survivors``, for pairs given row by row."""
    mask, wide = np.uint64((1 << SEGMENT_BITS) - 1), np.uint64(SEGMENT_BITS)
    differing, at = fps[left] ^ fps[right], segment[left].astype(np.uint64)
    so_far = np.zeros(len(left), dtype=np.int64)
    for length in range(1, SEGMENTS + 1):
        so_far = so_far + np.bitwise_count((differing >> (at * wide)) & mask)
        stay = so_far * SEGMENTS <= length * DISTANCE
        left, right, differing, so_far, at = (x[stay] for x in (left, right, differing, so_far, at))
        at = (at + np.uint64(1)) % np.uint64(SEGMENTS)
    return np.stack([left, right])


def _keys() -> Column:
    """The keys of ``fp``: number, bits and following bits of each segment, the latter also with one set bit cleared."""
    low = (1 << SEGMENT_BITS) - 1

    def of(i: int) -> Column:
        own = F.shiftrightunsigned("fp", i * SEGMENT_BITS).bitwiseAND(low)
        after = F.shiftrightunsigned("fp", (i + 1) % SEGMENTS * SEGMENT_BITS).bitwiseAND(low)
        key = F.lit(i << 2 * SEGMENT_BITS).cast("long") + F.shiftleft(own, SEGMENT_BITS) + after
        bits = F.array(*(F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)))
        cleared = F.transform(F.filter(bits, lambda b: after.bitwiseAND(b) != 0), lambda b: key - b)
        return F.concat(F.array(key), cleared)

    return F.concat(*(of(i) for i in range(SEGMENTS)))


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect just what the links between the fingerprints ``fp`` connect.

    ``distinct`` has each fingerprint once. Every fingerprint goes to its keys, about 36 of them. A key with more than
    ``TILE`` fingerprints is dealt into shares by a hash; each pair of shares is a tile of its own. ``fp`` must not be null, as
    no text's fingerprint is. A fingerprint without a near one has no edge, and an empty table gives none.
    """
    keyed = distinct.select("fp", F.explode(_keys()).alias("key"))
    return in_tiles(keyed, "fp").mapInArrow(_compare_tiles, "a long, b long").filter("a <> b")


def in_tiles(keyed: DataFrame, node: str, *others: str) -> DataFrame:
    """``(key, tile, node, others)`` in order inside each partition: rows that share a key, without keys of one row.

    A key with more than ``TILE`` rows is dealt into shares by a hash of the node; each pair of shares is a tile.
    """
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > TILE)
    dealt = keyed.join(full, "key", "left")
    shares = F.coalesce(F.ceil(F.col("rows") / TILE).cast("long"), F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(node), F.col("shares"))
    # tile (i, j), i <= j, holds shares i and j
    tiles = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("shares") - 1),
        lambda other: F.least(F.col("own"), other) * F.col("shares") + F.greatest(F.col("own"), other),
    )
    placed = (
        dealt.select(node, *others, "key", shares.alias("shares"))
        .withColumn("own", own)
        .select("key", F.explode(tiles).alias("tile"), node, *others)
    )
    sorted_rows = placed.repartition("key", "tile").sortWithinPartitions("key", "tile", node)
    # a tile holds at most about two shares; most keys have one row only
    company = F.count(F.lit(1)).over(Window.partitionBy("key", "tile"))
    return sorted_rows.withColumn("company", company).filter("company > 1").drop("company")


def _placed(prints: DataFrame, first: Column) -> DataFrame:
    """``(fp, first, group)``: the least ``first`` of every fingerprint, and the group that links put it in."""
    nodes = stage(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    groups = components(links(nodes.select("fp")))
    joined = nodes.join(groups, nodes["fp"] == groups["node"], "left")
    return stage(joined.select("fp", "first", F.coalesce("component", "fp").alias("group")), "groups")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest id that can be reached over
    links of at most three differing bits, a text's own id included. Null texts and empty texts have the
    fingerprint zero and are linked like any other; a null id is no candidate for the smallest one, so its group
    has a null ``component_id`` only when it has no other id. Repeated rows stay.
    """
    prints = stage(fingerprints(docs, id, text, words), "fingerprints")
    placed = _placed(prints, F.col("id"))
    least = placed.groupBy("group").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "group").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select(F.col("id").alias(id), shown, "component_id")
