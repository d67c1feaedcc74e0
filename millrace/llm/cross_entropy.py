"""Cross-entropy difference of documents under two matched n-gram models.

A target model (documents of a chosen set) and a background model (all documents) are bigram models with the same
vocabulary, which is every word of the corpus, and the same interpolation. Every word and every pair of neighbouring words
of every document is counted by itself, under 64-bit hashes, so what is counted grows with the corpus.

Documents are packed into blocks of bounded size, written once. A block asks for its different words and pairs with its own
counts, one row per bucket of the hash range; a bucket adds up what all blocks ask for and answers every block with
the totals in the order of its question, so answers need no keys. With these totals a block scores its own documents. A word
or pair comes at most once in a block's question, so none is hot, and nothing is broadcast. A document's score is
the mean over its tokens of target loss minus background loss: the lower, the more it resembles the target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, stage

BLOCK, BLOCK_ROWS = 12 << 20, 1 << 16  # UTF-8 bytes and documents of a block; a longer document is a block of its own
BUCKET = 8 << 20  # bytes of text for which there is a bucket: about a million words and pairs asked for
PAIR_WEIGHT, PRIOR = 0.6, 0.5  # of the pair's share in a probability; added to every word's count
HELD = 200_000  # words whose hashes a task holds
START = 1  # in place of the hash of a word: the begin of a document
TURN = 17  # bits by which the second hash of a pair is turned
WORD, PAIR = 0, 1  # kinds of what is counted
NOBODY = -1  # in place of a block: the sums of a bucket


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


class Hashes(dict):
    """64-bit hashes of words, each computed once while it is held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for every pair of hashes."""
    return before ^ ((word << np.uint64(TURN)) | (word >> np.uint64(64 - TURN)))


# -- blocks -----------------------------------------------------------------------------------------


def _packed(texts: list[bytes]) -> bytes:
    lengths = np.array([len(texts), *map(len, texts)], dtype=np.int64)
    # copies far apart in a block are found too
    how = zstandard.ZstdCompressionParameters.from_level(6, enable_ldm=True, window_log=25)
    return zstandard.ZstdCompressor(compression_params=how).compress(lengths.tobytes() + b"".join(texts))


def _unpacked(block: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    ends = 8 * (count + 1) + np.cumsum(np.frombuffer(raw, dtype=np.int64, count=count + 1)[1:])
    starts = [8 * (count + 1), *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=False)]


def blocks_of(docs: DataFrame, id: str, text: str, size: int = BLOCK) -> DataFrame:
    """``(block, ids, texts, bytes)``, written once: the documents of a task in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0

        def block() -> pa.RecordBatch:
            arrays = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([held])], names=["block", "ids", "texts", "bytes"])

        for batch in portions(batches):
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                encoded = (value or "").encode("utf-8", "surrogatepass")
                if ids and (held + len(encoded) > size or len(ids) >= BLOCK_ROWS):
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(own)
                texts.append(encoded)
                held += len(encoded)
        if ids:
            yield block()

    narrow = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stage(narrow.mapInArrow(run, "block long, ids array<long>, texts binary, bytes long"), "blocks")


@dataclass
class Counted:
    """Different words (the begin of a document first) and pairs of a block in the order of their hashes."""

    sizes: np.ndarray  # words of each document
    words: np.ndarray
    word_at: np.ndarray  # for every token the place of its word
    pairs: np.ndarray
    pair_at: np.ndarray  # for every token the place of its pair with the word before
    first: np.ndarray  # for every pair a token where it comes
    starts: np.ndarray  # tokens that begin a document

    def before(self) -> np.ndarray:
        """For every pair the place of its first word."""
        return np.where(self.starts[self.first], 0, self.word_at[self.first - 1])

    def counts(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair comes in the marked documents."""
        chosen = np.repeat(documents, self.sizes)
        words = np.bincount(self.word_at[chosen], minlength=len(self.words))
        words[0] = int((documents & (self.sizes > 0)).sum())
        return words, np.bincount(self.pair_at[chosen], minlength=len(self.pairs))


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in order, for each a place where it comes, and for every place the number of its hash."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.cumsum(new, dtype=np.int32) - np.int32(1)
    at = np.empty(len(hashes), dtype=np.int32)
    at[order] = number
    return ordered[new], order[new], at


def counted(block: bytes) -> Counted:
    known, texts = Hashes(), _unpacked(block)
    size = np.array([len(tokens(text)) for text in texts], dtype=np.int64)
    hashes = np.empty(int(size.sum()) + 1, dtype=np.uint64)  # the begin in front of all
    hashes[0], filled = START, 1
    for text, own in zip(texts, size.tolist(), strict=True):
        hashes[filled : filled + own] = np.fromiter(map(known.__getitem__, tokens(text)), dtype=np.uint64, count=own)
        filled += own
    texts.clear()
    starts = np.zeros(len(hashes), dtype=bool)
    starts[np.cumsum(size) - size] = True  # of a text without words it is the next one's begin, or the end
    starts = starts[:-1]
    words, _, word_at = _different(hashes)
    before = hashes[:-1].copy()
    before[starts] = START
    both, first, pair_at = _different(pairs(before, hashes[1:]))
    return Counted(size, words, word_at[1:], both, pair_at, first, starts)


# -- questions and answers ------------------------------------------------------------------------------


def _thin(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, the high ones of all together, as they are mostly zero."""
    columns = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(columns.tobytes())


def _thick(raw: bytes) -> np.ndarray:
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(columns.T).view(np.uint64).ravel()


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin and end."""
    of = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _questions(blocks: DataFrame, buckets: int) -> DataFrame:
    """``(block, kind, bucket, hashes, target, every)``; a bucket without a word or pair of a block has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, marks in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = counted(texts.as_py())
                chosen = np.zeros(len(own.sizes), dtype=bool)
                chosen[np.array(marks.as_py() or [], dtype=np.int64)] = True
                target, every = own.counts(chosen), own.counts(np.ones_like(chosen))
                for kind, hashes in ((WORD, own.words), (PAIR, own.pairs)):
                    edges = _edges(hashes, buckets)
                    rows = [
                        (bucket, _thin(np.diff(hashes[a:b], prepend=np.uint64(0))), _thin(target[kind][a:b]), _thin(every[kind][a:b]))
                        for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                        if a < b
                    ]
                    if rows:
                        bucket, *parts = zip(*rows, strict=True)
                        same = [np.full(len(rows), x, dtype=t) for x, t in ((block.as_py(), np.int64), (kind, np.int32))]
                        arrays = [pa.array(x) for x in same] + [pa.array(bucket, pa.int32())]
                        arrays += [pa.array(x, pa.binary()) for x in parts]
                        yield pa.RecordBatch.from_arrays(arrays, names=["block", "kind", "bucket", "hashes", "target", "every"])

    columns = "block long, kind int, bucket int, hashes binary, target binary, every binary"
    return blocks.select("block", "texts", "marks").mapInArrow(run, columns)


def _answer(table: pa.Table) -> pa.Table:
    """The totals of a bucket for every block that asked, and for ``NOBODY`` its number of words and the sum of their counts."""
    asked = [np.cumsum(_thick(x), dtype=np.uint64) for x in table["hashes"].to_pylist()]
    hashes, at = np.unique(np.concatenate(asked), return_inverse=True)
    totals = [
        np.bincount(at, np.concatenate([_thick(x) for x in table[name].to_pylist()]).astype(float), len(hashes)).astype(np.int64)
        for name in ("target", "every")
    ]
    ends = np.cumsum([len(a) for a in asked])
    parts = [[_thin(t[x]) for x in np.split(at, ends[:-1])] for t in totals]
    count = len(asked)
    start = (hashes == START) & (table["kind"][0].as_py() == WORD)
    sums = [int((~start).sum()), *(int(t[m].sum()) for m in (~start, start) for t in totals)]
    return pa.table({
        "block": pa.array([*table["block"].to_pylist(), NOBODY], pa.int64()),
        "kind": pa.array([table["kind"][0].as_py()] * (count + 1), pa.int32()),
        "bucket": pa.array([table["bucket"][0].as_py()] * (count + 1), pa.int32()),
        "target": pa.array([*parts[0], None], pa.binary()),
        "every": pa.array([*parts[1], None], pa.binary()),
        "sums": pa.array([None] * count + [sums], pa.list_(pa.int64())),
    })


def score(
    docs: DataFrame, target_ids: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """``(id, n_tokens, target_loss, background_loss, score)`` for every row of ``docs``.

    ``target_ids`` has a column ``id`` with the ids of the target documents; repeated and null ids there add nothing. A
    text without words, as a null or an empty one, has null losses and a null score; repeated rows count and score as often as
    they come. A text of any length is scored whole, in a block of its own if need be. Other columns of ``docs`` are not
    read, whatever their names. ``block`` and ``bucket`` bound what a task holds and change no result.
    """
    blocks = blocks_of(docs, id, text, block)
    chosen = target_ids.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct()
    # ids grow with the labels: a sort-merge plan at every size, which splits an id that comes very often
    marks = (
        blocks.select("block", F.posexplode("ids").alias("place", "id"))
        .join(chosen.hint("merge"), "id", "left_semi")
        .groupBy("block")
        .agg(F.collect_list("place").alias("marks"))  # places of a block, so at most BLOCK_ROWS
    )
    buckets = int((blocks.agg(F.sum("bytes")).first()[0] or 0) // bucket) + 1
    questions = _questions(blocks.join(marks.hint("merge"), "block", "left"), buckets)
    columns = "block long, kind int, bucket int, target binary, every binary, sums array<long>"
    answers = stage(questions.groupBy("kind", "bucket").applyInArrow(_answer, columns), "answers")
    sums = answers.filter((F.col("block") == NOBODY) & (F.col("kind") == WORD))
    total = sums.agg(*(F.sum(F.col("sums")[i]).alias(str(i)) for i in range(5))).first()
    words, *size = (x or 0 for x in total)

    def losses(own: Counted, totals: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        """For both models the loss of every document's tokens together."""
        before, word, of = own.before(), own.word_at[own.first], np.repeat(np.arange(len(own.sizes)), own.sizes)
        for model in range(2):
            word_counts, pair_counts = totals[WORD][model].copy(), totals[PAIR][model]
            word_counts[0] = size[2 + model]
            share = np.minimum(pair_counts / np.maximum(word_counts[before], 1), 1)
            chance = (word_counts[word] + PRIOR) / (size[model] + PRIOR * (words + 1))
            loss = -np.log(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * chance)
            yield np.bincount(of, loss[own.pair_at], len(own.sizes))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        own = counted(left["texts"][0].as_py())
        rows = sorted(zip(*(right[c].to_pylist() for c in ("kind", "bucket", "target", "every")), strict=True))
        none = [np.zeros(0)]
        totals = [
            [np.concatenate([_thick(r[2 + model]) for r in rows if r[0] == kind] or none).astype(float) for model in range(2)]
            for kind in (WORD, PAIR)
        ]
        some = own.sizes > 0
        sums = [pa.array(x / np.maximum(own.sizes, 1), mask=~some) for x in losses(own, totals)]
        both = pa.array(sums[0].to_numpy(zero_copy_only=False) - sums[1].to_numpy(zero_copy_only=False), mask=~some)
        return pa.table([left["ids"][0].values, pa.array(own.sizes), *sums, both], names=names)

    names = [id, "n_tokens", "target_loss", "background_loss", "score"]
    asked = answers.filter(F.col("block") != NOBODY).select("block", "kind", "bucket", "target", "every")
    pairs = blocks.select("block", "ids", "texts").groupBy("block").cogroup(asked.groupBy("block"))
    return pairs.applyInArrow(scored, f"`{id}` long, n_tokens long, target_loss double, background_loss double, score double")
