"""Collocations: phrases of a few words whose words attract each other, mined shard by shard.

A phrase that comes often enough in all documents reaches its share of that support in one shard at least, whichever way the
documents are dealt to shards. So each shard is mined completely at the lowered support, level by level: a longer
phrase is counted only where both phrases it is made of are frequent in the same shard. Where a phrase was not counted it is
infrequent, so the counts of all shards bound how often it comes at most, and what cannot reach the support goes. What is
frequent somewhere is then counted in all documents, exactly and under its own words.

What is frequent in a shard is kept as a bit map of fixed size that tasks test against. Two phrases with the same bit
make the test pass more often, never less, and the final counts decide: the size of the map bears on speed, not on results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, portions, stage

LONGEST, SUPPORT, TOP = 3, 10, 2000  # words of a phrase, occurrences of a candidate, phrases shown of a language
CONTAINED = (50, 100)  # a candidate goes if a longer one around it has this share of its occurrences
SCALE = 1_000_000
SHARDS = 3  # the support of a shard is SUPPORT / SHARDS, rounded up
BITS = 1 << 27  # of the map of a level, whatever the input: 16 MB
KEY_BITS = 40  # of a key under which phrases are counted in a shard; the lowest are its place in the map
KEY = np.uint64((1 << KEY_BITS) - 1)
#: What tells the shards apart in the map: each turns other bits of a place.
SHIFTS = np.array([xxhash.xxh64_intdigest(bytes([s])) % BITS for s in range(SHARDS)], dtype=np.uint64)
CHUNK, STEP = 1 << 21, 1 << 18  # words a task holds before it hands on what it counted; words whose keys are made at once
LANGUAGES = 1000  # languages a task holds at once
LANES, FAN_IN = 64, 4  # tasks that rank the phrases of one language; how many of their lists one task merges
UNKNOWN = "und"
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
TURNS = (0, 17, 34, 51, 5, 22, 39, 56)  # bits by which the hash of the first, second, … word of a phrase is turned


def pieces(text: str | None) -> list[list[bytes]]:
    """Words of the pieces between punctuation and line ends; only A-Z are lower-cased."""
    encoded = (text or "").encode("utf-8", "surrogatepass").lower().translate(BREAKS)
    return [p.split() for p in encoded.split(b"\n")]


class Numbers(dict):
    """Words by the order in which they were first met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class Chunk:
    """Words of some documents of one language, with the places where phrases of each length begin."""

    def __init__(self, lang: str) -> None:
        self.lang, self.known = lang, Numbers()
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.shards: list[tuple[int, int]] = []  # of each document: shard and number of words
        self.words = 0

    def add(self, text: str | None, shard: int) -> None:
        found = pieces(text)
        self.sizes += map(len, found)
        count = sum(map(len, found))
        self.parts.append(np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), dtype=np.int32, count=count))
        self.shards.append((shard, count))
        self.words += count

    def close(self) -> None:
        self.at = np.concatenate(self.parts)
        self.parts.clear()
        sizes = np.array(self.sizes, dtype=np.int64)
        # words from here to the end of the piece
        self.left = np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) - np.arange(len(self.at), dtype=np.int32)
        salt = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        names = list(self.known)
        self.known.clear()
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(n, salt) for n in names), dtype=np.uint64, count=len(names))
        self.names = pa.array([n.decode("utf-8", "surrogatepass") for n in names], pa.string())
        shards, counts = (np.array(x) for x in zip(*self.shards, strict=True))
        self.shard = np.repeat(shards.astype(np.int8), counts)

    def keys(self, begins: np.ndarray, length: int) -> np.ndarray:
        """One number for each phrase of ``length`` words that begins at a place, in this language."""
        mixed = self.hashes[self.at[begins]]
        for i in range(1, length):
            word, turn = self.hashes[self.at[begins + i]], TURNS[i % len(TURNS)]
            mixed ^= (word << np.uint64(turn)) | (word >> np.uint64(64 - turn)) if turn else word
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return mixed

    def begins(self, length: int) -> Iterator[np.ndarray]:
        """Places of all phrases of ``length`` words, in portions."""
        for start in range(0, len(self.at), STEP):
            yield start + np.flatnonzero(self.left[start : start + STEP] >= length)

    def tally(self, length: int, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, shards and numbers of the phrases of ``length`` words whose parts are all frequent in the shard."""
        held = [np.zeros(0, dtype=np.uint64)]
        for places in self.begins(length):
            for shorter, known in enumerate(maps[: length - 1], 1):
                for shift in range(length - shorter + 1):
                    at = places + shift
                    places = places[_has(known, self.keys(at, shorter), SHIFTS[self.shard[at]])]
            shard = self.shard[places].astype(np.uint64)
            held.append((self.keys(places, length) & KEY) | (shard << np.uint64(KEY_BITS)))
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        own = keys[edges]
        return own & KEY, own >> np.uint64(KEY_BITS), np.diff(edges, append=len(keys))

    def phrases(self, length: int, known: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Phrases of ``length`` words that some shard has often, with how often they come here, told apart by their words."""
        held = [np.zeros(0, dtype=np.int64)]
        for places in self.begins(length):
            keys = self.keys(places, length)
            held.append(places[np.logical_or.reduce([_has(known, keys, shift) for shift in SHIFTS])])
        places = np.concatenate(held)
        code = self.at[places].astype(np.int64)
        for i in range(1, length):
            if int(code.max(initial=0)) >= (1 << 62) // max(len(self.names), 1):
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(self.names) + self.at[places + i]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        first = places[first]
        words = [self.names.take(pa.array(self.at[first + i])) for i in range(length)]
        return pc.binary_join_element_wise(*words, " ") if length > 1 else words[0], counts


def _has(known: np.ndarray, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
    at = (keys ^ shift) & np.uint64(BITS - 1)
    return (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _chunked(batches: Iterable[pa.RecordBatch], handle: Callable[[Chunk], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand on what ``handle`` makes of the documents of a task, gathered by language in chunks of bounded size."""
    held: dict[str, Chunk] = {}
    words = 0
    for batch in portions(batches):
        for lang, text, shard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (own := held.get(lang)) is None:
                own = held[lang] = Chunk(lang)
            before = own.words
            own.add(text, shard)
            words += own.words - before
            if words > CHUNK or len(held) > LANGUAGES:
                while held:
                    one = held.popitem()[1]
                    one.close()
                    yield from handle(one)
                words = 0
    while held:
        one = held.popitem()[1]
        one.close()
        yield from handle(one)


def _frequent_in_shards(docs: DataFrame, length: int, maps: list, support: int) -> np.ndarray:
    """The bit map, by shards, of the phrases of ``length`` words that a shard has often and that can reach ``support``."""
    local = math.ceil(support / SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [m.value for m in maps]

        def handle(own: Chunk) -> Iterator[pa.RecordBatch]:
            found, shard, counts = own.tally(length, known)
            if len(found):
                arrays = [pa.array(x.astype(t)) for x, t in ((found, np.int64), (shard, np.int8), (counts, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "shard", "n"])

        yield from _chunked(batches, handle)

    shards = [f"s{s}" for s in range(SHARDS)]
    counted = docs.mapInArrow(run, "key long, shard byte, n int").groupBy("key").agg(
        *(F.sum(F.when(F.col("shard") == s, F.col("n"))).alias(name) for s, name in enumerate(shards))
    )
    # all words are counted; of longer phrases a shard without a count has less than its support
    most = F.lit(0 if length == 1 else local - 1)
    able = counted.filter(sum(F.coalesce(name, most) for name in shards) >= support)
    frequent = F.filter(
        F.array(*(F.when(F.col(name) >= local, F.lit(int(SHIFTS[s]))) for s, name in enumerate(shards))), lambda x: x.isNotNull()
    )
    place = able.select(F.explode(frequent).alias("shift"), "key").select(
        (F.col("key").bitwiseXOR(F.col("shift")).bitwiseAND(BITS - 1) + 1).alias("place")  # Spark's buckets count from one
    )
    rows = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    whole = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows.toLocalIterator():  # BITS / 32768 buckets of 4 KB at most, whatever the input
        start = (row.bucket - 1) * 4096
        whole[start : start + 4096] |= np.frombuffer(row.bits, dtype=np.uint8)
    return whole


def count_frequent(docs: DataFrame, id: str, lang: str, text: str, support: int = SUPPORT, longest: int = LONGEST) -> DataFrame:
    """``(lang, words, phrase, n)``: all phrases of 1 to ``longest`` words with at least ``support`` occurrences in a language.

    A row with ``words`` 0 counts all words of a language.
    """
    spark = docs.sparkSession
    own = F.pmod(F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")), F.lit(SHARDS)).cast("int")  # copies under other ids part
    narrow = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"), own.alias("shard"),
    )
    maps: list = []
    for length in range(1, longest + 1):
        maps.append(spark.sparkContext.broadcast(_frequent_in_shards(narrow, length, maps, support)))
        let_go(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [m.value for m in maps]

        def handle(one: Chunk) -> Iterator[pa.RecordBatch]:
            yield rows(one.lang, 0, pa.array([""]), np.array([one.words]))
            for length in range(1, longest + 1):
                yield rows(one.lang, length, *one.phrases(length, known[length - 1]))

        def rows(lang: str, words: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            same = [pa.repeat(pa.scalar(x, t), len(n)) for x, t in ((lang, pa.string()), (words, pa.int32()))]
            return pa.RecordBatch.from_arrays([*same, phrase, pa.array(n, pa.int64())], names=["lang", "words", "phrase", "n"])

        yield from _chunked(batches, handle)

    counted = narrow.mapInArrow(run, "lang string, words int, phrase string, n long")
    sums = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    kept = stage(sums.filter((F.col("n") >= support) | (F.col("words") == 0)), "phrases")
    del counted, sums
    let_go(spark)
    return kept


def _parts(words: Column, cut: Column) -> Column:
    """The first ``cut`` words and the rest, as phrases."""
    return F.struct(
        cut.alias("cut"), F.array_join(F.slice(words, 1, cut), " ").alias("head"),
        F.array_join(F.slice(words, cut + 1, F.size(words)), " ").alias("tail"),
    )


def collocations(
    docs: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text", support: int = SUPPORT,
    longest: int = LONGEST, top: int = TOP,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``longest`` words of every language.

    ``a`` is how often a phrase comes, ``l`` and ``r`` how often its two parts do at the cut with the lowest score
    (of equal scores the first), ``n`` the words of the language. ``score`` is floor(1000000 * a * a / (l * r)), exact. A phrase
    that a longer candidate contains goes if that one has half its occurrences or more. Higher scores come first, then
    higher ``a``, then the phrase by its bytes. A null text has no words, a null language is ``und``, repeated rows count as
    often as they come, and texts are counted whole whatever their length. The id only deals rows to shards, where a null does as
    well; other columns are not read. A language without candidates has no row.
    """
    counted = count_frequent(docs, id, lang, text, support, longest)
    total = counted.filter("words = 0").select("lang", F.col("n").alias("total"))
    candidates = counted.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    def inner(size: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")
        )

    around = (
        candidates.filter("words > 2")
        .select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), inner))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("around"))
    )
    share, whole = CONTAINED
    alone = candidates.join(around.hint("merge"), ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("around") * whole < F.col("a") * share, F.lit(True))
    )
    cuts = alone.select(
        "lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: _parts(words, k))).alias("c")
    ).select("lang", "phrase", "a", "c.*")
    known = counted.filter("words > 0")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    met = cuts.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
    a, l, r = (F.col(c).cast("decimal(18,0)") for c in "alr")  # noqa: E741
    scored = met.withColumn("score", F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, l * r))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))

    rows = best.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(LANES)).alias("lane"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    lanes = LANES
    while lanes:
        place = Window.partitionBy("lang", F.expr(f"lane % {lanes}")).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
        lanes //= FAN_IN
    return rows.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"),
        F.col("score").cast("long").alias("score"),
    )
