"""Phrases, prefix tries and hash forests against brute force, with odd rows, ties and hot groups."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")
from millrace.llm import hash_forest, phrases, prefix_trie  # noqa: E402

NAN = float("nan")


# -- phrases ----------------------------------------------------------------------------------------


def brute_phrases(rows, support, longest, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in able.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 50 * a and inside(q) for q, b in able.items()):
                continue
            score, _, l, r = min((int(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def corpus(seed, size=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["New", "york", "É", "漢字", "\x1c", "x\x00y"]
    rows = []
    for i in range(size):
        text = "".join(rng.choice(words) + rng.choice(["  ", " ", " ", " ", "\t", ", ", ".\n", "\r"]) for _ in range(rng.randrange(30)))
        rows.append((i, rng.choice(["en", "en", "de", None, ""]), text + rng.choice(["", "new York city", "New York City hall a b c d"])))
    return rows + [(7, "en", "same again and"), (7, "en", "same again and"), (None, "fr", "no id at all"), (8, "fr", None), (9, "fr", "")]


@pytest.mark.parametrize("longest, top", [(3, 2000), (3, 5), (5, 50), (2, 50)])
def test_phrases_match_brute_force(spark, longest, top):
    rows = corpus(longest)
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, lang string, text string, n int, score string")
    found = phrases.collocations(docs.repartition(5), longest=longest, top=top).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, phrases.SUPPORT, longest, top)


def test_phrases_do_not_depend_on_bounds(spark, monkeypatch):
    """Small chunks, a map with few bits and many copies under one id change nothing."""
    rows = corpus(1) + [(3, "en", "hot copies of one text")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for name, value in (("CHUNK", 50), ("STEP", 16), ("LANGUAGES", 1)):
        monkeypatch.setattr(phrases, name, value)
    found = phrases.collocations(docs.repartition(4)).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, phrases.SUPPORT, 3, 2000)


def test_scores_beyond_64_bits(spark):
    rows = [("en", 0, "", 10**12)] + [("en", w, p, n) for w, p, n in ((1, "a", 3 * 10**10), (1, "b", 2 * 10**10), (2, "a b", 10**10))]
    counted = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    original = phrases.count_frequent
    try:
        phrases.count_frequent = lambda *args: counted
        (row,) = phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).collect()
    finally:
        phrases.count_frequent = original
    assert (row.score, row.l, row.r, row.n) == (10**6 * 10**20 // (6 * 10**20), 3 * 10**10, 2 * 10**10, 10**12)


def test_phrases_of_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


# -- prefix trie --------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t[2] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        built[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


@pytest.mark.parametrize("limit, fan, shard", [(prefix_trie.LIMIT, prefix_trie.FAN, prefix_trie.SHARD), (1, 2, 3), (6, 3, 40), (30, 2, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, limit, fan, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PORTION", 10)
    rng = random.Random(limit)
    rows = []
    for c in [*range(-7, 60), *range(1000, 1040)]:
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            hot = c >= 1000 or rng.random() < 0.7
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"täxt {turn}" if hot else f"{rng.randrange(3)}"))
    rows += [(3, None, "system", None), (3, 1, None, "again"), (3, 1, None, "again"), (None, 0, "user", "x"), (70, 5, "", ""), (71, 0, None, None)]
    table = spark.createDataFrame([(*r, 0, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
    conv = F.col("conv_id")
    found = prefix_trie.prefix_trie(table.repartition(5), F.crc32(conv.cast("string").cast("binary")) % 9, conv - conv % 5, limit=limit, fan=fan)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(-1 if n == "parent_conv_id" and r.depth == 0 else r[n] for n in names) for r in found.collect()) == brute_trie(rows)
    assert found.filter("depth = 0 and parent_conv_id is not null").count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(5)
    for count in (0, 1, 2, 3, 1000, 20_000):
        digests = rng.integers(0, 2**64, size=(count, 2), dtype=np.uint64)
        slots = prefix_trie.Slots(digests)
        assert sorted(slots.of(digests)) == list(range(count))
        others = rng.integers(0, 2**64, size=(500, 2), dtype=np.uint64)
        assert (slots.of(others) == -1).all()
        if count:
            half = digests.copy()
            half[:, 1] ^= np.uint64(1)
            assert (slots.of(half) == -1).all()


# -- hash forest --------------------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, (i, v) in enumerate(good):
        if i % every == 0:
            near = [(-float(np.dot(v, w)), j) for c, (j, w) in enumerate(good) if c != q and len(w) == len(v)]
            found.setdefault(i, []).append([(j, -s) for s, j in sorted(near)[:k]])
    return found


def test_forest_finds_near_vectors_of_all_lengths(spark, monkeypatch):
    """Clustered vectors of different lengths, a vector with a third of all rows, and rows that take no part."""
    monkeypatch.setattr(hash_forest, "SHELF", 32)
    monkeypatch.setattr(hash_forest, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24)) * 3
    vectors = (centres[rng.integers(30, size=1200)] + rng.standard_normal((1200, 24)) * 0.3) * rng.choice([0.5, 1, 2], 1200)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))] + [(2000 + i, [1.0] * 24) for i in range(600)]
    rows += [(20, [0.5] * 24), (20, [0.5] * 24), (None, [9.0] * 24), (40, None), (60, [0.0] * 24), (80, [NAN] * 24), (100, [None] * 24), (6000, [1.0, 2.0])]
    rows += [(6020, [2.0, 1.0]), (6021, [1.0, 1.0]), (6040, [3.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, key int").repartition(6)
    found = collections.defaultdict(list)
    for r in hash_forest.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    expected = brute_nearest(rows, 20, 20)
    hits = wanted = 0
    for i, lists in expected.items():
        got = sorted(found.get(i, []))
        assert len(got) == sum(map(len, lists))
        hits += len({g[1] for g in got} & {j for one in lists for j, _ in one})
        wanted += len({j for one in lists for j, _ in one})
    assert hits / wanted >= 0.95
    hot = [g[1] for g in sorted(found[2200])]  # ties between copies go to the smaller id
    assert hot == [j for j, _ in expected[2200][0]]
    assert [g[1:] for g in sorted(found[6000])] == [(6020, 4.0), (6021, 3.0)] and 6040 not in found
    assert hash_forest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_prefixes_are_as_long_as_neighbours_are_near():
    lengths = [sum(hash_forest.depths(c)) for c in (-1.0, 0.0, 0.5, 0.9, 0.99, 0.9999)]
    assert lengths == sorted(lengths) and min(hash_forest.depths(-1.0)) == 0 and lengths[-1] > 8 * lengths[2] / 2
    for cosine in (0.3, 0.8, 0.99):
        same = 1 - np.arccos(cosine) / np.pi
        assert np.prod([1 - same**d for d in hash_forest.depths(cosine)]) <= hash_forest.MISS


def test_recall_on_given_tables(spark, sf_dir, monkeypatch):
    """Random vectors are the hardest case; small shelves make the forest decide instead of a shelf that holds all."""
    monkeypatch.setattr(hash_forest, "SHELF", 64)
    table = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    expected = brute_nearest(rows, 20, 20)
    found = collections.defaultdict(set)
    for r in hash_forest.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = sum(len(found[i] & {j for j, _ in lists[0]}) for i, lists in expected.items())
    assert hits / (20 * len(expected)) >= 0.9
