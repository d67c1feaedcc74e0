"""Operators on texts against brute force, libraries and small hand-made tables."""

import collections
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from millrace.llm import (  # noqa: E402
    cross_entropy,
    edit_counts,
    knn_quality,
    mixture,
    near_copies,
    piece_bpe,
    preference,
    simhash,
)
from millrace.llm import components as stars  # noqa: E402
from millrace.llm.components import components  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, EPOCH string, n_tokens int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = "the quick brown fox jumps over the lazy dog " * 4000
    rows = [
        (1, "one two three four five six", "en", "a", "x", 1, "s"),
        (1, "one two three four five six", "en", "a", "x", 1, "s"),
        (2, None, None, None, None, None, None),
        (3, "", "de", "a", "x", 1, "s"),
        (4, "  \n\t ", "de", "b", "x", 1, "s"),
        (5, long, "en", "b", "x", 1, "s"),
        (6, long + "end", "en", "b", "x", 1, "s"),
        (None, "a b c d e", "fr", "c", "x", 1, "s"),
        (8, "ONE two three four five six", "en", "a", "x", 1, "s"),
        (9, "▁ é€𝄞 \x00 漢字" + " " * 40, "es", "c", "x", 1, "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_components_match_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(900, 960)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(table).collect()}
    assert all(found.get(x, x) == find(x) for x in parent)
    assert components(table.limit(0)).count() == 0


def test_pieces_match_the_library(library):
    model = piece_bpe.load(MODEL)
    random.seed(3)
    alphabet = "ab et the in er  ▁▁   \n\t0123é€𝄞漢字aaabbb'\".,!x"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(40))) for _ in range(3000)]
    texts += [" " * n + "the" + " " * n for n in range(40)] + ["a" * 3000, " " * 3000, "ab" * 2000, "漢" * 1000]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [random.choice([random.randrange(32000), random.randrange(300), 259, 28705]) for _ in range(8)]
        assert model.decode(ids) == library.decode(ids)


def test_longest_piece_is_given_up_where_it_does_not_fit(library):
    model = piece_bpe.load(MODEL)
    greedy = lambda t: model.longest(t, 0)
    words = [f"▁{a}{b}" for a in ("the", "inter", "un") for b in ("ation", "ers", "ing", "edly", "est", "nessing")]
    assert all(model.split(w) == model.merge(w) for w in words)
    assert any(model.split(w)[0] != greedy(w) for w in words)


def test_encoding_keeps_columns(docs, library):
    rows = piece_bpe.encode_documents(docs, MODEL).collect()
    assert len(rows) == docs.count()
    for row in rows:
        ids = library.encode(row.text or "", add_eos=True)
        assert list(row.ids) == ids and row["n_tokens_"] == len(ids) and row.decoded == library.decode(ids)
    assert piece_bpe.token_digests(docs.limit(0), MODEL).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_groups(spark, docs):
    random.seed(7)
    texts = [" ".join(random.choice("abcdefgh") * 3 for _ in range(random.randrange(60))) for _ in range(60)]
    near = [(100 + i, random.choice(texts) + random.choice(["", "", " tail", " other end"])) for i in range(400)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = simhash.near_duplicates(table).collect()
    given = table.collect()
    assert len(rows) == len(given)
    prints = defaultdict(set)
    for r in given:
        prints[r.doc_id].add(f"{brute_fingerprint(r.text):016x}")
    assert all(r.fingerprint in prints[r.doc_id] for r in rows)
    nodes = sorted({int(r.fingerprint, 16) for r in rows})
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            root = find(int(r.fingerprint, 16))
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(find(int(r.fingerprint, 16))) for r in rows)


def test_hot_keys_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    assert len(found) == len(prints) - 1 and len({r.component for r in found}) == 1


def test_every_pair_within_three_bits_is_linked(spark):
    """Pairs of all shapes: one to four flipped bits anywhere, each pair far from all others."""
    random.seed(11)
    linked, apart = [], []
    for flips in (1, 2, 3, 4):
        for _ in range(400):
            one = random.getrandbits(64)
            other = one
            for b in random.sample(range(64), flips):
                other ^= 1 << b
            (linked if flips <= 3 else apart).append((one, other))
    signed = [(p - (1 << 64) if p >> 63 else p,) for pair in linked + apart for p in pair]
    found = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert found == {frozenset(pair) for pair in linked}


def test_quality_votes(spark, docs):
    random.seed(2)
    good = [(i, " ".join(random.choice(["river", "stone", "walks", "under"]) for _ in range(30))) for i in range(20, 120)]
    bad = [(i, " ".join(random.choice(["$$$", "###", "CLICK", "!!!"]) for _ in range(30))) for i in range(120, 220)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), None) for i in range(20, 220)] + [(None, 1, 0), (21, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = knn_quality.score(table, labels).collect()
    assert all(r.predicted == int(r.doc_id < 120) for r in rows) and any(r.held_out for r in rows)
    odd = knn_quality.score(docs, labels)
    assert odd.count() == docs.count() and {"score", "score_", "held_out", "predicted"} <= set(odd.columns)
    assert {r.score for r in knn_quality.score(table, labels.limit(0)).collect()} == {0.5}
    assert knn_quality.score(table.limit(0), labels).count() == 0
    assert knn_quality.keep_good(docs, labels).columns == docs.columns


def test_held_out_accuracy_on_given_tables(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    scored = knn_quality.score(spark.read.parquet(f"{base}/documents.parquet"), labels, keep_text=False)
    rows = scored.filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    right = sum(r.quality == r.predicted for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.98


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("x", "en", "a", 100), ("x", "en", "b", 1000), ("x", "de", "c", 1000), ("y", "en", "d", 1000), ("y", "en", "z", 0)],
        "domain string, lang string, source string, tokens long",
    )
    weights = spark.createDataFrame([("source", "a", 3), ("domain", "x", 1)], "level string, name string, weight long")
    found = {
        r.source: r.budget for r in mixture.leaf_budgets(leaves, weights, (1200, 3100), 1).collect()
    }  # x and y get 600 each, en and de 300; a can give 100 of its 225, and its sibling b gives the rest
    assert found == {"a": 100, "b": 200, "c": 300, "d": 600, "z": 0}
    none = spark.createDataFrame([("domain", "x", 0)], "level string, name string, weight long")
    assert {r.source: r.budget for r in mixture.leaf_budgets(leaves, none, (1, 1), 1).collect()}["d"] == 1000


def test_mixture_keeps_odd_rows_whole(spark, docs):
    weights = spark.createDataFrame([("lang", "en", 2)], "level string, name string, weight long")
    mixed = mixture.mix(docs, F.lit("all"), weights, (1, 1), 2)
    assert {"epoch_", "n_tokens_", "EPOCH", "n_tokens"} <= set(mixed.columns)
    twice = [(r.doc_id, r["epoch_"]) for r in mixed.filter("doc_id = 1").collect()]
    assert len(twice) % 2 == 0  # repeated rows go together
    assert mixture.mix(docs.limit(0), F.lit("all"), weights).count() == 0


def test_mixture_keeps_columns_named_like_its_own(spark, docs):
    own = ["full", "cut_hash", "cut_id", "_domain", "_FULL", "domain", "hash", "prefix", "budget", "tokens", "id"]
    more = docs.withColumns({name: F.lit(name) for name in own})
    weights = spark.createDataFrame([("lang", "en", 2)], "level string, name string, weight long")
    mixed = mixture.mix(more, F.lit("all"), weights, (1, 1), 2)
    assert all(r[name] == name for r in mixed.collect() for name in own)
    assert sorted(map(str, mixed.select(*docs.columns).collect())) == sorted(
        map(str, mixture.mix(docs, F.lit("all"), weights, (1, 1), 2).select(*docs.columns).collect())
    )


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, extra int"
    chosen = spark.createDataFrame(
        [(1, 0, "user", "q", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", "more", 0), (2, 0, None, None, 0),
         (3, 0, "user", "only", 0), (None, 0, "user", "x", 0), (1, None, "user", "x", 0), (1, 0, "user", "q", 0)], schema
    )
    rejected = spark.createDataFrame(
        [(1, 0, "user", "q", 0), (1, 1, "assistant", "no", 0), (2, 0, "", "", 0)], schema
    )
    rows = {r.pair_id: r for r in preference.format_pairs(chosen, rejected).collect()}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.prompt_turns == 1
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [one.chosen[s["from"] : s["to"]] for s in one.chosen_mask] == ["yes<|im_end|>\n"]
    assert [one.rejected[s["from"] : s["to"]] for s in one.rejected_mask] == ["no<|im_end|>\n"]
    assert rows[2].prompt_turns == 1 and rows[2].chosen == rows[2].rejected == ""
    assert rows[3].prompt_turns == 0 and rows[3].rejected == "" and rows[3].chosen_mask == []
    assert preference.format_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_counts_follow_edits():
    counts = edit_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    full = lambda t: len(counts.encoding.encode_ordinary(t))
    random.seed(5)
    alphabet = "ab re's 'll  \n\t12 é漢!?.,'  "
    for _ in range(400):
        text = "".join(random.choice(alphabet) for _ in range(random.randrange(120)))
        tree = edit_counts.CountTree(text, counts)
        for _ in range(8):
            at, deleted = random.randrange(-2, len(text) + 3), random.choice([0, 0, 1, 3, 30])
            inserted = "".join(random.choice(alphabet) for _ in range(random.choice([0, 1, 2, 5, 40])))
            start = min(max(at, 0), len(text))
            text = text[:start] + inserted + text[start + min(deleted, len(text) - start) :]
            tree.edit(at, deleted, inserted)
            assert tree.text == text and tree.total == full(text)
    tree = edit_counts.CountTree("word and ' more" * 2000, counts)
    for _ in range(300):
        tree.edit(random.randrange(len(tree.text)), 5, "zz top's")
    assert tree.total == full(tree.text) and tree.counted_again < len(tree.text)


def test_edit_table(docs):
    edits = F.expr("array(named_struct('at', 2L, 'deleted', 1L, 'inserted', 'new words'), NULL, "
                   "named_struct('at', CAST(NULL AS BIGINT), 'deleted', CAST(NULL AS BIGINT), 'inserted', ' x'))")  # fmt: skip
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = docs.withColumn("edits", F.when(F.col("doc_id") != 5, edits))
    rows = edit_counts.count_edited(table, ranks, public_tokenizers.PATTERN).collect()
    counts = edit_counts.counter(ranks, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        before = texts[r.doc_id]
        after = before if r.n_edits == 0 else before[:2] + "new words" + before[3:] + " x"
        assert (r.n_tokens_before, r.n_tokens) == tuple(len(counts.encoding.encode_ordinary(t)) for t in (before, after))


def test_kept_trees_take_later_edits(spark, docs, tmp_path):
    """Three batches on trees that are written in between, against whole counts; later ones count few characters again."""
    ranks, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(4)
    counts = edit_counts.counter(ranks, public_tokenizers.PATTERN)
    text = "many words of a text that's going on, and on. " * 300
    table = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(70, text, "s"), (71, text, "t")], "doc_id long, text string, score string"))
    table = table.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    trees = edit_counts.plant(table, ranks, public_tokenizers.PATTERN)
    for number in range(3):
        trees.write.parquet(f"{tmp_path}/{number}")
        kept = spark.read.parquet(f"{tmp_path}/{number}")
        batch = [(i, [(rng.randrange(len(t) + 1), rng.randrange(9), rng.choice(["", " x y", "'ll", "a" * 90])) for _ in range(3)]) for i, t in texts.items() if i != 71]
        for i, edits in batch:
            for at, deleted, inserted in edits:
                at = min(at, len(texts[i]))
                texts[i] = texts[i][:at] + inserted + texts[i][at + deleted :]
        given = spark.createDataFrame(batch, "doc_id long, edits array<struct<at:long,deleted:long,inserted:string>>")
        trees = edit_counts.apply_edits(edit_counts.with_edits(kept, given), ranks, public_tokenizers.PATTERN)
        for r in trees.collect():
            assert r.text == texts[r.doc_id] and r.n_tokens == len(counts.encoding.encode_ordinary(r.text)) == r.tokens[1]
            assert r.n_edits == (0 if r.doc_id == 71 else 3) and r.counted_again <= (0 if r.doc_id == 71 else 3 * len(r.text) + 900)
            assert r.doc_id != 70 or r.counted_again < len(r.text) / 10
    assert set(trees.columns) == {"doc_id", "text", "score", *edit_counts.KEPT, *edit_counts.COUNTED}


def test_context_of_patterns():
    assert edit_counts.context_of(public_tokenizers.PATTERN) >= 3
    assert edit_counts.context_of(r"\s+(?!\S)|[^\s]+") >= 1
    for bad in (r"(?<=a)b|.", r"\bword", r"a$", r"x(?=ab)|.", r"(a)\1"):
        with pytest.raises(ValueError):
            edit_counts.context_of(bad)


def test_cross_entropy_difference(spark, docs):
    rows = [(i, "red green blue " * 5) for i in range(10, 30)] + [(i, "cat dog cow " * 5) for i in range(30, 70)]
    table = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    )
    target = spark.createDataFrame([(i,) for i in (*range(10, 20), 10, None)], "id long")
    scored = {r.doc_id: r for r in cross_entropy.score(table, target).collect()}
    assert scored[25].score < 0 < scored[60].score  # also for documents that are not of the target themselves
    assert scored[3].score is None and scored[3].n_tokens == 0
    assert cross_entropy.score(table.limit(0), target).count() == 0


@pytest.mark.parametrize("block, bucket", [(1, 1 << 12), (200_000, 1 << 20), (cross_entropy.BLOCK, cross_entropy.BUCKET)])
def test_cross_entropy_matches_brute_force(spark, docs, block, bucket):
    """Whether a document is a block of its own or all share one, the losses are those of the whole models."""
    target = spark.createDataFrame([(1,), (5,)], "id long")
    table = docs.select("doc_id", "text").collect()
    words = [[w for w in re.split("[\x20\x09-\x0d]+", (r.text or "")) if w] for r in table]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws] for ws in words]
    models = []
    for kept in ({1, 5}, None):
        single, pair, total = collections.Counter(), collections.Counter(), 0
        for r, ws in zip(table, words, strict=True):
            if kept is None or r.doc_id in kept:
                single.update(ws)
                single.update([None] if ws else [])
                pair.update(zip([None, *ws], ws, strict=False))
                total += len(ws)
        models.append((single, pair, total))
    size = len({w for ws in words for w in ws}) + 1
    expected = []
    for r, ws in zip(table, words, strict=True):
        losses = []
        for single, pair, total in models:
            chance = [(single[w] + 0.5) / (total + 0.5 * size) for w in ws]
            share = [min(pair[b, w] / max(single[b], 1), 1) for b, w in zip([None, *ws], ws, strict=False)]
            losses.append(-sum(math.log(0.6 * s + 0.4 * c) for s, c in zip(share, chance, strict=True)) / (len(ws) or 1))
        expected.append((str(r.doc_id), len(ws), *((round(x, 9) for x in losses) if ws else (None, None))))
    scored = cross_entropy.score(docs, target, block=block, bucket=bucket).collect()
    found = [
        (str(r.doc_id), r.n_tokens, *(x if x is None else round(x, 9) for x in (r.target_loss, r.background_loss)))
        for r in scored
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("block, bucket", [(1000, 20_000), (100_000, 1000), (cross_entropy.BLOCK, cross_entropy.BUCKET)])
def test_cross_entropy_counts_every_word(spark, block, bucket):
    """Many words over several blocks, most of them once and one very long: each has counts of its own."""
    rows = [(i, f"shared words w{i} x{i % 7}") for i in range(20_500)] + [(20_500, "y" * 100 + " shared")]
    target = spark.createDataFrame([(i,) for i in range(0, 20_500, 7)], "id long")
    scored = cross_entropy.score(spark.createDataFrame(rows, "doc_id long, text string"), target, block=block, bucket=bucket)
    found = {r.doc_id: r for r in scored.filter("doc_id in (7, 8, 20500)").collect()}
    models = []
    for kept in (lambda i: i % 7 == 0 and i < 20_500, lambda i: True):
        single, pair = collections.Counter(), collections.Counter()
        for i, text in rows:
            if kept(i):
                ws = text.split()
                single.update([None, *ws])
                pair.update(zip([None, *ws], ws, strict=False))
        models.append((single, pair, sum(single.values()) - single[None]))
    size = len(models[1][0])  # all words and the unseen one, as None stands for the begin
    for i, r in found.items():
        ws = rows[i][1].split()
        for (single, pair, total), got in zip(models, (r.target_loss, r.background_loss), strict=True):
            chance = [(single[w] + 0.5) / (total + 0.5 * size) for w in ws]
            share = [min(pair[b, w] / max(single[b], 1), 1) for b, w in zip([None, *ws], ws, strict=False)]
            expected = -sum(math.log(0.6 * s + 0.4 * c) for s, c in zip(share, chance, strict=True)) / len(ws)
            assert got == pytest.approx(expected, abs=1e-9)


def test_cross_entropy_of_words_that_all_come_once(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5))) for i in range(40)]
    target = spark.createDataFrame([(i,) for i in range(10)], "id long")
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in cross_entropy.score(table, target, block=100, bucket=50).collect():
        expected = []
        for inside, starts, total in ((r.doc_id < 10, 10, 50), (True, 40, 200)):
            chance = (inside + 0.5) / (total + 0.5 * 201)
            losses = [-math.log(0.6 * s + 0.4 * chance) for s in (inside / starts, *[float(inside)] * 4)]
            expected.append(sum(losses) / 5)
        assert (r.target_loss, r.background_loss) == pytest.approx(expected, abs=1e-9)


def test_repeated_ids_with_different_texts_are_documents_of_their_own(spark):
    random.seed(13)
    one, two, three, four = (" ".join(random.choice("abcdefgh") * 3 for _ in range(40)) for _ in range(4))
    rows = [(1, one), (7, one), (7, two), (7, two), (8, two), (5, three), (5, four), (5, None), (6, ""), (None, one)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame([(*r, "own") for r in order], "doc_id long, text string, kept_digest string")
        kept = near_copies.keep_first(table)
        assert kept.columns == table.columns
        found = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
        assert found == sorted([(0, one), (1, one), (7, two), (5, three), (5, four), (5, "")])
    cased = spark.createDataFrame([(3, one), (3, one.upper()), (4, one)], "doc_id long, text string")
    assert len(near_copies.keep_first(cased).collect()) == 1  # different texts of one id in one group


def brute_links(texts):
    """Pairs of different texts with a similarity of 0.8, by the rarest shingles, which one of them must share."""
    sets = []
    for t in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    often = collections.Counter(s for x in sets for s in x)
    index, links = collections.defaultdict(list), set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        rare = sorted(sets[i], key=lambda s: (often[s], s))[: len(sets[i]) - math.ceil(0.8 * len(sets[i])) + 1]
        for j in {j for s in rare for j in index[s]}:
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                links.add((j, i))
        for s in rare:
            index[s].append(i)
    return links


def test_near_copies_on_given_tables(spark, sf_dir):
    """Nine in ten texts with a near copy are grouped with one, and texts grouped are near copies or linked by some."""
    table = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/documents.parquet")
    digests = table.filter("text is not null").select(simhash.text_digest("text").alias("node"), "text").distinct().collect()
    links = brute_links([r.text for r in digests])
    group = {r.node: r.group for r in near_copies.groups(table).collect()}
    of = [group[r.node] for r in digests]
    assert links and sum(of[a] == of[b] for a, b in links) >= 0.9 * len(links)
    linked = collections.defaultdict(set)
    for a, b in links:
        linked[a].add(b)
        linked[b].add(a)
    by_group = collections.defaultdict(set)
    for i, g in enumerate(of):
        by_group[g].add(i)
    for members in by_group.values():
        reached, todo = set(), [min(members)]
        while todo:
            i = todo.pop()
            if i not in reached:
                reached.add(i)
                todo += linked[i]
        assert members <= reached or not any(digests[i].text.strip() for i in members)


def test_a_crowd_of_near_copies_and_strangers(spark):
    """Hundreds of near copies of one text are one group; texts that share a long passage are not."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"changed{i}"
        texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(150)] + passage) for _ in range(100)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in near_copies.keep_first(table).collect())
    assert kept == [0, *range(300, 400)]


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(60))) for _ in range(60)]
    near = [(100 + i, rng.choice(texts) + rng.choice(["", "", " tail", " other end"])) for i in range(400)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    given = table.distinct().collect()
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    empty = [i for i, r in enumerate(given) if not (r.text or "").strip()]
    for a, b in [*brute_links([r.text for r in given]), *zip(empty, empty[1:], strict=False)]:
        parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(given):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    kept = near_copies.keep_first(table).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert sum(r.doc_id is None for r in kept) == 1


def plain_counts(text):
    """Trigrams of bytes by bucket and repeated words per thousand, one by one."""
    raw, counts = (text or "").encode(), collections.Counter()
    for i in range(len(raw) - 2):
        counts[(int.from_bytes(raw[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    words = raw.split()
    counts[knn_quality.BUCKETS] = 1000 * sum(a == b for a, b in zip(words, words[1:], strict=False)) // max(len(words), 1)
    return counts


def test_votes_match_brute_force(spark, sf_dir):
    """Every document of a table, voted on by all cosines with the same sample."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    space = knn_quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [r for r in labels.filter("quality in (0, 1)").distinct().collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    sample = sorted({(r.doc_id, int(r.quality)) for r in known if r.doc_id in texts})
    often = collections.Counter(t for text in texts.values() for t, n in plain_counts(text).items() if n)
    weights = [math.log((1 + len(texts)) / (1 + often[t])) + 1 for t in range(knn_quality.TERMS)]
    weights[knn_quality.BUCKETS] *= knn_quality.REPEAT_WEIGHT

    def place(text):
        row = np.zeros(knn_quality.TERMS)
        for t, n in plain_counts(text).items():
            row[t] = math.log(1 + n) * weights[t]
        row = row / (np.linalg.norm(row) or 1) @ space.axes
        return row / np.linalg.norm(row) if np.linalg.norm(row) > 1e-9 else row * 0

    assert len(sample) == len(space.labels) <= 2 * knn_quality.PER_CLASS
    vectors = [(place(texts[i]), q) for i, q in sample]
    for r in knn_quality.score(docs, labels).collect():
        own = place(texts[r.doc_id])
        near = [float(np.dot(own, v)) for v, _ in vectors]
        limit = sorted(near)[-min(knn_quality.NEIGHBOURS, len(near))]
        votes = [(max(s, 0) ** knn_quality.SHARPNESS, q) for s, (_, q) in zip(near, vectors, strict=True) if s >= limit - 1e-12]
        total = sum(v for v, _ in votes)
        expected = sum(v * q for v, q in votes) / total if total else sum(q for _, q in sample) / len(sample)
        assert r.score == pytest.approx(expected, abs=1e-9)
        assert (r.predicted, r.held_out) == (int(r.score >= 0.3), zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_trees_are_summed_level_by_level_not_node_by_node(monkeypatch):
    monkeypatch.setattr(edit_counts.CountTree, "_sum", None)
    for n in (0, 1, 2, 3, 7, 8, 9):
        tree = object.__new__(edit_counts.CountTree)
        tree._build([(i + 1, i % 3) for i in range(n)])
        assert len(tree.chars) == len(tree.tokens) == 2 * tree.size and tree.chars[0] == tree.tokens[0] == 0
        assert tree.chars[tree.size :][:n] == list(range(1, n + 1))
        for sums in (tree.chars, tree.tokens):
            assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, tree.size))


def test_a_link_whose_ends_have_closer_strangers_is_not_lost(spark):
    """A text whose fingerprint lies between those of two near copies is closer to both, in every tile, and a copy of neither."""
    rng = random.Random(35)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    parts = [base[i : i + 8] for i in range(0, 120, 8)]
    rng.shuffle(parts)
    phrase = base[:6]
    texts = [" ".join(t) for t in (base, sum(parts, []) + phrase * rng.randrange(3, 10), base + phrase * 12)]
    one, two, three = (simhash.fingerprint(t, near_copies.PRINT_WORDS) for t in texts)
    closer = (one ^ two).bit_count(), (two ^ three).bit_count()
    assert sum(closer) == (one ^ three).bit_count() <= near_copies.DISTANCE and min(closer) > 0
    assert brute_links(texts) == {(0, 2)}
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        table = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
        assert sorted(r.doc_id for r in near_copies.keep_first(table).collect()) == [0, 1]


def test_candidates_between_groups_leave_no_task_as_pairs(spark, monkeypatch):
    """Hundreds of texts whose fingerprints are near and whose shingles are not stay apart, without a row for each two of them."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = []
    for i in range(400):
        copy = list(base)
        for place in rng.sample(range(400), 14):
            copy[place] = f"changed{i}x{place}"
        texts.append(" ".join(copy))
    texts += [f"{texts[0]} end", f"{texts[399]} end"]
    rows = []
    written = near_copies.stage

    def counted(df, name):
        done = written(df, name)
        rows.append((name, done.count()))
        return done

    monkeypatch.setattr(near_copies, "stage", counted)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in near_copies.keep_first(table).collect())
    links = brute_links(texts)
    group = list(range(len(texts)))
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert kept == sorted(set(group)) and len(kept) > 350
    between = dict(rows)["left-out"]
    assert 0 < between <= len(texts) * len(near_copies.chains(len(texts)))


@pytest.mark.parametrize("common", [2, 64])
def test_near_copies_that_fingerprints_tell_apart_are_found(spark, monkeypatch, common):
    """A word that is said over and over turns the fingerprint and adds five shingles; also where all shingles are frequent."""
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, line = [], words(30)
    for _ in range(12):
        base = words(rng.randrange(60, 200)) + line
        texts += [" ".join(base), " ".join(base + ["spam"] * 400)]
    crowd = words(120)
    texts += [" ".join(crowd + [f"loud{i}"] * 500) for i in range(12)]
    texts += [" ".join(words(40) + line) for _ in range(12)]
    links = brute_links(texts)
    prints = [simhash.fingerprint(t, near_copies.PRINT_WORDS) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > near_copies.DISTANCE for a, b in links) > 12
    group = list(range(len(texts)))
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_first(table).collect()) == sorted(set(group))


def test_a_round_of_stars_lists_its_edges_once(spark, monkeypatch):
    plans = []
    written = stars.stage

    def planned(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(stars, "stage", planned)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}
    assert len(plans) > 2 and all(p.count("FileScan parquet") <= 2 for p in plans)


def test_a_sample_is_weighted_in_portions(spark, monkeypatch):
    """The driver holds no doubles of its whole sample of labelled documents, and the space is the same."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("aa", "bb", "cc", "dd")) + str(i % 9) for _ in range(20))) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    sizes = []
    weighted = knn_quality.Space.weighted
    monkeypatch.setattr(knn_quality.Space, "weighted", lambda self, counts: sizes.append(len(counts)) or weighted(self, counts))
    space = knn_quality.fit(docs, labels)
    assert len(space.vectors) == len(space.labels) > 2 * max(sizes) and max(sizes) <= 256
    monkeypatch.setattr(knn_quality, "PORTION", 5000)
    whole = knn_quality.fit(docs, labels)
    assert np.array_equal(space.axes, whole.axes) and np.allclose(space.vectors, whole.vectors, rtol=0, atol=1e-12)
