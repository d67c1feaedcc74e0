"""Operators on vectors and archives against brute force and damaged bytes."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import cover_tree, topk, warc

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1, 7), (1, [2.0, 0.0], 1, 7), (1, [2.0, 0.0], 1, 7), (2, [1.0, 0.1], 1, 7), (3, [0.0, 0.0], 1, 7),
        (4, None, 1, 7), (5, [NAN, 1.0], 1, 7), (6, [1.0, None], 1, 7), (7, [INF, 1.0], 1, 7), (8, [1.0, 0.0], None, 7),
        (9, [1.0, 0.0], 2, 7), (None, [1.0, 0.0], 1, 7), (10, [1e30, 1e30], 3, 7), (50, [1e30, 1e30], 3, 7), (51, [], 3, 7),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")


def test_trees_find_every_pair():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    near = centres[rng.integers(20, size=300)] + rng.standard_normal((300, 16)) * rng.choice([0.01, 0.1, 0.2], 300)[:, None]
    points = np.concatenate([near, rng.standard_normal((100, 16)), np.repeat(centres[:1], 80, 0)])
    points = points[rng.permutation(len(points))]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    found = [tuple(sorted(p)) for a, b in cover_tree.traverse(points, points, 0.98, True) for p in zip(a, b, strict=True)]
    expected = set(zip(*np.nonzero(np.triu(points @ points.T >= 0.98, 1)), strict=True))
    assert len(found) == len(set(found)) and set(found) == expected
    one, two = points[:200], points[200:]
    found = [p for a, b in cover_tree.traverse(one, two, 0.98, False) for p in zip(a, b, strict=True)]
    assert len(found) == len(set(found)) and set(found) == set(zip(*np.nonzero(one @ two.T >= 0.98), strict=True))


def test_tree_levels_cover():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((200, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    levels = cover_tree.build(points)
    assert len(levels[0].centre) == 1 and sorted(levels[-1].centre) == list(range(200))
    for upper, lower in zip(levels, levels[1:], strict=False):
        assert set(upper.centre) <= set(lower.centre)
        for i, c in enumerate(upper.centre):
            children = lower.centre[upper.first[i] : upper.first[i + 1]]
            assert (np.linalg.norm(points[children] - points[c], axis=1) <= upper.reach[i] + 1e-9).all()


def test_vector_groups_with_odd_rows(odd_vectors, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 2)
    rows = cover_tree.near_duplicates(odd_vectors).collect()
    assert len(rows) == odd_vectors.count()
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    assert found[0] == {(4, 0, True)} and found[None] == {(4, 0, False)}
    assert found[1] == {(4, 0, False)} and found[2] == {(4, 0, False)}
    assert all(found[i] == {(0, i, True)} for i in (3, 4, 5, 6, 7, 8, 9, 51))
    assert found[10] == {(1, 10, True)} and found[50] == {(1, 10, False)}
    assert cover_tree.near_duplicates(odd_vectors.limit(0)).count() == 0


def clustered(rng, count, width=16, clusters=12):
    """Crowds of near vectors far from each other, with hundreds of repeats in one, and strangers."""
    centres = rng.standard_normal((clusters, width))
    near = centres[rng.integers(clusters, size=count)] + rng.standard_normal((count, width)) * rng.choice([0.02, 0.08], count)[:, None]
    return np.concatenate([near, np.repeat(centres[:1], count // 4, 0), rng.standard_normal((count // 10, width))])


@pytest.mark.parametrize("block, centres", [(40, 4), (200, 8), (4096, 32)])
def test_groups_of_clustered_vectors_equal_brute_force(spark, monkeypatch, block, centres):
    """Links and components through the whole query, and fewer tiles than pairs of blocks."""
    for name, value in (("BLOCK", block), ("CENTRES", centres), ("SAMPLE", 64)):
        monkeypatch.setattr(cover_tree, name, value)
    rng = np.random.default_rng(block)
    points = clustered(rng, 1200)
    labels = rng.integers(2, size=len(points))
    given = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(points * rng.choice([0.1, 3.0], len(points))[:, None], labels, strict=True))]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").repartition(5)
    seen = []
    tiles = cover_tree.tiles_of
    monkeypatch.setattr(cover_tree, "tiles_of", lambda blocks, pairs: seen.append((blocks.count(), pairs.count())) or tiles(blocks, pairs))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(table).collect()}
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = (units @ units.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    reached = np.arange(len(points))
    while True:
        least = np.minimum(reached, np.where(near, reached[None, :], len(points)).min(axis=1))
        if (least == reached).all():
            break
        reached = least
    assert found == {i: (int(near[i].sum()), int(reached[i]), bool(reached[i] == i)) for i in range(len(points))}
    ((blocks, pairs),) = seen
    if block == 40:
        assert blocks > 30 and pairs < blocks * (blocks / 2 + 1) / 4  # two labels alone would give half of all pairs


def test_far_vectors_cost_no_more_than_their_product():
    rng = np.random.default_rng(8)
    points = rng.standard_normal((600, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    looked = []
    original = cover_tree._dots
    try:
        cover_tree._dots = lambda *args: looked.append(len(args[2])) or original(*args)
        assert not list(cover_tree.traverse(points, points, 0.98, True))
    finally:
        cover_tree._dots = original
    assert sum(looked) < 600 * 600 / 8


def test_top_k_with_odd_rows(odd_vectors):
    rows = topk.top_k(odd_vectors, F.col("vec_id") % 50 == 0, k=3).collect()
    found = {q: [(r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    assert [v for _, v, _ in found[0]] == [10, 50, 1] and len(found[50]) == 3
    assert found[50] == [(1, 0, 2**63 - 1), (2, 1, 2**63 - 1), (3, 1, 2**63 - 1)]  # scores kept at the end of a long
    assert topk.top_k(odd_vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_huge_components(spark):
    """Components beyond what a double times the scale can hold become whole numbers of any size."""
    rows = [(0, [1e308, -1e308]), (1, [1e308, 1e308]), (2, [1.0, 0.5]), (3, [-1e306, 2.0]), (4, [0.25, 3.0]), (5, [2.0**40, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_k(table, F.col("vec_id") >= 0).collect()}
    whole = [[math.floor(256 * Fraction(x)) for x in v] for _, v in rows]
    for q in range(6):
        for c in range(6):
            if q != c:
                exact = sum(a * b for a, b in zip(whole[q], whole[c], strict=True))
                assert found[q, c] == min(max(exact, -(2**63)), 2**63 - 1)


def test_top_k_over_many_tiles(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("QUERIES", 7), ("FAN_IN", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, size=(500, 6)) / 4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = topk.top_k(table, F.col("vec_id") % 20 == 0).collect()
    whole = np.floor(256 * vectors).astype(int)
    for q in range(0, 500, 20):
        scores = whole @ whole[q]
        expected = sorted((i for i in range(500) if i != q), key=lambda i: (-scores[i], i))[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert got == [(k, i, scores[i]) for k, i in enumerate(expected, 1)]


def test_top_k_ships_query_blocks_once_a_column_and_never_through_the_driver(spark, monkeypatch):
    for name, value in (("SHARD", 8), ("QUERIES", 16), ("FAN_IN", 4), ("SPREAD", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, size=(300, 4)) / 4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    top = topk.top_k(table, F.col("vec_id") % 10 == 0)
    rows = top.collect()
    assert "SortMergeJoin" in top._jdf.queryExecution().executedPlan().toString()  # query blocks are not broadcast
    whole = np.floor(256 * vectors).astype(int)
    for q in range(0, 300, 10):
        scores = whole @ whole[q]
        expected = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q) == [(k, i, scores[i]) for k, i in enumerate(expected, 1)]


def packed(data):
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def records(count, seed=0):
    rng = random.Random(seed)
    pages = [f"<html>{rng.random()}</html>".encode() * 40 for _ in range(count)]
    return [warc.page_record(i, f"http://x/{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(pages)]


def read(data):
    found = list(warc.salvage(warc.Span(pa.BufferReader(data), 0, len(data))))
    assert sum(length for _, length, _, _ in found) == len(data)  # records and gaps are all of the archive
    names = [r.headers["warc-record-id"] for _, _, r, _ in found if r]
    return [int(n.strip("<>").rpartition(":")[2]) for n in names], [(o, n, why) for o, n, r, why in found if r is None]


@pytest.mark.parametrize("pack", [packed, bytes])
def test_salvage_goes_on_after_damage(pack):
    parts = [pack(r) for r in records(12)]
    whole = b"".join(parts)
    assert read(whole) == (list(range(12)), [])
    starts = np.cumsum([0, *map(len, parts)])
    flipped = bytearray(whole)
    flipped[starts[3] + len(parts[3]) // 2] ^= 0xFF
    ids, gaps = read(bytes(flipped))
    assert ids == [0, 1, 2, *range(4, 12)] and [g[:2] for g in gaps] == [(starts[3], len(parts[3]))]
    ids, gaps = read(b"junk" + whole[: starts[5]] + random.Random(1).randbytes(500) + whole[starts[5] : -10])
    assert ids == list(range(11)) and len(gaps) == 3 and gaps[0][:2] == (0, 4) and gaps[1][1] == 500
    assert read(whole[: starts[1] - 3]) == ([], [(0, starts[1] - 3, gaps[2][2])])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("pack", [packed, bytes])
@pytest.mark.parametrize("seed", range(20))
def test_salvage_after_flipped_bits(pack, seed):
    """Three bits hurt three records at most; what is found is whole, in order, and has its mandatory fields."""
    parts = [pack(r) for r in records(12, seed)]
    whole, rng = b"".join(parts), random.Random(seed)
    payloads = [r.payload for _, _, r, _ in warc.salvage(warc.Span(pa.BufferReader(whole), 0, len(whole)))]
    for _ in range(60):
        broken = bytearray(whole)
        for _ in range(3):
            broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        found = list(warc.salvage(warc.Span(pa.BufferReader(bytes(broken)), 0, len(whole))))
        assert sum(length for _, length, _, _ in found) == len(whole)
        sound = [r for _, _, r, _ in found if r]
        assert len(sound) >= 9 and all(r.headers[n] for r in sound for n in ("warc-record-id", "warc-type", "warc-date"))
        places = [payloads.index(r.payload) for r in sound if r.payload is not None and r.checked]
        assert len(places) >= 9 and places == sorted(set(places))


@pytest.mark.parametrize("name", ["WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length"])
def test_records_without_mandatory_fields_are_gaps(name):
    parts = records(4)
    parts[1] = parts[1].replace(name.encode(), b"X" + name[1:].encode())
    ids, gaps = read(b"".join(parts))
    assert ids == [0, 2, 3] and [g[:2] for g in gaps] == [(len(parts[0]), len(parts[1]))]
    parts = records(4)
    twice = name.encode() + b": 1\r\n"
    parts[2] = parts[2].replace(b"WARC/1.1\r\n", b"WARC/1.1\r\n" + twice)
    ids, gaps = read(b"".join(parts))
    assert ids == [0, 1, 3] and gaps[0][2] == "header named twice"


def test_records_without_a_digest_are_marked(spark, tmp_path):
    parts = records(3)
    parts[1] = re.sub(rb"WARC-(Block|Payload)-Digest: ", rb"X-\1: ", parts[1])
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    table = spark.createDataFrame([(f"file:{tmp_path}/a.warc", None, None)], "path string, start long, end long")
    rows = sorted(warc.read_archives(table).collect(), key=lambda r: r.offset)
    assert [r.checked for r in rows] == [True, False, True] and all(r.payload for r in rows)
    assert all(r.payload is None for r in warc.read_archives(table, with_payload=False).collect())


def test_archives_round_trip_with_odd_pages(spark):
    big = "é" * 700
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (2, None, big), (None, "u", big), (3, "u", None), (4, "u", ""),
            (5, "u", "small"), (6, "u", "small"), (7, "u", "WARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    parts = warc.write_archives(pages)
    found = warc.read_archives(parts).collect()
    assert len(found) == len(rows) and all(r.reason is None for r in found)
    shown = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert [s[1] for s in shown if s[0] == "<urn:page:2>"] == ["response"] * 2
    assert [s[1:] for s in shown if s[0] in ("<urn:page:1>", "<urn:page:>")] == [("revisit", "<urn:page:2>", 1400)] * 2
    by_id = {r.record_id: r for r in found}
    assert by_id["<urn:page:7>"].payload.decode() == rows[8][2] and by_id["<urn:page:3>"].payload_bytes == 0
    assert by_id["<urn:page:1>"].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    path = parts.first().path.removeprefix("file:")
    with open(path, "r+b") as file:  # the end of an archive gets lost
        file.truncate(os.path.getsize(path) - 20)
    assert warc.read_archives(parts).filter("reason is not null").count() >= 1


def test_salvage_of_archives_by_other_writers():
    """Digests in base32, in an unknown encoding or of another kind; folded lines; captured headers of any form."""
    payload = b"<html>page</html>" * 50

    def record(number, encode, http=b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"):
        block = http + payload
        lines = [
            b"WARC/1.0", b"WARC-Type: response", b"WARC-Date: 2020-01-01T00:00:00Z", b"WARC-Record-ID:\r\n  <urn:page:%d>" % number,
            b"Content-Type: application/http; msgtype=response", b"WARC-Block-Digest: " + encode(block),
            b"WARC-Payload-Digest: " + encode(payload), b"Content-Length: %d" % len(block), b"", b"",
        ]
        return b"\r\n".join(lines) + block + b"\r\n\r\n"

    base32 = lambda b: b"sha1:" + base64.b32encode(hashlib.sha1(b).digest())
    other = [lambda b: b"sha1:" + base64.b64encode(hashlib.sha1(b).digest()), lambda b: b"md5:00", lambda b: b"sha1:"]
    odd = [b"HTTP/1.1 200 OK\r\nno colon\r\n folded\r\nContent-Length: \xc2\xb2\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"]
    whole = [record(i, e) for i, e in enumerate([base32, *other])] + [record(4 + i, base32, h) for i, h in enumerate(odd)]
    assert read(b"".join(whole)) == (list(range(6)), [])
    span = warc.Span(pa.BufferReader(b"".join(whole)), 0, sum(map(len, whole)))
    shown = [warc._shown(r) for _, _, r, _ in warc.salvage(span)]
    assert shown[0][4] == hashlib.sha1(payload).hexdigest() and all((s[5], s[7]) == (len(payload), payload) for s in shown)
    wrong = record(1, lambda b: base32(b + b"x"))
    assert read(whole[0] + wrong + whole[2])[0] == [0, 2]


@pytest.mark.parametrize("pack", [packed, bytes])
def test_salvage_reads_long_headers_and_blocks(pack, monkeypatch):
    page = b"<html>text</html>" * 300_000
    digest = hashlib.sha1(page).hexdigest()
    url = "http://x/" + "漢" * 30_000
    parts = [pack(warc.page_record(i, u, page, digest, None)) for i, u in enumerate(["u", url, "u"])]
    whole = b"".join(parts)
    assert read(whole) == ([0, 1, 2], [])
    monkeypatch.setattr(warc, "BLOCK", 1 << 20)  # a block that is too long to be held is checked all the same
    assert read(whole) == ([0, 1, 2], [])
    found = [r for _, _, r, _ in warc.salvage(warc.Span(pa.BufferReader(whole), 0, len(whole)))]
    assert all(r.payload is None and warc._shown(r)[4:6] == (digest, len(page)) for r in found)
    broken = bytearray(whole)
    broken[len(parts[0]) + len(parts[1]) - 200] ^= 1
    ids, gaps = read(bytes(broken))
    assert ids == [0, 2] and [g[:2] for g in gaps] == [(len(parts[0]), len(parts[1]))]


def test_query_fails_on_a_gap_in_its_own_archives(spark, tmp_path, monkeypatch):
    from millrace.llm.queries import QUERIES

    pages = spark.createDataFrame([(1, "http://x/" + "漢" * 30_000, "page")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.page_id for r in QUERIES["op2_warc_salvage"](spark, str(tmp_path)).collect()] == [1]
    write = warc.write_archives

    def damaged(pages):
        parts = write(pages)
        for row in parts.collect():
            with open(row.path.removeprefix("file:"), "r+b") as file:
                file.seek((row.start + row.end) // 2)
                file.write(b"damage")
        return parts

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="a page is missing"):
        QUERIES["op2_warc_salvage"](spark, str(tmp_path)).count()


@pytest.fixture(scope="module")
def mixed_widths(spark):
    """Two widths that take part, and longer vectors that may not."""
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (4, [1.0, 0.0], 2),
        (5, [1.0] * 4 + [None], 1), (6, [NAN] * 6, 1), (7, [1.0] * 7, None), (None, [1.0] * 8, 1),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vector_groups_of_mixed_widths(mixed_widths):
    found = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_duplicates(mixed_widths).collect()}
    linked = {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2)}
    assert found == linked | {i: (0, i) for i in (4, 5, 6, 7)} | {None: (0, None)}


def test_top_k_of_mixed_widths(mixed_widths, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 2)
    rows = topk.top_k(mixed_widths, F.col("vec_id") % 2 == 0, scale=100.0).collect()
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)
    assert found == [(0, 1, 1, 10_000), (0, 2, 4, 10_000), (2, 1, 3, 10_000), (4, 1, 0, 10_000), (4, 2, 1, 10_000)]
