"""All registered queries and the pipeline on tables without rows, and on tables of odd rows with clashing columns."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")
import corpus_pipeline  # noqa: E402
from millrace.llm import knn_quality, piece_bpe, simhash  # noqa: E402
from millrace.llm.queries import QUERIES, piece_model  # noqa: E402

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, label int, embedding array<float>",
    "conversations": "conv_id long, turn long, role string, text string",
}
#: Names that operators use themselves, for helpers or for results.
CLASHES = (
    "id", "key", "fp", "fingerprint", "component_id", "kept_id", "score", "predicted", "held_out", "epoch", "n_tokens", "full",
    "cut_hash", "domain", "ids", "ids_sha256", "decoded_sha256", "row", "members", "place", "edits", "_payload", "known_id",
)
LONG = "many words of a text that goes on and on \n" * 20_000
ROWS = {
    "documents": [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "ONE two three four five six seven", "en", "a", 33),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, LONG, "en", "b", len(LONG)),
        (6, LONG.replace(" ", ""), "en", "b", 1),
        (None, "no id but some words", "fr", None, 20),
        (8, " \t\n ", None, "c", 4),
    ],
    "labels": [(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, None), (4, None, 1), (5, 1, 0), (6, 0, 0), (None, 1, 0), (99, 1, 0)],
    "pages": [
        (1, "http://a/", "x" * 1000), (2, "http://b/ä b", "x" * 1000), (2, None, "x" * 1000), (3, "", None), (4, "u", ""),
        (None, None, "x" * 1000), (5, "u", LONG), (6, "u", "x" * 999), (7, "u", "x" * 999),
    ],
    "embeddings": [
        (0, 1, [1.0, 0.0]), (50, 1, [1.0, 0.01]), (50, 1, [1.0, 0.01]), (100, None, [1.0, 0.0]), (3, 1, None), (4, 1, [0.0, 0.0]),
        (5, 1, [float("nan"), 1.0]), (6, 1, [None, 1.0]), (7, 1, []), (8, 2, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (9, 1, [1.0]),
    ],
    "conversations": [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"), (2, 0, "user", None),
        (2, 1, "assistant", LONG), (3, 0, None, ""), (None, 0, "user", "x"), (4, None, "assistant", "x"), (5, 7, "assistant", ""),
    ],
}
ONE_EACH = {
    "op1_cross_entropy": "documents", "op2_warc_salvage": "pages", "op4_piece_encoding": "documents",
    "op5_edit_counts": "documents", "op7_simhash_groups": "documents", "op8_vector_groups": "embeddings",
    "op9_quality_votes": "documents",
}


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    for name, schema in SCHEMAS.items():
        rows = spark.createDataFrame(ROWS[name] if request.param == "odd" else [], schema)
        clashes = {c: F.lit(c) for c in CLASHES if c not in rows.columns}
        rows.withColumns(clashes).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path, request.param


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    path, kind = folder
    found = QUERIES[name](spark, path).collect()
    if kind == "empty":
        assert found == []
    elif name in ONE_EACH:
        assert len(found) == len(ROWS[ONE_EACH[name]])
    else:
        assert found


def test_stages(spark, folder):
    path, kind = folder
    docs = corpus_pipeline.table(spark, path, "documents")
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, path), name)
        if name != "encoding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert kind == "empty" or before.count() > 0
    assert (docs.count() == 0) == (kind == "empty")


def test_results_on_odd_rows(spark, folder):
    path, kind = folder
    if kind == "empty":
        pytest.skip("there are no rows")
    kinds = {}
    for r in QUERIES["op2_warc_salvage"](spark, path).collect():
        kinds.setdefault((r.page_id, r.payload_bytes), []).append((r.record_type, r.refers_to))
    assert kinds[1, 1000] == [("revisit", 2)] and kinds[2, 1000] == [("response", None)] * 2
    assert kinds[None, 1000] == [("revisit", 2)] and kinds[6, 999] == kinds[7, 999] == [("response", None)]
    groups = {r.doc_id: r.component_id for r in QUERIES["op7_simhash_groups"](spark, path).collect()}
    assert groups[1] == groups[2] == 1 and groups[3] == groups[4] == groups[8] == 3
    links = sorted(
        (-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id)
        for r in QUERIES["op8_vector_groups"](spark, path).filter("vec_id in (0, 50, 100, 8, 5) or vec_id is null").collect()
    )
    assert links == [(-1, 3, 0), (0, 3, 0), (5, 0, 5), (8, 0, 8), (50, 3, 0), (50, 3, 0), (100, 0, 100)]
    scores = QUERIES["op9_quality_votes"](spark, path).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores)
    best = {(r.query_id, r.vec_id, r.score) for r in QUERIES["op10_exact_top_k"](spark, path).filter("rank = 1").collect()}
    assert (0, 8, 65536) in best


def test_stated_cases_of_single_functions(spark):
    schema = "doc_id LONG, text STRING, predicted STRING, Score INT, n_tokens STRING"
    rows = [(1, None, "a", 1, "x"), (2, "", "b", 2, "y"), (None, "some words here", "c", 3, "z"), (3, "some words here", "c", 3, "z")]
    docs = spark.createDataFrame([*rows, rows[3]], schema)
    labels = spark.createDataFrame([], "doc_id LONG, quality INT")
    kept = knn_quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert knn_quality.keep_good(docs.limit(0), labels).count() == 0
    tokens = piece_bpe.token_digests(docs, piece_model())
    assert tokens.columns == ["doc_id", "predicted", "Score", "n_tokens", "n_tokens_", "ids_sha256", "decoded_sha256"]
    found = [(r.doc_id, r.n_tokens_) for r in tokens.collect()]
    assert sorted(found, key=repr)[:2] == [(1, 1), (2, 1)] and len(found) == 5 and found[2][1] == found[3][1] == found[4][1]
    for fingerprints in ([], [(0,), (-1,)]):
        assert simhash.links(spark.createDataFrame(fingerprints, "fp LONG")).count() == 0
