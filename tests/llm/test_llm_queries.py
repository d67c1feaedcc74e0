"""Registered queries against their SQL, and the pipeline against its own rules."""

import hashlib

import compare
import pytest

pytest.importorskip("millrace.llm")
import corpus_pipeline  # noqa: E402
from millrace.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    settings = dict(spark.conf.getAll)
    df = QUERIES[name](spark, sf_dir)
    df.count()
    assert dict(spark.conf.getAll) == settings  # later queries of the session run as before
    if name in ORACLES:
        assert compare.difference(df, duck, ORACLES[name]) is None
    elif name == "op13_hash_forest":  # recall is measured in test_phrases_trie_forest
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        assert df.count() == 20 * vectors.filter("vec_id % 20 = 0").count()
    else:
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir, duck):
    from millrace.llm import near_copies
    from millrace.llm.queries import mixed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [docs]
    for name, step in corpus_pipeline.STAGES:
        stages.append(corpus_pipeline.stage(step(spark, stages[-1], sf_dir), name))
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in stages]
    scored = QUERIES["op9_quality_votes"](spark, sf_dir)
    assert ids[1] == sorted(r.doc_id for r in scored.filter("predicted = 1").collect())
    found = near_copies.groups(stages[1]).groupBy("group").agg({"first": "min"}).collect()
    assert ids[2] == sorted(r[1] for r in found) and len(ids[2]) < len(ids[1])
    assert ids[3] == sorted(r.doc_id for r in mixed(stages[2]).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in stages[4].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert ids[4] == ids[3]
