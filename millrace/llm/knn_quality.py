"""Quality of documents by the labels of their nearest neighbours in a latent-semantic space.

Terms are byte trigrams in a fixed number of hashed buckets, and one term for words that repeat the word before them
(per thousand words, so that it does not follow the length). They are weighted by log(1 + count) and by an inverse
document frequency counted over all documents. The space is the truncated singular value decomposition of a bounded sample
of labelled documents; its axes and the sample's vectors (together about ``TERMS * RANK + 2 * PER_CLASS * RANK``
floats, whatever the input) are broadcast, and every document is compared with every vector of the sample by
blocked matrix products. The nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PORTION, arrow_map, fresh, portions, text_rows

BUCKETS, RANK, NEIGHBOURS, SHARPNESS = 4096, 64, 31, 4
TERMS = BUCKETS + 1  # the last term stands for repeated words
REPEAT_WEIGHT = 4  # it is one term against hundreds of trigrams
PER_CLASS = 1024  # labelled documents kept of each class
FOLDS, THRESHOLD, SEED = 5, 0.3, 20
PART = 1 << 20  # bytes of a text hashed at once


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def term_counts(text: str) -> np.ndarray:
    encoded = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(encoded, dtype=np.uint8)
    counts = np.zeros(TERMS, dtype=np.int64)
    for start in range(0, max(len(raw) - 2, 0), PART):
        part = raw[start : start + PART + 2].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=TERMS)
    words = encoded.split()
    counts[BUCKETS] = 1000 * sum(map(eq, words, words[1:])) // max(len(words), 1)
    return counts


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents: ``TERMS`` numbers in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(TERMS + 1, dtype=np.int64), 0
        for batch in portions(batches):
            for value in text_rows(batch, "text"):
                found[:TERMS] += term_counts(value) > 0
            rows += batch.num_rows
        found[TERMS] = rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS + 1)), pa.array(found)], names=["term", "docs"]
        )

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "term long, docs long")
    totals = np.zeros(TERMS + 1, dtype=np.int64)
    for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).collect():  # TERMS + 1 rows
        totals[row.term] = row.docs
    return totals[:TERMS], int(totals[TERMS])


@dataclass
class Space:
    """Everything that scoring needs; its size depends on the parameters alone."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.weights
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(norms > 0, norms, 1)

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of the space; a document without a term of the space is the zero vector."""
        rows = self.weighted(counts) @ self.axes
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(norms > 1e-9, norms, np.inf)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the neighbours; all that are as near as the last one vote too."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        near = self.place(counts) @ self.vectors.T
        last = min(NEIGHBOURS, near.shape[1])
        limit = np.partition(near, near.shape[1] - last, axis=1)[:, near.shape[1] - last]
        power = np.where(near >= limit[:, None], np.maximum(near, 0), 0) ** SHARPNESS
        total = power.sum(axis=1)
        share = power @ self.labels / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(share, 0, 1), prior)


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    per_class: int = PER_CLASS,
) -> Space:
    """Learn from at most ``per_class`` labelled documents of each class, those with the smallest hash of the id.

    Rows held out, with a null id, or with another label than 0 and 1 teach nothing. A document that has both labels
    counts for both.
    """
    frequency, rows = document_frequencies(docs, text)
    known = labels.select(F.col(id).alias("known_id"), F.col(label).cast("int").alias("known_label"))
    known = known.filter(F.col("known_id").isNotNull() & ~held_out(F.col("known_id"))).distinct()
    chosen = [
        known.filter(F.col("known_label") == k).orderBy(F.xxhash64("known_id"), "known_id").limit(per_class)
        for k in (0, 1)
    ]
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most 2 * per_class ids
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("id") == F.col("known_id"))
    sample = sample.groupBy("id", "known_label").agg(F.min("text").alias("text"))  # repeated rows teach once

    def handle(batch: pa.RecordBatch):
        raw = [term_counts(t).astype(np.int32).tobytes() for t in text_rows(batch, "text")]
        yield {"id": batch.column("id"), "label": batch.column("label"), "counts": raw}

    taught = arrow_map(
        sample.select(F.col("id").cast("long"), F.col("known_label").alias("label"), "text"),
        handle, "id long, label int, counts binary",
    )
    found = sorted(taught.collect(), key=lambda r: (r.id, r.label))  # at most 2 * per_class rows of fixed size
    weights = np.log((1 + rows) / (1 + frequency)) + 1
    weights[BUCKETS] *= REPEAT_WEIGHT
    space = Space(weights, np.zeros((TERMS, 0)), np.zeros((0, 0)), np.array([r.label for r in found], dtype=float))
    if found:
        counts = np.stack([np.frombuffer(r.counts, dtype=np.int32) for r in found])
        found.clear()
        # the driver holds the sample as counts and as single floats, and doubles of a portion of it only
        parts = [slice(start, start + PORTION) for start in range(0, len(counts), PORTION)]
        rows = np.empty(counts.shape, dtype=np.float32)
        for part in parts:
            rows[part] = space.weighted(counts[part])
        space.axes = _axes(rows).astype(np.float64)
        space.vectors = np.concatenate([space.place(counts[part]) for part in parts])
    return space


def _axes(rows: np.ndarray) -> np.ndarray:
    """The first right singular vectors by subspace iteration from a seeded start."""
    rank = min(RANK, *rows.shape)
    start = np.random.default_rng(SEED).standard_normal((rows.shape[1], min(rank + 16, rows.shape[1])))
    basis = start.astype(rows.dtype)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, within = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ within.T)[:, :rank]


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = THRESHOLD, keep_text: bool = True,
) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row; the text alone decides a score.

    Null texts are empty ones. A text without any term gets the share of label 1 in the sample, or 0.5 when nothing
    is labelled. Repeated rows get equal scores.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id, text, label))
    kept = [c for c in docs.columns if keep_text or c != text]
    names = fresh(docs, "held_out", "score", "predicted")
    place = docs.columns.index(text)
    source = docs.withColumn(names[0], held_out(F.col(f"`{id}`")))
    places = [i for i, c in enumerate(docs.columns) if c in kept] + [len(docs.columns)]
    schema = ", ".join(
        [f"`{source.columns[i]}` {source.schema.fields[i].dataType.simpleString()}" for i in places]
        + [f"`{names[1]}` double", f"`{names[2]}` int"]
    )
    outs = [source.columns[i] for i in places] + names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            if not batch.num_rows:
                continue
            counts = np.stack([term_counts(t or "") for t in batch.column(place).to_pylist()])
            scores = space.value.vote(counts)
            arrays = [batch.column(i) for i in places]
            arrays += [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=outs)

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns unchanged, whatever their names.

    A score equal to the threshold stays. Null and empty texts are judged by the score that ``score`` gives them, so all rows
    stay when nothing is labelled. Repeated rows stay or go together, rows without an id are judged like others, texts are
    read whole, and an empty table stays empty.
    """
    (predicted,) = fresh(docs, "predicted")
    scored = score(docs, labels, id, text)
    return scored.filter(F.col(f"`{predicted}`") == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
