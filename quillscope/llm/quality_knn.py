"""Operator 6: quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its hashed byte pairs, and a few bins of its style (share of
distinct words, of words that repeat the one before, of capitals and symbols; length).  Term weights are log counts times
inverse document frequency; latent-semantic vectors are their projections on
the leading singular vectors of the labelled sample.  The labelled vectors are
broadcast (at most ``docs_per_label`` * labels in expectation, ``RANK`` floats
each) and every document is compared with all of them by exact cosine
products, a block of documents at a time.  The ``NEIGHBOURS`` most similar
vote with their labels, weighted by similarity.

The model is fitted on a bounded sample of labelled rows; every row is scored.

Cases: a null text is an empty one, whose style bins still have neighbours; no
labelled row at all gives 0.5; repeated labels of one id count as their
greatest; rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.llm.pieces import text_slices
from quillscope.llm.sampling import held_out_bucket, per_class_sample

DOCS_PER_LABEL = 2048
BUCKETS = 1024
STYLES, BINS = 5, 16
STYLE_WEIGHT = 1.5
TERMS = BUCKETS + STYLES * BINS
RANK = 64
NEIGHBOURS = 25
BLOCK = 512
SLICE_BYTES = 1 << 21

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _style(bins: np.ndarray, column: int, share: np.ndarray) -> None:
    """Shares 0..1 as weights of the two nearest bins."""
    x = np.clip(share, 0, 1) * (BINS - 1)
    low = np.minimum(x.astype(int), BINS - 2)
    row = np.arange(len(x))
    bins[row, column * BINS + low] = 1 - (x - low)
    bins[row, column * BINS + low + 1] += x - low


def term_counts(texts: list[bytes]) -> np.ndarray:
    """texts x TERMS (float32): log counts of hashed byte pairs, then style bins."""
    n = len(texts)
    counts = np.zeros((n, TERMS), np.float32)
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), size)
    styles = np.zeros((n, STYLES * BINS), np.float32)
    if len(raw) > 1:
        pair = raw[:-1].astype(np.uint32) << 8 | raw[1:]
        bucket = (pair * np.uint32(2654435761)) >> np.uint32(32 - 10)
        inside = owner[:-1] == owner[1:]
        key = owner[:-1][inside] * BUCKETS + bucket[inside]
        counts[:, :BUCKETS] = np.log1p(np.bincount(key, minlength=n * BUCKETS).reshape(n, BUCKETS))
    some = np.maximum(size, 1)
    words = [t.split() for t in texts]
    _style(styles, 0, np.array([len(set(w)) / len(w) if w else 1.0 for w in words]))
    _style(styles, 4, np.sqrt([sum(map(eq, w, w[1:])) / len(w) if w else 0.0 for w in words]))
    _style(styles, 1, np.sqrt(np.bincount(owner, _UPPER[raw], n) / some))
    _style(styles, 2, np.sqrt(np.bincount(owner, _SYMBOL[raw], n) / some))
    _style(styles, 3, np.log1p(size) / np.log(1e6))
    counts[:, BUCKETS:] = styles
    return counts


def slices(texts: list[bytes]):
    """Runs of texts of about SLICE_BYTES, at most BLOCK of them."""
    a, held = 0, 0
    for b, t in enumerate(texts, 1):
        held += len(t)
        if held >= SLICE_BYTES or b - a == BLOCK or b == len(texts):
            yield a, b
            a, held = b, 0


class LatentNeighbours:
    """Labelled latent-semantic vectors and the projection to them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
        self.idf[BUCKETS:] = 1
        weighted = self._weighted(counts)
        _, vectors = np.linalg.eigh(weighted.T.astype(float) @ weighted)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK].astype(np.float32))
        self.known = self._unit(weighted @ self.basis)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        out = (counts * self.idf).astype(np.float32)
        out[:, :BUCKETS] = self._unit(out[:, :BUCKETS])
        out[:, BUCKETS:] = STYLE_WEIGHT * self._unit(out[:, BUCKETS:])
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a, b in slices(texts):
            like = self._unit(self._weighted(term_counts(texts[a:b])) @ self.basis) @ self.known.T
            nearest = np.argpartition(-like, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(like, nearest, axis=1), 1e-6)
            out[a:b] = np.clip((weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", docs_per_label: int = DOCS_PER_LABEL) -> LatentNeighbours:
    """A model from about ``docs_per_label`` labelled documents of each of the labels 0 and 1.

    Only the sample's ids are broadcast and only its term counts are collected.
    """
    marks = labels.select(F.col(doc_id).alias("labelled_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and labelled_id is not null")
    marks = marks.groupBy("labelled_id").agg(F.max("label").alias("label"))
    chosen = per_class_sample(marks, "label", docs_per_label, F.col("labelled_id"))
    sample = docs.select(F.col(doc_id).alias("labelled_id"), F.col(text).alias("body")).join(F.broadcast(chosen), "labelled_id")

    def counted(batches):
        for frame in batches:
            texts = [t.encode(errors="replace") if t else b"" for t in frame["body"]]
            rows = [x.astype("<f4").tobytes() for a, b in slices(texts) for x in term_counts(texts[a:b])]
            yield pd.DataFrame({"labelled_id": frame["labelled_id"].astype(str), "label": frame["label"], "counts": rows})

    rows = sorted(sample.mapInPandas(counted, "labelled_id string, label int, counts binary").collect())
    counts = np.array([np.frombuffer(bytes(r["counts"]), "<f4") for r in rows]).reshape(len(rows), TERMS)
    return LatentNeighbours(counts, np.array([r["label"] for r in rows]))


def training_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose crc32(id) mod 3 is not 1; the others are held out."""
    return labels.where(held_out_bucket(F.col(doc_id), 3) != 1)


def rate(df: DataFrame, model: LatentNeighbours, text: str = "text") -> DataFrame:
    """Adds score and predicted to every row; columns of these names in ``df`` are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def vote(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *map(shared.value.score, text_slices(column))]), pa.float64())

    return df.withColumn("score", vote(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: LatentNeighbours, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The filter stage: rejects documents whose neighbours vote for label 0."""
    return rate(docs.withColumn("__text", F.col(text)), model, "__text").where(F.col("score") >= min_score).select(*docs.columns)
