"""Operator 9: packing along a space-filling curve.

Every document has a hashed vector (counts of its byte triples in buckets,
normalised), projected to three dimensions by a fixed random matrix; a bounded
sample gives each dimension's quantiles, which turn a projection into a point
of a 2^10 cube, and its Hilbert index is the sort key.  The documents are
range-partitioned and sorted by that key (then a hash of id and text, so
copies, which share a point, are spread over partitions), so neighbours on the
curve follow each other.  Each range of the curve is then packed in order:
documents are tokenised as they stream by, an end-of-document id is added, and
the stream is cut every ``SEQUENCE`` tokens.  Only the last sequence of a range
is not full.

The ids are those of the ``tokenizers`` library; every distinct pre-token is
encoded once per worker by the same vocabulary, and remembered.

Cases: a null or empty text is the end id alone; equal ids or repeated rows are
packed a time each; an empty table has no pieces; a text of any length is cut
into as many sequences as it needs.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.llm.pieces import held, split_pieces, text_slices, texts_of
from quillscope.llm.token_counts import Vocabulary, default_tokenizer

SEQUENCE = 1024
END = 0
BUCKETS, DIMENSIONS, LEVEL_BITS = 512, 3, 10
SAMPLE_DOCS = 20_000
RANGE_BYTES = 16 << 20
MAX_RANGES = 16_384
MAX_CACHED_PIECES = 400_000
LONGEST_CACHED = 64
SLICE_BYTES = 1 << 21
OUT_ROWS = 20_000


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def project(texts: list[bytes]) -> np.ndarray:
    """Points of the texts: hashed byte-triple vectors, projected."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    a, held = 0, 0
    for b, t in enumerate(texts, 1):
        held += len(t)
        if held >= SLICE_BYTES or b - a == 4096 or b == len(texts):
            part = texts[a:b]
            raw = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            if len(raw) > 2:
                triple = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
                inside = owner[:-2] == owner[2:]
                key = owner[:-2] * BUCKETS + ((triple * np.uint32(2654435761)) >> np.uint32(32 - 9))
                counts = np.sqrt(np.bincount(key[inside], minlength=len(part) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32))
                norm = np.linalg.norm(counts, axis=1, keepdims=True)
                out[a:b] = counts / np.where(norm == 0, 1, norm) @ _projection()
            a, held = b, 0
    return out


def hilbert_index(points: np.ndarray, bits: int = LEVEL_BITS) -> np.ndarray:
    """Hilbert indices of integer points (n x d), coordinates below 2^bits.

    The curve of each cube is that of the unit cube, Gray-coded, with axes
    exchanged or reflected by the sub-cube it enters; working from the highest
    bit down, exchanges and reflections are undone on the lower bits.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(d):
            reflect = (x[axis] & bit) != 0
            swap = np.where(reflect, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(reflect, lower, swap)
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & 1 << level, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            index = index << 1 | (x[axis] >> level & 1)
    return index


class Curve:
    """Quantile edges of each dimension, and the keys at which the ranges of the curve begin."""

    def __init__(self, sample: np.ndarray, ties: np.ndarray, sizes: np.ndarray, total: int):
        inner = np.linspace(0, 1, (1 << LEVEL_BITS) + 1)[1:-1]
        self.edges = np.quantile(sample, inner, axis=0).T if len(sample) else np.zeros((DIMENSIONS, 0))
        self.ranges = max(1, min(MAX_RANGES, -(-total // RANGE_BYTES)))
        keys = self.keys(sample, ties) if len(sample) else np.zeros(0, np.int64)
        order = np.argsort(keys)
        share = np.cumsum(sizes[order]) / max(1, sizes.sum())
        at = np.searchsorted(share, np.arange(1, self.ranges) / self.ranges)
        self.begins = np.unique(keys[order][np.minimum(at, len(keys) - 1)]) if len(keys) else np.zeros(0, np.int64)

    def keys(self, points: np.ndarray, ties: np.ndarray) -> np.ndarray:
        cells = np.stack([np.searchsorted(e, points[:, k]) for k, e in enumerate(self.edges)], axis=1)
        return hilbert_index(cells) << 32 | ties

    def place(self, texts: list[bytes], ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys(project(texts), ties)
        return keys, np.searchsorted(self.begins, keys, "right")


class PieceIds(dict):
    """Ids of pre-tokens as bytes; missing ones are encoded."""

    def __init__(self, one):
        super().__init__()
        self.one = one

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("I", self.one(piece)).tobytes()
        if len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


class Encoder:
    """Token ids of texts."""

    def __init__(self, path: str):
        import tiktoken

        self.vocabulary = Vocabulary(path)
        # Ids follow the merges, so they are ranks; only whole pre-tokens are passed, so the pattern has no part.
        self.ids_of = PieceIds(tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.vocabulary.id_of, special_tokens={})._core_bpe.encode_single_piece)

    def of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.ids_of) > MAX_CACHED_PIECES:
            self.ids_of.clear()
        return list(map(self.ids_of.__getitem__, pieces))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts: list[list[bytes]] = [[] for _ in texts]
        plain = list(texts)
        for i, text in enumerate(texts):
            if any(s in text for s in self.vocabulary.special):
                parts[i], plain[i] = self._with_special(text), b""
        for pieces, sizes, index in split_pieces(plain):
            ids, at = self.of_pieces(pieces), 0
            for n, i in zip(sizes.tolist(), index.tolist(), strict=True):
                parts[i].append(b"".join(ids[at : at + n]))
                at += n
        return [b"".join(p) for p in parts]

    def _with_special(self, text: bytes) -> list[bytes]:
        special = max((s for s in self.vocabulary.special if s in text), key=len)
        mark = np.array([self.vocabulary.special[special]], "<u4").tobytes()
        ids = self.encode(text.split(special))
        return list(itertools.chain.from_iterable((x, mark) for x in ids))[:-1]


def encoder(path: str) -> Encoder:
    return held(("ids by", path), lambda: Encoder(path))


def _packer(path: str | None, schema: pa.Schema, with_ids: bool):
    def pack(batches):
        encode = encoder(path or default_tokenizer()).encode
        end = np.array([END], "<u4").tobytes()
        here, sequence, fill = None, 0, 0
        rows: list[tuple] = []

        def out():
            table = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return table

        for batch in batches:
            ids_of, ranges = batch.column("doc_id").to_pylist(), batch.column("__range").to_pylist()
            a = 0
            for texts in text_slices(batch.column("body"), SLICE_BYTES):
                b = a + len(texts)
                for doc, at_range, ids in zip(ids_of[a:b], ranges[a:b], encode(texts), strict=True):
                    if at_range != here:
                        here, sequence, fill = at_range, at_range << 32, 0
                    ids += end
                    n, start = len(ids) // 4, 0
                    while start < n:
                        length = min(n - start, SEQUENCE - fill)
                        piece = ids[4 * start : 4 * (start + length)]
                        row = (doc, start, length, zlib.crc32(piece), n, sequence, fill)
                        rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32).tolist()) if with_ids else row)
                        start, fill = start + length, fill + length
                        if fill == SEQUENCE:
                            sequence, fill = sequence + 1, 0
                        if len(rows) >= OUT_ROWS:
                            yield out()
                a = b
        if rows:
            yield out()

    return pack


def fit_curve(rows: DataFrame) -> Curve:
    """From a bounded sample of rows (body, __tie): about ``SAMPLE_DOCS`` by hash."""
    at = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()
    chance = min(1.0, SAMPLE_DOCS / max(1, at["n"]))
    sample = rows.where(F.pmod(F.xxhash64("__tie", F.lit("sample")), F.lit(1 << 30)) < chance * (1 << 30))

    def points(batches):
        for frame in batches:
            texts = [t.encode(errors="replace") for t in frame["body"]]
            p = project(texts)
            yield pd.DataFrame({"tie": frame["__tie"], "size": [len(t) for t in texts], **{f"p{k}": p[:, k].astype(float) for k in range(DIMENSIONS)}})

    found = sorted(tuple(r) for r in sample.mapInPandas(points, "tie long, size long, " + ", ".join(f"p{k} double" for k in range(DIMENSIONS))).collect())
    table = np.array(found, float).reshape(len(found), 2 + DIMENSIONS)
    return Curve(table[:, 2:], table[:, 0].astype(np.int64), table[:, 1] + 1, at["bytes"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with ``with_ids`` its ids too.

    sequence_id is the range of the curve * 2^32 + the sequence in the range.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), body), 32)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), tie.alias("__tie"))
    curve = fit_curve(rows)
    shared = docs.sparkSession.sparkContext.broadcast(curve)

    @F.arrow_udf("key long, range int")
    def place(column: pa.Array, ties: pa.Array) -> pa.Array:
        keys, ranges = shared.value.place(texts_of(column), ties.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(ranges, pa.int32())], ["key", "range"])

    placed = rows.withColumn("__at", place(F.col("body"), F.col("__tie"))).select("doc_id", "body", F.col("__at.key").alias("__key"), F.col("__at.range").alias("__range"))
    sorted_rows = placed.repartitionById(curve.ranges, F.col("__range")).sortWithinPartitions("__range", "__key", "doc_id", "body")
    fields = ["start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", *["ids array<int>"] * with_ids]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(", ".join([f"doc_id {id_type}", *fields]))
    return sorted_rows.select("doc_id", "body", "__range").mapInArrow(_packer(tokenizer, to_arrow_schema(schema), with_ids), schema)
