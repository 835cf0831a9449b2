"""Operator 3: SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed in Arrow batches: a text's words joined by one space
make every shingle a contiguous slice, which is hashed with XXH64 (seed 42); a
bit is set if it is set in over half of the hashes.

Linking is exact, not a banded candidate search.  Distinct fingerprints are
dealt into *tiles*: a cell per vector of population counts of four 16-bit
words, cut into tiles of at most ``TILE`` fingerprints.  The Hamming distance
of two fingerprints is at least the L1 distance of their population counts, so
tile pairs whose counts differ by more than the radius are never formed; for
all others, numpy exclusive-or and bit counts compare every pair.  A tile pair
returns a spanning forest of its links, at most one link per fingerprint, so
no group is emitted as all its pairs.

Cases: null or empty texts have fingerprint 0, which links like any other;
texts with fewer words than a shingle have one shingle; equal ids or repeated
rows keep a row each; a null id is never a component's id unless all are null.
"""

from __future__ import annotations

from itertools import chain, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, components
from quillscope.llm.pieces import text_slices

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 4096
BLOCK = 512
GROUP = 100_000


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text (uint64)."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII only: A-Z, and white space 09-0D and 20
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        k = max(1, len(words) - shingle + 1)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[:k].tolist()
        end = end[len(words) - k :].tolist()
        ones, n = np.zeros(64, np.int64), 0
        for at in range(0, k, GROUP):
            h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[at : at + GROUP], end[at : at + GROUP], strict=True)), np.uint64, min(GROUP, k - at))
            ones += _bit_sums(h)
            n += len(h)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from bit 0."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.int64) if len(h) > 255 else np.add.reduce(bits, axis=0, dtype=np.uint8).astype(np.int64)


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a string column as a (signed) long."""

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        found = [fingerprints(texts, shingle) for texts in text_slices(column)]
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    return fingerprint(text)


def _cell(fp: Column) -> Column:
    """Population counts of the four 16-bit words, five bits each."""
    word = lambda i: F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))
    return sum((word(i) * (32**i) for i in range(1, 4)), word(0)).cast("long")


def neighbour_offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors within the radius; of each and its opposite, one."""
    every = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in every if d >= (0, 0, 0, 0)]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles of fingerprints (uint64)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    us, vs = [], []
    for s in range(0, len(a), BLOCK):
        part = a[s : s + BLOCK]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ b[None, :]) <= radius)
        for x, y in zip(part[i].tolist(), b[j].tolist(), strict=True):
            if x != y and (rx := root(x)) != (ry := root(y)):
                parent[max(rx, ry)] = min(rx, ry)
                us.append(x)
                vs.append(y)
    return us, vs


def _compare(radius: int):
    def linked(batches):
        for frame in batches:
            us, vs = [], []
            for a, b in zip(frame["left"], frame["right"], strict=True):
                u, v = _forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
                us += u
                vs += v
            yield pd.DataFrame({"u": np.array(us, np.uint64).view(np.int64), "v": np.array(vs, np.uint64).view(np.int64)})

    return linked


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect distinct fingerprints (a column ``fp``) as all links within the radius do.

    Cells are cut into tiles by a hash of the fingerprint; a tile has ``TILE``
    in expectation.  Left tiles are replicated to the neighbouring cells, and
    the join key carries the right tile's number, so a large cell is spread.
    """
    cells = distinct.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = cells.groupBy("cell").count().select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    # At most 17^4 cells, two numbers each: a bounded broadcast.
    cells = cells.join(F.broadcast(sizes), "cell")
    tiles = cells.groupBy("cell", "tiles", F.pmod(F.xxhash64("fp", F.lit("tile")), "tiles").alias("tile")).agg(F.collect_list("fp").alias("fps"))
    # A count outside 0..16 makes a number that is no cell, so the join drops it.
    offsets = F.array(*(F.lit(sum(x * 32**i for i, x in enumerate(reversed(d)))).cast("long") for d in neighbour_offsets(radius)))
    left = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.col("fps").alias("left"), F.explode(offsets).alias("offset"))
    left = left.select("own", "own_tile", "left", (F.col("own") + F.col("offset")).alias("cell"))
    left = left.join(F.broadcast(sizes), "cell").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("tiles") - 1).cast("long")))).drop("tiles")
    pairs = left.join(tiles.select("cell", "tile", F.col("fps").alias("right")), ["cell", "tile"]).where("own != cell or own_tile <= tile")
    return pairs.select("left", "right").mapInPandas(_compare(radius), "u long, v long")


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int) -> DataFrame:
    """doc_id, fp, text hash, and of the row's component the least (doc_id, text hash); null ids come last."""
    checkpoint_folder(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), simhash(body, shingle).alias("fp")).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    of_fp = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_fp.groupBy("root").agg(F.min("least").alias("first"))
    named = of_fp.join(least, "root").select(F.col("fp").alias("named_fp"), F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("first_h"))
    return rows.join(named, F.col("fp") == F.col("named_fp")).drop("named_fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every row's ``doc_id``, ``fp`` (long) and ``component_id``: the least id reachable over links."""
    return _classes(docs, doc_id, text, shingle, radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The filter stage: of every component one row stays, the one with the least id (of equal ids, the least text hash)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("__id")
    first = _classes(docs, doc_id, text, shingle, radius).where("doc_id <=> component_id and h = first_h")
    first = first.select(name("doc_id"), F.col("h").alias("__h")).distinct()
    marked = docs.select("*", name(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    return marked.join(first, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"]).select(*docs.columns)
