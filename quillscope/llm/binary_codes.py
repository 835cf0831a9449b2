"""Operator 13: embedding near-duplicates by randomised-rotation binary codes.

After a random rotation (Gao and Long, "RaBitQ", 2024) a vector's code is the
signs of its components; stored with it is the correction factor f, the inner
product of the unit vector with its code scaled to length one.  For another
unit vector q the inner product of code and q, divided by f, is an unbiased
estimate of the cosine.  Its error is sqrt(1 - f^2) / f times the part of q
along one direction at right angles to the vector, and all such parts of a q
with cosine c are at most sqrt(1 - c^2) long.  So a pair of cosine t or more
has an estimate of at least t - sqrt(1 - f^2) / f * sqrt(1 - t^2): pairs
below that bound are dropped, and only the others are computed exactly, in
double precision.  With ``epsilon`` the bound is one of confidence instead:
a random direction has a part of about 1 / sqrt(D - 1), and epsilon such
deviations are allowed.  Without it (the default) the bound is certain and no
link is lost.

Equal vectors of a label are one class.  Classes of a label are dealt by a
hash into tiles of about ``TILE_BYTES``; a task row is a pair of tiles, and
returns the number of links of every class and a spanning forest of the links,
never the links themselves, so a group of near copies costs no pairs.

Cases: null labels, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing (0 links, a component of their own,
kept); vectors of different length never link; repeated rows and equal ids are
vectors of their own; a null id is a component's id only where all are null;
an empty table has no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, components

THRESHOLD = 0.93
SEED = 20240517
TILE_BYTES = 2 << 20
#: Left vectors compared with a tile at a time.
BLOCK = 256
#: Room for the rounding of single precision in estimates.
SLACK = 1e-4
TILE_SCHEMA = "label_key string, dim int, tile int, tiles int, nodes binary, copies binary, codes binary, factors binary, vectors binary"


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near one: exact, and squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def encode(vectors: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs) and correction factors of the rows."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = units @ rotation(vectors.shape[1], seed)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def least_estimate(factors: np.ndarray, dim: int, threshold: float, epsilon: float | None) -> np.ndarray:
    """The least estimate that a pair at the threshold can have, certainly or within epsilon deviations."""
    length = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors * np.sqrt(1 - threshold**2)
    part = 1.0 if epsilon is None else min(1.0, epsilon / np.sqrt(max(1, dim - 1)))
    return threshold - length * part - SLACK


def _tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    vectors = scaled(np.stack(frame["vec"].to_numpy()).astype(np.float64))
    codes, factors = encode(vectors)
    blobs = (frame["node"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64), codes, factors, vectors)
    return pd.DataFrame([(*key, int(frame["tiles"].iloc[0]), *(np.ascontiguousarray(b).tobytes() for b in blobs))], columns=[c.split()[0] for c in TILE_SCHEMA.split(", ")])


class _Side:
    def __init__(self, dim: int, nodes: bytes, copies: bytes, codes: bytes, factors: bytes, vectors: bytes):
        self.nodes, self.copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
        self.codes, self.factors = np.frombuffer(codes, np.uint8).reshape(len(self.nodes), -1), np.frombuffer(factors)
        self.vectors = np.frombuffer(vectors).reshape(-1, dim)
        self.norms = np.linalg.norm(self.vectors, axis=1)


def survivors(a: _Side, b: _Side, at: slice, turned: np.ndarray, threshold: float, epsilon: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of the rows ``at`` of a, and of b's rows, rotated unit vectors) whose estimates do not rule the threshold out."""
    dim = turned.shape[1]
    signs = np.unpackbits(a.codes[at], axis=1, count=dim).astype(np.float32) * 2 - 1
    estimates = (signs @ turned.T) / (np.sqrt(dim) * a.factors[at]).astype(np.float32)[:, None]
    return np.nonzero(estimates >= least_estimate(a.factors[at], dim, threshold, epsilon).astype(np.float32)[:, None])


def _linked(a: _Side, b: _Side, same: bool, threshold: float, epsilon: float | None) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Links of each of a's and b's classes (copies counted), and a spanning forest of the links."""
    n_a, n_b = len(a.nodes), len(b.nodes)
    dim = a.vectors.shape[1]
    turned = ((b.vectors / b.norms[:, None]) @ rotation(dim)).astype(np.float32)
    degree_a, degree_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    name = np.concatenate([np.arange(n_a), np.arange(n_b) + (0 if same else n_a)])[: n_a if same else None]
    shift = 0 if same else n_a
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    us, vs = [], []
    for s in range(0, n_a, BLOCK):
        at = slice(s, min(n_a, s + BLOCK))
        i, j = survivors(a, b, at, turned, threshold, epsilon)
        if same:
            i, j = i[j > i + s], j[j > i + s]
        if len(i) * 8 > (at.stop - s) * n_b:  # mostly links: one product
            cosines = ((a.vectors[at] @ b.vectors.T) / (a.norms[at, None] * b.norms[None, :]))[i, j]
        else:
            parts = [slice(k, k + 65_536) for k in range(0, len(i), 65_536)]
            cosines = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a.vectors[i[p] + s], b.vectors[j[p]]) / (a.norms[i[p] + s] * b.norms[j[p]]) for p in parts)])
        hit = cosines >= threshold
        i, j = i[hit] + s, j[hit]
        degree_a[at] += np.bincount(i - s, b.copies[j], at.stop - s).astype(np.int64)
        degree_b += np.bincount(j, a.copies[i], n_b).astype(np.int64)
        ends = np.searchsorted(i, np.arange(s, at.stop + 1))
        for row in np.flatnonzero(np.diff(ends)):
            found = np.unique(np.append(name[j[ends[row] : ends[row + 1]] + shift], name[s + row]))
            if len(found) > 1:
                us += nodes[found[1:]].tolist()
                vs += [int(nodes[found[0]])] * (len(found) - 1)
                name[np.isin(name, found[1:])] = found[0]
    return degree_a, degree_b, us, vs


def _compare(threshold: float, epsilon: float | None):
    blobs = ("nodes", "copies", "codes", "factors", "vectors")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                a = _Side(row.dim, *(getattr(row, f"left_{c}") for c in blobs))
                b = a if row.same else _Side(row.dim, *(getattr(row, c) for c in blobs))
                degree_a, degree_b, us, vs = _linked(a, b, row.same, threshold, epsilon)
                some_a, some_b = np.flatnonzero(degree_a), np.flatnonzero(degree_b)
                u = np.concatenate([a.nodes[some_a], b.nodes[some_b], np.array(us, np.int64)])
                v = np.concatenate([u[: len(u) - len(vs)], np.array(vs, np.int64)])
                n = np.concatenate([degree_a[some_a], degree_b[some_b], np.zeros(len(vs), np.int64)])
                yield pd.DataFrame({"u": u, "v": v, "n": n})

    return compared


def tiles(classes: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Codes, factors and vectors of classes (label_key, vec, node, copies), a row per tile."""
    keyed = classes.withColumn("dim", F.size("vec"))
    sizes = keyed.groupBy("label_key", "dim").agg(F.ceil(F.count("*") * F.first("dim") * 8 / tile_bytes).cast("int").alias("tiles"))
    dealt = keyed.join(sizes, ["label_key", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    return dealt.groupBy("label_key", "dim", "tile").applyInPandas(_tile, TILE_SCHEMA)


def compare_tiles(tiles: DataFrame, threshold: float = THRESHOLD, epsilon: float | None = None) -> DataFrame:
    """(u, v, n): with n > 0 the number of links of class u = v found in a pair of tiles, else a link (u, v) of the forest."""
    left = tiles.select("label_key", "dim", F.col("tile").alias("own"), *(F.col(c).alias(f"left_{c}") for c in ("nodes", "copies", "codes", "factors", "vectors")), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tile"))
    pairs = left.join(tiles.drop("tiles"), ["label_key", "dim", "tile"]).withColumn("same", F.col("own") == F.col("tile"))
    return pairs.mapInPandas(_compare(threshold, epsilon), "u long, v long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, epsilon: float | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Every row's vec_id, n_links, component_id and kept."""
    checkpoint_folder(vectors.sparkSession)
    vec = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col(label).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(good, F.col(label).cast("string")).alias("label_key"), F.when(good, F.transform(vec, lambda x: x + 0.0)).alias("vec"))
    classes = rows.where("label_key is not null").groupBy("label_key", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    found = compare_tiles(tiles(classes, tile_bytes), threshold, epsilon).checkpoint()
    degrees = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("n = 0").select("u", "v"))
    named = classes.join(degrees, "node", "left").join(roots, "node", "left")
    named = named.select("label_key", "vec", "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(firsts, "root").select("label_key", "vec", "n_links", "first")
    out = rows.join(named, ["label_key", "vec"], "left")
    own = F.coalesce(F.col("first"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


LINKS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
      WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93 END),
r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT r.a, min(v.vec_id) AS c FROM r JOIN v ON v.rid = r.b GROUP BY r.a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id IS NOT DISTINCT FROM c.c AS kept
FROM v JOIN c ON c.a = v.rid LEFT JOIN n ON n.a = v.rid
"""
