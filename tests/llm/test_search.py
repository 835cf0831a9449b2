"""Operators 11, 12 and 13 against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscope.llm import binary_codes, divergence, lexical_search, queries

TERM = re.compile(lexical_search.TERM)
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """item_id, rank, doc_id, score by scoring every document."""
    words = [(d, TERM.findall(brute.ascii_lower(t or ""))) for d, t in docs]
    words = [(d, Counter(w), len(w)) for d, w in words if w]
    n, total = len(words), sum(x[2] for x in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = TERM.findall(brute.ascii_lower(text or ""))
        scores = []
        for d, c, size in words:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=str)


def search(spark, tmp_path, docs, items, name="index", **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    index = lexical_search.build_index(docs, str(tmp_path / name), **more)
    rows = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted(map(tuple, rows), key=str)


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 31) - 1])
    data, ends = lexical_search.pack(values)
    assert lexical_search.unpack(data.tobytes()).tolist() == values.tolist()
    assert [lexical_search.unpack(data[a:b].tobytes()).tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [[v] for v in values]
    assert lexical_search.unpack(b"").tolist() == []


@pytest.mark.parametrize("block, shard_bytes", [(4, 2000), (2, 1 << 20)])
def test_search_equals_scoring_all(spark, tmp_path, monkeypatch, block, shard_bytes):
    """Frequent and rare terms, repeats in items, ties of equal documents over shards and blocks."""
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)] + ["É", "x1", "B"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(30)] + [(99, docs[5][1].upper()), (100, "w1 w1 W1 nowhere")]
    assert search(spark, tmp_path, docs, items, shard_bytes=shard_bytes) == ranked(docs, items)


def test_candidates_are_rejected_before_decompression(monkeypatch):
    """Block maxima reject candidates, blocks without a candidate stay compressed, and the best are those of whole lists."""
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    rng, shard, seen = random.Random(6), lexical_search._Shard(), Counter()
    vocabulary = [f"w{min(int(rng.paretovariate(0.5)), 5000)}" for _ in range(5000)]
    for i in range(2000):
        shard.add(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))).encode())
    rows = {r["term"]: r for b in shard.rows(0, lexical_search.pa.int64()) for r in b.to_pylist()}
    statistics = lexical_search._Statistics(2000, sum(shard.lengths))
    norm = statistics.norm(np.array(shard.lengths))
    for _ in range(40):
        asked = Counter(rng.choice(vocabulary) for _ in range(12))
        lists = [(lexical_search._List(type("Row", (), rows[t] | {"weight": math.floor(1000 * math.log(4002 / (2 * rows[t]["docs"] + 1)))}), statistics, norm), n) for t, n in asked.items() if t in rows]
        docs, scores = lexical_search.best_of_shard(lists, 2000, np.arange(2000), 3, seen)
        whole = np.zeros(2000, np.int64)
        for x, n in lists:
            at, parts = x.all()
            whole[at] += parts * n
        want = sorted(np.flatnonzero(whole).tolist(), key=lambda d: (-whole[d], d))[:3]
        assert docs.tolist() == want and scores.tolist() == whole[want].tolist()
    assert seen["left"] > 1000 and seen["rejected"] > 100


def test_search_cases(spark, tmp_path):
    docs = brute.edge_rows(spark)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "The CAT, the dog: long words!"), (1, "The CAT, the dog: long words!"), (1, "number"), (2, None), (3, "..."), (None, "x" * 20_000), (4, "unseen")]
    assert search(spark, tmp_path, docs, items) == ranked(plain, items)
    none = spark.createDataFrame([], "doc_id string, text string")
    assert search(spark, tmp_path, none, items, "none") == [] and search(spark, tmp_path, docs, [], "docs") == []


def audited(rows, min_docs=10, top=10):
    terms_of = defaultdict(Counter)
    df, groups = defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = LETTERS.findall(brute.ascii_lower(text or ""))
        terms_of[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t in df[lang] if df[lang][t] >= min_docs]
        p = {}
        for s in (*sources, None):
            n = Counter({t: terms_of[lang, s][t] if s is not None else sum(terms_of[lang, x][t] for x in sources) for t in kept})
            p[s] = {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if terms_of[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audit(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(map(tuple, divergence.audit(docs, **more).collect()))


@pytest.mark.parametrize("tile, chunk_rows, held", [(64, 65_536, 400_000), (2, 300, 50)])
def test_audit_equals_sums_over_all_terms(spark, monkeypatch, tile, chunk_rows, held):
    """More terms than a word has bits, several chunks and tiles, terms that one, both or no source lacks."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(8)
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = []
    for lang, size in (("en", 300), ("de", 40), (None, 5)):
        for _ in range(120):
            s = rng.choice(["a", "b", "b", "b", "ü", None, "sole"])
            rows.append((lang, s, " ".join(name(int(rng.paretovariate(0.4)) % size if s != "sole" else 7) for _ in range(rng.randint(0, 40)))))
    rows += [("xx", "one", "alone in here")] + [("yy", "a", None), ("yy", "b", "")]
    assert audit(spark, rows, min_docs=3) == audited(rows, 3)


def test_audit_cases(spark):
    docs = brute.edge_rows(spark)
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, divergence.audit(docs, min_docs=1).collect())) == audited(rows, 1)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_share_is_exact(spark):
    counts = [0, 1, 7, 10**12, 3 * 10**14]
    df = spark.createDataFrame([(c, t, v) for c in counts for t in (0, 3, 10**15 + 7) for v in (0, 1, 10**8)], "c long, t long, v long")
    for c, t, v, p in df.select("c", "t", "v", divergence.share(F.col("c"), F.col("t"), F.col("v"))).where("c <= t").collect():
        assert p == 1 + 10**9 * (c + 2) // max(1, t + 2 * v)


def linked(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept by all pairs."""
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    near = [[j for j, (_, w, m) in enumerate(rows) if i != j and good(v, k) and good(w, m) and k == m and len(v) == len(w) and cosine(v, w) >= threshold] for i, (_, v, k) in enumerate(rows)]
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - reached
            reached |= new
            todo += new
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return sorted(out, key=str)


def near_vectors(dim, seed=4):
    """Chains of vectors at cosines on both sides of 0.93, a dense group, copies and unrelated ones."""
    rng = np.random.default_rng(seed)
    rows, vec_id = [], 500
    for _ in range(12):
        v = rng.standard_normal(dim)
        for _ in range(5):
            rows.append((vec_id, v.tolist(), int(rng.integers(3))))
            w = rng.standard_normal(dim)
            w -= w @ v / (v @ v) * v
            angle = math.acos(0.93) + rng.choice([-0.2, -0.02, 0.02, 0.3])
            v = math.cos(angle) * v / np.linalg.norm(v) + math.sin(angle) * w / np.linalg.norm(w)
            vec_id -= 1
    v = rng.standard_normal(dim)
    rows += [(1000 + i, (v + 0.05 * rng.standard_normal(dim)).tolist(), 1) for i in range(40)]
    return rows + [(2000 + i, v.tolist(), 1) for i in range(5)] + [(3000 + i, (2 * v).tolist(), 2) for i in range(2)]


@pytest.mark.parametrize("dim, tile_bytes", [(64, 1 << 20), (24, 1500), (2, 64)])
def test_links_equal_all_pairs(spark, dim, tile_bytes):
    rows = near_vectors(dim)
    got = binary_codes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile_bytes=tile_bytes).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows)


def test_estimates_are_unbiased_and_bounds_hold():
    """Over rotations the estimate's mean is the cosine; no pair at the threshold falls below the certain bound."""
    rng = np.random.default_rng(1)
    dim = 64
    x = rng.standard_normal(dim)
    y = x + 0.3 * rng.standard_normal(dim)
    cosine = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    estimates = []
    for seed in range(400):
        code, factor = binary_codes.encode(x[None], seed)
        signs = np.unpackbits(code, axis=1, count=dim)[0] * 2.0 - 1
        estimates.append(signs @ (y / np.linalg.norm(y) @ binary_codes.rotation(dim, seed)) / np.sqrt(dim) / factor[0])
        assert estimates[-1] >= binary_codes.least_estimate(factor, dim, cosine, None)[0]
        assert binary_codes.least_estimate(factor, dim, cosine, 2.0)[0] > binary_codes.least_estimate(factor, dim, cosine, None)[0]
    assert abs(np.mean(estimates) - cosine) < 4 * np.std(estimates) / 20
    inside = np.mean([e >= binary_codes.least_estimate(np.array([f]), dim, cosine, 3.0)[0] for e, f in zip(estimates, [factor[0]] * 400, strict=True)])
    assert inside > 0.98


def test_unrelated_pairs_are_not_computed():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 64))
    codes, factors = binary_codes.encode(vectors)
    side = binary_codes._Side(64, np.arange(400).tobytes(), np.ones(400, np.int64).tobytes(), codes.tobytes(), factors.tobytes(), vectors.tobytes())
    turned = ((side.vectors / side.norms[:, None]) @ binary_codes.rotation(64)).astype(np.float32)
    i, j = binary_codes.survivors(side, side, slice(0, 400), turned, 0.93, None)
    assert {(k, k) for k in range(400)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 600


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (None, [5.0, 0.1], 1), (None, [-1.0, 0.0], 2), (None, [-2.0, 0.0], 2), (11, [1e300, 1e300], 3), (12, [1e-300, 1.1e-300], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "tile": F.lit("x"), "n_links": F.lit(None), "copies": F.lit(0.5)})
    assert sorted(map(tuple, binary_codes.near_duplicates(df).collect()), key=str) == linked([(i, v, k) for i, v, k in rows])
    assert binary_codes.near_duplicates(df.limit(0)).count() == 0


def test_search_queries_return_the_contract(spark):
    found = queries.op11_blockmax_search(spark, brute.SF_SMALL)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() > 0
