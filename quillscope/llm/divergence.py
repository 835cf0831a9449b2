"""Operator 12: source divergence audit by count-level bitmaps.

Terms are counted in Arrow batches, per (language, source), and summed by
Spark.  A language keeps the terms of at least ``MIN_DOCS`` of its documents.
Its kept terms are dealt by a hash into chunks, numbered in each chunk from
the most frequent one, and every (language, source, count) stores the bitmap
of its terms' numbers as 64-bit words, empty words left out.

For two sources the AND of a count's bitmap of one and a count's bitmap of the
other, and its population count, give the joint cell of the two counts: so
many terms share the same value of f, which is computed once a cell.  Terms
that a source lacks are the complement of the union of its bitmaps; terms that
both lack are what the union of all cells leaves of the vocabulary.  Since
words are matched by their place, a word of 64 terms has at most 64 x 64
cells whatever the counts are.

Sources are dealt into tiles of about ``TILE``; a task has one chunk and two
tiles.  A chunk has about ``CHUNK_ROWS`` (term, source) rows, so neither many
sources nor a large vocabulary makes a large task.

Cases: null language, source or text is ''; a group without terms counts zero
of every kept term; a language without kept terms has value 0 for every pair
and no term rows; a language of one source has no pairs; repeated rows and
equal ids count as documents of their own; an empty table has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, hint_small
from quillscope.llm.pieces import text_slices

MIN_DOCS = 10
TOP = 10
TILE = 64
CHUNK_ROWS = 65_536
#: Terms that a task counts before it hands them on.
HELD = 400_000
ONE = 1_000_000_000

#: A-Z become a-z, other ASCII that is not a letter a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 10_000):
                part = terms[a : a + 10_000]
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * len(part), pa.string()),
                        "source": pa.array([source] * len(part), pa.string()),
                        "term": pa.array(part, pa.binary()).cast(pa.string()),
                        "n": pa.array([n[t] for t in part], pa.int64()),
                        "df": pa.array([df[t] for t in part], pa.int64()),
                    }
                )
        held.clear()

    size = 0
    for batch in batches:
        groups = zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)
        for texts in text_slices(batch["text"]):
            for text in texts:
                n, df = held.setdefault(next(groups), (Counter(), Counter()))
                words = text.translate(LETTERS).split()
                before = len(n)
                n.update(words)
                df.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
    yield from out()


def _empty_for_null(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, lang_n): occurrences of every kept term in the groups that have it, and in the language.

    One shuffle by (language, term) serves the sums and the filter.
    """
    partial = _empty_for_null(docs, lang, source, text).mapInArrow(_partial_counts, "lang string, source string, term string, n long, df long")
    summed = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    kept = summed.withColumns({"lang_df": F.sum("df").over(of_term), "lang_n": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    return kept.where(F.col("lang_df") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).alias("first"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact."""
    above = (count + 2).cast("decimal(27,0)") * F.lit(ONE).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(38,0)"))


def _f(p: np.ndarray, q) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def bitmaps(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lang, chunk, source, n, word, bits): of every group and count, the words of its terms' bitmap that are not zero."""
    in_chunk = Window.partitionBy("lang", "chunk").orderBy(F.col("lang_n").desc(), "term")
    dealt = counts.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    # Dealt by both: a join by language must not leave a language in one task.
    numbered = dealt.repartition("lang", "chunk").withColumn("id", F.dense_rank().over(in_chunk) - 1)
    return numbered.groupBy("lang", "chunk", "source", "n", F.floor(F.col("id") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, id % 64))").alias("bits"))


class _Group:
    """Bitmap words of one source in one chunk, by word; ``p`` of each and of a count of zero."""

    def __init__(self, frame: pd.DataFrame, words: int):
        head = (frame["bits"] == 0).to_numpy()
        self.p0 = int(frame["p"].to_numpy()[head][0])
        rows = frame[~head].sort_values("word")
        self.word = rows["word"].to_numpy(np.int64)
        self.bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
        self.p = rows["p"].to_numpy(np.int64)
        self.starts = np.searchsorted(self.word, np.arange(words + 1))
        self.any = np.zeros(words, np.uint64)
        np.bitwise_or.at(self.any, self.word, self.bits)


def _pair(x: _Group, y: _Group) -> tuple[int, int]:
    """Sum of f over the terms that x or y has, and how many these are."""
    times = (y.starts[1:] - y.starts[:-1])[x.word]
    i = np.repeat(np.arange(len(x.word)), times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(y.starts[x.word], times)
    cells = np.bitwise_count(x.bits[i] & y.bits[j])
    at = np.flatnonzero(cells)
    value = int((cells[at].astype(np.int64) * _f(x.p[i[at]], y.p[j[at]])).sum())
    for a, b in ((x, y), (y, x)):  # what b lacks
        alone = np.bitwise_count(a.bits & ~b.any[a.word]).astype(np.int64)
        value += int((alone * _f(a.p, b.p0)).sum())
    return value, int(np.bitwise_count(x.any | y.any).sum())


def _tiles(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    lang, _, left, right = key
    words = int(frame["word"].max()) + 1
    groups = {s: _Group(rows, words) for s, rows in frame.groupby("source", sort=True)}
    sides = {s: t for s, t in zip(frame["source"], frame["tile"], strict=True)}
    found = [(lang, a, b, *_pair(groups[a], groups[b])) for a in groups for b in groups if sides[a] == left and sides[b] == right and (left != right or a < b)]
    return pd.DataFrame(found, columns=["lang", "a", "b", "value", "held"])


def pair_sums(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value, held) of unordered pairs of sources: f summed over the terms that either has, and their number.

    ``groups``: lang, source, total, terms, chunks, tiles of every group.
    """
    of_group = groups.select("lang", "source", "total", "terms", "chunks", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"))
    rows = words.join(of_group, ["lang", "source"])
    # A head has no bits; it gives its group's p of a count of zero.
    heads = of_group.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    heads = heads.select(*of_group.columns, "chunk", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("word"), F.lit(0).cast("long").alias("bits"))
    rows = rows.select(heads.columns).unionByName(heads).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1))
    placed = rows.withColumn("other", other).select("lang", "chunk", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "source", "tile", "p", "word", "bits")
    found = placed.groupBy("lang", "chunk", "left", "right").applyInPandas(_tiles, "lang string, a string, b string, value long, held long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: each group against the other sources (``pair``) and its ``top`` terms against the language (``term``)."""
    checkpoint_folder(docs.sparkSession)
    counts = term_counts(docs, min_docs, lang, source, text).checkpoint()
    every = _empty_for_null(docs, lang, source, source).select("lang", "source").distinct()
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"), F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK_ROWS)).cast("int").alias("chunks")).checkpoint()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = every.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(number, "lang")
    groups = groups.select("lang", "source", "tiles", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("total", 0), ("terms", 0), ("lang_total", 0), ("chunks", 1)))).checkpoint()
    summed = pair_sums(bitmaps(counts, hint_small(langs.select("lang", "chunks"))), hint_small(groups)).checkpoint()

    p0 = share(F.lit(0), F.col("total"), F.col("terms"))
    one = groups.select("lang", "source", "terms", p0.alias("p0"))
    two = groups.select("lang", F.col("source").alias("item"), p0.alias("q0"))
    both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "held"))
    pairs = one.join(two, "lang").where("source != item").join(both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", "held"), ["lang", "source", "item"], "left")
    # what neither has: the rest of the vocabulary
    rest = (F.col("terms") - F.coalesce("held", F.lit(0))) * f(F.col("p0"), F.col("q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    own = counts.join(hint_small(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = own.select("lang", "source", F.lit("term").alias("part"), "item", f(F.col("p"), F.col("q")).alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", nth).unionByName(terms.withColumn("rank", nth).where(F.col("rank") <= top))


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""
