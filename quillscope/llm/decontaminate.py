"""Operator 7: benchmark decontamination by a broadcast set of test n-grams.

DataFrame functions only.  A text's normalised words are an array; every
benchmark window of ``n`` consecutive words (an item with fewer words is one
window) is a row of a small table keyed by the window's 64-bit hash.  The
documents' positions are generated, hashed and looked up in the broadcast hash
table in one scan without a shuffle; a hit is verified word by word.  Only
hits, and one header row per document, are grouped afterwards.

The window table is broadcast while all of it is at most ``MAX_BROADCAST_BYTES``;
beyond that, positions and windows are joined by a shuffle of the hashes, without
the documents' words, and the hits go back to their document's words to be
verified there in the same way.

Cases: null or wordless texts have no words and are clean; equal windows of
several items count for each of those items; repeated items count once per id;
equal document ids or repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Normalised words; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def windows(benchmark: DataFrame, n: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(size, hash, gram, items): each distinct window of the benchmark and the ids of its items, as strings."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    grouped = grams.groupBy("gram").agg(F.collect_set("item").alias("items"))
    return grouped.select(F.size("gram").alias("size"), window_hash(F.col("gram")).alias("hash"), "gram", "items")


def _hits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with a word array ``w`` times their verified window hits: adds pos (from 0), size and items.

    Every row also comes once with pos equal to its number of words and no hit.
    """
    known = table.agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    sizes = known["sizes"]  # at most WINDOW values
    none = {"size": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")}
    if not sizes:
        return rows.withColumns({"pos": F.size("w"), **none})
    gram_size = F.explode(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0])
    here = F.slice("w", F.col("pos") + 1, F.col("gram_size"))
    fits = F.col("pos") + F.col("gram_size") <= F.size("w")

    def positions(of: DataFrame) -> DataFrame:
        at = of.select("*", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos")).withColumn("gram_size", gram_size)
        return at.withColumn("here_hash", F.when(fits, window_hash(here)))

    if known["bytes"] <= MAX_BROADCAST_BYTES:
        header = (F.col("pos") == F.size("w")) & (F.col("gram_size") == sizes[0])
        joined = positions(rows).join(F.broadcast(table), F.col("here_hash") == F.col("hash"), "left")
        verified = F.col("items").isNotNull() & (F.col("gram_size") == F.col("size")) & (here == F.col("gram"))
        return _merged(joined.withColumn("items", F.when(verified, F.col("items"))).where(verified | header), rows)
    numbered = rows.withColumn("__n", F.monotonically_increasing_id())
    narrow = positions(numbered).where("here_hash is not null").select("__n", "pos", "gram_size", "here_hash")
    hits = narrow.join(table, (F.col("here_hash") == F.col("hash")) & (F.col("gram_size") == F.col("size"))).select("__n", "pos", "gram_size", "size", "gram", "items")
    verified = hits.join(numbered, "__n").where(here == F.col("gram"))
    headers = rows.withColumns({"pos": F.size("w"), **none})
    return verified.select(headers.columns).unionByName(headers)


def _merged(joined: DataFrame, rows: DataFrame) -> DataFrame:
    """A header that met another window of its hash is no hit: it keeps no size."""
    return joined.select(*rows.columns, "pos", F.when(F.col("items").isNotNull(), F.col("size")).alias("size"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, n_words, n_hit, spans of hit words (from, to), and the ids of the items found."""
    table = windows(benchmark, n)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("w"))
    found = _hits(rows, table).select("row", "doc_id", "pos", "size", "items")
    grouped = found.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.max("pos").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("size")).alias("to"))))).alias("hits"),
        F.collect_set("items").alias("item_sets"),
    )
    item_ids = F.array_sort(F.array_distinct(F.flatten("item_sets")))
    merged = F.aggregate(
        "hits",
        F.array().cast("array<struct<pos:int,to:int>>"),
        lambda spans, h: F.when(
            (F.size(spans) > 0) & (F.element_at(spans, -1)["to"] >= h["pos"]),
            F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(F.element_at(spans, -1)["pos"].alias("pos"), F.greatest(F.element_at(spans, -1)["to"], h["to"]).alias("to")))),
        ).otherwise(F.concat(spans, F.array(h))),
    )
    counted = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["to"] - F.greatest(h["pos"], s["to"]))).alias("n"), F.greatest(s["to"], h["to"]).alias("to")),
        lambda s: s["n"],
    )
    return grouped.select("doc_id", "n_words", counted.cast("long").alias("n_hit"), merged.alias("spans"), item_ids.alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, text: str = "text") -> DataFrame:
    """The filter stage, with the columns of ``docs``: drops contaminated documents, or with ``remove="spans"`` their hit words.

    Contamination is a function of the text alone, so the texts with hits are
    found in one scan and matched by their digest; only the digests of such
    texts are grouped.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    bodies = docs.select(digest(F.col(text)).alias("__digest"), words(F.col(text)).alias("w"))
    found = _hits(bodies, windows(benchmark, n)).where("items is not null")
    marked = docs.withColumn("__digest", digest(F.col(text)))
    if remove == "documents":
        return marked.join(found.select("__digest").distinct(), "__digest", "left_anti").select(*docs.columns)
    # The positions of hit words, at most as many as the document has words.
    hit = found.select("__digest", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("at")).groupBy("__digest").agg(F.collect_set("at").alias("at"))
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    first_is_word = F.col(text).rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]").cast("int")
    is_hit = F.map_from_arrays("at", F.transform("at", lambda _: F.lit(True)))
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~(((i + first_is_word) % 2 == 1) & F.coalesce(F.element_at("__hit", F.floor((i + first_is_word - 1) / 2).cast("int")), F.lit(False))), x)), lambda x: x.isNotNull())
    cleaned = F.when(F.col("__hit").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return marked.join(hit.select("__digest", is_hit.alias("__hit")), "__digest", "left").withColumn(text, cleaned).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of :func:`contamination`."""
    c = contamination(docs, benchmark)
    return c.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
g AS (SELECT DISTINCT item, size, gram FROM (
        SELECT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
        FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0)),
p AS (SELECT rid, i, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS gram
      FROM d, unnest(range(1, len(w) + 1)) AS t(i), (SELECT DISTINCT size FROM g) s WHERE i + s.size - 1 <= len(w)),
h AS (SELECT rid, i, p.size, item FROM p JOIN g ON g.gram = p.gram AND g.size = p.size),
n AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""
