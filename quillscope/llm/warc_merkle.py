"""Operator 4: Merkle fixity audit of WARC records.

Records are serialised as WARC responses and hashed where they are read; only
a narrow index (slot, length, digest) is kept.  The slots of an archive, its
record numbers, are the leaves of a tree whose nodes cover ten neighbouring
nodes of the level below, so a leaf keeps its place when a replica lacks a
record or has one too many.  A node's digest covers its children's slots,
lengths and digests, and it knows the byte range of its records in its volume.
Two replicas are compared from the root down: a level joins only the children
of nodes that differ, until the differing records are found.

``RECORDS_PER_VOLUME`` slots make a volume (a WARC file); offsets are running
sums of record lengths in it.  A volume of more than ``WINDOW_ROWS`` records,
which only repeated numbers make, is summed over sorted ranges.

Cases: several records of one slot are one leaf, whatever their order; records
without a number get slots below zero by a hash of their address; null url or
body is empty; an empty replica differs in every leaf of the other; two empty
or equal replicas have no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, hint_small

FANOUT = 10
RECORDS_PER_VOLUME = 1000
UNNUMBERED_SLOTS = 1_000_000
WINDOW_ROWS = 100_000
INDEX = ("slot", "volume", "length", "digest", "offset")
HEADER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "


def record(url: Column, body: Column) -> Column:
    """A record's text: header, body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit(HEADER), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def index(pages: DataFrame, number: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """slot, volume, length, digest and offset (in its volume) of every record."""
    text = record(F.col(url), F.col(body))
    slot = F.coalesce(F.col(number).cast("long"), -1 - F.pmod(F.xxhash64(F.coalesce(F.col(url), F.lit(""))), F.lit(UNNUMBERED_SLOTS)))
    rows = pages.select(slot.alias("slot"), F.octet_length(text).cast("long").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"))
    checkpoint_folder(pages.sparkSession)
    rows = rows.withColumn("volume", F.floor(F.col("slot") / RECORDS_PER_VOLUME)).checkpoint()
    large = rows.groupBy("volume").count().where(F.col("count") > WINDOW_ROWS).select("volume").checkpoint()
    large = hint_small(large)
    small = _ends(rows.join(large, "volume", "left_anti"), "volume").withColumn("offset", F.col("end") - F.col("length"))
    return small.select(*INDEX).unionByName(_offsets_by_range(rows.join(large, "volume", "left_semi")))


def _ends(rows: DataFrame, *group: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of lengths in a group."""
    return rows.withColumn("end", F.sum("length").over(Window.partitionBy(*group).orderBy("slot", "digest", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _offsets_by_range(rows: DataFrame) -> DataFrame:
    """The index of volumes with very many records (repeated numbers): sums in sorted ranges of all records, after the volume's ranges before.

    Equal records are told apart by the row they were read from, so ranges are
    even.  A range begins inside one volume at most: that bounds the broadcast
    sums by the number of ranges.
    """
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("slot", "digest", "row").withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("volume").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("volume", "range").agg(F.sum("length").alias("bytes")).select("volume", "range", F.sum("bytes").over(before).alias("earlier")).where("earlier > 0")
    summed = _ends(dealt, "volume", "range", tie=("row",)).join(F.broadcast(earlier), ["volume", "range"], "left")
    return summed.withColumn("offset", F.col("end") - F.col("length") + F.coalesce("earlier", F.lit(0))).select(*INDEX)


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves up to at most two nodes: node, digest, length, volume and begin of its first record.

    A leaf of several records sums their digests, in four parts, so a slot with
    very many records is aggregated like any other; a node gathers at most
    FANOUT children.
    """
    checkpoint_folder(records.sparkSession)
    part = lambda i: F.sum(F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    summed = F.concat_ws(":", F.count("*").cast("string"), *(part(i) for i in range(4)))
    leaf = records.groupBy(F.col("slot").alias("node")).agg(
        F.sha2(F.when(F.count("*") == 1, F.min("digest")).otherwise(summed).cast("binary"), 256).alias("digest"),
        F.sum("length").alias("length"), F.min("volume").alias("volume"), F.min("offset").alias("begin"),
    )
    levels = [leaf.checkpoint()]
    while levels[-1].count() > 2 and len(levels) < 20:
        child = F.struct("node", "length", "digest")
        above = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"], c["length"], c["digest"])), " ").cast("binary"), 256).alias("digest"),
            F.sum("length").alias("length"), F.min("volume").alias("volume"), F.min_by("begin", "node").alias("begin"),
        )
        levels.append(above.checkpoint())
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("node", F.struct(*a.columns).alias("a")).join(b.select("node", F.struct(*b.columns).alias("b")), "node", "full")
    return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))


def audit(master: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """The leaves that differ: slot, status (changed, missing, extra), volume, offset, length and both digests.

    The master's place is given, and the replica's for records that only it has.
    """
    depth = min(len(master), len(replica)) - 1
    bad = _differing(master[depth], replica[depth])
    for level in range(depth - 1, -1, -1):
        # Both replicas' children are looked up by them: kept, lest every level doubles the plan.
        parents = bad.select(F.col("node").alias("parent")).checkpoint()
        children = [t[level].withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, "parent", "left_semi").drop("parent") for t in (master, replica)]
        bad = _differing(*children)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    of = lambda c: F.coalesce(f"a.{c}", f"b.{c}")
    return bad.select(
        F.col("node").alias("slot"), status.alias("status"), of("volume").alias("volume"), of("begin").alias("offset"), of("length").alias("length"),
        F.col("a.digest").alias("master_digest"), F.col("b.digest").alias("replica_digest"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages table with known damage: of every 101 records one has a character changed, of 211 one is
    missing, of 307 one has lost its second half, of 503 one stands under a new number as well."""
    n = F.coalesce(F.col("page_id"), F.lit(0))
    half = F.floor(F.length("html") / 2).cast("int")
    flip = F.concat(F.substring("html", F.lit(1), half), F.when(F.substring("html", half + 1, F.lit(1)) == "#", "$").otherwise("#"), F.substring("html", half + 2, F.length("html")))
    html = F.when(n % 101 == 7, flip).when(n % 307 == 5, F.substring("html", F.lit(1), half)).otherwise(F.col("html"))
    kept = pages.where(n % 211 != 3)
    again = pages.where(n % 503 == 11).select((F.col("page_id") + 1_000_000_000_000).alias("page_id"), "url", "html")
    return kept.select("page_id", "url", html.alias("html")).unionByName(again)


def audit_damaged(pages: DataFrame) -> DataFrame:
    """Audits the damaged replica of a pages table against the table."""
    pages = pages.select("page_id", "url", "html")
    return audit(tree(index(pages)), tree(index(damaged(pages))))


AUDIT_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CAST(floor(length(html) / 2) AS INT) AS half FROM pages),
r AS (SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN substr(html, 1, half) || CASE WHEN substr(html, half + 1, 1) = '#' THEN '$' ELSE '#' END || substr(html, half + 2)
                                WHEN page_id % 307 = 5 THEN substr(html, 1, half) ELSE html END AS html FROM p WHERE page_id % 211 <> 3
      UNION ALL SELECT page_id + 1000000000000, url, html FROM p WHERE page_id % 503 = 11),
t AS (SELECT 'a' AS which, page_id, url, html FROM p UNION ALL SELECT 'b', page_id, url, html FROM r),
w AS (SELECT which, page_id AS slot, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) ||
        'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM t),
x AS (SELECT which, slot, CAST(floor(slot / 1000) AS BIGINT) AS volume, CAST(strlen(record) AS BIGINT) AS length, sha256(sha256(record)) AS digest FROM w),
o AS (SELECT *, CAST(sum(length) OVER (PARTITION BY which, volume ORDER BY slot) - length AS BIGINT) AS "offset" FROM x),
j AS (SELECT coalesce(a.slot, b.slot) AS slot, CASE WHEN b.slot IS NULL THEN 'missing' WHEN a.slot IS NULL THEN 'extra' ELSE 'changed' END AS status,
        coalesce(a.volume, b.volume) AS volume, coalesce(a."offset", b."offset") AS "offset", coalesce(a.length, b.length) AS length, a.digest AS master_digest, b.digest AS replica_digest
      FROM (SELECT * FROM o WHERE which = 'a') a FULL JOIN (SELECT * FROM o WHERE which = 'b') b ON a.slot = b.slot)
SELECT * FROM j WHERE master_digest IS DISTINCT FROM replica_digest
"""
