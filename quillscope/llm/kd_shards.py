"""Operator 10: shards as the leaves of a k-d tree over document metadata.

DataFrame functions only.  A node that is to become L shards is split at the
weighted quantile floor(L/2) / L of its bytes, along its widest dimension (the
one whose range in the node is the largest share of its range in the table).
Dimensions are the size, the language and the source.  Copies of a text take
the language and source of the least of them, and rows with equal coordinates
are ordered by a hash of their text, then of their id, so a group of copies
stays in one shard unless a cut falls in it and it outweighs the tolerance.

Quantiles are found by distributed histograms: the ordering along a dimension
is one 60-bit number, and each round sums the bytes per next ten bits inside
the interval that holds the quantile, for all nodes of a level at once.  At
most 1024 sums per node reach the driver; rounds end when the interval weighs
less than the tolerance.

Cases: a null text is empty, null language or source is a value of its own;
equal ids or repeated rows keep a row each; an empty table has no shards; if
the rows are fewer than the shards, some shards are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder

SHARDS = 24
ROW_BYTES = 8
DIMENSIONS = ("by_size", "by_lang", "by_source")
BITS, ROUND_BITS = 60, 10
COORDINATE_BITS = 20  # then 20 of the text's hash, then 20 of the row's
TOLERANCE = 0.002  # of a shard's bytes
SLOT_BUCKET_ROWS = 50_000
MAX_SLOT_BUCKETS = 4096  # a shard's; their row counts are broadcast
HOT_PARTS = 1000  # a text with more than this part of the rows is a hot one


@dataclass
class Node:
    """A tree node: the shards it becomes, and the split while it is searched."""

    first: int
    shards: int
    dimension: str = ""
    low: int = 0
    shift: int = BITS
    before: int = 0  # bytes below the interval
    total: int = 0
    done: bool = False

    @property
    def half(self) -> int:
        return self.shards // 2

    @property
    def target(self) -> float:
        return self.total * self.half / self.shards


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """A narrow table: id, size, crc and the orderings along each dimension."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    )
    merged = _least_names(narrow)
    top = lambda h: F.shiftrightunsigned(h, 64 - COORDINATE_BITS)
    # Sizes on a logarithmic scale (a twentieth of a percent apart), names by their first bytes.
    name = lambda c: F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 5), 5, "0"), 16, 10).cast("long")
    log_size = F.least(F.lit((1 << COORDINATE_BITS) - 1), F.floor(F.log(F.col("size").cast("double")) * 20_000)).cast("long")
    source_code = F.shiftrightunsigned(F.xxhash64("source"), 64 - COORDINATE_BITS)
    tie = F.shiftleft(top(F.col("text_hash")), 20) + top(F.xxhash64("doc_id", "text_hash"))
    key = lambda c: F.shiftleft(c, 40) + tie
    return merged.select("doc_id", "size", "text_crc32", key(log_size).alias("by_size"), key(name(F.col("lang"))).alias("by_lang"), key(source_code).alias("by_source"))


def _least_names(narrow: DataFrame) -> DataFrame:
    """Rows with the least language and source of their text's copies.

    Of n rows, fewer than HOT_PARTS texts have more than n / HOT_PARTS copies.
    Their names are broadcast, and their rows go through the shuffled join of
    the others under keys of their own that meet nothing, so no text gathers
    its copies in one task.
    """
    copies = narrow.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("lang").alias("of_lang"), F.min("source").alias("of_source")).where("n > 1").checkpoint()
    is_hot = F.col("n") * HOT_PARTS > narrow.count()
    hot = copies.where(is_hot).select("text_hash", F.col("of_lang").alias("hot_lang"), F.col("of_source").alias("hot_source"))
    cold = copies.where(~is_hot).select(F.col("text_hash").alias("key"), F.lit(False).alias("apart"), "of_lang", "of_source")
    rows = narrow.join(F.broadcast(hot), "text_hash", "left").withColumn("apart", F.col("hot_lang").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("apart"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("text_hash")))
    return rows.join(cold, ["key", "apart"], "left").select(
        "doc_id", "size", "text_crc32", "text_hash", F.coalesce("hot_lang", "of_lang", "lang").alias("lang"), F.coalesce("hot_source", "of_source", "source").alias("source")
    )


def _along(rows: DataFrame, nodes: dict[int, Node], **values: str) -> DataFrame:
    """Rows with the position along their node's dimension and, by name, fields of the node; others have nulls.

    The joined table has a row per node, at most as many as there are shards.
    """
    fields = lambda k, n: F.struct(F.lit(k).alias("at_node"), F.lit(DIMENSIONS.index(n.dimension)).alias("dimension"), *(F.lit(getattr(n, f)).cast("long").alias(v) for v, f in values.items()))
    table = rows.sparkSession.range(1).select(F.inline(F.array(*(fields(k, n) for k, n in nodes.items()))))
    joined = rows.join(F.broadcast(table), F.col("node") == F.col("at_node"), "left").drop("at_node")
    position = F.when(F.col("dimension") == 0, F.col(DIMENSIONS[0])).when(F.col("dimension") == 1, F.col(DIMENSIONS[1])).when(F.col("dimension") == 2, F.col(DIMENSIONS[2]))
    return joined.withColumn("position", position).drop("dimension")


def _choose_dimensions(rows: DataFrame, nodes: dict[int, Node], ranges: dict[str, int]) -> None:
    spread = rows.groupBy("node").agg(F.sum("size").alias("total"), *(f(F.shiftright(d, 40)).alias(f"{d}_{n}") for d in DIMENSIONS for f, n in ((F.min, "min"), (F.max, "max"))))
    for r in spread.collect():
        if r["node"] in nodes:
            node = nodes[r["node"]]
            node.total = r["total"]
            node.dimension = max(DIMENSIONS, key=lambda d: (r[f"{d}_max"] - r[f"{d}_min"]) / max(1, ranges[d]))


def _search(rows: DataFrame, nodes: dict[int, Node], tolerance: float) -> None:
    """Narrows every node's interval until the quantile is known to within the tolerance."""
    while todo := {k: n for k, n in nodes.items() if not n.done}:
        shift = next(iter(todo.values())).shift - ROUND_BITS  # all of a level narrow together
        off = F.col("position") - F.col("low")
        inside = _along(rows, todo, low="low").select("node", "size", F.shiftright(off, shift).alias("bin"), off.alias("off"))
        inside = inside.where((F.col("off") >= 0) & (F.col("off") < (1 << (shift + ROUND_BITS))))
        sums: dict[int, list[tuple[int, int]]] = {k: [] for k in todo}
        for r in inside.groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect():
            sums[r["node"]].append((r["bin"], r["bytes"]))
        for k, node in todo.items():
            below = node.before
            for at, weight in sorted(sums[k]):
                if below + weight >= node.target:
                    break
                below += weight
            else:
                at, weight = 1 << ROUND_BITS, 0
            node.shift = shift
            if weight <= tolerance or shift == 0:
                # The cut goes to the nearer edge of a bin that is light enough, or cannot be divided.
                after = node.target - below > below + weight - node.target
                node.low += (at + after) << shift
                node.done = True
            else:
                node.low, node.before = node.low + (at << shift), below


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) of every row."""
    checkpoint_folder(docs.sparkSession)
    rows = _rows(docs, doc_id, text, lang, source).withColumn("node", F.lit(0)).checkpoint()
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(F.max(F.shiftright(d, 40)).alias(f"{d}_max") for d in DIMENSIONS), *(F.min(F.shiftright(d, 40)).alias(f"{d}_min") for d in DIMENSIONS)).first()
    ranges = {d: (whole[f"{d}_max"] or 0) - (whole[f"{d}_min"] or 0) for d in DIMENSIONS}
    tolerance = TOLERANCE * (whole["bytes"] or 0) / shards
    level = {0: Node(0, shards)}
    while whole["n"] and (nodes := {k: n for k, n in level.items() if n.shards > 1}):
        _choose_dimensions(rows, nodes, ranges)
        nodes = {k: n for k, n in nodes.items() if n.dimension}
        _search(rows, nodes, tolerance)
        # A node's number is its first shard.
        step = F.when(F.col("position") >= F.col("low"), F.col("half")).otherwise(0)
        rows = _along(rows, nodes, low="low", half="half").withColumn("node", (F.col("node") + F.coalesce(step, F.lit(0))).cast("int")).drop("position", "low", "half").checkpoint()
        level = {c.first: c for n in level.values() for c in ([Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)] if n.shards > 1 else [n])}
    return _with_slots(rows.withColumnRenamed("node", "shard"), min(MAX_SLOT_BUCKETS, -(-(whole["n"] or 0) // (shards * SLOT_BUCKET_ROWS))))


def _with_slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Numbers the rows of each shard: inside hash buckets, after the rows of the buckets before."""
    held = rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(8, buckets))).alias("bucket"))
    sizes = held.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return held.withColumn("__k", inside).join(F.broadcast(offsets), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("__k")).cast("long").alias("slot"))
