"""Operator 8: document fingerprints of closed syncmers.

DataFrame functions only.  An s-mer is ``S`` consecutive code points, a k-mer
``K`` consecutive s-mers (K + S - 1 code points); it is a *closed syncmer* if, of
the hashes of its s-mers, the least stands first or last (Edgar, "Syncmers are
more sensitive than minimizers", 2021).  Whether a k-mer is chosen depends on
the k-mer alone, so equal passages choose equal k-mers wherever they stand, in
texts without white space too.  Texts are taken as UTF-32, where the code points
from a place on are a slice of bytes: no string is made per code point.

An *anchor* is a chosen k-mer's 32-bit hash and its position.  A text's
fingerprint holds the ``SKETCH`` anchors of least distinct hashes, each at its
first position, as sixteen hexadecimal digits: hash, position.  A text of under
``WHOLE`` code points with no syncmer has all its k-mers as anchors, a longer
one itself; a text shorter than a k-mer has its s-mers (under S code points:
itself); only the empty text has the empty string.

Likeness matches anchors by position: of the least ``SKETCH`` hashes of the
union, the share that both have at consistent places, which are equal places or
places whose difference another match has too (1 for two empty fingerprints).
It estimates the Jaccard similarity of the sets of syncmers that stand in
common passages, with a standard error up to about 0.06.

The edited text of a document shares its beginning: of that part the document's
own anchors are taken, and only the joint and the next text's part are read.

Cases: null is an empty text; equal texts have equal fingerprints; rows of equal
id stand in the order in which they are read; rows with a null id stand after
all others; an empty table has no rows.  Ids are numbers or dates; other kinds
are refused.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

K = 5
S = 4
SKETCH = 64
WHOLE = 256
ROWS_PER_BUCKET = 512
MAX_BUCKETS = 16_384
#: Edges of a block; an id is compared with the first of every block and those of one.
EDGES = 128
#: Anchors beyond which a sketch looks at the least hashes first.
MANY = 1024
PLACES = 1 << 31
TIES = 1 << 20


def _slice(code_points: Column, at: Column, n: int) -> Column:
    return F.substring(code_points, at * 4 + 1, F.lit(4 * n))


def _each(values: Column, held: Column, what, of=F.transform) -> Column:
    """``of(values, x -> what(held, x))`` with ``held`` read from the row once: a lambda that names a column copies its bytes for every element."""
    return F.transform(F.array(held), lambda one: of(values, lambda x: what(one, x)))[0]


def _anchor(hash64: Column, at: Column) -> Column:
    """A 32-bit hash and a place under 2^31 as one long, ordered by hash."""
    return hash64.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(PLACES) + at


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 31)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(PLACES - 1))


def with_anchors(df: DataFrame, text: str, to: str, base: Column | None = None, k: int = K, s: int = S) -> DataFrame:
    """Adds ``to``: the anchors of all closed syncmers of a text column, in order, and ``<to>_else``: those it has if there are none.

    ``base`` is the place of the text's first code point."""
    b, h, n, size = f"__{to}_b", f"__{to}_h", f"__{to}_n", k + s - 1
    at0 = F.lit(0) if base is None else base
    points = df.withColumn(b, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-32"))
    points = points.withColumns({n: (F.octet_length(b) / 4).cast("int"), f"{h}_0": at0.cast("long")})
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashed = points.withColumn(h, _each(upto(F.col(n) - s), F.col(b), lambda points, i: F.xxhash64(_slice(points, i, s))))
    closed = lambda hs, i: F.least(*(F.get(hs, i + j) for j in range(1, k - 1))) >= F.least(F.get(hs, i), F.get(hs, i + (k - 1)))
    chosen = hashed.withColumn(f"{h}_c", _each(upto(F.col(n) - size), F.col(h), closed, F.filter))
    kmer = lambda points, i: _anchor(F.xxhash64(_slice(points, i, size)), i + F.col(f"{h}_0"))
    anchored = chosen.withColumn(to, _each(F.col(f"{h}_c"), F.col(b), kmer))
    whole = F.array(_anchor(F.xxhash64(F.col(b)), F.lit(0)))
    short = F.transform(F.col(h), lambda x, i: _anchor(x, i))
    rest = F.when(F.size(to) > 0, F.array()).when(F.col(n) == 0, F.array()).when((F.col(n) < s) | (F.col(n) >= WHOLE), whole)
    rest = rest.when(F.col(n) < size, short).otherwise(_each(upto(F.col(n) - size), F.col(b), kmer))
    return anchored.withColumn(f"{to}_else", rest.cast("array<bigint>")).drop(b, h, n, f"{h}_c", f"{h}_0")


def _first_of_each(ordered: str) -> Column:
    """Of ascending anchors, the first of every hash."""
    return F.filter(F.col(ordered), lambda x, i: (i == 0) | (hash_of(F.get(F.col(ordered), i - 1)) != hash_of(x)))


def with_sketch(df: DataFrame, anchors: str, to: str, sketch: int = SKETCH) -> DataFrame:
    """Adds ``to``: of an array of anchors the ``sketch`` of least distinct hashes, each at its first place, ascending.

    Of many anchors those below a bound are sorted first; if they hold too few
    distinct hashes, the whole array is searched instead."""
    few, all_ = f"__{to}_few", F.col(anchors)
    bound = F.when(F.size(all_) > MANY, (F.least(F.lit(1.0), 8.0 * sketch / F.size(all_)) * float((1 << 63) - 1024)).cast("long")).otherwise(F.lit((1 << 63) - 1))
    staged = df.withColumn(f"{few}_b", bound)
    staged = staged.withColumn(few, F.sort_array(F.filter(all_, lambda x: x < F.col(f"{few}_b"))))
    staged = staged.withColumn(few, F.slice(_first_of_each(few), 1, sketch))
    hashes = F.slice(F.sort_array(F.array_distinct(F.transform(all_, hash_of))), 1, sketch)
    searched = F.transform(hashes, lambda h: F.array_min(F.filter(all_, lambda x: hash_of(x) == h)))
    return staged.withColumn(to, F.when((F.size(few) >= sketch) | (F.size(all_) <= MANY), F.col(few)).otherwise(searched)).drop(few, f"{few}_b")


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: the sketch of a text column as an ascending array of anchors."""
    some = with_anchors(df, text, f"__{to}_a").withColumn(f"__{to}_s", F.concat(f"__{to}_a", f"__{to}_a_else"))
    return with_sketch(some, f"__{to}_s", to).drop(f"__{to}_a", f"__{to}_a_else", f"__{to}_s")


def as_text(sketch: Column) -> Column:
    digits = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    return F.array_join(F.transform(sketch, lambda x: F.concat(digits(hash_of(x)), digits(place_of(x)))), "")


def with_likeness(df: DataFrame, a: str, b: str, to: str, sketch: int = SKETCH) -> DataFrame:
    """Adds ``to``: the likeness of two sketches by matched anchors at consistent places."""
    union, of_b, shift = f"__{to}_u", f"__{to}_b", f"__{to}_o"
    hashes = lambda c: F.transform(c, hash_of)
    staged = df.withColumn(union, F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, sketch))
    staged = staged.withColumns({f"{union}_last": F.get(union, F.size(union) - 1), of_b: F.map_from_arrays(hashes(b), F.transform(b, place_of))})
    shared = F.filter(F.col(a), lambda x: (hash_of(x) <= F.col(f"{union}_last")) & F.map_contains_key(F.col(of_b), hash_of(x)))
    staged = staged.withColumn(shift, F.transform(shared, lambda x: place_of(x) - F.element_at(F.col(of_b), hash_of(x))))
    consistent = F.filter(F.col(shift), lambda d: (d == 0) | (F.size(F.filter(F.col(shift), lambda e: e == d)) > 1))
    return staged.withColumn(to, F.when(F.size(union) == 0, 1.0).otherwise(F.size(consistent) / F.size(union)).cast("double")).drop(union, f"{union}_last", of_b, shift)


def anchors(df: DataFrame, text: str = "text") -> DataFrame:
    """All other columns, and a row per closed syncmer: its position (code points before it) and hash."""
    rest = [c for c in df.columns if c != text]
    found = with_anchors(df, text, "__anchors").select(*rest, F.explode("__anchors").alias("__anchor"))
    return found.select(*rest, place_of(F.col("__anchor")).alias("position"), hash_of(F.col("__anchor")).alias("hash"))


def _bucket(df: DataFrame, doc_id: str) -> Column:
    """A number that grows with (id, ``__tie``), so that about ``ROWS_PER_BUCKET`` rows have one, whatever the ids are.

    Edges are quantiles of the ids.  An id that several edges share is cut again
    by its ties, and so are the rows without an id, which come first."""
    if not isinstance(df.schema[doc_id].dataType, NumericType | DateType | TimestampType):
        raise TypeError(f"ids of type {df.schema[doc_id].dataType.simpleString()} have no quantiles")
    n, none = df.agg(F.count("*"), F.count_if(F.col(doc_id).isNull())).first()
    per = max(ROWS_PER_BUCKET, -(-n // MAX_BUCKETS))
    cuts = max(1, (n - none) // per)
    share = [i / cuts for i in range(1, cuts)]
    edges = (df.agg(F.percentile_approx(doc_id, share, 20 * MAX_BUCKETS)).first()[0] if share else None) or []
    times = Counter(edges)
    tie = F.col("__tie") % TIES
    without = -MAX_BUCKETS - 1 + F.floor(tie * (none // per + 1) / TIES)
    if not times:
        return F.when(F.col(doc_id).isNull(), without).otherwise(F.lit(0))
    values = list(times)
    blocks = [values[i : i + EDGES] for i in range(0, len(values), EDGES)]
    kind = df.schema[doc_id].dataType
    listed = lambda xs: F.array(*(F.lit(x).cast(kind) for x in xs))
    own = lambda edge_list: F.size(F.filter(edge_list, lambda e: e <= F.col(doc_id)))
    block = F.greatest(own(listed([b[0] for b in blocks])) - 1, F.lit(0))
    inside = F.get(F.array(*map(listed, blocks)), block)
    below = block * EDGES + own(inside)
    here = F.get(F.filter(inside, lambda e: e == F.col(doc_id)), F.lit(0))
    heavy = F.create_map(*(x for e, m in times.items() if m > 1 for x in (F.lit(e).cast(kind), F.lit(m)))) if max(times.values()) > 1 else None
    part = F.lit(MAX_BUCKETS) if heavy is None else F.when(here.isNotNull(), F.floor(tie * (F.coalesce(F.element_at(heavy, here), F.lit(1)) + 1) / TIES)).otherwise(F.lit(MAX_BUCKETS))
    return F.when(F.col(doc_id).isNull(), without).otherwise(below.cast("long") * (MAX_BUCKETS + 1) + part).cast("long")


def with_next(df: DataFrame, doc_id: str, carry: list[str]) -> DataFrame:
    """Adds next_<c> for each of ``carry``: its value in the next row by descending id, after the last the first.

    Rows are dealt into buckets between quantiles of the ids.  The first row of
    every bucket also goes, marked, to the end of the bucket before it, so
    neighbours meet in one shuffle and no task sees more than some buckets.
    """
    if not carry or any(f"next_{c}" in df.columns for c in carry):
        raise ValueError("the new columns' names are taken")
    row = F.monotonically_increasing_id()
    # The last digits of the tie are spread evenly; the row's number makes it unique.
    tied = df.withColumn("__row", row).withColumn("__tie", F.pmod(F.xxhash64("__row"), F.lit(TIES)))
    placed = tied.withColumn("__bucket", _bucket(tied, doc_id))
    # At most a few rows per quantile, so one task can order them and all can have them.
    firsts = placed.groupBy("__bucket").agg(F.max(F.struct(doc_id, "__tie", "__row")).alias("__first"))
    order = Window.orderBy(F.col("__bucket").desc())
    before = F.coalesce(F.lag("__bucket").over(order), F.first("__bucket").over(Window.orderBy(F.col("__bucket").asc())))
    firsts = firsts.select(F.col("__bucket").alias("__own"), F.col("__first.__row").alias("__first"), before.alias("__before"))
    joined = placed.join(F.broadcast(firsts), F.col("__bucket") == F.col("__own"), "left")
    before = F.when(F.col("__first") == F.col("__row"), F.col("__before"))
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("copy")), F.struct(before.alias("b"), F.lit(1).alias("copy")))
    marked = joined.withColumn("__at", F.explode(F.filter(places, lambda x: x["b"].isNotNull()))).drop("__own", "__first", "__before")
    ordered = Window.partitionBy("__at.b").orderBy(F.col("__at.copy"), F.col(doc_id).desc_nulls_last(), F.col("__tie").desc(), F.col("__row").desc())
    led = marked.select("*", F.lead(F.struct(*carry)).over(ordered).alias("__next")).where("__at.copy = 0")
    return led.select(*df.columns, *(F.col("__next")[c].alias(f"next_{c}") for c in carry))


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row.

    The edited text's last third (rounded down) is replaced by as much of the
    next document's beginning.
    """
    reach = K + S - 2  # code points before the joint that a k-mer over it can start at
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    third = F.floor(F.char_length("body") / 3).cast("int")
    rows = with_anchors(rows, "body", "a").withColumn("kept", F.char_length("body") - third)
    rows = rows.withColumns({"whole": F.concat("a", "a_else"), "begin": F.filter(F.col("a"), lambda x: place_of(x) < F.col("kept") - reach)})
    rows = with_sketch(with_sketch(rows, "whole", "fp"), "begin", "begun").select("doc_id", "body", "kept", "fp", "begun")
    rows = with_next(rows, "doc_id", ["body", "fp"])
    rows = rows.withColumn("edited", F.concat(F.substring("body", F.lit(1), F.col("kept")), F.substring("next_body", F.lit(1), third)))
    rows = rows.select("doc_id", F.char_length("body").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited", "kept", "fp", "begun", "next_fp")
    # Short texts are read again as a whole, longer ones from before the joint.
    base = F.when(F.char_length("edited") < WHOLE, 0).otherwise(F.col("kept") - reach)
    rows = rows.withColumn("base", base).withColumn("read", F.substring(F.col("edited"), F.col("base") + 1, F.char_length("edited")))
    rows = with_anchors(rows, "read", "e", F.col("base"))
    found = F.concat(F.when(F.col("base") > 0, F.col("begun")).otherwise(F.array().cast("array<bigint>")), F.col("e"))
    none = F.when(F.char_length("edited") < WHOLE, F.col("e_else")).otherwise(F.array(_anchor(F.xxhash64(F.encode("edited", "UTF-32")), F.lit(0))))
    rows = rows.withColumn("found", found)
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(none)).drop("edited", "read", "e", "e_else")
    rows = with_sketch(rows, "found", "edited_fp")
    rows = with_likeness(with_likeness(rows, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
