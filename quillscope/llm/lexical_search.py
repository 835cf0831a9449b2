"""Operator 11: ranked lexical search by Block-Max MaxScore.

The index is partitioned by documents: where texts are read, every run of about
``SHARD_BYTES`` becomes a shard with its own inverted lists, without a shuffle.
A list is cut into blocks of ``BLOCK`` postings (gap and term frequency as
variable-length bytes); each block stores its last document and the pairs
(frequency, length) that no other pair of the block beats, so that block maxima
are exact for whatever collection statistics hold at search time.  The index is
a table, one row per list and one per shard, which searches read again.

A search joins the lists with the query terms and groups them by shard and
block of queries.  In a shard, the lists of an item are taken by their bounds
over the whole list.  *Essential* lists, without which a document could still
reach the threshold (the score of the k-th best so far), are read whole.  Of
the documents they hold, those whose score so far plus the maxima of the blocks
that may hold them in the other lists stays below the threshold are rejected
before any such block is decompressed; for the others the blocks are read, from
the highest bound on, and the threshold rises.  Ties with the threshold are
never rejected.  Each shard returns its k best, which one window merges; Spark
cuts its input to k a task before the shuffle.

Scores are integers (64 bits; products that could pass them are taken with
exact integers).

Cases: null texts and texts without a term have no rank, and count in no
statistic; an item without terms, or whose terms no document holds, has no
rows; items with equal id and text are one item, items with equal id and
different texts rank apart; equal scores rank by id, null ids last; repeated
documents rank each; an empty table of either kind has no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from quillscope.llm.components import checkpoint_folder, hint_small
from quillscope.llm.pieces import text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z become a-z, other ASCII that is neither letter nor digit a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD_BYTES = 12 << 20
BLOCK = 128
#: Queries of a block: each (shard, block) is a task's group.
QUERIES = 256
#: Length normalisation in percent, saturation and scale of the score.
LENGTH_PERCENT, SATURATION, SCALE = 75, 8, 1_000_000_000


# Lists: postings as bytes

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a value below 128; and the end of each value."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = size > k
        more = np.where(size[some] > k + 1, 128, 0)
        out[(ends - size)[some] + k] = (values[some] >> 7 * k) & 127 | more
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        some = starts + k <= ends
        values[some] |= (raw[starts[some] + k] & 127) << 7 * k
    return values


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class _Shard:
    """Postings of the documents of one shard, as they come."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(counter().__next__)
        self.terms, self.tf, self.sizes, self.lengths, self.ids, self.bytes = array("i"), array("i"), array("i"), array("q"), [], 0

    def add(self, doc_id, text: bytes) -> None:
        words = text.translate(FOLD).split()
        if words:
            found = Counter(words)
            self.terms.extend(map(self.vocabulary.__getitem__, found))
            self.tf.extend(found.values())
            self.sizes.append(len(found))
            self.lengths.append(len(words))
            self.ids.append(doc_id)
        self.bytes += len(text)

    def rows(self, shard: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        yield pa.record_batch({
            "shard": pa.array([shard], pa.int64()), "term": none(1, pa.string()), "docs": pa.array([len(lengths)], pa.int32()), "total": pa.array([int(lengths.sum())], pa.int64()),
            "lasts": none(1, pa.binary()), "ends": none(1, pa.binary()), "best": none(1, pa.binary()), "postings": pa.array([lengths.tobytes()], pa.binary()), "ids": pa.array([self.ids], pa.list_(id_type)),
        })
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), np.array(self.sizes, np.int32))
        order = np.argsort(np.frombuffer(self.terms, np.int32), kind="stable")
        term, doc, tf = np.frombuffer(self.terms, np.int32)[order], doc[order], np.frombuffer(self.tf, np.int32)[order]
        n = len(self.vocabulary)
        df = np.bincount(term, minlength=n)
        first = np.cumsum(df) - df
        place = np.arange(len(term)) - first[term]
        blocks = -(-df // BLOCK)
        block = (np.cumsum(blocks) - blocks)[term] + place // BLOCK
        del order, place
        gap = np.diff(doc, prepend=-1)
        gap[first] = doc[first] + 1
        data, ends = pack(np.stack([gap, tf], axis=1).ravel())
        ends = ends[1::2]
        last = np.flatnonzero(np.diff(block, append=block[-1] + 1))  # the last posting of every block
        list_end = ends[first + df - 1]
        block_end = ends[last] - np.repeat(list_end - np.diff(list_end, prepend=0), blocks)
        # pairs that no other beats: by falling frequency, each length below all before
        falling = np.lexsort((lengths[doc], -tf, block))
        length = lengths[doc][falling] - block[falling] * (int(lengths.max()) + 1)
        before = np.minimum.accumulate(length)
        good = falling[np.concatenate([[True], length[1:] < before[:-1]])]
        del falling, length, before
        best = np.stack([(block[good] - (np.cumsum(blocks) - blocks)[term[good]]), tf[good], lengths[doc[good]]], axis=1).astype(np.int64)
        several = lambda values, number: _slices(np.ascontiguousarray(values).view(np.uint8).ravel(), np.cumsum(number) * values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1))
        whole = pa.record_batch({
            "shard": pa.array(np.full(n, shard, np.int64)), "term": pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), "docs": pa.array(df.astype(np.int32)), "total": none(n, pa.int64()),
            "lasts": several(doc[last].astype(np.int32), blocks), "ends": several(block_end.astype(np.int32), blocks), "best": several(best.astype(np.int32), np.bincount(term[good], minlength=n)),
            "postings": _slices(data, list_end), "ids": none(n, pa.list_(id_type)),
        })
        for at in range(0, n, 20_000):
            yield whole.slice(at, 20_000)


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of all documents to a new table at ``path`` and returns it.

    A row with a term is that term's list in a shard; a row without one holds
    the shard's number of documents and of terms, its ids and lengths.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, number = TaskContext.get().partitionId(), _Shard(), 0
        for batch in batches:
            id_type, ids = batch.schema.field("id").type, iter(batch["id"].to_pylist())
            for texts in text_slices(batch["text"]):
                for body in texts:
                    shard.add(next(ids), body)
                    if shard.bytes >= shard_bytes or len(shard.terms) > 1 << 25:
                        if shard.ids:
                            yield from shard.rows((part << 32) + number, id_type)
                        shard, number = _Shard(), number + 1
        if shard.ids:
            yield from shard.rows((part << 32) + number, id_type)

    schema = StructType().add("shard", LongType()).add("term", StringType()).add("docs", IntegerType()).add("total", LongType())
    schema = schema.add("lasts", BinaryType()).add("ends", BinaryType()).add("best", BinaryType()).add("postings", BinaryType()).add("ids", ArrayType(rows.schema["id"].dataType))
    rows.mapInArrow(build, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


# Search in a shard

class _Statistics:
    """What the tf part of a score needs: N documents with L terms."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total = docs, total

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and LENGTH_PERCENT * int(lengths.max()) * self.docs >= 1 << 63:
            lengths = lengths.astype(object)
        return (100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths * self.docs // self.total).astype(np.int64)

    def part(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return SCALE * tf // (1000 * tf + SATURATION * norm)


class _List:
    """A term's list in a shard; blocks are decompressed when first needed."""

    def __init__(self, row, statistics: _Statistics, norm: np.ndarray):
        self.statistics, self.norm, self.weight = statistics, norm, int(row.weight)
        self.lasts, self.ends, self.postings = np.frombuffer(row.lasts, np.int32), np.frombuffer(row.ends, np.int32), row.postings
        best = np.frombuffer(row.best, np.int32).astype(np.int64).reshape(-1, 3)
        reach = self.weight * statistics.part(best[:, 1], statistics.norm(best[:, 2]))
        starts = np.searchsorted(best[:, 0], np.arange(len(self.lasts)))
        self.maxima = np.append(np.maximum.reduceat(reach, starts), 0)  # and 0 beyond the last block
        self.bound = int(self.maxima.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def _open(self, data: bytes, after: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = unpack(data).reshape(-1, 2)
        docs = after + np.cumsum(pairs[:, 0])
        return docs, self.weight * self.statistics.part(pairs[:, 1], self.norm[docs])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self._open(self.postings, -1)
        return self.whole

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is not None:
            return self.whole[0][i * BLOCK : (i + 1) * BLOCK], self.whole[1][i * BLOCK : (i + 1) * BLOCK]
        if i not in self.read:
            self.read[i] = self._open(self.postings[self.ends[i - 1] if i else 0 : self.ends[i]], int(self.lasts[i - 1]) if i else -1)
        return self.read[i]


def best_of_shard(lists: list[tuple[_List, int]], documents: int, order: np.ndarray, k: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents for an item's lists (each with its number of repeats).

    ``order``: a document's rank by id, for ties.  ``seen`` counts rejected
    candidates and blocks left compressed, for tests.
    """
    lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
    bounds = [x.bound * times for x, times in lists]
    rest = [sum(bounds[i:]) for i in range(len(bounds) + 1)]
    score, least, i = np.zeros(documents, np.int64), 1, 0

    def kth(scores: np.ndarray) -> int:
        return max(least, int(np.partition(scores, -k)[-k])) if len(scores) >= k else least

    while i < len(lists) and rest[i] >= least:  # a document of no list so far could still be among the best
        docs, parts = lists[i][0].all()
        score[docs] += parts * lists[i][1]
        least, i = kth(score), i + 1
    docs = np.flatnonzero(score)
    docs = docs[score[docs] + rest[i] >= least]
    others = lists[i:]
    if others and len(docs):
        where = [np.searchsorted(x.lasts, docs) for x, _ in others]
        reach = np.cumsum(np.array([x.maxima[w] * times for (x, times), w in zip(others, where, strict=True)])[::-1], axis=0)[::-1]
        alive = np.ones(len(docs), bool)
        for j, (x, times) in enumerate(others):
            alive &= score[docs] + reach[j] >= least
            needed = np.unique(where[j][alive & (where[j] < len(x.lasts))])
            for b in needed.tolist():
                inside, parts = x.block(b)
                mine = np.flatnonzero(alive & (where[j] == b))
                at = np.minimum(np.searchsorted(inside, docs[mine]), len(inside) - 1)
                score[docs[mine]] += np.where(inside[at] == docs[mine], parts[at] * times, 0)
            if seen is not None:
                seen["left"] += len(x.lasts) - len(needed)
                seen["rejected"] += int((~alive).sum())
            least = kth(score[docs[alive]])
        docs = docs[alive]
    docs = docs[score[docs] >= least]
    docs = docs[np.lexsort((order[docs], -score[docs]))[:k]]
    return docs, score[docs]


def _search(statistics: _Statistics, k: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame["term"].isna()
        own = frame[head].iloc[0]
        norm = statistics.norm(np.frombuffer(own["postings"], np.int64))
        ids = list(own["ids"])
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=lambda i: (ids[i] is None or ids[i] != ids[i], ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
        lists_of: dict[int, list[tuple[_List, int]]] = defaultdict(list)
        for row in frame[~head].itertuples(index=False):
            found = _List(row, statistics, norm)
            for q, times in zip(row.queries, row.times, strict=True):
                lists_of[int(q)].append((found, int(times)))
        out = [(q, ids[d], s) for q, lists in lists_of.items() for d, s in zip(*(x.tolist() for x in best_of_shard(lists, len(ids), order, k)), strict=True)]
        return pd.DataFrame({"q": pd.array([x[0] for x in out], "Int64"), "doc_id": pd.Series([x[1] for x in out], dtype=object), "score": pd.array([x[2] for x in out], "Int64")})

    return search


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    spark: SparkSession = index.sparkSession
    checkpoint_folder(spark)
    id_type = index.schema["ids"].dataType.elementType
    known = index.where("term is null").agg(F.sum("docs").cast("long").alias("docs"), F.sum("total").alias("total"), F.count("*").alias("shards")).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    asked = asked.withColumn("q", F.monotonically_increasing_id()).checkpoint()
    blocks = max(1, -(-asked.count() // QUERIES))
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    terms = asked.select("q", words.alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")).checkpoint()
    held = index.where("term is not null")
    df = held.select("term", "docs").join(hint_small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("docs").cast("long").alias("df"))
    docs = known["docs"] or 0
    weight = F.floor(1000 * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    used = terms.join(df.withColumn("weight", weight), "term").groupBy(block.alias("block"), "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("q", "times")).alias("uses"))
    used = used.select("block", "term", "weight", F.col("uses.q").alias("queries"), F.col("uses.times").alias("times")).checkpoint()
    columns = ["shard", "block", "term", "lasts", "ends", "best", "postings", "ids", "weight", "queries", "times"]
    lists = held.join(hint_small(used), "term").select(columns)
    heads = index.where("term is null").withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "weight": F.lit(None).cast("long"), "queries": F.lit(None).cast("array<long>"), "times": F.lit(None).cast("array<long>")})
    schema = StructType().add("q", LongType()).add("doc_id", id_type).add("score", LongType())
    found = lists.unionByName(heads.select(columns)).groupBy("shard", "block").applyInPandas(_search(_Statistics(docs, known["total"] or 0), k), schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
u AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) SEMI JOIN u USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, s GROUP BY term),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM u JOIN t USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY q, rid)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x JOIN m USING (rid) JOIN i USING (q) WHERE score > 0) WHERE rank <= 10
"""
