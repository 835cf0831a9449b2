"""Chunks of files that are read in pieces: a file larger than a task should hold is cut over tasks.

Spark's text reader deals a file's byte ranges (blocks) to tasks.  The greedy
fill carries one number from line to line, the size of the open chunk.  A first
pass sums up what each block does to that number: the first chunk that starts
in a block starts within its first ``target_chars``, and chains of starts soon
meet, so the map has some dozen entries.  Maps are composed along each file,
one short row per block; a second pass cuts every block from the size that is
open at its start.  Chunks within a block are whole there; only those that
cross into another block, and the last two of a file (the very last may be too
short to stand alone), are put together by a shuffle.  No task sees more of a
file than a block's line lengths and a chunk.

The chunks are those of :func:`functions.chunking.with_chunks` on the whole
text.  A file that is no valid UTF-8 is one row without a chunk and with an
error.  An empty file has no row.  A file of nothing but white space is one
chunk, its whole text, as there.  Files must not be compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import constants as K
from ..functions.chunking import lines_keepends
from ..functions.regex import PY_NON_WS_CLASS
from ..session import ensure_checkpoint_dir

#: Entries are broadcast up to this many blocks (about 200 bytes each), else joined by a shuffle.
MAX_BROADCAST_BLOCKS = 65_536

_EFFECT = "struct<ends: array<long>, carries: array<long>, lasts: array<long>, befores: array<long>>"
_MAP = f"path string, block long, file_size long, lines long, chars long, bytes long, bad long, filled long, effect {_EFFECT}, effect_unended {_EFFECT}"
_ENTRY = ("path string, block long, carry long, open_block long, open_start long, lines long, unended boolean, ending boolean, blank boolean, "
          "last_block long, last_start long, before_block long, before_start long")
_BLANK = -1  # the block of the one chunk of a file of white space
_CUT = "path string, chunk_block long, chunk_start long, block long, kind string, number int, text string"
_WHOLE, _PART, _TAIL, _COUNT = "whole", "part", "tail", "count"  # kinds of rows of a cut


def read_lines(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, block, file_size, bad, at, line, chars, bytes, filled): lines with their terminators; ``at`` orders the lines of a block.

    The last line of a file has a line feed even where the file has none."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "path"), ("file_block_start", "block"), ("file_size", "file_size"))]
    rows = reader.text(paths).select(*meta, F.concat("value", F.lit("\n")).alias("value"), (~F.is_valid_utf8("value")).cast("long").alias("bad"))
    lines = rows.select("path", "block", "file_size", "bad", F.explode(lines_keepends(F.col("value"))).alias("line"))
    return lines.select("path", "block", "file_size", "bad", F.monotonically_increasing_id().alias("at"), "line", F.length("line").cast("long").alias("chars"), F.octet_length("line").cast("long").alias("bytes"),
        F.col("line").rlike(PY_NON_WS_CLASS).cast("long").alias("filled"))


def starts_from(lengths: np.ndarray, first: int, target: int) -> list[int]:
    """The lines that start a chunk, if line ``first`` does: the next is the first whose end lies over ``target`` beyond a start."""
    ends = np.cumsum(lengths)
    found = []
    while first < len(lengths):
        found.append(first)
        first = max(first + 1, int(np.searchsorted(ends, ends[first] - lengths[first] + target, "right")))
    return found


def block_map(lengths: np.ndarray, target: int) -> dict[str, list[int]]:
    """For every line a chunk can be the block's first to start at: the line's end, the size open at the block's end, the last start and the one before it (-1: none)."""
    ends = np.cumsum(lengths)
    entries = min(len(lengths), int(np.searchsorted(ends, target, "right")) + 1)
    seen: dict[int, tuple[int, int]] = {}
    for entry in range(entries):
        chain, line = [], entry
        while line < len(lengths) and line not in seen:
            chain.append(line)
            line = max(line + 1, int(np.searchsorted(ends, ends[line] - lengths[line] + target, "right")))
        last, before = seen[line] if line < len(lengths) else (chain.pop(), -1)
        if line >= len(lengths):
            seen[last] = (last, -1)
        for start in reversed(chain):
            before = start if before < 0 else before
            seen[start] = (last, before)
    lasts = [seen[e][0] for e in range(entries)]
    carries = [int(ends[-1] - ends[k] + lengths[k]) for k in lasts]
    return {"ends": ends[:entries].tolist(), "carries": carries, "lasts": lasts, "befores": [seen[e][1] for e in range(entries)]}


def without_last_feed(lengths: np.ndarray) -> np.ndarray:
    """The lengths of a file's last lines, if the file does not end in the line feed that was added; a line of that feed alone is none."""
    return lengths[:-1] if lengths[-1] == 1 else np.append(lengths[:-1], lengths[-1] - 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch's runs of rows of one block."""
    path, block = batch.column("path"), batch.column("block").to_numpy(zero_copy_only=False)
    new = np.flatnonzero(block[1:] != block[:-1]) + 1
    names = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    bounds = [0, *sorted({*new.tolist(), *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()}), len(batch)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield (path[a].as_py(), int(block[a])), batch.slice(a, b - a)


def _maps(target: int):
    schema = to_arrow_schema(T.StructType.fromDDL(_MAP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, held):
            lengths = np.concatenate([h[0] for h in held])
            numbers = (held[0][1], len(lengths), lengths.sum(), *(sum(h[k] for h in held) for k in (2, 3, 4)))
            values = (*key, *map(int, numbers), block_map(lengths, target), block_map(without_last_feed(lengths), target))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema)

        key, held = None, []
        for batch in batches:
            for found, rows in _runs(batch):
                if found != key and held:
                    yield row(key, held)
                    held = []
                key = found
                chars, *sums = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("chars", "bytes", "bad", "filled"))
                held.append((chars, rows.column("file_size")[0].as_py(), *(x.sum() for x in sums)))
        if held:
            yield row(key, held)

    return run


def _compose(target: int):
    """Along one file: the size open at the start of every block, where the open chunk started, and the file's last two starts."""
    def run(blocks):
        import pandas as pd

        blocks = blocks.sort_values("block")
        # A line feed more than the file has: its last line ends without one.  Three bytes less: its byte-order mark.
        unended = (int(blocks["file_size"].iloc[0]) - int(blocks["bytes"].sum())) in (-1, 2)
        blank = not blocks["filled"].any()
        carry, opened, before, out = -1, (-1, -1), (-1, -1), []
        for i, b in enumerate(blocks.itertuples()):
            ending = i == len(blocks) - 1
            out.append((b.path, b.block, carry, *opened, b.lines, unended, ending, blank))
            effect = b.effect_unended if unended and ending else b.effect
            first = 0 if carry < 0 else int(np.searchsorted(effect["ends"], target - carry, "right"))
            if first < len(effect["ends"]):
                older = int(effect["befores"][first])
                before = (b.block, older) if older >= 0 else opened
                carry, opened = int(effect["carries"][first]), (b.block, int(effect["lasts"][first]))
            else:  # the whole block fits into the open chunk
                carry += b.chars
        return pd.DataFrame([(*row, *opened, *before) for row in out], columns=[part.split()[0] for part in _ENTRY.split(", ")])

    return run


class _Block:
    """The cut of one block, line by batch of lines: holds the chunk that is open."""

    def __init__(self, row: dict, target: int):
        self.row, self.target = row, target
        self.seen, self.carry, self.kept = 0, row["carry"], 0
        self.opened, self.text = (row["open_block"], row["open_start"]), []
        self.last, self.before = (row["last_block"], row["last_start"]), (row["before_block"], row["before_start"])

    def _close(self, whole: bool) -> Iterator[tuple]:
        """The open chunk's lines in this block.  It is whole if it started here, another starts after it, and it is none of the file's last two."""
        text, self.text = "".join(self.text), []
        if not text:
            return
        path, block = self.row["path"], self.row["block"]
        if whole and self.opened[0] == block and self.opened not in (self.last, self.before):
            chunk = text.strip("\n")
            if chunk.strip():
                yield path, block, self.opened[1], block, _WHOLE, self.kept, chunk
                self.kept += 1
        elif self.opened == self.last and self.before[1] >= 0:
            yield path, *self.before, block, _TAIL, None, text
        else:
            yield path, *self.opened, block, _PART, None, text

    def lines(self, rows: pa.RecordBatch) -> Iterator[tuple]:
        row = self.row
        lengths = rows.column("chars").to_numpy(zero_copy_only=False)
        texts = rows.column("line").to_pylist()
        if row["unended"] and row["ending"] and self.seen + len(lengths) == row["lines"]:
            lengths = without_last_feed(lengths)
            texts = texts[: len(lengths)]
            if row["blank"] and len(texts):  # its text is kept as it is
                texts[-1] = texts[-1][: lengths[-1]]
        starts: list[int] = []
        if row["blank"]:
            self.opened = (_BLANK, 0)
        elif len(lengths):
            ends = np.cumsum(lengths)
            first = 0 if self.carry < 0 else int(np.searchsorted(ends, self.target - self.carry, "right"))
            starts = starts_from(lengths, first, self.target)
            self.carry = int(ends[-1] - ends[starts[-1]] + lengths[starts[-1]]) if starts else self.carry + int(ends[-1])
        at = 0
        for start in starts:
            self.text += texts[at:start]
            yield from self._close(whole=True)
            self.opened, at = (row["block"], self.seen + start), start
        self.text += texts[at:]
        self.seen += len(lengths)

    def end(self) -> Iterator[tuple]:
        yield from self._close(whole=False)
        yield self.row["path"], self.row["block"], None, self.row["block"], _COUNT, self.kept, None


def _cut(target: int):
    """A row per chunk that is whole in its block, per part of another chunk, and per block with the number of whole ones.

    Parts of a file's last chunk stand under the chunk before it, as ``tail``."""
    schema = to_arrow_schema(T.StructType.fromDDL(_CUT))
    state = [part.split()[0] for part in _ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        key, block = None, None
        for batch in batches:
            out: list[tuple] = []
            for found, rows in _runs(batch):
                if found != key:
                    out += block.end() if block else ()
                    key, block = found, _Block({c: rows.column(c)[0].as_py() for c in state}, target)
                out += block.lines(rows)
            if out:
                yield batch_of(out)
        if block:
            yield batch_of(list(block.end()))

    return run


def _text(pieces, kind: str):
    """The pieces of a group of one kind, in order; null if there are none."""
    some = F.filter(pieces, lambda s: s["kind"] == F.lit(kind))
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda s: s["text"]), ""))


def long_file_chunks(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None, target_chars: int = K.TARGET_CHARS, minimum_tail_chars: int = K.MINIMUM_TAIL_CHARS) -> DataFrame:
    """(path, chunk_id, chunk_count, chunk, error), a row per chunk of every file at ``paths``.

    The lines are kept in the shared folder of spark.checkpoint.dir while they
    are cut, so that both passes see the same blocks whatever happens to the
    executors."""
    ensure_checkpoint_dir(spark)
    lines = read_lines(spark, paths, recursive, glob).checkpoint()
    blocks = lines.select("path", "block", "file_size", "chars", "bytes", "bad", "filled").mapInArrow(_maps(target_chars), _MAP).checkpoint()
    small = blocks.count() <= MAX_BROADCAST_BLOCKS
    hint = F.broadcast if small else (lambda df: df)
    bad = blocks.groupBy("path").agg(F.sum("bad").alias("bad")).where("bad > 0").select("path")
    entries = blocks.join(bad, "path", "left_anti").groupBy("path").applyInPandas(_compose(target_chars), _ENTRY)
    given = lines.select("path", "block", "at", "line", "chars").join(hint(entries), ["path", "block"])
    given = given if small else given.sortWithinPartitions("path", "block", "at")  # a broadcast leaves rows in order
    cut = given.mapInArrow(_cut(target_chars), _CUT)
    rest = cut.where(F.col("kind") != _WHOLE).checkpoint()  # a few rows a block
    grouped = rest.where(F.col("kind") != _COUNT).groupBy("path", "chunk_block", "chunk_start").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("pieces"))
    first, tail = F.trim(_text(F.col("pieces"), _PART), F.lit("\n")), F.trim(_text(F.col("pieces"), _TAIL), F.lit("\n"))
    ends = grouped.select("path", "chunk_block", _text(F.col("pieces"), _PART).alias("text"), first.alias("first"), tail.alias("tail"))
    merged = F.when(F.col("tail").isNull(), F.array("first")).when(F.length("tail") < minimum_tail_chars, F.array(F.concat("first", F.lit("\n"), "tail"))).otherwise(F.array("first", "tail"))
    chunks = F.when(F.col("chunk_block") == _BLANK, F.array("text")).otherwise(F.filter(merged, lambda c: c.rlike(PY_NON_WS_CLASS)))
    ends = ends.select("path", "chunk_block", chunks.alias("chunks"))
    counts = rest.where(F.col("kind") == _COUNT).select("path", F.col("block").alias("chunk_block"), F.col("number").alias("whole"), F.lit(0).alias("more"))
    counted = counts.unionByName(ends.select("path", "chunk_block", F.lit(0).alias("whole"), F.size("chunks").alias("more"))).groupBy("path", "chunk_block").agg(F.sum("whole").alias("whole"), F.sum(F.col("whole") + F.col("more")).alias("n"))
    along = Window.partitionBy("path")  # a row per block
    placed = counted.select("path", "chunk_block", "whole", (F.sum("n").over(along.orderBy("chunk_block")) - F.col("n")).alias("offset"), F.sum("n").over(along).cast("int").alias("chunk_count")).checkpoint()
    none = F.lit(None).cast("string")
    inner = cut.where(F.col("kind") == _WHOLE).select("path", "chunk_block", "number", "text").join(hint(placed), ["path", "chunk_block"])
    inner = inner.select("path", (F.col("offset") + F.col("number")).cast("int").alias("chunk_id"), "chunk_count", F.col("text").alias("chunk"), none.alias("error"))
    outer = ends.join(hint(placed), ["path", "chunk_block"]).select("path", "chunk_count", (F.col("offset") + F.col("whole")).alias("before"), F.posexplode("chunks").alias("i", "chunk"))
    outer = outer.select("path", (F.col("before") + F.col("i")).cast("int").alias("chunk_id"), "chunk_count", "chunk", none.alias("error"))
    failed = bad.select("path", F.lit(None).cast("int").alias("chunk_id"), F.lit(None).cast("int").alias("chunk_count"), none.alias("chunk"), F.lit(K.ERR_ENCODING).alias("error"))
    return inner.unionByName(outer).unionByName(failed)


# Ship these helpers by value: executors need not have this package installed.
try:
    import sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
