"""Greedy line-based chunking (C2-C5) as one row-local Catalyst expression.

A file is one input row, kept as an array of lines with their terminators.
The fold runs over the lines' lengths, in blocks of ``FOLD_LINES`` lines: a
first pass carries the open chunk's size from block to block, a second folds
every block from its own start and lists the lines at which chunks begin.  A
chunk is then a slice of the lines, joined.  Growing arrays stay as short as a
block, so work is linear in the file length up to very long files; nothing
leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import MINIMUM_TAIL_CHARS, TARGET_CHARS
from .regex import LINE, PY_NON_WS_CLASS
from .text import line_count


FOLD_LINES = 1024


def lines_keepends(code: Column) -> Column:
    """``code.splitlines(keepends=True)``, in one pass over the text."""
    return F.regexp_extract_all(code, F.lit(LINE), 0)


def _open_chars(size: Column, n: Column, target: int) -> tuple[Column, Column]:
    """Whether a line of n characters starts a new chunk, and the open chunk's size with it."""
    cut = (size > 0) & (size + n > F.lit(target))
    return cut, F.when(cut, n).otherwise(size + n)


def _block(block: Column) -> Column:
    return F.slice("_lengths", block * FOLD_LINES + 1, FOLD_LINES)


def _sizes_at_blocks(blocks: Column, target: int) -> Column:
    """The open chunk's size at the start of every block.  The last block's lines come before no other's: they are not folded here."""
    through = lambda size, block: F.aggregate(_block(block), size, lambda s, n: _open_chars(s, n, target)[1])

    def step(acc, block):
        return F.transform(F.array(through(acc["size"], block)), lambda size: F.struct(size.alias("size"), F.concat(acc["seen"], F.array(size)).alias("seen")))[0]

    start = F.struct(F.lit(0).alias("size"), F.array(F.lit(0)).alias("seen"))
    return F.aggregate(F.slice(blocks, 1, F.size(blocks) - 1), start, step, lambda acc: acc["seen"])


def _starts_in_block(block: Column, size: Column, target: int) -> Column:
    """The lines (0-based) of a block that start a chunk."""
    def step(acc, n):
        cut, size = _open_chars(acc["size"], n, target)
        starts = F.when(cut, F.concat(acc["starts"], F.array(acc["line"]))).otherwise(acc["starts"])
        return F.struct(size.alias("size"), (acc["line"] + 1).alias("line"), starts.alias("starts"))

    init = F.struct(size.alias("size"), (block * FOLD_LINES).alias("line"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(_block(block), init, step, lambda acc: acc["starts"])


def with_chunks(
    df: DataFrame,
    code: str = "code",
    out: str = "chunks",
    target_chars: int = TARGET_CHARS,
    minimum_tail_chars: int = MINIMUM_TAIL_CHARS,
    enabled: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Adds ``out``: the chunks of column ``code`` (greedy fill, ``\\n``-strip,
    tail merge, blank-chunk drop, never empty — falls back to ``[code]``), and
    ``total``, if named: the number of lines of every row's code.

    Built as staged projections: each intermediate array is its own column,
    so Catalyst evaluates it once per row instead of once per reference.
    Rows where ``enabled`` is false get ``['']`` without any work."""
    src = F.col(code)
    on = F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(False))
    cols = df.columns
    s1 = df.select(*cols, F.when(on, lines_keepends(src)).alias("_lines"))
    if total:  # the lines are there already, but for rows without chunks
        s1 = s1.select(*cols, "_lines", F.when(on, F.size("_lines")).otherwise(line_count(src)).alias(total))
        cols = [*cols, total]
    s2 = s1.select(*cols, "_lines", F.transform("_lines", lambda line: F.length(line)).alias("_lengths"))
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_lengths") - 1) / FOLD_LINES).cast("int")))
    s3 = s2.select(*cols, "_lines", "_lengths", blocks.alias("_blocks"))
    s4 = s3.select(*cols, "_lines", "_lengths", "_blocks", _sizes_at_blocks(F.col("_blocks"), target_chars).alias("_sizes"))
    starts = F.flatten(F.transform(
        F.arrays_zip(F.col("_blocks").alias("b"), F.col("_sizes").alias("s")),
        lambda z: _starts_in_block(z["b"], z["s"], target_chars),
    ))
    # Of code that fits in one chunk no line starts another.
    starts = F.when(F.length(src) <= target_chars, F.array().cast("array<int>")).otherwise(starts)
    s5 = s4.select(*cols, "_lines", F.concat(F.array(F.lit(0)), starts).alias("_starts"))
    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_lines")))
    raw = F.transform(
        F.arrays_zip(F.col("_starts").alias("s"), ends.alias("e")),
        lambda z: F.trim(F.array_join(F.slice("_lines", z["s"] + 1, z["e"] - z["s"]), ""), F.lit("\n")),
    )
    s6 = s5.select(*cols, raw.alias("_raw"))
    raw = F.col("_raw")
    m = F.size(raw)
    last = F.element_at(raw, -1)
    merged = F.when(
        (m > 1) & (F.length(last) < minimum_tail_chars),
        F.concat(
            F.slice(raw, 1, F.greatest(m - 2, F.lit(0))),
            F.array(F.concat(F.element_at(raw, F.greatest(m - 1, F.lit(1))), F.lit("\n"), last)),
        ),
    ).otherwise(raw)
    s7 = s6.select(*cols, F.filter(merged, lambda c: c.rlike(PY_NON_WS_CLASS)).alias("_kept"))
    kept = F.col("_kept")
    return s7.select(
        *cols,
        F.when(~on, F.array(F.lit(""))).when(F.size(kept) == 0, F.array(src)).otherwise(kept).alias(out),
    )
