"""The ``detect`` job: code files → chunks → features → scores → file results.

Plan shape (one pass over the input, no exchange):

    scan ─ resolve language ─ chunk fold ─ one Arrow UDF for Python files
         ─ features ─ scores ─ fold over chunks      (all in the file's row)

Parallelism is that of the scan's splits.  For an input in few splits,
``spread=True`` deals the files out by row number first, the one exchange it
can have; equal ids are not brought together.

Every input row is one file and one result row (one per weight set, where
weights are given as data), whatever its ``file_id``.  Rows without code,
malformed records and files with an unresolvable language flow through as one
empty chunk, so the input is read once; their row carries ``error`` and NULL
scores.  Without an aggregation the job runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chunking import with_chunks
from ..functions.language import SUPPORTED, language_error, resolve_language
from ..operators.aggregate import aggregate_files
from ..operators.features import chunk_features, chunk_metrics, with_syntax
from ..operators.scoring import chunk_scores, join_weights
from ..sources.files import spread as dealt


def _col_or_null(df: DataFrame, name: str, dtype: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def route(code_files: DataFrame) -> DataFrame:
    """Adds the resolved ``language`` and ``language_error``.

    The language is generated from a one-element array: what reads it, filters
    too, reads a column and does not run the patterns again."""
    code = F.col("code")
    lang = resolve_language(
        _col_or_null(code_files, "language", "string"),
        _col_or_null(code_files, "path", "string"),
        code,
    )
    routed = code_files.select(
        F.col("file_id"),
        _col_or_null(code_files, "path", "string").alias("path"),
        code,
        F.explode_outer(F.array(lang)).alias("language"),
        _col_or_null(code_files, "input_error", "string").alias("_input_error"),
    )
    error = F.coalesce(
        F.col("_input_error"), F.when(code.isNull(), F.lit(K.ERR_NO_CODE)), language_error(F.col("language"))
    )
    return routed.withColumn("language_error", error).drop("_input_error")


def file_chunks(routed: DataFrame, target_chars: int = K.TARGET_CHARS, minimum_tail_chars: int = K.MINIMUM_TAIL_CHARS) -> DataFrame:
    """Adds ``chunks``, the array of a file's chunks, in place of its code, and ``file_total_lines``."""
    staged = routed.select("file_id", "path", "language", "language_error", "code")
    return with_chunks(staged, target_chars=target_chars, minimum_tail_chars=minimum_tail_chars, enabled=F.col("language_error").isNull(), total="file_total_lines").drop("code")


def explode_chunks(routed: DataFrame, **chunking) -> DataFrame:
    """One row per chunk with ``chunk_id`` (0-based) and ``chunk_count``."""
    files = file_chunks(routed, **chunking)
    # outer: chunks are never empty, and an inner explode would make
    # Catalyst infer size(chunks) > 0 and inline the chunk fold into it
    return files.select("*", F.size("chunks").alias("chunk_count"), F.posexplode_outer("chunks").alias("chunk_id", "chunk")).drop("chunks")


def routed_files(code_files: DataFrame, spread: bool, languages: tuple[str, ...]) -> DataFrame:
    """The files of these languages (of all supported ones: and error rows), dealt out by row number if ``spread``."""
    deal = dealt if spread else lambda df: df
    if set(languages) == set(SUPPORTED):
        return route(deal(code_files))
    # Only files of these languages are dealt out.
    return deal(route(code_files).where(F.col("language").isin(*languages) & F.col("language_error").isNull()))


def scored_files(
    code_files: DataFrame, spread: bool = False, languages: tuple[str, ...] = SUPPORTED, weights: DataFrame | None = None,
    target_chars: int = K.TARGET_CHARS, minimum_tail_chars: int = K.MINIMUM_TAIL_CHARS, **thresholds,
) -> DataFrame:
    """A row per file with its arrays ``chunks``, ``_features`` and ``_scores`` (K1-K8).

    ``languages`` restricts the job to files of these languages (and, if it
    names all that are supported, error rows); with ``("javascript",)`` no
    Python worker is part of the plan.  ``weights`` is a table of weight sets
    (see :func:`operators.scoring.weight_sets`); rows then carry ``weight_set``.
    ``thresholds`` are those of :func:`operators.scoring.chunk_scores`."""
    routed = routed_files(code_files, spread, languages)
    files = with_syntax(file_chunks(routed, target_chars, minimum_tail_chars), languages)
    featured = files.withColumn("_features", built(code_files, ("features", languages), lambda: chunk_features(languages))).drop("_syntax")
    if weights is not None:
        featured = join_weights(featured, weights, languages)
    how = (weights is not None, *sorted(thresholds.items()))
    return featured.withColumn("_scores", built(code_files, ("scores", how), lambda: chunk_scores(weights is not None, **thresholds))).drop("_ai", "_human")


def built(df: DataFrame, key: tuple, build):
    """An expression that is the same for every input, built once per application: its many parts each cost a call to the JVM."""
    context = df.sparkSession.sparkContext
    kept = context.__dict__.setdefault("_quillscope_expressions", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def chunk_results(code_files: DataFrame, **kw) -> DataFrame:
    """Scored chunk rows (features + K1-K8), one per chunk and weight set."""
    files = scored_files(code_files, **kw)
    keep = [c for c in files.columns if c not in ("chunks", "_features", "_scores")]
    rows = files.select(*keep, F.size("chunks").alias("chunk_count"), F.posexplode_outer(F.arrays_zip("chunks", "_features", "_scores")).alias("chunk_id", "_c"))
    return rows.select(*keep, "chunk_count", "chunk_id", F.col("_c.chunks").alias("chunk"), "_c._features.*", "_c._scores.*")


def metrics(code_files: DataFrame, names: list[str], language: str, spread: bool = False, **chunking) -> DataFrame:
    """One row per chunk of the files of one language, with the named features and nothing else computed.

    Features of the Python syntax tree or tokens are those of :func:`chunk_results`."""
    files = file_chunks(routed_files(code_files, spread, (language,)), **chunking)
    found = built(code_files, ("metrics", language, *names), lambda: chunk_metrics(language, names))
    rows = files.select("file_id", F.size("chunks").alias("chunk_count"), F.posexplode_outer(found).alias("chunk_id", "_c"))
    return rows.select("file_id", "chunk_id", "chunk_count", "_c.*")


def detect(code_files: DataFrame, weights: DataFrame | None = None, **kw) -> DataFrame:
    """``code_files(file_id, [path], [language], code, [input_error])`` → one row per input row (and weight set)."""
    return aggregate_files(scored_files(code_files, weights=weights, **kw), () if weights is None else ("weight_set",))
