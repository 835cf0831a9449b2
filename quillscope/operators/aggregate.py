"""File-level aggregation over chunks (L1-L10) as a fold inside the file's row.

The chunks of a file are two arrays of its row, ``_features`` and ``_scores``.
Their numbers and flags are laid side by side as short arrays, which one fold
adds up element by element; signals are ranked by array functions.  Nothing is
grouped, so nothing is shuffled, and the job is the same on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import round_even
from .features import BOOL_FEATURES, DOUBLE_FEATURES, LONG_FEATURES, MAX_FEATURES, STRING_FEATURES, SUM_FEATURES
from .scoring import SCORE_FIELDS

WEIGHTED_MEAN_FIELDS = DOUBLE_FEATURES + SCORE_FIELDS


def _rows() -> Column:
    """Per chunk: weight, and arrays of its sums, maxima, flags and means."""
    def row(z: Column) -> Column:
        f, s = z["_features"], z["_scores"]
        weight = F.greatest(s["signal_strength"], F.lit(0.5)) * F.greatest(F.coalesce(f["non_empty_lines"], F.lit(0)).cast("double"), F.lit(1.0))
        return F.struct(
            weight.alias("w"),
            F.array(*[f[c] for c in SUM_FEATURES]).alias("sums"),
            F.array(*[f[c] for c in MAX_FEATURES]).alias("maxima"),
            F.array(*[f[c] for c in BOOL_FEATURES]).alias("flags"),
            F.array(*[f[c] for c in DOUBLE_FEATURES], *[s[c] for c in SCORE_FIELDS]).alias("means"),
        )

    return F.transform(F.arrays_zip("_features", "_scores"), row)


def _fold(rows: Column) -> Column:
    """Sums, maxima and flags skip nulls; a field no chunk has stays null."""
    nothing = lambda names, kind: F.array_repeat(F.lit(None).cast(kind), len(names))
    start = F.struct(
        F.lit(0.0).alias("w"), nothing(SUM_FEATURES, "long").alias("sums"), nothing(MAX_FEATURES, "long").alias("maxima"),
        nothing(BOOL_FEATURES, "boolean").alias("flags"), nothing(WEIGHTED_MEAN_FIELDS, "double").alias("means"),
    )

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["w"] + x["w"]).alias("w"),
            F.zip_with(acc["sums"], x["sums"], lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + b)).alias("sums"),
            F.zip_with(acc["maxima"], x["maxima"], lambda a, b: F.greatest(a, b)).alias("maxima"),
            F.zip_with(acc["flags"], x["flags"], lambda a, b: F.greatest(a, b)).alias("flags"),
            F.zip_with(acc["means"], x["means"], lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + b * x["w"])).alias("means"),
        )

    return F.aggregate(rows, start, step)


def _signals(side: str) -> Column:
    """All chunks' signals, in order."""
    return F.flatten(F.transform("_scores", lambda s: s[side]))


def _ranked(signals: Column) -> Column:
    """The signals most chunks list; of equal ones the first seen."""
    counted = F.transform(F.array_distinct(signals), lambda s, i: F.struct((-F.size(F.filter(signals, lambda t: t == s))).alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(counted), 1, K.TOP_SIGNALS), lambda e: e["s"])


def aggregate_files(scored: DataFrame, carry=()) -> DataFrame:
    """One result row per row of ``scored``; ``carry`` names columns to keep."""
    staged = scored.select("*", _rows().alias("_rows"), _signals("top_ai_signals").alias("_ai_all"), _signals("top_human_signals").alias("_human_all"))
    staged = staged.select("*", _fold(F.col("_rows")).alias("_sum"))
    first = F.col("_rows")[0]
    single = F.size("_rows") == 1
    means = F.when(single, first["means"]).otherwise(F.transform(F.col("_sum.means"), lambda v: round_even(v / F.col("_sum.w"))))
    # Of an array's error texts the first one is the file's.
    chunk_error = F.filter(F.transform("_features", lambda f: f["chunk_error"]), lambda e: e.isNotNull())
    clear = F.size(F.filter("_scores", lambda s: s["decision_basis"] == F.lit(K.BASIS_CLEAR)))
    staged = staged.select("*", means.alias("_means"), clear.alias("_clear"), F.coalesce(F.col("language_error"), F.get(chunk_error, F.lit(0))).alias("_error"))
    mean = {name: F.col("_means")[i] for i, name in enumerate(WEIGHTED_MEAN_FIELDS)}
    multi_class = (
        F.when((F.col("_clear") == 0) | (F.abs(mean["score_gap"]) < K.FILE_MINIMUM_GAP), F.lit(K.UNCERTAIN_LABEL))
        .when(mean["ai_probability"] >= K.FILE_AI_PROBABILITY, F.lit(K.AI_LABEL))
        .when(mean["ai_probability"] <= K.FILE_HUMAN_PROBABILITY, F.lit(K.HUMAN_LABEL))
        .otherwise(F.lit(K.UNCERTAIN_LABEL))
    )
    own = F.col("_scores")[0]
    staged = staged.select("*", F.when(single, own["classification"]).otherwise(multi_class).alias("_class"))
    ok = F.col("_error").isNull()
    guard = lambda c: F.when(ok, c)
    basis = F.when(single, own["decision_basis"]).otherwise(F.when(F.col("_clear") > 0, F.lit(K.BASIS_CHUNKS)).otherwise(F.lit(K.BASIS_LOW)))
    sums = {name: F.col("_sum.sums")[i] for i, name in enumerate(SUM_FEATURES)} | {name: F.col("_sum.maxima")[i] for i, name in enumerate(MAX_FEATURES)}
    result = F.struct(
        guard(F.col("_class")).alias("classification"),
        guard((F.col("_class") == F.lit(K.AI_LABEL)).cast("int")).alias("result"),
        *[guard(mean[c]).alias(c) for c in SCORE_FIELDS],
        guard(basis).alias("decision_basis"),
        guard(F.when(single, own["top_ai_signals"]).otherwise(_ranked(F.col("_ai_all")))).alias("top_ai_signals"),
        guard(F.when(single, own["top_human_signals"]).otherwise(_ranked(F.col("_human_all")))).alias("top_human_signals"),
        guard(F.size("_rows")).alias("chunk_count"),
        guard(F.col("_clear")).alias("clear_chunk_count"),
        guard(F.transform("_scores", lambda s: s["classification"])).alias("chunk_classifications"),
        F.col("file_total_lines").cast("int").alias("file_total_lines"),
        *[guard(sums[c]).alias(c) for c in LONG_FEATURES],
        *[guard(F.col("_sum.flags")[i]).alias(c) for i, c in enumerate(BOOL_FEATURES)],
        *[guard(mean[c]).alias(c) for c in DOUBLE_FEATURES],
        *[guard(F.when(single, F.col("_features")[0][c])).alias(c) for c in STRING_FEATURES],
        F.get(F.transform("_features", lambda f: f["python_version"]), F.lit(0)).alias("python_version"),
        F.col("_error").alias("error"),
    )
    # Generated from a one-element array: filters on results stay above, where they would otherwise
    # repeat the features at every stage below; filters on the id columns still move down.
    return staged.select("file_id", "path", "language", *carry, F.explode_outer(F.array(result)).alias("_result")).select("file_id", "path", "language", *carry, "_result.*")
