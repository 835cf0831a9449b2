"""Chunk scoring (K1-K8): weighted sums, abstention, confidence, top signals.

Scores are computed inside the file's row, from its array of chunk features.
The default weights are literals of one expression per language.  Weights given
as data are a table (weight_set, language, side, feature, weight); its sets are
rows per language, broadcast where their size allows, and every file is scored
under each set of its language in one pass over the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import clamp, round_even, sigmoid
from .features import ALL_FEATURES, STRING_FEATURES

PY, JS = "python", "javascript"
SCORE_FIELDS = ["ai_score", "human_score", "score_gap", "signal_strength", "ai_probability", "confidence"]
#: A table of weights beyond this size is joined by a shuffle of the files instead of a broadcast.
BROADCAST_BYTES = 8 << 20

SIDES = {"ai": {PY: K.PY_AI_WEIGHTS, JS: K.JS_AI_WEIGHTS}, "human": {PY: K.PY_HUMAN_WEIGHTS, JS: K.JS_HUMAN_WEIGHTS}}


def _numeric(chunk: Column, name: str) -> Column:
    return F.coalesce(chunk[name].cast("double"), F.lit(0.0))


def _contributions(chunk: Column, weights: dict) -> Column:
    return F.array(*[F.struct((_numeric(chunk, name) * F.lit(float(w))).alias("c"), F.lit(name).alias("n")) for name, w in weights.items()])


def _by_language(chunk: Column, side: str) -> Column:
    lang = F.col("language")
    tables = SIDES[side]
    return F.when(lang == F.lit(PY), _contributions(chunk, tables[PY])).when(lang == F.lit(JS), _contributions(chunk, tables[JS]))


def numeric_features() -> list[str]:
    """Features that a weight can name: numbers and flags."""
    return [n for n in ALL_FEATURES if n not in STRING_FEATURES]


def weight_sets(weights: DataFrame, languages=(PY, JS)) -> DataFrame:
    """(weight_set, language, _ai, _human) of a table of weights, and each supported language of each set.

    ``_ai`` and ``_human`` list (feature, weight) in the table's order: by
    ``position`` where there is such a column, else by feature.  A feature no
    chunk has counts 0; of a feature listed twice the last position holds."""
    order = F.col("position") if "position" in weights.columns else F.lit(0)
    rows = weights.select("weight_set", F.lower("language").alias("language"), F.lower("side").alias("side"), "feature", F.col("weight").cast("double").alias("weight"), order.cast("long").alias("position"))
    last = rows.groupBy("weight_set", "language", "side", "feature").agg(F.min("position").alias("position"), F.max_by("weight", "position").alias("weight"))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("position", "feature", "weight")))), lambda e: F.struct(e["feature"].alias("n"), e["weight"].alias("w")))
    sets = last.groupBy("weight_set", "language").agg(listed("ai").alias("_ai"), listed("human").alias("_human"))
    every = rows.select("weight_set").distinct().select("weight_set", F.explode(F.array(*map(F.lit, languages))).alias("language"))
    return every.join(sets, ["weight_set", "language"], "left")


def join_weights(files: DataFrame, weights: DataFrame, languages=(PY, JS)) -> DataFrame:
    """Files times the weight sets of their language; files with an error once, without a set."""
    sets = weight_sets(weights, languages)
    size = sets.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return files.join(F.broadcast(sets) if size <= BROADCAST_BYTES else sets, "language", "left")


def _given(chunk: Column, side: str) -> Column:
    """Contributions under the weight set joined to the file."""
    values = F.create_map(*(x for n in numeric_features() for x in (F.lit(n), _numeric(chunk, n))))
    entries = F.coalesce(F.col(f"_{side}"), F.array().cast("array<struct<n:string,w:double>>"))
    bound = F.transform(F.array(values), lambda v: F.transform(entries, lambda e: F.struct((F.coalesce(F.element_at(v, e["n"]), F.lit(0.0)) * e["w"]).alias("c"), e["n"].alias("n"))))
    return bound[0]


def _sum(contributions: Column) -> Column:
    return F.aggregate(contributions, F.lit(0.0), lambda total, e: total + e["c"])


def _top(contributions: Column) -> Column:
    best = F.slice(F.sort_array(F.filter(contributions, lambda e: e["c"] > 0), asc=False), 1, K.TOP_SIGNALS)
    return F.transform(best, lambda e: F.replace(e["n"], F.lit("_"), F.lit(" ")))


def chunk_scores(
    given_weights: bool = False,
    minimum_lines: int = K.MINIMUM_LINES,
    minimum_tokens: int = K.MINIMUM_TOKENS,
    minimum_signal: float = K.MINIMUM_SIGNAL,
    minimum_margin: float = K.MINIMUM_MARGIN,
) -> Column:
    """The array of score structs of column ``_features``."""
    contributions = _given if given_weights else _by_language

    def listed(chunk: Column) -> Column:
        both = F.struct(
            contributions(chunk, "ai").alias("ai"),
            contributions(chunk, "human").alias("human"),
            F.coalesce(chunk["non_empty_lines"], F.lit(0)).alias("lines"),
            F.coalesce(chunk["token_count"], F.lit(0)).alias("tokens"),
        )
        return F.transform(F.array(both), summed)[0]

    def summed(x: Column) -> Column:
        sums = F.struct(_sum(x["ai"]).alias("ai"), _sum(x["human"]).alias("human"), _top(x["ai"]).alias("top_ai"), _top(x["human"]).alias("top_human"), x["lines"].alias("lines"), x["tokens"].alias("tokens"))
        return F.transform(F.array(sums), scored)[0]

    def scored(x: Column) -> Column:
        gap, strength = x["ai"] - x["human"], x["ai"] + x["human"]
        margin = F.abs(gap)
        thin = (x["lines"] < minimum_lines) | (x["tokens"] < minimum_tokens)
        weak = (strength < minimum_signal) | (margin < minimum_margin)
        confidence = F.lit(0.5) + F.lit(0.5) * clamp((margin / 3.0) * F.least(strength / 4.0, F.lit(1.0)))
        raw = F.array(x["ai"], x["human"], gap, strength, sigmoid(gap), confidence)
        exact = F.struct(
            F.transform(raw, lambda v: round_even(v)).alias("v"),
            F.when(thin | weak, F.lit(K.UNCERTAIN_LABEL)).when(gap > 0, F.lit(K.AI_LABEL)).otherwise(F.lit(K.HUMAN_LABEL)).alias("classification"),
            F.when(thin, F.lit(K.BASIS_LOW)).when(weak, F.lit(K.BASIS_CONFLICT)).otherwise(F.lit(K.BASIS_CLEAR)).alias("decision_basis"),
        )
        return F.transform(F.array(exact), lambda e: F.struct(
            *[e["v"][i].alias(name) for i, name in enumerate(SCORE_FIELDS)],
            e["classification"].alias("classification"), e["decision_basis"].alias("decision_basis"),
            x["top_ai"].alias("top_ai_signals"), x["top_human"].alias("top_human_signals"),
        ))[0]

    return F.transform(F.col("_features"), listed)
