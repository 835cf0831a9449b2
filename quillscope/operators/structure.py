"""Python structure features (G0-G16) and token statistics (D2-D4) as aggregates of the node and token tables.

The relational form of what ``operators/features`` takes from one worker call
per file: any query can be asked of the same tables.  Rows are pre-aggregated
where they are made; only statement kinds, whose order matters, are gathered, a
chunk's worth at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.pytables import nodes, token_counts
from ..functions.text import dominant_ratio, pattern_repetition, saturate
from .features import SNAKE

FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
LOOPS = ("For", "While", "AsyncFor")
COMPREHENSIONS = ("ListComp", "DictComp", "SetComp", "GeneratorExp")


def structure_features(chunks: DataFrame, by: list[str], code: str = "chunk") -> DataFrame:
    """G0-G16 of every chunk, ``by`` its key columns."""
    kind, name = F.col("kind"), F.col("name")
    function = kind.isin(*FUNCTIONS)
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    lower = (F.lower(name) == name) & (F.upper(name) != name)
    upper = (F.upper(name) == name) & (F.lower(name) != name)
    length = F.greatest(F.lit(1), F.coalesce("end_lineno", "lineno") - F.col("lineno") + 1)
    magic = F.col("num_value").isNotNull() & ~F.col("num_value").isin(*map(float, K.PY_COMMON_NUMBERS))
    counted = nodes(chunks, code).groupBy(*by).agg(
        (F.count("bfs_pos") > 0).alias("parseable"),
        F.count_if(function).alias("function_count"),
        F.count_if(kind.isin(*LOOPS)).alias("loop_count"),
        F.count_if(kind == "Try").alias("try_except_count"),
        F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_ast_depth"),
        has(F.col("is_main_guard")).alias("has_main_guard"),
        F.count_if(function & F.col("has_doc")).alias("_documented"),
        has(kind.isin(*COMPREHENSIONS)).alias("uses_comprehensions"),
        has(kind == "NamedExpr").alias("uses_walrus_operator"),
        has(kind == "JoinedStr").alias("uses_f_strings"),
        has(F.col("annotated")).alias("uses_type_hints"),
        F.coalesce(F.max("fn_depth"), F.lit(0)).cast("double").alias("nested_function_depth"),
        F.coalesce(F.stddev_pop(F.when(function, length)), F.lit(0.0)).alias("function_length_variance"),
        F.array_sort(F.collect_list(F.when(F.col("is_stmt"), F.struct("bfs_pos", "kind")))).alias("_statements"),
        F.count("name").alias("_names"),
        F.count_if(name.rlike(SNAKE)).alias("_snake"),
        F.count_if(lower & ~name.contains("_")).alias("_lower"),
        F.count_if(upper).alias("_upper"),
        F.count_if((F.length(name) > 3) & ~F.lower(name).isin(*K.PY_STOP_NAMES)).alias("_meaningful"),
        F.count_if((F.length(name) == 1) & ~name.isin(*K.PY_EXEMPT_LETTERS)).alias("_single"),
        F.coalesce(F.avg(F.length(name)), F.lit(0.0)).alias("avg_name_length"),
        F.count_if(magic).alias("_magic"),
        F.count_if(F.col("bare_except")).alias("_bare"),
    )
    share = lambda part, whole: F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col(part) / F.col(whole))
    kinds: Column = F.transform("_statements", lambda s: s["kind"])
    return counted.select(
        *by, "parseable", "function_count", "loop_count", "try_except_count", "max_ast_depth", "has_main_guard",
        (F.col("_documented") > 0).alias("has_docstrings"), share("_documented", "function_count").alias("docstring_coverage"),
        "uses_comprehensions", "uses_walrus_operator", "uses_f_strings", "uses_type_hints", "nested_function_depth", "function_length_variance",
        saturate(F.col("function_length_variance"), 10.0).alias("function_length_variance_score"),
        pattern_repetition(kinds).alias("pattern_repetition_score"),
        F.when(F.col("_names") == 0, F.lit(0.0)).otherwise(dominant_ratio(F.col("_snake"), F.col("_lower"), F.col("_upper"))).alias("naming_consistency_score"),
        share("_snake", "_names").alias("uses_snake_case_ratio"), share("_meaningful", "_names").alias("meaningful_name_ratio"),
        share("_single", "_names").alias("single_letter_var_ratio"), "avg_name_length",
        (F.col("_magic") > 0).alias("has_magic_numbers"), saturate(F.col("_magic"), 6.0).alias("magic_number_score"), saturate(F.col("_bare"), 2.0).alias("bare_except_score"),
    )


def token_features(chunks: DataFrame, by: list[str], code: str = "chunk") -> DataFrame:
    """token_count and token_entropy of every chunk: two aggregates over tokens that are counted where they are made."""
    each = token_counts(chunks, code).groupBy(*by, "token").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = each.groupBy(*by).agg(F.sum("n").alias("token_count"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n").cast("double")))).alias("_nlogn"))
    entropy = F.when(F.col("token_count") == 0, F.lit(0.0)).otherwise(F.log2(F.col("token_count").cast("double")) - F.col("_nlogn") / F.col("token_count"))
    return total.select(*by, "token_count", entropy.alias("token_entropy"))
