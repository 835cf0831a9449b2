"""Registered queries: each reads the driver tables at ``sf_dir`` (or the
corpus Spark derives from them) and runs one operator family of the
inventory through the production code path.

Doubles are rounded to 6 digits and arrays joined to strings in the
projections only, so that results compare across engines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.chunking import with_chunks
from ..operators.evaluate import class_metrics, evaluate, expected_from_templates, held_out, reliability
from ..operators.features import ALL_FEATURES, BOOL_FEATURES, JS_BOOL, JS_DOUBLE, JS_STRING, LONG_FEATURES
from ..operators.structure import structure_features, token_features
from ..sources.corpus import code_files
from ..session import ensure_checkpoint_dir
from ..sources.files import read_code_files, snippets_from, spread
from ..sources.long_files import long_file_chunks
from .detect import chunk_results, detect, explode_chunks, metrics, route, routed_files
from .outputs import to_basic, to_detailed, to_report

JS_CHUNK_COLUMNS = [
    "total_lines", "non_empty_lines", "blank_line_ratio", "token_count", "token_entropy", "comment_ratio",
    "avg_line_length", "line_length_variance", "line_length_uniformity", "function_count", "loop_count",
    "try_except_count", "max_ast_depth", "uses_arrow_functions", "uses_async_await", "uses_destructuring",
    "uses_template_literals", "uses_spread_operator", "uses_optional_chaining", "has_iife", "import_export_usage",
    "uses_strict_mode", "function_style_consistency", "pattern_repetition_score", "uses_camel_case_ratio",
    "uses_snake_case_ratio", "meaningful_name_ratio", "single_letter_var_ratio", "avg_name_length",
    "naming_consistency_score", "semicolon_consistency", "quote_consistency", "indentation_consistency",
    "has_console_log", "has_debugger", "has_todo_comments", "has_commented_code", "has_alert", "has_eval",
    "has_var_declarations", "has_long_lines", "has_callback_hell", "uses_jquery", "console_log_score",
    "debugger_score", "todo_comment_score", "commented_code_score", "alert_score", "eval_score",
    "var_declaration_score", "callback_hell_score", "jquery_score", "long_line_score", "generic_example_score",
    "example_usage_score", "placeholder_score", "excessive_comments_ratio", "uses_react_patterns",
    "uses_node_patterns", "uses_typescript_patterns", "module_pattern",
]

# Python features that need no syntax tree (H1-H6, E5, E11, E12, E15, text metrics)
PY_TEXT_COLUMNS = [
    "total_lines", "non_empty_lines", "blank_line_ratio", "comment_ratio", "avg_line_length",
    "line_length_variance", "line_length_uniformity", "indentation_consistency", "has_todo_comments",
    "has_debug_prints", "has_commented_code", "has_long_lines", "has_trailing_whitespace", "todo_comment_score",
    "debug_print_score", "commented_code_score", "long_line_score", "trailing_whitespace_score",
    "generic_example_score", "example_usage_score", "placeholder_score", "over_explanation_score",
]

SCORE_COLUMNS = ["ai_score", "human_score", "score_gap", "signal_strength", "ai_probability", "confidence"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name), ", ").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def documents_as(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit(language).alias("language"),
        F.col("text").alias("code"),
    )


# --- C: chunking ------------------------------------------------------------

def q_chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"), F.col("text").alias("code"))
    chunks = with_chunks(docs.repartition("file_id"))
    return chunks.select(
        "file_id",
        F.size("chunks").alias("chunk_count"),
        F.posexplode_outer("chunks").alias("chunk_id", "chunk"),
    ).select(
        "file_id",
        F.col("chunk_id").cast("int").alias("chunk_id"),
        F.col("chunk_count").cast("int").alias("chunk_count"),
        F.length("chunk").cast("long").alias("chunk_chars"),
        F.md5(F.col("chunk")).alias("chunk_md5"),
    )


# --- D/E/F on documents (language-neutral operators) -------------------------

def _doc_metrics(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return _rounded(metrics(documents_as(spark, sf_dir, "javascript"), names, "javascript", spread=True).drop("chunk_count"))


def q_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_metrics(spark, sf_dir, [
        "total_lines", "non_empty_lines", "blank_line_ratio", "comment_ratio", "avg_line_length",
        "line_length_variance", "line_length_uniformity", "indentation_consistency", "long_line_score"])


def q_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_metrics(spark, sf_dir, ["token_count", "token_entropy", "quote_consistency"])


def q_keyword_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_metrics(spark, sf_dir, ["pattern_repetition_score"])


# --- J/K/L on the JavaScript part of the corpus ------------------------------

def _js_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_results(code_files(spark, sf_dir), languages=("javascript",))


def q_js_chunk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_js_chunks(spark, sf_dir).select(
        "file_id", F.col("chunk_id").cast("int").alias("chunk_id"), F.col("chunk_count").cast("int").alias("chunk_count"),
        *JS_CHUNK_COLUMNS))


def q_js_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_js_chunks(spark, sf_dir).select(
        "file_id", F.col("chunk_id").cast("int").alias("chunk_id"), *SCORE_COLUMNS,
        "classification", "decision_basis", "top_ai_signals", "top_human_signals"))


def js_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(code_files(spark, sf_dir), languages=("javascript",))


def file_digest(results: DataFrame) -> DataFrame:
    return _rounded(results.select(
        "file_id", "classification", "result", *SCORE_COLUMNS, "decision_basis", "top_ai_signals",
        "top_human_signals", "chunk_count", "clear_chunk_count", "chunk_classifications", "total_lines",
        "non_empty_lines", "token_count", "function_count", "loop_count", "try_except_count", "max_ast_depth",
        "token_entropy", "comment_ratio"))


def q_js_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_digest(js_file_results(spark, sf_dir))


def q_js_file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boolean and double feature of the JavaScript files."""
    return _rounded(js_file_results(spark, sf_dir).select("file_id", *JS_BOOL, *JS_DOUBLE))


def q_js_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_report(js_file_results(spark, sf_dir), detailed=True)


def q_js_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(to_basic(js_file_results(spark, sf_dir)))


def q_js_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the detailed output's features, as columns; what only Python files have is the text ``null``."""
    found = _rounded(to_detailed(js_file_results(spark, sf_dir)).select("file_id", "result", "classification", "language", "features.*", "error"))
    absent = [c for c in ALL_FEATURES if c not in LONG_FEATURES + JS_BOOL + JS_DOUBLE]
    return found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in absent})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected classes that no template gives: the label table's quality marks stand for the origin of a document's
    JavaScript file (1: a person), a quarter of the documents is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality").isNotNull())
    origin = F.when(F.col("quality") == 1, K.HUMAN_LABEL).otherwise(K.AI_LABEL)
    return labels.select((F.col("doc_id") * 4 + 1).alias("file_id"), origin.alias("expected_classification"), held_out(F.col("doc_id")).alias("held_out"))


def q_js_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(class_metrics(js_file_results(spark, sf_dir), _labelled(spark, sf_dir), ("held_out",)))


def q_js_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reliability(js_file_results(spark, sf_dir), _labelled(spark, sf_dir), by=("held_out",)))


def q_js_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller chunks, tails and abstention thresholds."""
    chunks = chunk_results(
        documents_as(spark, sf_dir, "javascript"), spread=True, languages=("javascript",), target_chars=900,
        minimum_tail_chars=200, minimum_lines=2, minimum_tokens=10, minimum_signal=0.4, minimum_margin=0.1)
    return _rounded(chunks.select(
        "file_id", F.col("chunk_id").cast("int").alias("chunk_id"), "total_lines", "token_count", "classification", "decision_basis"))


# A second set of weights beside the default one: flags and plain metrics count too, one feature on both sides.
HOUSE_WEIGHTS = {
    "ai": {"generic_example_score": 2.0, "uses_arrow_functions": 0.75, "comment_ratio": 1.25, "quote_consistency": 0.5, "no_such_feature": 9.0, "line_length_uniformity": 0.8, "uses_template_literals": 0.35},
    "human": {"has_var_declarations": 1.1, "long_line_score": 0.9, "token_entropy": 0.15, "comment_ratio": 0.4, "non_empty_lines": 0.01},
}


def weight_rows() -> list[tuple[str, str, str, str, float, int]]:
    """(weight_set, language, side, feature, weight, position) of both sets, JavaScript."""
    sets = {"default": {"ai": K.JS_AI_WEIGHTS, "human": K.JS_HUMAN_WEIGHTS}, "house": HOUSE_WEIGHTS}
    return [(name, "javascript", side, f, w, i) for name, sides in sets.items() for side, ws in sides.items() for i, (f, w) in enumerate(ws.items())]


def q_js_weight_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks scored under two sets of weights in one pass."""
    weights = spark.createDataFrame(weight_rows(), "weight_set string, language string, side string, feature string, weight double, position int")
    chunks = chunk_results(documents_as(spark, sf_dir, "javascript"), spread=True, languages=("javascript",), weights=weights)
    return _rounded(chunks.select(
        "weight_set", "file_id", F.col("chunk_id").cast("int").alias("chunk_id"), *SCORE_COLUMNS,
        "classification", "decision_basis", "top_ai_signals", "top_human_signals"))


def q_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a JavaScript snippet, and beside it, under the same id, a bad copy: without code, of an unsupported language, or malformed."""
    # Dealt out before a document becomes two snippets: its text is shuffled once.
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    none = F.lit(None).cast("string")
    fault = F.col("doc_id") % 3
    bad = F.struct(F.when(fault != 0, F.col("text")).alias("code"), F.when(fault == 1, "Ruby").otherwise("JavaScript").alias("language"), F.when(fault == 2, F.col("text")).alias("_corrupt_record"))
    good = F.struct(F.col("text").alias("code"), F.lit("JavaScript").alias("language"), none.alias("_corrupt_record"))
    given = docs.select(F.col("doc_id").alias("file_id"), F.inline(F.array(good, bad)))
    found = detect(snippets_from(given))
    return found.select("file_id", "language", "error", F.coalesce("result", F.lit(-1)).alias("result"), F.coalesce("total_lines", F.lit(-1)).alias("total_lines"))


#: Documents of neighbouring ids that make a stored file.
DOCS_PER_FILE = 32


def store_documents(docs: DataFrame, folder: str, per_file: int = DOCS_PER_FILE) -> None:
    """Documents as text files below ``folder``, ``per_file`` neighbouring ids each; some begin with a byte-order mark, some hold a byte that is no UTF-8."""
    number = F.floor(F.col("doc_id") / per_file)
    first = F.col("doc_id") % per_file == 0
    mark = F.when(first & (number % 3 == 1), F.lit("\ufeff")).when(first & (number % 5 == 2), F.unhex(F.lit("FF")).cast("string")).otherwise(F.lit(""))
    rows = docs.select(number.alias("number"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), mark.alias("mark"))
    ordered = rows.repartition("number").sortWithinPartitions("number", "doc_id", "text")
    ordered.select("number", F.concat("mark", "text").alias("value")).write.partitionBy("number").text(folder)


def q_stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: files on the shared storage, written from the documents, read back and analysed as JavaScript."""
    folder = f"{ensure_checkpoint_dir(spark)}/stored-files-{uuid.uuid4().hex}"
    store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    files = read_code_files(spark, folder, glob="*.txt").withColumn("language", F.lit("javascript"))
    found = detect(files, spread=True).withColumn("number", F.regexp_extract("path", r"number=(-?\d+)", 1).try_cast("long"))
    counts = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("chunk_count", "file_total_lines", "total_lines", "token_count")]
    return _rounded(found.select("number", "classification", *SCORE_COLUMNS, "decision_basis", *counts, "token_entropy", "error"))


#: Documents of neighbouring ids that make a long file.
DOCS_PER_LONG_FILE = 1024


def q_long_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2-C6 over blocks: long files on the shared storage, each read and cut by as many tasks as it has blocks."""
    folder = f"{ensure_checkpoint_dir(spark)}/long-files-{uuid.uuid4().hex}"
    store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, DOCS_PER_LONG_FILE)
    chunks = long_file_chunks(spark, folder, glob="*.txt").withColumn("number", F.regexp_extract("path", r"number=(-?\d+)", 1).try_cast("long"))
    counts = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("chunk_id", "chunk_count")]
    return chunks.select("number", *counts, F.coalesce(F.length("chunk"), F.lit(-1)).cast("long").alias("chunk_chars"), F.md5("chunk").alias("chunk_md5"), "error")


def q_page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript of every page's <script> elements, classified per page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    scripts = pages.select(
        F.col("page_id").alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.lit("javascript").alias("language"),
        F.array_join(F.regexp_extract_all(F.col("html"), F.lit("(?is)<script[^>]*>(.*?)</script>"), 1), "\n").alias("code"),
    )
    return _rounded(detect(scripts, spread=True, languages=("javascript",)).select(
        "file_id", "classification", *SCORE_COLUMNS, "decision_basis", "token_count", "function_count",
        "max_ast_depth", "total_lines"))


# --- B: language routing ------------------------------------------------------

def q_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(code_files(spark, sf_dir))
    return routed.select("file_id", "language", F.col("language_error").alias("error"))


# --- Python text features (no syntax tree) ------------------------------------

def q_py_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No syntax tree, so no Python worker."""
    return _rounded(metrics(code_files(spark, sf_dir), PY_TEXT_COLUMNS, "python").drop("chunk_count"))


def _python_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_chunks(routed_files(code_files(spark, sf_dir), False, ("python",))).select("file_id", F.col("chunk_id").cast("int").alias("chunk_id"), "chunk")


def q_py_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G0-G16 of every Python chunk as aggregates of the node table."""
    return _rounded(structure_features(_python_chunks(spark, sf_dir), ["file_id", "chunk_id"]))


def q_py_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2-D4 of every Python chunk as aggregates of the token table."""
    return _rounded(token_features(_python_chunks(spark, sf_dir), ["file_id", "chunk_id"]))


# --- both languages: results, outputs, evaluation ------------------------------

def q_py_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K, L, A7: the wide result of every Python file; in it a failed file's counts are -1, and flags are text, ``null`` where a file has none."""
    found = _rounded(detect(code_files(spark, sf_dir), languages=("python",)))
    counts = ["result", "chunk_count", "clear_chunk_count", "file_total_lines", *LONG_FEATURES]
    return found.withColumns(
        {c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in counts} | {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in BOOL_FEATURES + JS_STRING})


def q_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 of every file; the result of a file that was not analysed is -1."""
    files = code_files(spark, sf_dir)
    return _rounded(to_basic(detect(files))).withColumn("result", F.coalesce("result", F.lit(-1)))


def q_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: every feature of every file, as JSON."""
    return to_detailed(detect(code_files(spark, sf_dir)), as_json=True)


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_report(detect(code_files(spark, sf_dir)), detailed=True)


def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(code_files(spark, sf_dir)).where(F.col("error").isNotNull()).select("file_id", "language", "error")


def q_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = code_files(spark, sf_dir, ("file_id", "template"))
    return evaluate(detect(code_files(spark, sf_dir)), expected_from_templates(templates))


def q_benchmark_snippets_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short benchmark texts submitted as JavaScript snippets."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    snippets = snippets_from(bench.select(F.col("item_id").alias("file_id"), F.col("text").alias("code"), F.lit("JavaScript").alias("language")))
    return _rounded(to_basic(detect(snippets, spread=True, languages=("javascript",))))


def q_benchmark_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short benchmark texts submitted as snippets (language defaults to python)."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    snippets = snippets_from(bench.select(F.col("item_id").alias("file_id"), F.col("text").alias("code")))
    return _rounded(to_basic(detect(snippets, spread=True)))
