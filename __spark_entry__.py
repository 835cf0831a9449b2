"""

``entry(spark)`` runs the flagship query (per-file detection over the
JavaScript part of the derived code corpus) on sf0.001.  ``queries()`` maps
every registered query to a callable ``(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` gives, where the operator is SQL-expressible, the DuckDB
SQL computing the same rows over the driver tables.  The Python syntax features
have one too (``oracle/pyduck``): the statements of the corpus in normal form,
blocks by indents.  ``detailed`` (JSON) has none; ``js_detailed`` and
``py_file_results`` hold the same features as columns.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillscope.functions import constants as K  # noqa: E402
from quillscope.operators.evaluate import TEMPLATE_EXPECTED  # noqa: E402
from quillscope.oracle import duck as D  # noqa: E402
from quillscope.oracle import pyduck as PY  # noqa: E402
from quillscope.plans import queries as Q  # noqa: E402

try:  # the training-data operators and their pipeline can be left out as a whole
    import corpus_pipeline
    import quillscope.llm.queries as LLM
except ImportError:
    here = os.path.dirname(os.path.abspath(__file__))
    if all(os.path.exists(os.path.join(here, part)) for part in ("corpus_pipeline.py", "quillscope/llm/__init__.py")):
        raise  # they are there: what fails is inside them
    LLM = None

SF_SMOKE = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: file-level classification of the JavaScript files."""
    return Q.q_js_file_results(spark, SF_SMOKE)


def _conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from quillscope.session import ensure_checkpoint_dir
    from quillscope.streaming.stream import conversation_stream

    base = os.path.join(ensure_checkpoint_dir(spark), f"conversation-stream-{uuid.uuid4().hex}")
    results = conversation_stream(spark, sf_dir, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    return Q.file_digest(results)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "chunk_code": Q.q_chunk_code,
        "text_metrics": Q.q_text_metrics,
        "token_entropy": Q.q_token_entropy,
        "keyword_trigrams": Q.q_keyword_trigrams,
        "js_chunk_features": Q.q_js_chunk_features,
        "js_chunk_scores": Q.q_js_chunk_scores,
        "js_file_results": Q.q_js_file_results,
        "js_file_features": Q.q_js_file_features,
        "js_report": Q.q_js_report,
        "js_basic": Q.q_js_basic,
        "js_detailed": Q.q_js_detailed,
        "js_class_metrics": Q.q_js_class_metrics,
        "js_reliability": Q.q_js_reliability,
        "js_tuned": Q.q_js_tuned,
        "js_weight_sets": Q.q_js_weight_sets,
        "input_errors": Q.q_input_errors,
        "stored_files": Q.q_stored_files,
        "long_file_chunks": Q.q_long_file_chunks,
        "page_scripts": Q.q_page_scripts,
        "detect_language": Q.q_detect_language,
        "py_text_features": Q.q_py_text_features,
        "py_structure": Q.q_py_structure,
        "py_token_stats": Q.q_py_token_stats,
        "py_file_results": Q.q_py_file_results,
        "basic": Q.q_basic,
        "detailed": Q.q_detailed,
        "report": Q.q_report,
        "errors": Q.q_errors,
        "evaluate": Q.q_evaluate,
        "benchmark_snippets": Q.q_benchmark_snippets,
        "benchmark_snippets_js": Q.q_benchmark_snippets_js,
        "conversation_stream": _conversation_stream,
    } | (LLM.queries() | {"pipeline": corpus_pipeline.run} if LLM else {})


# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

def _r(col: str) -> str:
    return f"round({col}, 6) AS {col}"


DOC_SRC = "SELECT doc_id AS file_id, text AS code FROM documents"
JS_CORPUS_SRC = f"SELECT file_id, code FROM ({D.resolved_corpus_sql()}) WHERE language = 'javascript'"
PY_CORPUS_SRC = f"SELECT file_id, code FROM ({D.resolved_corpus_sql()}) WHERE language = 'python'"
BENCHMARK_SRC = "SELECT item_id AS file_id, text AS code FROM benchmark"
TURNS_SRC = "SELECT conv_id * 1048576 + turn AS file_id, text AS code FROM conversations"
PAGES_SRC = (
    "SELECT page_id AS file_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS code "
    "FROM pages"
)

JS_DOUBLES = set(K.JS_AI_WEIGHTS) | set(K.JS_HUMAN_WEIGHTS) | {
    "blank_line_ratio", "token_entropy", "comment_ratio", "avg_line_length", "line_length_variance",
    "line_length_uniformity", "uses_camel_case_ratio", "uses_snake_case_ratio", "meaningful_name_ratio",
    "avg_name_length", "naming_consistency_score", "quote_consistency", "indentation_consistency",
    "function_style_consistency", "pattern_repetition_score", "semicolon_consistency",
}


def _js(select: str, src: str, extra: str = "", **chunking: int) -> str:
    return f"WITH RECURSIVE {D.chunks_ctes(src, **chunking)}{D.js_feature_ctes()}{extra}\n{select}"


def _cols(cols) -> str:
    return ", ".join(_r(c) if c in JS_DOUBLES else c for c in cols)


def _all_files(select_js: str, select_py: str) -> str:
    """Rows of both languages' files, those of failed Python files left out; ``broken`` files are named by the second."""
    js = _js(select_js, JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes())
    return f"SELECT * FROM ({js}) UNION ALL BY NAME SELECT * FROM ({PY.file_query(select_py, PY_CORPUS_SRC)})"


def oracle_sql() -> dict[str, str]:
    score_cols = "ai_score, human_score, score_gap, signal_strength, ai_probability, confidence"
    file_select = (
        "SELECT file_id, classification, CASE WHEN classification = 'AI-Generated Code' THEN 1 ELSE 0 END AS result, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in score_cols.split(", "))
        + ", decision_basis, top_ai_signals, top_human_signals, CAST(n AS INT) AS chunk_count, "
        "CAST(clear_chunk_count AS INT) AS clear_chunk_count, replace(chunk_classes, '|', ', ') AS chunk_classifications, "
        "CAST(total_lines AS BIGINT) AS total_lines, CAST(non_empty_lines AS BIGINT) AS non_empty_lines, "
        "CAST(token_count AS BIGINT) AS token_count, CAST(function_count AS BIGINT) AS function_count, "
        "CAST(loop_count AS BIGINT) AS loop_count, CAST(try_except_count AS BIGINT) AS try_except_count, "
        "CAST(max_ast_depth AS BIGINT) AS max_ast_depth, round(token_entropy, 6) AS token_entropy, "
        "round(comment_ratio, 6) AS comment_ratio FROM files"
    )
    page_select = (
        "SELECT file_id, classification, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in score_cols.split(", "))
        + ", decision_basis, CAST(token_count AS BIGINT) AS token_count, CAST(function_count AS BIGINT) AS function_count, "
        "CAST(max_ast_depth AS BIGINT) AS max_ast_depth, CAST(total_lines AS BIGINT) AS total_lines FROM files"
    )
    basic_select = (
        "SELECT file_id, CASE WHEN classification = 'AI-Generated Code' THEN 1 ELSE 0 END AS result, classification, 'javascript' AS language, "
        "round(token_entropy, 6) AS token_entropy, round(comment_ratio, 6) AS comment_ratio, "
        f"CAST(len(parts) AS INT) AS total_lines, CAST(NULL AS VARCHAR) AS error FROM files JOIN lk USING (file_id)"
    )
    errors_select = f"""SELECT file_id, 'javascript' AS language, CAST(NULL AS VARCHAR) AS error,
      CASE WHEN classification = 'AI-Generated Code' THEN 1 ELSE 0 END AS result, CAST(total_lines AS BIGINT) AS total_lines FROM files
    UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'ruby' ELSE 'javascript' END,
      CASE doc_id % 3 WHEN 0 THEN 'No code provided' WHEN 1 THEN 'Unsupported language: ruby' ELSE 'Malformed record' END, -1, -1 FROM documents"""
    stored, long_files = D.stored_files_sql(Q.DOCS_PER_FILE), D.stored_files_sql(Q.DOCS_PER_LONG_FILE)
    no_result = ", ".join(f"NULL AS {c}" for c in f"classification, {score_cols}, decision_basis, token_entropy".split(", ")) + "".join(
        f", -1 AS {c}" for c in ("chunk_count", "file_total_lines", "total_lines", "token_count"))
    stored_select = f"""SELECT file_id AS number, classification, {', '.join(f'round({c}, 6) AS {c}' for c in score_cols.split(', '))}, decision_basis, CAST(n AS INT) AS chunk_count,
      CAST(len(parts) AS INT) AS file_total_lines, CAST(total_lines AS BIGINT) AS total_lines, CAST(token_count AS BIGINT) AS token_count, round(token_entropy, 6) AS token_entropy,
      CAST(NULL AS VARCHAR) AS error FROM files JOIN lk USING (file_id)
    UNION ALL BY NAME SELECT file_id AS number, {no_result}, {D.q(K.ERR_ENCODING)} AS error FROM ({stored}) WHERE bad"""
    supported = "('python', 'javascript')"
    python_basic = basic_select.replace("'javascript'", "'python'").replace("CAST(NULL AS VARCHAR) AS error", "error") + " LEFT JOIN broken USING (file_id)"
    for name in ("classification", "round(token_entropy, 6)", "round(comment_ratio, 6)"):
        alias = name.split("(")[-1].split(",")[0]
        python_basic = python_basic.replace(f", {name}{'' if name == alias else f' AS {alias}'},", f", CASE WHEN error IS NULL THEN {name} END AS {alias},")
    python_basic = python_basic.replace("CASE WHEN classification =", "CASE WHEN error IS NOT NULL THEN -1 WHEN classification =")
    unanalysed = f"""SELECT file_id, code, language, CASE WHEN language IS NULL THEN {D.q(K.ERR_UNDETECTED)} ELSE 'Unsupported language: ' || language END AS error
      FROM ({D.resolved_corpus_sql()}) WHERE language IS NULL OR language NOT IN {supported}"""
    lines_of = lambda text: f"CAST(len(regexp_extract_all({text}, {D.q(D.LWE)})) AS INT)"
    expected = " ".join(f"WHEN {t} THEN {D.q(label or 'error')}" for t, label in TEMPLATE_EXPECTED.items())
    return {
        "chunk_code": (
            f"WITH RECURSIVE {D.chunks_ctes(DOC_SRC)}\n"
            "SELECT file_id, chunk_id, chunk_count, CAST(length(chunk) AS BIGINT) AS chunk_chars, md5(chunk) AS chunk_md5 FROM ch"
        ),
        "text_metrics": _js(
            "SELECT file_id, chunk_id, total_lines, non_empty_lines, "
            + _cols(["blank_line_ratio", "comment_ratio", "avg_line_length", "line_length_variance",
                     "line_length_uniformity", "indentation_consistency", "long_line_score"]) + " FROM js",
            DOC_SRC),
        "token_entropy": _js(
            "SELECT file_id, chunk_id, token_count, " + _cols(["token_entropy", "quote_consistency"]) + " FROM js",
            DOC_SRC),
        "keyword_trigrams": _js("SELECT file_id, chunk_id, " + _cols(["pattern_repetition_score"]) + " FROM js", DOC_SRC),
        "js_chunk_features": _js(
            "SELECT file_id, chunk_id, chunk_count, " + _cols(Q.JS_CHUNK_COLUMNS) + " FROM js", JS_CORPUS_SRC),
        "js_chunk_scores": _js(
            f"SELECT file_id, chunk_id, {', '.join(f'round({c}, 6) AS {c}' for c in score_cols.split(', '))}, "
            "classification, decision_basis, top_ai AS top_ai_signals, top_human AS top_human_signals FROM js_scored",
            JS_CORPUS_SRC, D.js_score_ctes()),
        "js_file_results": _js(file_select, JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_file_features": _js("SELECT file_id, " + ", ".join(D.JS_BOOL) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in D.JS_DOUBLE) + " FROM files",
                                JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_report": _js(D.js_report_sql(), JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_basic": _js(basic_select, JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_detailed": _js(D.js_detailed_sql(), JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_class_metrics": _js(D.CLASS_METRICS_SQL, JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes() + D.labelled_ctes()),
        "js_reliability": _js(D.reliability_sql(), JS_CORPUS_SRC, D.js_score_ctes() + D.js_file_ctes() + D.labelled_ctes()),
        "stored_files": _js(stored_select, f"SELECT file_id, code FROM ({stored}) WHERE NOT bad", D.js_score_ctes() + D.js_file_ctes()),
        "long_file_chunks": f"""SELECT * FROM (WITH RECURSIVE {D.chunks_ctes(f"SELECT file_id, code FROM ({long_files}) WHERE NOT bad")}
          SELECT file_id AS number, chunk_id, chunk_count, CAST(length(chunk) AS BIGINT) AS chunk_chars, md5(chunk) AS chunk_md5, CAST(NULL AS VARCHAR) AS error FROM ch)
          UNION ALL SELECT file_id, -1, -1, -1, NULL, {D.q(K.ERR_ENCODING)} FROM ({long_files}) WHERE bad""",
        "benchmark_snippets_js": _js(basic_select, BENCHMARK_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "conversation_stream": _js(file_select, TURNS_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "js_tuned": _js("SELECT file_id, chunk_id, total_lines, token_count, classification, decision_basis FROM js_scored",
                        DOC_SRC, D.js_score_ctes(lines=2, tokens=10, signal=0.4, margin=0.1), target=900, tail=200),
        "js_weight_sets": _js(
            f"SELECT weight_set, file_id, chunk_id, {', '.join(f'round({c}, 6) AS {c}' for c in score_cols.split(', '))}, "
            "classification, decision_basis, top_ai AS top_ai_signals, top_human AS top_human_signals FROM js_scored",
            DOC_SRC, D.weight_set_ctes(Q.weight_rows(), [c for c in D.JS_FEATURE_COLUMNS if c != "module_pattern"])),
        "input_errors": _js(errors_select, DOC_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "page_scripts": _js(page_select, PAGES_SRC, D.js_score_ctes() + D.js_file_ctes()),
        "detect_language": (
            f"SELECT file_id, language, CASE WHEN language IS NULL THEN {D.q(K.ERR_UNDETECTED)} "
            f"WHEN language NOT IN {supported} THEN 'Unsupported language: ' || language END AS error "
            f"FROM ({D.resolved_corpus_sql()})"
        ),
        "py_text_features": PY.chunk_query(f"SELECT file_id, chunk_id, {PY.rounded(Q.PY_TEXT_COLUMNS)} FROM pyt", PY_CORPUS_SRC, PY.text_ctes()),
        "py_token_stats": PY.chunk_query(
            "SELECT ch.file_id, ch.chunk_id, CAST(coalesce(token_count, 0) AS BIGINT) AS token_count, round(coalesce(token_entropy, 0.0), 6) AS token_entropy "
            "FROM ch LEFT JOIN pts ON pts.file_id = ch.file_id AND pts.chunk_id = ch.chunk_id", PY_CORPUS_SRC, PY.token_ctes()),
        "py_structure": PY.chunk_query(f"SELECT file_id, chunk_id, {PY.rounded(PY.STRUCTURE_COLUMNS)} FROM pst", PY_CORPUS_SRC, PY.token_ctes() + PY.structure_ctes()),
        "py_file_results": PY.results_sql(f"SELECT * FROM ({D.resolved_corpus_sql()}) WHERE language = 'python'"),
        "basic": _all_files(basic_select, python_basic) + f" UNION ALL BY NAME SELECT file_id, -1 AS result, language, {lines_of('code')} AS total_lines, error FROM ({unanalysed})",
        "report": _all_files(D.js_report_sql(), " UNION ALL ".join(f"({part} WHERE file_id NOT IN (SELECT file_id FROM broken))" for part in D.js_report_sql("python").split(" UNION ALL "))),
        "errors": f"SELECT file_id, language, error FROM ({unanalysed}) UNION ALL SELECT file_id, 'python', error FROM ("
        + PY.chunk_query("SELECT file_id, error FROM broken", PY_CORPUS_SRC, PY.feature_ctes()) + ")",
        "evaluate": f"""SELECT expected_classification, predicted_classification, count(*) AS files FROM (
          SELECT file_id, CASE template {expected} END AS expected_classification FROM ({D.corpus_sql()})) LEFT JOIN (
          SELECT file_id, 'error' AS predicted_classification FROM ({unanalysed}) UNION ALL {_all_files('SELECT file_id, classification AS predicted_classification FROM files',
            "SELECT file_id, CASE WHEN error IS NULL THEN classification ELSE 'error' END AS predicted_classification FROM files LEFT JOIN broken USING (file_id)")}) USING (file_id) GROUP BY ALL""",
        "benchmark_snippets": PY.file_query(basic_select.replace("'javascript'", "'python'"), BENCHMARK_SRC),
    } | (LLM.oracle_sql() if LLM else {})
