"""Work that grows with the code is done once: patterns of a chunk, the language of a file, a line of the corpus, a batch of syntax."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillscope.functions import constants as K
from quillscope.functions import pysyntax, pytables
from quillscope.functions.chunking import lines_keepends
from quillscope.functions.language import _found
from quillscope.functions.regex import ecma_regex, java_regex
from quillscope.operators.features import JS_NAME_ARROW_REGEX, STARTS, chunk_features
from quillscope.plans.detect import detect
from quillscope.sources.corpus import render
from snippets import AI_JAVASCRIPT, AI_PYTHON, HUMAN_JAVASCRIPT


def test_every_pattern_of_a_chunk_is_run_once(spark):
    for language, table in (("javascript", K.JS_PATTERNS), ("python", K.PY_PATTERNS)):
        text = str(chunk_features((language,)))
        for name, (pattern, flags) in table.items():
            regex = java_regex(pattern, flags, STARTS[id(table)].get(name, ""))
            assert text.count(f", {regex}, ") + text.count(f", {regex})") <= 1, name


def test_the_language_of_a_file_is_resolved_once(spark):
    files = spark.createDataFrame([(1, None, AI_JAVASCRIPT)], "file_id long, path string, code string")
    plan = detect(files, spread=True, languages=("javascript",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__main__") == 1


def test_a_line_of_the_corpus_is_made_once():
    assert render("spark").count("'_')") == 1
    assert render("duckdb").count("'_', 'g')") == 2


def test_line_start_patterns_are_found_as_before(spark):
    rng = random.Random(8)
    parts = ["import a from 'b'", "from a import", "def f (", "class A", "    x", " ", "\n", "\r", " ", "\x85", "\t\t\t\t\ty", "const a =", "let b=", "var c =", "function g(", "export ", "é", "{"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*K.DETECT_PYTHON, *K.DETECT_JAVASCRIPT]
    found = df.select(*(F.array(_found(F.col("t"), p, f), F.col("t").rlike(ecma_regex(p, f))).alias(f"p{i}") for i, (p, f) in enumerate(patterns))).collect()
    assert all(a == b for row in found for a, b in row)
    assert {a for row in found for a, _ in row} == {True, False}


def test_lines_keep_their_ends(spark):
    rng = random.Random(9)
    texts = ["", "\n", "\r\n", "\r\r\n\n", *("".join(rng.choice("ab\n\r\x0b\x1c\x85  　") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lines_keepends(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [t.splitlines(keepends=True) for t in texts]


def test_arrow_names_are_found_as_before(spark):
    texts = ["a => b", "x$y\t=> 1, (b) => c, é_a=>d, 1a => e, a b => c =>", HUMAN_JAVASCRIPT, AI_JAVASCRIPT]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(*(F.regexp_extract_all("t", F.lit(r), 1) for r in (JS_NAME_ARROW_REGEX, java_regex(K.JS_NAME_ARROW)))).collect()
    assert all(a == b for a, b in rows) and rows[0][0] == ["a"]


def test_syntax_leaves_the_worker_in_bounded_pieces(monkeypatch):
    codes = [None, *(f"x{i} = 1\n" * 20 for i in range(300))]
    monkeypatch.setattr(pysyntax, "PIECE_CHARS", 1000)
    pieces = list(pysyntax.in_pieces(pa.array(codes), len))
    assert [c for p in pieces for c in p] == codes
    assert max(sum(len(c or "") for c in p[:-1]) for p in pieces) < 1000 < len(pieces) * 1000
    found = list(pysyntax._examine_batches.func(iter([pa.array([None if c is None else [c] for c in codes])])))
    assert len(found) > 10 and sum(map(len, found)) == len(codes)
    assert [len(f[0]["tokens"]) if f else None for a in found for f in a.to_pylist()] == [None, *[60] * 300]


@pytest.mark.parametrize("table", ["nodes", "tokens", "token_counts"])
def test_syntax_tables_are_made_without_a_call_per_row(spark, table):
    chunks = spark.createDataFrame([(1, AI_PYTHON), (1, AI_PYTHON), (2, "x = ("), (3, None)], "file_id long, chunk string")
    found = getattr(pytables, table)(chunks)
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
    n = {r.file_id: r["count"] for r in found.groupBy("file_id").count().collect()}
    tokens = pysyntax.token_strings(AI_PYTHON)
    assert n[3] == 1 and (table == "nodes" or n[1] == 2 * len(tokens if table == "tokens" else set(tokens)))
