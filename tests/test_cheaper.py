"""Loops are counted from the keywords found already, a pattern is spared where its words are not, lines are counted where they are cut."""

import random

from pyspark.sql import functions as F

from quillscope.functions import constants as K
from quillscope.functions.chunking import with_chunks
from quillscope.functions.regex import java_regex
from quillscope.operators.features import chunk_features, chunk_metrics
from snippets import AI_JAVASCRIPT, HUMAN_JAVASCRIPT


def test_loops_are_counted_from_the_keywords(spark):
    assert "for|while|do" not in str(chunk_features(("javascript",)))
    rng = random.Random(32)
    parts = ["for", "while", "do", " ", "(", "$", "é", "1", "_", "\n", "format", "redo", "const a"]
    codes = [AI_JAVASCRIPT, HUMAN_JAVASCRIPT, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(400))]
    df = spark.createDataFrame([([c],) for c in codes], "chunks array<string>")
    rows = df.select(chunk_metrics("javascript", ["loop_count"])[0]["loop_count"].alias("n"), F.regexp_count(F.col("chunks")[0], F.lit(java_regex(*K.JS_PATTERNS["loop"]))).alias("m")).collect()
    assert all(r.n == r.m for r in rows) and {r.n for r in rows} >= {0, 1, 2}


def test_typescript_is_looked_for_only_where_its_words_are(spark):
    pattern = java_regex(*K.JS_PATTERNS["typescript"])
    codes = ["/** @param {x} a */", "@returns{", "a: string", "a:number", "b : boolean", "interface A", "interfaceA", "a ? b : c", "strings", "@param x", ""]
    df = spark.createDataFrame([([c],) for c in codes], "chunks array<string>")
    rows = df.select(chunk_metrics("javascript", ["uses_typescript_patterns"])[0]["uses_typescript_patterns"].alias("n"), F.col("chunks")[0].rlike(pattern).alias("m")).collect()
    assert [r.n for r in rows] == [r.m for r in rows] and {r.m for r in rows} == {True, False}


def test_lines_are_counted_where_they_are_cut(spark):
    rows = [(1, "a\r\nb\x85c", True), (2, "", True), (3, "x\n" * 3000, True), (4, "r\n\n", False), (5, None, False), (6, "\n", True)]
    df = spark.createDataFrame(rows, "file_id long, code string, ok boolean")
    got = {r.file_id: (r.n, len(r.chunks)) for r in with_chunks(df, enabled=F.col("ok"), total="n").collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: None if t is None else len(t.splitlines()) for i, t, _ in rows}
    assert got[3][1] == 3 and got[1][1] == 1
