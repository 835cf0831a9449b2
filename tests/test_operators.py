"""Single operators against brute-force plain-Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

import plain
from quillscope.functions import constants as K
from quillscope.functions.chunking import with_chunks
from quillscope.functions.regex import java_regex
from quillscope.functions.text import entropy, line_count, pattern_repetition, round_even, split_lines
from quillscope.operators.features import _count, brace_depth, js_comment_lines

EDGE = [
    "", "a", "a\n", "\n\n\n", "x\r\ny\rz\x85w q ", "  \n \t\n", "a" * 5000,
    ("line of text\n" * 400), ("b" * 2199 + "\n") * 3 + "c" * 499, ("b" * 2199 + "\n") * 3 + "c" * 500,
    "\x1c\x1d", "a\x1cb\x1fc\x0bd\x0ce", "   \n　\n", "éfoo\nfooé\n",
]


def _random_text(rng, n):
    alphabet = "ab {}()/*'\"`\\\n\r\t;:,=>." + "é" + " "
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_chunking_matches_greedy_model(spark):
    rng = random.Random(7)
    texts = EDGE + [("x" * rng.randint(1, 400) + "\n") * rng.randint(1, 40) for _ in range(60)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts += [r.text for r in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, code string")
    got = {r.file_id: list(r.chunks) for r in with_chunks(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain.chunks_by_sums(t), i


def test_split_lines_matches_str_splitlines(spark):
    rng = random.Random(3)
    texts = EDGE + [_random_text(rng, rng.randint(0, 80)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(split_lines(F.col("t")).alias("l"), line_count(F.col("t")).alias("n")).collect()
    assert [list(r.l) for r in rows] == [t.splitlines() for t in texts]
    assert [r.n for r in rows] == [len(t.splitlines()) for t in texts]


def test_brace_depth_and_comment_lines(spark):
    rng = random.Random(11)
    texts = ["/*/ { */ {", "'\\'{'", "`a{`{", "// {\n{", '"\\\\"{', "{{}}}}{{{"]
    texts += [_random_text(rng, rng.randint(0, 120)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(brace_depth(F.col("t")).alias("d"), js_comment_lines(split_lines(F.col("t"))).alias("c")).collect()
    for t, r in zip(texts, rows):
        assert r.d == plain.deepest_brace(t), t
        assert r.c == plain.comment_line_count(t), t


def test_entropy_and_trigrams(spark):
    rng = random.Random(5)
    seqs = [[rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s array<string>")
    rows = df.select(entropy(F.col("s")).alias("e"), pattern_repetition(F.col("s")).alias("p")).collect()
    for s, r in zip(seqs, rows):
        assert r.e == pytest.approx(plain.entropy(s), abs=1e-12)
        assert r.p == pytest.approx(plain.trigram_repetition(s), abs=1e-12)


@pytest.mark.parametrize("table", ["py", "js"])
def test_translated_patterns_count_like_python_re(spark, table):
    patterns = K.PY_PATTERNS if table == "py" else K.JS_PATTERNS
    rng = random.Random(13)
    words = ["TODO", "todo", "fixme", "print (", "example", "sample_x", "demo", "foo", "éfoo", "fooé", "# if",
             "// var", "function (", "function f (", "=>", "$(", "jQuery (", "console.log(", "alert(", "eval (",
             "var  ", "debugger", "your-", "my_", "mock", "exampleData", "module.exports", "import x from y",
             "export default", "{", "}", "\n", " ", " ", "\t", "@param {", ": string", "interface X", "`a${b}`",
             "const [a] =", "(function () {", "use strict", "'", '"', "require('jquery')", "\x1c", "ſ", "K",
             "module.exports", "exports.x", "process.env", "__dirname", "useState(", "className=", "await ",
             "async", "let {a} =", "`", "do", "while", "for", "try", "print(", "breakpoint (", "#", "React.x",
             "import a from 'b'", "export const", "jsx", "@returns {"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = list(patterns)
    # through the production helper, so the literal gates are checked too
    cols = [_count(n, patterns, F.col("t")).alias(n) for n in names]
    rows = df.select(*cols).collect()
    flag_map = {"I": re.IGNORECASE, "M": re.MULTILINE, "S": re.DOTALL}
    for t, r in zip(texts, rows):
        for n in names:
            p, f = patterns[n]
            flags = 0
            for ch in f:
                flags |= flag_map[ch]
            assert r[n] == len(re.findall(p, t, flags)), (n, t)


def test_js_tokens_like_python_re(spark):
    rng = random.Random(17)
    texts = [_random_text(rng, rng.randint(0, 100)) + " x1 2.5 === ... $a" for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.regexp_extract_all(F.col("t"), F.lit(java_regex(K.JS_TOKEN)), 0).alias("k")).collect()
    for t, r in zip(texts, rows):
        assert list(r.k) == re.findall(K.JS_TOKEN, t)


def test_chunking_over_fold_blocks(spark):
    """Files of several fold blocks, and lines longer than a chunk."""
    rng = random.Random(23)
    texts = ["".join("y" * rng.choice([0, 1, 3, 40, 90, 2500]) + "\n" for _ in range(n)) for n in (1023, 1024, 1025, 2048, 3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, code string")
    got = {r.file_id: list(r.chunks) for r in with_chunks(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain.chunks_by_sums(t), i


def test_chunking_time_grows_with_the_file(spark):
    """Twice the file, about twice the time; four times would be 4."""
    import time

    line = "some words of a line of code that is not too short\n"
    took = []
    for mb in (1, 4, 16):
        df = spark.createDataFrame([(line * (mb * 20_000),)], "code string").cache()
        df.count()
        with_chunks(df).select(F.size("chunks")).collect()
        start = time.perf_counter()
        assert with_chunks(df).select(F.size("chunks").alias("n")).first().n > mb * 400
        took.append(time.perf_counter() - start)
    assert took[2] < 3 * 4 * max(took[1], 0.3), took


def test_fixed_rounds_exact_values(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from quillscope.plans.outputs import fixed

    rng = random.Random(29)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 12.25, 12.75, 88.85, 15.25, 99.95, 100.0, 1.005, 2.675, 0.125, 0.375, 4.0, 3.999, 7.95]
    values += [round(rng.random(), 4) * 100 for _ in range(500)] + [rng.random() * 6 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", fixed(F.col("v"), 1).alias("a"), fixed(F.col("v"), 2).alias("b")).collect()
    for r in rows:
        if r.v is None:
            assert r.a is None and r.b is None
        else:
            assert r.a == str(Decimal(r.v).quantize(Decimal("0.1"), ROUND_HALF_UP)) and r.b == str(Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_round_even_is_python_round(spark):
    """10^6 doubles: of all sizes, planted ties, and their neighbours."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 250_000
    ties = (rng.integers(-(10**8), 10**8, n) * 2 + 1) / 32.0  # five binary places: many exact ties at four digits
    near = np.nextafter((rng.integers(-(10**9), 10**9, n) + 0.5) / 1e4, rng.choice([-np.inf, np.inf], n))
    values = np.concatenate([rng.standard_normal(n) * 10.0 ** rng.integers(-8, 10, n), ties, near, (rng.integers(-(10**6), 10**6, n) + 0.5) / 1e4, [3.6062499999999997, 3.60625, 0.0, 2.0**38, -1e300]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = np.array([r[0] for r in df.select(round_even(F.col("v"))).collect()])
    want = np.array([round(float(v), 4) for v in values])
    assert (got == want).all(), values[got != want][:5]


def test_sql_rounding_is_the_same():
    import duckdb

    from quillscope.oracle.duck import round4

    values = [3.6062499999999997, 3.60625, 3.60635, -0.00005, 0.00015, 1.00005, 2.00015, 0.03125, 0.09375, -3.60625]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {round4('?')}", [v]).fetchone()[0] for v in values] == [round(v, 4) for v in values]
