"""Documents are dealt out before files are made of them, and patterns that ignore case are spared where they cannot match."""

import pytest
from pyspark.sql import functions as F

from quillscope.functions import constants as K
from quillscope.operators.features import FOLDED_LITERALS, _count, _folded
from quillscope.plans import queries as Q
from quillscope.sources.corpus import code_files

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [Q.q_js_file_features, Q.q_js_report, Q.q_js_detailed, Q.q_py_text_features, Q.q_detailed, Q.q_errors])
def test_the_corpus_is_rendered_after_the_exchange(spark, query):
    plan = plan_of(query(spark, SF))
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") > plan.rindex("md5(")  # what is lower in the plan runs earlier


def test_bad_copies_are_made_after_the_exchange(spark):
    plan = plan_of(Q.q_input_errors(spark, SF))
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("inline(")


def test_expected_classes_need_no_rendered_code(spark):
    assert "md5(" not in plan_of(code_files(spark, SF, ("file_id", "template")))
    whole = code_files(spark, SF).select("file_id", "template")
    assert sorted(code_files(spark, SF, ("file_id", "template")).collect()) == sorted(whole.collect())
    assert plan_of(Q.q_evaluate(spark, SF)).count("md5(") == plan_of(Q.q_errors(spark, SF)).count("md5(")


WORDS = ["foo", "BAR", "Example", "sampleData", "demo_x", "my-", "my_", "TODO", "insert", "mock", "helper", "example usage", "bug", "refactor", "barely"]
ODD = ["ſample", "mocK", "İnsert", "Fıxme", "tutorİal", "// FİXME", "# ı", "ſome_"]


@pytest.mark.parametrize("table", [K.JS_PATTERNS, K.PY_PATTERNS])
def test_spared_patterns_count_alike(spark, table):
    texts = [f"{mark} {w} é {w}\n{w}" for w in WORDS + ODD for mark in ("", "//", "#", "x")] + ["", None, "plain text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    both = df.select("t", *[F.struct(_count(k, table, t).alias("a"), _count(k, table, t, _folded(t)).alias("b")).alias(k) for k in FOLDED_LITERALS[id(table)]])
    for row in both.collect():
        for k in FOLDED_LITERALS[id(table)]:
            assert (row[k].a or 0) == (row[k].b or 0), (k, row.t)


def test_no_other_character_passes_for_an_ascii_letter(spark):
    chars = [(chr(c),) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame(chars, "c string").where(F.col("c").rlike("(?U)(?i)^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$")).collect()
    assert {r.c for r in found} <= {"İ", "ı", "ſ", "K"}
