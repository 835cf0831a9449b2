"""The detector's own behavioural checks, on hand-written snippets."""

import json

import pytest
from pyspark.sql import functions as F

from quillscope import detect
from quillscope.functions import constants as K
from quillscope.plans.outputs import to_basic, to_detailed, to_report
from snippets import AI_JAVASCRIPT, AI_PYTHON, HUMAN_JAVASCRIPT, HUMAN_PYTHON, LOW_SIGNAL_PYTHON


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (1, None, "python", AI_PYTHON),
        (2, None, "python", HUMAN_PYTHON),
        (3, None, "javascript", AI_JAVASCRIPT),
        (4, None, "javascript", HUMAN_JAVASCRIPT),
        (5, None, "python", LOW_SIGNAL_PYTHON),
        (6, "notes.rb", None, "puts 1"),
        (7, None, "cobol", "DISPLAY 'HI'."),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, language string, code string")
    out = detect(df).cache()
    return {r.file_id: r for r in out.collect()}, out


def test_ai_like_python(results):
    r = results[0][1]
    assert r.classification == K.AI_LABEL
    assert r.ai_score > r.human_score
    assert r.confidence > 0.6


def test_human_like_python(results):
    r = results[0][2]
    assert r.classification == K.HUMAN_LABEL
    assert r.human_score > r.ai_score
    assert "todo comment score" in r.top_human_signals


def test_ai_like_javascript(results):
    r = results[0][3]
    assert r.classification == K.AI_LABEL
    assert r.function_count > 0
    assert r.token_entropy > 0


def test_human_like_javascript(results):
    r = results[0][4]
    assert r.classification == K.HUMAN_LABEL
    assert r.uses_jquery
    assert r.human_score > r.ai_score


def test_low_signal_python(results):
    r = results[0][5]
    assert r.classification == K.UNCERTAIN_LABEL
    assert r.decision_basis == K.BASIS_LOW
    assert r.result == 0


def test_language_errors_keep_rows(results):
    assert results[0][6].error == K.ERR_UNDETECTED and results[0][6].classification is None
    assert results[0][7].error == "Unsupported language: cobol"


def test_basic_detailed_report(results):
    out = results[1]
    basic = {r.file_id: r for r in to_basic(out).collect()}
    assert basic[1].result == 1 and basic[2].result == 0
    assert basic[2].total_lines == len(HUMAN_PYTHON.splitlines())
    detailed = {r.file_id: r for r in to_detailed(out, as_json=True).collect()}
    feats = json.loads(detailed[1].features)
    assert feats["confidence"] == results[0][1].confidence and "has_main_guard" in feats
    report = to_report(out, detailed=True).where(F.col("file_id") == 1).orderBy("position").collect()
    props = [r.property for r in report]
    assert props[:3] == ["Classification", "Language", "Confidence"] and "Max AST Depth" in props
    assert report[2].value.endswith("%")
    basic_report = to_report(out, detailed=False).where(F.col("file_id") == 1).collect()
    assert [r.value for r in basic_report if r.property == "Confidence"] != []


def test_detect_language_by_path_and_content(spark):
    from quillscope import detect_language

    rows = [("x.PY", "const a = 1;"), ("a/b.tsx", "def f(): pass"), (None, AI_PYTHON), (None, AI_JAVASCRIPT), ("noext", AI_PYTHON), (None, "..."), (None, None)]
    df = spark.createDataFrame(rows, "path string, code string")
    assert [r[0] for r in df.select(detect_language(F.col("code"), F.col("path"))).collect()] == ["python", "javascript", "python", "javascript", "python", None, None]
    assert [r[0] for r in df.select(detect_language(F.col("code"))).collect()][2:4] == ["python", "javascript"]
