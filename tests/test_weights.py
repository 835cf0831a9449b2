"""Weights given as a table."""

import pytest
from pyspark.sql import functions as F

from quillscope import chunk_results, detect
from quillscope.functions import constants as K
from quillscope.operators import scoring
from quillscope.plans.queries import HOUSE_WEIGHTS
from snippets import AI_JAVASCRIPT, AI_PYTHON, HUMAN_JAVASCRIPT, HUMAN_PYTHON, LOW_SIGNAL_PYTHON

SCHEMA = "weight_set string, language string, side string, feature string, weight double, position int"
DEFAULTS = {("python", "ai"): K.PY_AI_WEIGHTS, ("python", "human"): K.PY_HUMAN_WEIGHTS, ("javascript", "ai"): K.JS_AI_WEIGHTS, ("javascript", "human"): K.JS_HUMAN_WEIGHTS}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "python", AI_PYTHON), (2, "python", HUMAN_PYTHON), (3, "javascript", AI_JAVASCRIPT), (4, "javascript", HUMAN_JAVASCRIPT), (5, "python", LOW_SIGNAL_PYTHON), (6, "ruby", "puts 1"), (7, "python", None), (8, "javascript", (HUMAN_JAVASCRIPT + AI_JAVASCRIPT) * 4)]
    return spark.createDataFrame(rows, "file_id long, language string, code string")


def rows_of(sets):
    return [(name, lang, side, f, w, i) for name, table in sets.items() for (lang, side), ws in table.items() for i, (f, w) in enumerate(ws.items())]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_default_weights_as_a_table_change_nothing(spark, files, monkeypatch, broadcast):
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", broadcast)
    other = {k: {f: 1.0 for f in ws} for k, ws in DEFAULTS.items()}
    weights = spark.createDataFrame(rows_of({"default": DEFAULTS, "flat": other}), SCHEMA)
    plain = detect(files)
    found = detect(files, weights=weights)
    own = found.where("weight_set = 'default' or error is not null").select(plain.columns).distinct()
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
    assert found.where("weight_set = 'flat' and error is null").count() == plain.where("error is null").count()
    assert found.where("file_id = 6").count() == 1  # an error row has no set of its language


def test_chunk_scores_of_a_set_by_hand(spark, files):
    """Unknown features count nothing, flags count one, a side without weights scores zero, of repeated entries the last holds."""
    rows = [("house", "JavaScript", side, f, w, i) for side, ws in HOUSE_WEIGHTS.items() for i, (f, w) in enumerate(ws.items())]
    rows += [("house", "javascript", "AI", "generic_example_score", 3.0, 99), ("one", "javascript", "human", "comment_ratio", 2.0, 0)]
    chunks = chunk_results(files.where("language = 'javascript'"), languages=("javascript",), weights=spark.createDataFrame(rows, SCHEMA)).collect()
    ai = HOUSE_WEIGHTS["ai"] | {"generic_example_score": 3.0}
    ai = {f: ai[f] for f in [*(f for f in ai if f != "generic_example_score"), "generic_example_score"]}
    assert {r.weight_set for r in chunks} == {"house", "one"}
    for r in chunks:
        weights = (ai, HOUSE_WEIGHTS["human"]) if r.weight_set == "house" else ({}, {"comment_ratio": 2.0})
        parts = [[(float(r[f] or 0) * w, f) for f, w in ws.items() if f in r.asDict()] for ws in weights]
        for total, top, part in zip((r.ai_score, r.human_score), (r.top_ai_signals, r.top_human_signals), parts, strict=True):
            assert total == pytest.approx(sum(c for c, _ in part), abs=1e-4)
            assert top == [f.replace("_", " ") for c, f in sorted(part, reverse=True) if c > 0][:3]


def test_an_empty_table_of_weights(spark, files):
    found = detect(files, weights=spark.createDataFrame([], SCHEMA)).collect()
    assert len(found) == 8 and all(r.weight_set is None for r in found)
    assert all(r.ai_score == 0.0 and r.classification == K.UNCERTAIN_LABEL for r in found if r.error is None)


def test_features_are_computed_once_for_all_sets(spark, files):
    weights = spark.createDataFrame(rows_of({"a": DEFAULTS, "b": DEFAULTS}), SCHEMA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one, two = detect(files), detect(files, weights=weights)
    assert plan(two).count("ArrowEvalPython") == plan(one).count("ArrowEvalPython") == 1
    assert plan(two).count("regexp_extract_all") == plan(one).count("regexp_extract_all")
