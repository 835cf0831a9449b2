"""Evaluation against labels that no template gives, and the queries over stored files and detailed output."""

import math
import random

import duckdb
import pytest
from conftest import SF_SMALL

from quillscope.functions import constants as K
from quillscope.operators.evaluate import class_metrics, reliability

CLASSES = (K.AI_LABEL, K.HUMAN_LABEL, K.UNCERTAIN_LABEL)


def _tables(spark, rows):
    predictions = spark.createDataFrame([(i, c, p) for i, c, p, _, _ in rows], "file_id long, classification string, ai_probability double")
    expected = spark.createDataFrame([(i, e, h) for i, _, _, e, h in rows if e], "file_id long, expected_classification string, held_out boolean")
    return predictions, expected


def _rows(n=400):
    rnd = random.Random(5)
    # A third of all files has one probability; some failed, some have no label.
    return [
        (i, rnd.choice((*CLASSES, None)), 0.5 if i % 3 == 0 else round(rnd.random(), 4) if i % 11 else None, rnd.choice((*CLASSES[:2], None)), rnd.random() < 0.25)
        for i in range(n)
    ]


def test_class_metrics(spark):
    rows = _rows()
    found = {(r["held_out"], r["class"]): r for r in class_metrics(*_tables(spark, rows), by=("held_out",)).collect()}
    seen = set()
    for held in (False, True):
        pairs = [(e, c or "error") for _, c, _, e, h in rows if e and h == held]
        for cls in {x for p in pairs for x in p}:
            r, hits = found[held, cls], pairs.count((cls, cls))
            expected, predicted = sum(e == cls for e, _ in pairs), sum(c == cls for _, c in pairs)
            assert (r["as_expected"], r["as_predicted"], r["hits"]) == (expected, predicted, hits)
            assert r["precision"] == (hits / predicted if predicted else None) and r["recall"] == (hits / expected if expected else None)
            assert r["f1"] == pytest.approx(2 * hits / (expected + predicted))
            seen.add((held, cls))
    assert seen == set(found)


def test_reliability(spark):
    rows = _rows()
    found = {r["bin"]: r for r in reliability(*_tables(spark, rows)).collect()}
    scored = sorted((p, e == K.AI_LABEL) for _, _, p, e, _ in rows if e and p is not None)
    bins = {}
    for p, hit in scored:
        bins.setdefault(10 * sum(q < p for q, _ in scored) // len(scored), []).append((p, hit))
    assert set(bins) == set(found) and sum(r["files"] for r in found.values()) == len(scored)
    for at, members in bins.items():
        r = found[at]
        assert (r["files"], r["low"], r["high"]) == (len(members), members[0][0], members[-1][0])
        assert r["mean_probability"] == pytest.approx(sum(p for p, _ in members) / len(members))
        assert r["share"] == pytest.approx(sum(h for _, h in members) / len(members))


def test_empty_evaluation(spark):
    predictions, expected = _tables(spark, _rows(4))
    assert class_metrics(predictions, expected.limit(0)).count() == 0
    assert reliability(predictions.limit(0), expected).count() == 0


@pytest.mark.parametrize("name", ["stored_files", "js_detailed", "js_class_metrics", "js_reliability"])
def test_queries_against_sql(spark, name):
    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = con.sql(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda d: sorted(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in row) for row in d[cols].itertuples(index=False))
    assert len(got) > 0 and norm(got) == norm(want)
    if name == "stored_files":
        assert got["error"].notna().any() and got["error"].isna().any()
