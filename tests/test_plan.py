"""Physical plan shape of `detect` (what the scale argument relies on)."""

import re

import pytest

from quillscope import detect
from quillscope.plans import queries as Q
from quillscope.plans.queries import documents_as

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("languages", [("javascript",), ("python", "javascript")])
def test_detect_exchanges_only_to_spread(spark, spread, languages):
    plan = plan_of(detect(documents_as(spark, "/root/testdata/sf0.1", "javascript"), spread=spread, languages=languages))
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)", plan)
    assert len(exchanges) == spread and all(e[1].startswith("_row#") for e in exchanges), plan
    assert not re.search("Aggregate|Join|CartesianProduct|Sort", plan)
    # the scan reads only the two columns the job needs
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert sorted(c.split("#")[0] for c in scan.split(",")) == ["doc_id", "text"]


def test_filters_on_results_do_not_repeat_the_features(spark):
    found = detect(documents_as(spark, SF, "javascript"), languages=("javascript",))
    plain, filtered = plan_of(found), plan_of(found.where("error is null and ai_score > 0"))
    assert filtered.count("regexp_extract_all") == plain.count("regexp_extract_all")


def test_python_stage_once_or_not_at_all(spark):
    assert plan_of(detect(documents_as(spark, SF, "python"))).count("ArrowEvalPython") == 1
    for query in (Q.q_js_file_results, Q.q_js_chunk_scores, Q.q_page_scripts, Q.q_text_metrics):
        assert "Python" not in plan_of(query(spark, SF))


def test_corpus_is_lazy(spark):
    plan = plan_of(Q.q_js_file_results(spark, SF))
    assert "ExistingRDD" not in plan and plan.count("FileScan parquet") == 1
    assert plan.count("md5(") <= 2  # each branch of the template expression stands once
