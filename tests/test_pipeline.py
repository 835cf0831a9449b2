"""File aggregation (L1-L10), Python structure, error rows, entry contract."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import plain
from quillscope import chunk_results, detect
from quillscope.functions import constants as K
from quillscope.operators.aggregate import WEIGHTED_MEAN_FIELDS
from quillscope.operators.features import BOOL_FEATURES, SUM_FEATURES
from quillscope.sources.corpus import code_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus_results(spark):
    files = code_files(spark, SF)
    chunks = chunk_results(files).cache()
    results = detect(files).cache()
    return files, chunks, results


def test_multi_chunk_aggregation_matches_rules(corpus_results):
    _, chunks, results = corpus_results
    by_file = {}
    for r in chunks.where(F.col("chunk_count") > 1).collect():
        by_file.setdefault(r.file_id, []).append(r)
    assert by_file, "corpus must contain multi-chunk files"
    files = {r.file_id: r for r in results.collect()}
    for fid, rows in by_file.items():
        f = files[fid]
        if f.error is not None:
            assert f.chunk_count is None and any(r.chunk_error for r in rows)
            continue
        rows.sort(key=lambda r: r.chunk_id)
        w = [max(r.signal_strength, 0.5) * max(float(r.non_empty_lines), 1.0) for r in rows]
        for c in WEIGHTED_MEAN_FIELDS:
            if rows[0][c] is None:
                continue
            want = round(sum(r[c] * x for r, x in zip(rows, w)) / sum(w), 4)
            assert f[c] == pytest.approx(want, abs=1e-9), (fid, c)
        for c in SUM_FEATURES:
            assert f[c] == sum(r[c] for r in rows)
        assert f.max_ast_depth == max(r.max_ast_depth for r in rows)
        for c in BOOL_FEATURES:
            if rows[0][c] is not None:
                assert f[c] == any(r[c] for r in rows)
        clear = sum(1 for r in rows if r.decision_basis == K.BASIS_CLEAR)
        assert f.clear_chunk_count == clear
        assert list(f.chunk_classifications) == [r.classification for r in rows]
        if clear == 0 or abs(f.score_gap) < K.FILE_MINIMUM_GAP:
            want_class = K.UNCERTAIN_LABEL
        elif f.ai_probability >= K.FILE_AI_PROBABILITY:
            want_class = K.AI_LABEL
        elif f.ai_probability <= K.FILE_HUMAN_PROBABILITY:
            want_class = K.HUMAN_LABEL
        else:
            want_class = K.UNCERTAIN_LABEL
        assert f.classification == want_class
        assert list(f.top_ai_signals) == plain.top_signals_over_chunks([r.top_ai_signals for r in rows])
        assert list(f.top_human_signals) == plain.top_signals_over_chunks([r.top_human_signals for r in rows])
        assert f.module_pattern is None


def test_single_chunk_pass_through(corpus_results):
    _, chunks, results = corpus_results
    one = {r.file_id: r for r in chunks.where(F.col("chunk_count") == 1).collect()}
    for f in results.where(F.col("chunk_count") == 1).collect():
        c = one[f.file_id]
        assert f.classification == c.classification and f.token_entropy == c.token_entropy
        assert list(f.top_ai_signals) == list(c.top_ai_signals)


def test_python_structure_by_template(corpus_results):
    files, chunks, results = corpus_results
    t = {r.file_id: r.template for r in files.select("file_id", "template").collect()}
    res = {r.file_id: r for r in results.collect()}
    seen, guarded = set(), 0
    for fid, tpl in t.items():
        r = res[fid]
        seen.add((tpl, r.chunk_count))
        if tpl == 0:
            # a long first line, as a comment in the middle, can cut the template in two chunks
            assert r.has_docstrings and r.uses_type_hints and r.uses_comprehensions and r.function_count == 3
            guarded += r.has_main_guard
        elif tpl == 1:
            assert r.bare_except_score > 0 and r.has_magic_numbers and r.has_todo_comments
        elif tpl == 7:
            assert r.function_count == 0 and (r.parseable is False or r.chunk_count > 1)
        elif tpl == 9:
            assert r.error is not None and r.error.startswith("IndentationError") and r.classification is None
        elif tpl == 11:
            assert r.error == K.ERR_UNSUPPORTED.format("ruby") or r.error == K.ERR_UNDETECTED
        if r.language == "python":
            assert r.python_version.startswith("3.")
    assert guarded > 5
    assert {0, 1, 5, 7, 9, 11} <= {k for k, _ in seen}
    six = chunks.join(files.where("template = 6").select("file_id"), "file_id").orderBy("file_id", "chunk_id").collect()
    assert six and all(bool(r.parseable) == (not r.chunk.startswith("    ")) for r in six if "v_" not in r.chunk)


def test_any_change_of_a_text_changes_its_file(spark, tmp_path):
    texts = ["One two, three\nfour five six.", "One two, three\nfour five six!", "One two, thrée\nfour five six.", "One two, three\nfour five seven."]
    for k in range(12):
        rows = [(k + 12 * i * 2, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert code_files(spark, f"{tmp_path}/{k}").select("code").distinct().count() == 12  # three files of each text


def test_bad_input_keeps_its_row(spark):
    rows = [(1, "python", None, None), (1, "python", "a = 1\n", None), (1, "python", "a = 1\n", None), (None, "python", "b = 2\n", None),
            (None, None, None, "not json"), (2, "javascript", None, None), (3, "ruby", "x", None)]
    out = detect(spark.createDataFrame(rows, "file_id long, language string, code string, input_error string")).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.error) for r in out) == sorted(["No code provided"] * 2 + ["None"] * 3 + ["not json", "Unsupported language: ruby"])
    assert all((r.result is None) == (r.error is not None) and (r.confidence is None) == (r.error is not None) for r in out)
    assert all(r.chunk_count == 1 for r in out if r.error is None)


def test_report_of_null_cells(spark):
    from quillscope.plans.outputs import to_report

    results = detect(spark.createDataFrame([(1, "python", "a = 1\n")], "file_id long, language string, code string"))
    blank = results.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema])
    assert {r["value"] for r in to_report(blank, detailed=True).collect()} == {"N/A", ""}
    assert [r["property"] for r in to_report(results, detailed=True).orderBy("position").collect()][3] == ""


def test_deep_trees_are_errors(spark):
    rows = [(1, "python", "x = " + "-" * 1500 + "1\n")]
    out = detect(spark.createDataFrame(rows, "file_id long, language string, code string")).first()
    assert out.error is not None and out.classification is None


def test_edge_inputs_never_fail_the_job(spark):
    deep = "x = " + "(" * 5000 + "1" + ")" * 5000
    rows = [(1, "python", deep), (2, "python", "a = 1\x00\n"), (3, "python", "   \n\t\n"),
            (4, "javascript", "'unterminated {{{"), (5, "python", "x = " + "a" * 5000)]
    df = spark.createDataFrame(rows, "file_id long, language string, code string")
    out = {r.file_id: r for r in detect(df).collect()}
    assert len(out) == 5
    assert out[1].error is not None or out[1].parseable is False
    assert out[4].max_ast_depth == 0
    assert out[5].has_long_lines


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship_against_oracle(spark):
    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(E.oracle_sql()["js_file_results"]).df()
    got = E.queries()["js_file_results"](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(got.columns)
    norm = lambda d: sorted(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in row)
                            for row in d[cols].itertuples(index=False))
    assert norm(got) == norm(want)


def test_tunable_arguments(spark):
    from snippets import AI_PYTHON, LOW_SIGNAL_PYTHON

    df = spark.createDataFrame([(1, "python", AI_PYTHON), (2, "python", LOW_SIGNAL_PYTHON)],
                               "file_id long, language string, code string")
    default = {r.file_id: r for r in detect(df).collect()}
    small = {r.file_id: r for r in detect(df, target_chars=300, minimum_tail_chars=50).collect()}
    assert default[1].chunk_count == 1 and small[1].chunk_count > 1
    lenient = {r.file_id: r for r in detect(df, minimum_lines=1, minimum_tokens=1, minimum_signal=0.0,
                                              minimum_margin=0.0).collect()}
    assert default[2].decision_basis == K.BASIS_LOW and lenient[2].decision_basis == K.BASIS_CLEAR
