"""Operators 4 and 5, and the pipeline."""

import brute
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quillscope.llm import chat_rotation, queries, warc_merkle


def same(frame, sql, keys, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{brute.SF_CHECK}/{t}.parquet'")
    got, want = frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    got, want = (x[sorted(x.columns)].sort_values(keys).reset_index(drop=True).fillna("-") for x in (got, want))
    assert got.astype(str).equals(want.astype(str))


def test_audit_equals_sql(spark):
    same(queries.op4_warc_merkle(spark, brute.SF_CHECK), warc_merkle.AUDIT_SQL, ["slot"], ["pages"])


def test_rotation_equals_sql(spark):
    same(queries.op5_chat_rotation(spark, brute.SF_CHECK), chat_rotation.DIGEST_SQL, ["conv_id", "block", "part", "perspective"], ["conversations"])


def test_decontamination_equals_sql(spark):
    same(queries.op7_decontamination(spark, brute.SF_CHECK), queries.oracle_sql()["op7_decontamination"], ["doc_id"], ["documents", "benchmark"])


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_edge_rows(spark):
    rows = [(None, "u", "a"), (None, None, None), (3, "u", "b"), (3, "u", "b"), (3, "v", "c"), (1007, None, "c"), (5, "x", None)]
    whole = warc_merkle.tree(warc_merkle.index(pages(spark, rows)))
    assert warc_merkle.audit(whole, warc_merkle.tree(warc_merkle.index(pages(spark, rows[::-1])))).count() == 0
    changed = [(None, "u", "a"), (None, None, "new"), (3, "u", "b"), (3, "u", "b"), (3, "v", "d"), (5, "x", ""), (12, "y", "")]
    found = {r["slot"]: r for r in warc_merkle.audit(whole, warc_merkle.tree(warc_merkle.index(pages(spark, changed)))).collect()}
    assert {k: r["status"] for k, r in found.items() if k >= 0} == {3: "changed", 1007: "missing", 12: "extra"}
    assert sum(k < 0 for k in found) == 1
    assert found[1007]["volume"] == 1 and found[1007]["offset"] == 0
    empty = warc_merkle.tree(warc_merkle.index(pages(spark, [])))
    assert warc_merkle.audit(empty, empty).count() == 0
    assert {r["status"] for r in warc_merkle.audit(whole, empty).collect()} == {"missing"}


def test_offsets_follow_each_other(spark):
    table = spark.read.parquet(f"{brute.SF_SMALL}/pages.parquet")
    at = {}
    for r in warc_merkle.index(table).orderBy("slot").collect():
        assert r["offset"] == at.get(r["volume"], 0)
        at[r["volume"]] = r["offset"] + r["length"]


TURNS = "conv_id long, turn long, role string, text string, part string"


def test_a_repeated_number_is_summed_over_ranges(spark, monkeypatch):
    rows = [(5 if i % 3 else i, "u", "same" if i % 2 else "x" * (i % 70)) for i in range(1500)] + [(None, None, f"n{i % 9}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    wide = sorted(warc_merkle.index(pages).collect())
    monkeypatch.setattr(warc_merkle, "WINDOW_ROWS", 90)
    assert sorted(warc_merkle.index(pages).collect()) == wide and len(wide) == len(rows)
    ends = {}
    for r in sorted(wide, key=lambda r: (r["volume"], r["offset"])):
        assert r["offset"] == ends.get(r["volume"], 0)
        ends[r["volume"]] = r["offset"] + r["length"]


def test_rotation_edge_rows(spark):
    rows = [(1, 0, "ann", "hi", "z"), (1, 1, "bob", None, "z"), (1, None, None, "x", "z"), (None, 0, "system", "s", "z"), (None, 1, "cy", "c", "z"), (2, 0, "a", "q", "z"), (2, 0, "a", "q", "z"), (3, 0, "system", "only", "z")]
    out = chat_rotation.rotate(spark.createDataFrame(rows, TURNS)).collect()
    assert {(r["conv_id"], r["perspective"]) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy"), (2, "a")}
    for r in out:
        said = [r["rendered"][m["from"] : m["to"]] for m in r["mask"]]
        assert said == [t or "" for c, n, who, t, _ in rows if c == r["conv_id"] and (who or "unknown") == r["perspective"] and (n is None) == (r["block"] is None)]
    assert chat_rotation.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_blocks_without_turns_are_numbered_over_ranges(spark, monkeypatch):
    # One conversation without an id holds most rows, all without a turn, many of them equal.
    rows = [(None, None, f"p{i % 3}", "same" if i % 2 else f"text {i % 500}") for i in range(2000)] + [(7, i % 5, "a", f"t{i}") for i in range(300)] + [(8, i, "b", "t") for i in range(100)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    wide = sorted(map(str, chat_rotation.digest(chat_rotation.rotate(turns)).collect()))
    monkeypatch.setattr(chat_rotation, "WINDOW_ROWS", 90)
    narrow = sorted(map(str, chat_rotation.digest(chat_rotation.rotate(turns)).collect()))
    assert narrow == wide and len(wide) == 3 * -(-2000 // 64) + -(-300 // 64) + 2


def test_a_long_conversation_has_blocks(spark):
    rows = [(1, i if i < 200 else 7, "ab"[i % 2], f"t{i}", "") for i in range(400)]
    out = chat_rotation.rotate(spark.createDataFrame(rows, TURNS)).collect()
    assert max(r["n_turns"] for r in out) <= chat_rotation.BLOCK_TURNS
    for who in "ab":
        assert sum(len(r["mask"]) for r in out if r["perspective"] == who) == 200


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{brute.SF_CHECK}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], brute.SF_CHECK).cache())
    return docs


def test_stages(spark, stages):
    labels = spark.read.parquet(f"{brute.SF_CHECK}/labels.parquet")
    columns = stages[0].columns
    assert all(d.columns == columns for d in stages[:5])
    n = [d.count() for d in stages[:5]]
    assert n[0] >= n[1] > n[2] > n[3] > n[4] > 0
    good = labels.where("quality = 1").join(stages[1], "doc_id")
    assert good.join(stages[2], "doc_id", "left_semi").count() > 0.99 * good.count()
    from quillscope.llm import decontaminate, simhash

    bench = spark.read.parquet(f"{brute.SF_CHECK}/benchmark.parquet")
    assert decontaminate.report(stages[4], bench).where("contaminated").count() == 0
    assert decontaminate.report(stages[3], bench).where("not contaminated").count() == n[4]
    assert simhash.near_duplicates(stages[3]).where("doc_id != component_id").count() == 0
    packed = stages[5].agg(F.countDistinct("doc_id")).first()[0]
    assert packed == n[4]


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, brute.SF_SMALL).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
