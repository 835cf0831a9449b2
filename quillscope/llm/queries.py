"""The registered queries of the training-data operators, and their DuckDB SQL.

Each query applies its operator with production parameters to its whole table
and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.llm import binary_codes, chat_rotation, decontaminate, divergence, hilbert_pack, kd_shards, language_id, lexical_search, quality_knn, simhash, syncmers, token_counts, warc_merkle
from quillscope.llm.components import checkpoint_folder, remove_folder
from quillscope.llm.sampling import held_out_bucket
from quillscope.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.training_rows(docs))
    held_out = F.coalesce(held_out_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_merkle.audit_damaged(table(spark, sf_dir, "pages"))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.digest(chat_rotation.rotate(table(spark, sf_dir, "conversations")))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, quality_knn.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(held_out_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality_knn.rate(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edited(table(spark, sf_dir, "documents"))


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_blockmax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is a table in the shared folder; the few results are kept there apart from it, so it can go."""
    folder = f"{checkpoint_folder(spark)}/lexical-index-{uuid.uuid4().hex}"
    index = lexical_search.build_index(table(spark, sf_dir, "documents"), folder)
    found = lexical_search.search(index, table(spark, sf_dir, "benchmark")).checkpoint()
    remove_folder(spark, folder)
    return found


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in (op1_token_counts, op2_language_id, op3_simhash, op4_warc_merkle, op5_chat_rotation, op6_quality_knn, op7_decontamination, op8_syncmers, op9_hilbert_pack, op10_kd_shards, op11_blockmax_search, op12_source_divergence, op13_binary_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_merkle": warc_merkle.AUDIT_SQL, "op5_chat_rotation": chat_rotation.DIGEST_SQL, "op7_decontamination": decontaminate.REPORT_SQL, "op11_blockmax_search": lexical_search.SEARCH_SQL, "op12_source_divergence": divergence.AUDIT_SQL, "op13_binary_codes": binary_codes.LINKS_SQL}
