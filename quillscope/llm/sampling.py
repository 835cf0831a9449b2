"""Bounded samples of labelled rows, for fitting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.llm.components import checkpoint_folder, hint_small


def held_out_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(id as text) mod modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Label values whose chances stand in the expression itself; more are a table that is joined.
TERMS = 256


def per_class_sample(df: DataFrame, label: str, at_most: int, salt: Column) -> DataFrame:
    """About ``at_most`` rows of each label value, chosen by a hash of ``salt``; all rows of smaller classes.

    The class sizes are counted over all rows first, so the sample is bounded by
    at_most * classes in expectation, whatever the number of classes.
    """
    chance = F.pmod(F.xxhash64(salt, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sizes = df.groupBy(label).count()
    some = sizes.limit(TERMS + 1).collect()
    if len(some) <= TERMS:
        keep = F.lit(0.0)
        for row in some:
            keep = F.when(F.col(label) == row[label], min(1.0, at_most / row["count"])).otherwise(keep)
        return df.where(chance < keep) if some else df
    checkpoint_folder(df.sparkSession)
    chances = sizes.where(F.col(label).isNotNull()).select(label, F.least(F.lit(1.0), at_most / F.col("count")).alias("__keep")).checkpoint()
    return df.join(hint_small(chances), label).where(chance < F.col("__keep")).select(*df.columns)
