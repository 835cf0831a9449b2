"""Connected components of a link table, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Both
steps are a partial-aggregated minimum and a join on the node, so a node with
very many links is never gathered: the join's hot side can be split.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a scratch one only where nothing is set and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return os.fspath(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared file system once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hint_small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """A broadcast hint where all of ``df``, a stored table, is at most ``limit`` bytes as JSON; else ``df`` as it is."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _least(links: DataFrame) -> DataFrame:
    """Of every u, itself and its neighbours: the least."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a table of links (u, v): root is the least node of its component.

    Nodes are longs; loops and nulls are left out, an empty table has no rows.
    Each round is checkpointed in the shared folder.  The rounds end when the
    links are stars that no longer change.
    """
    spark = links.sparkSession
    checkpoint_folder(spark)
    state = links.select("u", "v").where("u != v")
    state = state.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        n, total = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (n, total)
        state = _small_star(_large_star(state)).checkpoint()
