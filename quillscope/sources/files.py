"""Sources (A1, A2): source files from storage and (code, language) snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K

#: A file is one row; larger ones are error rows.
MAX_FILE_BYTES = 256 << 20

SNIPPET_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("code", T.StringType()),
    T.StructField("language", T.StringType()),
])


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly.  They are numbered where they are read: the same number in every attempt of a task."""
    return rows.withColumn("_row", F.monotonically_increasing_id()).repartition("_row").drop("_row")


def read_code_files(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None, max_bytes: int = MAX_FILE_BYTES, modified_after: str | None = None) -> DataFrame:
    """A1: one row per file (UTF-8 text without a byte-order mark), ``path`` feeds language detection.

    A file that is no valid UTF-8, or larger than ``max_bytes``, is a row
    without code and with an error; the bytes of a file that is too large are
    not read.  A file without a byte has no row: Spark's readers pass it over.
    ``file_id`` is the path itself: stable across runs and task
    retries, and no two files share it."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    found = reader.load(paths)
    none = F.lit(None).cast("string")
    text = F.col("content").cast("string")
    read = found.where(F.col("length") <= max_bytes).select("path", text.alias("text"), F.is_valid_utf8(text).alias("valid"))
    read = read.select("path", F.when(F.col("valid"), F.regexp_replace("text", "^\\x{FEFF}", "")).alias("code"), F.when(~F.col("valid"), F.lit(K.ERR_ENCODING)).alias("input_error"))
    large = found.where(F.col("length") > max_bytes).select("path", none.alias("code"), F.lit(K.ERR_TOO_LARGE).alias("input_error"))
    return read.unionByName(large).select(F.col("path").alias("file_id"), "path", none.alias("language"), "code", "input_error")


def snippets_from(df: DataFrame) -> DataFrame:
    """A2: language lower-cased, default ``python``; no path.  Records that could
    not be read (column ``_corrupt_record``) keep their row, with an error."""
    has = set(df.columns)
    lang = F.col("language") if "language" in has else F.lit(None).cast("string")
    error = F.when(F.col("_corrupt_record").isNotNull(), F.lit(K.ERR_MALFORMED)) if "_corrupt_record" in has else F.lit(None).cast("string")
    return df.select(
        F.col("file_id").cast("long").alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.lower(F.coalesce(lang, F.lit("python"))).alias("language"),
        F.col("code"),
        error.alias("input_error"),
    )


def read_snippets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A2: JSON lines / parquet of ``(file_id, code, language)``."""
    schema = SNIPPET_SCHEMA
    if fmt == "json":
        schema = T.StructType([*SNIPPET_SCHEMA, T.StructField("_corrupt_record", T.StringType())])
    return snippets_from(spark.read.schema(schema).format(fmt).load(path))
