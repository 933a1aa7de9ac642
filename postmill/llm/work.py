"""Shared folder, written tables and files that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a list of documents is broadcast (some 16 bytes each); beyond that it is joined by a shuffle.
LISTED = 2_000_000
_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir`` (a local temporary folder only where that is unset)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="postmill-"))
    return f"{root.rstrip('/')}/postmill/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, uri: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again: cuts lineage, and lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def delete(spark: SparkSession, uri: str) -> None:
    """Removes a folder that later steps don't read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it (file, hdfs, s3 and gs are built in)."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def rows_left(docs: DataFrame, fates: DataFrame, uri: str) -> DataFrame:
    """``docs`` without the rows that ``fates`` (doc_id, text_key, kept) drops; ``text_key`` is Spark's xxhash64 of the text.

    Of rows that share both, one stays if any is kept. Only keys with a dropped row are listed; texts aren't copied.
    """
    keys = fates.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept")).filter("n_kept = 0 or n > 1")
    keys = written(keys.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"), F.col("n_kept") > 0).toDF("of_doc", "of_key", "stays"), uri)
    listed = F.broadcast(keys) if keys.count() <= LISTED else keys
    same = docs["doc_id"].eqNullSafe(keys["of_doc"]) & (F.xxhash64(docs["text"]) == keys["of_key"])
    left = docs.join(listed, same, "left_anti")
    again = keys.filter("stays")
    if again.isEmpty():
        return left
    same = docs["doc_id"].eqNullSafe(again["of_doc"]) & (F.xxhash64(docs["text"]) == again["of_key"])
    repeated = docs.join(F.broadcast(again) if again.count() <= LISTED else again, same, "left_semi")
    row = F.struct(*[repeated[c] for c in docs.columns]).alias("row")
    once = repeated.select(repeated["doc_id"].alias("i"), F.xxhash64(repeated["text"]).alias("k"), row).groupBy("i", "k").agg(F.first("row").alias("row"))
    return left.unionByName(once.select("row.*"))
