"""Sinks: tables, twins, quarantine and idempotent upserts. No path is overwritten while it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftspark.util import cut


def with_twin(df: DataFrame, path: str) -> None:
    """Parquet and, beside it, JSON lines."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).write.mode("overwrite").json(f"{path}.jsonl")


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def quarantine(df: DataFrame, bad: DataFrame, key: str, clean_path: str, bad_path: str) -> None:
    """Rows whose key is in bad go to one path, the others to another."""
    keys = bad.select(key).distinct()
    df.join(keys, key, "left_semi").write.mode("overwrite").parquet(bad_path)
    df.join(keys, key, "left_anti").write.mode("overwrite").parquet(clean_path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, in whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Folders that a keyed table is split into by its key's hash: a batch reads only those that its keys fall in.
BUCKETS = 64


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Rows whose key the table doesn't hold yet are appended, once per key; repeating a call changes nothing. Returns how many.

    The table is split by the key's hash (column _bucket), so a batch is compared with the keys of its own buckets, not with the whole table. The batch is
    stored before it is compared, and rows are counted while they are written.
    """
    new = cut(df.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    if exists(spark, path):
        hit = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
        there = spark.read.parquet(path).where(F.col("_bucket").isin(hit)).select("_bucket", key)
        new = new.join(there, ["_bucket", key], "left_anti")
    count = Observation()
    new.observe(count, F.count("*").alias("n")).write.mode("append").partitionBy("_bucket").parquet(path)
    return count.get["n"]


def append_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that are there: logs of costs, batches and runs."""
    df.write.mode("append").json(path)


def index_chunks(spark: SparkSession, embedded: DataFrame, path: str) -> int:
    """Embedded chunks into the vector table, each chunk_id once, with whole texts and the vectors as arrays."""
    return append_new(spark, embedded, path, "chunk_id")


def arrays(df: DataFrame, ids: list[str], columns: list[str], path: str) -> None:
    """Numeric columns of each row as one array of doubles, for readers of tensors."""
    df.select(*ids, F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).write.mode("overwrite").parquet(path)


def report(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([tuple(values.values())], list(values)).coalesce(1).write.mode("overwrite").json(path)
