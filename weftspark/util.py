"""Helpers shared by the operators: table access, size-checked broadcasts, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only in one JVM (master local) is a local folder set where that is unset; on a cluster without it nothing could be stored safely, which is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        there = spark.sparkContext.getCheckpointDir()
    if there is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), "weftspark-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder; what follows survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables taken to the driver or broadcast must stay under these bounds.
MAX_SMALL_ROWS = 200_000
MAX_SMALL_BYTES = 64 << 20


class TooLarge(ValueError):
    """A table that has to be small is not."""


def small_rows(df: DataFrame, what: str, max_rows: int = MAX_SMALL_ROWS) -> list:
    """Rows of a reference table whose size is proven first: at most max_rows are ever read."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLarge(f"{what} has more than {max_rows} rows; it can't be held whole")
    return rows


def maybe_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = MAX_SMALL_BYTES) -> DataFrame:
    """Broadcast df if it is counted to be small, in rows and in bytes; else leave the join to shuffle on its key."""
    size = None
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        n = F.coalesce(F.length(f.name) * 2, F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.size(f.name), F.lit(0)) * 64 if kind in ("array", "map") else F.lit(16)
        size = n if size is None else size + n
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores is dealt to all cores, before work that is heavy per row. Larger tables, streams and results of shuffles pass as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or n < 2:
        return df
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString() or execution.toRdd().getNumPartitions() >= n:
        return df
    return df.repartition(n)
