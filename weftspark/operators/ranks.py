"""Ranks and order statistics without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_key(seed: int, *cols: str) -> Column:
    """md5 of seed and columns: an order that depends on nothing else, and that SQL engines share."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def hash_rank(df: DataFrame, group: list[str], ids: list[str], seed: int = 42, name: str = "rank") -> DataFrame:
    """1, 2, ... per group in the order of hash_key. Hash prefixes cut a group into 4,096 ranges of even size: ranges are counted, counts summed, rows ranked within their range."""
    d = df.withColumn("_h", hash_key(seed, *ids)).withColumn("_b", F.substring("_h", 1, 3))
    keys = {f"_g{i}": g for i, g in enumerate([*group, "_b"])}
    n = d.groupBy(*(F.col(g).alias(k) for k, g in keys.items())).count()
    w = W.partitionBy(*list(keys)[:-1]).orderBy(list(keys)[-1]).rowsBetween(W.unboundedPreceding, -1)  # 4,096 rows per group
    before = n.withColumn("_before", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    on = F.lit(True)
    for k, g in keys.items():
        on = on & F.col(g).eqNullSafe(F.col(k))
    j = d.join(before, on).drop(*keys)
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*group, "_b").orderBy("_h", *ids))
    return j.withColumn(name, rank.cast("long")).drop("_h", "_b", "_before")


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n, upto (rows of the group with this value or a smaller one), total. Nulls are left out. The windows run over distinct values, not rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*group)
    return c.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))


def value_at(df: DataFrame, group: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Per group, the value at each 0-based position of its sorted values; a position is a column over `total`."""
    c = value_counts(df, group, value)
    at = [F.min(F.when(F.col("upto") > p, F.col(value))).alias(k) for k, p in positions.items()]
    return c.groupBy(*group).agg(F.max("total").alias("n"), *at)


def nearest_rank(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """sorted[int(share * n)], counted from 0."""
    return value_at(df, group, value, {"value": F.least(F.floor(F.lit(share) * F.col("total")), F.col("total") - 1)})


def exclusive_quantile(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """The exclusive method: position p(n+1) counted from 1, linear between neighbours, within the data."""
    pos = F.greatest(F.lit(1.0), F.least(F.lit(p) * (F.col("total") + 1), F.col("total").cast("double")))
    got = value_at(df, group, value, {"lo": F.floor(pos) - 1, "hi": F.least(F.floor(pos), F.col("total") - 1)})
    pos = F.greatest(F.lit(1.0), F.least(F.lit(p) * (F.col("n") + 1), F.col("n").cast("double")))
    return got.select(*group, "n", (F.col("lo") + (F.col("hi") - F.col("lo")) * (pos - F.floor(pos))).alias("value"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Rows of rank up to k. Spark's window group limit drops the rest before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
