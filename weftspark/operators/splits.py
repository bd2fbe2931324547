"""Sampling, splitting and assembly, exact in size and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.ranks import hash_rank
from weftspark.util import maybe_broadcast


def stratified_split(df: DataFrame, stratum: str, ids: list[str], shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """split: train, val or test; per stratum floor(share * n) rows of the first two, in hash order. Null strata are one."""
    n = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    r = hash_rank(df, [stratum], ids, seed, "_r")
    j = r.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, r[stratum].eqNullSafe(F.col("_s"))).drop("_s")
    a = F.floor(F.col("_n") * shares[0] + 1e-9)
    b = a + F.floor(F.col("_n") * shares[1] + 1e-9)
    return j.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_n", "_r")


def oversample_counts(df: DataFrame, stratum: str, least: float = 0.15) -> DataFrame:
    """(stratum, n, target, extra): strata under int(total * least) are raised to it; none is cut."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("all"))
    t = F.greatest("n", F.floor(F.col("all") * least + 1e-9))
    return n.crossJoin(F.broadcast(total)).select(stratum, "n", t.alias("target"), (t - F.col("n")).alias("extra"))


def oversample(df: DataFrame, stratum: str, ids: list[str], least: float = 0.15, seed: int = 42) -> DataFrame:
    """All rows, and copies (copy 1, 2, ...) that raise each small stratum to its target: each row as often as the others, the rest in hash order."""
    c = oversample_counts(df, stratum, least).withColumnRenamed(stratum, "_s")
    r = hash_rank(df, [stratum], ids, seed, "_r")
    j = r.join(F.broadcast(c) if c.limit(10_001).count() <= 10_000 else c, r[stratum].eqNullSafe(F.col("_s"))).drop("_s")
    times = F.floor((F.col("extra") + F.col("n") - F.col("_r")) / F.col("n")).cast("int")
    return j.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).drop("_r", "n", "target", "extra")


def take_per_group(df: DataFrame, group: str, need: dict[str, int], ids: list[str], seed: int = 42) -> DataFrame:
    """min(need, size) rows of each group, in hash order."""
    k = F.create_map(*(F.lit(x) for kv in need.items() for x in kv))
    return hash_rank(df.where(F.col(group).isin(*need)), [group], ids, seed, "_r").where(F.col("_r") <= k[F.col(group)]).drop("_r")


def assemble(pools: list[DataFrame], group: str, target: dict[str, int], ids: list[str], seed: int = 42) -> DataFrame:
    """Rows of the first pool, then the second and so on until each group has its target; (rows, pool, place)."""
    u = None
    for i, p in enumerate(pools):
        d = hash_rank(p, [group], ids, seed, "_r").withColumn("pool", F.lit(i))
        u = d if u is None else u.unionByName(d)
    sizes = u.groupBy(F.col(group).alias("_g"), F.col("pool").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), (F.col("a._g") == F.col("b._g")) & (F.col("b._p") < F.col("a._p")), "left").groupBy("a._g", "a._p").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    t = F.create_map(*(F.lit(x) for kv in target.items() for x in kv))
    j = u.join(maybe_broadcast(before), (F.col(group) == F.col("_g")) & (F.col("pool") == F.col("_p")))
    return j.withColumn("place", F.col("_before") + F.col("_r")).where(F.col("place") <= t[F.col(group)]).drop("_g", "_p", "_before", "_r")


def needs(target: DataFrame, have: DataFrame, group: str) -> DataFrame:
    """(group, need) = target minus what there is, where positive."""
    n = have.groupBy(group).agg(F.count("*").alias("have"))
    return target.join(n, group, "left").select(group, F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("need")).where("need > 0")


def leave_one_out(df: DataFrame, group: str, folds: DataFrame) -> DataFrame:
    """(fold, ..., part): for each fold, rows of its group are test, the others train. folds is a stated, small list."""
    return df.crossJoin(maybe_broadcast(folds.select(F.col(group).alias("fold")))).withColumn("part", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))


def sweep(designs: DataFrame, design: str = "design", steps: int = 11, first: float = 2.0, step: float = 0.4) -> DataFrame:
    """(design, clock_ns, variant): every design at every clock target."""
    clock = F.round(F.lit(first) + F.col("i") * step, 2)
    c = designs.select(design).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(design, clock.alias("clock_ns"))
    name = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.col("clock_ns")), "0+$", ""), r"\.$", "")
    return c.withColumn("variant", F.concat(F.lit("clk_"), F.regexp_replace(name, r"\.", "p")))


def native_sweep(designs: DataFrame, design: str, native: str, multipliers: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.25, 1.5)) -> DataFrame:
    """(design, clock_ns, variant): every design at multiples of its own clock, to three places."""
    c = designs.select(design, native).distinct().withColumn("m", F.explode(F.array(*map(F.lit, multipliers)))).select(design, F.round(F.col(native) * F.col("m"), 3).alias("clock_ns"))
    name = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.col("clock_ns")), "0+$", ""), r"\.$", "")
    return c.withColumn("variant", F.concat(F.lit("clk_"), F.regexp_replace(name, r"\.", "p")))


def priority_sample(df: DataFrame, first: Column, ids: list[str], most_first: int, size: int, seed: int = 42) -> DataFrame:
    """(ids, first): at most so many rows that come first, in hash order, and of the others as many as fill the sample."""
    d = df.select(*ids, F.coalesce(first, F.lit(False)).alias("first"))
    r = hash_rank(d, ["first"], ids, seed, "_r").where((F.col("first") & (F.col("_r") <= most_first)) | (~F.col("first") & (F.col("_r") <= size)))
    n = d.where("first").limit(most_first).agg(F.count("*").alias("_n"))
    return r.crossJoin(F.broadcast(n)).where(F.col("first") | (F.col("_r") <= size - F.col("_n"))).drop("_r", "_n")
