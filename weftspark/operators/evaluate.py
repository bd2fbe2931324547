"""Evaluation roll-ups and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(results: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by each dimension alone and over all, in one pass: grouping sets. level is the dimension's name, or all."""
    d = results.select(*dims, *(m.alias(n) for n, m in measures.items()))
    level = F.lit("all")
    for x in reversed(dims):
        level = F.when(F.grouping(x) == 0, x).otherwise(level)
    sets = [*([F.col(x)] for x in dims), []]
    return d.groupingSets(sets, *dims).agg(level.alias("level"), F.count("*").alias("n"), *(F.avg(n).alias(n) for n in measures)).select("level", F.coalesce(*dims).alias("key"), "n", *measures)


def set_precision(expected: Column, got: Column, empty: float | None = 1.0) -> Column:
    """Share of distinct values got that are expected, letter case aside; without expectations as `empty`, without any got 0."""
    low = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower))
    e, g = low(expected), low(got)
    return F.when(F.size(e) == 0, F.lit(empty).cast("double")).when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(e, g)) / F.size(g))


def set_differences(expected: Column, got: Column) -> tuple[Column, Column]:
    """(missing, unexpected): expected values that aren't got, and the reverse, distinct and sorted."""
    one = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    return F.array_sort(F.array_except(one(expected), one(got))), F.array_sort(F.array_except(one(got), one(expected)))


def dimension_means(rows: DataFrame, dims: list[str], judged: Column) -> DataFrame:
    """(dimension, n, mean, p10) over judged rows: a missing score counts as 0 in the mean; p10 is sorted[n // 10] of the scores above 0."""
    from weftspark.operators.ranks import value_counts

    x = rows.where(judged).select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in dims))).alias("x")).select("x.*")
    a = x.groupBy("dimension").agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    c = value_counts(x.where("score > 0"), ["dimension"], "score")
    low = c.groupBy("dimension").agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 10), F.col("score"))).alias("p10"))
    return a.join(low, "dimension", "left")


def grounded_means(rows: DataFrame, group: str, score: str) -> DataFrame:
    """(group, n, grounded, mean): the mean over rows that have a score at all."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count(score).alias("grounded"), F.avg(score).alias("mean"))


def rate_pct(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), places)


def progress(rows: DataFrame, bucket: Column, measures: dict[str, Column]) -> DataFrame:
    """(bucket, n, done, and each measure so far): running sums over buckets of rows, not over rows."""
    from pyspark.sql import Window as W

    g = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *(F.sum(m).alias(k) for k, m in measures.items()))
    w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # one row per bucket
    return g.select("bucket", "n", F.sum("n").over(w).alias("done"), *(F.sum(k).over(w).alias(k) for k in measures))


def best_checkpoint(log: DataFrame, group: list[str], step: str, error: str) -> DataFrame:
    """The step of smallest error per run, the first on ties; null and NaN errors are none."""
    e = F.when(~F.isnan(error), F.col(error))
    return log.where(e.isNotNull()).groupBy(*group).agg(F.min(F.struct(e.alias("e"), F.col(step).alias("s"))).alias("b")).select(*group, F.col("b.s").alias(step), F.col("b.e").alias(error))


def early_stops(log: DataFrame, run: str, step: str, error: str, patience: int) -> DataFrame:
    """Per logged step: the best error so far, steps since it, and whether training stops there (first step with `patience` steps without a better one). A run's log is one window: a row per step."""
    from pyspark.sql import Window as W

    w = W.partitionBy(run).orderBy(step)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    x = log.withColumn("best", F.min(error).over(past)).withColumn("_at", F.row_number().over(w))
    x = x.withColumn("_better", F.coalesce(F.col("best") < F.lag("best").over(w), F.lit(True))).withColumn("since", F.col("_at") - F.max(F.when(F.col("_better"), F.col("_at"))).over(past))
    first = F.min(F.when(F.col("since") >= patience, F.col("_at"))).over(W.partitionBy(run))
    return x.withColumn("stops", F.coalesce(F.col("_at") == first, F.lit(False))).select(run, step, error, "best", "since", "stops")


def set_recall(expected: Column, got: Column, empty: float | None = 1.0) -> Column:
    """Share of distinct expected values (letter case aside) among those got; empty expectations count as `empty`."""
    low = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower))
    e = low(expected)
    return F.when(F.size(e) == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(e, low(got))) / F.size(e))


def source_recall(expected: Column, texts: list[Column], lists: list[Column], empty: float | None = 1.0) -> Column:
    """Share of expected sources that are contained in one of the texts or one value of the lists."""
    e = F.coalesce(expected, F.array().cast("array<string>"))

    def seen(s: Column) -> Column:
        out = F.lit(False)
        for t in texts:
            out = out | F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lower(s))
        for a in lists:
            out = out | F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lower(s)))
        return out

    return F.when(F.size(e) == 0, F.lit(empty).cast("double")).otherwise(F.size(F.filter(e, seen)) / F.size(e))


def hit_rate(results: DataFrame, group: str, facts: str) -> DataFrame:
    return results.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(facts) > 0).alias("hits"))


def perplexity(batches: DataFrame, loss: str, n: str) -> DataFrame:
    """exp of the token-weighted mean loss."""
    return batches.agg(F.exp(F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("perplexity"))


def cross_validation(folds: DataFrame, error: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.agg(F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"))


def overall(dims: list[Column], how: str = "min") -> Column:
    """Scores clamped to [0, 1], then their least, or their mean."""
    c = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(d, F.lit(0.0)))) for d in dims]
    return F.least(*c) if how == "min" else sum(c[1:], c[0]) / len(c)


def judged(rows: DataFrame, score: str, accept: float = 0.9) -> DataFrame:
    """status: accepted, rejected, or failed where there is no score."""
    return rows.withColumn("status", F.when(F.col(score).isNull(), "failed").when(F.col(score) >= accept, "accepted").otherwise("rejected"))


def keep_quality(rows: DataFrame, score: str, least: float, missing: float) -> DataFrame:
    """Rows of at least this score; a missing one counts as `missing`."""
    return rows.where(F.coalesce(F.col(score), F.lit(missing)) >= least)


# fixed values: task categories that are merged into others
CATEGORIES = {"error_diagnosis": "error_diagnosis", "rtl_qa": "rtl_qa", "constraint_generation": "constraint_generation", "cross_tool_knowledge": "cross_tool_knowledge", "optimization_advisory": "cross_tool_knowledge", "general_eda": "cross_tool_knowledge", "drc_rule_lookup": "drc_rule_lookup"}


def category(c: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    c = F.coalesce(c, F.lit("error_diagnosis"))
    return F.coalesce(F.try_element_at(m, c), c)


def instruction(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), F.coalesce(question, F.lit("")), F.lit(" [/INST] "), F.coalesce(answer, F.lit("")), F.lit("</s>"))


def token_cost(tokens_in: Column, tokens_out: Column, in_per_million: float, out_per_million: float) -> Column:
    return (tokens_in * in_per_million + tokens_out * out_per_million) / 1e6


def client_ip(real: Column, forwarded: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(real), F.lit("")), F.nullif(F.trim(F.get(F.split(forwarded, ","), 0)), F.lit("")), host)


def valid_query(q: Column, longest: int = 500) -> Column:
    """The query without blanks around it; null if blank or too long."""
    t = F.trim(q)
    return F.when((F.length(t) > 0) & (F.length(q) <= longest), t)
