"""Sources mixed to target weights.

Efraimidis-Spirakis sampling: each document draws an exponential key divided by its quality weight; the smallest keys win.
A source's budget is met by whole passes over all its documents first, then by the documents of smallest keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftspark.llm.tokens import TOKENIZER, lengths
from weftspark.util import cut, small_rows, spread

#: Documents per bucket of keys, on average: no window spans more than about one bucket.
BUCKET = 2_000
MAX_SOURCES = 100_000


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


_SIZED = T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def sized(text: Column, path: str = TOKENIZER) -> Column:
    """(tokens, weight). The quality weight is characters per token over 4, within [0.25, 4]: text the vocabulary knows well weighs more."""

    @F.pandas_udf(_SIZED)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            texts = [t or "" for t in s]
            n = lengths(texts, path)
            yield pd.DataFrame({"tokens": n, "weight": [min(4.0, max(0.25, len(t) / k / 4)) if k else 1.0 for t, k in zip(texts, n, strict=True)]}).astype({"tokens": "int32"})

    return run(text)


def budgets(targets: list[tuple[str, float, int, int]], total: int) -> dict[str, int]:
    """Tokens per source from (source, target_share, max_repeats, tokens there).

    Each source gets its share of the total, but no more than max_repeats times its tokens; what a source can't
    give is shared among those that can, in proportion to their targets, until the total is met or all are at their limit.
    """
    limit = {s: max(0, r) * n for s, _, r, n in targets}
    share = {s: max(0.0, w) for s, w, _, _ in targets}
    given = dict.fromkeys(share, 0)
    open_ = {s for s in share if share[s] > 0 and limit[s] > 0}
    rest = total
    while rest > 0 and open_:
        whole = sum(share[s] for s in open_)
        full = {s for s in open_ if limit[s] - given[s] <= rest * share[s] / whole}
        if not full:
            parts = {s: int(rest * share[s] / whole) for s in sorted(open_)}
            for s, n in parts.items():
                given[s] += n
            break
        for s in full:
            rest -= limit[s] - given[s]
            given[s] = limit[s]
        open_ -= full
    return given


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """documents: (id, source, tokens, weight). Returns uses (id, source, tokens, uses) and shares per source.

    The total is the tokens of all documents, of whatever source. Documents of other sources aren't used. Null tokens
    and weights count as 0 and 1. A repeated target counts with its largest share. Null sources match none.
    Per source: passes = budget div its tokens complete passes; of the rest, documents by key while their sum stays within
    half a document of it. No document exceeds max_repeats. Sources may hold a third of all rows: keys fall into
    buckets of about BUCKET documents, buckets are summed up, and only the bucket in which a budget ends is sorted.
    """
    d = documents.select(F.col(id_col).alias("id"), "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)).alias("weight"))
    key = -F.log(uniform(seed, "id")) / F.col("weight")
    d = cut(d.withColumn("key", key))
    all_ = d.agg(F.sum("tokens"), F.count("*")).first()
    total, rows = all_[0] or 0, all_[1]
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    there = t.join(d.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs")), "source", "left")
    known = small_rows(there.select("source", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("docs", F.lit(0)).alias("docs")), "mixture targets", MAX_SOURCES)
    give = budgets([(r.source, r.share, r.repeats, r.have) for r in known], total)
    plan = documents.sparkSession.createDataFrame(
        [(r.source, float(r.share), int(r.repeats), int(r.have), int(r.docs), give[r.source], give[r.source] // r.have if r.have else 0, give[r.source] % r.have if r.have else 0) for r in known],
        "source string, target_share double, max_repeats int, have long, docs long, budget long, passes long, rest long",
    )
    buckets = max(1, -(-rows // BUCKET))
    d = d.join(F.broadcast(plan.select("source", "passes", "rest", "max_repeats")), "source")
    # a monotone function of the key with values in [0, 1)
    d = d.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("long"))
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(sums, ["source", "bucket"])
    inside = (F.col("before") + F.col("in_bucket")) <= F.col("rest")
    edge = ~inside & (F.col("before") < F.col("rest"))
    ends = d.where(edge).withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("key", "id", "tokens").rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    d = d.where(~edge).withColumn("extra", inside.cast("int")).unionByName(ends.drop("upto"))
    uses = cut(d.select("id", "source", "tokens", F.least(F.col("passes") + F.col("extra"), F.col("max_repeats").cast("long")).cast("int").alias("uses")))
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum((F.col("uses") > 0).cast("int")).alias("used_docs"), F.max("uses").alias("most_uses"))
    sum_used = uses.agg(F.coalesce(F.sum(F.col("tokens") * F.col("uses")), F.lit(0)).alias("mix_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shares = plan.join(got, "source", "left").crossJoin(F.broadcast(sum_used)).select(
        "source", "target_share", "max_repeats", F.col("docs").alias("documents"), F.col("have").alias("source_tokens"), F.col("budget").alias("budget_tokens"), zero("used_docs").alias("used_documents"), zero("most_uses").alias("most_uses"), zero("used_tokens").alias("used_tokens"),
        F.when(F.col("mix_tokens") > 0, zero("used_tokens") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"), F.lit(total).alias("total_tokens"),
    )
    return uses.select(F.col("id").alias(id_col), "source", "tokens", "uses"), shares


def mix_documents(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    s = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", sized(F.col("text"), path).alias("x")).select("doc_id", "source", "x.*")
    return mix(s, targets, seed)
