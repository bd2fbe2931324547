"""Checks of tables and of the graph: contracts, seeds, versions, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.util import maybe_broadcast


def contract(df: DataFrame, required: list[str], enums: dict[str, list[str]] | None = None, unique: list[str] | None = None) -> DataFrame:
    """(check, field, violations) of a table against its declaration: missing values, values outside a domain, keys that occur again."""
    parts = [("required", c, F.count_if(F.col(c).isNull())) for c in required] + [("domain", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(v))) for c, v in (enums or {}).items()]
    a = df.agg(*(v.alias(f"_{i}") for i, (_, _, v) in enumerate(parts)))
    out = a.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(c).alias("field"), F.col(f"_{i}").alias("violations")) for i, (k, c, _) in enumerate(parts)))).alias("x")).select("x.*")
    if unique:
        again = df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(again.select(F.lit("unique").alias("check"), F.lit(",".join(unique)).alias("field"), "violations"))
    return out


def node_properties(nodes: DataFrame, captured: str) -> DataFrame:
    """Nodes with the properties that every Version has by default: its tag, the tool it begins with, and the day it was captured; others have none."""
    v = F.col("label") == "Version"
    props = F.create_map(F.lit("version_tag"), F.col("id"), F.lit("source_tool"), F.get(F.split("id", "_"), 0), F.lit("capture_date"), F.lit(captured))
    return nodes.withColumn("defaults", F.when(v, props))


def seed_check(nodes: DataFrame, seeds: DataFrame, label: str = "Violation") -> DataFrame:
    """(id, found): which of the stated ids are nodes of the label."""
    there = nodes.where(F.col("label") == label).select("id").distinct().withColumn("found", F.lit(True))
    return seeds.select("id").distinct().join(there, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def seed_patterns(edges: DataFrame, patterns: dict[str, tuple[str, str | None, str | None]]) -> DataFrame:
    """(pattern, matches, passed): edges of each stated type and ends, where given; a pattern without any fails."""
    hits = []
    for name, (kind, src, dst) in patterns.items():
        c = F.col("type") == kind
        c = c if src is None else c & (F.col("src") == src)
        hits.append((name, c if dst is None else c & (F.col("dst") == dst)))
    a = edges.agg(*(F.count_if(c).alias(f"_{i}") for i, (_, c) in enumerate(hits)))
    rows = F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(f"_{i}").alias("matches")) for i, (n, _) in enumerate(hits)))
    return a.select(F.explode(rows).alias("x")).select("x.pattern", "x.matches", (F.col("x.matches") > 0).alias("passed"))


def version_coverage(nodes: DataFrame, edges: DataFrame, canonical: list[str]) -> DataFrame:
    """One row: version nodes, which of the canonical ones are missing, edges of divergence, and whether all are there and one diverges."""
    v = nodes.where("label = 'Version'")
    want = F.array(*map(F.lit, canonical))
    a = v.agg(F.count("*").alias("versions"), F.collect_set(F.when(F.col("id").isin(canonical), F.col("id"))).alias("have"))  # at most the canonical ones
    d = edges.where("type = 'DIVERGES_FROM'").agg(F.count("*").alias("divergences"))
    missing = F.array_sort(F.array_except(want, "have"))
    return a.crossJoin(d).select("versions", missing.alias("missing"), "divergences", ((F.size(missing) == 0) & (F.col("divergences") > 0)).alias("passed"))


def violations_with_fix(labelled: DataFrame, hops: int = 2) -> DataFrame:
    """One row: violations, and those with a fix within so many undirected steps over any relation. Fixes spread their reach step by step; only distinct nodes pass on."""
    e = labelled.select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ends = labelled.select(F.col("src_label").alias("l"), F.col("src").alias("id")).unionAll(labelled.select(F.col("dst_label").alias("l"), F.col("dst").alias("id"))).distinct()
    seen = ends.where("l = 'Fix'").select("id").distinct()
    for _ in range(hops):
        seen = seen.unionByName(both.join(seen.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))).distinct()
    v = ends.where("l = 'Violation'").select("id")
    return v.join(seen.withColumn("r", F.lit(1)), "id", "left").agg(F.count("*").alias("violations"), F.count("r").alias("with_fix"))


def rule_use(labelled: DataFrame) -> DataFrame:
    """(rule, violations, pdks): distinct violations of each rule and the PDKs that define it, sorted."""
    from weftspark.operators.retrieve import drc_rules

    ids = labelled.where("src_label = 'Rule'").select(F.col("src").alias("id")).unionAll(labelled.where("dst_label = 'Rule'").select(F.col("dst").alias("id")))
    return drc_rules(labelled, ids).withColumnRenamed("id", "rule")


def node_lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of the stated (label, id)."""
    return nodes.join(maybe_broadcast(wanted.select("label", "id").distinct()), ["label", "id"], "left_semi")


def top_counts(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k most frequent values and how often they occur; ties by value. The limit is the report's purpose."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


