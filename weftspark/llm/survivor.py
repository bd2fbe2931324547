"""Best representative of each group of duplicate facts.

survivors: one record per group by declared precedence, each field from the first row that has it.
truth: iterative truth discovery, which estimates the reliability of sources and takes the field values
of highest support. The first is what p4_found is defined by; agreement() measures how often the second differs, see the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.util import cut, maybe_broadcast

KEYS = ("subject_id", "predicate", "object_id")


def loose(c: Column) -> Column:
    """Text without whitespace, _ and -, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_\-]+", ""))


def _rank() -> Column:
    """Smallest first: confidence descending with null last, extracted_at descending with null last, triple_id ascending. NaN counts as null."""
    conf = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    return F.struct(F.coalesce(-conf, F.lit(float("inf"))).alias("c"), F.coalesce(-F.unix_micros("extracted_at"), F.lit(2**63 - 1)).alias("t"), F.col("triple_id").alias("i"))


def _has_span() -> Column:
    return F.length(F.regexp_replace(F.coalesce("source_span", F.lit("")), r"(?U)\s+", "")) > 0


def _has_properties() -> Column:
    return F.coalesce(F.size("properties"), F.lit(0)) > 0


def groups(triples: DataFrame) -> DataFrame:
    """Per group of two rows or more: group_id, rows, and the id of the row for the record, source_span and properties.

    One aggregation with partial results on the map side: a group that holds a third of all rows sends one partial
    row per task. Rows with a null in a key belong to no group.
    """
    t = triples.where(" and ".join(f"{k} is not null" for k in KEYS))
    r = _rank()
    return (
        t.groupBy(*(loose(F.col(k)).alias(f"_{k}") for k in KEYS))
        .agg(
            F.count("*").alias("rows"), F.min("triple_id").alias("group_id"), F.min(r)["i"].alias("record"),
            F.min(F.when(_has_span(), r))["i"].alias("source_span"), F.min(F.when(_has_properties(), r))["i"].alias("properties"),
        )
        .where("rows > 1")
        .select("group_id", "rows", "record", "source_span", "properties")
    )


def provenance(triples: DataFrame) -> DataFrame:
    """(group_id, field, triple_id): the row that the record and each of its gaps are taken from; fields without any are left out."""
    g = groups(triples)
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("triple_id")) for f in ("record", "source_span", "properties")))
    return g.select("group_id", F.explode(parts).alias("x")).select("group_id", "x.*").where("triple_id is not null")


def survivors(triples: DataFrame) -> DataFrame:
    """One built record per group: the fields of its first row, source_span and properties from the first row that has them."""
    g = groups(triples)
    ids = triples.select("triple_id", *KEYS, "subject_label", "object_label", "confidence", "extracted_at", "source_file")
    out = g.join(ids, g.record == ids.triple_id).drop("triple_id")
    for f in ("source_span", "properties"):
        src = triples.select(F.col("triple_id").alias("_id"), F.col(f).alias(f"{f}_value"))
        out = out.join(src, out[f] == src._id, "left").drop("_id")
    return out.withColumnsRenamed({"record": "record_from", "source_span": "source_span_from", "properties": "properties_from"}).withColumnsRenamed({"source_span_value": "source_span", "properties_value": "properties"})


def _claimed(triples: DataFrame, f: str) -> Column:
    """A field as the text that is claimed for it: maps in the order of their keys, null for empty maps and NaN."""
    kind = triples.schema[f].dataType.typeName()
    if kind == "map":
        return F.when(F.size(f) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(f)))))
    return F.when(~F.isnan(f), F.col(f).cast("string")) if kind in ("double", "float") else F.col(f).cast("string")


def truth(triples: DataFrame, fields: tuple[str, ...] = ("subject_id", "predicate", "object_id", "subject_label", "object_label", "confidence", "source_span", "properties"), rounds: int = 500, tolerance: float = 1e-4) -> DataFrame:
    """(group_id, field, value, support, votes): the value of highest support per group and field, by truth discovery.

    A source is a source_file with an extraction tier; null files are one source. Its reliability starts at the mean
    confidence of its rows and is re-estimated as the smoothed share of support that its claims have, until no
    reliability moves by more than the tolerance; if that takes more rounds than given, an error is raised. A value's support is the sum of its
    claimants' reliabilities, -ln(1 - r), weighted by row confidence (0.5 where null). Nulls and blanks claim nothing.
    Ties go to the smaller value. Each round aggregates claims to (group, field, value) and to sources with
    partial results; only claims and reliabilities, both tables, pass from round to round.
    """
    used = dict.fromkeys(["triple_id", *KEYS, *fields, "source_file", "extraction_tier", "confidence"])
    t = triples.where(" and ".join(f"{k} is not null" for k in KEYS)).select(*used, *(loose(F.col(k)).alias(f"_{k}") for k in KEYS))
    big = t.groupBy(*(f"_{k}" for k in KEYS)).agg(F.count("*").alias("n"), F.min("triple_id").alias("group_id")).where("n > 1").drop("n")
    rows = t.join(big, [f"_{k}" for k in KEYS])
    source = F.concat_ws("|", F.coalesce("source_file", F.lit("?")), F.coalesce(F.col("extraction_tier").cast("string"), F.lit("?")))
    claims = rows.select("group_id", source.alias("src"), F.coalesce(F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")), F.lit(0.5)).alias("conf"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), _claimed(triples, f).alias("value")) for f in fields))).alias("x"))
    claims = claims.select("group_id", "src", "conf", "x.*").where("value is not null and trim(value) != ''")
    claims = cut(claims.groupBy("group_id", "field", "value", "src").agg(F.sum("conf").alias("conf"), F.count("*").alias("votes")))
    # a field's only value has a share of 1 in every round, so only contested claims pass through them
    several = claims.groupBy("group_id", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo != hi").select("group_id", "field")
    contested = cut(claims.join(several, ["group_id", "field"]))
    at_stake = contested.groupBy("src").agg(F.sum("votes").alias("open"))
    said_in_all = claims.groupBy("src").agg(F.sum("conf").alias("conf"), F.sum("votes").alias("all_votes")).join(at_stake, "src", "left").select("src", "conf", "all_votes", (F.col("all_votes") - F.coalesce("open", F.lit(0))).alias("alone"))
    sources = cut(said_in_all)
    bounded = lambda r: F.least(F.greatest(r, F.lit(0.05)), F.lit(0.95)).alias("r")
    rel = cut(sources.select("src", bounded(F.col("conf") / F.col("all_votes"))))
    for _ in range(rounds):
        said = contested.join(maybe_broadcast(rel), "src").withColumn("weight", -F.log(1 - F.col("r")) * F.col("conf"))
        support = said.groupBy("group_id", "field", "value").agg(F.sum("weight").alias("support"))
        share = support.join(support.groupBy("group_id", "field").agg(F.sum("support").alias("all")), ["group_id", "field"]).select("group_id", "field", "value", (F.col("support") / F.col("all")).alias("share"))
        won = contested.join(share, ["group_id", "field", "value"]).groupBy("src").agg(F.sum(F.col("share") * F.col("votes")).alias("won"))
        new = cut(sources.join(won, "src", "left").select("src", bounded((F.coalesce("won", F.lit(0.0)) + F.col("alone") + 1) / (F.col("all_votes") + 2))))
        moved = new.join(rel.withColumnRenamed("r", "old"), "src").agg(F.max(F.abs(F.col("r") - F.col("old")))).first()[0]
        rel = new
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved} after {rounds} rounds")
    support = claims.join(maybe_broadcast(rel), "src").groupBy("group_id", "field", "value").agg(F.sum(-F.log(1 - F.col("r")) * F.col("conf")).alias("support"), F.sum("votes").alias("votes"))
    best = support.groupBy("group_id", "field").agg(F.min(F.struct((-F.col("support")).alias("s"), "value", "votes")).alias("b"))
    return best.select("group_id", "field", F.col("b.value").alias("value"), (-F.col("b.s")).alias("support"), F.col("b.votes").alias("votes"))


def agreement(triples: DataFrame, elected: DataFrame) -> DataFrame:
    """(field, groups, differ): in how many groups the value that truth() elects (elected) is another than that of the row which precedence names, by field."""
    p = provenance(triples)
    out = None
    for f, row in (("confidence", "record"), ("source_span", "source_span"), ("properties", "properties")):
        own = p.where(F.col("field") == row).join(triples.select("triple_id", F.trim(_claimed(triples, f)).alias("own")), "triple_id").select("group_id", "own")
        j = own.join(elected.where(F.col("field") == f).select("group_id", F.trim("value").alias("value")), "group_id").where("own is not null")
        n = j.agg(F.lit(f).alias("field"), F.count("*").alias("groups"), F.count_if(F.expr("own != value")).alias("differ"))
        out = n if out is None else out.unionByName(n)
    return out
