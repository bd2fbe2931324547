"""Query routing and entity linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftspark.util import cut, maybe_broadcast

# fixed values: keywords of each category, in the order that decides ties
SIGNALS = {
    "error_diagnosis": "error crash violation failed fail sigsegv segfault wns tns slack drc timing setup hold bug fix wrong broken issue".split(),
    "rtl_qa": "module port wire reg always assign verilog rtl input output inout instance net signal flip-flop latch mux decoder".split(),
    "constraint_generation": "sdc create_clock set_false_path set_multicycle_path constraint clock period uncertainty set_input_delay set_output_delay set_max_delay group_path".split(),
    "drc_rule_lookup": "spacing enclosure layer metal via rule width density antenna min_area overlap pdk sky130 asap7 nangate".split(),
    "cross_tool_knowledge": "version orfs yosys openroad openlane diverge upgrade migration compatibility tool release regression difference change".split(),
}


def hits(query: Column, keywords: list[str]) -> Column:
    """Keywords that are contained, each counted once."""
    q = F.lower(query)
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(q, F.lit(k)).cast("int")
    return total


def route(queries: DataFrame, query: str) -> DataFrame:
    """category and confidence of each row: most keywords wins, the earlier category on ties; without any, error_diagnosis at 0. Null queries have none."""
    scored = F.array(*(F.struct(F.coalesce(hits(F.col(query), w), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c"), F.lit(float(max(3.0, len(w) * 0.3))).alias("least")) for i, (c, w) in enumerate(SIGNALS.items())))
    best = F.array_max(scored)
    return queries.withColumn("_b", best).withColumn("category", F.when(F.col("_b.n") > 0, F.col("_b.c")).otherwise("error_diagnosis")).withColumn("confidence", F.least(F.lit(1.0), F.col("_b.n") / F.col("_b.least"))).drop("_b")


# fixed values: beginnings of ids after which a name may stand alone in a query, the names, and versions that count as they are
PREFIXES = ("design_", "version_", "tool_", "ed_")
NAMES = "jpeg ibex aes gcd riscv32i swerv swerv_wrapper orfs yosys openroad openlane".split()
VERSION_NAMES = ("v3.0", "v3_0", "26q1")
_GRAM = 4


def _grams(q: DataFrame) -> DataFrame:
    at = F.sequence(F.lit(1), F.length("q") - (_GRAM - 1))
    return q.where(F.length("q") >= _GRAM).select(F.explode(F.transform(at, lambda i: F.substring(F.col("q"), i, F.lit(_GRAM)))).alias("g")).distinct()


def link(queries: DataFrame, query_id: str, query: str, ids: DataFrame, id_col: str = "id", keep: int | None = None, names: list[str] = NAMES, versions: tuple[str, ...] = VERSION_NAMES) -> DataFrame:
    """(qid, id, rank): ids that a query names, longest first. The queries are a stated set; all ids pass by them. With keep, the first so many per query.

    An id is named where the query contains it; where it is one of PREFIXES and a name of `names` that is a word of the query, or a version of
    `versions` that the query contains; or where the query has ed, with or without - or _, and three digits, and the id has these.
    Only ids whose first and last four letters stand in some query are compared with the queries: two lookups per id.
    """
    q = cut(queries.where(F.col(query).isNotNull()).select(F.col(query_id).alias("qid"), F.lower(query).alias("q")).distinct())
    small = maybe_broadcast(q, 20_000)
    n = ids.where(F.coalesce(id_col, F.lit("")) != "").select(F.col(id_col).alias("id")).distinct().withColumn("low", F.lower("id"))
    n = cut(n)
    grams = maybe_broadcast(cut(_grams(q)))
    long = n.where(F.length("low") >= _GRAM)
    for end in (F.substring("low", 1, _GRAM), F.expr(f"right(low, {_GRAM})")):
        long = long.withColumn("g", end).join(grams, "g", "left_semi").drop("g")
    short = n.where(F.length("low") < _GRAM)
    parts = [long.unionByName(short).join(small, F.contains(F.col("q"), F.col("low"))).select("qid", "id")]
    # what stands after a prefix
    head = F.regexp_extract("low", f"^({'|'.join(PREFIXES)})(.*)$", 2)
    tail = n.select("id", head.alias("tail")).where("tail != ''")
    words = q.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"\b\w+\b"), F.lit(0)))).alias("tail")).where(F.col("tail").isin(*names))
    parts.append(tail.join(maybe_broadcast(words), "tail").select("qid", "id"))
    said = q.select("qid", F.explode(F.filter(F.array(*map(F.lit, versions)), lambda v: F.contains(F.col("q"), v))).alias("tail"))
    parts.append(tail.join(maybe_broadcast(said), "tail").select("qid", "id"))
    number = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?=(ed_?\d{3}))"), F.lit(1)))
    asked = q.select("qid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("q", F.lit(r"\b(ed[_-]?\d{3})\b"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit("_"))))).alias("ed"))
    parts.append(n.select("id", F.explode(number("low")).alias("ed")).join(maybe_broadcast(asked), "ed").select("qid", "id"))
    j = parts[0]
    for p in parts[1:]:
        j = j.unionByName(p)
    w = W.partitionBy("qid").orderBy(F.length("id").desc(), "id")
    r = j.distinct().withColumn("rank", F.row_number().over(w))
    return r if keep is None else r.where(F.col("rank") <= keep)
