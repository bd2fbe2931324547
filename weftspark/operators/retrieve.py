"""Retrieval over graph and texts: entities of queries, facts by kind of entity, one answer row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators import graph, router, search
from weftspark.operators.ranks import top_per_group
from weftspark.util import cut, maybe_broadcast

MODES = ("hybrid", "dense", "sparse")


# --- facts about given nodes: each operator takes a table of ids and all edges -----------------------------------------


def error_diagnosis(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, role, other, linked): fixes of each violation with the reports that document the fix, and its causes with their versions; linked is null where there is none.

    edges as of graph.labelled_edges. Labels must match: a Fix that FIXES a Violation, a Report that a Fix is DOCUMENTED_IN, a ToolRun that CAUSES it.
    """
    ids = maybe_broadcast(ids.select("id").distinct())
    out = []
    for role, label, via, then, end in (("fix", "Fix", "FIXES", ("DOCUMENTED_IN",), "Report"), ("cause", "ToolRun", "CAUSES", ("VERSION_OF", "RAN_ON"), "Version")):
        first = edges.where((F.col("type") == via) & (F.col("src_label") == label) & (F.col("dst_label") == "Violation")).select(F.col("dst").alias("id"), F.col("src").alias("other")).join(ids, "id", "left_semi")
        second = edges.where(F.col("type").isin(*then) & (F.col("src_label") == label) & (F.col("dst_label") == end)).select(F.col("src").alias("other"), F.col("dst").alias("linked"))
        out.append(first.join(second, "other", "left").select("id", F.lit(role).alias("role"), "other", "linked"))
    return out[0].unionByName(out[1]).distinct()


def drc_rules(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, pdks, violations): PDKs that each rule is defined in, sorted, and its distinct violations. Each side is aggregated before the join."""
    ids = ids.select("id").distinct()
    pdk = edges.where("type = 'DEFINED_IN' and src_label = 'Rule' and dst_label = 'PDK'").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("pdks"))  # the few PDKs of a rule
    n = edges.where("type = 'VIOLATES' and src_label = 'Violation' and dst_label = 'Rule'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("violations"))
    return ids.join(pdk, "id", "left").join(n, "id", "left").select("id", F.coalesce("pdks", F.array().cast("array<string>")).alias("pdks"), F.coalesce("violations", F.lit(0)).alias("violations"))


def divergence(edges: DataFrame, designs: DataFrame) -> DataFrame:
    """(design, kind, shown, linked): versions that designs whose id contains the name ran on, with the version each diverges from, and runs whose id contains it, with their metrics.

    designs is a stated set of names, against all edges.
    """
    d = maybe_broadcast(designs.select(F.lower("design").alias("design")).where("design != ''").distinct())
    ran = edges.where("type = 'RAN_ON' and src_label = 'Design' and dst_label = 'Version'").select(F.col("src").alias("id"), F.col("dst").alias("version"))
    to = edges.where("type = 'DIVERGES_FROM' and src_label = 'Version' and dst_label = 'Version'").select(F.col("src").alias("version"), F.col("dst").alias("to"))
    versions = ran.join(d, F.contains(F.lower("id"), F.col("design"))).join(to, "version", "left").select("design", F.lit("version").alias("kind"), F.concat_ws(" -> ", "id", "version").alias("shown"), F.col("to").alias("linked"))
    metrics = edges.where("type in ('HAS_TIMING', 'HAS_METRIC') and src_label = 'ToolRun' and dst_label = 'Metric'").select(F.col("src").alias("id"), F.col("dst").alias("linked"))
    runs = metrics.join(d, F.contains(F.lower("id"), F.col("design"))).select("design", F.lit("run").alias("kind"), F.col("id").alias("shown"), "linked")
    return versions.unionByName(runs).distinct()


def rtl_context(edges: DataFrame, ids: DataFrame, limit: int | None = 30) -> DataFrame:
    """(id, rel, neighbour, neighbour_label): neighbours of modules over any relation, either way; the first so many per module by relation and neighbour."""
    e = edges.select("src", "src_label", "type", "dst", "dst_label")
    out = e.where("src_label = 'Module'").select(F.col("src").alias("id"), F.col("type").alias("rel"), F.col("dst").alias("neighbour"), F.col("dst_label").alias("neighbour_label"))
    back = e.where("dst_label = 'Module'").select(F.col("dst").alias("id"), F.col("type").alias("rel"), F.col("src").alias("neighbour"), F.col("src_label").alias("neighbour_label"))
    got = out.unionByName(back).join(maybe_broadcast(ids.select("id").distinct()), "id", "left_semi").distinct()
    return got if limit is None else top_per_group(got, ["id"], [F.col("rel"), F.col("neighbour"), F.col("neighbour_label")], limit).drop("rank")


def metrics_of_runs(edges: DataFrame) -> DataFrame:
    """(run, metrics): the distinct metrics of each run, sorted."""
    m = edges.where("type in ('HAS_TIMING', 'HAS_METRIC') and src_label = 'ToolRun' and dst_label = 'Metric'")
    return m.groupBy(F.col("src").alias("run")).agg(F.array_sort(F.collect_set("dst")).alias("metrics"))  # a run's own metrics


# fixed values: what the beginning of an entity's id says about where its facts lie, and where else they are looked for, by category
PREFIXES = [("error_diagnosis", ("ed_", "violation_")), ("divergence", ("design_",)), ("drc_rules", ("rule_", "constraint_")), ("subgraph", ("version_", "tool_"))]
BY_CATEGORY = {"error_diagnosis": "error_diagnosis", "rtl_qa": "rtl_context", "constraint_generation": "subgraph", "drc_rule_lookup": "drc_rules", "cross_tool_knowledge": "subgraph"}


def handler(entity: Column, category: Column) -> Column:
    """Which facts an entity gets: by the beginning of its id, else by the query's category, else its neighbourhood."""
    out = F.try_element_at(F.create_map(*(F.lit(x) for kv in BY_CATEGORY.items() for x in kv)), category)
    for name, heads in reversed(PREFIXES):
        for h in heads:
            out = F.when(F.lower(entity).startswith(h), name).otherwise(out)
    return F.coalesce(out, F.lit("subgraph"))


def entity_facts(linked: DataFrame, edges: DataFrame, cap: int = 5, hops: int = 2, limit: int = 50) -> DataFrame:
    """(qid, entity, handler, line): one row per fact of the first `cap` entities of each query.

    linked: (qid, category, id, rank). Designs without versions get their neighbourhood instead; for queries across tools, the first two designs also
    get theirs under the handler version_divergence. Facts are looked up once per entity, then joined to the queries.
    """
    top = cut(linked.where(F.col("rank") <= cap).withColumn("handler", handler(F.col("id"), F.col("category"))))
    edges = cut(edges)
    of = lambda h: top.where(F.col("handler") == h).select("id").distinct()
    show = lambda a, mid, b: F.concat(a, F.lit(mid), b)
    facts = []
    d = error_diagnosis(edges, of("error_diagnosis"))
    facts.append(d.select("id", F.lit("error_diagnosis").alias("handler"), F.concat_ws(" ", F.initcap("role"), F.lit(":"), "other", F.concat(F.lit("("), "linked", F.lit(")"))).alias("line")))
    rules = drc_rules(edges, of("drc_rules"))
    facts.append(rules.select("id", F.lit("drc_rules").alias("handler"), F.concat(F.lit("pdks: "), F.array_join("pdks", ", "), F.lit("; violations: "), F.col("violations").cast("string")).alias("line")))
    facts.append(rtl_context(edges, of("rtl_context")).select("id", F.lit("rtl_context").alias("handler"), show(F.col("rel"), " ", F.col("neighbour")).alias("line")))
    across = top.where("category = 'cross_tool_knowledge' and (lower(id) like 'design\\\\_%' or length(id) <= 10)")
    across = top_per_group(across.select("qid", "id", F.col("rank").alias("r")), ["qid"], [F.col("r")], 2).select("qid", "id")
    names = of("divergence").unionByName(across.select("id").distinct()).distinct().withColumn("design", F.lower(F.replace("id", F.lit("design_"), F.lit(""))))
    v = cut(divergence(edges, names).join(names, "design").select("id", "kind", divergence_line().alias("line")))
    have = v.where("kind = 'version'").select("id").distinct()
    facts.append(v.join(have, "id", "left_semi").select("id", F.lit("divergence").alias("handler"), "line"))
    around = of("subgraph").unionByName(of("divergence").join(have, "id", "left_anti")).distinct()
    sub = graph.k_hop_edges(edges.select("src", "type", "dst"), around, hops, limit)
    line = F.concat(F.col("src"), F.lit(" --["), F.col("type"), F.lit("]--> "), F.col("dst"))
    for h in ("subgraph", "divergence"):
        facts.append(sub.select(F.col("start").alias("id"), F.lit(h).alias("handler"), line.alias("line")))
    f = facts[0]
    for x in facts[1:]:
        f = f.unionByName(x)
    got = top.join(f.distinct(), ["id", "handler"]).select("qid", F.col("id").alias("entity"), "handler", "line")
    extra = across.join(v.join(have, "id", "left_semi").where("kind = 'version'").select("id", "line"), "id").select("qid", F.col("id").alias("entity"), F.lit("version_divergence").alias("handler"), "line")
    return got.unionByName(extra.distinct())


def divergence_line() -> Column:
    return F.concat(F.col("kind"), F.lit(": "), F.col("shown"), F.when(F.col("linked").isNull(), "").otherwise(F.concat(F.when(F.col("kind") == "version", " (diverges from ").otherwise(" (metric "), F.col("linked"), F.lit(")"))))


# --- chunks and the answer --------------------------------------------------------------------------------------------


def candidates(mode: str, docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10, where: Column | None = None) -> DataFrame:
    """(qid, did, score, rank) by mode. A hybrid search without vectors falls back to the sparse one; another mode is an error. A filter applies to the documents before they are ranked."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    docs = docs if where is None else docs.where(where)
    if mode == "sparse" or (mode == "hybrid" and (vectors is None or query_vectors is None)):
        return search.bm25(docs, queries, k)
    if vectors is None or query_vectors is None:
        raise ValueError("dense search needs vectors of documents and queries")
    v = vectors if where is None else vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = search.dense(v, query_vectors, k if mode == "dense" else 2 * k).withColumnRenamed("vid", "did")
    return dense if mode == "dense" else search.hybrid(cut(dense), cut(search.bm25(docs, queries, 2 * k)), k=k)


def shown_score(cosine_distance: Column) -> Column:
    """Similarity as results show it: 1 minus the distance, four places."""
    return F.round(1 - cosine_distance, 4)


def clamp(k: Column, least: int = 1, most: int = 10) -> Column:
    return F.least(F.greatest(k, F.lit(least)), F.lit(most))


def citations(chunks: Column) -> Column:
    """Distinct non-empty source files of an array of chunks, in order."""
    return F.array_distinct(F.filter(F.transform(chunks, lambda c: c["source_file"]), lambda s: F.coalesce(s, F.lit("")) != ""))


def retrieve(queries: DataFrame, docs: DataFrame, edges: DataFrame, node_ids: DataFrame, mode: str = "hybrid", top_k: int = 5, pool: int = 10, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, most_facts: int = 15, score=search.overlap_score) -> DataFrame:
    """One row per query: qid, task_category, confidence, entities, facts (lines by entity), chunks (did, source_file, score, text), citations, context.

    queries (id, query), a stated set; docs (doc_id, text, source_file). Route, link, look up facts, search a pool, rerank it by `score` (query, text), render.
    Per query no more than five entities, most_facts lines each and top_k chunks are gathered; these limits are the operator's purpose.
    """
    q = cut(router.route(queries.where(F.col("query").isNotNull()).select(F.col("id").alias("qid"), "query").distinct(), "query"))
    linked = router.link(q, "qid", "query", node_ids).join(q.select("qid", "category"), "qid")
    linked = cut(linked)
    ents = linked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("entities"))  # ids that one query names
    f = entity_facts(linked, edges)
    f = top_per_group(f, ["qid", "entity", "handler"], [F.col("line")], most_facts, "n")
    per = f.groupBy("qid", "entity", "handler").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    facts = per.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("entity", "handler", "lines"))).alias("facts"))
    top = candidates(mode, docs, q.select(F.col("qid").alias("id"), "query"), vectors, query_vectors, pool)
    c = docs.select(F.col("doc_id").alias("did"), "text", "source_file").join(maybe_broadcast(cut(top).select("qid", "did", "rank")), "did").join(maybe_broadcast(q.select("qid", "query")), "qid")
    c = search.rerank(cut(c.select("qid", "did", "rank", score(F.col("query"), F.col("text")).alias("rerank_score"), "text", "source_file")), top_k, keep=("text", "source_file"))
    chunks = c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("reranked_rank", "did", "source_file", F.col("rerank_score").alias("score"), "text"))).alias("chunks"))  # top_k of them
    out = q.join(ents, "qid", "left").join(facts, "qid", "left").join(chunks, "qid", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = out.select("qid", F.col("category").alias("task_category"), "confidence", none("entities", "array<string>").alias("entities"), none("facts", "array<struct<entity:string,handler:string,lines:array<string>>>").alias("facts"), none("chunks", c_type()).alias("chunks"))
    return out.withColumn("citations", citations(F.col("chunks"))).withColumn("context", context(F.col("facts"), F.col("chunks")))


def c_type() -> str:
    return "array<struct<reranked_rank:int,did:bigint,source_file:string,score:double,text:string>>"


def context(facts: Column, chunks: Column) -> Column:
    """What a model is shown: facts by entity, then the chunks, numbered, with source and score."""
    by_entity = F.transform(facts, lambda f: F.concat(F.lit("\n### Entity: "), f["entity"], F.lit("\n"), F.array_join(F.transform(f["lines"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    numbered = F.transform(chunks, lambda c: F.concat(F.lit("\n### ["), c["reranked_rank"].cast("string"), F.lit("] "), F.coalesce(c["source_file"], F.lit("unknown")), F.lit(" (score: "), F.format_string("%.3f", c["score"]), F.lit(")\n"), F.coalesce(c["text"], F.lit(""))))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")))
    return F.concat_ws("\n", part("## Knowledge Graph Facts", by_entity), part("\n## Retrieved Documents", numbered))
