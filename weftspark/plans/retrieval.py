"""Queries of graph facts and retrieval from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import graph, retrieve, router, search
from weftspark.plans import registry
from weftspark.plans.base import literal, query, values
from weftspark.util import cut, table

_VALID, _LINK, _label = registry._VALID, registry._LINK, registry._label
_LE = f"(SELECT DISTINCT {_label('subject_label')} AS sl, subject_id AS src, predicate AS type, {_label('object_label')} AS dl, object_id AS dst FROM triples WHERE {_VALID})"

#: A graph with facts of every kind: violations, fixes with and without reports, causes, versions that diverge, rules, modules.
SEED = [
    ("Fix", "fix_a", "FIXES", "Violation", "ed_001_override"), ("Fix", "fix_b", "FIXES", "Violation", "ed_001_override"), ("Fix", "fix_c", "FIXES", "Violation", "ed_002_units"), ("Module", "fix_d", "FIXES", "Violation", "ed_002_units"),
    ("Fix", "fix_a", "DOCUMENTED_IN", "Report", "doc_1"), ("Fix", "fix_a", "DOCUMENTED_IN", "Report", "doc_2"), ("Fix", "fix_c", "DOCUMENTED_IN", "Module", "doc_3"), ("ToolRun", "run_heron_1", "CAUSES", "Violation", "ed_001_override"), ("ToolRun", "run_heron_2", "CAUSES", "Violation", "ed_001_override"),
    ("ToolRun", "run_heron_1", "RAN_ON", "Version", "version_31q1"), ("Design", "design_heron", "RAN_ON", "Version", "version_31q1"), ("Design", "design_heron", "RAN_ON", "Version", "version_30q4"), ("Design", "design_plover", "RAN_ON", "Version", "version_30q4"), ("Version", "version_31q1", "DIVERGES_FROM", "Version", "version_30q4"),
    ("ToolRun", "run_heron_1", "HAS_TIMING", "Metric", "wns_1"), ("ToolRun", "run_heron_1", "HAS_METRIC", "Metric", "area_1"), ("ToolRun", "run_plover_1", "HAS_METRIC", "Metric", "area_2"), ("Rule", "rule_m2", "DEFINED_IN", "PDK", "pdk_b"), ("Rule", "rule_m2", "DEFINED_IN", "PDK", "pdk_a"),
    ("Violation", "drc_1", "VIOLATES", "Rule", "rule_m2"), ("Violation", "drc_2", "VIOLATES", "Rule", "rule_m2"), ("ToolRun", "run_heron_1", "VIOLATES", "Rule", "rule_m2"), ("Module", "module_top", "CONTAINS", "Module", "module_sub"), ("Module", "module_top", "DEFINED_IN", "Report", "file_top"), ("Fix", "fix_b", "TARGETS", "Version", "version_31q1"),
]
_SEED_SQL = values(SEED, "sl, src, type, dl, dst")
_SCHEMA = "src_label string, src string, type string, dst_label string, dst string"


def _diagnosis(e: str) -> str:
    part = "SELECT e.dst AS id, '{r}' AS role, e.src AS other, d.dst AS linked FROM {e} e LEFT JOIN (SELECT src, dst FROM {e} WHERE type IN ({t}) AND sl = '{l}' AND dl = '{x}') d ON d.src = e.src WHERE e.type = '{v}' AND e.sl = '{l}' AND e.dl = 'Violation'"
    return f"{part.format(r='fix', e=e, t=chr(39) + 'DOCUMENTED_IN' + chr(39), l='Fix', x='Report', v='FIXES')} UNION {part.format(r='cause', e=e, t=chr(39) + 'VERSION_OF' + chr(39) + ', ' + chr(39) + 'RAN_ON' + chr(39), l='ToolRun', x='Version', v='CAUSES')}"


def _rules(e: str, ids: str) -> str:
    return f"SELECT i.id, coalesce(pdks, '') AS pdks, coalesce(n, 0) AS violations FROM {ids} i LEFT JOIN (SELECT src, string_agg(DISTINCT dst, ', ' ORDER BY dst) AS pdks FROM {e} WHERE type = 'DEFINED_IN' AND sl = 'Rule' AND dl = 'PDK' GROUP BY src) p ON p.src = i.id LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM {e} WHERE type = 'VIOLATES' AND sl = 'Violation' AND dl = 'Rule' GROUP BY dst) v ON v.dst = i.id"


def _divergence(e: str, designs: str) -> str:
    return f"""SELECT DISTINCT design, 'version' AS kind, r.src || ' -> ' || r.dst AS shown, t.dst AS linked FROM {designs} JOIN {e} r ON contains(lower(r.src), design) LEFT JOIN (SELECT * FROM {e} WHERE type = 'DIVERGES_FROM' AND sl = 'Version' AND dl = 'Version') t ON t.src = r.dst WHERE r.type = 'RAN_ON' AND r.sl = 'Design' AND r.dl = 'Version'
UNION SELECT design, 'run', m.src, m.dst FROM {designs} JOIN {e} m ON contains(lower(m.src), design) WHERE m.type IN ('HAS_TIMING', 'HAS_METRIC') AND m.sl = 'ToolRun' AND m.dl = 'Metric'"""


def _context(e: str, limit: int = 30) -> str:
    return f"SELECT id, rel, neighbour, neighbour_label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel, neighbour, neighbour_label) AS r FROM (SELECT src AS id, type AS rel, dst AS neighbour, dl AS neighbour_label FROM {e} WHERE sl = 'Module' UNION SELECT dst, type, src, sl FROM {e} WHERE dl = 'Module')) WHERE r <= {limit}"


def _edges(s, d):
    return graph.labelled_edges(table(s, d, "triples"))


def _seed(s):
    return literal(s, SEED, _SCHEMA)


def _ends(e):
    return e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()


@query(_diagnosis(_LE))
def facts_of_violations(s, d):
    e = _edges(s, d)
    return retrieve.error_diagnosis(e, _ends(e))


@query(_diagnosis(_SEED_SQL))
def facts_of_seed_violations(s, d):
    return retrieve.error_diagnosis(_seed(s), _ends(_seed(s)))


@query(_rules(_SEED_SQL, f"(SELECT DISTINCT unnest([src, dst]) AS id FROM {_SEED_SQL})"))
def facts_of_rules(s, d):
    return retrieve.drc_rules(_seed(s), _ends(_seed(s))).withColumn("pdks", F.array_join("pdks", ", "))


_NAMES = "(SELECT unnest(['heron', 'plover', 'none']) AS design)"


@query(_divergence(_SEED_SQL, _NAMES))
def facts_of_designs(s, d):
    return retrieve.divergence(_seed(s), literal(s, [("Heron",), ("plover",), ("none",), ("",)], "design string"))


@query(_divergence(_LE, "(SELECT DISTINCT lower(canonical_name) AS design FROM canonical_entities WHERE kind = 'design')"))
def version_divergence(s, d):
    return retrieve.divergence(_edges(s, d).withColumn("src_label", F.when(F.col("type") == "HAS_METRIC", "ToolRun").otherwise(F.col("src_label"))), table(s, d, "canonical_entities").where("kind = 'design'").select(F.col("canonical_name").alias("design")))


registry.ORACLES["version_divergence"] = registry.ORACLES["version_divergence"].replace("m.sl = 'ToolRun'", "m.sl IN ('ToolRun', 'Design')")


@query(_context(_LE))
def facts_of_modules(s, d):
    e = _edges(s, d)
    return retrieve.rtl_context(e, _ends(e))


@query(f"SELECT src AS run, string_agg(DISTINCT dst, ';' ORDER BY dst) AS metrics FROM {_SEED_SQL} WHERE type IN ('HAS_TIMING', 'HAS_METRIC') GROUP BY src")
def run_metrics(s, d):
    return retrieve.metrics_of_runs(_seed(s)).withColumn("metrics", F.array_join("metrics", ";"))


_ROUTED = f"(SELECT id AS qid, CASE WHEN m = 0 THEN 'error_diagnosis' {registry._CAT} END AS category, round(least(1.0, m / CASE {registry._LEAST} END), 6) AS confidence FROM (SELECT *, {registry._TOP} AS m FROM (SELECT id, {registry._SCORES} FROM (SELECT id, lower(query) AS q FROM edabench WHERE query IS NOT NULL))))"
_HANDLER = "CASE " + " ".join(f"WHEN starts_with(lower(id), '{h}') THEN '{n}'" for n, hs in retrieve.PREFIXES for h in hs) + " " + " ".join(f"WHEN category = '{c}' THEN '{h}'" for c, h in retrieve.BY_CATEGORY.items()) + " ELSE 'subgraph' END"


def _facts(e: str, linked: str) -> str:
    """linked: (qid, category, id, rank)."""
    hop = "SELECT id, src || ' --[' || type || ']--> ' || dst AS line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, type, dst) AS r FROM (SELECT DISTINCT n.id, x.src, x.type, x.dst FROM (SELECT id, id AS at FROM {ids} UNION SELECT i.id, x.dst FROM {ids} i JOIN E x ON x.src = i.id UNION SELECT i.id, x.src FROM {ids} i JOIN E x ON x.dst = i.id) n JOIN E x ON x.src = n.at OR x.dst = n.at)) WHERE r <= 50"
    names = "(SELECT id, lower(replace(id, 'design_', '')) AS design FROM (SELECT id FROM T WHERE handler = 'divergence' UNION SELECT id FROM A))"
    return f"""WITH E AS MATERIALIZED (SELECT * FROM {e}), L AS (SELECT * FROM {linked}), T AS MATERIALIZED (SELECT *, {_HANDLER} AS handler FROM L WHERE rank <= 5),
A AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM T WHERE category = 'cross_tool_knowledge' AND (starts_with(lower(id), 'design_') OR length(id) <= 10)) WHERE r <= 2),
N AS (SELECT * FROM {names} WHERE design <> ''), V AS MATERIALIZED (SELECT N.id, kind, kind || ': ' || shown || CASE WHEN linked IS NULL THEN '' ELSE CASE WHEN kind = 'version' THEN ' (diverges from ' ELSE ' (metric ' END || linked || ')' END AS line FROM ({_divergence('E', '(SELECT DISTINCT design FROM N)')}) d JOIN N ON N.design = d.design),
H AS (SELECT DISTINCT id FROM V WHERE kind = 'version'), S AS (SELECT id FROM T WHERE handler = 'subgraph' UNION SELECT id FROM T WHERE handler = 'divergence' AND id NOT IN (SELECT id FROM H)), K AS MATERIALIZED ({hop.format(ids='S')}),
F AS (SELECT id, 'error_diagnosis' AS handler, upper(role[1]) || role[2:] || ' : ' || other || coalesce(' (' || linked || ')', '') AS line FROM ({_diagnosis('E')}) UNION SELECT id, 'drc_rules', 'pdks: ' || pdks || '; violations: ' || violations FROM ({_rules('E', "(SELECT DISTINCT id FROM T WHERE handler = 'drc_rules')")})
UNION SELECT id, 'rtl_context', rel || ' ' || neighbour FROM ({_context('E')}) UNION SELECT id, 'divergence', line FROM V WHERE id IN (SELECT id FROM H) UNION SELECT id, 'subgraph', line FROM K UNION SELECT id, 'divergence', line FROM K)
SELECT T.qid, T.id AS entity, T.handler, F.line FROM T JOIN F ON F.id = T.id AND F.handler = T.handler UNION ALL SELECT DISTINCT A.qid, A.id, 'version_divergence', V.line FROM A JOIN V ON V.id = A.id WHERE V.kind = 'version' AND V.id IN (SELECT id FROM H)"""


_BENCH_LINKED = f"(SELECT l.qid, r.category, l.id, l.rank FROM {_LINK} l JOIN {_ROUTED} r ON r.qid = l.qid)"


def _linked(s, d):
    q = router.route(table(s, d, "edabench").where("query is not null").select(F.col("id").alias("qid"), "query"), "query")
    return router.link(q, "qid", "query", graph.merge_nodes(table(s, d, "triples")).select("id")).join(q.select("qid", "category"), "qid")


@query(_facts(_LE, _BENCH_LINKED))
def entity_facts(s, d):
    return retrieve.entity_facts(_linked(s, d), _edges(s, d))


_ASKED = [("q1", "error_diagnosis", "ed_001_override", 1), ("q2", "cross_tool_knowledge", "design_heron", 1), ("q2", "cross_tool_knowledge", "version_31q1", 2), ("q3", "drc_rule_lookup", "rule_m2", 1), ("q4", "rtl_qa", "module_top", 1), ("q5", "rtl_qa", "design_none", 1), ("q6", "constraint_generation", "fix_a", 1), ("q6", "constraint_generation", "fix_b", 6)]


@query(_facts(_SEED_SQL, values(_ASKED, "qid, category, id, rank")))
def seed_facts(s, d):
    return retrieve.entity_facts(literal(s, _ASKED, "qid string, category string, id string, rank int"), _seed(s))


@query(f"""WITH {registry._RERANK}, c5 AS (SELECT qid, string_agg(CAST(did AS VARCHAR), ',' ORDER BY reranked) AS chunks FROM r GROUP BY qid), l AS (SELECT qid, string_agg(id, ',' ORDER BY rank) AS entities FROM {_LINK} GROUP BY qid)
SELECT k.qid, k.category AS task_category, k.confidence, coalesce(l.entities, '') AS entities, coalesce(c5.chunks, '') AS chunks FROM {_ROUTED} k LEFT JOIN l ON l.qid = k.qid LEFT JOIN c5 ON c5.qid = k.qid""")
def retrieve_answers(s, d):
    """Every benchmark query from route to context; the benchmark has no vectors, so the hybrid mode falls back to the sparse one. Facts are in entity_facts."""
    t = table(s, d, "triples")
    docs = table(s, d, "documents").select("doc_id", "text", F.col("source").alias("source_file"))
    r = retrieve.retrieve(table(s, d, "edabench").select("id", "query"), docs, cut(graph.labelled_edges(t)), graph.merge_nodes(t).select("id"))
    return r.select("qid", "task_category", F.round("confidence", 6).alias("confidence"), F.array_join("entities", ",").alias("entities"), F.array_join(F.transform("chunks", lambda c: c["did"].cast("string")), ",").alias("chunks"))


@query(f"WITH {registry._dense(5)} SELECT qid, did AS vid, round(score, 4) AS similarity FROM v")
def dense_similarity(s, d):
    """Dense results as they are shown: 1 minus the distance, four places."""
    e = table(s, d, "embeddings")
    x = search.dense(e, e.where("vec_id % 50 = 0"), 5)
    return x.select("qid", "vid", retrieve.shown_score(1 - F.col("score")).alias("similarity"))


@query(f"WITH {registry._bm25(registry._BENCH_Q, 10, 'b').replace('FROM documents', 'FROM (SELECT * FROM documents WHERE content_type = ' + chr(39) + 'documentation' + chr(39) + ')')} SELECT qid, did, round(score, 6) AS score, rank FROM b")
def bm25_filtered(s, d):
    """A filter on the content type before the ranking: counts and lengths are those of the filtered documents."""
    x = retrieve.candidates("sparse", table(s, d, "documents"), table(s, d, "edabench"), where=F.col("content_type") == "documentation")
    return x.select("qid", "did", F.round("score", 6).alias("score"), "rank")


@query()
def ivf_topk(s, d):
    """Approximate dense search: an inverted file over all vectors."""
    e = table(s, d, "embeddings")
    return search.ivf(e, e.where("vec_id % 50 = 0")).select("qid", "vid", F.round("score", 6).alias("score"), "rank")
