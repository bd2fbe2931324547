"""Queries of the core operators over whole tables, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import chunking, corpus, evaluate, extract, graph, inject, ranks, reports, router, search, splits, units
from weftspark.plans.base import ORACLES, QUERIES, listed, query
from weftspark.streaming import jobs
from weftspark.util import cut, shared_dir, table

_in = listed


# --- units -------------------------------------------------------------------------------------------------------


@query()
def p2_found(s, d):
    return units.recorded_otherwise(table(s, d, "orfs_runs"), table(s, d, "unit_declarations"))


@query()
def p2_common_units(s, d):
    return units.to_common_units(table(s, d, "orfs_runs"), table(s, d, "unit_declarations"))


# --- corpus --------------------------------------------------------------------------------------------------------

_EXT = " ".join(
    f"WHEN ext IN {_in(v)}" + (" OR ends_with(name, '_report.txt')" if k == "log" else "") + f" THEN '{k}'" for k, v in corpus.EXTENSIONS.items()
)


@query(f"""SELECT DISTINCT artifact_id, file_path, CASE WHEN file_path IS NULL THEN NULL WHEN name = '6_report.json' THEN 'orfs_report' {_EXT} ELSE 'other' END AS content_type
FROM (SELECT *, lower(string_split(file_path, '/')[-1]) AS name, regexp_extract(lower(string_split(file_path, '/')[-1]), '^.+(\\.[^.]*)$', 1) AS ext FROM manifest)""")
def content_types(s, d):
    m = table(s, d, "manifest")
    return m.select("artifact_id", "file_path", corpus.content_type(F.col("file_path")).alias("content_type")).distinct()


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", corpus.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT source, count(*) AS file_count, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 4 AS BIGINT) AS token_count_approx FROM documents GROUP BY source")
def source_manifest(s, d):
    return corpus.source_manifest(table(s, d, "documents"), "source", "text")


_COPIES = "SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS keep_id FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, doc_id FROM documents WHERE text IS NULL"


@query(f"SELECT doc_id, keep_id, keep_id <> doc_id AS is_duplicate FROM ({_COPIES})")
def exact_duplicates(s, d):
    return corpus.exact_duplicates(table(s, d, "documents"))


@query(f"SELECT count(*) AS docs, count_if(keep_id <> doc_id) AS duplicates, count_if(keep_id = doc_id) AS kept, 100.0 * count_if(keep_id <> doc_id) / greatest(count(*), 1) AS duplicate_pct FROM ({_COPIES})")
def dedup_report(s, d):
    x = corpus.exact_duplicates(table(s, d, "documents"))
    return x.agg(F.count("*").alias("docs"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(~F.col("is_duplicate")).alias("kept")).withColumn("duplicate_pct", 100.0 * F.col("duplicates") / F.greatest("docs", F.lit(1)))


def _shingles(t: str, key: str, text: str, least_one: bool = False) -> str:
    short = "WHEN len(w) > 0 THEN [array_to_string(w, ' ')]" if least_one else ""
    return f"""(SELECT {key}, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) {short} ELSE [] END AS s
      FROM (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '') AS w FROM {t} WHERE {text} IS NOT NULL))"""


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), ',')) AS key FROM {_shingles("documents", "doc_id", "text")} WHERE len(s) > 0),
reps AS (SELECT key, min(doc_id) AS rep FROM k GROUP BY key),
g AS (SELECT doc_id AS id, n, unnest(s) AS g FROM k WHERE doc_id IN (SELECT rep FROM reps)),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE i >= 0.8 * (na + nb - i) - 1e-9),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS c FROM reps UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(c) AS class_id FROM r GROUP BY id),
deg AS (SELECT x AS id, count(*) AS links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(deg.links, 0) AS links FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN reps ON reps.key = k.key LEFT JOIN c ON c.id = reps.rep LEFT JOIN deg ON deg.id = reps.rep""")
def near_duplicate_classes(s, d):
    return corpus.near_duplicate_classes(table(s, d, "documents"))


def _contaminated(t: str, key: str, text: str, rule: str) -> str:
    uni = "ni" if rule == "containment" else "nc + ni - inter"
    return f"""WITH c AS (SELECT {key} AS id, len(s) AS nc, unnest(s) AS g FROM {_shingles(t, key, text, True)}), i AS (SELECT id AS item_id, len(s) AS ni, unnest(s) AS g FROM {_shingles("edabench", "id", "query", True)}),
j AS (SELECT c.id, item_id, nc, ni, count(*) AS inter FROM c JOIN i ON c.g = i.g GROUP BY ALL), u AS (SELECT *, CAST({uni} AS BIGINT) AS uni FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -CAST(inter AS DOUBLE) / uni, item_id) AS r FROM u WHERE inter >= 0.7 * uni - 1e-9)
SELECT id AS {key}, item_id, inter, uni FROM b WHERE r = 1"""


@query(_contaminated("qa_raw", "qa_id", "question", "jaccard"))
def contamination_jaccard(s, d):
    return corpus.contamination(table(s, d, "qa_raw"), "qa_id", "question", table(s, d, "edabench"), "id", "query")


@query(_contaminated("documents", "doc_id", "text", "containment"))
def contamination_containment(s, d):
    return corpus.contamination(table(s, d, "documents"), "doc_id", "text", table(s, d, "edabench"), "id", "query", containment=True)


@query("SELECT q.qa_id, q.seed_bug_id FROM qa_raw q WHERE q.seed_bug_id IS NULL OR q.seed_bug_id NOT IN (SELECT seed_bug_id FROM edabench WHERE seed_bug_id IS NOT NULL)")
def resume_anti_join(s, d):
    return corpus.not_done(table(s, d, "qa_raw").select("qa_id", "seed_bug_id"), table(s, d, "edabench"), "seed_bug_id").select("qa_id", "seed_bug_id")


_MANIFEST = "artifact_id source_type source_name source_url file_path content_hash token_count license tool_name tool_version pdk_version design_name scrape_date format dedup_status".split()
_TEXT = ", ".join(f"CASE WHEN {c} IS NULL OR lower(CAST({c} AS VARCHAR)) IN ('none', 'nan') THEN '' ELSE CAST({c} AS VARCHAR) END AS {c}" for c in _MANIFEST)


@query(f"SELECT {_TEXT} FROM manifest UNION ALL SELECT {_TEXT} FROM orfs_runs")
def manifest_union(s, d):
    return corpus.union_manifests(table(s, d, "manifest"), table(s, d, "orfs_runs"))


@query(f"""WITH x AS (SELECT o.source AS source_name, count(*) AS n FROM ({_COPIES}) k JOIN documents o USING (doc_id) WHERE k.keep_id <> k.doc_id GROUP BY o.source)
SELECT artifact_id, source_name, coalesce(n, 0) AS dedup_removed, 'complete' AS dedup_status FROM manifest LEFT JOIN x USING (source_name)""")
def manifest_update(s, d):
    docs = table(s, d, "documents")
    gone = corpus.exact_duplicates(docs).where("is_duplicate").join(docs.select("doc_id", F.col("source").alias("source_name")), "doc_id")
    return corpus.update_manifest(table(s, d, "manifest").select("artifact_id", "source_name"), gone, "source_name").select("artifact_id", "source_name", "dedup_removed", "dedup_status")


# --- chunks --------------------------------------------------------------------------------------------------------


@query("SELECT content_type, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, count_if(token_count > 512) AS oversized FROM chunks GROUP BY content_type")
def chunk_summary(s, d):
    return chunking.chunk_summary(table(s, d, "chunks"))


@query("SELECT chunk_id, substr(md5(concat_ws('_', source_file, CAST(chunk_index AS VARCHAR))), 1, 16) AS made_id FROM chunks")
def chunk_ids(s, d):
    return table(s, d, "chunks").select("chunk_id", chunking.chunk_id("source_file", "chunk_index").alias("made_id"))


@query()
def chunk_documentation(s, d):
    return chunking.chunk_documentation(table(s, d, "documents"), "doc_id")


def _files(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Texts of all chunk rows whose file is of these kinds by its path; data files are cut like logs, as in the original."""
    return table(s, d, "chunks").where(corpus.routed_type(F.col("source_file"), F.col("content_type")).isin(*kinds)).select("chunk_id", "source_file", "text").distinct()


@query()
def chunk_code(s, d):
    return chunking.chunk_code(_files(s, d, "code", "source_code"), "chunk_id", F.regexp_extract("source_file", r"(\.[^./]+)$", 1))


@query()
def chunk_log(s, d):
    return chunking.chunk_log(_files(s, d, "log", "data"), "chunk_id")


@query()
def chunk_forum(s, d):
    return chunking.chunk_forum(table(s, d, "qa_raw"), "qa_id", "question", "evidence_span", "answer")


# --- extraction ----------------------------------------------------------------------------------------------------


def _matches(t: str, key: str, text: str, pattern: str, groups: dict[str, int]) -> str:
    p = pattern.replace("'", "''")
    cols = ", ".join(f"regexp_extract_all({text}, '{p}', {g}) AS {n}" for n, g in groups.items())
    out = ", ".join(f"{n}[i + 1] AS {n}" for n in groups)
    first = next(iter(groups))
    return f"SELECT {key}, CAST(i AS INTEGER) AS pos, {out} FROM (SELECT *, unnest(range(0, len({first}))) AS i FROM (SELECT {key}, {cols} FROM {t} WHERE {text} IS NOT NULL))"


def _extractor(name: str, t: str, key: str, pattern: str, groups: dict[str, int]) -> None:
    def run(s, d):
        return extract.matches(table(s, d, t), key, "text", pattern, groups)

    QUERIES[name] = run
    ORACLES[name] = _matches(t, key, "text", pattern, groups)


_extractor("extract_slacks", "documents", "doc_id", extract.SLACK_STATUS, {"status": 1, "slack": 2})
_extractor("extract_drc", "documents", "doc_id", extract.DRC, {"rule": 1, "layer": 2, "x": 3, "y": 4})
_extractor("extract_periods", "documents", "doc_id", extract.PERIOD, {"period": 1})
_extractor("extract_units", "documents", "doc_id", extract.UNITS, {"unit": 1})
_extractor("extract_modules", "chunks", "chunk_id", extract.MODULE, {"module": 1})
_extractor("extract_settings", "documents", "doc_id", extract.SETTING, {"name": 1, "value": 2})

_TOOLS = "LoomFlow Tessera Pitonne Sylvane Kartsch Ravelin".split()


@query(f"""SELECT DISTINCT doc_id, tool[i] AS tool, version[i] AS version FROM (SELECT *, unnest(range(1, len(tool) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\\b({"|".join(_TOOLS)})\\s+(?:v|version\\s+)?(\\d+\\.\\d+(?:\\.\\d+)?)', 1) AS tool,
regexp_extract_all(text, '(?i)\\b({"|".join(_TOOLS)})\\s+(?:v|version\\s+)?(\\d+\\.\\d+(?:\\.\\d+)?)', 2) AS version FROM documents WHERE text IS NOT NULL))""")
def extract_tool_versions(s, d):
    return extract.tool_versions(table(s, d, "documents"), "doc_id", "text", _TOOLS)


@query(f"""SELECT doc_id, p[2 * i - 1] AS startpoint, p[2 * i] AS endpoint FROM (SELECT *, unnest(range(1, len(p) // 2 + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{extract.ENDPOINT}', 1) AS p FROM documents WHERE text IS NOT NULL))""")
def extract_paths(s, d):
    return extract.path_pairs(table(s, d, "documents"), "doc_id", "text")


@query("""SELECT chunk_id, coalesce((regexp_matches(lower(source_file), 'forum|discussion|issue|qa_pair') OR regexp_matches(string_split(lower(source_file), '/')[-1], 'readme|doc|guide|tutorial|\\.md|\\.rst')) AND length(text) >= 200, false) AS needs_model FROM chunks""")
def model_routing(s, d):
    return table(s, d, "chunks").select("chunk_id", extract.needs_model(F.col("source_file"), F.col("text")).alias("needs_model"))


@query("""SELECT subject_id, predicate, object_id, triple_id, coalesce(confidence, 0) AS confidence, copies FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY coalesce(confidence, 0) DESC, triple_id) AS r, count(*) OVER (PARTITION BY subject_id, predicate, object_id) AS copies FROM triples) WHERE r = 1""")
def triples_argmax_dedup(s, d):
    return extract.argmax_dedup(table(s, d, "triples"))


@query("""SELECT stat, key, count(*) AS n FROM (SELECT 'label' AS stat, subject_label AS key FROM triples UNION ALL SELECT 'label', object_label FROM triples UNION ALL SELECT 'predicate', predicate FROM triples UNION ALL SELECT 'tier', CAST(extraction_tier AS VARCHAR) FROM triples
UNION ALL SELECT 'confidence', CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END FROM triples) GROUP BY stat, key""")
def triple_stats(s, d):
    return extract.triple_stats(table(s, d, "triples"))


_GEN = "(regexp_replace(lower({c}), '^_+|_+$', '', 'g') IN " + _in(extract.GENERIC) + " OR length({c}) < 3)"
_S, _O = _GEN.format(c="subject_id"), _GEN.format(c="object_id")
_ODD = f"NOT coalesce(predicate IN {_in(extract.KNOWN_PREDICATES)}, false)"
_EMPTY = "coalesce(subject_id, '') = '' OR coalesce(object_id, '') = ''"
_AUDIT = f"""SELECT triple_id, predicate, CASE WHEN {_EMPTY} OR {_S} OR {_O} THEN 'WRONG' WHEN {_ODD} OR length(subject_id) > 100 OR length(object_id) > 100 OR regexp_matches(subject_id, '^[a-f0-9]{{32,}}$') OR regexp_matches(object_id, '^[a-f0-9]{{32,}}$') THEN 'UNCERTAIN' ELSE 'CORRECT' END AS verdict,
CASE WHEN {_EMPTY} THEN 'Empty subject or object ID' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN {_S} THEN 'generic_subject:' || subject_id END, CASE WHEN {_O} THEN 'generic_object:' || object_id END, CASE WHEN {_ODD} THEN 'unknown_predicate:' || coalesce(predicate, '') END,
CASE WHEN predicate = 'FIXES' AND coalesce(subject_label, '') <> '' AND subject_label <> 'Fix' THEN 'expected_Fix_label_got:' || subject_label END, CASE WHEN predicate = 'FIXES' AND coalesce(object_label, '') <> '' AND object_label <> 'Violation' THEN 'expected_Violation_label_got:' || object_label END,
CASE WHEN predicate = 'CAUSES' AND coalesce(object_label, '') <> '' AND object_label NOT IN ('Violation', 'Bug', 'Error') THEN 'CAUSES_target_label:' || object_label END, CASE WHEN length(subject_id) > 100 THEN 'subject_id_too_long' END, CASE WHEN regexp_matches(subject_id, '^[a-f0-9]{{32,}}$') THEN 'subject_looks_like_hash' END, CASE WHEN length(object_id) > 100 THEN 'object_id_too_long' END, CASE WHEN regexp_matches(object_id, '^[a-f0-9]{{32,}}$') THEN 'object_looks_like_hash' END,
CASE WHEN coalesce(source_file, '') = '' THEN 'no_source_file' WHEN extraction_tier = 3 AND contains(source_file, 'forum_llm') THEN 'forum_llm_source' END), ''), 'auto_pass') END AS notes FROM triples"""


@query(f"SELECT triple_id, verdict, notes FROM ({_AUDIT})")
def audit_verdicts(s, d):
    return extract.audit(table(s, d, "triples"))


@query(f"""SELECT predicate, correct, wrong, uncertain, CASE WHEN correct + wrong > 0 THEN CAST(correct AS DOUBLE) / (correct + wrong) ELSE 1.0 END AS precision FROM (SELECT predicate, count_if(verdict = 'CORRECT') AS correct, count_if(verdict = 'WRONG') AS wrong, count_if(verdict = 'UNCERTAIN') AS uncertain FROM ({_AUDIT}) GROUP BY predicate)""")
def audit_precision(s, d):
    t = table(s, d, "triples")
    return extract.audit_precision(extract.audit(t), t)


def _norm(x: str) -> str:
    low = f"lower(trim({x}_id))"
    return f"""CASE WHEN {x}_label = 'Design' THEN 'design_' || coalesce(c{x}.canonical, {low}) WHEN {x}_label = 'Version' THEN 'version_' || coalesce(replace(lower(c{x}.canonical), '.', '_'), {low})
WHEN {x}_label = 'Module' THEN 'module_' || regexp_replace(regexp_replace({low}, '^(module_|cell_|pin_|net_|port_)', ''), '\\s+', '_', 'g') WHEN {x}_label = 'Rule' THEN 'rule_' || regexp_replace(regexp_replace({low}, '^(rule_|clk_|sdc_)', ''), '[\\s-]+', '_', 'g')
WHEN {x}_label = 'PDK' THEN 'pdk_' || replace({low}, 'pdk_', '') WHEN {x}_label IN ('Violation', 'Fix', 'ToolRun', 'Report') THEN lower({x}_label) || '_' || {low} WHEN {x}_label = 'TimingPath' THEN 'tp_' || {low} ELSE {low} END"""


@query(f"""WITH f AS (SELECT kind, canonical_name AS canonical, entity_id, unnest([lower(canonical_name), replace(lower(canonical_name), '_', ''), replace(lower(canonical_name), '-', '_'), replace(lower(canonical_name), '_', '.'), replace(lower(canonical_name), '.', '_')]) AS alias, unnest([0, 1, 2, 3, 4]) AS p FROM canonical_entities),
al AS (SELECT kind, alias, arg_min(canonical, entity_id || '/' || p) AS canonical, min(entity_id || '/' || p) AS ord FROM f GROUP BY kind, alias),
e AS (SELECT DISTINCT label, raw FROM (SELECT subject_label AS label, subject_id AS raw FROM triples UNION ALL SELECT object_label, object_id FROM triples) WHERE label IN ('Design', 'Version') AND raw IS NOT NULL),
l AS (SELECT *, CASE WHEN label = 'Design' THEN replace(replace(lower(trim(raw)), 'design_', ''), '_', '') ELSE replace(replace(lower(trim(raw)), 'tool_', ''), 'version_', '') END AS look FROM e),
m AS (SELECT label, raw, arg_min(canonical, ord) AS canonical FROM l JOIN al ON (label = 'Design' AND kind = 'design' AND (contains(look, alias) OR contains(alias, look))) OR (label = 'Version' AND kind = 'tool_version' AND contains(look, alias)) GROUP BY label, raw),
n AS (SELECT triple_id, {_norm("subject")} AS subject_id, predicate, {_norm("object")} AS object_id, confidence, t.subject_id AS s0, t.object_id AS o0 FROM triples t LEFT JOIN m csubject ON csubject.label = t.subject_label AND csubject.raw = t.subject_id LEFT JOIN m cobject ON cobject.label = t.object_label AND cobject.raw = t.object_id)
SELECT triple_id, subject_id, predicate, object_id, CASE WHEN subject_id IS DISTINCT FROM s0 OR object_id IS DISTINCT FROM o0 THEN least(coalesce(confidence, 1.0), 0.7) ELSE confidence END AS confidence, (subject_id IS DISTINCT FROM s0 OR object_id IS DISTINCT FROM o0) AS coref_applied FROM n""".replace("_label = ", "_label = "))
def resolve_triples(s, d):
    return extract.resolve(table(s, d, "triples"), table(s, d, "canonical_entities"))


# --- graph ---------------------------------------------------------------------------------------------------------


def _label(c: str) -> str:
    return f"CASE WHEN {c} IN {_in(list(graph.LABELS))} THEN {c} " + " ".join(f"WHEN lower({c}) = '{x.lower()}' THEN '{x}'" for x in graph.LABELS) + " ELSE 'Entity' END"


_VALID = "coalesce(subject_id, '') <> '' AND coalesce(object_id, '') <> ''"
_TYPE = "CASE WHEN coalesce(predicate, '') = '' THEN 'RELATED_TO' ELSE upper(regexp_replace(predicate, '[^A-Za-z0-9_]', '_', 'g')) END"
_ENDS = f"SELECT {_label('subject_label')} AS label, subject_id AS id, triple_id, source_file FROM triples WHERE {_VALID} UNION ALL SELECT {_label('object_label')}, object_id, triple_id, source_file FROM triples WHERE {_VALID}"
_NODES = f"SELECT label, id, min(triple_id) AS first_seq, first(source_file ORDER BY triple_id) AS source_file, count(*) AS mentions FROM ({_ENDS}) GROUP BY label, id"
_EDGES = f"(SELECT DISTINCT subject_id AS src, predicate AS type, object_id AS dst FROM triples WHERE {_VALID})"


@query(_NODES)
def merge_nodes_first(s, d):
    return graph.merge_nodes(table(s, d, "triples"))


@query(f"""WITH t AS (SELECT {_label("subject_label")} AS src_label, subject_id AS src, {_TYPE} AS type, {_label("object_label")} AS dst_label, object_id AS dst, triple_id, properties, confidence, source_file FROM triples WHERE {_VALID}),
x AS (SELECT src_label, src, type, dst_label, dst, last(confidence ORDER BY triple_id) AS confidence, last(source_file ORDER BY triple_id) AS source_file, count(*) AS written FROM t GROUP BY ALL),
kv AS (SELECT src_label, src, type, dst_label, dst, triple_id, unnest(map_keys(properties)) AS k, unnest(map_values(properties)) AS v FROM t WHERE properties IS NOT NULL),
p AS (SELECT src_label, src, type, dst_label, dst, k, arg_max(v, triple_id) AS v FROM kv GROUP BY ALL), q AS (SELECT src_label, src, type, dst_label, dst, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM p GROUP BY ALL)
SELECT x.*, coalesce(q.properties, '') AS properties FROM x LEFT JOIN q USING (src_label, src, type, dst_label, dst)""")
def merge_edges_last(s, d):
    e = graph.merge_edges(table(s, d, "triples"))
    return e.withColumn("properties", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";"))


@query(f"""SELECT a.merged, a.n - a.merged AS rejected, a.merged * 2 AS node_writes, (SELECT count(*) FROM ({_NODES})) AS distinct_nodes, (SELECT count(*) FROM (SELECT DISTINCT subject_id, {_TYPE}, object_id FROM triples WHERE {_VALID})) AS distinct_edges FROM (SELECT count(*) AS n, count_if({_VALID}) AS merged FROM triples) a""")
def merge_stats(s, d):
    return graph.merge_stats(table(s, d, "triples"))


def _versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "canonical_entities").where("kind = 'tool_version'").select(F.col("canonical_name").alias("id"))


@query(f"""WITH e AS {_EDGES}, st AS (SELECT canonical_name AS id FROM canonical_entities WHERE kind = 'tool_version'), n AS (SELECT st.id AS start, st.id AS at FROM st UNION SELECT st.id, e.dst FROM st JOIN e ON e.src = st.id UNION SELECT st.id, e.src FROM st JOIN e ON e.dst = st.id)
SELECT DISTINCT start, src, type, dst FROM n JOIN e ON e.src = n.at OR e.dst = n.at""")
def k_hop_edges(s, d):
    return graph.k_hop_edges(graph.edges_of(table(s, d, "triples")), _versions(s, d), 2)


@query(f"SELECT canonical_name AS id FROM canonical_entities WHERE canonical_name NOT IN (SELECT src FROM {_EDGES} UNION SELECT dst FROM {_EDGES})")
def orphans(s, d):
    return graph.orphans(table(s, d, "canonical_entities").select(F.col("canonical_name").alias("id")), graph.edges_of(table(s, d, "triples")))


@query(f"SELECT label, count(*) AS nodes FROM ({_NODES}) GROUP BY label")
def label_counts(s, d):
    return graph.label_counts(table(s, d, "triples"))


@query(f"SELECT dst AS violation, count(DISTINCT src) AS fixes, string_agg(DISTINCT src, ';' ORDER BY src) AS ids FROM {_EDGES} WHERE type = 'FIXES' GROUP BY dst HAVING count(DISTINCT src) > 1")
def multi_fix(s, d):
    x = graph.multi_fix(graph.edges_of(table(s, d, "triples")))
    return x.withColumn("ids", F.array_join("ids", ";"))


@query(f"SELECT violation, count(*) AS pairs, string_agg(fix || '@' || version, ';' ORDER BY fix, version) AS which FROM (SELECT DISTINCT f.dst AS violation, f.src AS fix, t.dst AS version FROM {_EDGES} f JOIN {_EDGES} t ON f.src = t.src WHERE f.type = 'FIXES' AND t.type = 'TARGETS') GROUP BY violation HAVING count(*) > 1")
def cross_version(s, d):
    x = graph.cross_version(graph.edges_of(table(s, d, "triples")))
    return x.withColumn("which", F.array_join(F.transform("which", lambda p: F.concat(p["fix"], F.lit("@"), p["version"])), ";"))


@query(f"SELECT DISTINCT f.dst AS violation, f.src AS fix, d.dst AS document, coalesce(o.n, 0) AS own_documents FROM {_EDGES} f LEFT JOIN (SELECT * FROM {_EDGES} WHERE type = 'DOCUMENTED_IN') d ON d.src = f.src LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM {_EDGES} WHERE type = 'DOCUMENTED_IN' GROUP BY src) o ON o.src = f.dst WHERE f.type = 'FIXES'")
def violation_fixes(s, d):
    return graph.violation_fixes(graph.edges_of(table(s, d, "triples")))


@query(f"SELECT DISTINCT c.dst AS violation, c.src AS cause, v.dst AS version FROM {_EDGES} c LEFT JOIN (SELECT * FROM {_EDGES} WHERE type IN ('VERSION_OF', 'RAN_ON')) v ON v.src = c.src WHERE c.type = 'CAUSES'")
def error_diagnosis(s, d):
    return graph.diagnosis(graph.edges_of(table(s, d, "triples")))


@query(f"SELECT coalesce(m.src, v.src) AS design, coalesce(metrics, 0) AS metrics, coalesce(violations, 0) AS violations FROM (SELECT src, count(DISTINCT dst) AS metrics FROM {_EDGES} WHERE type IN ('HAS_METRIC', 'HAS_TIMING') GROUP BY src) m FULL JOIN (SELECT src, count(DISTINCT dst) AS violations FROM {_EDGES} WHERE type = 'VIOLATES' GROUP BY src) v ON m.src = v.src")
def design_metrics(s, d):
    return graph.design_metrics(graph.edges_of(table(s, d, "triples")))


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE type IN ('CAUSES', 'FIXES')), b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT dst AS violation FROM e), r AS (SELECT violation, y AS n FROM v JOIN b ON x = violation UNION SELECT violation, c.y FROM v JOIN b a ON a.x = violation JOIN b c ON c.x = a.y WHERE c.y <> violation) SELECT violation, count(*) AS reached FROM r GROUP BY violation")
def two_hop_reach(s, d):
    return graph.reachable_fixes(graph.edges_of(table(s, d, "triples")))


@query(f"""SELECT n AS nodes, e AS edges, o AS orphans, o * 100.0 / greatest(n, 1) AS orphan_pct FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT canonical_name FROM canonical_entities)) AS n, (SELECT count(*) FROM {_EDGES}) AS e, (SELECT count(*) FROM canonical_entities WHERE canonical_name NOT IN (SELECT src FROM {_EDGES} UNION SELECT dst FROM {_EDGES})) AS o)""")
def graph_integrity(s, d):
    return graph.integrity(table(s, d, "canonical_entities").select(F.col("canonical_name").alias("id")).distinct(), graph.edges_of(table(s, d, "triples")))


@query(f"WITH a AS (SELECT unnest(aliases) AS alias, canonical_name AS id FROM canonical_entities WHERE aliases IS NOT NULL) SELECT DISTINCT coalesce(x.id, e.src) AS src, e.type, coalesce(y.id, e.dst) AS dst FROM {_EDGES} e LEFT JOIN a x ON x.alias = e.src LEFT JOIN a y ON y.alias = e.dst")
def alias_merge(s, d):
    a = table(s, d, "canonical_entities").select(F.explode("aliases").alias("alias"), F.col("canonical_name").alias("id"))
    return graph.merge_aliases(graph.edges_of(table(s, d, "triples")), a)


_CHAIN = "(SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"


def _chain(s: SparkSession, d: str) -> DataFrame:
    t = lambda n, a, b: table(s, d, n).select(F.concat(F.lit(a[0]), F.col(a[1:]).cast("string")).alias("src"), F.concat(F.lit(b[0]), F.col(b[1:]).cast("string")).alias("dst"))
    return t("nation", "rn_regionkey", "nn_nationkey").unionAll(t("customer", "nc_nationkey", "cc_custkey")).unionAll(t("orders", "co_custkey", "oo_orderkey")).unionAll(t("lineitem", "ol_orderkey", "pl_partkey"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_CHAIN}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), p AS (SELECT id, 0 AS depth FROM n UNION SELECT e.dst, p.depth + 1 FROM p JOIN e ON e.src = p.id) SELECT id, max(depth) AS depth FROM p GROUP BY id""")
def topo_depth(s, d):
    return graph.depths(_chain(s, d))


@query(f"SELECT coalesce(i.id, o.id) AS id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT dst AS id, count(*) AS fan_in FROM {_EDGES} GROUP BY dst) i FULL JOIN (SELECT src AS id, count(*) AS fan_out FROM {_EDGES} GROUP BY src) o ON i.id = o.id")
def fan_in_out(s, d):
    return graph.fan(graph.edges_of(table(s, d, "triples")))


# --- retrieval -----------------------------------------------------------------------------------------------------

_TERMS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def _bm25(queries: str, k: int, name: str) -> str:
    return f"""{name}d AS (SELECT doc_id, coalesce({_TERMS.format(c="text")}, []) AS w FROM documents), {name}st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}d), {name}q AS ({queries}),
{name}p AS (SELECT doc_id AS did, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM {name}d) WHERE t IN (SELECT t FROM {name}q) GROUP BY ALL), {name}f AS (SELECT t, count(*) AS df FROM {name}p GROUP BY t),
{name}w AS (SELECT t, did, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM {name}p JOIN {name}f USING (t), {name}st), {name}s AS (SELECT qid, did, sum(w) AS score FROM {name}w JOIN {name}q USING (t) GROUP BY qid, did),
{name} AS (SELECT qid, did, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM {name}s) WHERE rank <= {k})"""


_BENCH_Q = f"SELECT id AS qid, unnest(list_distinct({_TERMS.format(c='query')})) AS t FROM edabench WHERE query IS NOT NULL"


@query(f"WITH {_bm25(_BENCH_Q, 10, 'b')} SELECT qid, did, round(score, 6) AS score, rank FROM b")
def bm25_topk(s, d):
    return search.bm25(table(s, d, "documents"), table(s, d, "edabench")).select("qid", "did", F.round("score", 6).alias("score"), "rank")


def _dense(k: int) -> str:
    dot = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    cos = f"{dot.format(a='v.embedding', b='q.embedding')} / (sqrt({dot.format(a='v.embedding', b='v.embedding')}) * sqrt({dot.format(a='q.embedding', b='q.embedding')}))"
    return f"vs AS (SELECT q.vec_id AS qid, v.vec_id AS did, {cos} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM vs) WHERE rank <= {k})"


@query(f"WITH {_dense(10)} SELECT qid, did AS vid, round(score, 6) AS score, rank FROM v")
def dense_topk(s, d):
    e = table(s, d, "embeddings")
    return search.dense(e, e.where("vec_id % 50 = 0")).select("qid", "vid", F.round("score", 6).alias("score"), "rank")


_TITLE_Q = f"SELECT doc_id AS qid, unnest(list_distinct({_TERMS.format(c='string_split(text, chr(10))[1]')})) AS t FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)"


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists for documents of ids divisible by 50 that have a vector: by vector, and by the words of the first line."""
    e, docs = table(s, d, "embeddings"), table(s, d, "documents")
    q = docs.where("doc_id % 50 = 0").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), 0).alias("query"))
    dense = search.dense(e, e.where("vec_id % 50 = 0"), 20).withColumnRenamed("vid", "did")
    return cut(dense), cut(search.bm25(docs, q, 20))


@query(f"""WITH {_dense(20)}, {_bm25(_TITLE_Q, 20, "b")}, a AS (SELECT qid, did, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM v WINDOW w AS (PARTITION BY qid)),
c AS (SELECT qid, did, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM b WINDOW w AS (PARTITION BY qid)),
j AS (SELECT coalesce(a.qid, c.qid) AS qid, coalesce(a.did, c.did) AS did, 0.7 * coalesce(a.s, 0) + 0.3 * coalesce(c.s, 0) AS score FROM a FULL JOIN c ON a.qid = c.qid AND a.did = c.did)
SELECT qid, did, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM j) WHERE rank <= 10""")
def hybrid_topk(s, d):
    a, b = _lists(s, d)
    return search.hybrid(a, b).select("qid", "did", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_dense(20)}, {_bm25(_TITLE_Q, 20, "b")}, u AS (SELECT qid, did, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, did, rank FROM v UNION ALL SELECT qid, did, rank FROM b) GROUP BY qid, did)
SELECT qid, did, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, did) AS rank FROM u) WHERE rank <= 10""")
def rrf_topk(s, d):
    a, b = _lists(s, d)
    return search.reciprocal_rank(a, b).select("qid", "did", F.round("score", 9).alias("score"), "rank")


_RERANK = f"""{_bm25(_BENCH_Q, 10, "b")}, c AS (SELECT qid, did, rank, CAST(len(list_intersect(list_distinct({_TERMS.format(c="e.query")}), {_TERMS.format(c="d.text")})) AS DOUBLE) / len(list_distinct({_TERMS.format(c="e.query")})) AS rerank_score FROM b JOIN edabench e ON e.id = qid JOIN documents d ON d.doc_id = did),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank) AS reranked FROM c) WHERE reranked <= 5)"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    top = search.bm25(table(s, d, "documents"), table(s, d, "edabench"))
    e, docs = table(s, d, "edabench").select(F.col("id").alias("qid"), "query"), table(s, d, "documents").select(F.col("doc_id").alias("did"), "text")
    j = docs.join(top.select("qid", "did", "rank"), "did").join(F.broadcast(e) if e.limit(10_001).count() <= 10_000 else e, "qid")
    return j.select("qid", "did", "rank", search.overlap_score(F.col("query"), F.col("text")).alias("rerank_score"))


@query(f"WITH {_RERANK} SELECT qid, did, rank AS original_rank, reranked AS reranked_rank, abs(rank - reranked) AS moved, rerank_score FROM r")
def rerank_topn(s, d):
    return search.rerank(_candidates(s, d))


@query(f"""WITH {_RERANK} SELECT qid, mean_move, top1_original_rank, min_score, max_score, round(mean_score, 9) AS mean_score FROM (SELECT qid, avg(abs(rank - reranked)) AS mean_move, max(CASE WHEN reranked = 1 THEN rank END) AS top1_original_rank FROM r GROUP BY qid)
JOIN (SELECT qid, min(rerank_score) AS min_score, max(rerank_score) AS max_score, avg(rerank_score) AS mean_score FROM c GROUP BY qid) USING (qid)""")
def rerank_stats(s, d):
    return search.rerank_stats(_candidates(s, d)).withColumn("mean_score", F.round("mean_score", 9))


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in words)


_SCORES = ", ".join(f"coalesce({_hits(w)}, 0) AS s{i}" for i, w in enumerate(router.SIGNALS.values()))
_TOP = "greatest(" + ", ".join(f"s{i}" for i in range(len(router.SIGNALS))) + ")"
_CAT = " ".join(f"WHEN s{i} = m THEN '{c}'" for i, c in enumerate(router.SIGNALS))
_LEAST = " ".join(f"WHEN s{i} = m THEN {max(3.0, len(w) * 0.3)}" for i, w in enumerate(router.SIGNALS.values()))


@query(f"""SELECT qa_id, CASE WHEN m = 0 THEN 'error_diagnosis' {_CAT} END AS category, round(least(1.0, m / CASE {_LEAST} END), 6) AS confidence FROM (SELECT *, {_TOP} AS m FROM (SELECT qa_id, {_SCORES} FROM (SELECT qa_id, lower(question) AS q FROM qa_raw)))""")
def route_queries(s, d):
    return router.route(table(s, d, "qa_raw").select("qa_id", "question"), "question").select("qa_id", "category", F.round("confidence", 6).alias("confidence"))


_LINK = rf"""(WITH n AS (SELECT DISTINCT id, lower(id) AS low, regexp_extract(lower(id), '^({"|".join(router.PREFIXES)})(.*)$', 2) AS tail FROM ({_ENDS})), q AS (SELECT DISTINCT id AS qid, lower(query) AS q FROM edabench WHERE query IS NOT NULL),
u AS (SELECT qid, id FROM q JOIN n ON contains(q, low) UNION SELECT qid, id FROM (SELECT qid, unnest(regexp_extract_all(q, '\b\w+\b')) AS w FROM q) JOIN n ON tail = w WHERE tail IN {_in(router.NAMES)} UNION SELECT qid, id FROM q JOIN n ON contains(q, tail) WHERE tail IN {_in(router.VERSION_NAMES)}
UNION SELECT qid, id FROM (SELECT qid, unnest(list_transform(regexp_extract_all(q, '\b(ed[_-]?\d{{3}})\b', 1), lambda x: replace(x, '-', '_'))) AS ed FROM q) JOIN n ON contains(low, ed)) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY length(id) DESC, id) AS rank FROM u)"""


@query(f"SELECT * FROM {_LINK}")
def link_entities(s, d):
    ids = graph.merge_nodes(table(s, d, "triples")).select("id")
    return router.link(table(s, d, "edabench"), "id", "query", ids)


@query(f"""WITH l AS (SELECT qid, id FROM {_LINK} WHERE rank <= 5), f AS (SELECT l.qid, l.id, count(*) AS facts FROM l JOIN {_EDGES} e ON e.src = l.id OR e.dst = l.id GROUP BY l.qid, l.id)
SELECT qid, CAST(sum(facts) AS BIGINT) AS facts, count(*) AS entities FROM f GROUP BY qid""")
def fused_facts(s, d):
    """Graph facts of the entities that each query names, at most five: counted per entity before they are joined."""
    t = table(s, d, "triples")
    e = graph.edges_of(t)
    l = router.link(table(s, d, "edabench"), "id", "query", graph.merge_nodes(t).select("id"), keep=5).select("qid", "id")  # noqa: E741
    ends = e.select(F.col("src").alias("id")).unionAll(e.where("src != dst").select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("facts"))
    return l.join(ends, "id").groupBy("qid").agg(F.sum("facts").alias("facts"), F.count("*").alias("entities"))


# --- reports -------------------------------------------------------------------------------------------------------


@query("SELECT source_name, min(wns) AS wns, round(coalesce(sum(wns) FILTER (wns < 0), 0), 4) AS tns, count_if(wns < 0) AS violations, count(*) AS paths, round(quantile_cont(wns, 0.0), 6) AS p0, round(quantile_cont(wns, 0.1), 6) AS p10, round(quantile_cont(wns, 0.5), 6) AS p50, round(quantile_cont(wns, 0.9), 6) AS p90 FROM orfs_runs WHERE wns IS NOT NULL GROUP BY source_name")
def slack_percentiles(s, d):
    x = reports.slack_summary(table(s, d, "orfs_runs"), ["source_name"], "wns")
    return x.select("source_name", "wns", F.round("tns", 4).alias("tns"), "violations", "paths", *(F.round(f"p{n}", 6).alias(f"p{n}") for n in (0, 10, 50, 90)))


@query("SELECT source_name, " + ", ".join(f"max(CASE WHEN r = {i + 1} THEN wns END) AS path_slack_{i}" for i in range(10)) + " FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY wns, artifact_id, received_at) AS r FROM orfs_runs WHERE wns IS NOT NULL) GROUP BY source_name")
def worst_slacks(s, d):
    return reports.worst_slacks(table(s, d, "orfs_runs"), ["source_name"], "wns", ["artifact_id", "received_at"])


def _num(p: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(report_text, '{p}', 1), '') AS DOUBLE) + 0.0"


@query(f"""SELECT DISTINCT artifact_id, {_num("(?im)^\\s*wns\\s+(-?\\d+\\.?\\d*)")} AS wns, {_num("(?im)^\\s*tns\\s+(-?\\d+\\.?\\d*)")} AS tns, {_num("(?i)clock\\s+period\\s*=\\s*(\\d+\\.?\\d*)")} AS clock_period FROM orfs_runs WHERE report_text IS NOT NULL""")
def timing_reports(s, d):
    return table(s, d, "orfs_runs").where("report_text is not null").select("artifact_id", *(c.alias(n) for n, c in reports.timing_report(F.col("report_text")).items())).distinct()


@query(f"""SELECT artifact_id, source_name, coalesce(cell_area_um2, {_num("(?i)core\\s+area\\s+(\\d+\\.?\\d*)")}) AS area_um2, freq_mhz, coalesce(violation_count, 0) AS violations, {_num("(?i)clock\\s+period\\s*=\\s*(\\d+\\.?\\d*)")} AS clock_period
FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY received_at DESC) AS r FROM orfs_runs) WHERE r = 1 AND run_status = 'success'""")
def run_features(s, d):
    return reports.run_features(table(s, d, "orfs_runs"))


_BOX = (0.0, 0.0, 60.0, 120000.0)
_CELL = "CAST(least(greatest(floor(({c} - {lo}) / ({hi} - {lo}) * 20), 0), 19) AS INTEGER)"
_GRID = f"SELECT {_CELL.format(c='l_quantity', lo=0.0, hi=60.0)} AS bx, {_CELL.format(c='l_extendedprice', lo=0.0, hi=120000.0)} AS by, count(*) AS n FROM lineitem GROUP BY ALL"


@query(_GRID)
def density_grid(s, d):
    return reports.density_grid(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 20, _BOX)


@query(f"WITH g AS ({_GRID}), a AS (SELECT max(n) AS most, sum(n) / 400.0 AS mean, round(sqrt(sum(n * n) / 400.0 - pow(sum(n) / 400.0, 2)), 6) AS std, quantile_cont(n, 0.9) AS p90 FROM g) SELECT most, CAST(mean AS DOUBLE) AS mean, std, (SELECT count(*) FROM g WHERE n >= p90) AS hotspots FROM a")
def density_stats(s, d):
    return reports.density_stats(reports.density_grid(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 20, _BOX), 20).withColumn("std", F.round("std", 6))


_INST = reports._INSTANCE.replace("'", "''")
_PINS = f"""SELECT DISTINCT chunk_id, cell, inst, pin[j] AS pin, net[j] AS net, upper(pin[j]) IN {_in(list(reports.OUTPUT_PINS))} AS is_output FROM (SELECT *, unnest(range(1, len(pin) + 1)) AS j FROM (SELECT chunk_id, cell[i] AS cell, inst[i] AS inst, regexp_extract_all(ports[i], '{reports._PIN}', 1) AS pin, regexp_extract_all(ports[i], '{reports._PIN}', 2) AS net
FROM (SELECT *, unnest(range(1, len(cell) + 1)) AS i FROM (SELECT chunk_id, regexp_extract_all(text, '{_INST}', 1) AS cell, regexp_extract_all(text, '{_INST}', 2) AS inst, regexp_extract_all(text, '{_INST}', 3) AS ports FROM chunks WHERE text IS NOT NULL)))) WHERE lower(cell) NOT IN {_in(list(reports.KEYWORDS))}"""


@query(_PINS)
def netlist_pins(s, d):
    return reports.pins(table(s, d, "chunks"), "chunk_id", "text").distinct()


@query(f"WITH p AS ({_PINS}) SELECT DISTINCT a.chunk_id, a.inst AS src, b.inst AS dst, a.net FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND a.net = b.net WHERE a.is_output AND NOT b.is_output AND a.net <> ''")
def netlist_edges(s, d):
    return reports.netlist_edges(reports.pins(table(s, d, "chunks"), "chunk_id", "text").distinct(), "chunk_id")


@query(f"WITH p AS ({_PINS}) SELECT kind, count(*) AS n FROM (SELECT chunk_id, inst, CASE " + " ".join(f"WHEN starts_with(upper(cell), '{k}') THEN '{k}'" for k in sorted(reports.CELL_KINDS, key=len, reverse=True)) + " ELSE 'OTHER' END AS kind FROM (SELECT DISTINCT chunk_id, inst, cell FROM p)) GROUP BY kind")
def cell_kinds(s, d):
    p = reports.pins(table(s, d, "chunks"), "chunk_id", "text").select("chunk_id", "inst", "cell").distinct()
    return p.groupBy(reports.cell_kind(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


# --- sampling and assembly -------------------------------------------------------------------------------------------

_HASH = "md5('42|' || CAST({k} AS VARCHAR))"


@query(f"""SELECT qa_id, task_category, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (SELECT qa_id, task_category, row_number() OVER (PARTITION BY task_category ORDER BY {_HASH.format(k="qa_id")}, qa_id) AS r, count(*) OVER (PARTITION BY task_category) AS n FROM qa_raw)""")
def stratified_split(s, d):
    return splits.stratified_split(table(s, d, "qa_raw").select("qa_id", "task_category"), "task_category", ["qa_id"])


@query("SELECT task_category, n, greatest(n, CAST(floor(t * 0.15 + 1e-9) AS BIGINT)) AS target, greatest(n, CAST(floor(t * 0.15 + 1e-9) AS BIGINT)) - n AS extra FROM (SELECT task_category, count(*) AS n FROM qa_raw GROUP BY task_category), (SELECT count(*) AS t FROM qa_raw)")
def oversample_counts(s, d):
    return splits.oversample_counts(table(s, d, "qa_raw"), "task_category")


@query(f"""SELECT qa_id, task_category, CAST(unnest(range(0, 1 + CAST(floor((extra + n - r) / n) AS BIGINT))) AS INTEGER) AS copy FROM (SELECT *, greatest(n, CAST(floor(t * 0.15 + 1e-9) AS BIGINT)) - n AS extra FROM (SELECT qa_id, task_category, row_number() OVER (PARTITION BY task_category ORDER BY {_HASH.format(k="qa_id")}, qa_id) AS r, count(*) OVER (PARTITION BY task_category) AS n, count(*) OVER () AS t FROM qa_raw))""")
def oversampled(s, d):
    return splits.oversample(table(s, d, "qa_raw").select("qa_id", "task_category"), "task_category", ["qa_id"])


_NEED = {"error_diagnosis": 48, "rtl_qa": 18, "constraint_generation": 18, "drc_rule_lookup": 18, "cross_tool_knowledge": 18}
_TARGET = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _NEED.items())


@query(f"SELECT qa_id, task_category FROM (SELECT qa_id, task_category, row_number() OVER (PARTITION BY task_category ORDER BY {_HASH.format(k='qa_id')}, qa_id) AS r FROM qa_raw) WHERE r <= CASE task_category {_TARGET} ELSE 0 END")
def holdout_sample(s, d):
    return splits.take_per_group(table(s, d, "qa_raw").select("qa_id", "task_category"), "task_category", _NEED, ["qa_id"])


@query(f"""WITH u AS (SELECT 0 AS pool, id AS item, task_category FROM edabench WHERE verified UNION ALL SELECT 1, CAST(qa_id AS VARCHAR), task_category FROM qa_raw), r AS (SELECT *, row_number() OVER (PARTITION BY task_category ORDER BY pool, {_HASH.format(k="item")}, item) AS place FROM u) SELECT item, task_category, pool, place FROM r WHERE place <= CASE task_category {_TARGET} ELSE 0 END""")
def assemble_priority(s, d):
    a = table(s, d, "edabench").where("verified").select(F.col("id").alias("item"), "task_category")
    b = table(s, d, "qa_raw").select(F.col("qa_id").cast("string").alias("item"), "task_category")
    return splits.assemble([a, b], "task_category", _NEED, ["item"]).select("item", "task_category", "pool", "place")


@query(f"SELECT task_category, need FROM (SELECT t.k AS task_category, greatest(t.v - coalesce(h.n, 0), 0) AS need FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v * 10})' for k, v in _NEED.items())}) t(k, v) LEFT JOIN (SELECT task_category, count(*) AS n FROM edabench GROUP BY 1) h ON h.task_category = t.k) WHERE need > 0")
def benchmark_needs(s, d):
    t = s.createDataFrame([(k, v * 10) for k, v in _NEED.items()], "task_category string, target long")
    return splits.needs(t, table(s, d, "edabench"), "task_category")


@query("SELECT f.difficulty AS fold, e.id, CASE WHEN e.difficulty = f.difficulty THEN 'test' ELSE 'train' END AS part FROM edabench e, (SELECT DISTINCT difficulty FROM edabench WHERE difficulty IS NOT NULL) f")
def leave_one_out(s, d):
    e = table(s, d, "edabench").select("id", "difficulty")
    return splits.leave_one_out(e, "difficulty", e.where("difficulty is not null").select("difficulty").distinct()).select("fold", "id", "part")


@query("SELECT canonical_name AS design, round(2.0 + i * 0.4, 2) AS clock_ns, 'clk_' || replace(regexp_replace(regexp_replace(printf('%.3f', round(2.0 + i * 0.4, 2)), '0+$', ''), '\\.$', ''), '.', 'p') AS variant FROM (SELECT DISTINCT canonical_name FROM canonical_entities WHERE kind = 'design'), range(0, 11) t(i)")
def sweep_matrix(s, d):
    return splits.sweep(table(s, d, "canonical_entities").where("kind = 'design'").select(F.col("canonical_name").alias("design")))


@query(f"SELECT triple_id, predicate, r AS rank FROM (SELECT triple_id, predicate, row_number() OVER (PARTITION BY predicate ORDER BY {_HASH.format(k='triple_id')}, triple_id) AS r FROM triples WHERE predicate IN ('FIXES', 'CAUSES', 'VIOLATES')) WHERE r <= 20")
def audit_sample(s, d):
    t = table(s, d, "triples").where("predicate in ('FIXES', 'CAUSES', 'VIOLATES')").select("triple_id", "predicate")
    return ranks.hash_rank(t, ["predicate"], ["triple_id"]).where("rank <= 20")


@query()
def injected_faults(s, d):
    return inject.inject(_files(s, d, "code", "source_code"), "chunk_id", "text", "source_file").select("chunk_id", "family", F.md5("injected").alias("injected_md5"), F.length("injected").alias("n"))


# --- evaluation ----------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN grouping(task_category) = 0 THEN 'task_category' WHEN grouping(violation_family) = 0 THEN 'violation_family' ELSE 'all' END AS level, coalesce(task_category, violation_family) AS key, count(*) AS n, round(avg(input_tokens), 6) AS input_tokens, round(avg(output_tokens), 6) AS output_tokens, round(avg(CASE WHEN length(answer) > 0 THEN 1.0 ELSE 0.0 END), 6) AS answered
FROM qa_raw GROUP BY GROUPING SETS ((task_category), (violation_family), ())""")
def eval_rollup(s, d):
    m: dict[str, Column] = {"input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "answered": F.when(F.length("answer") > 0, 1.0).otherwise(0.0)}
    x = evaluate.rollup(table(s, d, "qa_raw"), ["task_category", "violation_family"], m)
    return x.select("level", "key", "n", *(F.round(k, 6).alias(k) for k in m))


@query("SELECT task_category, n, list_extract(l, CAST(least(floor(0.95 * n), n - 1) AS BIGINT) + 1) AS value FROM (SELECT task_category, count(output_tokens) AS n, list(output_tokens ORDER BY output_tokens) FILTER (output_tokens IS NOT NULL) AS l FROM qa_raw GROUP BY task_category) WHERE n > 0")
def nearest_rank_p95(s, d):
    return ranks.nearest_rank(table(s, d, "qa_raw"), ["task_category"], "output_tokens", 0.95)


@query("SELECT task_category, n, round(list_extract(l, CAST(floor(p) AS BIGINT)) + (list_extract(l, CAST(least(floor(p) + 1, n) AS BIGINT)) - list_extract(l, CAST(floor(p) AS BIGINT))) * (p - floor(p)), 6) AS value FROM (SELECT *, greatest(1.0, least(0.99 * (n + 1), n)) AS p FROM (SELECT task_category, count(output_tokens) AS n, list(output_tokens ORDER BY output_tokens) FILTER (output_tokens IS NOT NULL) AS l FROM qa_raw GROUP BY task_category)) WHERE n > 0")
def exclusive_p99(s, d):
    return ranks.exclusive_quantile(table(s, d, "qa_raw"), ["task_category"], "output_tokens", 0.99).withColumn("value", F.round("value", 6))


@query("SELECT task_category, count(*) AS n, count_if(length(trim(evidence_span)) > 0) AS hits FROM qa_raw GROUP BY task_category")
def graph_hit_rate(s, d):
    return evaluate.hit_rate(table(s, d, "qa_raw").withColumn("facts", F.length(F.trim("evidence_span"))), "task_category", "facts")


_LINKED = f"(SELECT qid, list(DISTINCT lower(id)) AS got FROM {_LINK} GROUP BY qid)"


@query(f"""SELECT e.id, CASE WHEN len(x) = 0 THEN 1.0 ELSE CAST(len(list_intersect(x, coalesce(got, []))) AS DOUBLE) / len(x) END AS retrieval_recall FROM (SELECT id, list_distinct(list_transform(coalesce(expected_graph_nodes, []), lambda v: lower(v))) AS x FROM edabench) e LEFT JOIN {_LINKED} l ON l.qid = e.id""")
def retrieval_recall(s, d):
    e = table(s, d, "edabench")
    got = router.link(e, "id", "query", graph.merge_nodes(table(s, d, "triples")).select("id")).groupBy(F.col("qid").alias("id")).agg(F.collect_set("id").alias("got"))  # ids that a query's own text contains
    return e.join(got, "id", "left").select("id", evaluate.set_recall(F.col("expected_graph_nodes"), F.col("got")).alias("retrieval_recall"))


@query("""SELECT id, CASE WHEN len(coalesce(expected_sources, [])) = 0 THEN NULL ELSE CAST(len(list_filter(expected_sources, lambda v: contains(lower(coalesce(ground_truth_answer, '')), lower(v)) OR contains(lower(coalesce(source, '')), lower(v)))) AS DOUBLE) / len(expected_sources) END AS source_recall FROM edabench""")
def source_recall(s, d):
    return table(s, d, "edabench").select("id", evaluate.source_recall(F.col("expected_sources"), [F.col("ground_truth_answer"), F.col("source")], [], None).alias("source_recall"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN confidence IS NULL THEN 'failed' WHEN confidence >= 0.9 THEN 'accepted' ELSE 'rejected' END AS status FROM triples) GROUP BY status")
def judge_status(s, d):
    return evaluate.judged(table(s, d, "triples"), "confidence").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM triples WHERE coalesce(confidence, 1.0) >= 0.6) AS kept, (SELECT count(*) FROM triples WHERE coalesce(confidence, 0.0) >= 0.9) AS held_out")
def quality_filters(s, d):
    t = table(s, d, "triples")
    a = evaluate.keep_quality(t, "confidence", 0.6, 1.0).agg(F.count("*").alias("kept"))
    return a.crossJoin(evaluate.keep_quality(t, "confidence", 0.9, 0.0).agg(F.count("*").alias("held_out")))


@query("SELECT qa_id, CASE coalesce(task_category, 'error_diagnosis') WHEN 'optimization_advisory' THEN 'cross_tool_knowledge' WHEN 'general_eda' THEN 'cross_tool_knowledge' ELSE coalesce(task_category, 'error_diagnosis') END AS category, md5('<s>[INST] ' || coalesce(question, '') || ' [/INST] ' || coalesce(answer, '') || '</s>') AS prompt_md5 FROM qa_raw")
def instruction_data(s, d):
    return table(s, d, "qa_raw").select("qa_id", evaluate.category(F.col("task_category")).alias("category"), F.md5(evaluate.instruction(F.col("question"), F.col("answer"))).alias("prompt_md5"))


@query("SELECT model_used, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, round((sum(input_tokens) * 3.0 + sum(output_tokens) * 15.0) / 1e6, 9) AS cost FROM qa_raw GROUP BY model_used")
def token_costs(s, d):
    g = table(s, d, "qa_raw").groupBy("model_used").agg(F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    return g.withColumn("cost", F.round(evaluate.token_cost(F.col("tokens_in"), F.col("tokens_out"), 3.0, 15.0), 9))


@query("SELECT round(exp(sum(CAST(output_tokens AS DOUBLE) / greatest(input_tokens, 1) * input_tokens) / sum(input_tokens)), 6) AS perplexity FROM qa_raw WHERE input_tokens IS NOT NULL AND output_tokens IS NOT NULL")
def weighted_perplexity(s, d):
    q = table(s, d, "qa_raw").where("input_tokens is not null and output_tokens is not null").withColumn("loss", F.col("output_tokens") / F.greatest("input_tokens", F.lit(1)))
    return evaluate.perplexity(q, "loss", "input_tokens").withColumn("perplexity", F.round("perplexity", 6))


@query("SELECT task_category, split, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split), 9) AS share FROM (SELECT task_category, split, count(*) AS n FROM (" + ORACLES["stratified_split"] + ") GROUP BY ALL)")
def split_shares(s, d):
    from pyspark.sql import Window as W

    n = stratified_split(s, d).groupBy("task_category", "split").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("split")), 9))


# --- events --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_limit_windows(s, d):
    return jobs.over_limit(table(s, d, "events"), "ts", "user_id", 2, "1 hour")


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(s, d):
    return jobs.windowed_counts(table(s, d, "events"), "ts", ("event_type",), "1 day")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, k""")
def event_sessions(s, d):
    return jobs.sessions(table(s, d, "events"))


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def stream_ingest(s, d):
    """events.parquet taken in as a stream, each event once, into a table of the shared folder."""
    import uuid

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    e = table(s, d, "events")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    jobs.ingest(s, f"{d}/events.parque[t]", schema, f"{base}/table", "event_id", f"{base}/log")
    return s.read.parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"))


# --- queries in modules of their own -----------------------------------------------------------------------------------

from weftspark.plans import features, retrieval, small, triples  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "features", "retrieval", "small", "triples"]
