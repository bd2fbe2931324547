"""Queries of corpus accounts, checks, evaluation and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import chunking, corpus, evaluate, graph, inject, minhash, prompts, ranks, splits, validate
from weftspark.plans import registry
from weftspark.plans.base import ORACLES, literal, query, values
from weftspark.util import table

_COPIES, _NODES, _EDGES, _shingles = registry._COPIES, registry._NODES, registry._EDGES, registry._shingles

# --- corpus ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def content_ids(s, d):
    return table(s, d, "documents").select("doc_id", corpus.content_id(F.col("text")).alias("content_id"))


@query(r"""WITH f AS (SELECT string_split(source_file, '/')[3] AS source, source_file AS path, min(sha256(coalesce(text, ''))) AS h FROM chunks WHERE source_file IS NOT NULL GROUP BY ALL), d AS (SELECT source, regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files, sha256(string_agg(h, '' ORDER BY path)) AS h FROM f GROUP BY ALL)
SELECT source, CAST(sum(files) AS BIGINT) AS files, substr(sha256(string_agg(h, '' ORDER BY folder)), 1, 16) AS checksum FROM d GROUP BY source""")
def tree_checksums(s, d):
    c = table(s, d, "chunks").withColumn("source", F.get(F.split("source_file", "/"), 2))
    return corpus.tree_checksums(c, "source", "source_file", "text")


@query(r"SELECT lower(regexp_extract(file_path, '(\.[^./]+)$', 1)) AS ext, count(*) AS files, min(file_path) AS first, max(file_path) AS last FROM (SELECT DISTINCT file_path FROM manifest WHERE file_path IS NOT NULL) GROUP BY ALL")
def extension_index(s, d):
    return corpus.by_extension(table(s, d, "manifest"), "file_path")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_COPIES}) WHERE keep_id <> doc_id)")
def surviving_documents(s, d):
    return corpus.surviving(table(s, d, "documents")).select("doc_id")


_STAR = f"""k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), ',')) AS key FROM {_shingles("documents", "doc_id", "text")} WHERE len(s) > 0), reps AS (SELECT key, min(doc_id) AS rep FROM k GROUP BY key), g AS (SELECT doc_id AS id, n, unnest(s) AS g FROM k WHERE doc_id IN (SELECT rep FROM reps)),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL), l AS (SELECT b, min(a) AS a FROM p WHERE i >= 0.9 * (na + nb - i) - 1e-9 GROUP BY b),
star AS (SELECT doc_id, least(rep, coalesce(a, rep)) AS near FROM k JOIN reps USING (key) LEFT JOIN l ON l.b = rep WHERE least(rep, coalesce(a, rep)) <> doc_id)"""


@query(f"WITH {_STAR} SELECT doc_id AS id, near FROM star")
def near_duplicate_stars(s, d):
    """By MinHash bands with exact check, at 0.9; the SQL joins all shingles."""
    return minhash.near_duplicates(table(s, d, "documents"), 0.9)


@query(f"""WITH {_STAR}, e AS (SELECT doc_id FROM ({_COPIES}) WHERE keep_id <> doc_id), n AS (SELECT DISTINCT doc_id FROM star) SELECT docs, exact, near_only, removed, docs - removed AS kept, 100.0 * removed / greatest(docs, 1) AS removed_pct FROM (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS docs, (SELECT count(*) FROM e) AS exact, (SELECT count(*) FROM n WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS near_only, (SELECT count(*) FROM (SELECT doc_id FROM e UNION SELECT doc_id FROM n)) AS removed)""")
def duplicate_accounts(s, d):
    docs = table(s, d, "documents")
    near = minhash.near_duplicates(docs, 0.9).withColumnRenamed("id", "doc_id")
    return corpus.duplicate_accounts(docs, corpus.exact_duplicates(docs).where("is_duplicate"), near)


def _minhash_jaccard(field: str, item: str) -> str:
    return f"""WITH c AS (SELECT qa_id AS id, len(s) AS nc, unnest(s) AS g FROM {_shingles("qa_raw", "qa_id", field, True)}), i AS (SELECT id AS item_id, len(s) AS ni, unnest(s) AS g FROM {_shingles("edabench", "id", item, True)}), j AS (SELECT c.id, item_id, nc, ni, count(*) AS n FROM c JOIN i ON c.g = i.g GROUP BY ALL),
b AS (SELECT id, item_id, CAST(n AS DOUBLE) / (nc + ni - n) AS jac, row_number() OVER (PARTITION BY id ORDER BY CAST(n AS DOUBLE) / (nc + ni - n) DESC, item_id) AS r FROM j WHERE CAST(n AS DOUBLE) / (nc + ni - n) >= 0.7 - 1e-12) SELECT id AS qa_id, item_id, round(jac, 4) AS jaccard FROM b WHERE r = 1"""


@query(_minhash_jaccard("question", "query"))
def contamination_minhash(s, d):
    return minhash.contamination(table(s, d, "qa_raw"), "qa_id", "question", table(s, d, "edabench"), "id", "query")


@query(registry._contaminated("qa_raw", "qa_id", "answer", "containment").replace('"query"', '"ground_truth_answer"').replace("lower(query)", "lower(ground_truth_answer)").replace("WHERE query IS NOT NULL", "WHERE ground_truth_answer IS NOT NULL"))
def contamination_answers(s, d):
    return corpus.contamination(table(s, d, "qa_raw"), "qa_id", "answer", table(s, d, "edabench"), "id", "ground_truth_answer", containment=True)


@query(f"SELECT 100.0 * 0 + round(100.0 * (SELECT count(*) FROM ({ORACLES['contamination_jaccard']})) / greatest((SELECT count(*) FROM qa_raw), 1), 4) AS rate_pct, (SELECT count(*) FROM ({ORACLES['contamination_jaccard']})) AS contaminated")
def contamination_rate(s, d):
    q = table(s, d, "qa_raw")
    n = corpus.contamination(q, "qa_id", "question", table(s, d, "edabench"), "id", "query").agg(F.count("*").alias("contaminated"))
    return n.crossJoin(q.agg(F.count("*").alias("n"))).select(evaluate.rate_pct(F.col("contaminated"), F.col("n")).alias("rate_pct"), "contaminated")


# --- chunks ------------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT chunk_id, text FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL) WHERE starts_with(ltrim(text), '{') AND json_valid(text)), k AS (SELECT chunk_id, text, unnest(json_keys(text)) AS k, generate_subscripts(json_keys(text), 1) AS p FROM t),
g AS (SELECT chunk_id, string_split(k, '__')[1] AS h, min(p) AS first, '{' || chr(10) || string_agg('  "' || k || '": ' || json_extract_string(text, '$."' || k || '"'), ',' || chr(10) ORDER BY p) || chr(10) || '}' AS text FROM k GROUP BY chunk_id, h)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY first) - 1 AS INTEGER) AS chunk_index, greatest(1, length(text) // 4)::INTEGER AS token_count, text FROM g""")
def chunk_report(s, d):
    c = table(s, d, "chunks").select("chunk_id", "text").distinct()
    return chunking.chunk_report(c.where(F.ltrim("text").startswith("{") & F.from_json("text", "map<string,string>").isNotNull()), "chunk_id")


@query()
def chunk_all(s, d):
    """Every file's chunks by the chunker of its type, and those of all forum pairs."""
    return chunking.chunk_corpus(table(s, d, "chunks"), table(s, d, "qa_raw"), "source_file", "text", "content_type", "qa_id", "question", "evidence_span", "answer")


@query("SELECT chunks, over, incomplete, 100.0 * over / greatest(chunks, 1) AS over_pct, (100.0 * over / greatest(chunks, 1) < 15.0 AND incomplete = 0) AS passed FROM (SELECT count(*) AS chunks, count_if(token_count > 512) AS over, count_if(chunk_id IS NULL OR source_file IS NULL OR text IS NULL) AS incomplete FROM chunks)")
def chunk_gate(s, d):
    return chunking.chunk_gate(table(s, d, "chunks"))


# --- graph checks --------------------------------------------------------------------------------------------------------

_ENUM = ["FIXES", "CAUSES", "RAN_ON", "VIOLATES"]


@query(f"""SELECT 'required' AS "check", 'subject_id' AS field, count_if(subject_id IS NULL) AS violations FROM triples UNION ALL SELECT 'required', 'source_file', count_if(source_file IS NULL) FROM triples UNION ALL SELECT 'domain', 'predicate', count_if(predicate IS NOT NULL AND predicate NOT IN {registry._in(_ENUM)}) FROM triples
UNION ALL SELECT 'unique', 'subject_id,predicate,object_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM triples GROUP BY subject_id, predicate, object_id HAVING count(*) > 1)""")
def contract_triples(s, d):
    return validate.contract(table(s, d, "triples"), ["subject_id", "source_file"], {"predicate": _ENUM}, ["subject_id", "predicate", "object_id"])


@query(f"SELECT label, id, CASE WHEN label = 'Version' THEN id || '|' || string_split(id, '_')[1] || '|2031-01-01' END AS defaults FROM ({_NODES})")
def node_defaults(s, d):
    n = validate.node_properties(graph.merge_nodes(table(s, d, "triples")), "2031-01-01")
    return n.select("label", "id", F.when(F.col("defaults").isNotNull(), F.concat_ws("|", F.col("defaults")["version_tag"], F.col("defaults")["source_tool"], F.col("defaults")["capture_date"])).alias("defaults"))


_SEEDS = ["violation_000000001", "violation_000000336", "violation_000001219", "no_such_violation"]


@query(f"SELECT id, id IN (SELECT id FROM ({_NODES}) WHERE label = 'Violation') AS found FROM (SELECT unnest({_SEEDS}) AS id)")
def seed_check(s, d):
    return validate.seed_check(graph.merge_nodes(table(s, d, "triples")), literal(s, [(x,) for x in _SEEDS], "id string"))


_PATTERNS = {"fixes": ("FIXES", None, None), "runs": ("RAN_ON", None, None), "diverges": ("DIVERGES_FROM", None, None), "bug": ("HAS_BUG", "sylvane_0.35", None)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) AS matches, count(*) > 0 AS passed FROM {_EDGES} WHERE type = '{t}'" + (f" AND src = '{a}'" if a else "") for k, (t, a, _) in _PATTERNS.items()))
def seed_patterns(s, d):
    return validate.seed_patterns(graph.edges_of(table(s, d, "triples")), _PATTERNS)


_CANON = ["sylvane_0.35", "ravelin_23.05", "no_such_0.0"]


@query(f"SELECT (SELECT count(*) FROM ({_NODES}) WHERE label = 'Version') AS versions, coalesce((SELECT string_agg(c, ';' ORDER BY c) FROM (SELECT unnest({_CANON}) AS c) WHERE c NOT IN (SELECT id FROM ({_NODES}) WHERE label = 'Version')), '') AS missing, (SELECT count(*) FROM {_EDGES} WHERE type = 'DIVERGES_FROM') AS divergences, false AS passed")
def version_coverage(s, d):
    t = table(s, d, "triples")
    return validate.version_coverage(graph.merge_nodes(t), graph.edges_of(t), _CANON).withColumn("missing", F.array_join("missing", ";"))


_LE = f"(SELECT DISTINCT {registry._label('subject_label')} AS sl, subject_id AS src, {registry._label('object_label')} AS dl, object_id AS dst FROM triples WHERE {registry._VALID})"


@query(f"WITH e AS (SELECT * FROM {_LE}), b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), n AS (SELECT sl AS l, src AS id FROM e UNION SELECT dl, dst FROM e), s0 AS (SELECT id FROM n WHERE l = 'Fix'), s1 AS (SELECT id FROM s0 UNION SELECT y FROM b JOIN s0 ON x = id), s2 AS (SELECT id FROM s1 UNION SELECT y FROM b JOIN s1 ON x = id) SELECT count(*) AS violations, count_if(id IN (SELECT id FROM s2)) AS with_fix FROM n WHERE l = 'Violation'")
def violations_with_fix(s, d):
    return validate.violations_with_fix(graph.labelled_edges(table(s, d, "triples")))


@query(f"SELECT label, id, mentions FROM ({_NODES}) WHERE label = 'Violation' AND id IN ('violation_000000336', 'violation_000001219')")
def node_lookup(s, d):
    w = literal(s, [("Violation", "violation_000000336"), ("Violation", "violation_000001219"), ("Fix", "nobody")], "label string, id string")
    return validate.node_lookup(graph.merge_nodes(table(s, d, "triples")), w).select("label", "id", "mentions")


@query("SELECT object_id, count(*) AS n FROM triples WHERE object_id IS NOT NULL GROUP BY object_id ORDER BY n DESC, object_id LIMIT 20")
def top_objects(s, d):
    return validate.top_counts(table(s, d, "triples"), "object_id", 20)


# --- evaluation ----------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT 'confidence' AS dimension, confidence AS score FROM triples WHERE extraction_tier = 3 UNION ALL SELECT 'doubt', 1 - confidence FROM triples WHERE extraction_tier = 3), l AS (SELECT dimension, list(score ORDER BY score) AS l FROM x WHERE score > 0 GROUP BY dimension)
SELECT dimension, count(*) AS n, round(avg(coalesce(score, 0.0)), 9) AS mean, any_value(l.l[len(l.l) // 10 + 1]) AS p10 FROM x LEFT JOIN l USING (dimension) GROUP BY dimension""")
def judge_dimensions(s, d):
    t = table(s, d, "triples").withColumn("doubt", 1 - F.col("confidence"))
    return evaluate.dimension_means(t, ["confidence", "doubt"], F.col("extraction_tier") == 3).withColumn("mean", F.round("mean", 9))


_GOT = "list_distinct(list_transform(list_filter(string_split(ground_truth_answer, ' '), lambda w: contains(w, '_')), lambda w: lower(rtrim(w, '.,:;'))))"


@query(f"""WITH x AS (SELECT task_category, CASE WHEN len(e) = 0 THEN NULL WHEN len(g) = 0 THEN 0.0 ELSE CAST(len(list_intersect(e, g)) AS DOUBLE) / len(g) END AS p FROM (SELECT task_category, list_distinct(list_transform(coalesce(expected_graph_nodes, []), lambda v: lower(v))) AS e, coalesce({_GOT}, []) AS g FROM edabench))
SELECT task_category, count(*) AS n, count(p) AS grounded, round(avg(p), 9) AS mean FROM x GROUP BY task_category""")
def grounded_precision(s, d):
    got = F.transform(F.filter(F.split("ground_truth_answer", " "), lambda w: F.contains(w, F.lit("_"))), lambda w: F.regexp_replace(w, "[.,:;]+$", ""))
    e = table(s, d, "edabench").withColumn("p", evaluate.set_precision(F.col("expected_graph_nodes"), got, None))
    return evaluate.grounded_means(e, "task_category", "p").withColumn("mean", F.round("mean", 9))


@query(f"SELECT k.task_category, count(*) AS n, count_if(coalesce(f.n, 0) > 0) AS hits FROM edabench k LEFT JOIN (SELECT qid, count(*) AS n FROM {registry._LINK} l JOIN {_EDGES} e ON e.src = l.id OR e.dst = l.id GROUP BY qid) f ON f.qid = k.id GROUP BY k.task_category")
def graph_fact_hits(s, d):
    facts = registry.fused_facts(s, d).select(F.col("qid").alias("id"), "facts")
    return evaluate.hit_rate(table(s, d, "edabench").select("id", "task_category").join(facts, "id", "left"), "task_category", "facts")


@query("SELECT bucket, n, CAST(sum(n) OVER w AS BIGINT) AS done, CAST(sum(a) OVER w AS BIGINT) AS tokens_in, sum(c) OVER w AS cost FROM (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS bucket, count(*) AS n, sum(input_tokens) AS a, sum(input_tokens * 1.5::DOUBLE + output_tokens * 7.5::DOUBLE) AS c FROM qa_raw WHERE created_at IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)")
def running_cost(s, d):
    """Costs so far by day, at the batch tariff, in millionths."""
    q = table(s, d, "qa_raw").where("created_at is not null")
    return evaluate.progress(q, F.date_format("created_at", "yyyy-MM-dd"), {"tokens_in": F.col("input_tokens"), "cost": F.col("input_tokens") * 1.5 + F.col("output_tokens") * 7.5})


@query("SELECT round(sum(greatest(1, length(text) // 4)) / 1e6 * 0.12, 9) AS cost FROM chunks WHERE text IS NOT NULL")
def embedding_cost(s, d):
    c = table(s, d, "chunks").where("text is not null").agg(F.sum(corpus.estimate_tokens(F.col("text"))).alias("n"))
    return c.select(F.round(evaluate.token_cost(F.col("n"), F.lit(0), 0.12, 0.0), 9).alias("cost"))


LOG = [("a", 1, 0.9), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, 0.8), ("a", 5, 0.75), ("a", 6, 0.6), ("b", 1, 0.5), ("b", 2, None), ("b", 3, 0.5)]


@query(f"SELECT * FROM {values([('a', 6, 0.6), ('b', 1, 0.5)], 'run, step, val_mae')}")
def best_checkpoint(s, d):
    return evaluate.best_checkpoint(literal(s, LOG, "run string, step int, val_mae double"), ["run"], "step", "val_mae")


@query(f"SELECT * FROM {values([('a', 1, 0.9, 0, False), ('a', 2, 0.7, 0, False), ('a', 3, 0.7, 1, False), ('a', 4, 0.7, 2, False), ('a', 5, 0.7, 3, True), ('a', 6, 0.6, 0, False), ('b', 1, 0.5, 0, False), ('b', 2, 0.5, 1, False), ('b', 3, 0.5, 2, False)], 'run, step, best, since, stops')}")
def early_stops(s, d):
    return evaluate.early_stops(literal(s, LOG, "run string, step int, val_mae double"), "run", "step", "val_mae", 3).drop("val_mae")


@query("SELECT round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS std FROM (SELECT task_category, avg(abs(output_tokens - input_tokens)) AS m FROM qa_raw WHERE task_category IS NOT NULL GROUP BY task_category)")
def cross_validation(s, d):
    m = table(s, d, "qa_raw").where("task_category is not null").groupBy("task_category").agg(F.avg(F.abs(F.col("output_tokens") - F.col("input_tokens"))).alias("m"))
    return evaluate.cross_validation(m, "m").select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("SELECT id, array_to_string(list_sort(list_filter(coalesce(expected_sources, []), lambda v: NOT list_contains(coalesce([source], []), v))), ';') AS missing, CASE WHEN source IS NULL OR list_contains(coalesce(expected_sources, []), source) THEN '' ELSE source END AS unexpected FROM (SELECT id, list_distinct(expected_sources) AS expected_sources, source FROM edabench)")
def source_differences(s, d):
    e = table(s, d, "edabench")
    missing, unexpected = evaluate.set_differences(F.col("expected_sources"), F.array_compact(F.array("source")))
    return e.select("id", F.array_join(missing, ";").alias("missing"), F.array_join(unexpected, ";").alias("unexpected"))


@query("SELECT id, CASE WHEN bad OR length(trim(query)) = 0 OR query IS NULL OR length(query) > 500 THEN NULL ELSE trim(query) END AS query, least(greatest(k, 1), 10) AS k, ip FROM " + values([("a", " why? ", 0, "9.9.9.9", False), ("b", "   ", 5, "1.1.1.1", False), ("c", None, 11, "7.7.7.7", False), ("d", "x" * 501, 10, "8.8.8.8", False)], "id, query, k, ip, bad"))
def valid_queries(s, d):
    """Query, size and caller of requests: blank and long queries are none, sizes lie in 1 to 10, the caller is the real address, else the first forwarded one, else the host."""
    rows = [("a", " why? ", 0, "9.9.9.9", "1.2.3.4", "h"), ("b", "   ", 5, "", " 1.1.1.1 , 2.2.2.2", "h"), ("c", None, 11, None, None, "7.7.7.7"), ("d", "x" * 501, 10, " ", "", "8.8.8.8")]
    from weftspark.operators.retrieve import clamp

    x = literal(s, rows, "id string, query string, k int, real string, forwarded string, host string")
    return x.select("id", evaluate.valid_query(F.col("query")).alias("query"), clamp(F.col("k")).alias("k"), evaluate.client_ip(F.col("real"), F.col("forwarded"), F.col("host")).alias("ip"))


# --- prompts -------------------------------------------------------------------------------------------------------------

REPLIES = [("r1", '```json\n{"answer": "yes", "score": 0.5}\n```'), ("r2", '{"answer": "no"}'), ("r3", "not json"), ("r4", "```\n{\"answer\": null, \"score\": 1}\n```"), ("r6", '{"answer": "late", "score": 2}')]


@query(f"SELECT * FROM {values([('r1', 'ok', 'yes', 0.5), ('r2', 'invalid', None, None), ('r3', 'invalid', None, None), ('r4', 'invalid', None, None), ('r5', 'missing', None, None)], 'custom_id, status, answer, score')}")
def model_results(s, d):
    """Worked out by hand: fenced and plain replies, missing fields, replies that never came or were never asked for."""
    r = prompts.results(literal(s, [(f"r{i}",) for i in range(1, 6)], "custom_id string"), literal(s, REPLIES, "custom_id string, raw string"), "answer string, score double", ["answer", "score"])
    return r.select("custom_id", "status", "reply.answer", "reply.score")


@query("SELECT qa_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN length(trim(question)) > 0 THEN 'Question:' || chr(10) || question END, CASE WHEN length(trim(evidence_span)) > 0 THEN 'Evidence:' || chr(10) || evidence_span END)) AS prompt_md5 FROM qa_raw")
def question_prompts(s, d):
    return table(s, d, "qa_raw").select("qa_id", F.md5(prompts.question_prompt({"Question": F.col("question"), "Evidence": F.col("evidence_span")})).alias("prompt_md5"))


@query("SELECT id, ['a', 'b', 'c'][CAST((row_number() OVER (ORDER BY md5('42|' || id), id) - 1) % 3 + 1 AS BIGINT)] AS fact FROM edabench")
def round_robin_facts(s, d):
    return prompts.with_facts(table(s, d, "edabench").select("id"), "id", literal(s, [("b",), ("a",), ("c",), (None,), ("a",)], "fact string"), "fact")


@query("SELECT batch, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY md5('42|' || CAST(qa_id AS VARCHAR)), qa_id) - 1) // 128 AS BIGINT) AS batch FROM qa_raw) GROUP BY batch")
def batch_sizes(s, d):
    return prompts.batches(table(s, d, "qa_raw").select("qa_id"), ["qa_id"]).groupBy("batch").agg(F.count("*").alias("n"))


# --- sampling ------------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT triple_id, coalesce(predicate IN ('FIXES', 'CAUSES', 'VIOLATES'), false) AS first, row_number() OVER (PARTITION BY coalesce(predicate IN ('FIXES', 'CAUSES', 'VIOLATES'), false) ORDER BY {registry._HASH.format(k='triple_id')}, triple_id) AS k FROM triples), n AS (SELECT least(60, count_if(first)) AS n FROM r)
SELECT triple_id, first FROM r, n WHERE (first AND k <= 60) OR (NOT first AND k <= 100 - n)""")
def audit_hundred(s, d):
    return splits.priority_sample(table(s, d, "triples").select("triple_id", "predicate"), F.col("predicate").isin("FIXES", "CAUSES", "VIOLATES"), ["triple_id"], 60, 100)


@query("SELECT f.design AS fold, count_if(e.design = f.design) AS test, count_if(e.design <> f.design) AS train FROM (SELECT design_name AS design FROM orfs_runs WHERE design_name IN (SELECT canonical_name FROM canonical_entities)) e, (SELECT canonical_name AS design FROM canonical_entities WHERE kind = 'design') f GROUP BY f.design")
def leave_one_design_out(s, d):
    c = table(s, d, "canonical_entities").where("kind = 'design'").select(F.col("canonical_name").alias("design"))
    r = table(s, d, "orfs_runs").select(F.col("design_name").alias("design")).join(F.broadcast(table(s, d, "canonical_entities").select(F.col("canonical_name").alias("design")).distinct()), "design", "left_semi")
    # per fold only counts are wanted, so rows are counted by design before the folds
    n = r.groupBy("design").agg(F.count("*").alias("n"))
    x = splits.leave_one_out(n, "design", c)
    return x.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("part") == "test", F.col("n"))), F.lit(0)).alias("test"), F.coalesce(F.sum(F.when(F.col("part") == "train", F.col("n"))), F.lit(0)).alias("train"))


@query("SELECT design, round(native * m, 3) AS clock_ns FROM (SELECT canonical_name AS design, 1.0 + (length(canonical_name) % 5) AS native FROM canonical_entities WHERE kind = 'design'), (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.25, 1.5]::DOUBLE[]) AS m)")
def native_sweep(s, d):
    c = table(s, d, "canonical_entities").where("kind = 'design'").select(F.col("canonical_name").alias("design"), (1.0 + F.length("canonical_name") % 5).alias("native"))
    return splits.native_sweep(c, "design", "native").select("design", "clock_ns")


@query("SELECT family, source, count(*) AS taken FROM (SELECT violation_family AS family, source_file AS source, row_number() OVER (PARTITION BY violation_family, source_file ORDER BY md5('42|' || CAST(qa_id AS VARCHAR)), qa_id) AS r FROM qa_raw) WHERE r <= 3 GROUP BY ALL")
def capped_sources(s, d):
    q = table(s, d, "qa_raw").select(F.col("violation_family").alias("family"), F.col("source_file").alias("source"), "qa_id")
    return ranks.hash_rank(q, ["family", "source"], ["qa_id"]).where("rank <= 3").groupBy("family", "source").agg(F.count("*").alias("taken"))


@query("SELECT category, node, src FROM (SELECT id, task_category AS category, unnest(CASE WHEN seed_bug_id IS NULL THEN ['general'] ELSE [seed_bug_id, 'general'] END) AS node, CASE WHEN verified THEN 'seeds' ELSE 'generated' END AS src FROM edabench) GROUP BY ALL")
def seed_nodes(s, d):
    e = table(s, d, "edabench")
    return e.select(F.col("task_category").alias("category"), F.explode(F.array_compact(F.array("seed_bug_id", F.lit("general")))).alias("node"), F.when(F.coalesce("verified", F.lit(False)), "seeds").otherwise("generated").alias("src")).distinct()




@query(f"SELECT family, count(*) AS cases, {12} AS each FROM (SELECT unnest(range(0, 12)) AS k), (SELECT unnest({sorted(inject.TEMPLATES)}) AS family) GROUP BY family")
def fault_cases(s, d):
    """Twelve cases of each family: from the chunks, at most three of a file, and from templates where these don't suffice."""
    c = table(s, d, "chunks").select("chunk_id", "source_file", "text").where("source_file is not null and text is not null").distinct()
    x = inject.assemble_cases(c, "chunk_id", "text", "source_file", 144)
    return x.groupBy("family").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("each"))
