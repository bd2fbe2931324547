import pathlib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftspark.operators import chunking, corpus, evaluate, extract, graph, inject, ranks, reports, router, search, splits
from weftspark.sources import readers, writers
from weftspark.streaming import jobs
from weftspark.util import TooLarge, shared_dir, small_rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- a plain model of the chunkers --------------------------------------------------------------------------------


def tok(t):
    return max(1, len(t) // 4)


def packed(units, budget, overlap):
    out, cur, n = [], [], 0
    for u in units:
        if n + tok(u) > budget and cur:
            out.append(cur)
            kept, c = [], 0
            if overlap is not None:
                for p in reversed(cur):
                    c += tok(p)
                    if c > overlap:
                        break
                    kept.insert(0, p)
            cur, n = kept, c
        cur = [*cur, u]
        n += tok(u)
    return [*out, cur] if cur else out


def text_of(rng, n):
    words = ["slack", "net", "Macro", "Timing", "is", "high.", "low.", "Then", "fix", "it.", "module", "proc", "\n", "\n---\n", "[INFO]", "\n2031-01-02", "x" * 40]
    return " ".join(rng.choice(words) for _ in range(n))


def test_documentation_chunks(spark):
    rng = random.Random(3)
    docs = [(i, text_of(rng, rng.choice([3, 50, 400, 1500]))) for i in range(40)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {}
    for r in chunking.chunk_documentation(df, "id", budget=60, overlap=15).collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.text
    for i, t in docs:
        if t is None:
            assert i not in got
            continue
        s = re.split(r"(?<=[.!?])\s+(?=[A-Z])", t)
        if len(s) <= 1:
            s = t.split("\n")
        want = [("\n" if any("\n" in x for x in c) else " ").join(c) for c in packed(s, 60, 15)]
        assert got.get(i, {}) == {k: c for k, c in enumerate(want) if len(c.strip()) >= 10}


def test_code_and_log_chunks(spark):
    rng = random.Random(4)
    docs = [(i, text_of(rng, rng.choice([5, 60, 300])).replace(" ", "\n" if i % 2 else " ")) for i in range(20)]
    df = spark.createDataFrame(docs, "id long, text string")
    code = {}
    for r in chunking.chunk_code(df, "id", F.lit(".v"), budget=30, overlap=8).collect():
        code.setdefault(r.id, {})[r.chunk_index] = r.text
    log = {}
    for r in chunking.chunk_log(df, "id", budget=30).collect():
        log.setdefault(r.id, {})[r.chunk_index] = r.text
    keep = lambda cs: {k: c for k, c in enumerate(cs) if len(c.strip()) >= 10}
    for i, t in docs:
        want = []
        for s in (x for x in re.split(r"(?=\b(?:module|package|interface|class)\b)", t) if x.strip()):
            want += [s] if tok(s) <= 30 else ["\n".join(c) for c in packed(s.split("\n"), 30, 8)]
        assert code.get(i, {}) == keep(want)
        merged, cur = [], ""
        for s in (x for x in re.split(chunking.LOG_HEADS, t) if x.strip()):
            if tok(cur + s) > 30 and cur:
                merged.append(cur)
                cur = s
            else:
                cur += s
        merged += [cur] if cur.strip() else []
        want = []
        for c in merged:
            want += ["\n".join(x) for x in packed(c.split("\n"), 30, None)] if tok(c) > 45 else [c]
        assert log.get(i, {}) == keep(want)


# --- corpus ---------------------------------------------------------------------------------------------------------


def test_duplicates_and_classes(spark):
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(1, base), (2, base), (3, base + " tail"), (4, base + " tail more"), (5, "too short"), (6, None), (7, ""), (8, " ".join(f"z{i}" for i in range(40))), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    d = {r.doc_id: (r.keep_id, r.is_duplicate) for r in corpus.exact_duplicates(df).collect()}
    assert d[2] == (1, True) and d[6] == (6, False) and d[9] == (9, False) and d[1] == (1, False)
    c = {r.doc_id: (r.class_id, r.links) for r in corpus.near_duplicate_classes(df).collect()}
    assert {c[i][0] for i in (1, 2, 3, 4)} == {1} and c[3][1] == 2 and c[8] == (8, 0) and c[5] == (5, 0) and len(c) == 9
    assert corpus.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    docs = []
    for i in range(60):
        w = [f"a{rng.randrange(300)}" for _ in range(60)]
        docs.append((2 * i, " ".join(w)))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"b{rng.randrange(9)}"
        docs.append((2 * i + 1, " ".join(w)))
    sh = {i: {" ".join(t.split()[k : k + 5]) for k in range(56)} for i, t in docs}
    want = {(a, b) for a in sh for b in sh if a < b and sh[a] != sh[b] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]) - 1e-9}
    classes, links = corpus.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    rep = {r.id: r.rep for r in classes.collect()}
    assert {(r.a, r.b) for r in links.collect()} == {p for p in want if rep[p[0]] == p[0] and rep[p[1]] == p[1]}


def test_near_duplicates_store_and_join_prefixes_only(spark):
    # whole sets were stored twice and every shingle was joined with its frequency
    rng = random.Random(4)
    docs = [(i, " ".join(f"a{rng.randrange(10**6)}" for _ in range(1000))) for i in range(200)]
    docs += [(200 + i, docs[i][1] + " tail") for i in range(0, 200, 4)]
    before = set(pathlib.Path(shared_dir(spark)).rglob("part-*"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    c = {r.doc_id: (r.class_id, r.links) for r in corpus.near_duplicate_classes(df).collect()}
    assert c == {i: (i, int(i % 4 == 0)) for i in range(200)} | {200 + i: (i, 1) for i in range(0, 200, 4)}
    stored = sum(p.stat().st_size for p in set(pathlib.Path(shared_dir(spark)).rglob("part-*")) - before)
    assert 0 < stored < 0.5 * 8 * 996 * len(docs)


def test_near_duplicates_at_any_threshold_and_order(spark):
    rng = random.Random(5)
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(7)) for _ in range(6)]
    docs = []
    for i in range(90):
        w = docs[rng.randrange(len(docs))][1].split() if docs and rng.random() < 0.6 else " ".join(rng.choice(common) for _ in range(rng.randrange(1, 30))).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"b{rng.randrange(30)}"
        docs.append((i, " ".join(w[: len(w) - rng.randrange(4)])))
    sh = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in docs for w in [t.split()]}
    rep = {}
    for i, x in sh.items():
        if x:
            rep.setdefault(x, i)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for t in (0.4, 0.8, 0.9):
        classes, links = corpus.near_duplicates(df, t)
        assert {(r.id, r.rep) for r in classes.collect()} == {(i, rep[x]) for i, x in sh.items() if x}
        want = {(a, b, len(x & y), len(x | y)) for x, a in rep.items() for y, b in rep.items() if a < b and len(x & y) >= t * len(x | y) - 1e-9}
        assert sorted(rows(links)) == sorted(want) and len(want) > 5


def test_content_types(spark):
    paths = {"a/6_report.json": "orfs_report", "a/x.V": "code", "a/run.log": "log", "a/x_report.txt": "log", "a/b.txt": "documentation", "m.py": "source_code", "m.json": "data", "Makefile": "other", ".v": "other"}
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    assert {r.p: r.c for r in df.select("p", corpus.content_type(F.col("p")).alias("c")).collect()} == {**paths, None: None}


def test_manifests(spark):
    a = spark.createDataFrame([("1", None, 3), ("2", "nan", 4)], "id string, x string, n int")
    b = spark.createDataFrame([("3", 5.5)], "id string, extra double")
    assert rows(corpus.union_manifests(a, b)) == [("1", "", "3"), ("2", "", "4"), ("3", "", "")]
    m = corpus.update_manifest(spark.createDataFrame([("s",), ("t",)], "source string"), spark.createDataFrame([("s",), ("s",)], "source string"))
    assert {(r.source, r.dedup_removed) for r in m.collect()} == {("s", 2), ("t", 0)}


# --- extraction -------------------------------------------------------------------------------------------------------


def test_extraction(spark):
    t = "slack (VIOLATED)  -0.3\nStartpoint: a\nEndpoint: b\nEndpoint: c\nerror: met1.spacing at (3, 4)\nmodule m1 (input x);\nTessera v2.4.1 and tessera version 2.4.1"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id long, text string")
    assert rows(extract.matches(df, "id", "text", extract.SLACK_STATUS, {"s": 1, "v": 2})) == [(1, 0, "VIOLATED", "-0.3")]
    assert rows(extract.path_pairs(df, "id", "text")) == [(1, "a", "b")]
    assert rows(extract.matches(df, "id", "text", extract.MODULE, {"m": 1})) == [(1, 0, "m1")]
    assert rows(extract.tool_versions(df, "id", "text", ["Tessera"])) == [(1, "Tessera", "2.4.1"), (1, "tessera", "2.4.1")]


TRIPLE = "triple_id long, subject_id string, subject_label string, predicate string, object_id string, object_label string, confidence double, extraction_tier int, source_file string, properties map<string,string>"


def triples(spark, data):
    return spark.createDataFrame(data, TRIPLE)


def test_argmax_and_audit(spark):
    t = triples(spark, [(1, "a_x", "Fix", "FIXES", "v_1", "Violation", 0.5, 1, "f", None), (2, "a_x", "Fix", "FIXES", "v_1", "Violation", 0.9, 1, "f", None), (3, "a_x", "Fix", "FIXES", "v_1", "Violation", 0.9, 1, "f", None), (4, "it", "Module", "FIXES", "v_2", "Rule", None, 1, "", None), (5, "", "Fix", "ODD", "x", "Y", 1.0, 1, "f", None), (6, "abc", "Fix", "ODD", "xyz", "Y", 1.0, 1, "f", None)])
    assert [(r.triple_id, r.copies) for r in extract.argmax_dedup(t).where("subject_id = 'a_x'").collect()] == [(2, 3)]
    a = {r.triple_id: (r.verdict, r.notes) for r in extract.audit(t).collect()}
    assert a[1] == ("CORRECT", "auto_pass") and a[4][0] == "WRONG" and "no_source_file" in a[4][1] and a[5] == ("WRONG", "Empty subject or object ID") and a[6][0] == "UNCERTAIN"


def test_graph_merge(spark):
    t = triples(spark, [(1, "a", "fix", "fixes it", "b", "Odd", 0.1, 1, "f1", {"k": "1", "m": "x"}), (2, "a", "Fix", "fixes it", "b", None, 0.2, 1, "f2", {"k": "2"}), (3, "", "Fix", "X", "b", "Fix", 0.2, 1, "f", None)])
    n = {(r.label, r.id): (r.source_file, r.mentions) for r in graph.merge_nodes(t).collect()}
    assert n == {("Fix", "a"): ("f1", 2), ("Entity", "b"): ("f1", 2)}
    e = graph.merge_edges(t).collect()
    assert len(e) == 1 and e[0].properties == {"k": "2", "m": "x"} and e[0].type == "FIXES_IT" and e[0].source_file == "f2"
    assert tuple(graph.merge_stats(t).first()) == (2, 1, 4, 2, 1)


def test_hops_and_depths(spark):
    e = spark.createDataFrame([("a", "t", "b"), ("b", "t", "c"), ("c", "t", "d"), ("b", "u", "a"), ("b", "t", "b")], "src string, type string, dst string")
    got = rows(graph.k_hop_edges(e, spark.createDataFrame([("a",)], "id string"), 2))
    assert got == [("a", "a", "t", "b"), ("a", "b", "t", "b"), ("a", "b", "t", "c"), ("a", "b", "u", "a")]
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")], "src string, dst string")
    assert rows(graph.depths(dag)) == [("a", 0), ("b", 1), ("c", 2), ("x", 0)]
    assert rows(graph.orphans(spark.createDataFrame([("a",), ("q",)], "id string"), e)) == [("q",)]


# --- retrieval --------------------------------------------------------------------------------------------------------


def test_search(spark):
    d = spark.createDataFrame([(1, "clock slack clock"), (2, "metal rule"), (3, None), (4, "clock")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "clock rule"), ("n", None)], "id string, query string")
    top = {r.did: r.rank for r in search.bm25(d, q).collect()}
    assert set(top) == {1, 2, 4}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vid, r["rank"]) for r in search.dense(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    same = lambda b: rows(search.dense(v, v, 2, block=b))
    assert same(1) == same(100) and len(same(1)) == 6
    c = spark.createDataFrame([("q", i, i, s) for i, s in enumerate([0.1, 0.9, 0.5], 1)], "qid string, did long, rank int, rerank_score double")
    assert [r.did for r in search.rerank(c, 2).orderBy("reranked_rank").collect()] == [2, 3]
    assert search.rerank(c.limit(0)).count() == 0


@pytest.mark.parametrize("q,cat", [("why did timing fail", "error_diagnosis"), ("openroad version change", "cross_tool_knowledge"), ("sdc clock constraint", "constraint_generation"), ("nothing here", "error_diagnosis"), ("wns sdc", "error_diagnosis")])
def test_routing(spark, q, cat):
    assert router.route(spark.createDataFrame([(q,)], "q string"), "q").first().category == cat


# --- reports ----------------------------------------------------------------------------------------------------------


def test_reports(spark):
    t = "wns -0.5\ntns -2\nclock period = 2.5\n Total 1e-3 2e-3 3e-3 6e-3 100%\ncore area 50 um2\nDIEAREA ( 0 0 ) ( 100 200 )\n- u1 NAND2 + PLACED ( 10 20 ) N ;\n"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id long, text string")
    c = F.col("text")
    cols = {**reports.timing_report(c), **reports.power_report(c), **reports.area_report(c), "die": reports.die_area(c)}
    r = df.select("id", *(x.alias(k) for k, x in cols.items())).orderBy("id").collect()
    assert (r[0].wns, r[0].tns, r[0].clock_period, r[0].total_mw, r[0].area_um2, r[0].die) == (-0.5, -2.0, 2.5, 6.0, 50.0, [0.0, 0.0, 100.0, 200.0])
    assert r[1].wns is None and r[2].wns is None
    assert rows(reports.placements(df, "id", "text")) == [(1, "u1", "NAND2", 10, 20)]
    net = spark.createDataFrame([(1, "NAND2 g1 (.A(a), .Y(n1));\nINV g2 (.A(n1), .Y(z));\nmodule m (.x(y));\n")], "id long, text string")
    p = reports.pins(net, "id", "text")
    assert rows(reports.netlist_edges(p, "id")) == [(1, "g1", "g2", "n1")]
    k = p.select(reports.cell_kind(F.col("cell")).alias("a"), reports.cell_kind(F.col("cell"), False).alias("b")).distinct()
    assert ("NAND", "AND") in rows(k)
    lib = spark.createDataFrame([("f", 1, "cell (X) {"), ("f", 2, " area : 2.0 ;"), ("f", 3, 'cell ("Y") {'), ("f", 4, " area : 3 ;")], "file string, line_no int, line string")
    assert rows(reports.liberty_areas(lib)) == [("f", "X", 2.0), ("f", "Y", 3.0)]
    s = spark.createDataFrame([("set clk_period 380",), ("none",)], "t string").select(reports.sdc_variant(F.col("t"), F.lit(2.5)).alias("v"))
    assert [r.v for r in s.collect()] == ["set clk_period 2.5", None]


# --- ranks, samples, evaluation -----------------------------------------------------------------------------------------


def test_ranks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(50)) for _ in range(300)] + [("c", None), (None, 1)]
    df = spark.createDataFrame(data, "g string, v int").withColumn("id", F.monotonically_increasing_id())
    r = ranks.hash_rank(df, ["g"], ["id"])
    for g in ("a", "b", None):
        got = sorted(x["rank"] for x in r.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert got == list(range(1, len(got) + 1))
    p95 = {x.g: x.value for x in ranks.nearest_rank(df, ["g"], "v", 0.95).collect()}
    for g in ("a", "b"):
        s = sorted(v for k, v in data if k == g)
        assert p95[g] == s[int(0.95 * len(s))]
    import statistics

    p99 = {x.g: x.value for x in ranks.exclusive_quantile(df, ["g"], "v", 0.99).collect()}
    for g in ("a", "b"):
        s = sorted(v for k, v in data if k == g)
        assert p99[g] == pytest.approx(statistics.quantiles(s, n=100)[98])


def test_splits(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)] + [(100, None)], "id long, s string")
    n = {(r.s, r.split): r["count"] for r in splits.stratified_split(df, "s", ["id"]).groupBy("s", "split").count().collect()}
    assert n == {("a", "train"): 72, ("a", "val"): 9, ("a", "test"): 9, ("b", "train"): 8, ("b", "val"): 1, ("b", "test"): 1, (None, "test"): 1}
    o = {r.s: r["count"] for r in splits.oversample(df, "s", ["id"]).groupBy("s").count().collect()}
    assert o == {"a": 90, "b": 15, None: 15}
    assert splits.stratified_split(df.limit(0), "s", ["id"]).count() == 0
    a = splits.assemble([df.where("s = 'b'"), df.where("s = 'a'").withColumn("s", F.lit("b"))], "s", {"b": 12}, ["id"])
    assert a.count() == 12 and a.where("pool = 0").count() == 10
    assert splits.sweep(spark.createDataFrame([("d",)], "design string")).count() == 11


def test_evaluation(spark):
    df = spark.createDataFrame([(["A", "b"], ["a"]), ([], ["x"]), (None, None)], "e array<string>, g array<string>")
    assert [r.x for r in df.select(evaluate.set_recall(F.col("e"), F.col("g")).alias("x")).collect()] == [0.5, 1.0, 1.0]
    assert [r.x for r in df.select(evaluate.set_recall(F.col("e"), F.col("g"), None).alias("x")).collect()] == [0.5, None, None]
    s = spark.createDataFrame([(1.2, 0.5, None)], "a double, b double, c double").select(evaluate.overall([F.col(x) for x in "abc"]).alias("m"), evaluate.overall([F.col("a"), F.col("b")], "mean").alias("n")).first()
    assert (s.m, s.n) == (0.0, 0.75)
    j = evaluate.judged(spark.createDataFrame([(0.95,), (0.5,), (None,)], "s double"), "s")
    assert [r.status for r in j.collect()] == ["accepted", "rejected", "failed"]


def test_injection(spark):
    t = "create_clock -period 2.5 -name c [get_ports x]\nmodule m (input [3:0] a, output b);\n  SPACING 2.0 ;\nexport CORE_DENSITY=0.5\n" + "x" * 50
    df = spark.createDataFrame([(1, "a/b.v", t), (2, "c.v", "short"), (3, "d.v", None)], "id long, path string, text string")
    got = {r.family: r.injected for r in inject.inject(df, "id", "text", "path").collect()}
    assert "-period 0.25 " in got["setup_violation"] and "-period 2500 " in got["sdc_unit_mismatch"] and "SPACING 10 ;" in got["drc_spacing"]
    assert "\n# create_clock" in "\n" + got["missing_clock"] and got["rtl_port_mismatch"].count("[4:0]") == 1 and "CORE_DENSITY=0.95" in got["ppa_regression"] and "output b, phantom_debug_port)" in got["lvs_mismatch"]
    assert inject.cases(inject.inject(df, "id", "text", "path"), "id", 1).where("family = 'setup_violation'").first().case_id == "setup_violation_0000"
    for family in inject.TEMPLATES:
        made = inject.templates(spark, family, 5).collect()
        assert len({r.case_id for r in made}) == 5 and all(r.original != r.injected and "{" not in r.source_file for r in made)


# --- sources, sinks, streams ----------------------------------------------------------------------------------------------


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c" / ".git").mkdir(parents=True)
    (tmp_path / "c" / "a.v").write_text("module m;" + "x" * 200)
    (tmp_path / "c" / "b.bin").write_text("x" * 200)
    (tmp_path / "c" / "s.v").write_text("tiny")
    (tmp_path / "c" / ".git" / "h.v").write_text("x" * 200)
    assert [r.ext for r in readers.files(spark, str(tmp_path / "c")).collect()] == [".v"]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "j.jsonl"), "a int", strict=False).where("a is not null").count() == 2
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, v string")
    p = str(tmp_path / "t")
    assert writers.append_new(spark, df, p, "k") == 2 and writers.append_new(spark, df, p, "k") == 0
    writers.quarantine(df, df.where("k = 1"), "k", str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1 and spark.read.parquet(str(tmp_path / "ok")).count() == 3
    with pytest.raises(TooLarge):
        small_rows(df, "rows", 2)


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, datetime(2031, 1, 1, 0, i), "v") for i in range(6)] + [(0, datetime(2031, 1, 1), "v")], "event_id long, ts timestamp, event_type string")
    src = str(tmp_path / "src")
    e.write.parquet(src)
    go = lambda: jobs.ingest(spark, src, "event_id long, ts timestamp, event_type string", str(tmp_path / "out"), "event_id", str(tmp_path / "log"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert go() == 0
    assert sorted(r.n for r in jobs.windowed_counts(e, width="3 minutes").collect()) == [3, 4]
    assert jobs.sessions(e, key="event_type", gap="2 minutes").count() == 1
