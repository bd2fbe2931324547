"""Triples from texts, linking, facts, retrieval, duplicates by MinHash."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import corpus, emit, graph, minhash, retrieve, router, search, validate
from weftspark.plans import retrieval, triples


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- triples -----------------------------------------------------------------------------------------------------------


def test_triples_keep_properties(spark):
    t = spark.createDataFrame(triples.FILES, "path string, text string").withColumn("confidence", F.lit(1)).withColumn("source_file", F.lit("clash"))
    got = emit.extract_triples(t, "path", "text", tools=triples.TOOLS).collect()
    by = {}
    for r in got:
        by.setdefault((r.predicate, r.source_file), []).append(r)
    assert [r.properties for r in by["HAS_SLACK", "runs/a/timing_report.rpt"]] == [{"slack": "-0.25", "unit": "ns"}, {"slack": "-12.5", "unit": "ps"}]
    assert by["VIOLATES", "runs/a/drc_errors.log"][0].properties == {"layer": "met2", "x": "12.5", "y": "30.0"}
    assert by["HAS_TIMING", "x/v3_0/heron/6_report.json"][0].properties == {"wns_ps": "-12.5", "design": "heron", "version": "ORFS_v3.0"}
    assert {r.object_id for r in by["HAS_METRIC", "x/v3_0/heron/6_report.json"]} == {f"metric_{k}_heron_ORFS_v3.0" for k in ("tns", "area", "power")}
    assert not [r for r in got if r.source_file in ("short.v", "empty.v", "z/26Q1/plover/6_report.json", None)]
    assert emit.extract_triples(t.limit(0), "path", "text").count() == 0


def test_module_limit_is_a_parameter(spark):
    text = "\n".join(f"module m{i} (a);" for i in range(25))
    t = spark.createDataFrame([("a.v", text)], "p string, t string")
    n = lambda k: t.select(F.explode(emit.pattern_triples(F.col("p"), F.col("t"), modules=k))).count()
    assert n(None) == 25 and n(10) == 10


# --- linking -----------------------------------------------------------------------------------------------------------

IDS = ["design_jpeg", "design_ibex", "version_v3_0", "version_26q1", "tool_yosys", "ed_002_version_divergence", "ed_005_ibex_26q1_sigsegv", "constraint_x", "wns", "xy", None, ""]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Why does JPEG fail?", ["design_jpeg"]), ("jpegs are fine", []), ("ibex crash in 26Q1", ["version_26q1", "design_ibex"]), ("what about ED-002?", ["ed_002_version_divergence"]), ("ed002 has no mark", []),
        ("the constraint_x of yosys, wns", ["constraint_x", "tool_yosys", "wns"]), ("galaxy", ["xy"]), ("", []), (None, []), ("v3_0 and v3.0", ["version_v3_0"]),
    ],
)
def test_linking(spark, query, want):
    q = spark.createDataFrame([(1, query)], "id int, query string").withColumn("low", F.lit("clash"))
    ids = spark.createDataFrame([(x,) for x in IDS], "id string")
    assert [r.id for r in router.link(q, "id", "query", ids).orderBy("rank").collect()] == want


def test_linking_against_containment(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd_") for _ in range(n))
    ids = {word(rng.randrange(1, 8)) for _ in range(400)}
    qs = [(i, word(60)) for i in range(20)]
    got = {(r.qid, r.id) for r in router.link(spark.createDataFrame(qs, "id int, query string"), "id", "query", spark.createDataFrame([(x,) for x in ids], "id string")).collect()}
    assert got == {(i, x) for i, q in qs for x in ids if x in q} and len(got) > 100


# --- facts and answers ---------------------------------------------------------------------------------------------------


def test_answers_from_end_to_end(spark):
    docs = spark.createDataFrame([(1, "hold slack of heron on clock", "a.md"), (2, "metal spacing rule", "b.md"), (3, None, None), (4, "clock clock hold", None)], "doc_id long, text string, source_file string")
    q = spark.createDataFrame([("q1", "Why does ed_001_override fail hold on clock?"), ("q2", "zzz"), ("q3", None), ("q1", "Why does ed_001_override fail hold on clock?")], "id string, query string")
    e = spark.createDataFrame(retrieval.SEED, retrieval._SCHEMA)
    ids = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
    got = {r.qid: r for r in retrieve.retrieve(q, docs, e, ids).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"].task_category == "error_diagnosis" and got["q1"].entities == ["ed_001_override"]
    assert [c.did for c in got["q1"].chunks] == [4, 1] or [c.did for c in got["q1"].chunks] == [1, 4]
    text = got["q1"].context
    assert "## Knowledge Graph Facts" in text and "### Entity: ed_001_override" in text and "- Fix : fix_a (doc_1)" in text and "- Cause : run_heron_2" in text and re.search(r"### \[1\] \S+ \(score: 0\.\d{3}\)", text)
    assert got["q1"].citations == ["a.md"] and got["q2"].context == "" and got["q2"].chunks == [] and got["q2"].entities == []
    for mode, error in (("fuzzy", "none of"), ("dense", "needs vectors")):
        with pytest.raises(ValueError, match=error):
            retrieve.candidates(mode, docs, q)
    assert retrieve.candidates("sparse", docs, q, where=F.col("source_file") == "b.md").count() == 0


def test_bm25_against_formula(spark, monkeypatch):
    monkeypatch.setattr(search, "SPARSE_BLOCK", 3)
    rng = random.Random(1)
    docs = [(i, None if i == 7 else " ".join(rng.choice("ab bc cd de éf x_1 9".split()) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    qs = [(f"q{i}", " ".join(rng.sample("ab bc cd de éf x_1 9 zz".split(), 3))) for i in range(8)]
    got = {}
    for r in search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*qs, ("n", None)], "id string, query string"), 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.did, round(r.score, 9)))
    words = {i: re.findall(r"\w+", t or "") for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    for q, text in qs:
        s = {}
        for t in set(text.split()):
            df = sum(t in w for w in words.values())
            for i, w in words.items():
                if tf := w.count(t):
                    s[i] = s.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        want = sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        assert sorted(got[q]) == [(k + 1, i, pytest.approx(v, abs=1e-8)) for k, (i, v) in enumerate(want)]


def test_dense_and_inverted_file(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(600)] + [(900, None), (901, [0.0] * 16)]
    v = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0")
    exact = {(r.qid, r.vid) for r in search.dense(v, q, 10).collect()}
    blocks = {(r.qid, r.vid) for r in search.dense(v, q, 10, block=4).collect()}
    m = np.array([e for _, e in x[:600]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 600, 50) for j in sorted((j for j in range(600) if j != i), key=lambda j: (-round(float(m[i] @ m[j]), 9), j))[:10]}
    assert exact == blocks == want
    found = {(r.qid, r.vid) for r in search.ivf(v, q, 10, cells=24, probes=6).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert search.ivf(v.limit(0), q.limit(0)).count() == 0 and search.dense(v, q.limit(0)).count() == 0


# --- MinHash -------------------------------------------------------------------------------------------------------------


def test_signatures_and_bands():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.6) < 0.15 and (minhash.signature(a) == minhash.signature(a[::-1])).all()
    for t in (0.5, 0.7, 0.8, 0.9):
        k, r = minhash.bands(t)
        assert k * r <= 128 and 1 - (1 - t**r) ** k >= 0.99


def test_near_duplicates_by_bands(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)] for _ in range(12)]
    docs, n = [], 0
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randrange(0, 2)):
                w[rng.randrange(len(w))] = "new"
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "too short text")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs if t and len(t.split()) >= 5}
    want = {}
    for i in sets:
        near = [j for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if near:
            want[i] = min(near)
    got = {r.id: r.near for r in minhash.near_duplicates(d, 0.8).collect()}
    # a copy's smallest like document may be like its representative only through the same set: equal sets share it
    assert got == want and len(want) > 10
    items = spark.createDataFrame([("A", docs[0][1]), ("B", "other words that nobody has written here"), ("C", None)], "id string, q string")
    found = {r.doc_id: r.item_id for r in minhash.contamination(d, "doc_id", "text", items, "id", "q").collect()}
    brute = {r.doc_id: r.item_id for r in corpus.contamination(d, "doc_id", "text", items, "id", "q").collect()}
    assert found == brute and len(found) >= 3


# --- checks --------------------------------------------------------------------------------------------------------------


def test_checks(spark):
    e = spark.createDataFrame(retrieval.SEED, retrieval._SCHEMA)
    nodes = e.select(F.col("src_label").alias("label"), F.col("src").alias("id")).unionAll(e.select(F.col("dst_label").alias("label"), F.col("dst").alias("id"))).distinct()
    r = validate.version_coverage(nodes, e, ["version_31q1", "version_30q4"]).first()
    assert r.passed and r.missing == [] and r.divergences == 1
    assert validate.violations_with_fix(e).first() == (4, 2) and validate.violations_with_fix(e, 4).first() == (4, 4)
    assert {(x.rule, tuple(x.pdks), x.violations) for x in validate.rule_use(e).collect()} == {("rule_m2", ("pdk_a", "pdk_b"), 2)}
    assert rows(validate.contract(e.limit(0), ["src"], {"type": ["FIXES"]}, ["src"])) == [("domain", "type", 0), ("required", "src", 0), ("unique", "src", 0)]
    assert graph.violation_fixes(e).where("violation = 'ed_001_override'").count() == 3
