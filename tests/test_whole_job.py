"""Queries and operators take in the whole of their input."""

import pytest
from pyspark.sql import functions as F

from weftspark.operators import chunking, graph
from weftspark.plans import registry

CHUNK = "chunk_id string, source_file string, content_type string, text string"


def test_chunk_queries_route_by_path(spark, tmp_path):
    macro, module, log = "MACRO inv_1\n  PIN a LAYER met2 (1, 2)\n", "module adder(input [3:0] a);\nendmodule // of version v2.1\n", "[INFO] routed\n2031-01-02 finished all nets\n"
    files = [
        ("d1", "pdk/a.def", "data", macro + "DESIGN top ;\n" * 3),
        ("d2", "pdk/b.DEF", None, macro + "DESIGN top ;\n" * 3),
        ("v1", "rtl/a.v", None, module),
        ("v2", "rtl/b.v", "code", module),
        ("n1", None, "code", module),
        ("m1", "flow/Makefile", "source_code", module),
        ("l1", "runs/a.log", None, log),
        ("l2", "runs/b.rpt", "orfs_report", log),
        ("l3", "runs/c.log", "log", log),
        ("j1", "runs/d.json", "data", log),
        ("t1", "docs/a.md", "documentation", module),
        ("t2", "docs/b.md", None, log),
        ("x1", "x/y", None, module),
    ]
    spark.createDataFrame(files, CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {q: registry.QUERIES[q](spark, str(tmp_path)) for q in ("chunk_code", "chunk_log", "injected_faults")}
    ids = {q: {r[0] for r in x.collect()} for q, x in got.items()}
    assert ids == {"chunk_code": {"d1", "d2", "v1", "v2", "n1", "m1"}, "chunk_log": {"l1", "l2", "l3", "j1"}, "injected_faults": {"d1", "d2", "v1", "v2", "n1", "m1"}}
    # .def files are cut at their heads; the second section is too short to stay
    assert {r.chunk_index for r in got["chunk_code"].where(F.col("chunk_id") == "d2").collect()} == {0, 2}


def test_forum_chunks_hold_long_texts_whole(spark):
    body, answer = ("".join(f"{w} number {i} holds. " for i in range(400)).strip() for w in ("Evidence", "Answer"))
    qa = spark.createDataFrame([(1, "Why?", body, answer), (2, "Why?", None, "x" * 2500)], "id long, t string, b string, a string")
    got = {i: "\n".join(r.text for r in chunking.chunk_forum(qa, "id", "t", "b", "a").where(F.col("id") == i).collect()) for i in (1, 2)}
    assert all(f"{w} number {i} holds." in got[1] for w in ("Evidence", "Answer") for i in range(400)) and "x" * 2500 in got[2]


def test_two_hops_in_both_directions(spark):
    e = [("x", "CAUSES", "n"), ("n", "CAUSES", "v"), ("v", "CAUSES", "w"), ("w", "FIXES", "z"), ("f", "FIXES", "w"), ("z", "RAN_ON", "q")]
    near = {"n": "xvw", "v": "nxwzf", "w": "vnfz", "z": "wvf"}
    got = {r.violation: r.reached for r in graph.reachable_fixes(spark.createDataFrame(e, "src string, type string, dst string")).collect()}
    assert got == {v: len(n) for v, n in near.items()}


def test_depths_refuse_cycles(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d"), ("d", "e")]
    schema = "src string, dst string"
    assert {r.id: r.depth for r in graph.depths(spark.createDataFrame(e, schema)).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "d": 3, "e": 4}
    for cycle in ([("e", "b")], [("x", "x")], [("p", "q"), ("q", "p")]):
        with pytest.raises(ValueError, match="cycle"):
            graph.depths(spark.createDataFrame(e + cycle, schema))
