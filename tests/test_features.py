"""Netlists, layouts, runs, prompts, sinks and the helpers they share."""

import random

import pytest
from pyspark.sql import functions as F

from weftspark import util
from weftspark.operators import chunking, evaluate, graph, netlist, prompts, runs
from weftspark.plans import features
from weftspark.sources import readers, writers


def kahn(edges, nodes):
    """Depths as a queue gives them; nodes on cycles keep what the nodes before them gave."""
    left = {n: sum(d == n for _, d in edges) for n in nodes}
    depth = dict.fromkeys(nodes, 0)
    queue = [n for n in nodes if not left[n]]
    while queue:
        n = queue.pop(0)
        for s, d in edges:
            if s == n:
                depth[d] = max(depth[d], depth[n] + 1)
                left[d] -= 1
                if not left[d]:
                    queue.append(d)
    return depth


def test_partial_depths_against_a_queue(spark):
    rng = random.Random(8)
    for n in (6, 12):
        nodes = [f"n{i}" for i in range(n)]
        edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(int(n * 1.3))})
        used = {x for e in edges for x in e}
        got = {r.id: r.depth for r in graph.depths(spark.createDataFrame(edges, "src string, dst string"), "partial").collect()}
        assert got == {k: v for k, v in kahn(edges, nodes).items() if k in used}
    assert graph.depths(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_cell_types_and_drivers(spark):
    c = spark.createDataFrame([("NAND2X1",), ("XNOR2x",), ("DFFRX1",), ("odd",), (None,)], "c string")
    assert [r[0] for r in c.select(netlist.cell_type(F.col("c"))).collect()] == ["AND2", "OR2", "DFFR", "UNKNOWN", "UNKNOWN"]
    assert [r[0] for r in c.select(netlist.cell_type(F.col("c"), "strict")).collect()] == ["NAND2", "XNOR2", "DFFR", "UNKNOWN", "UNKNOWN"]
    n = spark.createDataFrame(features.NETLISTS, "id string, text string").where("id = 'twice'")
    k = netlist.connections(n, "id", "text")
    assert {(r.src, r.dst) for r in netlist.edges(k).collect()} == {("d2", "l1")} and {(r.src, r.dst) for r in netlist.edges(k, "all").collect()} == {("d1", "l1"), ("d2", "l1")}
    assert netlist.features(n.limit(0), "id", "text", spark.createDataFrame([], "name string, area double")).count() == 0


def test_names_are_repaired():
    text = "COMPONENTS 1 ;\n- a\\[1\\] BUF + PLACED ( 0 0 ) N ;\nEND COMPONENTS\nPIN ( a[1] Y ) ;\n- NET x ( a[1] Y ) ;\nno brackets a[1]"
    fixed = netlist.repaired_names(text)
    assert "PIN ( a\\[1\\] Y )" in fixed and "- NET x ( a[1] Y )" in fixed and fixed.endswith("no brackets a[1]")
    assert netlist.repaired_names(None) is None and netlist.repaired_names("plain") == "plain"


def test_labels_are_needed(spark):
    m = spark.createDataFrame([(True, i % 3 == 0) for i in range(30)], "has_power boolean, has_delay boolean")
    assert runs.fully_labelled(m).count() == 10
    with pytest.raises(ValueError, match="10 are needed"):
        runs.fully_labelled(m.limit(5))
    assert runs.run_stats(spark.createDataFrame([], "run_id string, path string, text string")).count() == 0


def test_replies_and_models(spark):
    d = spark.createDataFrame([("q1", "one"), ("q2", "two"), ("q3", None)], "qid string, context string")

    def model():
        return lambda texts: [f'```json\n{{"answer": "{t.upper()}"}}\n```' for t in texts]

    def broken():
        def call(texts):
            raise OSError("no model")

        return call

    assert [(r.answer, r.failed) for r in prompts.synthesise(d, model).orderBy("qid").collect()] == [("ONE", False), ("TWO", False), ("", False)]
    assert {(r.answer, r.failed) for r in prompts.synthesise(d, broken).collect()} == {("The answer could not be made.", True)}
    assert {r.batch for r in prompts.batches(spark.range(300).select(F.col("id").alias("k")), ["k"]).collect()} == {0, 1, 2}
    r = prompts.requests(d, F.col("qid"), F.col("context"), "m", 5).orderBy("custom_id").first()
    assert r.custom_id == "q1" and '"max_tokens":5' in r.body


def test_report_chunks(spark):
    t = spark.createDataFrame([(1, '{"a__x": 1.50, "b__y": "text \\"q\\"", "a__z": null, "b__w": true}'), (2, "no json\nbut lines of text"), (3, None), (4, "")], "id int, text string")
    got = chunking.chunk_report(t, "id").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index) for r in got] == [(1, 0), (1, 1), (2, 0)]
    assert got[0].text == '{\n  "a__x": 1.5,\n  "a__z": null\n}' and got[1].text == '{\n  "b__y": "text \\"q\\"",\n  "b__w": true\n}' and got[2].text == "no json\nbut lines of text"


def test_rollups_do_not_share_names(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("b", None, None)], "g string, h string, v double")
    one = evaluate.rollup(d, ["g"], {"v": F.col("v")})
    two = evaluate.rollup(d.where("g = 'b'"), ["h"], {"w": F.col("v") * 2})
    assert {(r.level, r.key, r.n, r.v) for r in one.collect()} == {("g", "a", 1, 1.0), ("g", "b", 2, 3.0), ("all", None, 3, 2.0)}
    assert {(r.level, r.key, r.n, r.w) for r in two.collect()} == {("h", "x", 1, 6.0), ("h", None, 1, None), ("all", None, 2, 6.0)}


def test_keyed_table_and_logs(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string")
    assert writers.append_new(spark, df, p, "k") == 50 and writers.append_new(spark, df.unionByName(spark.createDataFrame([(99, "x"), (99, "y"), (None, "z")], df.schema)), p, "k") == 1
    assert spark.read.parquet(p).count() == 51 and spark.read.parquet(p).select("k").distinct().count() == 51
    writers.append_json(df.limit(2), str(tmp_path / "log"))
    writers.append_json(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    writers.arrays(df, ["v"], ["k"], str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).where("v = 'v7'").first().x == [7.0]
    writers.with_twin(df, str(tmp_path / "twin"))
    assert spark.read.json(str(tmp_path / "twin.jsonl")).count() == 50
    writers.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), "k int, v string").count() == 50
    writers.report(spark, {"kept": 3, "name": "a"}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().kept == 3


def test_file_scans(spark, tmp_path):
    for name, text in (("b.v", "x" * 300), ("a.vhd", "y" * 200), ("c.txt", " " * 150 + "short")):
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    assert readers.files(spark, root).count() == 3 and readers.files(spark, root, most=250).count() == 2 and readers.files(spark, root, least_text=20).count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in readers.files(spark, root, first=1).collect()] == ["a.vhd"]
    listing = spark.createDataFrame([("g/2.pt",), ("g/1.pt",)], "path string")
    d = spark.createDataFrame([("1", "9"), ("7", "2"), ("7", "7"), (None, None)], "a string, b string")
    got = readers.first_existing(d, [F.concat(F.lit("g/"), "a", F.lit(".pt")), F.concat(F.lit("g/"), "b", F.lit(".pt"))], listing)
    assert sorted(((r.b, r.found) for r in got.where("a is not null").collect()), key=str) == [("2", "g/2.pt"), ("7", None), ("9", "g/1.pt")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "r.json").write_text('{"a": 1.5,\n "b": 2}')
    assert readers.metric_reports(spark, str(tmp_path / "m")).first().metrics == {"a": 1.5, "b": 2.0}
    issue = [(1, "T", "b" * 6000, [("c" * 30,)] * 7, [("Bug",), ("other",)]), (2, "T", " ", [("c" * 30,)], [])]
    i = spark.createDataFrame(issue, "number int, title string, body string, comments array<struct<body:string>>, labels array<struct<name:string>>")
    r = readers.issue_pairs(i).collect()
    assert len(r) == 1 and len(r[0].question_body) == 6000 and r[0].answer.count("---") == 6 and r[0].error_tags == ["Bug"]
    assert readers.issue_pairs(i, most_body=5000, comments=5).first().answer.count("---") == 4


def test_broadcasts_are_checked_in_bytes(spark):
    d = spark.createDataFrame([(1, "x" * 1000)] * 50, "k int, v string")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(util.maybe_broadcast(d)) and not hinted(util.maybe_broadcast(d, max_bytes=10_000)) and not hinted(util.maybe_broadcast(d, max_rows=10)) and hinted(util.maybe_broadcast(d.limit(0)))


def test_clusters_need_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        util.shared_dir(Session())


def test_request_log_and_seed_files(spark, tmp_path):
    from weftspark.streaming import jobs

    e = spark.createDataFrame([(1, "why?", None, "1.1.1.1, 2.2.2.2"), (2, " ", "9.9.9.9", None)], "id int, query string, real string, forwarded string")
    e.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    cols = {"id": F.col("id"), "ip": evaluate.client_ip(F.col("real"), F.col("forwarded"), F.lit("host")), "query": evaluate.valid_query(F.col("query"))}
    for _ in range(2):  # a second start adds nothing
        jobs.query_log(stream(), cols, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert sorted(((r.id, r.ip, r.query) for r in spark.read.parquet(str(tmp_path / "log")).collect()), key=str) == [(1, "1.1.1.1", "why?"), (2, "9.9.9.9", None)]
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- id: s1\n  question: why\n- id: s2\n")
    (tmp_path / "b.yaml").write_text("id: one\nquestion: what\n")
    (tmp_path / "c.yaml").write_text("other: 1\n")
    got = [[tuple(r) for r in readers.yaml_items(spark, str(tmp_path / f"{n}.yaml"), "id string, question string").collect()] for n in "abc"]
    assert got == [[("s1", "why"), ("s2", None)], [("one", "what")], []]
