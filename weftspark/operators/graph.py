"""Property graph as two DataFrames: nodes (label, id, ...) and edges (src, type, dst, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.util import cut

# fixed values: labels a node may have
LABELS = ("Design", "Module", "Violation", "Rule", "TimingPath", "ToolRun", "Report", "Version", "Fix", "PDK", "Metric", "Entity")


def label(c: Column) -> Column:
    """A valid label: as it is or in another letter case, else Entity."""
    out = F.when(c.isin(*LABELS), c)
    for x in LABELS:
        out = out.when(F.lower(c) == x.lower(), x)
    return out.otherwise("Entity")


def relation(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "RELATED_TO").otherwise(F.upper(F.regexp_replace(c, "[^A-Za-z0-9_]", "_")))


def valid(triples: DataFrame) -> DataFrame:
    return triples.where("coalesce(subject_id, '') != '' and coalesce(object_id, '') != ''")


def merge_nodes(triples: DataFrame, seq: str = "triple_id") -> DataFrame:
    """(label, id, first_seq, source_file, mentions): a node keeps the properties of its first writer in ingest order."""
    t = valid(triples)
    ends = F.array(*(F.struct(label(F.col(f"{x}_label")).alias("label"), F.col(f"{x}_id").alias("id")) for x in ("subject", "object")))
    n = t.select(F.col(seq).alias("s"), "source_file", F.explode(ends).alias("e")).select("e.*", "s", "source_file")
    return n.groupBy("label", "id").agg(F.min("s").alias("first_seq"), F.min(F.struct("s", "source_file"))["source_file"].alias("source_file"), F.count("*").alias("mentions"))


def merge_edges(triples: DataFrame, seq: str = "triple_id") -> DataFrame:
    """(src_label, src, type, dst_label, dst, properties, confidence, source_file, written): a later writer overwrites an edge's properties key by key; confidence and source_file are the last writer's."""
    t = valid(triples).select(label(F.col("subject_label")).alias("src_label"), F.col("subject_id").alias("src"), relation(F.col("predicate")).alias("type"), label(F.col("object_label")).alias("dst_label"), F.col("object_id").alias("dst"), F.col(seq).alias("s"), "properties", "confidence", "source_file")
    keys = ["src_label", "src", "type", "dst_label", "dst"]
    last = t.groupBy(*keys).agg(F.max(F.struct("s", "confidence", "source_file")).alias("x"), F.count("*").alias("written"))
    props = t.select(*keys, "s", F.explode("properties").alias("k", "v")).groupBy(*keys, "k").agg(F.max(F.struct("s", "v"))["v"].alias("v"))
    props = props.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))  # an edge's distinct keys
    j = last.join(props, keys, "left")
    return j.select(*keys, F.map_from_entries(F.coalesce("kv", F.array().cast("array<struct<k:string,v:string>>"))).alias("properties"), "x.confidence", "x.source_file", "written")


def merge_stats(triples: DataFrame) -> DataFrame:
    """One row: triples merged and rejected, node writes (two per triple) and distinct nodes and edges."""
    ok = valid(triples)
    e = ok.select(F.struct(label(F.col("subject_label")).alias("l"), F.col("subject_id").alias("i")).alias("n")).unionAll(ok.select(F.struct(label(F.col("object_label")).alias("l"), F.col("object_id").alias("i")).alias("n")))
    a = triples.agg(F.count("*").alias("all"), F.count_if((F.coalesce("subject_id", F.lit("")) != "") & (F.coalesce("object_id", F.lit("")) != "")).alias("merged"))
    b = e.distinct().agg(F.count("*").alias("distinct_nodes"))
    c = ok.select("subject_id", relation(F.col("predicate")), "object_id").distinct().agg(F.count("*").alias("distinct_edges"))
    return a.crossJoin(b).crossJoin(c).select("merged", (F.col("all") - F.col("merged")).alias("rejected"), (F.col("merged") * 2).alias("node_writes"), "distinct_nodes", "distinct_edges")


def edges_of(triples: DataFrame) -> DataFrame:
    return valid(triples).select(F.col("subject_id").alias("src"), F.col("predicate").alias("type"), F.col("object_id").alias("dst")).distinct()


def labelled_edges(triples: DataFrame) -> DataFrame:
    """Distinct (src_label, src, type, dst_label, dst), labels as they are merged."""
    return valid(triples).select(label(F.col("subject_label")).alias("src_label"), F.col("subject_id").alias("src"), F.col("predicate").alias("type"), label(F.col("object_label")).alias("dst_label"), F.col("object_id").alias("dst")).distinct()


def k_hop_edges(edges: DataFrame, starts: DataFrame, k: int = 2, limit: int | None = None) -> DataFrame:
    """(start, src, type, dst): distinct edges on undirected paths of up to k edges from each start, no edge twice on a path.

    Edges at distance up to k - 1 from the start: for k = 2, all edges at the start or its neighbours. With a limit,
    the first so many edges per start in the order of src, type, dst.
    """
    e = edges.select("src", "type", "dst").distinct()
    both = e.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("to"))).distinct()
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct())
    front = seen
    for _ in range(k - 1):
        nxt = front.join(both, "at").select("start", F.col("to").alias("at")).distinct()
        front = cut(nxt.join(seen, ["start", "at"], "left_anti"))
        seen = seen.unionByName(front)
    out = seen.join(e.withColumn("at", F.col("src")), "at").select("start", "src", "type", "dst").unionByName(seen.join(e.withColumn("at", F.col("dst")), "at").select("start", "src", "type", "dst")).distinct()
    if limit is not None:
        from weftspark.operators.ranks import top_per_group

        out = top_per_group(out, ["start"], [F.col("src"), F.col("type"), F.col("dst")], limit).drop("rank")
    return out


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends.distinct(), "id", "left_anti")


def label_counts(triples: DataFrame) -> DataFrame:
    return merge_nodes(triples).groupBy("label").agg(F.count("*").alias("nodes"))


def multi_fix(edges: DataFrame) -> DataFrame:
    """(violation, fixes, ids): violations with more than one distinct fix, and which."""
    g = edges.where("type = 'FIXES'").groupBy(F.col("dst").alias("violation")).agg(F.array_sort(F.collect_set("src")).alias("ids"))  # the fixes of one violation
    return g.where(F.size("ids") > 1).select("violation", F.size("ids").alias("fixes"), "ids")


def cross_version(edges: DataFrame) -> DataFrame:
    """(violation, pairs, which): violations whose fixes target several (fix, version) pairs, and which."""
    f, t = edges.where("type = 'FIXES'").select(F.col("src").alias("fix"), F.col("dst").alias("violation")), edges.where("type = 'TARGETS'").select(F.col("src").alias("fix"), F.col("dst").alias("version"))
    g = f.join(t, "fix").groupBy("violation").agg(F.array_sort(F.collect_set(F.struct("fix", "version"))).alias("which"))
    return g.where(F.size("which") > 1).select("violation", F.size("which").alias("pairs"), "which")


def violation_fixes(edges: DataFrame) -> DataFrame:
    """(violation, fix, document, own_documents): a row per fix of a violation and report that documents the fix (null without one), and how many reports document the violation itself."""
    f = edges.where("type = 'FIXES'").select(F.col("dst").alias("violation"), F.col("src").alias("fix")).distinct()
    d = edges.where("type = 'DOCUMENTED_IN'")
    by_fix = d.select(F.col("src").alias("fix"), F.col("dst").alias("document")).distinct()
    own = d.groupBy(F.col("src").alias("violation")).agg(F.countDistinct("dst").alias("own_documents"))
    return f.join(by_fix, "fix", "left").join(own, "violation", "left").select("violation", "fix", "document", F.coalesce("own_documents", F.lit(0)).alias("own_documents"))


def diagnosis(edges: DataFrame, optional: tuple[str, ...] = ("VERSION_OF", "RAN_ON")) -> DataFrame:
    """(violation, cause, version): tool runs that cause a violation, with the version each ran on, if known."""
    c = edges.where("type = 'CAUSES'").select(F.col("dst").alias("violation"), F.col("src").alias("cause"))
    v = edges.where(F.col("type").isin(*optional)).select(F.col("src").alias("cause"), F.col("dst").alias("version"))
    return c.join(v, "cause", "left").select("violation", "cause", "version").distinct()


def design_metrics(edges: DataFrame) -> DataFrame:
    """Per design: distinct metrics and violations; each side is aggregated before the join, so there is no product."""
    m = edges.where(F.col("type").isin("HAS_METRIC", "HAS_TIMING")).groupBy("src").agg(F.countDistinct("dst").alias("metrics"))
    v = edges.where("type = 'VIOLATES'").groupBy("src").agg(F.countDistinct("dst").alias("violations"))
    return m.join(v, "src", "full_outer").select(F.col("src").alias("design"), F.coalesce("metrics", F.lit(0)).alias("metrics"), F.coalesce("violations", F.lit(0)).alias("violations"))


def reachable_fixes(edges: DataFrame) -> DataFrame:
    """(violation, reached): distinct nodes within two undirected CAUSES or FIXES steps of each violation that is the target of such an edge."""
    e = edges.where("type in ('CAUSES', 'FIXES')").select("src", "dst").distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    violations = e.select(F.col("dst").alias("violation")).distinct()
    one = violations.join(both, F.col("violation") == both.src).select("violation", F.col("dst").alias("n"))
    # a second step over the same edge leads back to the violation
    two = one.join(both, one.n == both.src).select("violation", F.col("dst").alias("n")).where("violation != n")
    return one.unionByName(two).distinct().groupBy("violation").agg(F.count("*").alias("reached"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans and their share in percent."""
    n, e, o = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    return n.crossJoin(e).crossJoin(o).withColumn("orphan_pct", F.col("orphans") * 100.0 / F.greatest("nodes", F.lit(1)))


def merge_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges re-pointed from alias (alias, id) to canonical ids and made distinct; self-loops that arise are kept."""
    a = aliases.select(F.col("alias").alias("other"), F.col("id").alias("canon"))
    e = edges.join(a, F.col("src") == F.col("other"), "left").select(F.coalesce("canon", "src").alias("src"), "type", "dst")
    return e.join(a, F.col("dst") == F.col("other"), "left").select("src", "type", F.coalesce("canon", "dst").alias("dst")).distinct()


def depths(edges: DataFrame, cycles: str = "error") -> DataFrame:
    """(id, depth): the longest path from a source to each node. Each round takes away the nodes with no edges in from nodes that are left, and the round is their depth.

    Nodes left when none can be taken lie on or behind a cycle: they are refused, or with cycles='partial' get one more than the deepest node taken
    away that leads to them, else 0. A round reads the nodes that are left and the edges of those taken away; depths are put together at the end.
    """
    e = cut(edges.select("src", "dst").distinct())
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("left"))
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
    left = cut(nodes.join(into, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left")))
    done, at = None, 0
    while True:
        front = cut(left.where("left = 0").select("id", F.lit(at).alias("depth")))
        if not front.limit(1).count():
            break
        done = front if done is None else done.unionByName(front)
        gone = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("gone"))
        left = cut(left.where("left > 0").join(gone, "id", "left").select("id", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")))
        at += 1
    if left.limit(1).count():
        if cycles != "partial":
            raise ValueError("the graph has a cycle; its nodes have no depth")
        if done is None:
            return left.select("id", F.lit(0).alias("depth"))
        led = done.join(e, done.id == e.src).groupBy(F.col("dst").alias("id")).agg((F.max("depth") + 1).alias("depth"))
        done = done.unionByName(left.join(led, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth")))
    return done if done is not None else left.select("id", F.lit(0).alias("depth"))


def fan(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out)."""
    i, o = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return i.join(o, "id", "full_outer").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
