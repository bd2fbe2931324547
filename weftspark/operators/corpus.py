"""Corpus operators: classification, estimates, manifests, duplicates, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators import sets
from weftspark.util import cut, maybe_broadcast, spread

# fixed values: content types by file extension
EXTENSIONS = {
    "code": [".v", ".sv", ".vh", ".svh", ".tcl", ".sdc", ".lib", ".lef", ".def"],
    "log": [".log", ".rpt"],
    "documentation": [".md", ".rst", ".txt", ".html"],
    "source_code": [".py", ".cpp", ".cc", ".c", ".h", ".hpp", ".sh"],
    "data": [".json", ".csv", ".yaml", ".yml"],
}


def content_type(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    out = F.when(name == "6_report.json", "orfs_report")
    for kind, exts in EXTENSIONS.items():
        out = out.when(ext.isin(exts) | name.endswith("_report.txt") if kind == "log" else ext.isin(exts), kind)
    return F.when(path.isNotNull(), out.otherwise("other"))


def routed_type(path: Column, recorded: Column) -> Column:
    """The content type a file is chunked by: its path's, and the recorded one only where the path tells nothing."""
    by_path = content_type(path)
    return F.when(by_path.isNull() | (by_path == "other"), F.coalesce(recorded, by_path)).otherwise(by_path)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def source_manifest(files: DataFrame, source: str, text: str) -> DataFrame:
    """Per source: files, characters, and tokens as the sum of characters over 4, floored after the sum."""
    return files.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("file_count"), F.sum(F.length(text)).alias("chars"), F.floor(F.sum(F.length(text)) / 4).cast("long").alias("token_count_approx"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, is_duplicate): the smallest id of a text's copies is kept. Null texts are no copies of each other. Only ids and hashes are shuffled."""
    h = docs.select(F.col(id_col), F.sha2(text, 256).alias("h"))
    keep = h.where("h is not null").groupBy("h").agg(F.min(id_col).alias("k"), F.count("*").alias("n")).where("n > 1")
    j = h.join(keep, "h", "left")
    return j.select(id_col, F.coalesce("k", id_col).alias("keep_id"), (F.coalesce(F.col("k"), F.col(id_col)) != F.col(id_col)).alias("is_duplicate"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingles(w: Column, n: int = 5, least_one: bool = False) -> Column:
    """Distinct runs of n words of an array column (a column, not an expression: it is read at every position). Texts of fewer words have none, or, with least_one, themselves as the only one."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    short = F.array(F.array_join(w, " ")) if least_one else F.array().cast("array<string>")
    return F.when(F.size(w) >= n, F.array_distinct(many)).otherwise(F.when(F.size(w) > 0, short).otherwise(F.array().cast("array<string>")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Exact set-similarity join on word shingles: (classes, links).

    classes: (id, rep): rep is the smallest id of the documents with the same shingle set, which need no pair of their own.
    links: (a, b, inter, uni), a < b, of all pairs of representatives with Jaccard similarity at least the threshold.
    Prefix filter: shingles are ordered from the rarest on, as counts of hash buckets tell them, and two sets that similar share one of their first
    |s| - ceil(threshold * |s|) + 1. Only prefixes are stored and joined; sets are made once more for texts that stand in a pair which shares enough in its prefixes.
    """
    t = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("_t"))
    hashed = lambda d: sets.word_hashes(d.select("id", F.array_remove(F.split(F.lower("_t"), r"\s+"), "").alias("w")))
    h = hashed(spread(t))
    p = cut(sets.prefixes(h, n, threshold, sets.bucket_levels(h, n)))
    reps = p.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    classes = p.select("id", "k1", "k2", "n").join(reps, ["k1", "k2", "n"]).select("id", "rep")
    r = p.join(maybe_broadcast(classes.where("id != rep").select("id")), "id", "left_anti").select("id", "n", "last", F.explode("prefix").alias("g"))
    a, b = r.toDF("a", "na", "la", "g"), r.toDF("b", "nb", "lb", "g")
    both = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count("*").alias("c"))
    # what the text whose prefix ends first shares there is all in c, so they share at most c and its rest
    rest = lambda m: F.ceil(F.lit(threshold) * F.col(m) - 1e-9) - 1
    most = F.col("c") + F.when(F.col("la") < F.col("lb"), rest("na")).when(F.col("la") > F.col("lb"), rest("nb")).otherwise(F.greatest(rest("na"), rest("nb")))
    cand = cut(both.where((1 + threshold) * most >= threshold * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b", "na", "nb").distinct())
    ids = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    x = sets.whole(hashed(t.join(maybe_broadcast(ids), "id", "left_semi")), n)
    v = cand.join(x.toDF("a", "xa"), "a").join(x.toDF("b", "xb"), "b").withColumn("inter", F.size(F.array_intersect("xa", "xb")))
    links = v.select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni")).where(F.col("inter") >= threshold * F.col("uni") - 1e-9)
    return classes, links.distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, class_id): the smallest id reachable, of every node of a link. Label propagation with pointer jumping; only nodes whose label moved, and their neighbours, take part in a round.

    Rounds are cut in the shared folder; the driver sees only whether anything moved.
    """
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = cut(e.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("l")))
    while True:
        near = e.join(lab.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("l").alias("m"))
        step = lab.join(near, "id").select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        # a label is a node too: take over its label
        new = cut(step.join(lab.select(F.col("id").alias("l"), F.col("l").alias("ll")), "l", "left").select("id", "old", F.least("l", F.coalesce("ll", "l")).alias("l")))
        moved = new.where("l != old").limit(1).count()
        lab = new.select("id", "l")
        if not moved:
            return lab.withColumnRenamed("l", "class_id")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, links) per document: class of all documents linked by chains of similar texts, and the number of other representatives its text is similar to. Documents without shingles are classes of their own."""
    classes, links = near_duplicates(docs, threshold, id_col, text)
    links = cut(links)
    classes = cut(classes)
    comp = components(links)
    deg = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    m = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(deg, "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    every = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    return every.join(m, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def contamination(corpus: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, threshold: float = 0.7, containment: bool = False) -> DataFrame:
    """(id, item_id, inter, uni): for each corpus row, its item of highest Jaccard (or containment of the item) of word 5-grams, if at least the threshold. Ties go to the smaller item id. Rows without words match nothing.

    5-grams are 64-bit hashes. Only those that some item has leave a corpus row: rows are filtered against the items' hashes, broadcast while they
    are counted to be few, before anything is grouped.
    """
    hashed = lambda d, i, t: d.where(F.col(t).isNotNull()).select(F.col(i).alias("_i"), words(F.col(t)).alias("w")).select("_i", F.transform(shingles(F.col("w"), 5, True), lambda x: F.xxhash64(x)).alias("s"))
    it = cut(hashed(items, item_id, item_text).select(F.col("_i").alias("item_id"), F.size("s").alias("ni"), F.explode_outer("s").alias("g")))
    c = hashed(spread(corpus.select(id_col, text)), id_col, text).select(F.col("_i").alias("id"), F.size("s").alias("nc"), F.explode_outer("s").alias("g"))
    j = c.join(maybe_broadcast(it), "g").groupBy("id", "nc", "item_id", "ni").agg(F.count("*").alias("inter"))
    j = j.withColumn("uni", F.col("ni").cast("long") if containment else F.col("nc") + F.col("ni") - F.col("inter"))
    best = j.where(F.col("inter") >= threshold * F.col("uni") - 1e-9).groupBy("id").agg(F.min(F.struct((-F.col("inter") / F.col("uni")).alias("r"), "item_id", "inter", F.col("uni").cast("long").alias("uni"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "b.item_id", "b.inter", "b.uni")


def content_id(text: Column) -> Column:
    """The first 16 hex digits of a text's sha256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def tree_checksums(files: DataFrame, source: str, path: str, text: str) -> DataFrame:
    """(source, files, checksum): one checksum per source over its files in the order of their paths, by folder: a folder's is that of its files' hashes, a source's that of its folders'. Copies of a path count once, by their smallest hash."""
    f = files.where(F.col(path).isNotNull()).groupBy(F.col(source).alias("source"), F.col(path).alias("path")).agg(F.min(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("h"))
    ordered = lambda key: F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"])), 256)
    folders = f.groupBy("source", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), ordered("path").alias("h"))
    return folders.groupBy("source").agg(F.sum("files").alias("files"), F.substring(ordered("folder"), 1, 16).alias("checksum"))


def by_extension(files: DataFrame, path: str) -> DataFrame:
    """(ext, files, first, last): how many files of each extension there are, and the first and last path. Files themselves are looked up by a partition or filter on the extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return files.where(F.col(path).isNotNull()).select(path).distinct().groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.min(path).alias("first"), F.max(path).alias("last"))


def surviving(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that aren't copies of an earlier one."""
    gone = exact_duplicates(docs, id_col, text).where("is_duplicate").select(id_col)
    return docs.join(gone, id_col, "left_anti")


def duplicate_accounts(every: DataFrame, exact: DataFrame, near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: rows, exact copies, near copies that are no exact ones, all removed, kept, and the share removed in percent. exact and near are tables of ids."""
    e, n = exact.select(id_col).distinct(), near.select(id_col).distinct()
    c = lambda d, name: d.agg(F.count("*").alias(name))
    a = c(every.select(id_col).distinct(), "docs").crossJoin(c(e, "exact")).crossJoin(c(n.join(e, id_col, "left_anti"), "near_only")).crossJoin(c(e.unionByName(n).distinct(), "removed"))
    return a.select("*", (F.col("docs") - F.col("removed")).alias("kept"), (100.0 * F.col("removed") / F.greatest("docs", F.lit(1))).alias("removed_pct"))


def union_manifests(a: DataFrame, b: DataFrame, blanks: bool = True) -> DataFrame:
    """b's rows in a's schema: absent columns are null, others dropped, values as text; None and nan become blank."""
    text = lambda d: d.select(*(F.col(c).cast("string") for c in d.columns))
    u = text(a).unionByName(text(b), allowMissingColumns=True).select(*a.columns)
    if blanks:
        u = u.select(*(F.when(F.col(c).isNull() | F.lower(c).isin("none", "nan"), "").otherwise(F.col(c)).alias(c) for c in u.columns))
    return u


def update_manifest(manifest: DataFrame, removed: DataFrame, source: str = "source") -> DataFrame:
    """dedup_removed and dedup_status per manifest row; sources without removed rows get 0."""
    n = removed.groupBy(source).agg(F.count("*").alias("dedup_removed"))
    return manifest.join(n, source, "left").withColumn("dedup_removed", F.coalesce("dedup_removed", F.lit(0)).cast("long")).withColumn("dedup_status", F.lit("complete"))


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in done yet; the resume filter of every incremental step."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
