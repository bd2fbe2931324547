"""Content-type-aware chunkers as folds over arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.corpus import estimate_tokens, routed_type
from weftspark.util import spread

# fixed values: where code of a language is cut
CODE_HEADS = {
    "verilog": ([".v", ".sv", ".vh", ".svh"], r"(?=\b(?:module|package|interface|class)\b)"),
    "tcl": ([".tcl", ".sdc"], r"(?=\bproc\b|\n#{3,})"),
    "layout": ([".lef", ".def"], r"(?=\b(?:MACRO|PIN|LAYER|SITE|VIA)\b)"),
}
LOG_HEADS = r"(?=\[(?:INFO|WARNING|ERROR|WARN|DEBUG)\]|\n-{3,}|\n={3,}|\n\d{4}-\d{2}-\d{2})"
SENTENCE_ENDS = r"(?<=[.!?])\s+(?=[A-Z])"


def _fold(budget: int, overlap: int) -> tuple:
    """A fold over unit numbers, with token counts in _t, to runs (first, last), 0-based: greedy, closed when the next unit exceeds the budget.

    The next run begins with the last units of at most `overlap` tokens, and its count begins with those and the unit
    that broke the overlap, as the original counts them; so runs after the first are filled less.
    """
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("st"), F.lit(0).alias("ct"))

    def step(acc: Column, i: Column) -> Column:
        t = F.get(F.col("_t"), i)
        full = (acc["ct"] + t > budget) & (i > acc["st"])
        back0 = F.struct(F.lit(0).alias("o"), i.alias("s"), F.lit(False).alias("stop"))

        def back(x: Column, k: Column) -> Column:
            o = x["o"] + F.get(F.col("_t"), k)
            over = o > overlap
            return F.when(x["stop"], x).otherwise(F.struct(o.alias("o"), F.when(over, x["s"]).otherwise(k).alias("s"), over.alias("stop")))

        kept = F.aggregate(F.reverse(F.sequence(acc["st"], F.greatest(i - 1, acc["st"]))), back0, back)
        closed = F.concat(acc["done"], F.array(F.struct(acc["st"].alias("a"), (i - 1).alias("b"))))
        new = F.struct(closed.alias("done"), kept["s"].alias("st"), (kept["o"] + t).alias("ct"))
        return F.when(full, new).otherwise(F.struct(acc["done"].alias("done"), acc["st"].alias("st"), (acc["ct"] + t).alias("ct")))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["st"].alias("a"), (F.size("_t") - 1).alias("b"))))

    return start, step, finish


def _runs(df: DataFrame, units: str, budget: int, overlap: int) -> DataFrame:
    start, step, finish = _fold(budget, overlap)
    return df.withColumn("_t", F.transform(units, estimate_tokens)).withColumn("_runs", F.aggregate(F.sequence(F.lit(0), F.size("_t") - 1), start, step, finish)).drop("_t")


def _slice(units: str, run: Column) -> Column:
    return F.slice(F.col(units), run["a"] + 1, run["b"] - run["a"] + 1)


def chunk_documentation(docs: DataFrame, id_col: str, text: str = "text", budget: int = 384, overlap: int = 96) -> DataFrame:
    """(id, chunk_index, token_count, text): sentences packed greedily; texts of one sentence by lines. Null texts give none; chunks under 10 characters are dropped after numbering."""
    s = F.split(text, SENTENCE_ENDS)
    d = spread(docs.where(F.col(text).isNotNull()).select(id_col, text)).select(id_col, F.when(F.size(s) > 1, s).otherwise(F.split(text, "\n")).alias("_u"))
    d = _runs(d, "_u", budget, overlap)
    joined = lambda r: F.when(F.exists(_slice("_u", r), lambda x: F.contains(x, F.lit("\n"))), F.array_join(_slice("_u", r), "\n")).otherwise(F.array_join(_slice("_u", r), " "))
    return number(d.select(id_col, F.transform("_runs", joined).alias("c")), id_col)


def chunk_code(docs: DataFrame, id_col: str, ext: Column, text: str = "text", budget: int = 512, overlap: int = 64) -> DataFrame:
    """Code at module, proc or macro heads by extension; larger sections by lines with overlap."""
    parts = F.array("_t")
    for exts, head in CODE_HEADS.values():
        parts = F.when(F.lower("_e").isin(exts), F.split("_t", head)).otherwise(parts)
    d = spread(docs.where(F.col(text).isNotNull()).select(id_col, F.col(text).alias("_t"), ext.alias("_e"))).select(id_col, F.posexplode_outer(F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")).alias("_s", "_x"))
    d = d.withColumn("_u", F.when(estimate_tokens(F.col("_x")) <= budget, F.array("_x")).otherwise(F.split("_x", "\n")))
    d = _runs(d, "_u", budget, overlap).select(id_col, "_s", F.posexplode_outer(F.transform("_runs", lambda r: F.array_join(_slice("_u", r), "\n"))).alias("_k", "_c"))
    sections = d.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_s", "_k", "_c"))).alias("a"))  # a document's own sections
    return number(sections.select(id_col, F.transform("a", lambda x: x["_c"]).alias("c")), id_col)


def chunk_log(docs: DataFrame, id_col: str, text: str = "text", budget: int = 256) -> DataFrame:
    """Log sections merged up to the budget by the size of the joined text; results over 1.5 budgets by lines, without overlap."""
    d = spread(docs.where(F.col(text).isNotNull()).select(id_col, text)).select(id_col, F.filter(F.split(text, LOG_HEADS), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "").alias("_u"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def merge(acc: Column, x: Column) -> Column:
        both = F.concat(acc["cur"], x)
        full = (estimate_tokens(both) > budget) & (acc["cur"] != "")
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), x.alias("cur"))).otherwise(F.struct(acc["done"].alias("done"), both.alias("cur")))

    end = lambda acc: F.when(F.trim(F.regexp_replace(acc["cur"], r"\s", " ")) != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    d = d.withColumn("_m", F.aggregate("_u", start, merge, end)).select(id_col, F.posexplode_outer("_m").alias("_s", "_x"))
    d = d.withColumn("_u", F.when(estimate_tokens(F.col("_x")) > int(budget * 1.5), F.split("_x", "\n")).otherwise(F.array("_x")))
    # a fold with an overlap of 0 would still count the unit that broke it, so these lines have a fold of their own
    d = d.select(id_col, "_s", F.posexplode_outer(F.transform(_plain(F.col("_u"), budget), lambda r: F.array_join(_slice("_u", r), "\n"))).alias("_k", "_c"))
    sections = d.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_s", "_k", "_c"))).alias("a"))
    return number(sections.select(id_col, F.transform("a", lambda x: x["_c"]).alias("c")), id_col)


def _plain(units: Column, budget: int) -> Column:
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("st"), F.lit(0).alias("i"), F.lit(0).alias("ct"))

    def step(acc: Column, x: Column) -> Column:
        t = estimate_tokens(x)
        full = (acc["ct"] + t > budget) & (acc["i"] > acc["st"])
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["st"].alias("a"), (acc["i"] - 1).alias("b"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, acc["i"]).otherwise(acc["st"]).alias("st"), (acc["i"] + 1).alias("i"), F.when(full, t).otherwise(acc["ct"] + t).alias("ct"))

    return F.aggregate(units, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["st"].alias("a"), (acc["i"] - 1).alias("b")))))


def number(chunked: DataFrame, id_col: str) -> DataFrame:
    """chunk_index is the position before short chunks are dropped. Outer explosions keep Spark from inferring a filter on the array's size, which would compute it twice."""
    c = chunked.select(id_col, F.posexplode_outer("c").alias("chunk_index", "text"))
    return c.where(F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) >= 10).select(id_col, "chunk_index", estimate_tokens(F.col("text")).alias("token_count"), "text")


def chunk_forum(qa: DataFrame, id_col: str, title: str, body: str, answer: str, budget: int = 512) -> DataFrame:
    """Q: title, body and A: answer, all of them whole (the original cuts body and answer off), one chunk if it fits, else packed by sentences."""
    t = F.concat_ws("\n\n", F.concat(F.lit("Q: "), F.coalesce(title, F.lit(""))), F.nullif(F.coalesce(body, F.lit("")), F.lit("")), F.concat(F.lit("A: "), F.coalesce(answer, F.lit(""))))
    d = qa.select(id_col, t.alias("text"))
    small = d.where(estimate_tokens(F.col("text")) <= budget).select(id_col, F.lit(0).alias("chunk_index"), estimate_tokens(F.col("text")).alias("token_count"), "text")
    return small.unionByName(chunk_documentation(d.where(estimate_tokens(F.col("text")) > budget), id_col))


def chunk_report(docs: DataFrame, id_col: str, text: str = "text", budget: int = 512) -> DataFrame:
    """Flat JSON reports: one chunk per group of keys, by what stands before their first __, in the order of the groups' first keys, printed as JSON. Texts that are no JSON object are packed by lines, whole."""
    m = F.from_json(text, "map<string,string>")
    d = docs.where(F.col(text).isNotNull()).select(id_col, F.col(text).alias("_t"), F.when(F.ltrim(F.col(text)).startswith("{"), m).alias("_m"))
    keys = F.map_keys("_m")
    head = lambda k: F.get(F.split(k, "__"), 0)
    shown = lambda v: F.when(v.isNull(), "null").when(v.try_cast("double").isNotNull() | v.isin("true", "false"), v).otherwise(F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6))
    line = lambda k: F.concat(F.lit('  "'), k, F.lit('": '), shown(F.try_element_at("_m", k)))
    group = lambda g: F.concat(F.lit("{\n"), F.array_join(F.transform(F.filter(keys, lambda k: head(k) == g), line), ",\n"), F.lit("\n}"))
    grouped = F.transform(F.array_distinct(F.transform(keys, head)), group)
    # equal keys of a report would be an error of the map: such texts count as no JSON
    good = d.where("_m is not null").select(id_col, grouped.alias("c"))
    rest = d.where("_m is null").withColumn("_u", F.split("_t", "\n"))
    packed = rest.select(id_col, "_u", _plain(F.col("_u"), budget).alias("_r")).select(id_col, F.transform("_r", lambda r: F.array_join(_slice("_u", r), "\n")).alias("c"))
    return number(good.unionByName(packed), id_col)


def chunk_files(files: DataFrame, id_col: str = "id", path: str = "path", text: str = "text", recorded: str | None = None, least: int = 20) -> DataFrame:
    """(id, content_type, source_id, chunk_index, token_count, text): every file by the chunker of its content type; texts under `least` characters without the blanks around them give none."""
    kind = routed_type(F.col(path), F.col(recorded) if recorded else F.lit(None).cast("string"))
    f = files.where(F.length(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))) >= least).select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"), F.coalesce(kind, F.lit("other")).alias("kind"))
    of = lambda *kinds: f.where(F.col("kind").isin(*kinds))
    rest = ("code", "source_code", "log", "data", "orfs_report")
    parts = [chunk_code(of("code", "source_code"), "id", F.regexp_extract("path", r"(\.[^./]+)$", 1)), chunk_log(of("log", "data"), "id"), chunk_report(of("orfs_report"), "id"), chunk_documentation(f.where(~F.col("kind").isin(*rest)), "id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    about = f.select("id", F.col("kind").alias("content_type"), F.substring(F.md5("path"), 1, 12).alias("source_id")).dropDuplicates(["id"])
    return out.join(about, "id").select("id", "content_type", "source_id", "chunk_index", "token_count", "text")


def chunk_corpus(files: DataFrame, qa: DataFrame, path: str, text: str, recorded: str, qa_id: str, title: str, body: str, answer: str) -> DataFrame:
    """Chunks of all files and of all forum pairs in one table; ids begin with what they are of."""
    f = files.where(F.col(text).isNotNull()).select(F.concat(F.lit("file "), F.md5(F.concat_ws("|", path, text))).alias("id"), path, text, recorded).dropDuplicates(["id"])
    a = chunk_files(f, "id", path, text, recorded)
    q = chunk_forum(qa.select(F.concat(F.lit("qa "), F.col(qa_id).cast("string")).alias("id"), title, body, answer), "id", title, body, answer)
    return a.unionByName(q.select("id", F.lit("forum_qa").alias("content_type"), F.substring(F.md5("id"), 1, 12).alias("source_id"), "chunk_index", "token_count", "text"))


def chunk_gate(chunks: DataFrame, limit: int = 512, most_pct: float = 15.0, required: tuple[str, ...] = ("chunk_id", "source_file", "text")) -> DataFrame:
    """One row: chunks, share over the limit in percent, rows that lack a required field, and whether both gates are passed."""
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    a = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") > limit).alias("over"), F.count_if(lacks).alias("incomplete"))
    pct = 100.0 * F.col("over") / F.greatest("chunks", F.lit(1))
    return a.select("chunks", "over", "incomplete", pct.alias("over_pct"), ((pct < most_pct) & (F.col("incomplete") == 0)).alias("passed"))


def chunk_summary(chunks: DataFrame, limit: int = 512) -> DataFrame:
    """Per content type: chunks, tokens, chunks over the limit."""
    return chunks.groupBy("content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("token_count") > limit).alias("oversized"))


def chunk_id(*parts: str) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *(F.col(p).cast("string") for p in parts))), 1, 16)
