"""Sources: file scans, JSON lines, CSV, YAML; each a plain Spark read with its filters at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: suffixes of corpus files
SUFFIXES = ".v .sv .vh .svh .tcl .sdc .lib .lef .def .md .rst .txt .html .py .cpp .cc .c .h .hpp .sh .json .csv .yaml .yml .log .rpt .mk .vhd .vhdl .cfg .xml".split()


def files(spark: SparkSession, root: str, suffixes: list[str] | None = SUFFIXES, least: int = 100, most: int | None = None, least_text: int = 0, first: int | None = None) -> DataFrame:
    """(path, ext, size, text) of files under root, outside .git, by suffix and size; both are filtered on the listing, before contents are read.

    most: the largest size in bytes, by default none is too large. least_text: characters without the blanks around them. first: so many files in the order of their paths.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    f = f.where((F.col("length") >= least) & ~F.contains("path", F.lit("/.git/")))
    if suffixes is not None:
        f = f.where(ext.isin(suffixes))
    if most is not None:
        f = f.where(F.col("length") <= most)
    if first is not None:
        f = f.join(f.select("path").orderBy("path").limit(first), "path", "left_semi")
    f = f.select("path", ext.alias("ext"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return f.where(F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) >= least_text) if least_text else f


def first_existing(rows: DataFrame, candidates: list, listing: DataFrame, name: str = "found") -> DataFrame:
    """rows with the first of the candidate paths (columns) that is in the listing (path); null where none is."""
    there = listing.select("path").distinct()
    keys = []
    for i, c in enumerate(candidates):
        rows = rows.join(there.withColumnRenamed("path", f"_c{i}"), c == F.col(f"_c{i}"), "left")
        keys.append(F.col(f"_c{i}"))
    return rows.withColumn(name, F.coalesce(*keys)).drop(*(f"_c{i}" for i in range(len(candidates))))


def metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, metrics) of flat JSON reports, each a whole file; null metrics where a file is none."""
    t = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return t.select(F.input_file_name().alias("path"), F.from_json("value", "map<string,double>").alias("metrics"))


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones fail (strict) or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def yaml_items(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A YAML list of mappings, or one mapping with an id, as a small table. Needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or []
    rows = got if isinstance(got, list) else [got] if "id" in got else []
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(r.get(n) for n in s.names) for r in rows], s)


def issue_pairs(issues: DataFrame, labels: tuple[str, ...] = ("bug", "error", "crash", "regression"), most_body: int | None = None, most_answer: int | None = None, comments: int | None = None) -> DataFrame:
    """Question and answer of closed issues: body of 50 characters or more, answer of the comments over 20 characters. Bodies and answers are whole and all comments are taken, unless limits are given."""
    good = F.filter(F.transform("comments", lambda c: c["body"]), lambda b: F.length(b) > 20)
    d = issues.withColumn("_c", good).where((F.length(F.trim(F.coalesce("body", F.lit("")))) > 0) & (F.length("body") >= 50) & (F.size("_c") > 0))
    upto = lambda c, n: c if n is None else F.substring(c, 1, n)
    answer = F.array_join("_c" if comments is None else F.slice("_c", 1, comments), "\n---\n")
    return d.select("number", "title", upto(F.col("body"), most_body).alias("question_body"), upto(answer, most_answer).alias("answer"), F.filter(F.transform("labels", lambda x: x["name"]), lambda n: F.lower(n).isin(*labels)).alias("error_tags"), F.size("comments").alias("comment_count"))
