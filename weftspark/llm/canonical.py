"""Free-entered values mapped to the entries of a reference list.

Values are deduplicated, normalised, looked up in an inverted index of character n-grams, scored by
a weighted cosine and accepted above a threshold and a margin. The numbers of a name are part of the
index key: a candidate with other numbers is never retrieved.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.util import cut, maybe_broadcast

UNMATCHED = "UNMATCHED"
THRESHOLD, MARGIN = 0.4, 0.04
#: A candidate has this cosine at least, and after it at most so many edits.
CANDIDATE, MAX_EDITS = 0.12, 3

# fixed values: letters of other scripts that look like Latin ones
_LOOKALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ɡ": "g", "ѵ": "v", "ԛ": "q", "ԝ": "w",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x", "У": "y", "І": "i", "Ѕ": "s", "Ј": "j",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Χ": "x", "Ζ": "z", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
})
# fixed values: digits typed for letters
_LEET = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"})
# fixed values: words around a name that don't belong to it
_DECORATION = {
    "design": set("the a block blocks core top syn wrapper dut design designs rtl inst instance module macro ip unit chip netlist cell lib src hdl".split()),
    "tool_version": set("the release rel version ver v tool stable final".split()),
}
_BUILD = re.compile(r"(?:\+build[.\d]*|[-_+ ]build[-_. ]?\d+|-\d*-?g[0-9a-f]{6,40}|[-+ ]r\d{5,}|\+[0-9a-f]{7,40})$", re.I)
_INVISIBLE = re.compile(r"[​-‏‪-‮⁠-⁤﻿­]")


def normalise(value: str, kind: str) -> tuple[list[str], str]:
    """A name's letters without what stands around them, in the order written and turned round, and its numbers in order, joined by dots."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", value)).translate(_LOOKALIKES)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = t.strip().strip("\"'`()[]{}<>").strip().casefold()
    t = _BUILD.sub("", t)
    if kind == "design":
        t = re.sub(r"\.[a-z]{1,4}$", "", t).replace("\\", "/").rstrip("/").split("/")[-1].split(":")[-1]
    words, numbers = [], []
    for k in re.split(r"[^a-z0-9]+", t):
        if not k or k in _DECORATION.get(kind, ()):
            continue
        if sum(c.isalpha() for c in k) >= 4:  # one digit before a letter of a longer word is a mistyped letter
            k = re.sub(r"(?<!\d)\d(?=[a-z])", lambda m: m[0].translate(_LEET), k)
        k = re.sub(r"^v(?=\d)", "", k)
        words.append("".join(re.findall(r"[a-z]+", k)))
        numbers += re.findall(r"\d+", k)
    words = [w for w in words if w]
    forms = ["".join(words)]
    if len(words) == 2:
        forms.append(words[1] + words[0])
    return forms, ".".join(numbers)


def grams(letters: str) -> list[str]:
    """Character pairs and triples with the word's ends marked, and pairs with one letter between, which survive transpositions."""
    s = f"^{letters}$"
    return list(dict.fromkeys([s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)] + [f"{s[i]}*{s[i + 2]}" for i in range(len(s) - 2)]))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


_NORMAL = T.StructType([T.StructField("forms", T.ArrayType(T.StringType())), T.StructField("numbers", T.StringType())])


@F.pandas_udf(_NORMAL)
def _normal(value: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normalise(v, k) for v, k in zip(value, kind, strict=True)], columns=["forms", "numbers"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(letters: pd.Series) -> pd.Series:
    return letters.map(grams)


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def map_values(values: DataFrame, entities: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(kind, value, entity_id, score, lead) for every distinct (kind, value); entity_id is UNMATCHED where none is accepted.

    values has kind and value; nulls and blanks are left out. entities has entity_id, kind, canonical_name, aliases; null
    aliases count as none. The score is the mean of the weighted cosine of the n-grams and the share of letters that an
    exact comparison leaves as they are; more than MAX_EDITS edits (none in names of under six letters) rule an entity
    out. A value that equals a canonical name to the letter is that entity with score 1. An empty reference list leaves all
    values UNMATCHED; so do two entities that lie within the margin.
    """
    # not deterministic to Spark: else filters on the arrays' sizes are inferred and they are computed twice
    normal, gram = _normal.asNondeterministic(), _grams.asNondeterministic()
    distinct = values.where("value is not null and kind is not null and trim(value) != ''").select("kind", "value").distinct()
    distinct = cut(distinct)
    names = entities.select(F.col("entity_id"), "kind", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null and kind is not null")
    names = names.select("entity_id", "kind", normal("name", "kind").alias("n")).select("entity_id", "kind", F.col("n.forms")[0].alias("name"), "n.numbers").distinct()
    names = cut(names)
    total = names.groupBy("kind").agg(F.count("*").alias("names"))
    postings = names.withColumn("gram", F.explode(gram("name")))
    weights = postings.groupBy("kind", "gram").agg(F.count("*").alias("df")).join(total, "kind").select("kind", "gram", F.log1p(F.col("names") / F.col("df")).alias("w"))
    weights = cut(weights)
    postings = postings.join(weights, ["kind", "gram"])
    norms = postings.groupBy("entity_id", "kind", "name", "numbers").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("name_norm"))
    postings = maybe_broadcast(cut(postings.join(norms, ["entity_id", "kind", "name", "numbers"])))

    forms = distinct.select("kind", "value", normal("value", "kind").alias("n")).select("kind", "value", "n.numbers", F.explode("n.forms").alias("form")).distinct()
    seen = cut(forms.select("kind", "value", "numbers", "form", F.explode(gram("form")).alias("gram")))
    # grams that no name has weigh as rare ones
    rare = F.log1p(F.col("names")) * 0.7
    weighed = seen.join(maybe_broadcast(weights), ["kind", "gram"], "left").join(maybe_broadcast(total), "kind", "left").withColumn("w", F.coalesce("w", rare, F.lit(1.0)))
    value_norm = weighed.groupBy("kind", "value", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("value_norm"))
    p = postings.select("kind", "numbers", "gram", "entity_id", "name", "name_norm", F.col("w").alias("pw"))
    scored = seen.join(p, ["kind", "numbers", "gram"]).groupBy("kind", "value", "form", "entity_id", "name", "name_norm").agg(F.sum(F.col("pw") * F.col("pw")).alias("dot"))
    scored = scored.join(value_norm, ["kind", "value", "form"]).withColumn("cosine", F.col("dot") / (F.col("name_norm") * F.col("value_norm"))).where(F.col("cosine") >= CANDIDATE)
    # stored before names are compared: else the comparison, a filter on grouping keys, is pushed below the aggregate and made for
    # every n-gram in common. Rows are small, so AQE would leave them to one task; a stated number of partitions stays.
    scored = cut(scored.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "value"))
    # a swap is one edit here and two for the engine's distance, so none within MAX_EDITS is lost
    near = F.levenshtein("form", "name", 2 * MAX_EDITS) >= 0
    scored = scored.where(F.when(F.length("name") >= 6, near & (F.abs(F.length("form") - F.length("name")) <= MAX_EDITS)).otherwise(F.col("form") == F.col("name")))
    scored = scored.withColumn("edits", F.when(F.col("form") == F.col("name"), 0).otherwise(_edits("form", "name"))).where(F.col("edits") <= MAX_EDITS)
    scored = scored.withColumn("score", (F.col("cosine") + 1 - F.col("edits") / F.greatest(F.length("form"), F.length("name"))) / 2)
    best = scored.groupBy("kind", "value", "entity_id").agg(F.max("score").alias("score"))
    top = best.groupBy("kind", "value").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "entity_id")), asc=False), 1, 2).alias("t"))
    top = top.select("kind", "value", F.col("t")[0]["entity_id"].alias("best"), F.col("t")[0]["score"].alias("score"), (F.col("t")[0]["score"] - F.coalesce(F.try_element_at("t", F.lit(2))["score"], F.lit(0.0))).alias("lead"))
    exact = entities.select("kind", F.col("canonical_name").alias("value"), F.col("entity_id").alias("same")).dropDuplicates(["kind", "value"])
    out = distinct.join(top, ["kind", "value"], "left").join(exact, ["kind", "value"], "left")
    accepted = F.when((F.col("score") >= threshold) & (F.col("lead") >= margin), F.col("best"))
    return out.select("kind", "value", F.coalesce("same", accepted, F.lit(UNMATCHED)).alias("entity_id"), F.when(F.col("same").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.coalesce("lead", F.lit(0.0)).alias("lead"))


def fields(triples: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """(source_table, row_key, field, kind, value) of every freely entered field, read in one pass per table."""
    kind = F.create_map(F.lit("Design"), F.lit("design"), F.lit("Version"), F.lit("tool_version"))
    t = triples.where("subject_label in ('Design', 'Version') or object_label in ('Design', 'Version')")
    pairs = F.array(*(F.struct(F.lit(f"{x}_id").alias("field"), kind[F.col(f"{x}_label")].alias("kind"), F.col(f"{x}_id").alias("value")) for x in ("subject", "object")))
    out = [t.select(F.lit("triples").alias("source_table"), F.col("triple_id").cast("string").alias("row_key"), F.explode(pairs).alias("x"))]
    pairs = F.array(F.struct(F.lit("design_name").alias("field"), F.lit("design").alias("kind"), F.col("design_name").alias("value")), F.struct(F.lit("tool_version").alias("field"), F.lit("tool_version").alias("kind"), F.col("tool_version").alias("value")))
    for name, df in (("manifest", manifest), ("orfs_runs", runs)):
        out.append(df.select(F.lit(name).alias("source_table"), F.col("artifact_id").alias("row_key"), F.explode(pairs).alias("x")))
    got = out[0].unionByName(out[1]).unionByName(out[2]).select("source_table", "row_key", "x.*")
    return got.where("kind is not null and value is not null and trim(value) != ''")


def map_fields(triples: DataFrame, manifest: DataFrame, runs: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_table, row_key, field, entity_id) of each value that is not to the letter a canonical name of its kind.

    The mapping is of distinct values only; a value that a third of all rows share is mapped once and joined back,
    by broadcast while the mapping is small, else by a shuffle that AQE splits where it is skewed. The result's rows are
    distinct: a row delivered again with the same value gives one row, with other values one each.
    """
    rows = fields(triples, manifest, runs)
    mapping = maybe_broadcast(cut(map_values(rows, entities)))
    exact = entities.select("kind", F.col("canonical_name").alias("value")).distinct()
    free = rows.join(F.broadcast(exact) if entities.limit(10_001).count() <= 10_000 else exact, ["kind", "value"], "left_anti")
    return free.join(mapping.select("kind", "value", "entity_id"), ["kind", "value"]).select("source_table", "row_key", "field", "entity_id").distinct()
