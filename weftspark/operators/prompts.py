"""What goes to models and what comes back: prompts, batches, landed results. Models themselves are functions that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unfenced(raw: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[A-Za-z]*\s*\n?", ""), r"\n?\s*```$", ""))


def parsed(raw: Column, schema: str, required: list[str] | None = None) -> Column:
    """The reply as a struct of the schema; null where it is no JSON or lacks a required field."""
    x = F.from_json(unfenced(raw), schema)
    ok = x.isNotNull()
    for f in required or []:
        ok = ok & x[f].isNotNull()
    return F.when(ok, x)


def answer_of(raw: Column, field: str = "answer") -> Column:
    """The answer field of a JSON reply, else the reply as it came."""
    return F.coalesce(F.get_json_object(unfenced(raw), f"$.{field}"), raw)


def question_prompt(case: dict[str, Column]) -> Column:
    """Named parts of a case, each under its name; empty parts are left out."""
    return F.concat_ws("\n\n", *(F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{k}:\n"), v)) for k, v in case.items()))


def judge_prompt(question: Column, answer: Column, dims: list[str]) -> Column:
    rules = "Score from 0 to 1: " + ", ".join(dims) + ". The overall score is the least of them. Reply with JSON only."
    return F.concat(F.lit(rules + "\n\nQuestion:\n"), F.coalesce(question, F.lit("")), F.lit("\n\nAnswer:\n"), F.coalesce(answer, F.lit("")))


def with_facts(items: DataFrame, key: str, facts: DataFrame, fact: str) -> DataFrame:
    """Each item with one fact, dealt round robin: item number i, by key, gets fact i modulo their number. Facts are a stated list, small; without any they are null."""
    from weftspark.operators.ranks import hash_rank
    from weftspark.util import small_rows

    stated = sorted(r[0] for r in small_rows(facts.select(fact).where(F.col(fact).isNotNull()).distinct(), "facts"))
    r = hash_rank(items, [], [key], name="_i")
    return r.withColumn(fact, F.get(F.array(*map(F.lit, stated)), F.pmod(F.col("_i") - 1, F.lit(len(stated))).cast("int")) if stated else F.lit(None).cast("string")).drop("_i")


def batches(rows: DataFrame, ids: list[str], size: int = 128) -> DataFrame:
    """batch: 0, 1, ... of so many rows each, the last of what is left, in hash order."""
    from weftspark.operators.ranks import hash_rank

    return hash_rank(rows, [], ids, name="_i").withColumn("batch", F.floor((F.col("_i") - 1) / size)).drop("_i")


def requests(rows: DataFrame, custom_id: Column, prompt: Column, model: str, max_tokens: int = 1024) -> DataFrame:
    """(custom_id, body): the first phase of a batch job, one JSON line per request."""
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))
    return rows.select(custom_id.alias("custom_id"), body.alias("body"))


def results(sent: DataFrame, landed: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """(custom_id, status, reply): the second phase. landed: (custom_id, raw). status is ok, invalid where the reply doesn't parse, or missing; of several replies the first by text holds."""
    got = landed.groupBy("custom_id").agg(F.min("raw").alias("raw"))
    x = sent.select("custom_id").distinct().join(got, "custom_id", "left").withColumn("reply", parsed(F.col("raw"), schema, required))
    return x.select("custom_id", F.when(F.col("raw").isNull(), "missing").when(F.col("reply").isNull(), "invalid").otherwise("ok").alias("status"), "reply")


def ask(prompt: Column, model: Callable[[], Callable[[list[str]], list[str]]], fallback: str = "") -> Column:
    """(reply, failed) of a model that each worker loads once: model() gives a function from prompts to replies. A batch that fails gives the fallback and is marked."""

    @F.pandas_udf(T.StructType([T.StructField("reply", T.StringType()), T.StructField("failed", T.BooleanType())]))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = model()
        for s in it:
            try:
                yield pd.DataFrame({"reply": call(s.fillna("").tolist()), "failed": False})
            except Exception:  # noqa: BLE001
                yield pd.DataFrame({"reply": [fallback] * len(s), "failed": True})

    return run(prompt)


def synthesise(retrieved: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], most: int | None = None) -> DataFrame:
    """qid, answer, failed: a model's answer to each retrieved context (see retrieve), with a plain sentence where it fails. most cuts the context, by default nothing."""
    text = F.col("context") if most is None else F.substring("context", 1, most)
    return retrieved.select("qid", ask(text, model, "The answer could not be made.").alias("r")).select("qid", answer_of(F.col("r.reply")).alias("answer"), "r.failed")
