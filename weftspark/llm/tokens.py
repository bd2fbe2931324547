"""Exact token counts under a public tokenizer, totalled over cubes."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.lang import ALIASES, detect
from weftspark.util import spread

#: Vocabulary file of the tokenizer: a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("WEFTSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# fixed value: how this tokenizer splits a text into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The tokenizer, loaded once per worker process."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # one call per text: the batch call hands texts to threads of its own and takes half as much time again
        return lambda texts: [enc.encode_ordinary(t) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: sp.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    return lambda texts: [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


#: A text of more characters is encoded in parts, cut at white space before a word: the encoder's memory stays bounded.
PART = 200_000
_CUT = re.compile(r"(?<=\S)(?=\s\S)")


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts whose token counts add up to the text's: cuts lie before a space that begins a word, where this pattern always ends a word."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = None
        for m in _CUT.finditer(text, at + size - 1000, at + size):  # noqa: B007
            pass
        end = m.start() if m else at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def lengths(texts: list[str], path: str) -> list[int]:
    encode = encoder(path)
    if max(map(len, texts), default=0) <= PART:
        return [len(x) for x in encode(texts)]
    return [sum(len(x) for x in encode(parts(t))) for t in texts]


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Token count of each text; null for null, 0 for empty."""

    @F.pandas_udf(T.IntegerType())
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            n = iter(lengths([t for t in s if t is not None], path))
            yield pd.Series([None if t is None else next(n) for t in s], dtype="Int32")

    return run(text)


_BOTH = T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("language", T.StringType())])


def count_and_detect(text: Column, path: str = TOKENIZER) -> Column:
    """(tokens, language) of each text, in one pass through Python."""

    @F.pandas_udf(_BOTH)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            texts = [t or "" for t in s]
            yield pd.DataFrame({"tokens": lengths(texts, path), "language": [detect(t) for t in texts]}).astype({"tokens": "int32"})

    return run(text)


def tagged_language(tag: Column) -> Column:
    """en for en-US, EN, eng ...; null for null and unknown tags."""
    t = F.lower(F.trim(tag))
    head = F.regexp_extract(t, r"^([^-_ ]*)", 1)
    known = F.lit(None).cast("string")
    for code, names in ALIASES.items():
        known = F.when(t.isin(names) | head.isin(names), code).otherwise(known)
    return known


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """One row per artifact_id, the last collected: (artifact_id, manifest_source_type, manifest_tokens). Partial aggregates; a third of all rows may be one artifact."""
    m = manifest.where("artifact_id is not null").groupBy("artifact_id")
    last = F.max(F.struct(F.coalesce("scrape_date", F.lit("0001-01-01").cast("date")).alias("d"), F.coalesce("token_count", F.lit(-1)).alias("n"), "source_type"))
    return m.agg(last.alias("x")).select("artifact_id", F.col("x.source_type").alias("manifest_source_type"), F.when(F.col("x.n") >= 0, F.col("x.n")).alias("manifest_tokens"))


def document_tokens(documents: DataFrame, manifest: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, language, source_type, content_type, topic, tokens, recorded) per document; identical rows count each.

    Language is the one the text shows, else the tag's, else und. source_type is the manifest's, else the document's own.
    recorded is the manifest's token_count, null where none is recorded. A null text has 0 tokens.
    """
    d = spread(documents.select("doc_id", "source", "lang", "artifact_id", "source_type", "content_type", "topic", "text")).select("doc_id", "source", "lang", "artifact_id", F.col("source_type").alias("own_source_type"), "content_type", "topic", count_and_detect(F.col("text"), path).alias("x"))
    d = d.join(latest_manifest(manifest), "artifact_id", "left")
    return d.select("doc_id", "source", F.coalesce("x.language", tagged_language(F.col("lang")), F.lit("und")).alias("language"), F.coalesce("manifest_source_type", "own_source_type").alias("source_type"), "content_type", "topic", F.col("x.tokens").alias("tokens"), F.col("manifest_tokens").alias("recorded"))


DIMENSIONS = ("source", "language", "source_type", "content_type", "topic")


def token_cube(documents: DataFrame, manifest: DataFrame, chunks: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Totals over the cube of source, language, source_type, content_type and topic, for documents and for chunks (content_type only).

    (corpus, the dimensions, level, items, tokens, recorded_items, recorded_tokens): level is grouping_id() of the
    dimensions (bit 16 for source down to 1 for topic: set where summed over); a null dimension with its bit unset is a missing value.
    Rows are first added up to the distinct combinations of dimensions, so the cube expands those and not the rows.
    A chunk delivered again (same chunk_id and text) counts once; the texts' hashes are shuffled for that, not the texts.
    """
    totals = [F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("recorded_items").alias("recorded_items"), F.sum("recorded_tokens").alias("recorded_tokens")]
    measure = [F.count("*").alias("items"), F.sum(F.col("tokens").cast("long")).alias("tokens"), F.count("recorded").alias("recorded_items"), F.coalesce(F.sum(F.col("recorded").cast("long")), F.lit(0)).alias("recorded_tokens")]
    d = document_tokens(documents, manifest, path).groupBy(*DIMENSIONS).agg(*measure)
    d = d.cube(*DIMENSIONS).agg(F.grouping_id().alias("level"), *totals).select(F.lit("documents").alias("corpus"), *DIMENSIONS, F.col("level").cast("int").alias("level"), "items", "tokens", "recorded_items", "recorded_tokens")
    # a chunk's deliveries differ in embedded_at alone: they agree in everything counted here
    c = spread(chunks.select("chunk_id", "content_type", "token_count", "text")).select("chunk_id", "content_type", F.col("token_count").alias("recorded"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), count_tokens(F.coalesce("text", F.lit("")), path).alias("tokens"))
    c = c.groupBy("chunk_id", "h").agg(F.max("content_type").alias("content_type"), F.max("recorded").alias("recorded"), F.max("tokens").alias("tokens"))
    c = c.groupBy("content_type").agg(*measure)
    none = F.lit(None).cast("string")
    c = c.cube("content_type").agg(F.grouping_id().alias("g"), *totals).select(F.lit("chunks").alias("corpus"), none.alias("source"), none.alias("language"), none.alias("source_type"), "content_type", none.alias("topic"), (F.lit(29) + 2 * F.col("g")).cast("int").alias("level"), "items", "tokens", "recorded_items", "recorded_tokens")
    return d.unionByName(c)
