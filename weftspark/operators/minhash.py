"""MinHash signatures, banded candidates and verified near duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.corpus import shingles, words
from weftspark.util import cut, maybe_broadcast, spread

PERMUTATIONS = 128
_PRIME = np.uint64((1 << 31) - 1)


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, int(_PRIME), size=n, dtype=np.uint64), rng.integers(0, int(_PRIME), size=n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int = PERMUTATIONS, seed: int = 1) -> np.ndarray:
    """The least of (a x + b) mod p over a set of 64-bit hashes, for n pairs (a, b); in blocks, so memory doesn't grow with the set."""
    a, b = _coefficients(n, seed)
    x = (hashes.astype(np.uint64) ^ (hashes.astype(np.uint64) >> np.uint64(32))) & np.uint64(0x7FFFFFFF)
    least = np.full(n, _PRIME, dtype=np.uint64)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096, None] * a + b) % _PRIME).min(axis=0))
    return least


def bands(threshold: float, n: int = PERMUTATIONS, recall: float = 0.99) -> tuple[int, int]:
    """(bands, rows per band): the longest rows with which sets of the threshold's similarity still meet with this chance. What is more alike meets more surely; what is less alike is sorted out by the exact check."""
    for r in range(n, 0, -1):
        if 1 - (1 - threshold**r) ** (n // r) >= recall:
            return n // r, r
    return n, 1


def signatures(sets: DataFrame, id_col: str, hashes: str, n: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """(id, sig): signatures of arrays of 64-bit hashes. Empty sets have none: they would all be alike."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: signature(np.asarray(x, dtype=np.int64).view(np.uint64), n, seed).astype(np.int64))

    return sets.where(F.size(hashes) > 0).select(id_col, run(hashes).alias("sig"))


def candidates(sigs: DataFrame, id_col: str, threshold: float, n: int = PERMUTATIONS) -> DataFrame:
    """(id, band, key): the buckets that a signature falls in. Two sets of the threshold's similarity meet in one with a chance that bands() fits to it."""
    b, r = bands(threshold, n)
    keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", i * r + 1, r)).alias("key")))
    return sigs.select(id_col, F.explode(keys).alias("k")).select(id_col, "k.band", "k.key")


def estimate(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def shingle_hashes(docs: DataFrame, id_col: str, text: str, n: int = 5, least_one: bool = False) -> DataFrame:
    """(id, w, s): distinct 64-bit hashes of word runs, sorted."""
    w = spread(docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("_t"))).select("id", words(F.col("_t")).alias("w"))
    return w.select("id", F.array_sort(F.transform(shingles(F.col("w"), n, least_one), lambda x: F.xxhash64(x))).alias("s"))


def near_duplicates(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, near): the smallest id that each document's text is similar to, if it isn't its own: a star, not a closure.

    Copies of a shingle set are represented by their smallest id. Representatives that meet in a bucket are candidates; all
    are verified on their shingles, so false candidates cost time only. Pairs are of different sets only, each once; a bucket of many is
    split by the skew join.
    """
    s = cut(shingle_hashes(docs, id_col, text)).where(F.size("s") > 0).withColumn("key", F.md5(F.array_join("s", ",")))
    reps = s.groupBy("key").agg(F.min("id").alias("rep"))
    one = cut(s.join(reps, "key").where("id = rep").select("id", "s"))
    b = cut(candidates(signatures(one, "id", "s"), "id", threshold))
    busy = b.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    b = b.join(busy, ["band", "key"])
    pairs = b.select("band", "key", F.col("id").alias("a")).join(b.select("band", "key", F.col("id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    v = pairs.join(one.toDF("a", "sa"), "a").join(one.toDF("b", "sb"), "b").withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    near = v.where(F.col("inter") >= threshold * (F.size("sa") + F.size("sb") - F.col("inter")) - 1e-9).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("near"))
    m = s.select("id", "key").join(reps, "key").join(near, "rep", "left").select("id", F.least("rep", F.coalesce("near", "rep")).alias("near"))
    return m.where("near != id")


def contamination(corpus: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, threshold: float = 0.7) -> DataFrame:
    """(id, item_id, jaccard): for each corpus row that meets an item in a bucket, the item of highest verified Jaccard similarity, if at least the threshold. Ties go to the smaller item id."""
    c, i = shingle_hashes(corpus, id_col, text, 5, True), shingle_hashes(items, item_id, item_text, 5, True)
    i = cut(i)
    bi = maybe_broadcast(cut(candidates(signatures(i, "id", "s"), "id", threshold).withColumnRenamed("id", "item_id")))
    c = cut(c)
    bc = candidates(signatures(c, "id", "s"), "id", threshold)
    pairs = bc.join(bi, ["band", "key"]).select("id", "item_id").distinct()
    v = pairs.join(c, "id").join(maybe_broadcast(i.toDF("item_id", "si")), "item_id").withColumn("inter", F.size(F.array_intersect("s", "si")))
    v = v.withColumn("j", F.col("inter") / (F.size("s") + F.size("si") - F.col("inter"))).where(F.col("j") >= threshold - 1e-12)
    best = v.groupBy("id").agg(F.min(F.struct((-F.col("j")).alias("x"), "item_id")).alias("b"))
    return best.select(F.col("id").alias(id_col), "b.item_id", F.round(-F.col("b.x"), 4).alias("jaccard"))
