"""Sets of word runs as 64-bit hashes, by NumPy over Arrow batches: counts of hash buckets, keys of whole sets, prefixes of a similarity join, the sets themselves."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the counts that order shingles, and how many of them pass in one row.
BUCKETS, PART = 1 << 22, 1 << 16


def _mix(x: np.ndarray, by: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random."""
    x = x + np.uint64(by)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(g, sizes): the distinct runs of n words of every row, sorted within the row, and how many there are per row. Runs are hashed with the place of each word."""
    lens = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    w = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    many = np.maximum(lens - n + 1, 0)
    if not many.sum():
        return np.zeros(0, np.uint64), np.zeros(len(lens), np.int64)
    g = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        g += _mix(w[i : len(w) - n + 1 + i], i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    row = np.repeat(np.arange(len(lens)), lens)
    g, row = _mix(g[row[: len(g)] == row[n - 1 :]]), np.repeat(np.arange(len(lens)), many)
    _sort_rows(g, many)
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[first], np.bincount(row[first], minlength=len(lens))


def _sort_rows(x: np.ndarray, sizes: np.ndarray) -> None:
    """Sorts x in place within consecutive ranges of these sizes."""
    end = np.cumsum(sizes)
    for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True):
        if b - a > 1:
            x[a:b].sort()


def _lists(x: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(x.view(np.int64)))


def bucket_levels(hashed: DataFrame, n: int) -> np.ndarray:
    """For each bucket of hashes how often its runs occur in all rows of (id, w): a level below 128, four to each doubling. One packed row of counts per task and part is shuffled, the driver gets a byte per bucket."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for b in batches:
            g, _ = _runs(b.column("w"), n)
            total += np.bincount((g >> np.uint64(8)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32)
        for i in range(0, BUCKETS, PART):
            if (x := total[i : i + PART]).any():
                small = x.astype(np.min_scalar_type(x.max()))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([small.itemsize]), pa.array([zlib.compress(small.tobytes(), 1)])], ["part", "width", "counts"])

    def levels(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), f"u{w}").astype(np.int64) for x, w in zip(parts["counts"], parts["width"], strict=True))
        return pd.DataFrame({"part": parts["part"].iloc[:1], "levels": [np.minimum(4 * np.log2(1 + total), 127).astype(np.uint8).tobytes()]})

    out = np.zeros(BUCKETS, np.uint8)
    for r in hashed.mapInArrow(counts, "part long, width long, counts binary").groupBy("part").applyInPandas(levels, "part long, levels binary").collect():
        out[r["part"] : r["part"] + PART] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


def prefixes(hashed: DataFrame, n: int, threshold: float, levels: np.ndarray) -> DataFrame:
    """(id, n, k1, k2, last, prefix) of the rows of (id, w) that have runs: how many distinct ones, two keys of the whole set, and its first ones in the order of (level, hash), one of which any two sets as similar as the threshold share. last is the upper half of the prefix's last one.

    The order is the same in all rows, so whatever the levels are no pair is lost; good levels only make the pairs few.
    """
    sent = hashed.sparkSession.sparkContext.broadcast(levels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for b in batches:
            g, sizes = _runs(b.column("w"), n)
            some = sizes > 0
            ids, sizes = b.column("id").filter(pa.array(some)), sizes[some]
            if not len(sizes):
                continue
            start = np.cumsum(sizes) - sizes
            k1, k2 = (np.add.reduceat(_mix(g, by), start) for by in (1, 0xD1B54A32D192ED03))
            t = level[(g >> np.uint64(8)).astype(np.int64) & (BUCKETS - 1)].astype(np.uint64) << np.uint64(56) | g >> np.uint64(8)
            _sort_rows(t, sizes)
            take = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            head = np.arange(len(t)) - np.repeat(start, sizes) < np.repeat(take, sizes)
            last = (t[start + take - 1] >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(last), _lists(t[head], take)], ["id", "n", "k1", "k2", "last", "prefix"])

    return hashed.mapInArrow(of, "id long, n int, k1 long, k2 long, last int, prefix array<long>")


def whole(hashed: DataFrame, n: int) -> DataFrame:
    """(id, x): the distinct runs of each row of (id, w)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(*_runs(b.column("w"), n))], ["id", "x"])

    return hashed.mapInArrow(of, "id long, x array<long>")


def word_hashes(words: DataFrame) -> DataFrame:
    """(id, w) with each word of the array column w as its hash."""
    return words.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
