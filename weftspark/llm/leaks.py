"""Passages of test items that stand in corpus records.

The words of a window walk randomly through a CGK embedding, which turns edit distance into Hamming distance; a few
sampled positions of the embedding make a bucket key; several walks and samples give the recall wanted. Windows of records
that share a bucket with a window of an item are compared exactly, by chains of matching words.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.util import shared_dir, spread

#: A passage has at least so many words of the item; one word in EDITS of it may be changed, added or dropped.
MIN_WORDS, EDITS = 12, 8
#: Walks, samples per walk and positions per sample. recall() measures what they find.
WALKS, SAMPLES, POSITIONS = 4, 4, 5
#: Items go to the workers in blocks of so many words, one pass over the corpus per block.
BLOCK_WORDS = 2_000_000
#: Words that the parts of an item longer than a block share.
SHARED_WORDS = 64

_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_TAG, _ENTITY = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>"), re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+);")
_WORD = re.compile(r"\w+")
_NOT_WORD = re.compile(r"[^\w\s]+")


def clean(text: str) -> str:
    if not text.isascii():
        if any(c in text for c in _INVISIBLE):
            text = text.translate(dict.fromkeys(map(ord, _INVISIBLE)))
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return text.lower()


_EMPHASIS = re.compile(r"(?<!\w)_+|_+(?!\w)")
_EDGES = re.compile(r"_(?!\w)"), re.compile(r"_(?<!\w_)")


def strict_words(text: str) -> list[str]:
    """Runs of letters, digits and underscores; underscores around a word are markup."""
    return _WORD.findall(_EMPHASIS.sub(" ", text) if "_" in text and (_EDGES[0].search(text) or _EDGES[1].search(text)) else text)


def joined_words(text: str) -> list[str]:
    """What white space parts, without its punctuation: where a copy has lost its punctuation, 0.55 reads 055."""
    return _NOT_WORD.sub("", _EMPHASIS.sub(" ", text)).split()


#: The two ways to read a text: its words, size of window in them, most of a window's words that no item has.
VIEWS = ((strict_words, 12, 2), (joined_words, 7, 1))


def _walks(words: int) -> np.ndarray:
    """The random choices: for each walk, step and word class (a hash of the word), whether to step on."""
    rng = np.random.default_rng(20240521 + words)
    return rng.integers(0, 2, size=(WALKS, 3 * words, 256), dtype=np.int8)


def _samples(words: int) -> np.ndarray:
    """Sampled positions of the embedding. Later steps of a walk lie past the window's end; positions come from its first two thirds."""
    rng = np.random.default_rng(7919 + words)
    top = 2 * words
    return np.stack([np.stack([np.sort(rng.choice(top, POSITIONS, replace=False)) for _ in range(SAMPLES)]) for _ in range(WALKS)])


_TABLE = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_keys(windows: np.ndarray) -> np.ndarray:
    """windows: (n, words) word numbers. Keys, (n, WALKS * SAMPLES): hashes of sampled positions of the CGK embeddings."""
    n, size = windows.shape
    walks, samples = _walks(size), _samples(size)
    padded = np.concatenate([windows.astype(np.int64), np.full((n, 1), -2, dtype=np.int64)], axis=1)
    classes = ((padded.astype(np.uint64) * _MIX) >> np.uint64(56)).astype(np.intp)
    out = np.empty((n, WALKS * SAMPLES), dtype=np.uint64)
    rows = np.arange(n)
    for w in range(WALKS):
        at = np.zeros(n, dtype=np.intp)
        top = int(samples[w].max()) + 1
        embedded = np.empty((top, n), dtype=np.uint64)
        for j in range(top):
            embedded[j] = padded[rows, at].astype(np.uint64)
            at = np.minimum(at + walks[w, j][classes[rows, at]], size)
        for s in range(SAMPLES):
            h = np.full(n, (w * SAMPLES + s + 1) * 0xD6E8FEB86659FD93 % 2**64, dtype=np.uint64)
            for p in samples[w, s]:
                h = (h ^ (embedded[p] + _MIX)) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            out[:, w * SAMPLES + s] = h
    return out


def _gram_hashes(grams: np.ndarray) -> np.ndarray:
    """Hashes of rows of word numbers, for candidates only."""
    h = np.full(len(grams), 0xD6E8FEB86659FD93, dtype=np.uint64)
    for c in range(grams.shape[1]):
        h = (h ^ (grams[:, c].astype(np.uint64) + _MIX)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _grams(items: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and items of all runs of half a window's words."""
    hashes = [_gram_hashes(np.lib.stride_tricks.sliding_window_view(np.array(x[1], dtype=np.int64), size // 2)) for x in items]
    h, o = np.concatenate(hashes), np.repeat(np.arange(len(items)), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    return h[order], o[order]


class Index:
    """Buckets of the items' windows, in both views."""

    def __init__(self, passages: list[tuple[str, str]]) -> None:
        """passages: (item id, text)."""
        self.views = []
        #: Words that arise where punctuation inside an item's words is lost; only texts with one need the second view.
        self.merged: set[str] = set()
        for read, size, _ in VIEWS:
            vocab: dict[str, int] = {}
            items = []
            keys: list[np.ndarray] = []
            owner: list[np.ndarray] = []
            for item, text in passages:
                t = clean(text)
                words = read(t)
                if len(strict_words(t)) < MIN_WORDS or len(words) < size:
                    continue
                ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], dtype=np.int64)
                weights = [max(1, len(strict_words(w))) for w in _units(t, read)]
                items.append((item, ids.tolist(), weights, Passages(ids.tolist(), weights)))
                if read is joined_words:
                    self.merged.update(w for w, n in zip(words, items[-1][2], strict=True) if n > 1)
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                keys.append(windows)
                owner.append(np.full(len(windows) * WALKS * SAMPLES, len(items) - 1, dtype=np.int64))
            if read is strict_words:
                strict = set(vocab)
            if items:
                k, o = bucket_keys(np.concatenate(keys)).ravel(), np.concatenate(owner)
                order = np.lexsort((o, k))
                k, o = k[order], o[order]
                once = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
                members = np.unique(np.concatenate([i * (len(vocab) + 1) + np.array(x[1], dtype=np.int64) for i, x in enumerate(items)]))
                k, o = k[once], o[once]
                heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                table = np.zeros(_TABLE, dtype=bool)
                table[k % _TABLE] = True
                self.views.append((vocab, items, members, table, k[heads], np.concatenate([heads, [len(k)]]), o, _grams(items, size)))
            else:
                self.views.append((vocab, items, *[None] * 6))
        self.merged -= strict


def _units(text: str, read) -> list[str]:
    """For each word of the view, the text whose strict words it holds."""
    if read is strict_words:
        return strict_words(text)
    return [u for u in _EMPHASIS.sub(" ", text).split() if _NOT_WORD.sub("", u)]


def leaks(texts: list[str | None], index: Index) -> list[set[str]]:
    """The items that each text leaks."""
    found: list[set[str]] = [set() for _ in texts]
    cleaned = [clean(t) if t else "" for t in texts]
    merged = index.merged
    for (read, size, most_new), (vocab, items, members, table, keys, heads, owners, grams) in zip(VIEWS, index.views, strict=True):
        if not items:
            continue
        ids: list[int] = []
        first, again = [0], []
        for t in cleaned:
            if t:
                words = read(t)
                if read is strict_words and merged.isdisjoint(words):
                    again.append("")
                else:
                    again.append(t)
                ids += map(vocab.get, words, repeat(0))
            else:
                again.append("")
            first.append(len(ids))
        cleaned = again
        flat = np.array(ids, dtype=np.int64)
        first_a = np.array(first)
        # a least passage with a word dropped is one word short of a window; one half of it, left or right, is whole
        short = np.flatnonzero(first_a[1:] - first_a[:-1] == size - 1)
        if len(short):
            whole = flat[first_a[short][:, None] + np.arange(size - 1)]
            for half in (whole[:, : size // 2], whole[:, -(size // 2) :]):
                h = _gram_hashes(half)
                for x, lo, hi in zip(short.tolist(), np.searchsorted(grams[0], h, "left").tolist(), np.searchsorted(grams[0], h, "right").tolist(), strict=True):
                    for y in set(grams[1][lo:hi].tolist()):
                        if items[y][0] not in found[x] and items[y][3].found(flat[first[x] : first[x + 1]].tolist()):
                            found[x].add(items[y][0])
        if len(flat) < size:
            continue
        new = np.concatenate([[0], np.cumsum(flat == 0)])
        # a window of a passage has no more words unknown to the items than it has edits
        good = np.flatnonzero(new[size:] - new[:-size] <= most_new)
        record = np.searchsorted(first_a, good, side="right") - 1
        good = good[first_a[record + 1] >= good + size]
        for at in range(0, len(good), 50_000):
            part = good[at : at + 50_000]
            windows = flat[part[:, None] + np.arange(size)]
            k = bucket_keys(windows)
            k = k.ravel()
            maybe = np.flatnonzero(table[k % _TABLE])
            at_key = np.minimum(np.searchsorted(keys, k[maybe]), len(keys) - 1)
            same = keys[at_key] == k[maybe]
            if not same.any():
                continue
            # every (window, item) that meet in a bucket, once
            lo = heads[at_key[same]]
            n = heads[at_key[same] + 1] - lo
            w = np.repeat(maybe[same] // (WALKS * SAMPLES), n)
            o = owners[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            pairs = np.unique(w * len(items) + o)
            w, o = pairs // len(items), pairs % len(items)
            # the window's words must be that item's, but for as many as it may have edits
            code = o[:, None] * (len(vocab) + 1) + windows[w]
            pos = np.minimum(np.searchsorted(members, code), len(members) - 1)
            near = ((members[pos] == code) & (windows[w] > 0)).sum(axis=1) >= size - most_new
            rec = np.searchsorted(first_a, part, side="right") - 1
            places: dict[tuple[int, int], list[int]] = {}
            for x, y, z in zip(rec[w[near]].tolist(), o[near].tolist(), part[w[near]].tolist(), strict=True):
                places.setdefault((x, y), []).append(z)
            for (x, y), starts in places.items():
                item, ids_of, _, search = items[y]
                if item in found[x]:
                    continue
                reach = len(ids_of) + len(ids_of) // EDITS + size
                starts.sort()
                a = b = starts[0]
                for z in [*starts[1:], None]:
                    if z is not None and z - b <= reach:
                        b = z
                        continue
                    region = flat[max(first[x], a - reach) : min(first[x + 1], b + size + reach)]
                    if search.found(region.tolist()):
                        found[x].add(item)
                        break
                    a = b = z
    return found


class Passages:
    """Searches records for a passage of one item: at least MIN_WORDS of its words, at most one edit in EDITS words, its ends matching.

    Exact: an alignment is a chain of runs of equal words; between two runs the edits are the longer of the two gaps.
    weights: how many words each of the item's counts for, matched or changed.
    """

    def __init__(self, item: list[int], weights: list[int] | None = None) -> None:
        self.n, self.where = len(item), {}
        for i, w in enumerate(item):
            self.where.setdefault(w, []).append(i)
        self.total = [0]
        for i in range(len(item)):
            self.total.append(self.total[-1] + (weights[i] if weights else 1))

    def found(self, record: list[int]) -> bool:
        total, where = self.total, self.where
        # maximal runs along diagonals: a run's diagonal is i - j
        runs: list[tuple[int, int, int]] = []
        open_: dict[int, tuple[int, int]] = {}
        for j, w in enumerate(record):
            for i in where.get(w, ()) if w else ():
                r = open_.get(i - j)
                if r and r[1] == j - 1:
                    open_[i - j] = (r[0], j)
                else:
                    if r:
                        runs.append((r[0], r[0] + i - j, r[1] - r[0] + 1))
                    open_[i - j] = (j, j)
        runs += [(a, a + d, b - a + 1) for d, (a, b) in open_.items()]
        runs.sort()
        reach = max(1, total[-1] // EDITS)
        for k, (_, i0, n0) in enumerate(runs):
            if total[-1] - total[i0] < MIN_WORDS:
                continue
            if total[i0 + n0] - total[i0] >= MIN_WORDS:
                return True
            # fewest edits to have come to the end of each run, from the start of run k
            best: dict[int, int] = {k: 0}
            for m in range(k, len(runs)):
                if m not in best:
                    continue
                e = best[m]
                jm, im, nm = runs[m]
                je, ie = jm + nm, im + nm
                words = total[ie] - total[i0]
                if words >= MIN_WORDS and e * EDITS <= words:
                    return True
                for q in range(m + 1, len(runs)):
                    jq, iq, nq = runs[q]
                    if jq - je > reach:
                        break
                    if iq - ie > reach or iq + nq <= ie:
                        continue
                    trim = max(0, je - jq, ie - iq)
                    if trim >= nq:
                        continue
                    gap = max(jq + trim - je, total[iq + trim] - total[ie])
                    if gap >= 1 and e + gap <= reach and e + gap < best.get(q, 1 << 30):
                        best[q] = e + gap
        return False


def passage(record: list[int], item: list[int], weights: list[int] | None = None) -> bool:
    return Passages(item, weights).found(record)


def recall(windows: np.ndarray, changed: np.ndarray) -> float:
    """Share of window pairs that meet in a bucket."""
    return float((bucket_keys(windows) == bucket_keys(changed)).any(axis=1).mean()) if len(windows) else 1.0


_FOUND = T.ArrayType(T.StringType())


def item_parts(text: str, most: int, shared: int) -> Iterator[str]:
    """A text of any length in parts of at most so many words, each sharing so many with the one before.

    A passage holds a passage of at most 24 words: cut into runs of 24 words, one of them has no more than its share of edits, three, and
    without the edits at its ends it keeps 21 words or more and a ratio no worse. So parts that share 24 words or more lose none.
    """
    if len(text) // 2 <= most:
        yield text
        return
    starts = [m.start() for m in _WORD.finditer(text)]
    at = 0
    while at == 0 or at + shared < len(starts):
        end = at + most
        yield text[starts[at] if at else 0 : starts[end] if end < len(starts) else len(text)]
        at = end - shared


def _blocks(items: DataFrame, id_col: str, fields: tuple[str, ...]) -> Iterator[list[tuple[str, str]]]:
    """The stated items, in blocks of at most BLOCK_WORDS words each, streamed from the cluster one partition at a time."""
    block, words = [], 0
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), *fields).distinct()
    for r in rows.toLocalIterator():
        for f in fields:
            for part in item_parts(r[f], BLOCK_WORDS, SHARED_WORDS) if r[f] else ():
                n = len(part) // 4
                if block and words + n > BLOCK_WORDS:
                    yield block
                    block, words = [], 0
                block.append((r["i"], part))
                words += n
    if block:
        yield block


def _one_block(corpora: dict[str, tuple[DataFrame, str, tuple[str, ...]]], shared) -> DataFrame:
    @F.pandas_udf(_FOUND)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for s in it:
            yield pd.Series([sorted(x) for x in leaks(s.tolist(), index)], dtype=object)

    # not deterministic to Spark: else a filter on the array's size is inferred and records are searched twice
    search = run.asNondeterministic()
    out = None
    for name, (df, id_col, texts) in corpora.items():
        # fields of a record are read apart: a passage doesn't run from one into the next
        df = spread(df.select(id_col, *texts))
        rows = df.select(F.col(id_col).alias("record_id"), F.explode(F.array(*texts)).alias("text")) if len(texts) > 1 else df.select(F.col(id_col).alias("record_id"), F.col(texts[0]).alias("text"))
        got = rows.where("text is not null").select(F.lit(name).alias("corpus"), "record_id", F.explode(search("text")).alias("item_id"))
        out = got if out is None else out.unionByName(got)
    return out


def find_leaks(corpora: dict[str, tuple[DataFrame, str, tuple[str, ...]]], items: DataFrame, item_id: str = "id", fields: tuple[str, ...] = ("query", "ground_truth_answer")) -> DataFrame:
    """(corpus, record_id, item_id) of every record that holds a passage of an item.

    corpora: name -> (table, id column, text columns). Items with under MIN_WORDS words can't leak; null and empty texts
    hold nothing; repeated rows are reported once; without items the result is empty. Records are read whole, once per
    block of items, and nothing is shuffled but the found triples. Items of one block stay a lazy plan. Of more blocks one is
    indexed at a time: its finds are written to the shared folder and its index leaves driver and workers before the next.
    """
    spark = items.sparkSession
    blocks = _blocks(items, item_id, fields)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], "corpus string, record_id bigint, item_id string")
    if second is None:
        return _one_block(corpora, spark.sparkContext.broadcast(Index(first))).distinct()
    path = f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}"
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(Index(block))
        _one_block(corpora, shared).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path).distinct()
