"""Sparse, dense and hybrid retrieval over whole tables for a stated set of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.ranks import top_per_group
from weftspark.util import cut, maybe_broadcast, spread

# public defaults of BM25 engines
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: Queries that are scored at once; more go in blocks, one pass over the documents each. A block's terms and weights are broadcast.
SPARSE_BLOCK = 1_000
_WORD = re.compile(r"\w+")


def _postings(docs: DataFrame, doc_id: str, text: str, vocab) -> DataFrame:
    """(did, dl, ts, tfs): length of each document and counts of those of its terms that the queries have."""

    @F.pandas_udf("dl int, ts array<int>, tfs array<int>")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = vocab.value
        for s in it:
            rows = []
            for t in s:
                w = _WORD.findall(t) if t else []
                c = Counter(i for i in map(number.get, w) if i is not None)
                rows.append((len(w), list(c), list(c.values())))
            yield pd.DataFrame(rows, columns=["dl", "ts", "tfs"])

    d = spread(docs.select(F.col(doc_id).alias("did"), F.col(text).alias("_t")))
    return d.select("did", count(F.lower("_t")).alias("p")).select("did", "p.*")


def _score_block(q: DataFrame, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    spark = q.sparkSession
    rows = q.select("qid", "t").collect()  # at most SPARSE_BLOCK queries' terms
    qids = sorted({r.qid for r in rows})
    at = {x: i for i, x in enumerate(qids)}
    vocab = {t: i for i, t in enumerate(sorted({r.t for r in rows}))}
    having: list[list[int]] = [[] for _ in vocab]
    for r in rows:
        having[vocab[r.t]].append(at[r.qid])
    post = cut(_postings(docs, doc_id, text, spark.sparkContext.broadcast(vocab)))
    n, avg = post.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(vocab))
    for r in post.select(F.explode("ts").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[r.t] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((qids, [np.array(h) for h in having], idf, avg))
    kind = dict(docs.dtypes)[doc_id]

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, having, idf, avg = shared.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=object))] * len(qids)
        for pdf in it:
            for lo in range(0, len(pdf), 2_000):
                part = pdf.iloc[lo : lo + 2_000]
                sizes = np.array([len(t) for t in part["ts"]])
                if not sizes.sum():
                    continue
                doc = np.repeat(np.arange(len(part)), sizes)
                ts, tf = np.concatenate(part["ts"].tolist()), np.concatenate(part["tfs"].tolist()).astype(float)
                dl = part["dl"].to_numpy()[doc]
                w = idf[ts] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
                scores = np.zeros((len(qids), len(part)))
                order = np.argsort(ts, kind="stable")
                ts, doc, w = ts[order], doc[order], w[order]
                ends = np.flatnonzero(np.concatenate([ts[1:] != ts[:-1], [True]])) + 1
                start = 0
                for e in ends:
                    scores[np.ix_(having[ts[start]], doc[start:e])] += w[start:e]
                    start = e
                ids = part["did"].to_numpy()
                for i in range(len(qids)):
                    got = np.flatnonzero(scores[i])
                    if len(got):
                        s, d = np.concatenate([kept[i][0], scores[i][got]]), np.concatenate([kept[i][1], ids[got]])
                        best = sorted(range(len(s)), key=lambda j: (-round(s[j], 9), d[j]))[:k] if len(s) <= 4 * k else _best(s, d, k)
                        kept[i] = s[best], d[best]
        out = [(q, d, float(s)) for q, (ss, ds) in zip(qids, kept, strict=True) for s, d in zip(ss, ds, strict=True)]
        if out:
            yield pd.DataFrame(out, columns=["qid", "did", "score"])

    return post.mapInPandas(score, f"qid {dict(q.dtypes)['qid']}, did {kind}, score double")


def _best(s: np.ndarray, d: np.ndarray, k: int) -> list[int]:
    """Positions of the k largest scores, to nine places, ties to the smaller id: those that may be among them first, then in order."""
    near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-8)
    return sorted(near.tolist(), key=lambda j: (-round(s[j], 9), d[j]))[:k]


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "id", query: str = "query") -> DataFrame:
    """(query, doc, score, rank): top k documents of each query by BM25 over distinct query terms.

    A stated query set against all documents. Terms are counted in one pass over the whole texts; counts and lengths are of all documents.
    Each task scores its documents and keeps its own best k per query, so no row per (query, document) is ever shuffled. Null texts are
    documents of length 0, null ids of queries are left out. Ties go to the smaller document id.
    """
    q = queries.where(F.col(query).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(terms(F.col(query)))).alias("t")).distinct()
    q = cut(q)
    blocks = max(1, -(-q.select("qid").distinct().count() // SPARSE_BLOCK))
    out = None
    for i in range(blocks):
        part = _score_block(q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), docs, k, doc_id, text)
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, ["qid"], [F.round("score", 9).desc(), F.col("did")], k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that are broadcast at once; more go in blocks, one pass over the rows each.
BLOCK = 2_000


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def _dense_block(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    rows = q.collect()  # at most a block of queries
    kinds = dict(q.dtypes)["qid"], dict(v.dtypes)["vid"]
    shared = q.sparkSession.sparkContext.broadcast(([r.qid for r in rows], _unit([r.q for r in rows])))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, m = shared.value
        if not qids:
            return
        kept = [(np.empty(0), np.empty(0, dtype=object))] * len(qids)
        for pdf in it:
            for lo in range(0, len(pdf), 2_000):
                part = pdf.iloc[lo : lo + 2_000]
                scores, ids = _unit(part["v"].tolist()) @ m.T, part["vid"].to_numpy()
                for i, own in enumerate(qids):
                    s = scores[:, i]
                    # those that may be among the best of this part, and one more for the query's own vector
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-8) if len(s) > k + 1 else np.arange(len(s))
                    near = near[ids[near] != own]
                    s, d = np.concatenate([kept[i][0], s[near]]), np.concatenate([kept[i][1], ids[near]])
                    best = sorted(range(len(s)), key=lambda j: (-round(s[j], 9), d[j]))[:k]
                    kept[i] = s[best], d[best]
        out = [(x, d, float(s)) for x, (ss, ds) in zip(qids, kept, strict=True) for s, d in zip(ss, ds, strict=True)]
        if out:
            yield pd.DataFrame(out, columns=["qid", "vid", "score"])

    return v.mapInPandas(score, f"qid {kinds[0]}, vid {kinds[1]}, score double")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "vec_id", where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(query, vec, score, rank): top k by cosine. A stated query set against all rows, in blocks of queries: each task multiplies its vectors with the block's and keeps its own best. A filter applies before the ranking. Null and zero vectors match nothing."""
    norm = lambda c: F.sqrt(dot(c, c))
    v = vectors if where is None else vectors.where(where)
    v = spread(v.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("vid"), F.col(vec).alias("v"))).where(norm("v") > 0)
    q = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).alias("qid"), F.col(vec).alias("q")).where(norm("q") > 0)
    blocks = max(1, -(-q.count() // block))
    out = None
    for i in range(blocks):
        part = _dense_block(v, q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), k)
        out = part if out is None else out.unionByName(part)
    return top_per_group(out, ["qid"], [F.round("score", 9).desc(), F.col("vid")], k)


#: Vectors that the cells are fitted on at most; every vector is indexed.
FIT = 20_000


def fit_cells(vectors: DataFrame, cells: int, vec: str = "embedding", id_col: str = "vec_id", rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres of so many cells, by spherical k-means on at most FIT vectors in the order of their ids' hash."""
    sample = vectors.where(F.col(vec).isNotNull()).select(vec, F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).orderBy("h").limit(FIT).collect()
    x = _unit([r[0] for r in sample if any(r[0])])
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds if len(x) else 0):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                m = x[own == c].sum(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def assign_cells(vectors: DataFrame, centres: np.ndarray, vec: str = "embedding", probes: int = 1) -> DataFrame:
    """All rows with the numbers of their nearest cells (_cells): one for rows of the index, more for queries. Null and zero vectors have none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        c = shared.value
        out: list = [None] * len(v)
        at = [i for i, x in enumerate(v) if x is not None and np.any(x)]
        if at and len(c):
            s = _unit([v.iloc[i] for i in at]) @ c.T
            for i, best in zip(at, np.argsort(-s, axis=1)[:, :probes].tolist(), strict=True):
                out[i] = best
        return pd.Series(out, dtype=object)

    return vectors.withColumn("_cells", near(vec))


def ivf(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 64, probes: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(qid, vid, score, rank) by an inverted file: only vectors of the query's nearest cells are compared, by a join on the cell. More probes find more; recall against dense() is measured in the tests."""
    centres = fit_cells(vectors, cells, vec, id_col)
    v = assign_cells(vectors.select(id_col, vec), centres, vec).select(F.col(id_col).alias("vid"), F.col(vec).alias("v"), F.get("_cells", 0).alias("cell")).where("cell is not null")
    q = assign_cells(queries.select(id_col, vec), centres, vec, probes).select(F.col(id_col).alias("qid"), F.col(vec).alias("q"), F.explode("_cells").alias("cell"))
    norm = lambda c: F.sqrt(dot(c, c))
    s = v.join(maybe_broadcast(cut(q)), "cell").where("vid != qid").select("qid", "vid", (dot("v", "q") / (norm("v") * norm("q"))).alias("score"))
    return top_per_group(s, ["qid"], [F.round("score", 9).desc(), F.col("vid")], k)


def _minmax(s: DataFrame) -> DataFrame:
    r = s.groupBy("qid").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.join(r, "qid").select("qid", "did", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("s"))


def hybrid(dense_top: DataFrame, sparse_top: DataFrame, alpha: float = 0.7, k: int = 10) -> DataFrame:
    """Relative-score fusion of two ranked lists (qid, did, score): alpha dense + (1 - alpha) sparse of min-max scaled scores."""
    a, b = _minmax(dense_top).withColumnRenamed("s", "sd"), _minmax(sparse_top).withColumnRenamed("s", "ss")
    j = a.join(b, ["qid", "did"], "full_outer").select("qid", "did", (alpha * F.coalesce("sd", F.lit(0.0)) + (1 - alpha) * F.coalesce("ss", F.lit(0.0))).alias("score"))
    return top_per_group(j, ["qid"], [F.round("score", 9).desc(), F.col("did")], k)


def reciprocal_rank(a: DataFrame, b: DataFrame, c: int = 60, k: int = 10) -> DataFrame:
    """Fusion by the sum of 1 / (c + rank)."""
    u = a.select("qid", "did", "rank").unionByName(b.select("qid", "did", "rank")).groupBy("qid", "did").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"))
    return top_per_group(u, ["qid"], [F.round("score", 12).desc(), F.col("did")], k)


def overlap_score(query: Column, text: Column) -> Column:
    """The offline stand-in of a cross-encoder: share of the query's distinct terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(text))) / F.size(q)).otherwise(0.0)


def rerank(cands: DataFrame, top_n: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """cands (qid, did, rank, rerank_score): top_n by score, with rank before and after and how far each moved."""
    r = top_per_group(cands, ["qid"], [F.col("rerank_score").desc(), F.col("rank")], top_n, "reranked")
    return r.select("qid", "did", F.col("rank").alias("original_rank"), F.col("reranked").alias("reranked_rank"), F.abs(F.col("rank") - F.col("reranked")).alias("moved"), "rerank_score", *keep)


def rerank_stats(cands: DataFrame, top_n: int = 5) -> DataFrame:
    """Per query: mean move over the top_n, least, most and mean score over all, and where the first came from."""
    r = rerank(cands, top_n).groupBy("qid").agg(F.avg("moved").alias("mean_move"), F.max(F.when(F.col("reranked_rank") == 1, F.col("original_rank"))).alias("top1_original_rank"))
    a = cands.groupBy("qid").agg(F.min("rerank_score").alias("min_score"), F.max("rerank_score").alias("max_score"), F.avg("rerank_score").alias("mean_score"))
    return r.join(a, "qid")
