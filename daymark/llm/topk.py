"""Exact top-k inner-product search by a three-phase uniform threshold.

The components of a vector are cut into ``LISTS`` lists; a score is the sum of its parts in the lists.

1. Every shard of vectors gathers the best ``k`` entries of each list for each query and resolves their scores. The k-th best of
   these scores over all shards is a safe cutoff: the true k-th best is not below it.
2. The cutoff travels to the shards. A vector whose score reaches the cutoff has a part of at least cutoff / LISTS in some list, so the
   entries that pass this uniform threshold are sufficient.
3. Of these, those whose known parts plus the threshold for the missing ones reach the cutoff are resolved exactly. A shard
   returns its best ``k`` by (score, smaller id), which bounds the result whatever the ties.

Scale: queries and vectors meet in cells of a block of queries and a shard of vectors, so a task holds a bounded number of
both. Results per cell are k entries a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.llm.common import table

LISTS = 4
SHARD, BLOCK = 4096, 2048


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v) with integer components floor(scale * x); vectors that are null or hold a null or non-finite one are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).where("vec_id is not null and embedding is not null").where(fine)
    return out.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; in floating point where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def parts(queries: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    edges = np.linspace(0, queries.shape[1], min(LISTS, max(1, queries.shape[1])) + 1).astype(int)
    return [products(queries[:, a:b], vectors[:, a:b]) for a, b in zip(edges, edges[1:])]


def first_entries(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase 1 in a cell: the best entries of each list, with their whole scores."""
    q, v = np.stack(queries["q"].to_numpy()), np.stack(vectors["v"].to_numpy())
    q_ids, v_ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
    lists = parts(q, v)
    total = sum(lists)
    own = q_ids[:, None] == v_ids[None, :]
    who, what = [], []
    few = min(k + 1, len(v_ids))  # one more, for the query itself
    for part in lists:
        top = np.argpartition(-part, few - 1, axis=1)[:, :few]
        who.append(np.repeat(np.arange(len(q_ids)), few))
        what.append(top.ravel())
    who, what = np.concatenate(who), np.concatenate(what)
    keep = ~own[who, what]
    return pd.DataFrame({"query_id": q_ids[who[keep]], "vec_id": v_ids[what[keep]], "score": total[who[keep], what[keep]]}).drop_duplicates()


def last_entries(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phases 2 and 3 in a cell: entries above the uniform threshold, the remaining ones resolved, the best k of them."""
    q, v = np.stack(queries["q"].to_numpy()), np.stack(vectors["v"].to_numpy())
    q_ids, v_ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
    cutoff = queries["cutoff"].to_numpy(np.float64, na_value=-np.inf)  # none: fewer than k candidates
    lists = parts(q, v)
    share = (cutoff / len(lists))[:, None]
    known = np.stack([part >= share for part in lists])
    bound = sum(np.where(passed, part, share) for passed, part in zip(known, lists))
    candidate = known.any(axis=0) & (bound >= cutoff[:, None]) & (q_ids[:, None] != v_ids[None, :])
    who, what = np.nonzero(candidate)
    score = sum(part[who, what] for part in lists)
    found = pd.DataFrame({"query_id": q_ids[who], "vec_id": v_ids[what], "score": score})
    found = found[found["score"] >= cutoff[who]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def best(entries: DataFrame, k: int) -> DataFrame:
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def search(vectors: DataFrame, query_ids, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other vectors for each vector that meets the condition ``query_ids``.

    Ties go to the smaller vec_id. Only vectors of the query's length are compared. Rows that repeat a vec_id are one vector, of which
    the smallest counts. Scores must fit a long. A query without any candidate has no row.
    """
    rows = table(whole_vectors(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(query_ids)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    keys = ["size", "block", "shard"]
    left = rows.where(query_ids).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("size"), place(blocks).alias("block"))
    left = left.withColumn("shard", every(shards))
    right = rows.select("vec_id", "v", F.size("v").alias("size"), place(shards).alias("shard")).withColumn("block", every(blocks))

    def cells(queries: DataFrame, step) -> DataFrame:
        def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})
            return step(q, v, k)

        return queries.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    gathered = best(cells(left, first_entries).distinct(), k)
    cutoffs = table(gathered.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")
    return best(cells(left.join(cutoffs, "query_id", "left"), last_entries), k).select("query_id", "rank", "vec_id", "score")
