"""Exact top-k inner product by pivot-table elimination.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` for candidates (M: largest norm) and 0 for queries, so
that the largest inner product is the least Euclidean distance.  Distances of every vector to a few dozen
pivots are computed once, each in its own task.  For a query and a candidate the largest difference of their
pivot distances is a lower bound of their distance, hence gives an upper bound of the score.  Candidates are
evaluated exactly in the order of that bound until the k-th best score exceeds what is left.

Queries and candidates meet in blocks: a task holds at most about ``QUERY_BLOCK`` queries and
``ROW_BLOCK`` rows.  Each block keeps k rows per query, a ranked window merges them.  The search is exact for
any pivots; they only decide how much is skipped.

Vectors that are NULL or hold NULL or non-finite components take no part.  Only vectors of equal length
meet.  Scores tie towards the smaller ``vec_id``.  A query never meets rows with its own ``vec_id``; repeated
candidate rows of one id count once (the largest score), and so do repeated query rows (equal rows).  With fewer than k candidates all are
returned.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, and the bounded sample (least hashes) from which they are picked far apart.
PIVOTS, PIVOT_SAMPLE = 24, 1024
#: Pivots whose bounds are taken for every candidate, before the others refine what is left.
FIRST = 6
QUERY_BLOCK, ROW_BLOCK = 4096, 16384
#: Candidates that are evaluated at once.
STEP = 256


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component in double; rows that take no part are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (
        vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").where(~F.coalesce(bad, F.lit(True)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    )


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, each the farthest from those before it."""
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, pivots: dict[int, np.ndarray], top: float, k: int) -> Iterator[tuple]:
    q_ids, r_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    q, x = np.stack(queries["v"].to_numpy()).astype(np.float64), np.stack(rows["v"].to_numpy()).astype(np.float64)
    order = np.argsort(r_ids, kind="stable")
    r_ids, x = r_ids[order], x[order]
    big = max(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]), 1)
    q_norm, x_norm = (np.square(a).sum(axis=1) for a in (q, x))
    p = pivots[x.shape[1]]
    p_norm = np.square(p).sum(axis=1)
    q_dot, x_dot = q @ p.T, x @ p.T
    exact = np.float32 if big < 2**24 else np.float64 if big < 2**53 else np.int64  # no rounding in scores
    q, x = q.astype(exact), x.astype(exact)
    pad = np.sqrt(np.maximum(top - x_norm, 0))
    # distances in the longer space; pivots keep their own last component at 0
    q_far = np.sqrt(np.maximum(q_norm[:, None] + p_norm - 2 * q_dot, 0))
    x_far = np.sqrt(np.maximum(x_norm[:, None] + p_norm - 2 * x_dot + (pad**2)[:, None], 0))
    columns = [np.ascontiguousarray(c, np.float32) for c in x_far.T]
    slack = 1e-4 * (top + 1) + 1e-3 * np.sqrt(top + 1)
    bound = lambda i, low: (q_norm[i] + top - np.square(low.astype(np.float64))) / 2 + slack
    for i in range(len(q)):
        low = np.abs(columns[0] - np.float32(q_far[i, 0]))
        for j in range(1, min(FIRST, len(columns))):
            np.maximum(low, np.abs(columns[j] - np.float32(q_far[i, j])), out=low)
        limit = bound(i, low)
        limit[r_ids == q_ids[i]] = -np.inf
        n_live, taken, kth = int((limit > -np.inf).sum()), 0, -np.inf
        ids, scores, step = np.zeros(0, np.int64), np.zeros(0), STEP
        left, refined = np.arange(len(x)), False
        while n_live > taken:
            # the next best bounds among those that can still enter
            left = left[limit[left] >= kth] if taken else left[limit > -np.inf]
            if taken and not refined:  # the other pivots only for what the first ones left over
                own = low[left]
                for j in range(FIRST, len(columns)):
                    np.maximum(own, np.abs(columns[j][left] - np.float32(q_far[i, j])), out=own)
                limit[left], refined = bound(i, own), True
                left = left[limit[left] >= kth]
            if not len(left):
                break
            if len(left) > step:
                cut = np.argpartition(-limit[left], step)
                now, left = left[cut[:step]], left[cut[step:]]
            else:
                now, left = left, left[:0]
            taken += len(now)
            # many rows are multiplied in place, few are gathered
            got = (x @ q[i])[now] if 8 * len(now) > len(x) else x[now] @ q[i]
            now, got = now[got >= kth], got[got >= kth]
            ids, scores = np.concatenate([ids, r_ids[now]]), np.concatenate([scores, got])
            best = np.lexsort((ids, -scores))
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]  # one row per id
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                kth = scores[-1]
            step *= 2
        for vec_id, score in zip(ids, scores):
            yield int(q_ids[i]), int(vec_id), int(score)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` over integer vectors ``(vec_id, v)``; every row is a candidate."""
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    facts = rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("top"),
        F.min_by("v", F.struct(F.xxhash64("vec_id"), "vec_id")).alias("first"),
    ).collect()  # one row per vector length
    facts = [r for r in facts if r["q"]]
    out = "query_id long, vec_id long, score long"
    if not facts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sampled = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(PIVOT_SAMPLE).select("v", "dim").collect()
    pivots = {r["dim"]: far_apart(np.array([r["first"], *[s["v"] for s in sampled if s["dim"] == r["dim"]]], np.float64), PIVOTS) for r in facts}
    tops = {r["dim"]: float(r["top"]) for r in facts}
    n_query = {r["dim"]: -(-r["q"] // QUERY_BLOCK) for r in facts}
    n_row = {r["dim"]: -(-r["n"] // ROW_BLOCK) for r in facts}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("dim")]
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), table(n)).cast("int")
    known = rows.where(F.col("dim").isin(list(tops)))
    asked = known.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("qb", place(n_query, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), table(n_row) - 1)))
    given = known.withColumn("rb", place(n_row, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), table(n_query) - 1)))

    def block(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(x["dim"].iloc[0])
        return pd.DataFrame(list(_best_of_block(q, x, pivots, tops[dim], k)), columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = asked.groupBy("dim", "qb", "rb").cogroup(given.groupBy("dim", "qb", "rb")).applyInPandas(block, out)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
