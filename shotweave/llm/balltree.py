"""Exact top-k inner-product search by ball trees, branch and bound.

Vectors are scaled to whole numbers, floor(scale * x). Candidates are dealt by hash into shards of bounded size;
each shard builds a ball tree (median splits along the direction of greatest spread). For a query q and a ball with centre c and
radius r no inner product exceeds q.c + |q| r. A shard orders its balls by this bound and leaves the rest out as
soon as the bound falls below the query's kth score so far. The kth score is shared: in a first round each shard
scores every query's most promising ball only, and the best k of all shards' scores give each query a floor to
start from in the second round, which prunes most balls.

Queries go to the shards in blocks, so a task holds one shard and one block. Partial results are k rows per
query and shard; they are cut to k again by rank.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a
null id; rows that repeat an id are candidates each; only vectors of the same length are compared; ties go to the
smaller id; a query with fewer than k other vectors gets all; further columns are ignored; an empty table gives an
empty result. Scores are exact: where products could leave 2**53 the shard computes with Python integers, and a score
beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.llm.common import durable

#: A shard holds a 64th of the rows within these bounds, a block of queries and a leaf at most so many.
SHARD_ROWS, BLOCK_QUERIES, LEAF = (1_024, 16_384), 2_048, 64


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """``id, v array<double>`` (whole numbers) and ``d`` (length) of the usable vectors."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
            .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)
            .select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"), F.size("x").alias("d")))


class BallTree:
    """Leaves of at most LEAF rows as ranges of ``order``, with the balls of all inner nodes."""

    def __init__(self, v: np.ndarray):
        self.order = np.arange(len(v))
        self.nodes: list[list] = []  # [start, end, centre, radius, left child or -1]
        self._build(v, 0, len(v))
        self.centre = np.stack([n[2] for n in self.nodes])
        # a little slack covers rounding in the bounds
        self.radius = np.array([n[3] for n in self.nodes]) * (1 + 1e-9) + 1e-6
        self.left = np.array([n[4] for n in self.nodes])
        self.right = np.array([n[5] for n in self.nodes])

    def _build(self, v: np.ndarray, a: int, z: int) -> int:
        own = v[self.order[a:z]]
        centre = own.mean(0)
        off = own - centre
        dist = np.sqrt((off * off).sum(1))
        me = len(self.nodes)
        self.nodes.append([a, z, centre, float(dist.max()), -1, -1])
        if z - a > LEAF and dist.max() > 0:
            far = off[int(dist.argmax())]  # from the centre to the farthest row
            along = off @ far
            mid = (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(along, mid)]
            self.nodes[me][4] = self._build(v, a, a + mid)
            self.nodes[me][5] = self._build(v, a + mid, z)
        return me


def search_shard(ids: np.ndarray, v: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, first: bool):
    """(query row, id, score) of the best k of the shard for each query that reach its floor; with ``first`` only the
    most promising ball of each query is scored."""
    tree = BallTree(v)
    big = max(np.abs(v).max(), 1) * max(np.abs(q).max(), 1) * v.shape[1] >= 2 ** 52
    exact_v, exact_q = (v.astype(object), q.astype(object)) if big else (v, q)
    norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
    best = [[] for _ in q]  # (-score, id), sorted
    kth = floor.copy()
    # top-down: (query, leaf) pairs whose ball may hold a score of the floor or more
    pairs_q, pairs_n = np.arange(len(q)), np.zeros(len(q), np.int64)
    leaf_q, leaf_n, leaf_u = [], [], []
    while len(pairs_q):
        bound = np.einsum("ij,ij->i", q[pairs_q], tree.centre[pairs_n]) + norm[pairs_q] * tree.radius[pairs_n]
        bound += 1e-6 * np.abs(bound)
        go = bound >= kth[pairs_q]
        pairs_q, pairs_n, bound = pairs_q[go], pairs_n[go], bound[go]
        leaf = tree.left[pairs_n] < 0
        leaf_q.append(pairs_q[leaf])
        leaf_n.append(pairs_n[leaf])
        leaf_u.append(bound[leaf])
        pairs_q, inner = pairs_q[~leaf], pairs_n[~leaf]
        pairs_q, pairs_n = np.r_[pairs_q, pairs_q], np.r_[tree.left[inner], tree.right[inner]]
    lq, ln, lu = np.concatenate(leaf_q), np.concatenate(leaf_n), np.concatenate(leaf_u)
    order = np.lexsort((-lu, lq))
    lq, ln, lu = lq[order], ln[order], lu[order]
    rank = np.arange(len(lq)) - np.searchsorted(lq, lq)
    step = 0
    while True:
        now = np.flatnonzero((rank == step) & (lu >= kth[lq]))
        if not len(now) or (first and step):
            break
        by = now[np.argsort(ln[now], kind="stable")]
        for group in np.split(by, np.flatnonzero(np.diff(ln[by])) + 1):
            a, z = tree.nodes[ln[group[0]]][:2]
            rows = tree.order[a:z]
            score = exact_q[lq[group]] @ exact_v[rows].T
            for g, s in zip(lq[group].tolist(), score, strict=True):
                may = np.flatnonzero(np.asarray(s >= kth[g], bool) & (ids[rows] != qid[g]))
                if len(may):
                    best[g] = sorted(best[g] + [(-int(s[i]), int(ids[rows[i]])) for i in may.tolist()])[:k]
                    if len(best[g]) == k:
                        kth[g] = max(kth[g], float(-best[g][-1][0]))
        step += 1
    return [(g, i, -s) for g, rows in enumerate(best) for s, i in rows]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """The ``k`` largest inner products of each row that ``is_query`` (a condition on ``id``) picks with all other rows.

    Returns ``query_id long, rank int`` (from 1)``, vec_id long, score long``."""
    rows = durable(whole_vectors(vectors, id_col, vector, scale), "vectors")
    n = rows.count()
    shards = max(1, -(-n // min(max(n // 64, SHARD_ROWS[0]), SHARD_ROWS[1])))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    q = queries.select("id", "v", "d", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    c = rows.select("id", "v", "d", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))
    # shards meet blocks of the stated queries; each task holds one of both
    left = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def one_round(q, first):
        def run(key, cand, quer):
            if not len(cand) or not len(quer):
                return pd.DataFrame({"query_id": [], "qrow": [], "vec_id": [], "score": []})
            out = []
            v, w = np.stack(cand["v"].to_numpy()), np.stack(quer["v"].to_numpy())
            for g, i, s in search_shard(cand["id"].to_numpy(), v, quer["id"].to_numpy(), w, k,
                                        quer["floor"].to_numpy(float), first):
                out.append((int(quer["id"].iloc[g]), int(quer["qrow"].iloc[g]), i, s))
            return pd.DataFrame(out, columns=["query_id", "qrow", "vec_id", "score"])

        keys = ["shard", "block", "d"]
        found = left.groupBy(*keys).cogroup(durable(q, "queries").withColumn("shard", every).groupBy(*keys)).applyInPandas(
            run, "query_id long, qrow long, vec_id long, score long")
        w = Window.partitionBy("query_id", "qrow").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # rows that repeat a query's id are queries each; qrow tells different vectors of one id apart
    q = q.withColumn("qrow", F.xxhash64("v")).dropDuplicates(["id", "qrow"])
    seed = one_round(q.withColumn("floor", F.lit(float("-inf"))), True)
    floor = seed.groupBy("query_id", "qrow").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k)
    floor = floor.select(F.col("query_id").alias("id"), "qrow", F.col("s").cast("double").alias("floor"))
    q2 = q.join(durable(floor, "floors"), ["id", "qrow"], "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf"))))
    return one_round(q2, False).select("query_id", "rank", "vec_id", "score")
