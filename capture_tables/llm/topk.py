"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt into blocks of bounded size, and in each block every dimension has a list
of its vectors sorted by that component. A query walks all lists at once, each from the end
at which its own component makes the products largest, and scores each vector that turns up
by looking its other components up. No vector further down can score more than the sum of
the products at the depth reached; once that bound is below the kth score known, the walk
ends. A query first meets one block; its kth score there is the bound that it takes to the
others, of which it skips those whose largest components cannot beat it. The depths at which
walks can end are found for all queries of a block at once, and queries that must go so deep
that most vectors turn up score the block's vectors together. A query's best of all blocks
are then ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
QUERY_BLOCK = 512
_FIRST_DEPTH = 16
#: Rows of a plan, one for each length of vector, that are broadcast at most.
PLANNED = 10_000


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component x. Vectors that are null, empty, or hold a
    null, NaN or infinite component are left out, and so are rows without vec_id."""
    as_double = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return as_double.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & finite).select(
        "vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")
    )


class SortedLists:
    """The sorted per-dimension lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, rows: np.ndarray):
        """ids: what ties go by; marks: which row it is; rows: the vectors."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.marks, self.rows = ids[order], marks[order], rows[order]
        self.up = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T)
        n = len(ids)
        self.depths = np.array([0, *(d for d in (_FIRST_DEPTH << g for g in range(40)) if d < n)])
        ranked = np.sort(self.rows, axis=0)
        last = np.maximum(self.depths - 1, 0)
        self.high, self.low = ranked[n - 1 - last], ranked[last]  # where lists stand at each depth
        self.most = int(np.abs(self.rows).max(initial=0))

    def exact(self, queries: np.ndarray) -> np.dtype:
        """A type in which no product of these vectors is rounded."""
        most = self.most * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        return np.dtype(float) if most < 1 << 53 else np.dtype(np.int64) if most < 1 << 63 else np.dtype(object)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, least: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, scores) of its k best vectors, ties to smaller ids, except
        the row that is its `own`, and except those that score below its `least` (or None)."""
        kind = self.exact(queries)
        q, rows = queries.astype(kind), self.rows.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        self_at = {mark: at for at, mark in enumerate(self.marks.tolist())}
        out: list = [None] * len(q)
        deep = []
        for j in range(len(q)):
            used = np.flatnonzero(queries[j])
            if least[j] is not None and bounds[j, 0] < least[j]:
                out[j] = (np.empty(0, np.int64), np.empty(0, kind))
                continue
            walk = [d for d in self.depths[1:] if d * len(used) <= len(rows) // 4]
            if not walk or least[j] is not None and bounds[j, len(walk)] >= least[j]:
                deep.append(j)
                continue
            bar = least[j]
            for g, depth in enumerate(walk, 1):
                falling = queries[j, used] > 0
                met = np.unique(np.concatenate((self.up[used[falling], -depth:].ravel(), self.up[used[~falling], :depth].ravel())))
                out[j] = self._best(met, rows[met] @ q[j], self_at.get(own[j]), k)
                if len(out[j][1]) == k and (bar is None or out[j][1][-1] > bar):
                    bar = out[j][1][-1]
                if bar is not None and bounds[j, g] < bar:
                    break
            else:
                deep.append(j)
        every = np.arange(len(rows))
        for lo in range(0, len(deep), 64):
            part = deep[lo : lo + 64]
            for j, scores in zip(part, q[part] @ rows.T, strict=True):
                out[j] = self._best(every, scores, self_at.get(own[j]), k)
        return out

    def _best(self, at: np.ndarray, scores: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        if own is not None:
            other = at != own
            at, scores = at[other], scores[other]
        if len(at) > 4 * k:
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= bar
            at, scores = at[near], scores[near]
        order = np.lexsort((at, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda x: (-scores[x], at[x]))[:k], int)
        return at[order], scores[order]


def top_k(vectors: DataFrame, asks, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best vectors, all if there are fewer.

    `vectors` have vec_id and v (array of whole numbers); `asks` is the condition, a Column, for
    a row to be a query. A query meets the vectors of its own length, all rows but its own.
    Equal scores go to the smaller vec_id. Rows that repeat a vec_id are queries and candidates
    each. Scores are ranked exactly; one outside the range of a long is returned as that range's
    end. An empty table, or none that asks, gives an empty result.
    """
    marked = vectors.select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks"))
    sized = common.stored(marked.select(F.monotonically_increasing_id().alias("mark"), "vec_id", "v", "asks", F.size("v").alias("width")))
    plan = sized.groupBy("width").agg(
        F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"),
        F.ceil(F.sum(F.col("asks").cast("long")) / F.lit(QUERY_BLOCK)).cast("int").alias("query_blocks"),
    )
    plan = common.stored(plan.where("query_blocks > 0"))
    if plan.count() <= PLANNED:
        plan = F.broadcast(plan)
    placed = sized.join(plan, "width").withColumn("block", F.pmod(F.xxhash64("mark"), "blocks").cast("int"))
    placed = placed.withColumn("query_block", F.pmod(F.xxhash64("mark", F.lit(1)), "query_blocks").cast("int"))
    schema = "query long, query_id long, vec_id long, score long, exact string"

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        is_query = rows["role"].to_numpy() == 1
        out: list[tuple] = []
        if is_query.any() and not is_query.all():
            ids, marks, wide = rows["vec_id"].to_numpy(np.int64), rows["mark"].to_numpy(np.int64), rows["v"].to_numpy()
            least = [None if x is None or x != x else int(x) for x in rows["least"][is_query]]
            lists = SortedLists(ids[~is_query], marks[~is_query], np.stack(wide[~is_query]).astype(np.int64))
            found = lists.top(np.stack(wide[is_query]).astype(np.int64), marks[is_query], k, least)
            for mark, query_id, (at, scores) in zip(marks[is_query].tolist(), ids[is_query].tolist(), found, strict=True):
                for a, score in zip(lists.ids[at].tolist(), scores.tolist(), strict=True):
                    score = int(score)
                    out.append((mark, query_id, a, max(min(score, (1 << 63) - 1), -(1 << 63)), str(score)))
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "exact"]).astype({"query": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.int64, "exact": str})

    def cells(rows: DataFrame, queries: DataFrame) -> DataFrame:
        """Each block of `rows` with each block of `queries`."""
        columns = ["mark", "vec_id", "v", "least"]
        a = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).withColumn("least", F.lit(None).cast("string"))
        a = a.select(F.xxhash64("width", "block", "query_block").alias("cell"), F.lit(0).alias("role"), *columns)
        b = queries.select(F.xxhash64("width", "block", "query_block").alias("cell"), F.lit(1).alias("role"), *columns)
        return a.unionByName(b).groupBy("cell").applyInPandas(search, schema)

    asking = placed.where("asks")
    first = common.stored(cells(placed.where("block = 0"), asking.withColumn("block", F.lit(0)).withColumn("least", F.lit(None).cast("string"))))
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.min(F.col("exact").cast("decimal(38,0)")).alias("least")).where(F.col("n") >= k)
    known = asking.join(kth.select(F.col("query").alias("mark"), F.col("least").cast("string").alias("least")), "mark", "left")
    others = known.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    best = first.unionByName(cells(placed.where("block > 0"), others))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.col("exact").cast("decimal(38,0)")), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
