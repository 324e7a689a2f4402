"""Exact top-k search with an impact-ordered index, processed score at a time.

Vectors of whole numbers, inner product. In a block of candidates every dimension has
its postings in segments of nearly equal value, so that a segment has one quantised
impact for a query: what its values add at least over the least that the dimension can
add. The segments of all dimensions are processed by descending impact, in a few steps and for some
queries together. At any time a candidate's score lies between what it has gathered and that plus the greatest
impacts still open in each dimension. A query is settled only when this proves that few
candidates can still be among the k best, or all segments are processed; these are rescored exactly. The k-th score
of earlier blocks is carried along as a bound.

Null vectors and such with null, NaN or infinite components take no part, nor do rows
whose id is null; vectors of another length than the query's are not compared with it.
Ties go to the smaller id; of rows with one id each is a candidate of its own, and none
of them a candidate for a query of that id. Empty input gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.common import checkpoint

#: Queries that are sent to the workers at once, candidates of a block of the index, segments of a dimension.
QUERY_BLOCK, INDEX_BLOCK, LEVELS = 20_000, 16_384, 96
#: Queries that a block meets at once, and steps in which it processes its segments.
TOGETHER, STEPS = 128, 4
#: Stands for a bound that is not known yet.
NONE = -(2**62)


def whole(vectors: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # coalesce: with a null among them, exists says null instead of true
    return F.when(vectors.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vectors, lambda x: F.floor(x.cast("double") * scale)))


class ImpactIndex:
    """Postings of one block: ids, and X of shape (candidates, dimensions), both int64.

    A positive component of a query adds the more the higher a value is, a negative one the more the lower it is. So
    each dimension has two halves, in which segments add at least ``sure`` and at most ``can``, per unit of the query, over
    the least that the dimension can add.
    """

    def __init__(self, ids: np.ndarray, X: np.ndarray, levels: int = LEVELS):
        self.ids, self.X = ids, X
        n = len(ids)
        order = np.argsort(X, axis=0, kind="stable")  # per dimension, ascending
        cuts = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(np.int64))
        ranked = np.take_along_axis(X, order, axis=0)
        low, high = ranked[cuts[:-1]], ranked[cuts[1:] - 1]  # least and greatest value of each segment
        segment = np.empty(X.shape, np.int64)
        np.put_along_axis(segment, order, np.repeat(np.arange(len(low)), np.diff(cuts))[:, None], axis=0)
        self.segment = np.hstack([segment, segment])
        self.least = np.hstack([low[0], -high[-1]])
        self.sure, self.can = np.hstack([low - low[0], high[-1] - high]), np.hstack([high - low[0], high[-1] - low])

    def search(self, queries: np.ndarray, k: int, least: list[int | None], own: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each row of ``queries`` (score negated, id) of the k best; candidates below its ``least`` may be missing.

        The queries share the order of segments, that of the greatest impact for any of them; one product
        of matrices adds what a step's segments have for all queries that are not settled.
        """
        ids, n = self.ids, len(self.ids)
        weight = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)])
        # Whole numbers below 2 ** 53 are exact as doubles, which multiply faster.
        top = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(self.can.max(initial=0))
        kind = np.float64 if top < 2**52 else np.int64
        base = (weight * self.least).sum(axis=1)
        floor = np.array([NONE if x is None else x - int(b) for x, b in zip(least, base)], kind)
        impact = self.can * weight.max(axis=0)
        step_of = np.empty(impact.size, np.int64)
        step_of[np.argsort(-impact, axis=None, kind="stable")] = np.arange(impact.size) * STEPS // max(1, impact.size)
        step_of, halves = step_of.reshape(impact.shape), np.arange(impact.shape[1])
        live, weight = np.arange(len(queries)), weight.astype(kind)
        self_rows = ids[None, :] == own[:, None]  # rows of the query's own id are no candidates, however many there are
        enough = n - self_rows.sum(axis=1) >= k
        sure, most = np.zeros((len(queries), n), kind), np.zeros((len(queries), n), kind)
        found: list[list[tuple[int, int]]] = [[]] * len(queries)
        for step in range(STEPS):
            now = step_of == step
            sure += weight @ np.where(now, self.sure, 0)[self.segment, halves].astype(kind).T
            most += weight @ np.where(now, self.can, 0)[self.segment, halves].astype(kind).T
            sure[self_rows] = -1
            left = weight @ np.where(step_of > step, self.can, 0).max(axis=0).astype(kind)  # greatest impacts still open
            bound = floor
            if k <= n:
                bound = np.where(enough, np.maximum(floor, np.partition(sure, n - k, axis=1)[:, n - k]), floor)
            possible = (most >= (bound - left)[:, None]) & ~self_rows
            done = possible.sum(axis=1) <= max(4 * k, n // 50) if step < STEPS - 1 else np.ones(len(live), bool)
            for j in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(possible[j])
                score = self.X[rows] @ queries[live[j]]
                found[live[j]] = heapq.nsmallest(k, zip((-score).tolist(), ids[rows].tolist()))
            if done.any():
                keep = ~done
                live, weight, floor, enough, self_rows, sure, most = (x[keep] for x in (live, weight, floor, enough, self_rows, sure, most))
                if not len(live):
                    break
        return found


def _search(rows: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """The k best in each task for each of the queries that ``sent`` has: (vec_id, components)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[int, int]]] = {}
        held, size = [], 0
        asked: dict[int, list[int]] = {}
        for j, (_, q) in enumerate(sent.value):
            asked.setdefault(len(q), []).append(j)

        def block() -> None:
            pdf = pd.concat(held)
            for dims, part in pdf.groupby(pdf["v"].map(len)):
                ids = part["vec_id"].to_numpy(np.int64)
                # The block is a whole: the order of rows in it is free.
                index = ImpactIndex(ids, np.array(part["v"].tolist(), np.int64).reshape(len(ids), dims))
                queries = asked.get(dims, [])
                for at in range(0, len(queries), TOGETHER):
                    some = queries[at : at + TOGETHER]
                    old = [best.get(j, []) for j in some]
                    least = [-x[-1][0] if len(x) == k else None for x in old]
                    new = index.search(np.array([sent.value[j][1] for j in some]), k, least, np.array([sent.value[j][0] for j in some]))
                    best.update({j: heapq.nsmallest(k, x + y) for j, x, y in zip(some, old, new)})

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= INDEX_BLOCK:
                block()
                held, size = [], 0
        if size:
            block()
        out = [(sent.value[j][0], j, i, -s) for j, found in best.items() for s, i in found]
        yield pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

    return rows.mapInPandas(run, "query_id long, query_row long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id ``every`` divides, among all others.

    The queries are a stated set, met by all rows in blocks of a bounded number: each
    block is one pass over the vectors that leaves k rows for each query and task.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v")).filter("vec_id is not null and v is not null")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // query_block))
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b) if blocks > 1 else asked
        got = own.toArrow().sort_by("vec_id")
        sent = rows.sparkSession.sparkContext.broadcast([(i, np.array(v.as_py(), np.int64)) for i, v in zip(got["vec_id"].to_pylist(), got["v"])])
        del got
        part = _search(rows, sent, k).withColumn("query_row", F.struct(F.lit(b).alias("b"), F.col("query_row").alias("j")))
        if blocks > 1:
            # A block is done, with k rows for each query and task, before the next one's queries are fetched.
            part = checkpoint(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    # Each task has its k best; the rank over these is found in two steps, for no query's rows of all tasks to meet unthinned.
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
