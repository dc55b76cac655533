"""Operator 6: exact top-k inner products by norm-bucketed retrieval.

Components become integers, floor(scale * x).  The vectors are grouped by their
length: a bucket holds lengths within a factor of ``STEP``, and a crowded bucket
is split by a hash of the id, so that no group is much larger than
``group_rows``.  A sample of the longest vectors gives every query a first
lower bound of its k-th score.  In a group that bound, divided by the query's
length and the group's greatest length, is a local cosine threshold:

* above 1, no vector of the group can be among the k best, and it is skipped;
* if high, *coordinate pruning*: a vector with that cosine must have its
  coordinate, where the query is strongest, within an interval about the
  query's, found by binary search in the sorted coordinate;
* else *length pruning*: only the vectors that are long enough are looked at.

What is left is verified by exact integer products.  Bounds are taken with a
margin for rounding, so nothing that could score enough is lost.  Each group
returns its k best for a query; a window merges them.

Queries are taken in blocks of about ``block_queries`` against all rows; a block
is what the driver holds and broadcasts.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part.  Vectors of unlike dimension are compared as
if the shorter one went on with zeros; a vector without components scores 0.
Ties go to the smaller id.  Rows that carry the query's id are its own and no
candidates; equal query rows are one query.  A query with fewer than k
candidates returns them all.  Scores beyond the range of a bigint are held at
its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, stored

STEP = 1.05  # lengths of a bucket are within this factor
COORDINATE_FROM = 0.6  # local cosine threshold from which coordinates are pruned
SEEDS = 2000  # longest vectors, for the first bounds
TILE = 64  # queries whose products are taken together
_EXACT = float(1 << 52)


def quantised(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer rows of ``c`` and ``q``: by floating
    point where every partial sum is exact, else by unbounded integers."""
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if bound < _EXACT:
        return (c.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    exact = c.astype(object) @ q.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -(1 << 63) else -scores[at]))][:k]


class Queries:
    """A block of queries with their lengths and lower bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.bounds = np.full(len(ids), -np.inf)  # of the k-th score

    def seed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), TILE):
            scores = products(vectors, self.vectors[at : at + TILE])
            for j in range(scores.shape[1]):
                own = scores[ids != self.ids[at + j], j]
                if len(own) >= self.k:
                    self.bounds[at + j] = float(np.partition(own, len(own) - self.k)[len(own) - self.k])

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, id, score) of the best of one group of vectors."""
        real = vectors.astype(np.float64)
        lengths = np.sqrt((real**2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        ids, vectors, lengths, real = ids[order], vectors[order], lengths[order], real[order]
        unit = real / np.maximum(lengths, 1e-300)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = self.bounds / (self.lengths * lengths[0])
        cosine[~(self.bounds > 0)] = -1.0  # no bound that could prune
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: list[tuple[int, int, int]] = []
        by_length = []
        for q in np.flatnonzero(cosine <= 1 + 1e-9).tolist():
            if cosine[q] < COORDINATE_FROM:
                by_length.append(q)
                continue
            direction = self.vectors[q] / self.lengths[q]
            f = int(np.abs(direction).argmax())
            if f not in sorted_by:
                by = np.argsort(unit[:, f], kind="stable")
                sorted_by[f] = by, unit[by, f]
            by, values = sorted_by[f]
            t, x = min(float(cosine[q]), 1.0), float(direction[f])
            spread = np.sqrt(max(0.0, 1 - x * x)) * np.sqrt(max(0.0, 1 - t * t)) + 1e-6
            at = by[np.searchsorted(values, x * t - spread) : np.searchsorted(values, x * t + spread, side="right")]
            # a coordinate beyond the query's own angle is nearer still
            if x * x > t * t:
                end = by[np.searchsorted(values, x * t + spread, side="right") :] if x > 0 else by[: np.searchsorted(values, x * t - spread)]
                at = np.concatenate([at, end])
            self._verify(q, np.sort(at), ids, vectors, found)
        for i in range(0, len(by_length), TILE):
            some = by_length[i : i + TILE]
            need = np.where(self.bounds[some] > 0, self.bounds[some] / np.maximum(self.lengths[some], 1e-300) * (1 - 1e-9), -1.0)
            upto = np.searchsorted(-lengths, -need, side="right")
            scores = products(vectors[: upto.max()], self.vectors[some])
            for j, q in enumerate(some):
                self._keep(q, scores[: upto[j], j], ids[: upto[j]], found)
        return found

    def _verify(self, q: int, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray, found: list) -> None:
        self._keep(q, products(vectors[at], self.vectors[q : q + 1])[:, 0], ids[at], found)

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray, found: list) -> None:
        good = (scores >= self.bounds[q]) & (ids != self.ids[q])
        scores, ids = scores[good], ids[good]
        found += [(q, int(ids[i]), int(scores[i])) for i in best(scores, ids, self.k)]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, group_rows: int = 20_000, block_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of every usable row of ``queries``."""
    spark = candidates.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(col(id_col).cast("bigint").alias("id"), col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        rows = rows.select("id", quantised(F.col("v"), scale).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return rows.select("id", "v", length.alias("length"))

    rows = prepared(candidates).withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(float(np.log(STEP))))).otherwise(F.lit(-1)).cast("int"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("bucket", F.ceil(F.col("n") / group_rows).alias("parts"))
    grouped = stored(rows.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("bucket", "part", "id", "v"), "topk-buckets")
    seeds = rows.orderBy(F.desc("length"), "id").limit(SEEDS).select("id", "v").collect()
    asked = prepared(queries).select("id", "v").distinct()
    n_blocks = max(1, -(-asked.count() // block_queries))
    out = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect() if n_blocks > 1 else asked.collect()
        part = _search_block(grouped, block, seeds, k, spark)
        part = stored(part, "topk-block") if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(grouped: DataFrame, block: list, seeds: list, k: int, spark) -> DataFrame:
    width = max([len(r["v"]) for r in [*block, *seeds]], default=0)
    block = sorted(block)
    queries = Queries(np.array([r["id"] for r in block], np.int64), matrix([r["v"] for r in block], width), k)
    if block and seeds:
        queries.seed(np.array([r["id"] for r in seeds], np.int64), matrix([r["v"] for r in seeds], width))
    shared = spark.sparkContext.broadcast(queries)

    def search(group: pa.Table) -> pa.Table:
        own, lists = shared.value, group.column("v").to_pylist()
        found = []
        if len(own.ids):
            # components that no query has meet zeros
            vectors = matrix([v[: own.vectors.shape[1]] for v in lists], own.vectors.shape[1])
            found = own.search(group.column("id").to_numpy(), vectors)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query", "vec_id", "score"))})

    hits = grouped.groupBy("bucket", "part").applyInArrow(search, "query bigint, vec_id bigint, score bigint")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, int(r["id"])) for i, r in enumerate(block)], "query bigint, query_id bigint")
    return ranked.join(F.broadcast(names), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
