"""Approximate nearest neighbours by a trained index, with recall against R1.

The index is trained on a bounded sample: the ``sample_rows`` rows whose keys have
the smallest md5 (``SAMPLE_ROWS`` unless given).  A few Lloyd steps from its first
rows give the ``n_lists`` list centres.  What is left of a vector after its centre
is cut into pieces, and a few Lloyd steps per piece give codebooks (a residual
product quantiser), so a row's code is one small number a piece.

Every row of the collection is indexed: its list, its code and its vector are
written once to shared storage, partitioned by list.  A question probes its
``n_probe`` nearest lists and reads only the codes there.  A list's centre and a
code's book entries add up to the coded vector, so the estimated distances of
many questions to many rows are one matrix product, exact as long as the numbers
are under 2**53 (else integers are multiplied).  Each task holds the keys and codes
of its part and gives a question's ``shortlist`` best as one row.  Only the vectors
of the merged short list are fetched and scored exactly, block by block of the
questions, whose vectors are broadcast and not shuffled.  No question x candidate
pairs are materialised, and nothing is grouped by list, so a list that holds a
third of the collection is still spread over many tasks.

Training, lists and codes are exact integer arithmetic on ``floor(scale * x)``,
with ties to the smaller number, so the result is the same on every run and
engine.  With every list probed and a short list as long as the collection, the
search is exact (tested).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knn import DEFAULT_BLOCK_ROWS, MERGE_WAYS, _exact_l2, question_blocks, usable
from tessera.session import scratch_path

SAMPLE_ROWS = 20_000  # rows on the driver for training
SCALE = 1024
LIST_STEPS, CODE_STEPS = 3, 2  # Lloyd steps
N_CODES = 16
_TILE, _ROWS = 256, 8192  # questions and rows scored together
_PART_ROWS = 1 << 17  # rows of a task from which their number follows the collection's
_PAIRS = 1 << 16  # exact distances computed together


def integers(vectors) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    return np.floor(SCALE * np.stack(rows)).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to each of a few centres."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def lloyd(points: np.ndarray, centres: np.ndarray, steps: int) -> np.ndarray:
    """Integer means, rounded down; a centre without points stays."""
    for _ in range(steps):
        own = squares(points, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """List centres, and for each piece of ``width`` components its codebook.
    Its size is (n_lists + N_CODES) vectors, whatever the collection's."""

    centres: np.ndarray
    books: list
    width: int

    @classmethod
    def train(cls, sample: np.ndarray, n_lists: int, width: int) -> Index:
        centres = lloyd(sample, sample[:n_lists], LIST_STEPS)
        rest = sample - centres[squares(sample, centres).argmin(axis=1)]
        pieces = [rest[:, at:at + width] for at in range(0, sample.shape[1], width)]
        return cls(centres, [lloyd(p, p[:N_CODES], CODE_STEPS) for p in pieces], width)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of every point."""
        lists = squares(points, self.centres).argmin(axis=1)
        rest = points - self.centres[lists]
        codes = [squares(rest[:, i * self.width:(i + 1) * self.width], book).argmin(axis=1) for i, book in enumerate(self.books)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def probes(self, points: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of every point, nearest first."""
        return np.argsort(squares(points, self.centres), axis=1, kind="stable")[:, :n].astype(np.int32)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The coded vectors: every list's centre and the code's book entries."""
        out = self.centres[lists]
        for i, book in enumerate(self.books):
            out[:, i * self.width:(i + 1) * self.width] += book[codes[:, i]]
        return out


def build_index(collection: DataFrame, ckey: str, vector: str, n_lists: int, width: int = 2,
                sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Index | None]:
    """Train, write (ckey, _v, _code, _list) partitioned by list, and return it
    with the trained part (None for a collection without usable vectors)."""
    spark = collection.sparkSession
    rows = collection.select(ckey, F.col(vector).cast("array<double>").alias("_v")).filter(usable("_v"))
    sample = rows.orderBy(F.md5(F.col(ckey).cast("string")), ckey).limit(sample_rows).select("_v").toLocalIterator()
    sample = integers(np.array(r["_v"]) for r in sample)
    index = Index.train(sample, n_lists, width) if len(sample) else None
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("struct<_code:binary,_list:int>")
    def assign(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("_code", pa.binary()), ("_list", pa.int32())]))
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        lists, codes = shared.value.encode(np.floor(SCALE * flat.reshape(len(vectors), -1)).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists, pa.int32())], ["_code", "_list"])

    path = scratch_path(spark, "ivf-index")
    assigned = rows.withColumn("_a", assign("_v")).select(ckey, "_v", "_a._code", "_a._list")
    assigned.write.partitionBy("_list").parquet(path)
    return spark.read.schema(assigned.schema).parquet(path), index


class _Estimates:
    """Integer points and coded vectors; ``tile`` gives numbers (larger first) that
    differ from minus the squared distance by a constant of the question."""

    def __init__(self, points: np.ndarray, coded: np.ndarray):
        def size(x):
            return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))

        self.kind = np.float64 if (size(points) + size(coded)) ** 2 < 2.0 ** 52 else np.int64
        self.sq = (points ** 2).sum(axis=1)
        self.left = np.append(2 * points, np.full((len(points), 1), -1), axis=1).astype(self.kind)
        self.right = np.append(coded, (coded ** 2).sum(axis=1, keepdims=True), axis=1).astype(self.kind)

    @property
    def least(self):
        return -np.inf if self.kind is np.float64 else np.iinfo(np.int64).min

    def tile(self, q: slice, rows: slice) -> np.ndarray:
        return self.left[q] @ self.right[rows].T


def _key_order(keys: pd.Series) -> np.ndarray:
    """Row numbers by key, null keys first as in Spark."""
    null = keys.isna().to_numpy()
    known = np.flatnonzero(~null)
    return np.concatenate([np.flatnonzero(null), known[np.argsort(keys.to_numpy()[known], kind="stable")]])


def _equal_keys(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last places of the wanted keys among sorted keys without nulls."""
    known = ~pd.isna(wanted)
    first, last = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    first[known], last[known] = (np.searchsorted(keys, wanted[known], side) for side in ("left", "right"))
    return first, last


def _make_scan(shared, index, shortlist: int, ckey: str, exclude_self: bool):
    def scan(batches):
        qkeys, vectors, probes = shared.value  # probes: questions x n_probe list ids
        trained, Q = index.value, integers(vectors)
        parts = [(pdf[ckey], b"".join(pdf["_code"]), pdf["_list"].to_numpy()) for pdf in batches if len(pdf)]
        if not parts:
            return
        keys, lists = pd.concat([p[0] for p in parts], ignore_index=True), np.concatenate([p[2] for p in parts])
        codes = np.frombuffer(b"".join(p[1] for p in parts), np.uint8).reshape(len(keys), -1)
        order = _key_order(keys)
        lists, est = lists[order], _Estimates(Q, trained.decode(lists[order], codes[order]))
        n_null, keys = int(keys.isna().sum()), keys.to_numpy()[order]
        probed = np.zeros((len(Q), len(trained.centres)), bool)
        probed[np.arange(len(Q))[:, None], probes] = True
        first, last = _equal_keys(keys[n_null:], qkeys)
        way = TaskContext.get().partitionId() % MERGE_WAYS
        for q0 in range(0, len(Q), _TILE):
            q = slice(q0, min(q0 + _TILE, len(Q)))
            r, c, t = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, est.kind)
            edge = np.full(q.stop - q0, est.least, est.kind)
            for r0 in range(0, len(keys), _ROWS):
                rows = slice(r0, r0 + _ROWS)
                T = est.tile(q, rows)
                T[~probed[q][:, lists[rows]]] = est.least
                if exclude_self:
                    start, stop = (np.clip(x[q] + n_null - r0, 0, T.shape[1]) for x in (first, last))
                    for i in np.flatnonzero(stop > start):
                        T[i, start[i]:stop[i]] = est.least
                if T.shape[1] > shortlist:  # what is under the tile's own last cannot come in
                    none = np.flatnonzero(edge == est.least)
                    edge[none] = np.partition(T[none], -shortlist, axis=1)[:, -shortlist]
                at = np.flatnonzero((T >= edge[:, None]) & (T > est.least))
                if not len(at):
                    continue
                new = np.divmod(at, T.shape[1])
                r, c, t = np.append(r, new[0]), np.append(c, new[1] + r0), np.append(t, T.ravel()[at])
                best = np.lexsort((c, -t, r))  # rows are in key order
                r, c, t = r[best], c[best], t[best]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                edge[r[nth == shortlist - 1]] = t[nth == shortlist - 1]
                r, c, t = (x[nth < shortlist] for x in (r, c, t))
            if len(r):
                asked, at = np.unique(r, return_index=True)
                yield pd.DataFrame({"qkey": qkeys[q][asked], "_way": way, "_k": np.split(keys[c], at[1:]),
                                    "_d": np.split(est.sq[q][r] - t.astype(np.int64), at[1:])})

    return scan


def _make_exact(shared, ckey: str):
    """Squared L2 distances of rows (qkey, key, _v) to the block's questions."""

    def exact(batches):
        qkeys, asked, _ = shared.value
        order = _key_order(pd.Series(qkeys))
        for pdf in batches:
            if len(pdf):
                first, last = _equal_keys(qkeys[order], pdf["qkey"].to_numpy())
                n, vectors = last - first, np.stack(pdf["_v"].to_numpy())
                row = np.repeat(np.arange(len(pdf)), n)
                place = order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)]
                score = [_exact_l2(asked[place[i:i + _PAIRS]], vectors[row[i:i + _PAIRS]]) for i in range(0, len(row), _PAIRS)]
                yield pdf[["qkey", ckey]].iloc[row].assign(score=np.concatenate([np.zeros(0), *score]))

    return exact


def _short(cand: DataFrame, shortlist: int) -> DataFrame:
    """(qkey, _k0) of the tasks' lists merged, within groups of tasks first."""
    def least(lists):
        return F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, shortlist).alias("best")

    cand = cand.select("qkey", "_way", F.arrays_zip(F.col("_d"), F.col("_k")).alias("best"))
    cand = cand.groupBy("qkey", "_way").agg(least("best")).groupBy("qkey").agg(least("best"))
    return cand.select("qkey", F.explode("best").alias("_b")).select("qkey", F.col("_b._k").alias("_k0"))


def ann_nearest(collection: DataFrame, questions: DataFrame, k: int, *, ckey: str, qkey: str, vector: str,
                n_lists: int, n_probe: int, shortlist: int, width: int = 2, qvector: str | None = None,
                exclude_self: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Approximate top-``k`` by squared L2: (qkey, ckey, score, rank); ``score`` is
    exact, as R1's, and ``shortlist`` rows a question are scored exactly.  Keys of
    the collection identify its rows."""
    qvector = qvector or vector
    spark = collection.sparkSession
    rows, index = build_index(collection, ckey, vector, n_lists, width, sample_rows)
    qtype, ctype = questions.schema[qkey].dataType, collection.schema[ckey].dataType
    listed = T.StructType([
        T.StructField("qkey", qtype), T.StructField("_way", T.IntegerType()),
        T.StructField("_k", T.ArrayType(ctype)), T.StructField("_d", T.ArrayType(T.LongType())),
    ])
    out_schema = T.StructType([T.StructField("qkey", qtype), T.StructField(ckey, ctype), T.StructField("score", T.DoubleType())])
    scored = spark.createDataFrame([], out_schema)
    asked = questions.select(qkey, F.col(qvector).cast("array<double>").alias("_q")).filter(usable("_q") & F.col(qkey).isNotNull())
    trained = spark.sparkContext.broadcast(index)
    # a question key's rows are in one block, as its lists are merged there
    n_blocks, blocks = question_blocks(asked, qkey, "_q", block_rows, by=("_q",))
    # few large parts: each gives every question a short list
    n_parts = max(-(-rows.count() // _PART_ROWS), -(-3 * spark.sparkContext.defaultParallelism // n_blocks))
    for pdf in blocks if index else ():
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["_v"]])
        probes = index.probes(integers(vectors), n_probe)
        shared = spark.sparkContext.broadcast((pdf["_q"].to_numpy(), vectors, probes))
        read = rows.filter(F.col("_list").isin(np.unique(probes).tolist())).select(ckey, "_code", "_list").coalesce(n_parts)
        short = _short(read.mapInPandas(_make_scan(shared, trained, shortlist, ckey, exclude_self), listed), shortlist)
        met = rows.select(ckey, "_v").join(short.withColumnRenamed("_k0", ckey), ckey).select("qkey", ckey, "_v")
        scored = scored.unionByName(met.mapInPandas(_make_exact(shared, ckey), out_schema))
    rank = F.row_number().over(Window.partitionBy("qkey").orderBy("score", ckey))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("qkey", qkey)


def recall(approx: DataFrame, exact: DataFrame, qkey: str, ckey: str, k: int) -> DataFrame:
    """Per question: how many of the exact top-k the approximate search found."""
    hits = exact.select(qkey, ckey).join(approx.select(qkey, ckey, F.lit(1).alias("_hit")), [qkey, ckey], "left")
    return hits.groupBy(qkey).agg(F.count("_hit").alias("ann_hits"),
                                  (F.count("_hit") / F.lit(float(k))).alias("recall"))
