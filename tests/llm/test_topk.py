import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk
from tessera.llm.queries import op6_topk

from .conftest import SF01


def plain(rows, queries, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in good if i in queries}:
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert got(op6_topk(spark, SF01)) == plain(rows, {i for i, _ in rows if i % 100 == 0})


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (9, [-1.0, 0.5]), (9, [-1.0, 0.5]), (None, [1.0, 1.0]), (100, [1e15, -1e15]), (200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("bucket", F.lit("clash")).withColumn("score", F.lit(1))
    for k in (1, 3, 10):
        out = got(topk.top_k(df, df.where("vec_id % 100 = 0"), k))
        assert out == plain(rows, {0, 100, 200}, k)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []
    assert topk.top_k(df, df.limit(0)).collect() == []


def test_pruning_is_exact_on_unlike_lengths_blocks_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1200, 6)) * np.exp(rng.normal(size=(1200, 1)) * 1.5)
    near = base[rng.integers(0, 20, 400)] * (1 + 0.01 * rng.normal(size=(400, 6)))
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.concatenate([base, near, np.repeat(base[:1], 300, axis=0)]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), 10, group_rows=100, block_queries=16)
    assert got(out) == plain(rows, {i for i, _ in rows if i % 50 == 0})
