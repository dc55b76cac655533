import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.queries import op8_simhash

from .conftest import SF01


def plain_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits=3):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits) + i + 1:
            a, b = find(v), find(values[j])
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_query_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in op8_simhash(spark, SF01).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    roots = plain_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    assert len(got) == len(rows)
    for i, f in fps.items():
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == least[roots[f]]


def test_links_of_crowded_fingerprints_with_and_without_levels(spark):
    """Clusters so dense that signatures go to the lower levels."""
    rng = random.Random(5)
    values = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(3000):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(2000)}
    df = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp bigint")
    want = plain_components(values)
    for limit in (2048, 16_384):
        edges = simhash.links(df, 3, limit)
        rows = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in edges.collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in rows)
        roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(edges).collect()}
        groups = {}
        for v in values:
            groups.setdefault(roots.get(v, v), set()).add(v)
        expected = {}
        for v, r in want.items():
            expected.setdefault(r, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    out = simhash.near_duplicates(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert by["0" * 16] == {0}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_row_of_each_component_stays(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    components = {r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert sorted(ids) == sorted(components)
    assert simhash.keep_one(no_docs).collect() == []
    only_null = odd_docs.where(F.col("doc_id").isNull())
    assert len(simhash.keep_one(only_null).collect()) == 2
