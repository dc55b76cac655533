import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.queries import op12_quality

from .conftest import SF01

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in text or "":
        if c in SPACES:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def counts(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines)


def base_failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def plain(rows):
    """(id, counts, base_failed, kept), fences from sorted values, each replaced
    by the value of its bucket."""
    step = math.log(1.01 / 0.99)

    def held(x):
        return math.exp(math.ceil(math.log(x) / step) * step) * 2 / (1 + math.exp(step)) if x > 0 else 0.0

    found = [(i, lang, source, counts(t)) for i, t, lang, source in rows]
    ratio = {
        "symbols": lambda c: c[2] / c[0],
        "letters": lambda c: c[1] / c[0],
        "lines": lambda c: c[3] / max(1, c[5]),
    }
    least = {"symbols": 0.05, "letters": 0.5, "lines": 0.15}
    groups = defaultdict(list)
    for _, lang, source, c in found:
        if c[0]:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(c)
    limits = {}
    for key, own in groups.items():
        if len(own) >= 200:
            for m, f in ratio.items():
                values = sorted(map(f, own))
                q1, q3 = (held(values[math.floor(s * (len(values) - 1))]) for s in (0.25, 0.75))
                limits[key, m] = q1, q3, 3 * max(q3 - q1, least[m])
    out = []
    for i, lang, source, c in found:
        bad = base_failed(c)
        good = not bad
        for m, f in ratio.items() if good else ():
            own = next((limits[k, m] for k in ((lang, source), (lang,), ()) if (k, m) in limits), None)
            if own:
                reach = own[2] * math.sqrt(max(1.0, 50 / c[0]))
                good &= (m != "letters" or f(c) >= own[0] - reach) and f(c) <= own[1] + reach
        out.append((i, *c[:5], bad, good))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def digest(judged):
    return judged.select("row.doc_id", *[f"counts.{n}" for n in quality.COUNTS[:5]], "base_failed", "kept")


def test_query_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert got(op12_quality(spark, SF01).drop("failed")) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("counts", F.lit("clash")).withColumn("salt", F.lit(1)).withColumn("kept", F.lit(1))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert got(digest(quality.judge(docs))) == plain(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in plain(rows))
    assert quality.judge(no_docs).collect() == []


def test_fences_of_groups_and_fallbacks(spark, no_docs):
    """Own fences of a large group, its language's of a small one, those of all
    texts elsewhere; one source holds most rows."""
    rng = np.random.default_rng(0)
    texts = [(" ".join("w" * int(rng.integers(1, 6)) + str(rng.integers(10, 99)) + "#" * int(k < 0.02) for k in rng.random(40)), "en", "big") for _ in range(900)]
    texts += [(" ".join("#" * 3 + "w" * int(n) + str(rng.integers(10, 99)) for n in rng.integers(1, 6, 40)), "en", "marked") for _ in range(250)]
    texts += [("#### " * 20 + "abcd " * 10, lang, source) for lang in ("en", "xx", None) for source in ("big", "marked", "small", None)]
    rows = [(i, *t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, lang, source, 1) for i, t, lang, source in rows], no_docs.schema)
    out = got(digest(quality.judge(df.repartition(7))))
    assert out == plain(rows)
    kept = {r[0]: r[-1] for r in out}
    assert sum(kept[i] for i in range(900, 1150)) == 250 and not kept[1150]


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.exp(rng.normal(size=4000)), np.zeros(500), [1e-12, 1e12]])
    df = spark.createDataFrame([(i % 5, float(v)) for i, v in enumerate(values)], "g int, v double")
    parts = quality.sketches(df, ["g"], {"v": F.col("v")})
    whole = quality.quantiles(quality.merge(parts, []), [], {"a": 0.0, "b": 0.3, "c": 0.99, "d": 1.0}).first()
    assert whole.n == len(values)
    for share, found in zip((0.0, 0.3, 0.99, 1.0), whole[2:]):
        true = np.sort(values)[math.floor(share * (len(values) - 1))]
        assert abs(found - true) <= 0.0100001 * true


@pytest.mark.parametrize("n", [0, 1, 30])
def test_repeated_words(n):
    rng = np.random.default_rng(n)
    texts = [[b"%d" % x for x in rng.integers(0, 2 + 5 * (k % 2), int(rng.integers(0, 60)))] for k in range(n)]
    want = [counts(b" ".join(t).decode())[4] for t in texts]
    assert quality.repeated_words(texts).tolist() == want
