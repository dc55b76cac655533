import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import WORD_TABLE, byte_words
from tessera.llm.queries import op7_toxicity, toxicity_model

from .conftest import SF01, crc_remainder


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 5, 1, 4])
    odds, start, moves = rng.normal(size=13) * 2, 0.4, rng.normal(size=(2, 2))
    got = np.split(toxicity.Chains(lengths).marginals(odds, start, moves), np.cumsum(lengths)[:-1])
    for n, own, o in zip(lengths, got, np.split(odds, np.cumsum(lengths)[:-1])):
        want, total = np.zeros(n), 0.0
        for tags in itertools.product((0, 1), repeat=int(n)):
            if not tags:
                continue
            w = np.exp(start * tags[0] + sum(o[i] for i in range(n) if tags[i]) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            want += w * np.array(tags)
        if n:
            assert np.allclose(own, want / total)


def test_fit_follows_the_gradient():
    """Tags that depend on the word and on the tag before are learnt."""
    pieces = [([b"bad", b"thing", b"here", b"nice"], [1, 1, 0, 0]), ([b"nice", b"thing", b"here"], [0, 0, 0])] * 40
    w, start, moves = toxicity.fit_chain(pieces)
    model = toxicity.Model(w, start, moves, None)
    p = model.marginals([[b"bad", b"thing", b"here"], [b"nice", b"thing"]], {})
    assert [x > 0.5 for x in p[0]] == [True, True, False] and max(p[1]) < 0.5


@pytest.fixture(scope="module")
def model(spark):
    return toxicity_model(spark, SF01, spark.read.parquet(f"{SF01}/documents.parquet"))


def test_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = op7_toxicity(spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    wrong = total = 0
    for r in got:
        assert r.held_out == (crc_remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            total += 1
            wrong += r.predicted != labels[r.doc_id]
    assert total > 80 and wrong / total <= 0.05


def test_spans_and_odd_texts(spark, model, odd_docs, no_docs):
    text = "é nice words, then scum, worthless idiot! and nice"
    df = spark.createDataFrame([(text,)], "text string")
    r = df.select(toxicity.tag(F.col("text"), model, spark).alias("f")).first().f
    assert any(text[s.start : s.end] in ("scum, worthless idiot", "worthless idiot", "scum") for s in r.spans)
    kept = toxicity.keep_clean(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.keep_clean(no_docs, model).collect() == []


def test_nothing_to_learn(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    none = toxicity.fit(odd_docs, labels, F.lit(True))
    assert {r.f.score for r in odd_docs.select(toxicity.tag(F.col("text"), none, spark).alias("f")).collect()} == {0.0}


def test_offsets_with_capitals():
    text = "I SAID you are SCUM indeed, Scum É idiot USA"
    words = byte_words(text)
    for i, w in enumerate(words):
        at = toxicity.offsets(text, np.arange(len(words)) == i)
        assert [text[x["start"] : x["end"]].encode().translate(WORD_TABLE) for x in at] == [w]
    assert toxicity.offsets(text, np.array([w == b"scum" for w in words])) == [{"start": 15, "end": 19}, {"start": 28, "end": 32}]


def test_one_id_with_a_third_of_the_rows(spark, docs):
    """Copies and versions of one drawn id: one text of it is learned from."""
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    plain = docs.select("doc_id", "text")
    hot = plain.where("doc_id = 0").crossJoin(spark.range(plain.count() // 2).withColumnRenamed("id", "copy"))
    hot = hot.select("doc_id", F.concat("text", F.lit(" "), (F.col("copy") % 3).cast("string")).alias("text"))
    model = toxicity.fit(plain.where("doc_id <> 0").unionByName(hot), labels, F.lit(True))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = plain.select("doc_id", toxicity.tag(F.col("text"), model, spark).alias("f")).collect()
    wrong = [r.doc_id for r in got if r.doc_id in truth and (r.f.score >= 0.7) != (truth[r.doc_id] == 1)]
    assert len(wrong) <= 0.05 * len(got)
