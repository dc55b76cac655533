import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import op10_language_id

from .conftest import SF01, crc_remainder


def test_held_out_accuracy_and_contract(spark, docs):
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang", "text").collect()}
    got = op10_language_id(spark, SF01).collect()
    assert len(got) == len(truth)
    right = total = 0
    for r in got:
        assert r.held_out == (crc_remainder(r.doc_id, 4) == 2)
        assert 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == truth[r.doc_id].lang
    assert total > 100 and right / total >= 0.98


def test_pairs_within_a_family():
    """Three related languages and a foreign one: the family is chosen first."""
    import numpy as np

    texts = {"aa": "tala mila sola", "ab": "tala milo solo", "ac": "tale mile sole", "zz": "xyrq wvvk jqqz"}
    rng = np.random.default_rng(1)
    sample = [(k, langid.features(" ".join(rng.choice(t.split(), 20)))) for k, t in texts.items() for _ in range(30)]
    family_of = {"aa": "a", "ab": "a", "ac": "a"}
    x, lang = np.stack([v for _, v in sample]), np.array([k for k, _ in sample])
    fam = np.array([family_of.get(k, k) for k in lang])
    w = np.stack([langid.fit_machine(x, np.where(fam == f, 1.0, -1.0)) for f in ("a", "zz")])
    pairs = {}
    for a, b in (("aa", "ab"), ("aa", "ac"), ("ab", "ac")):
        own = (lang == a) | (lang == b)
        pairs[a, b] = langid.fit_machine(x[own], np.where(lang[own] == a, 1.0, -1.0))
    model = langid.Model(["a", "zz"], {"a": ["aa", "ab", "ac"], "zz": ["zz"]}, w, pairs)
    assert [p[0] for p in model.predict(list(texts.values()))] == list(texts)


def test_odd_texts(spark, docs, odd_docs, no_docs):
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    kept = langid.keep_known(odd_docs, labelled)
    assert kept.columns == odd_docs.columns
    texts = {r.text for r in kept.collect()}
    assert not texts & {None, "", " \t\n", "!!! ??? ..."} and {"a", "日本語 текст 🙂 mixed"} <= texts
    assert langid.keep_known(no_docs, labelled).collect() == []
    nothing = langid.fit(labelled.limit(0))
    out = odd_docs.select(langid.predict(F.col("text"), nothing, spark).alias("p")).collect()
    assert {(r.p.lang_pred, r.p.score) for r in out} == {("und", 0.0)}
    one = langid.fit(labelled.where("lang = 'de'"))
    assert one.predict(["hello", None])[0][0] == "de"


def test_nothing_to_learn_from_keeps_letters(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "123 !"), (3, None), (4, "日本")], "doc_id long, text string")
    none = df.selectExpr("doc_id AS id", "text", "CAST(NULL AS string) AS lang")
    assert [r.doc_id for r in langid.keep_known(df, none).orderBy("doc_id").collect()] == [1, 4]


def test_copies_of_a_row_count_once(spark):
    """A row that makes up most of the table, ids missing among them."""
    many = [(1, "das ist ein haus", "de")] * 3000 + [(None, "the cat sat", "en")] * 500 + [(i, f"the house number {i}", "en") for i in range(9)]
    labelled = spark.createDataFrame(many, "id long, text string, lang string").repartition(7)
    sample = langid.fit_sample(labelled, per_language=50)
    assert sorted(lang for lang, _ in sample) == ["de"] + ["en"] * 10
    model = langid.fit(labelled)
    assert [p[0] for p in model.predict(["das haus", "the house"])] == ["de", "en"]


def test_no_language_is_left_out_silently(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26) * 4}", f"l{i:03}") for i in range(501)]
    labelled = spark.createDataFrame(rows, "id long, text string, lang string")
    with pytest.raises(ValueError, match="over 500 languages"):
        langid.fit_sample(labelled)
    assert len({lang for lang, _ in langid.fit_sample(labelled, most_languages=501)}) == 501
