"""Chunking, sentence, preview and title semantics, including the quirks the
reference has (chunk tail, newline arm, casefold, title case after digits)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import text as X


@pytest.mark.parametrize("n,spans", [
    (0, []), (1, [(0, 1)]), (450, [(0, 450)]), (451, [(0, 451), (450, 451)]), (500, [(0, 500), (450, 500)]),
    (501, [(0, 500), (450, 501)]), (900, [(0, 500), (450, 900)]), (901, [(0, 500), (450, 901), (900, 901)])])
def test_chunk_edge_cases(spark, n, spans):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, "s", " ".join(words))], "doc_id long, source string, text string")
    rows = X.chunk_documents(df).orderBy("chunk").collect()
    assert [r["text"].split() for r in rows] == [words[a:b] for a, b in spans]


def test_chunk_number_on_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    got = {}
    for r in X.chunk_documents(docs).collect():
        got.setdefault(r["doc_id"], {})[r["chunk"]] = r["text"].split()
    for r in docs.collect():
        words, own = r["text"].split(), got.get(r["doc_id"], {})
        assert sorted(own) == list(range(math.ceil(len(words) / 450)))
        # without the 50 words that each chunk repeats, the chunks are the text
        assert [w for i in sorted(own) for w in own[i][:450]] == words


def test_every_word_lands_in_a_chunk(spark):
    text = " ".join(f"w{i}" for i in range(1234))
    df = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    covered = set(" ".join(r["text"] for r in X.chunk_documents(df).collect()).split())
    assert covered == set(text.split())


@pytest.mark.parametrize("text,sentences", [
    ("First one. Second one!  Third?\nFourth line\n\nFifth. ",
     ["First one.", "Second one!", "Third?", "Fourth line", "Fifth."]),
    ("  Heading\nBody text without end", ["Heading", "Body text without end"]),
    ("a . b", ["a .", "b"]),
    ("Dr. Smith arrived.\tThen left.", ["Dr.", "Smith arrived.", "Then left."]),
    ("tab\x0bvertical and\x1cfile separator are Python whitespace. Next",
     ["tab\x0bvertical and\x1cfile separator are Python whitespace.", "Next"]),
    ("", [])])
def test_sentences(spark, text, sentences):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.sentences("t")).first()[0] == sentences


def test_words_and_strip_use_python_whitespace(spark):
    s = "　a b\x1cc  d "
    r = spark.createDataFrame([(s,)], "t string").select(T.words("t").alias("w"), T.strip_ws("t").alias("s")).first()
    assert r["w"] == s.split()
    assert r["s"] == s.strip()


def test_preview(spark):
    text = "  many\n\nspaces   here " + "x" * 400
    r = spark.createDataFrame([(text,)], "t string").select(T.preview("t").alias("p")).first()
    assert r["p"] == " ".join(text.split())[:300] + "..."


def test_casefold_sharp_s(spark):
    r = spark.createDataFrame([("Straße",), ("STRASSE",)], "t string").select(T.casefold("t").alias("f")).collect()
    assert r[0]["f"] == r[1]["f"] == "strasse" == "Straße".casefold()


@pytest.mark.parametrize("name", ["code_review_process.txt", "x2y_report.txt", "o'neil notes.txt", "q4_results.txt"])
def test_document_title_is_python_title(spark, name):
    df = spark.createDataFrame([(name, "  body \n")], "filename string, text string")
    r = X.document_table(df).first()
    assert r["title"] == name.replace(".txt", "").replace("_", " ").title()
    assert r["content"] == "body"


def test_corpus_dedup_keeps_first_copy(spark):
    rows = [(1, "s", 0, "Same Sentence."), (2, "s", 3, "same sentence."), (3, "s", 0, "Other."),
            (0, "t", 5, "Same sentence.")]
    df = spark.createDataFrame(rows, "doc_id long, source string, pos int, sentence string")
    out = {(r["source"], r["sentence"]): (r["doc_id"], r["copies"]) for r in X.dedup_sentences(df).collect()}
    assert out[("s", "Same Sentence.")] == (1, 2)
    assert out[("t", "Same sentence.")] == (0, 1)
    assert len(out) == 3
