import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.queries import RANKS, op1_byte_bpe

from .conftest import SF001, SF01


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_tiktoken_on_whole_table(spark, docs, reference):
    got = {r.doc_id: r for r in op1_byte_bpe(spark, SF01).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        row = got[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_texts(spark, odd_docs, reference):
    coder = bpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)
    out = odd_docs.select("text", coder.encode(F.col("text")).alias("i")).select("text", "i", coder.decode(F.col("i")).alias("b")).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r.i == reference.encode_ordinary(r.text or "")
        assert bytes(r.b) == (r.text or "").encode()


def test_empty_table_and_null_ids(spark, no_docs):
    coder = bpe.ByteBpe(spark, RANKS, public_tokenizers.PATTERN)
    assert no_docs.select(coder.encode(F.col("text")).alias("i")).collect() == []
    assert spark.range(1).select(coder.decode(F.lit(None).cast("array<int>")).alias("b")).first().b is None


def test_unknown_id_is_an_error():
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for ids in ([-1], [50_256]):
        with pytest.raises(IndexError):
            own.decode(ids)


def test_columns(spark):
    assert op1_byte_bpe(spark, SF001).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    op1_byte_bpe(spark, SF01).count()
    assert spark.conf.get(name) == before
