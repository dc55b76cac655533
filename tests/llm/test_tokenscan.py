import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import tokenscan
from tessera.llm.queries import op5_token_counts

from .conftest import SF01
from .test_decontam import words


def test_query_equals_plain_counts(spark, docs):
    got = sorted((r.doc_id, r.n_tokens) for r in op5_token_counts(spark, SF01).collect())
    assert got == sorted((r.doc_id, len(words(r.text))) for r in docs.collect())


@pytest.mark.parametrize("width,eod", [(2, 0), (4, 50_256), (1, 255)])
def test_documents_over_blocks(spark, tmp_path, monkeypatch, width, eod):
    monkeypatch.setattr(tokenscan, "STRETCH", 3)
    rng = random.Random(width)
    want = []
    for f in range(4):
        runs = [[rng.randint(1, 200) for _ in range(rng.choice([0, 1, 2, 7, 90]))] for _ in range(rng.randint(0, 25))]
        tail = [5, 6] if f == 2 else []
        flat = [t for r in runs for t in [*r, eod]] + tail
        np.array(flat, f"<u{width}").tofile(tmp_path / f"f{f}.bin")
        at = 0
        for i, r in enumerate(runs + ([tail] if tail else [])):
            want.append((f, i, at, len(r), i < len(runs), (r + [eod] + [t for s in runs[i + 1 :] for t in [*s, eod]] + tail)[:3] if i < len(runs) else r[:3]))
            at += len(r) + 1
    for block in (width, 4 * width, 1000):
        out = tokenscan.count_tokens(spark, str(tmp_path), eod, width, head=3, block_bytes=block).collect()
        got = [(int(r.file[-5]), r.document, r.start, r.n_tokens, r.ended, r.head) for r in out]
        assert sorted(got) == sorted(want)
    assert {(r.document, r.start) for r in tokenscan.count_tokens(spark, str(tmp_path), eod, width).collect()} == {(w[1], w[2]) for w in want}


def test_broken_file(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x01\x02\x03")
    with pytest.raises(Exception, match="whole number"):
        tokenscan.count_tokens(spark, str(tmp_path)).collect()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    extreme = spark.createDataFrame([(-1, "a b"), (2**63 - 1, "c"), (-(2**63), None)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extreme)
    for name, df in (("a", docs), ("b", no_docs)):
        path = str(tmp_path / name)
        tokenscan.write_token_files(df.select(tokenscan.word_tokens(F.col("doc_id"), F.col("text")).alias("tokens")), path)
        out = tokenscan.count_tokens(spark, path, head=tokenscan.HEAD, block_bytes=1 << 16)
        got = [(r.i, r.n_tokens - tokenscan.HEAD) for r in out.withColumn("i", tokenscan.head_id(F.col("head"))).collect()]
        assert sorted(map(str, got)) == sorted(str((r.doc_id, len(words(r.text)))) for r in df.collect())
