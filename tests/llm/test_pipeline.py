import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, queries, toxicity

from .conftest import SF01
from .test_decontam import plain
from .test_simhash import plain_components, plain_fingerprint


def test_pipeline_equals_plain_stages(spark, docs):
    """Every stage again, with the fitted models but plain Python besides."""
    kept = docs.select("doc_id", "text").collect()
    language = langid.fit(queries.language_labels(docs))
    kept = [r for r, (name, _) in zip(kept, language.predict([r.text for r in kept])) if name != "und"]
    ids = [r.doc_id for r in kept]
    model = queries.toxicity_model(spark, SF01, docs.where(F.col("doc_id").isin(ids)))
    words = [toxicity.byte_words(r.text) for r in kept]
    kept = [r for r, p in zip(kept, model.marginals(words, {})) if model.score(p) < 0.7]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in kept}
    roots, least = plain_components(fps.values()), {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    kept = [r for r in kept if least[roots[fps[r.doc_id]]] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [r for r, (n, hit, _) in zip(kept, plain([r.text for r in kept], items)) if not (hit > 0 and 20 * hit >= n)]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(queries.RANKS))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF01).collect()}
    assert sorted(got) == sorted(r.doc_id for r in kept)
    for r in kept:
        assert got[r.doc_id].ids == coder.encode_ordinary(r.text or "") and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF01).collect() == [], name
        out = stage(spark, odd_docs, SF01)
        assert out.count() <= odd_docs.count()
        if name != "byte_bpe":
            assert out.columns == odd_docs.columns, name
