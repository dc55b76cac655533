"""The call log end to end (S5, S6, K1-K3, X1 on the log's own shape) and the
empty-collection short-circuit (S7 + R10)."""

from pyspark.sql import functions as F

from tessera.operators import cost as K
from tessera.operators import retrieval as R
from tessera.operators.sessions import number_runs
from tessera.sources import files as S

LOG = [
    ("2026-10-08T16:47:00.100000", "q1", "manager-classifier", 86, 2),
    ("2026-10-08T16:47:01.200000", "q1", "qualitative", 612, 59),
    ("2026-10-08T16:50:07.000000", "q2", "manager-classifier", 83, 1),
    ("2026-10-08T16:50:08.500000", "q2", "quantitative", 587, 230),
    ("2026-10-08T16:50:09.900000", "q2", "qualitative", 89, 2),
]


def test_log_append_read_price_and_runs(spark, tmp_path):
    import datetime as dt

    df = spark.createDataFrame(LOG, "timestamp string, query string, agent string, input_tokens long, "
                                    "output_tokens long")
    priced = K.priced(df)
    path = str(tmp_path / "log")
    S.append_jsonl(priced.limit(2), path)
    S.append_jsonl(priced.subtract(priced.limit(2)), path)
    (tmp_path / "log" / "bad.json").write_text('not json\n{"query": "q", "input_tokens": "many"}\n')
    lines = S.read_call_log(spark, path)
    assert lines.schema == S.CALL_LOG_SCHEMA
    bad = [r["malformed"] for r in lines.collect() if r["malformed"]]
    assert sorted(bad) == ["not json", '{"query": "q", "input_tokens": "many"}']
    back = lines.where("malformed IS NULL").drop("malformed").cache()
    assert back.count() == 5
    rows = {r["timestamp"]: r for r in back.collect()}
    assert rows[dt.datetime(2026, 10, 8, 16, 47, 0, 100000)]["cost_usd"] == 0.000147
    assert rows[dt.datetime(2026, 10, 8, 16, 50, 8, 500000)]["cost_per_1000_queries"] == 2.95

    # X1 on the log: a classifier record opens a run; order of writes = time
    runs = number_runs(
        back.select(F.lit(0).alias("user_id"), F.col("timestamp").alias("ts"),
                    F.col("timestamp").alias("event_id"), "agent"),
        F.col("agent") == "manager-classifier")
    assert [r["run_no"] for r in runs.orderBy("ts").collect()] == [1, 1, 2, 2, 2]

    totals = {r["query"]: r for r in K.with_totals(back, "query", "agent").filter(
        F.col("agent") == "TOTAL").collect()}
    assert (totals["q2"]["input_tokens"], totals["q2"]["output_tokens"]) == (83 + 587 + 89, 1 + 230 + 2)


def test_empty_collection_gives_fallback(spark):
    qs = spark.createDataFrame([(1, "anything at all")], "query_id long, question string")
    empty = spark.createDataFrame([], "chunk_id string, source string, chunk int, text string")
    assert S.is_empty(empty)
    snippets = R.rerank(qs, empty)
    assert snippets.count() == 0
    answers = spark.createDataFrame([(1, "model text", 7, 3)],
                                    "query_id long, answer string, input_tokens int, output_tokens int")
    r = R.answer_with_fallback(qs, snippets, answers, "query_id").first()
    assert r["answer"] == R.FALLBACK_ANSWER
    assert (r["input_tokens"], r["output_tokens"], r["n_snippets"]) == (0, 0, 0)
