"""S1 folder reader, X1 run numbering against brute force, oracle parity."""

import datetime as dt
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from tessera.operators.sessions import number_runs
from tessera.sources import files as S


def test_read_text_folder_is_flat_and_sorted(spark, tmp_path):
    (tmp_path / "b_doc.txt").write_text("second\nfile", encoding="utf-8")
    (tmp_path / "a_doc.txt").write_text("first", encoding="utf-8")
    (tmp_path / "skip.md").write_text("not text", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("nested", encoding="utf-8")
    rows = S.read_text_folder(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["text"]) for r in rows] == [("a_doc.txt", "first"), ("b_doc.txt", "second\nfile")]


def test_run_numbers_match_sequential_scan(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    eid = 0
    for user, n in ((1, 3000), (2, 40), (3, 5)):  # user 1 is the hot key
        for _ in range(n):
            ts = base + dt.timedelta(seconds=rnd.randint(0, 3 * 86400))
            rows.append((eid, ts, user, rnd.choice(["signup", "view", "click", "purchase"])))
            eid += 1
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    got = {r["event_id"]: r["run_no"] for r in number_runs(df, F.col("event_type") == "signup").collect()}
    expected = {}
    for user in (1, 2, 3):
        run = 0
        for e, ts, u, kind in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            run += kind == "signup"
            expected[e] = run
    assert got == expected


def test_runs_keep_rows_without_user_or_time(spark):
    from tessera.operators.sessions import run_summary

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, "signup", 1.0), (2, None, 1, "view", 1.0), (3, t, None, "view", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert sum(r["n_events"] for r in run_summary(df, F.col("event_type") == "signup").collect()) == 3


def test_file_names_are_not_retyped(spark, tmp_path):
    df = spark.createDataFrame([("007", "a"), ("010", "b"), ("1e3", "c\nd")], "filename string, text string")
    S.write_documents_as_files(df, str(tmp_path / "d"))
    assert sorted(map(tuple, S.read_documents_from_files(spark, str(tmp_path / "d")).collect())) == sorted(
        map(tuple, df.collect()))


def test_documents_take_a_file_each_and_no_folder(spark, tmp_path):
    names = [f"doc {i}" for i in range(200)] + ["a/b", "..", "_c", ".d", "e%2Ff", "g=ü.txt", "__HIVE_DEFAULT_PARTITION__"]
    rows = [(n, f"text of {n}\r\n\n") for n in names] + [("h", None), ("i", ""), (None, "nameless"), ("large", "x\n" * (9 << 20))]
    path = tmp_path / "d"
    S.write_documents_as_files(spark.createDataFrame([("gone", "x")], "filename string, text string"), str(path))
    S.write_documents_as_files(spark.createDataFrame(rows, "filename string, text string").repartition(4), str(path))
    found = [(folder, f) for folder, _, files in os.walk(path / "_documents") for f in files]
    assert len(found) == len(rows) and len({folder for folder, _ in found}) <= 4
    assert "doc 7" in {f for _, f in found}
    (path / "_documents" / "0").mkdir()  # of an attempt that failed
    (path / "_documents" / "0" / "doc 7").write_text("half")
    back = S.read_documents_from_files(spark, str(path)).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((n, t or "")) for n, t in rows)


def test_rows_of_one_name_and_task_share_a_file(spark, tmp_path):
    rows = [("a", "1"), ("b", "2"), ("a", "3"), (None, "4"), ("", "5")]
    S.write_documents_as_files(spark.createDataFrame(rows, "filename string, text string").coalesce(1), str(tmp_path / "d"))
    back = S.read_documents_from_files(spark, str(tmp_path / "d")).collect()
    assert {tuple(r) for r in back} == {("a", "1\n3"), ("b", "2"), (None, "4\n5")}


def test_documents_in_a_store_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    rows = [("a", "1"), ("b/c", "2\n"), ("d", None)]
    for _ in range(2):
        S.write_documents_as_files(spark.createDataFrame(rows, "filename string, text string"), "viewfs://files/in/d")
    back = S.read_documents_from_files(spark, "viewfs://files/in/d").collect()
    assert sorted(map(tuple, back)) == [("a", "1"), ("b/c", "2\n"), ("d", "")]


def test_redelivered_document_replaces_its_chunks(spark, tmp_path):
    from tessera.streaming import jobs as X

    schema = "doc_id long, source string, text string"
    landing, sink, ckpt = (str(tmp_path / n) for n in ("l", "s", "c"))
    for rows in ([(1, "a", "old " * 600), (2, "a", "kept"), (3, "a", "emptied"), (None, "a", "no key"), (None, "a", "nor here")],
                 [(1, "a", "new"), (3, "a", "")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        X.incremental_chunks(spark, landing, spark.createDataFrame([], schema).schema, sink, ckpt)
    got = sorted((str(r["doc_id"]), r["text"]) for r in X.latest_documents(spark, sink).collect())
    assert got == [("1", "new"), ("2", "kept"), ("None", "no key"), ("None", "nor here")]
    assert {r["doc_id"] for r in X.deliveries(spark, sink).collect()} == {1, 2, 3}


def test_delivery_manifest(spark, tmp_path):
    """Versions within a micro-batch, deletions, versions that arrive too late,
    rows that are delivered twice, and a batch that died before its manifest."""
    import shutil

    from tessera.streaming import jobs as X

    schema = "doc_id long, source string, text string, delivery long, deleted boolean"
    landing, sink, ckpt = (str(tmp_path / n) for n in ("l", "s", "c"))
    arrivals = [
        [(1, "a", "one", 5, False), (2, "a", "two", 5, None), (3, "a", "three", 5, False), (4, "a", "same", 5, False), (4, "a", "same", 5, False)],
        [(1, "a", "one b", 7, False), (1, "a", "one a", 6, False), (2, "a", None, 6, True), (3, "a", "too late", 4, False), (5, "a", "tie x", 1, False), (5, "a", "tie y", 1, False)],
        [(2, "a", "back", 9, False), (4, "a", "same", 5, False)],
    ]
    seen = []
    for rows in arrivals:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(landing)
        X.incremental_chunks(spark, landing, spark.createDataFrame([], schema).schema, sink, ckpt)
        seen.append(sorted((r["doc_id"], r["text"]) for r in X.latest_documents(spark, sink).collect()))
    assert seen[0] == [(1, "one"), (2, "two"), (3, "three"), (4, "same")]
    tie = [x for x in seen[1] if x[0] == 5]
    assert len(tie) == 1 and seen[1] == [(1, "one b"), (3, "three"), (4, "same"), *tie]
    assert seen[2] == [(1, "one b"), (2, "back"), (3, "three"), (4, "same"), *tie]
    shutil.copytree(tmp_path / "s", tmp_path / "died", ignore=lambda d, names: ["batch_id=2"] if d.endswith("manifest") else [])
    assert sorted((r["doc_id"], r["text"]) for r in X.latest_documents(spark, str(tmp_path / "died")).collect()) == seen[1]


@pytest.mark.slow
def test_all_queries_match_oracle_sf0001(spark):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    import __spark_entry__ as E
    from oracle_check import compare, duck

    con = duck("/root/testdata/sf0.001")
    qs, oracle = E.queries(), E.oracle_sql()
    bad = [n for n in qs if n in oracle and not compare(n, qs[n](spark, "/root/testdata/sf0.001"), con, oracle[n])]
    assert bad == []
    assert E.entry(spark).count() > 0


@pytest.mark.slow
def test_entry_from_foreign_working_directory(tmp_path):
    """Executors must import the package even when the driver runs elsewhere
    with a plain session (the package is shipped with addPyFile)."""
    import subprocess

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(repo, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert E.entry(spark).count() > 0
assert E.queries()["hashed_vectors"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                       timeout=600)
    assert r.returncode == 0 and "OK" in r.stdout, r.stderr[-2000:]
