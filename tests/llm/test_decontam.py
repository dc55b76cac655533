import hashlib
import re

import pytest

from tessera.llm import decontam
from tessera.llm.queries import op2_decontamination

from .conftest import SF01

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items, width=13):
    """(n_words, n_hit, items) of every text by looking at every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_query_equals_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in op2_decontamination(spark, SF01).collect()}
    assert len(got) == len(rows)
    for r, (n, hit, found) in zip(rows, plain([r.text for r in rows], items)):
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items) == (n, hit, len(found))
        assert g.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert g.contaminated == (hit > 0 and 20 * hit >= n)
    assert any(r.contaminated for r in got.values())


ITEMS = [(1, "One two THREE"), (2, "a b c d e f g h i j k l m n o"), (2, "zero"), (3, None), (4, ""), (None, "tail"), (5, "one two"), (6, "d e f g h i j k l m n o p")]


@pytest.mark.parametrize("block_words", [4, 1000])
def test_odd_rows_and_blocks(spark, odd_docs, block_words):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    extra = spark.createDataFrame([(50, "x a b c d e f g h i j k l m n o p y", "en", "s", 1), (51, "a b c d e f g h i j k l m", None, None, 0), (52, "one two three one two three", "", "", 0)], odd_docs.schema.fieldNames()[:5])
    docs = odd_docs.select(extra.columns).unionByName(extra)
    out = decontam.verdicts(decontam.matches(docs, items, block_words=block_words)).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    cases = [(i if i is not None else "", t) for i, t in ITEMS]
    want = sorted((str(r.doc_id), n, h, f) for r, (n, h, f) in zip(rows, plain([r.text for r in rows], cases)))
    assert sorted((str(r.id), r.n_words, r.n_hit, r.items) for r in out) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x b a"), (2, "a x y z b c"), (3, "a b"), (4, "q a c c b q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    near = {r.id: r.near for r in decontam.matches(docs, items, near_width=4).collect()}
    assert near == {1: ["7"], 2: [], 3: [], 4: ["7"]}


def test_stage_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    kept = decontam.remove_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert not {"one two three", "One TWO three", "one two three four"} & {r.text for r in kept.collect()}
    assert kept.count() == odd_docs.count() - 4
    assert decontam.remove_contaminated(no_docs, items).collect() == []
    assert decontam.remove_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()
