"""Operator 2: benchmark decontamination by a distributed positional index.

The training documents are cut into *segments* of about a million words, each
the work of one task.  A segment's index is a set of posting lists, one row for
every test term that it holds: the sorted positions of the term in the segment's
word stream, as gaps.  One more row records the documents' places in the stream.
The index is written to the shared folder and then searched segment by segment:
for every window of a test item, the lists of its terms are shifted by the
term's offset in the window and intersected, from the rarest term on, which
leaves the exact places of the window.  Documents lie apart in the stream by a
gap wider than any window, so that no match runs over a document's end.
A proximity match is a window whose distinct words all lie within
``near_width`` consecutive words, in any order; its search starts at the places
of the rarest word.

Scale: segments are alike in size whatever words they hold, so a word that makes
up a third of the corpus is cut over all segments, and a benchmark passage in a
third of the documents costs each segment its share.  The test items are taken
in blocks of at most ``BLOCK_WORDS`` words (one larger item is a block of its
own); what a task gets by broadcast is bounded by that, and the corpus is read
once for each block.

Defined results: null, empty and wordless texts have no words and no hits; a
null item, or one without words, has no window; repeated rows get a row each;
an item id that is null is listed as the empty string, and items that share an
id count once.  A document of any length stays within one segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import byte_words, col, packed, stored

SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
DOCUMENTS = -1  # the term number of a segment's record of its documents


@dataclass
class TestBlock:
    """Windows of one block of test items, by term numbers."""

    width: int
    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)

    def add(self, item: str, text: str | None) -> None:
        ids = [self.terms.setdefault(w, len(self.terms)) for w in byte_words(text)]
        if not ids:
            return
        for i in range(max(1, len(ids) - self.width + 1)):
            self.windows.setdefault(tuple(ids[i : i + self.width]), set()).add(item)


def test_blocks(items: DataFrame, id_col: str, text_col: str, width: int, most_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """Blocks of items by the hash of their id, none with more words than
    ``most_words`` unless it is a single item."""

    @F.arrow_udf("bigint")
    def count_words(texts: pa.Array) -> pa.Array:
        return pa.array([len(byte_words(t.as_py())) for t in texts], pa.int64())

    sized = items.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("item"), col(text_col).alias("text"))
    sized = sized.withColumn("n", count_words("text")).where("n > 0")
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // most_words))
    while True:
        number = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
        over = sized.groupBy(number.alias("block")).agg(F.sum("n").alias("words"), F.countDistinct("item", "text").alias("k"))
        if over.where((F.col("words") > most_words) & (F.col("k") > 1)).isEmpty():
            break
        n_blocks *= 2
    for b in range(n_blocks):
        block = TestBlock(width)
        for r in sized.where(number == b).select("item", "text").distinct().toLocalIterator():
            block.add(r.item, r.text)
        if block.windows:
            yield block


# ------------------------------------------------------------------- index


def index_schema(id_type: T.DataType) -> T.StructType:
    places = T.StructType([T.StructField("id", id_type), T.StructField("hash", T.LongType()), T.StructField("base", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    return T.StructType([
        T.StructField("segment", T.StringType()),
        T.StructField("term", T.IntegerType()),
        T.StructField("gaps", T.ArrayType(T.IntegerType())),
        T.StructField("documents", T.ArrayType(places)),
    ])


def build_index(docs: DataFrame, terms, width: int) -> DataFrame:
    """Posting lists (segment, term, gaps, documents) of ``docs`` (id, hash,
    text) for the broadcast ``terms`` (word to number)."""
    schema = index_schema(docs.schema["id"].dataType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def segment_rows(name: str, places: list[dict], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        stream = np.concatenate(parts) if parts else np.empty(0, np.int32)
        at = np.flatnonzero(stream >= 0)
        order = np.argsort(stream[at], kind="stable")
        found, at = stream[at][order], at[order].astype(np.int32)
        firsts = np.flatnonzero(np.diff(found, prepend=-1))
        gaps = np.diff(at, prepend=0).astype(np.int32)
        gaps[firsts] = at[firsts]
        offsets = np.append(firsts, len(at)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps))
        n = len(firsts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), pa.array(found[firsts].astype(np.int32)), lists, pa.nulls(n, arrow.field("documents").type)], schema=arrow
        )
        yield pa.RecordBatch.from_pylist([{"segment": name, "term": DOCUMENTS, "gaps": None, "documents": places}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = terms.value, TaskContext.get().partitionId()
        n, base, places, parts = 0, 0, [], []
        gap = np.full(width, -1, np.int32)
        for batch in batches:
            ids, hashes, texts = batch.columns
            for i in range(batch.num_rows):
                words = byte_words(texts[i].as_py())
                if places and base + len(words) > SEGMENT_WORDS:
                    yield from segment_rows(f"{task}-{n}", places, parts)
                    n, base, places, parts = n + 1, 0, [], []
                places.append({"id": ids[i].as_py(), "hash": hashes[i].as_py(), "base": base, "n_words": len(words)})
                if words:
                    parts.append(np.fromiter((number.get(w, -1) for w in words), np.int32, len(words)))
                    parts.append(gap)
                    base += len(words) + width
        if places:
            yield from segment_rows(f"{task}-{n}", places, parts)

    return docs.select("id", "hash", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------ search


class Windows:
    """The windows of a block as arrays, for one task's searches."""

    def __init__(self, windows: dict[tuple[int, ...], set[str]], width: int):
        self.keys = list(windows)
        self.items = [sorted(windows[k]) for k in self.keys]
        self.matrix = np.array([k + (k[0],) * (width - len(k)) for k in self.keys], np.int32).reshape(-1, width)


def phrase_starts(window: tuple[int, ...], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Places where the window's terms stand consecutively: shifted lists,
    intersected from the rarest on."""
    offsets = sorted(range(len(window)), key=lambda o: len(lists[window[o]]))
    starts = lists[window[offsets[0]]] - offsets[0]
    for o in offsets[1:]:
        if not len(starts):
            break
        own = lists[window[o]]
        at = np.searchsorted(own, starts + o)
        at[at == len(own)] = 0
        starts = starts[own[at] == starts + o]
    return starts


def near_places(window: tuple[int, ...], lists: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Places of the rarest term that lie in ``width`` consecutive words with
    all other distinct terms of the window."""
    terms = sorted(set(window), key=lambda t: len(lists[t]))
    anchors = lists[terms[0]]
    for t in terms[1:]:  # every other term near each anchor at least
        if not len(anchors):
            return anchors
        own = lists[t]
        anchors = anchors[np.searchsorted(own, anchors + width) > np.searchsorted(own, anchors - width + 1)]
    if not len(anchors):
        return anchors
    starts = anchors[:, None] - np.arange(width)[None, :]
    whole = np.ones(starts.shape, bool)
    for t in terms[1:]:
        own = lists[t]
        whole &= np.searchsorted(own, starts + width) > np.searchsorted(own, starts)
    return anchors[whole.any(axis=1)]


SPANS = "array<struct<item:string,start:int,end:int>>"


def search(index: DataFrame, block: TestBlock, near_width: int | None) -> DataFrame:
    """(id, hash, n_words, spans, near): for every document, the maximal runs of
    words that windows of an item cover, and the items with a proximity match."""
    id_type = index.schema["documents"].dataType.elementType["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("hash", T.LongType()), T.StructField("n_words", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("near", T.ArrayType(T.StringType())),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    shared = index.sparkSession.sparkContext.broadcast((block.windows, len(block.terms), block.width))

    def run(segment: pa.Table) -> pa.Table:
        windows, n_terms, width = shared.value
        own = windows if isinstance(windows, Windows) else Windows(windows, width)
        lists, places = {}, []
        for term, gaps, documents in zip(segment.column("term").to_pylist(), segment.column("gaps"), segment.column("documents")):
            if term == DOCUMENTS:
                places = documents.as_py()
            else:
                lists[term] = np.cumsum(gaps.values.to_numpy())
        places = sorted(places, key=lambda p: (p["base"], p["n_words"] > 0))
        bases = np.array([p["base"] for p in places], np.int64)
        spans: list[dict[str, list[list[int]]]] = [{} for _ in places]
        near: list[set[str]] = [set() for _ in places]
        present = np.zeros(n_terms, bool)
        present[list(lists)] = True
        for w in np.flatnonzero(present[own.matrix].all(axis=1)).tolist():
            key = own.keys[w]
            starts = phrase_starts(key, lists)
            at = np.searchsorted(bases, starts, side="right") - 1
            for d, s in zip(at.tolist(), (starts - bases[at]).tolist()):
                for item in own.items[w]:
                    spans[d].setdefault(item, []).append((s, s + len(key)))
            if near_width:
                hits = near_places(key, lists, max(near_width, len(set(key))))
                for d in set((np.searchsorted(bases, hits, side="right") - 1).tolist()):
                    near[d].update(own.items[w])
        rows = [
            {"id": p["id"], "hash": p["hash"], "n_words": p["n_words"], "near": sorted(near[d]),
             "spans": [{"item": item, "start": a, "end": b} for item, runs in sorted(spans[d].items()) for a, b in merged(runs)]}
            for d, p in enumerate(places)
        ]
        return pa.Table.from_pylist(rows, schema=arrow)

    return index.groupBy("segment").applyInArrow(run, schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) runs joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---------------------------------------------------------------- operator


def covered(spans: Column) -> Column:
    """Words inside any span."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    return F.aggregate(
        places,
        zero,
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto")
        ),
        lambda acc: acc["hit"],
    )


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 13, near_width: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, hash, n_words, spans, near), one row for every row of ``docs``."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"), col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    found = []
    for block in test_blocks(items, item_id_col, item_text_col, width, block_words):
        index = stored(build_index(rows, sc.broadcast(block.terms), width), "positional-index")
        found.append(search(index, block, near_width))
    if not found:
        block = TestBlock(width)
        found = [search(build_index(rows, sc.broadcast(block.terms), width), block, None)]
    if len(found) == 1:
        return found[0]
    # Several blocks: rows that agree in id and text have the same matches, so
    # each block gives one of them, and their number comes back at the end.
    one = [x.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("near").alias("near")) for x in found]
    whole = one[0]
    for more in one[1:]:
        whole = whole.unionByName(more)
    joined = whole.groupBy("id", "hash").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "hash", "n_words", "spans", "near")


def verdicts(matched: DataFrame) -> DataFrame:
    """n_hit, the sorted items, and the rule: one word in twenty hit at least."""
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    out = matched.select("id", "hash", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), items.alias("items"), "spans", "near")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = verdicts(matches(docs, items, id_col, text_col, **how))
    bad = found.where("contaminated").select(F.col("id").alias("bad_id"), F.col("hash").alias("bad_hash")).distinct()
    rows = docs.select(packed(docs), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")
