"""Operator 8: SimHash near-duplicates by deletion-variant signatures.

A document's shingles (``shingle_words`` consecutive words, repeats included;
fewer words: the whole sequence) are hashed with XXH64, and each of the 64
fingerprint bits is the majority of the hashes' bits.  Two fingerprints link at
``max_bits`` or fewer differing bits; documents of one connected component are
one group.

Finding the links: the 64 bits are cut into so few segments that, of two
linked fingerprints, one segment differs in one bit at most.  Every segment is
indexed as it is and once for each of its bits with that bit deleted; linked
fingerprints meet by an equality join of these signatures, and every meeting is
verified on all 64 bits.

Skew: the index holds *distinct* fingerprints, so exact copies count once.  A
signature that more than ``group_limit`` fingerprints share (a large group of
near copies) is not gathered: its members are indexed again by signatures of the
bits that it leaves free, and once more below that.  The third level leaves at
most 11 of 64 bits free, which bounds its groups at 2,048 fingerprints.  No link
is lost, since linked fingerprints share a signature at every level.  A group
never emits its pairs, but a spanning forest of its verified links: at most one
edge for each member.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; repeated rows share a fingerprint and so a component.  A null
id takes part in linking; the component is named by the smallest id that is not
null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, packed, stored

BITS = 64
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
RUN_SHINGLES = 200_000  # hashes whose bits are counted in one go


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """Fingerprint of one text (unsigned)."""
    import xxhash

    words = text.encode("utf-8").translate(LOWER).split() if text else []
    if not words:
        return 0
    digest, k = xxhash.xxh64_intdigest, shingle_words
    if len(words) <= k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), RUN_SHINGLES):
        part = hashes[at : at + RUN_SHINGLES]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprint(text: Column, shingle_words: int = 3) -> Column:
    """Fingerprint as a signed bigint holding the 64 bits."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.array(found.view(np.int64), pa.int64())

    return run(text)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


# ---------------------------------------------------------------- signatures


def segments(low: int, width: int, max_bits: int) -> list[tuple[int, int]]:
    """Cut bits ``low .. low+width`` into (low bit, length) segments, as few as
    leave one with at most one of ``max_bits`` differing bits."""
    n = max_bits // 2 + 1
    edges = [low + width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(segment, mask of the bits it fixes, deleted bit or 0) of all signatures."""
    out = []
    for k, (low, length) in enumerate(parts):
        whole = ((1 << length) - 1) << low
        out.append((k, whole, 0))
        out += [(k, whole & ~(1 << bit), 1 << bit) for bit in range(low, low + length)]
    return out


def forest(values: np.ndarray, deleted: int, max_bits: int, tile: int = 1024) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sorted distinct ``values`` that
    share a signature; ``deleted`` is its deleted bit (0: none).

    With a deleted bit only pairs that differ in it are of interest (the others
    meet in the signature without deletion).  Each step takes a whole tile of
    unreached values against those that the search has just reached.
    """
    out: list[tuple[int, int]] = []
    values = values.astype(np.uint64)
    if deleted:
        side = (values & np.uint64(deleted)) != 0
        if side.all() or not side.any():
            return out
        sides = [values[~side], values[side]]
        # bipartite search: reached values of one side look at the other's unreached
        left = [sides[0], sides[1]]
        while len(left[0]) and len(left[1]):
            start, left[0] = left[0][:1], left[0][1:]
            frontier, at = start, 1
            queue = [(frontier, at)]
            while queue:
                frontier, at = queue.pop()
                hits = _reach(frontier, left[at], max_bits, tile, out)
                if hits is not None:
                    new, left[at] = left[at][hits], left[at][~hits]
                    if len(new):
                        queue.append((new, 1 - at))
        return out
    rest = values
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hits = _reach(frontier, rest, max_bits, tile, out)
            frontier, rest = rest[hits], rest[~hits]
    return out


def _reach(frontier: np.ndarray, rest: np.ndarray, max_bits: int, tile: int, out: list) -> np.ndarray:
    """Which of ``rest`` link to ``frontier``; adds one edge for each to ``out``."""
    hits = np.zeros(len(rest), bool)
    for i in range(0, len(frontier), tile):
        if hits.all():
            break
        some = frontier[i : i + tile]
        for j in range(0, len(rest), tile):
            idx = np.flatnonzero(~hits[j : j + tile]) + j
            if not len(idx):
                continue
            near = np.bitwise_count(rest[idx][:, None] ^ some[None, :]) <= max_bits
            found = near.any(axis=1)
            if found.any():
                first = near[found].argmax(axis=1)
                out.extend(zip(some[first].tolist(), rest[idx][found].tolist()))
                hits[idx[found]] = True
    return hits


def links(fps: DataFrame, max_bits: int = 3, group_limit: int = 16_384) -> DataFrame:
    """(a, b): verified links that connect exactly the components of all links
    among the distinct fingerprints in column ``fp``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be from 0 to 3")
    return _links(fps.select("fp"), [], (0, BITS), max_bits, max(group_limit, 2048)).distinct()


def _links(fps: DataFrame, above: list[str], free: tuple[int, int], max_bits: int, limit: int) -> DataFrame:
    """Links among fingerprints that agree on the columns ``above``, the
    signatures so far; ``free`` are the bits that these do not fix."""
    parts = segments(*free, max_bits)
    sigs = signatures(parts)
    depth = len(above) // 2
    names = [*above, f"sig{depth}", f"value{depth}"]
    kinds = F.array(*[F.struct(F.lit(i).cast("smallint").alias("i"), F.lit(_signed(m)).cast("bigint").alias("mask")) for i, (_, m, _) in enumerate(sigs)])
    rows = fps.select(*above, "fp", F.explode(kinds).alias("s")).select(
        *above, F.col("s.i").alias(names[-2]), F.col("fp").bitwiseAND(F.col("s.mask")).alias(names[-1]), "fp"
    )
    # Sizes first: a window counts every group as it streams by (its buffer
    # spills), and only the few rows that meet others go on.
    n = F.count(F.lit(1)).over(Window.partitionBy(*names))
    met = stored(rows.withColumn("n", n).where("n > 1"), f"simhash-met{depth}")
    pairs = met.where("n = 2").groupBy(*names).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).select("a", "b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    deleted = [bit for _, _, bit in sigs]

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for sig, group in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = group.values.to_numpy().view(np.uint64)
                found += forest(np.unique(values), deleted[sig], max_bits)
            edges = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    groups = met.where(F.col("n").between(3, limit)).groupBy(*names).agg(F.collect_list("fp").alias("fps"))
    out = pairs.unionByName(groups.select(names[-2], "fps").mapInArrow(forests, "a bigint, b bigint"))
    hot = met.where(F.col("n") > limit)
    if hot.isEmpty():
        return out
    for k in range(len(parts)):
        own = hot.where(F.col(names[-2]).isin([i for i, (part, _, _) in enumerate(sigs) if part == k]))
        other = next(part for j, part in enumerate(parts) if j != k)
        out = out.unionByName(_links(own.select(*names, "fp"), names, other, max_bits, limit))
    return out


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node that
    it reaches, by alternating large-star and small-star steps.  Each round's
    edges are written to the shared folder; rounds are logarithmic in practice
    and end when the edges no longer change."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        if large:  # larger neighbours hang below the smallest
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # the node and its smaller neighbours hang below the smallest
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "simhash-edges")
    seen = state(now)
    while True:
        now = stored(star(star(now, True), False), "simhash-star")
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


# ---------------------------------------------------------------- operator


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3, group_limit: int = 16_384) -> DataFrame:
    """(id, fingerprint, component_id): one row for every row of ``docs``."""
    marked = stored(docs.select(col(id_col).alias("id"), fingerprint(col(text_col), shingle_words).alias("fp")), "simhash-fingerprints")
    return grouped(marked, max_bits, group_limit).select(F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def grouped(marked: DataFrame, max_bits: int = 3, group_limit: int = 16_384) -> DataFrame:
    """``marked`` (id, fp, ...) with ``component_id``, the smallest id of the component."""
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(fps, max_bits, group_limit))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of every component, with all columns of ``docs``: the row of the
    smallest id (null ids last), of several such the one with the smallest text
    hash, and one of equal rows."""
    text_hash = F.xxhash64(col(text_col))
    marked = stored(docs.select(col(id_col).alias("id"), text_hash.alias("hash"), fingerprint(col(text_col), shingle_words).alias("fp")), "simhash-fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "hash")).alias("row")), "simhash-distinct")
    roots = components(links(fps, max_bits))
    best = fps.join(roots, fps.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row"))
    kept = best.select(F.col("row.id").alias("kid"), F.col("row.hash").alias("khash"))
    rows = docs.select(packed(docs), col(id_col).alias("id"), text_hash.alias("hash"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("hash") == F.col("khash")), "left_semi")
    # Rows that repeat id and text are one document: the first of each stays.
    first = met.groupBy("id", "hash").agg(F.first("row").alias("row"))
    return first.select("row.*")
