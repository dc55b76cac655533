"""Operator 12: quality rules with adaptive thresholds from quantile sketches.

Every text is measured (words, symbols, repeated lines, repeated five-word
windows).  Three ratios of a text are compared with fences that come from the
texts of the same language and source themselves: a text fails where a ratio is
beyond the quartiles by more than ``FAR`` times their distance.  The ratio of a
text of few words varies more, so below ``STEADY_WORDS`` the fence is the further
out, by the square root of the missing factor.

The quartiles come from a mergeable sketch: the number of values in each bucket
of a logarithmic scale, so that a quantile is right within ``ACCURACY`` of its
value.  Sketches merge by adding; the result does not depend on the order, on the
partitions or on a task that ran twice.  The executors' partial aggregates are the
sketches of their rows, and only bucket counts are shuffled.  A (language,
source) with fewer than ``LEAST_ROWS`` texts takes the merged sketch of its
language, a language with fewer that of all texts, and if all are fewer, there is
no fence: only the fixed rules decide.

The rows then meet their fences in a join on (language, source, salt): the
fences, one row for each group, are repeated ``SALTS`` times, so a source that
holds a third of the rows is spread over many tasks.

Defined results: a null, empty or blank text has zero words and fails the fixed
rules.  A null language or source is a group of its own.  Repeated rows count as
often as they occur.  Ties: a ratio equal to its fence passes.  An empty table
gives an empty result.  Columns are taken by name and packed, so that other
columns cannot clash.  Texts of any length are measured whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, packed, stored

ACCURACY = 0.01  # relative error of a quantile
LEAST_ROWS = 200  # texts of a group that fences of its own need
FAR = 3.0  # quartile distances beyond the quartile
STEADY_WORDS = 50
SALTS = 16
RUN_CHARS = 1_000_000  # characters of the texts measured together
WINDOW = 5  # words

# Fixed values of the rules: symbols, white space between words, least words,
# and the share of words in repeated windows (per cent).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEATED = 20

# The ratios, with the least distance of the quartiles that a fence assumes and
# whether low values fail too.
MEASURES = {
    "symbols_per_word": (0.05, False),
    "letters_per_word": (0.5, True),
    "repeated_lines": (0.15, False),
}


# -------------------------------------------------------------- measurement


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in windows that the text has twice or more.

    Windows whose fingerprints are alike are candidates; these are ranked word by
    word, so a chance fingerprint changes nothing."""
    ends = np.cumsum([len(t) for t in texts])
    n = int(ends[-1]) if len(texts) else 0
    words = list(chain.from_iterable(texts))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.arange(max(0, n - WINDOW + 1))
    at = at[doc[at] == doc[at + WINDOW - 1]] if len(at) else at
    with np.errstate(over="ignore"):
        prints = doc[at].astype(np.uint64)
        for k in range(WINDOW):
            prints = (prints ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            prints ^= prints >> np.uint64(29)
    ordered = np.sort(prints)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(texts), np.int64)
    if not len(again):
        return out
    place = np.minimum(np.searchsorted(again, prints), len(again) - 1)
    at = at[again[place] == prints]
    rank = doc[at]
    for k in range(WINDOW):
        rank = np.unique(rank * len(number) + ids[at + k], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(covered[:-1]) > 0], 1)
    return out


def _measured(texts: list[str | None]) -> Iterator[tuple]:
    words = [t.encode().split() if t else [] for t in texts]
    repeated = repeated_words(words).tolist()
    for text, own, again in zip(texts, words, repeated):
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        yield (
            len(own),
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)),
            again,
            len(lines),
        )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: Column) -> Column:
    """The counts of a text, as a struct of bigints."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in COUNTS) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, some, size = [], [], 0
            for t in batch:
                some.append(t.as_py())
                size += len(some[-1] or "")
                if size >= RUN_CHARS:
                    rows += _measured(some)
                    some, size = [], 0
            rows += _measured(some)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))

    return run(text)


def ratios(counts: Column) -> dict[str, Column]:
    """The three ratios of a text with words."""
    words = F.greatest(counts["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(counts["n_lines"], F.lit(1)).cast("double")
    return {
        "symbols_per_word": counts["n_symbols"] / words,
        "letters_per_word": counts["word_chars"] / words,
        "repeated_lines": counts["n_dup_lines"] / lines,
    }


# ------------------------------------------------------------------- sketches

_STEP = math.log((1 + ACCURACY) / (1 - ACCURACY))
_ZERO = -(1 << 30)  # bucket of values that are not positive


def bucket(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(_STEP)).cast("int")).otherwise(F.lit(_ZERO))


def bucket_value(number: Column) -> Column:
    """A value within ACCURACY of all in the bucket."""
    middle = F.exp(number * F.lit(_STEP)) * F.lit(2 / (1 + math.exp(_STEP)))
    return F.when(number == _ZERO, F.lit(0.0)).otherwise(middle)


def sketches(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, measure, bucket, n): the sketch of every measure and group."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bucket(v).alias("bucket")) for name, v in values.items()]))
    return rows.select(*keys, each.alias("x")).groupBy(*keys, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged down to fewer keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, measure, n, one column a share): the value of rank
    floor(share * (n - 1)), from 0.  A group has as many rows as its sketch has
    buckets, whatever the number of values."""
    over = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketch.select(*keys, "measure", "bucket", upto.alias("upto"), F.sum("n").over(over).alias("total"))
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(s) * (F.col("total") - 1)), F.col("bucket"))).alias(name) for name, s in shares.items()]
    found = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), *at)
    return found.select(*keys, "measure", "n", *[bucket_value(F.col(name)).alias(name) for name in shares])


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low_*, high_* and reach_* of every measure) for each group, from its own
    sketch or the merged one of fewer keys, where it has enough rows."""
    shares = {"q1": 0.25, "q3": 0.75}
    least = F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)]), F.col("measure"))
    two_sided = F.col("measure").isin([m for m, (_, low) in MEASURES.items() if low])

    def limits(by: list[str]) -> DataFrame:
        own = quantiles(merge(sketch, by), by, shares).where(F.col("n") >= LEAST_ROWS)
        reach = F.lit(FAR) * F.greatest(F.col("q3") - F.col("q1"), least)
        return own.select(*by, "measure", F.struct(F.when(two_sided, F.col("q1")).alias("low"), F.col("q3").alias("high"), reach.alias("reach")).alias("limit"))

    out = sketch.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    levels = []
    for k in range(len(keys), -1, -1):
        own = limits(keys[:k])
        name = f"limit{k}"
        own = own.select(*[F.col(c).alias(f"_{c}") for c in keys[:k]], F.col("measure").alias("_m"), F.col("limit").alias(name))
        same = F.col("measure") == F.col("_m")
        for c in keys[:k]:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(own, same, "left").drop("_m", *[f"_{c}" for c in keys[:k]])
        levels.append(F.col(name))
    out = out.withColumn("limit", F.coalesce(*levels))
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col(f"limit.{side}"))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high", "reach")])


# -------------------------------------------------------------------- verdicts


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if not given) as ``row``, with the
    text's ``counts``, ``base_failed``, ``failed`` (the measures beyond their
    fences) and ``kept``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(packed(docs.select(*map(col, keep))), col(lang).alias("lang"), col(source).alias("source"), measure(col(text)).alias("counts"))
    rows = stored(rows, "quality-measures")
    worded = rows.where("counts.n_words > 0")
    limits = fences(sketches(worded, ["lang", "source"], ratios(F.col("counts"))), ["lang", "source"])
    salted = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), *[c for c in limits.columns if c not in ("lang", "source")])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", "counts"), F.lit(SALTS)).cast("int"))
    met = rows.join(salted, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt")), "left")
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(STEADY_WORDS)) / F.greatest(F.col("counts.n_words"), F.lit(1))))
    beyond = []
    for m, value in ratios(F.col("counts")).items():
        reach = F.col(f"reach_{m}") * wider
        beyond.append(F.when((value < F.col(f"low_{m}") - reach) | (value > F.col(f"high_{m}") + reach), F.lit(m)))
    failed = F.array_compact(F.array(*beyond))
    base = (F.col("counts.n_words") < MIN_WORDS) | (100 * F.col("counts.n_repeat_words") > MAX_REPEATED * F.col("counts.n_words"))
    return met.select("row", "counts", base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that are kept, with all their columns."""
    return judge(docs, text, lang, source, keep=docs.columns).where("kept").select("row.*")
