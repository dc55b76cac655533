"""Operator 3: URL filter by host word segmentation and naive Bayes.

Rules come first: a rule (host, path, verdict) fits its host and all hosts below
it if the url's path starts with the rule's path; the longest fitting rule
decides (of equally long ones the one that blocks).

The other urls are judged by their words.  Host names run words together, so a
unigram model splits them: word counts are taken over the whole text of all
pages, every run of letters in a host is cut into all its parts, the parts meet
the counts by an equality join, and a Viterbi search finds the split with the
greatest probability.  A multinomial naive Bayes model then weighs the host's
words and the words of the path.  It learns from the urls that a rule decides,
and from a short list of words that mark unwanted hosts; its features are
hashed, so that its size is a parameter (``FEATURES``) whatever the corpus.

Scale: hosts are made distinct before they are split, so a host with a third of
all pages is split once; the result returns to the pages by a join that adaptive
execution splits where one host is crowded.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, and gets the verdict of the empty set of words: allow.  Repeated
rows get equal results.  Without any rule-decided url the words
listed are all there is to learn.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, stored

FEATURES = 1 << 16
BLOCK_FROM = 0.75  # score; set on the given pages (README)
SMOOTHING = 5.0  # hosts that every word is given in both classes
MARKED_HOSTS = 50  # blocked hosts that each marked word counts as
MARKED = (
    "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "keygen", "lottery", "nude", "nudes", "pharmacy", "pills",
    "poker", "porn", "porno", "replica", "sex", "sexy", "slots", "spam", "torrent", "viagra", "warez", "webcam", "xxx",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(given, cut, 1), _UPPER, _LOWER), F.regexp_extract(given, cut, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The winning rule's name, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


# ------------------------------------------------------------ segmentation


def unigrams(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n): counts of the words (lower-cased letters) of all pages' texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for html in batch.column(0):
                if text := html.as_py():
                    seen.update(w for w in _LETTERS.findall(_TAG.sub(" ", text).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return pages.select(col(html_col)).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def best_split(letters: str, parts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable words of ``letters``; ``parts``: (start, length) of the
    known words and their counts.  An unknown part of length n, however long,
    counts as 10 / (total * 10**n); of equal splits the one with the longer last
    word wins."""
    total = max(total, 1)
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, length), n in parts.items():
        ending.setdefault(start + length, []).append((start, math.log(n / total)))
    ten, first = math.log(10), math.log(10 / total)
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = (0.0, 0)  # best place to start an unknown part, with its value there
    for end in range(1, len(letters) + 1):
        options = [(unknown[0] + first - end * ten, unknown[1])]
        options += [(best[start][0] + p, -start) for start, p in ending.get(end, ())]
        p, start = max(options)
        best.append((p, -start))
        unknown = max(unknown, (p + end * ten, -end))
    words, end = [], len(letters)
    while end:
        start = best[end][1]
        words.append(letters[start:end])
        end = start
    return words[::-1]


def split_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): the words of every distinct host."""
    of_all = counts.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).first()
    total, longest = of_all["total"] or 0, of_all["longest"] or 1
    runs = F.filter(F.split(F.lower("host"), r"[^\p{L}]+"), lambda x: F.length(x) > 0)
    placed = stored(hosts.select("host").distinct().select("host", F.posexplode(runs).alias("place", "run")), "url-runs")
    distinct = placed.select("run").distinct()
    starts = distinct.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    parts = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("start") + 1))).alias("length"))
    parts = parts.select("run", "start", "length", F.substring("run", F.col("start"), F.col("length")).alias("word"))
    known = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length", "n")).alias("parts"))

    @F.arrow_udf("array<string>")
    def split(runs: pa.Array, parts: pa.Array) -> pa.Array:
        found = ({(x["start"], x["length"]): x["n"] for x in p or ()} for p in parts.to_pylist())
        return pa.array([best_split(r, p, total) for r, p in zip(runs.to_pylist(), found)], pa.list_(pa.string()))

    cut = distinct.join(known, "run", "left").select("run", split("run", "parts").alias("words"))
    by_place = F.array_sort(F.collect_list(F.struct("place", "words")))
    return placed.join(cut, "run").groupBy("host").agg(F.flatten(F.transform(by_place, lambda x: x["words"])).alias("words"))


# ------------------------------------------------------------- naive Bayes


def url_tokens(words: Column, path: Column) -> Column:
    """Tokens of a url: host words, and path words with digits as their number."""
    path_words = F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[^\p{L}0-9]+"), lambda x: F.length(x) > 0)
    return F.concat(
        F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(path_words, lambda w: F.concat(F.lit("p:"), w))
    )


def feature(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FEATURES)).cast("int")


def rule_tokens(rules: list[Rule]) -> list[str]:
    """The tokens that the rules themselves test, which so say nothing new."""
    found = {f"h:{w}" for r in rules for w in _LETTERS.findall(r.host.lower())}
    return sorted(found | {f"p:{w}" for r in rules for w in re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", r.path.lower()))})


def fit(labelled: DataFrame, rules: list[Rule]) -> list[float]:
    """Log odds (block against allow) of every feature from ``labelled`` (host,
    tokens, verdict).  A word counts once for a host and class, so that a host
    with very many pages is one piece of evidence; both classes weigh alike, and a
    word that neither class has weighs nothing."""
    token = labelled.select("verdict", "host", F.explode(F.array_distinct("tokens")).alias("t")).where(~F.col("t").isin(rule_tokens(rules)))
    token = token.select("verdict", "host", feature(F.col("t")).alias("f")).distinct()
    rows = token.groupBy("f").agg(F.sum((F.col("verdict") == "block").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    bad, good = [0.0] * FEATURES, [0.0] * FEATURES
    for r in rows:
        bad[r["f"]] += r["bad"]
        good[r["f"]] += r["n"] - r["bad"]
    alike = sum(bad) / sum(good) if sum(bad) and sum(good) else 1.0
    spark = labelled.sparkSession
    for r in spark.createDataFrame([(f"h:{w}",) for w in MARKED], "t string").select(feature(F.col("t")).alias("f")).collect():
        bad[r["f"]] += MARKED_HOSTS
    return [math.log(b + SMOOTHING) - math.log(g * alike + SMOOTHING) for b, g in zip(bad, good)]


def block_score(tokens: Column, odds: list[float], spark) -> Column:
    """Probability of ``block`` given the tokens, both classes alike beforehand."""
    shared = spark.sparkContext.broadcast(odds)

    @F.arrow_udf("double")
    def run(features: pa.Array) -> pa.Array:
        table = shared.value
        sums = (sum(table[f] for f in own or ()) for own in features.to_pylist())
        return pa.array([1 / (1 + math.exp(-min(700.0, max(-700.0, s)))) for s in sums], pa.float64())

    return run(F.transform(F.array_distinct(tokens), feature))


# ---------------------------------------------------------------- operator


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, host_words, score) of every row."""
    spark = pages.sparkSession
    host, path = host_and_path(col(url_col))
    urls = pages.select(col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    words = split_hosts(urls, stored(unigrams(pages, html_col), "url-unigrams"))
    tokens = url_tokens(F.col("words"), F.col("path")).alias("tokens")
    met = stored(urls.join(words, "host", "left").select("id", "host", "path", "rule", "words", tokens), "url-tokens")
    verdict_of = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.verdict))]) if rules else F.create_map(F.lit(""), F.lit(""))
    ruled = met.withColumn("verdict", verdict_of[F.col("rule")])
    odds = fit(ruled.where("verdict IS NOT NULL").select("host", "tokens", "verdict"), rules)
    scored = ruled.withColumn("score", block_score(F.col("tokens"), odds, spark))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("words", F.array().cast("array<string>")).alias("host_words"), "score")
