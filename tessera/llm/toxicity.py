"""Operator 7: toxic spans by a linear-chain conditional random field.

Documents carry a label, tokens do not, so tokens are labelled first: words and
word beginnings that occur in toxic documents in far more surroundings than in
clean ones mark their tokens as toxic (a surrounding is the pair of neighbouring
words, so that copies of one document count once).  They are proposed by the
fitting sample and judged over the larger statistics sample.  A
linear-chain CRF (tags clean and toxic; hashed features of the word, its
beginnings and its end; transition weights) is fitted on pieces of that sample.
Every token of every whole document then gets its forward-backward marginal.
The marginals make the document's score (a logistic curve over their sum, their
maximum and the length, fitted on the sample's documents), and runs of tokens
with a marginal of one half or more are the offending offsets.

Fitting: at most ``FIT_DOCUMENTS`` ids of each label, with one text of at most
``FIT_CHARS`` characters for each (of an id with several texts the one whose hash
is smallest), go to the driver; the rows of at most ``STAT_DOCUMENTS`` ids of each
label are counted by the executors.  Both are the ids with the smallest hashes and
documented bounds of the fit; scoring covers everything.  The sampled ids, no more
than twice ``STAT_DOCUMENTS``, are broadcast.  The weights are
``1 << FEATURE_BITS`` numbers whatever the corpus.

Defined results: null, empty and wordless texts score like a document without
any toxic token; repeated rows score alike; repeated labels of one id count as
toxic if one of them is.  If either label is missing from the sample there is
nothing to learn, and every score is 0.  Empty tables give empty results; other
columns, whatever their names, are carried along unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_words, col, packed

FEATURE_BITS = 16
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
FIT_DOCUMENTS = 1000  # of each label
STAT_DOCUMENTS = 20_000  # of each label
FIT_CHARS = 60_000  # of a document for fitting
PIECE = 24  # tokens of a training piece
FIT_PIECES = 12_000  # training pieces at most
LEAST_SEEN = 6  # surroundings of a toxic word or beginning in the fitting sample
LEAST_LIFT = 3.5  # its log odds over the statistics sample, toxic against clean
RUN_WORDS = 400_000  # words of consecutive documents scored side by side
MEMO_ENTRIES = 200_000  # words remembered per Python worker
THRESHOLD = 0.7

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}  # keeps offsets


def word_keys(word: bytes) -> list[bytes]:
    """The word, its beginnings and its end, by which tokens are described."""
    keys = [b"w" + word]
    keys += [b"%d" % n + word[:n] for n in BEGINNINGS if len(word) >= n]
    keys.append(b"e" + word[-3:])
    return keys


def feature_numbers(word: bytes) -> list[int]:
    return [zlib.crc32(k) & (1 << FEATURE_BITS) - 1 for k in word_keys(word)]


# --------------------------------------------------------------- inference


class Chains:
    """Documents of a batch, token by token side by side: step t of all documents
    that are long enough lies in one run of an array."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        most = int(ordered[0]) if len(ordered) else 0
        self.active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(most), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(doc)) - starts[doc]
        self.place = self.at[step] + rank[doc]  # of the tokens, document after document

    def marginals(self, odds: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
        """P(toxic) of every token, document after document.  ``odds``: log odds
        of the tokens; ``start``: of the first tag; ``moves``: 2x2 log weights.

        Forward and backward messages are kept as ratios toxic : clean, which a
        step maps by one fraction, so that no length under- or overflows.
        """
        a = np.exp(moves)
        e = np.empty(len(odds))
        e[self.place] = np.exp(np.clip(odds, -60, 60))
        forward, backward = np.empty_like(e), np.ones_like(e)
        steps = len(self.active)
        for t in range(steps):
            lo, hi = self.at[t], self.at[t + 1]
            if t == 0:
                forward[lo:hi] = e[lo:hi] * np.exp(start)
            else:
                r = forward[self.at[t - 1] : self.at[t - 1] + hi - lo]
                forward[lo:hi] = e[lo:hi] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
        for t in range(steps - 2, -1, -1):
            lo, n = self.at[t], self.active[t + 1]
            nxt = slice(self.at[t + 1], self.at[t + 1] + n)
            q = e[nxt] * backward[nxt]
            backward[lo : lo + n] = (a[1, 0] + q * a[1, 1]) / (a[0, 0] + q * a[0, 1])
        odds_all = forward * backward
        return (odds_all / (1 + odds_all))[self.place]


# ----------------------------------------------------------------- fitting


def key_contexts(words: list[bytes], wanted=None) -> Iterator[tuple[bytes, int]]:
    """(key, hash of the neighbouring words) of every token of four bytes or
    more, by its word and its beginnings of four bytes or more."""
    last = len(words) - 1
    keys_of: dict[bytes, list[bytes]] = {}
    for i, w in enumerate(words):
        if len(w) < 4:
            continue
        if (keys := keys_of.get(w)) is None:
            keys = keys_of[w] = [k for k in word_keys(w) if k[:1] in b"w4567" and (wanted is None or k in wanted)]
        if keys:
            around = zlib.crc32(words[i - 1] + b" " + words[i + 1] if 0 < i < last else b" ".join(words[max(0, i - 1) : i + 2]))
            for k in keys:
                yield k, around


def lift(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def proposed_keys(documents: list[tuple[int, list[bytes]]]) -> set[bytes]:
    """Keys that the sample's toxic documents show in enough surroundings, and
    oftener than its clean ones."""
    seen: tuple[dict, dict] = ({}, {})
    totals = [0, 0]
    for label, words in sorted(documents, reverse=True):
        totals[label] += 1
        for k, around in key_contexts(words, None if label else seen[1]):
            seen[label].setdefault(k, set()).add(around)
    return {k for k, s in seen[1].items() if len(s) >= LEAST_SEEN and lift(len(s), len(seen[0].get(k, ())), totals[1], totals[0]) >= 1}


def toxic_keys(sample: DataFrame, proposed: set[bytes]) -> set[bytes]:
    """The proposed keys that hold over ``sample`` (text, toxic)."""
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(proposed))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, label, c) for t, label in zip(batch.column(0), batch.column(1).to_pylist()) for k, c in key_contexts(byte_words(t.as_py()), wanted.value)}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.int64()))], ["key", "toxic", "around"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    seen = sample.select("text", F.col("toxic").cast("int")).mapInArrow(contexts, "key binary, toxic int, around bigint").distinct()
    rows = seen.groupBy("key").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    return {bytes(r["key"]) for r in rows if lift(r["bad"], r["n"] - r["bad"], totals.get(1, 0), totals.get(0, 0)) >= LEAST_LIFT}


def training_pieces(documents: list[tuple[int, list[bytes]]], keys: set[bytes]) -> list[tuple[list[bytes], list[int]]]:
    """Pieces of PIECE tokens with token tags: around every toxic token, and as
    many again spread over the other text."""
    rng = np.random.default_rng(0)
    toxic, clean = [], []
    for label, words in documents:
        tags = [int(label and len(w) >= 4 and not keys.isdisjoint(word_keys(w))) for w in words]
        for i in range(0, len(words), PIECE):
            (toxic if any(tags[i : i + PIECE]) else clean).append((words[i : i + PIECE], tags[i : i + PIECE]))
    half = FIT_PIECES // 2
    pick = lambda rows: [rows[i] for i in sorted(rng.permutation(len(rows))[:half])]
    return pick(toxic) + pick(clean)


def fit_chain(pieces: list[tuple[list[bytes], list[int]]], rounds: int = 80, decay: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the features, the start and the moves that maximise the tags'
    likelihood, by gradient ascent with adaptive steps."""
    n, size = len(pieces), 1 << FEATURE_BITS
    numbers: dict[bytes, list[int]] = {}
    rows, cols, mask, tags = [], [], np.zeros((n, PIECE), bool), np.zeros((n, PIECE), np.int64)
    for i, (words, own) in enumerate(pieces):
        mask[i, : len(words)] = True
        tags[i, : len(own)] = own
        for j, w in enumerate(words):
            f = numbers.get(w) or numbers.setdefault(w, feature_numbers(w))
            rows += [i * PIECE + j] * len(f)
            cols += f
    rows_, cols_ = np.array(rows), np.array(cols)
    theta = np.zeros(size + 5)
    theta[size + 1 : size + 5] = [1.0, -1.0, -0.5, 0.5]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    for k in range(1, rounds + 1):
        w, start, moves = theta[:size], theta[size], theta[size + 1 :].reshape(2, 2)
        odds = np.bincount(rows_, w[cols_], n * PIECE).reshape(n, PIECE)
        e = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -60, 60))], 2) * mask[:, :, None] + (~mask)[:, :, None]
        a = np.exp(moves)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] * np.array([1.0, np.exp(start)])
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, PIECE):
            step = (alpha[:, t - 1] @ a) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(PIECE - 2, -1, -1):
            step = (e[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = np.where(mask[:, t + 1, None], step / step.sum(1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        grad = np.zeros_like(theta)
        miss = np.where(mask, tags - post[:, :, 1], 0.0)
        grad[:size] = np.bincount(cols_, miss.ravel()[rows_], size)
        grad[size] = miss[:, 0].sum()
        for i in (0, 1):
            for j in (0, 1):
                real = ((tags[:, :-1] == i) & (tags[:, 1:] == j) & both).sum()
                grad[size + 1 + 2 * i + j] = real - pair[:, :, i, j][both].sum()
        grad = grad / n - decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += 0.25 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8) * (1 if k < rounds // 2 else 0.4)
    return theta[:size].astype(np.float32), float(theta[size]), theta[size + 1 :].reshape(2, 2)


def summary(p: np.ndarray) -> list[float]:
    """What a document's marginals are judged by."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    total = float(p[p >= 0.5].sum())
    return [1.0, float(np.log1p(total)), float(p.max()), float(np.log1p(100 * total / len(p)))]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the classes weigh alike."""
    w = np.zeros(x.shape[1])
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.3 * w)
    return w


@dataclass
class Model:
    weights: np.ndarray
    start: float
    moves: np.ndarray
    curve: np.ndarray | None

    def marginals(self, documents: list[list[bytes]], memo: dict[bytes, float]) -> list[np.ndarray]:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for w in {w for words in documents for w in words}.difference(memo):
            memo[w] = float(self.weights[feature_numbers(w)].sum())
        lengths = np.array([len(words) for words in documents], np.int64)
        odds = np.fromiter((memo[w] for words in documents for w in words), np.float64, int(lengths.sum()))
        p = Chains(lengths).marginals(odds, self.start, self.moves)
        return np.split(p, np.cumsum(lengths)[:-1]) if len(lengths) else []

    def score(self, p: np.ndarray) -> float:
        if self.curve is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.array(summary(p)) @ self.curve, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Model from the texts of ``docs`` and the 0/1 labels in ``labels``, by ids
    for which ``learn``, a condition on column ``id``, holds."""
    one = labels.select(col(id_col).alias("id"), col(toxic_col).cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1))
    one = one.groupBy("id").agg(F.max("toxic").alias("toxic"))
    empty = Model(np.zeros(1 << FEATURE_BITS, np.float32), 0.0, np.zeros((2, 2)), None)
    drawn = one.withColumn("draw", F.xxhash64("id"))
    lowest = [drawn.where(F.col("toxic") == label).orderBy("draw", "id").limit(STAT_DOCUMENTS) for label in (0, 1)]
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "id"))
    # a few ten thousand ids at most, by the limits above
    ids = F.broadcast(lowest[0].unionByName(lowest[1]).select("id", "toxic", (place <= FIT_DOCUMENTS).alias("fit")))
    sample = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text IS NOT NULL").join(ids, "id")
    own = sample.where(F.col("fit") & (F.length("text") <= FIT_CHARS)).groupBy("id", "toxic")
    rows = own.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text").collect()
    documents = sorted((r["toxic"], byte_words(r["text"])) for r in rows)
    if len({label for label, _ in documents}) < 2:
        return empty
    keys = toxic_keys(sample.select("text", "toxic"), proposed_keys(documents))
    weights, start, moves = fit_chain(training_pieces(documents, keys))
    model = Model(weights, start, moves, None)
    x = np.array([summary(p) for p in model.marginals([w for _, w in documents], {})])
    model.curve = fit_curve(x, np.array([label == 1 for label, _ in documents]))
    return model


# ---------------------------------------------------------------- operator


def offsets(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    """Code-point ranges [start, end) of runs of toxic tokens."""
    out: list[dict[str, int]] = []
    last = False
    for m, bad in zip(_WORD.finditer(text.translate(_LOWER)), toxic.tolist(), strict=True):
        if bad and last:
            out[-1]["end"] = m.end()
        elif bad:
            out.append({"start": m.start(), "end": m.end()})
        last = bad
    return out


def tag(text: Column, model: Model, spark) -> Column:
    """struct<score, spans> of a text column."""
    shared = spark.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, memo = shared.value, {}
        for texts in batches:
            scores, spans, run_ = [], [], []
            size = 0
            for i, t in enumerate(texts):
                run_.append((t.as_py(), byte_words(t.as_py())))
                size += len(run_[-1][1])
                if size < RUN_WORDS and i + 1 < len(texts):
                    continue
                for (t_, _), p in zip(run_, own.marginals([w for _, w in run_], memo)):
                    scores.append(own.score(p))
                    spans.append(offsets(t_, p >= 0.5) if own.curve is not None and len(p) and p.max() >= 0.5 else [])
                run_, size = [], 0
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, spans_type)], ["score", "spans"])

    return run(text)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    rows = docs.select(packed(docs), tag(col(text_col), model, docs.sparkSession).alias("found"))
    return rows.where(F.col("found.score") < threshold).select("row.*")
