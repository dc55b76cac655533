"""Operator 10: language identification by hierarchical discrimination.

A text becomes a vector of hashed letter n-grams (square roots of their counts,
scaled to length one; case, digits and ASCII punctuation do not count).  Linear
support vector machines choose the language *family* first, one against the
rest; within the family every pair of languages has a machine of its own, and
the language with the most pairwise support wins.  Families are a parameter; a
language that it does not name is a family of its own.

Fitting: the driver fits the machines on a sample of about ``FIT_DOCUMENTS``
labelled rows of each language, chosen by a hash of id and text; copies of a row
count once, so that their number moves neither the share nor the sample.  The
vectors are computed by the executors and have at most ``1 << FEATURE_BITS``
entries each.  Every language is learned: more than ``FIT_LANGUAGES`` of them are
an error, never a silent choice.  Prediction covers the whole text of every row,
with weights whose size does not depend on the corpus.

Defined results: a null text, or one without any letter, is ``und`` with score
0; ties go to the language that sorts first; repeated rows get equal results.
Without any labelled row to learn from, every text is ``und``.  Empty tables give
empty results; other columns, whatever their names, are carried along unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, packed

FEATURE_BITS = 13
ORDERS = (2, 3, 4)  # bytes of an n-gram
FIT_DOCUMENTS = 500  # of each language, for fitting
FIT_LANGUAGES = 500  # more are an error, unless the caller allows them
SHARPNESS = 6.0  # of the logistic curve from margins to scores
UNKNOWN = "und"

FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def features(text: str) -> np.ndarray:
    """Unit vector of the text's n-grams."""
    body = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    x = np.frombuffer(body, np.uint8).astype(np.uint32)
    counts = np.zeros(1 << FEATURE_BITS, np.int64)
    gram = x
    for n in range(2, max(ORDERS) + 1):
        gram = (gram[:-1] << np.uint32(8) if n <= 4 else gram[:-1] * np.uint32(257)) | x[n - 1 :]
        if n in ORDERS and len(gram):
            hashed = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)
            counts += np.bincount(hashed, minlength=len(counts))
    v = np.sqrt(counts, dtype=np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by dual coordinate descent; the
    last weight is the bias.  ``y`` is +1 or -1; classes weigh alike."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * c * weight)
    w, alpha = np.zeros(x.shape[1] + 1, np.float32), np.zeros(n)
    size = np.einsum("ij,ij->i", x, x) + 1 + slack
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - g / size[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[:-1] += np.float32(step * y[i]) * x[i]
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families, their languages, and the machines' weights."""

    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray  # (families, features + 1)
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            x = np.stack([features(texts[i]) for i in some])
            for k, answer in enumerate(self._families_then_pairs(x)):
                out[some[k]] = answer
        return out

    def _families_then_pairs(self, x: np.ndarray) -> Iterator[tuple[str, float]]:
        margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        support = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        support /= support.sum(axis=1, keepdims=True)
        best = support.argmax(axis=1)
        pairs = {k: 1 / (1 + np.exp(-SHARPNESS * (x @ w[:-1] + w[-1]))) for k, w in self.pair_weights.items()}
        for i, f in enumerate(best.tolist()):
            names = self.languages[self.families[f]]
            if len(names) == 1:
                yield names[0], float(support[i, f])
                continue
            votes = dict.fromkeys(names, 0.0)
            for a, b in combinations(names, 2):
                p = float(pairs[a, b][i])
                votes[a] += p
                votes[b] += 1 - p
            name = max(names, key=lambda n: (votes[n], [-ord(c) for c in n]))
            yield name, float(support[i, f]) * votes[name] / (len(names) - 1)


def fit_sample(labelled: DataFrame, per_language: int = FIT_DOCUMENTS, most_languages: int = FIT_LANGUAGES) -> list[tuple[str, np.ndarray]]:
    """(language, vector) of the sampled rows of ``labelled`` (id, text, lang)."""
    labelled = labelled.select("lang", "text", F.xxhash64("id", "text").alias("row"))
    counts = labelled.select("lang", "row").distinct().groupBy("lang").count().limit(most_languages + 1).collect()
    if not counts:
        return []
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages: fit fewer at a time, or allow more by most_languages")
    draw = F.pmod("row", F.lit(1_000_000))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1_000_000, 1 + 1_000_000 * per_language // r["count"])))])
    sample = labelled.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of this task: no larger than the sample
        for batch in batches:
            rows = []
            for lang, row, text in zip(batch.column("lang").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                if (lang, row) not in seen:
                    seen.add((lang, row))
                    if has_letter(body := text.as_py()):
                        rows.append((lang, row, features(body)))
            at = [np.flatnonzero(v).astype(np.int16) for _, _, v in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v[a].astype(np.float16).tobytes() for (_, _, v), a in zip(rows, at)], pa.binary())],
                ["lang", "row", "at", "value"],
            )

    found = sample.select("lang", "row", "text").mapInArrow(vectors, "lang string, row long, at binary, value binary")
    found = found.dropDuplicates(["lang", "row"]).select("lang", "at", "value").collect()
    out = []
    for r in sorted(found):
        v = np.zeros(1 << FEATURE_BITS, np.float32)
        v[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float16)
        out.append((r["lang"], v))
    return out


def fit(labelled: DataFrame, families: dict[str, str] | None = None, per_language: int = FIT_DOCUMENTS, most_languages: int = FIT_LANGUAGES) -> Model:
    """Model from ``labelled`` (id, text, lang); rows without text or lang are skipped."""
    family_of = FAMILIES if families is None else families
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = fit_sample(usable, per_language, most_languages)
    languages: dict[str, list[str]] = {}
    for lang in sorted({lang for lang, _ in sample}):
        languages.setdefault(family_of.get(lang, lang), []).append(lang)
    names = sorted(languages)
    if not names:
        return Model([], {}, np.zeros((0, 1)), {})
    x = np.stack([v for _, v in sample])
    lang = np.array([n for n, _ in sample])
    family = np.array([family_of.get(n, n) for n in lang])
    if len(names) == 1:
        weights = [np.zeros(x.shape[1] + 1, np.float32)]
    else:
        weights = [fit_machine(x, np.where(family == f, 1.0, -1.0)) for f in names]
    pairs = {}
    for f in names:
        for a, b in combinations(languages[f], 2):
            own = (lang == a) | (lang == b)
            pairs[a, b] = fit_machine(x[own], np.where(lang[own] == a, 1.0, -1.0))
    return Model(names, languages, np.stack(weights), pairs)


def predict(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred string, score double> of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), 256):
                for name, score in shared.value.predict(texts[at : at + 256].to_pylist()):
                    names.append(name)
                    scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(text)


def keep_known(docs: DataFrame, labelled: DataFrame, text_col: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language (one of ``wanted``, if
    given); rows without any letter go.  Where there is nothing to learn from and no
    language is wanted, all rows with a letter stay."""
    model = fit(labelled)
    if not model.families and wanted is None:

        @F.arrow_udf("boolean")
        def lettered(texts: pa.Array) -> pa.Array:
            return pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_())

        return docs.where(lettered(col(text_col)))
    rows = docs.select(packed(docs), predict(col(text_col), model, docs.sparkSession).alias("found"))
    good = F.col("found.lang_pred") != UNKNOWN
    if wanted is not None:
        good &= F.col("found.lang_pred").isin(wanted)
    return rows.where(good).select("row.*")
