"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings compares their subsequences of three characters, gaps allowed: a subsequence over a span of s
characters weighs LAMBDA**s, spans longer than ``SPAN`` are left out, and values are normalised to 1 for equal strings
without repeated subsequences. An insult with a character put in or left out still shares most of them with the plain one.

Units are words without their punctuation (spaced-out letters count as one word) with a mark at both ends; a text is as toxic as its worst unit.
Units are mapped to kernel values against landmarks, whitened by the landmarks' own kernel matrix (Nyström), and a
linear SVM with squared hinge loss is fitted there. Labels are of whole texts, so that the units of toxic texts that
count as insults are chosen in rounds: at first those frequent in toxic texts and absent from others, then the
worst-scoring unit of every toxic text. As the fitted function is a sum over landmarks, its weight for each subsequence is
summed up front, which gives the same scores.

Fitting uses at most ``FIT_DOCS`` labelled texts of each label, those of smallest hash of their id; all else covers all rows.

Cases: null and empty texts have no unit and the score of the lowest margin; texts of any length are read whole; rows
that repeat get equal scores; a document with contradictory labels counts as toxic; without both labels every
score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import map_arrow

FIT_DOCS = 1500
LANDMARKS = 300
LAMBDA, SPAN = 0.7, 6
ROUNDS = 3
#: Margins of units remembered by one worker before its memory of them starts anew.
REMEMBERED = 300_000
#: Products of weights that the fit holds at a time.
CELLS = 2_000_000
#: Units whose margins are taken at a time.
BLOCK = 20_000
THRESHOLD = 0.3
MARGIN_FLOOR = -4.0
#: Classes of characters: a-z, others by code point, and the two marks.
ALPHABET = 64
_CLASS = 27 + np.arange(0x110000) % 35
_CLASS[97:123] = np.arange(1, 27)
_CLASS[[2, 3]] = 62, 63
GAPS = [(a, a + b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_POINTS = re.compile(r"[^\w\s]+|_+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def units(text: str) -> set[str]:
    """Distinct units of a text: lower-cased words without punctuation, and runs of single letters as one."""
    low = _POINTS.sub("", text.lower())
    return {*low.split(), *("".join(m.split()) for m in _SPACED.findall(low))}


@dataclass(frozen=True)
class Codes:
    """Subsequences of units: for each occurrence the unit it lies in, its code, and its weight."""
    unit: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    size: int


def spelt(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the characters of units between their marks, first position of each unit, characters left from each position on."""
    code = np.frombuffer("".join("\x02" + u + "\x03" for u in found).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(u) + 2 for u in found], np.int64)
    first = np.cumsum(size) - size
    return _CLASS[code], first, np.repeat(first + size, size) - np.arange(len(code))


def subsequences(found: list[str]) -> Codes:
    char, first, left = spelt(found)
    owner = np.repeat(np.arange(len(found)), np.diff(np.r_[first, len(char)]))
    parts = []
    for a, b in GAPS:
        at = np.flatnonzero(left > b)
        parts.append((owner[at], (char[at] * ALPHABET + char[at + a]) * ALPHABET + char[at + b], np.full(len(at), LAMBDA ** (b + 1))))
    return Codes(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(found))


def norms(codes: Codes) -> np.ndarray:
    """Root of the sum of squares over occurrences, by which a unit's weights are divided."""
    return np.sqrt(np.maximum(np.bincount(codes.unit, codes.weight**2, codes.size), 1e-12))


def kernel(a: Codes, b: Codes) -> np.ndarray:
    """Normalised kernel matrix of two lists of units."""
    names, place = np.unique(b.code, return_inverse=True)
    at = np.searchsorted(names, a.code)
    at[at == len(names)] = 0
    hit = names[at] == a.code if len(names) else np.zeros(len(a.code), bool)
    table = np.zeros((len(names), b.size))
    np.add.at(table, (place, b.unit), b.weight)
    out = np.zeros((a.size, b.size))
    rows, codes, weights = a.unit[hit], at[hit], a.weight[hit]
    step = max(1, CELLS // max(1, b.size))
    for k in range(0, len(rows), step):
        np.add.at(out, rows[k:k + step], table[codes[k:k + step]] * weights[k:k + step, None])
    return out / norms(a)[:, None] / norms(b)[None, :]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e4, rounds: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the points inside the margin; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + c * a.T @ x[inside], c * a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


@dataclass(frozen=True)
class Model:
    """Weight of every subsequence (summed over landmarks), bias, and the sigmoid from margin to score."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: list[str]) -> np.ndarray:
        if not len(self.weights) or not found:
            return np.full(len(found), MARGIN_FLOOR)
        return np.concatenate([self._margins(found[k:k + BLOCK]) for k in range(0, len(found), BLOCK)])

    def _margins(self, found: list[str]) -> np.ndarray:
        char, first, left = spelt(found)
        total, square = np.zeros(len(char)), np.zeros(len(char))
        for a, b in GAPS:
            n = len(char) - b
            if n > 0:
                code = (char[:n] * ALPHABET + char[a:n + a]) * ALPHABET + char[b:]
                total[:n] += np.where(left[:n] > b, self.weights[code], 0.0) * LAMBDA ** (b + 1)
                square[:n] += (left[:n] > b) * LAMBDA ** (2 * b + 2)
        return np.add.reduceat(total, first) / np.sqrt(np.maximum(np.add.reduceat(square, first), 1e-12)) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """SVM over units of labelled texts."""
    if not toxic or not clean:
        return Model(np.empty(0), MARGIN_FLOOR, 0.0, -30.0)
    random = np.random.Generator(np.random.PCG64(seed))
    one: dict[str, str] = {}  # a word that many texts hold is kept once
    bad, fine = ([sorted(one.setdefault(u, u) for u in units(t)) for t in texts] for texts in (toxic, clean))
    bad = without_copies(bad)
    bad_df, good_df = Counter(itertools.chain.from_iterable(bad)), Counter(itertools.chain.from_iterable(fine))
    # so frequent that a word of equal rate would be absent from the other texts once in 10,000 times at most
    least = max(2.0, np.log(1e4) * len(bad) / len(clean), len(bad) / 60)
    chosen = covering(bad, [u for u, n in bad_df.items() if n >= least and not good_df[u] and len(u) > 2], least)
    chosen = chosen or sorted({max(us, key=lambda u: (bad_df[u] / (1 + good_df[u]), u)) for us in bad if us})
    good = sorted(good_df)
    negative = {*(good[k] for k in random.permutation(len(good))[:4000]), *(u for u, _ in good_df.most_common(500))}
    model, flat = None, sorted(bad_df)
    for _ in range(ROUNDS):
        # landmarks: the most frequent insults, others evenly over the alphabet, and ordinary words
        top = sorted(chosen, key=lambda u: (-bad_df[u], u))[:landmarks // 3]
        marks = sorted({*top, *(chosen[k] for k in np.linspace(0, len(chosen) - 1, min(len(chosen), landmarks // 3)).astype(int)),
                        *sorted(negative, key=lambda u: (hash_of(u), u))[:landmarks // 3]})
        b = subsequences(marks)
        values, vectors = np.linalg.eigh(kernel(b, b))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        found = [*chosen, *sorted(negative)]
        y = np.r_[np.ones(len(chosen)), -np.ones(len(negative))]
        often = np.array([bad_df[u] ** 0.5 for u in chosen])
        weight = np.r_[0.5 * often / often.sum(), np.full(len(negative), 0.5 / len(negative))]
        w = fit_svm(kernel(subsequences(found), b) @ white, y, weight)
        # f(u) = sum over landmarks of beta k(u, landmark): one weight for each subsequence
        beta = white @ w[:-1] / norms(b)
        model = Model(np.bincount(b.code, b.weight * beta[b.unit], ALPHABET**3), float(w[-1]), 1.0, 0.0)
        margin = dict(zip(flat, model.margins(flat).tolist(), strict=True))
        own = set(chosen)
        worst = Counter(max(us, key=lambda u: (margin[u], u)) for us in bad if us and own.isdisjoint(us))
        chosen = sorted(own | {u for u in worst if not good_df[u] and margin[u] > 0.5 and bad_df[u] > 1})
        hard = model.margins(good)
        negative |= {good[k] for k in np.argsort(-hard, kind="stable")[:1500]}
    margin.update(zip(good, hard.tolist(), strict=True))
    high, low = (np.array([max((margin[u] for u in us), default=MARGIN_FLOOR) for us in group]) for group in (bad, fine))
    return calibrated(model, high, low)


def without_copies(texts: list[list[str]]) -> list[list[str]]:
    """Texts that share less than half of their units with each text kept before: the words of copies count once."""
    kept, holders = [], {}
    for us in sorted(texts, key=lambda us: (-len(us), us)):
        met = Counter(itertools.chain.from_iterable(holders.get(u, ()) for u in us))
        if us and (not met or 2 * met.most_common(1)[0][1] < len(us)):
            for u in us:
                holders.setdefault(u, []).append(len(kept))
            kept.append(us)
    return kept


def covering(texts: list[list[str]], names: list[str], least: float, times: int = 4) -> list[str]:
    """Of names, the most frequent first, those needed to find each text ``times`` times: words that come with a group
    of copies alone add nothing to the insults in it."""
    found: dict[str, list[int]] = {u: [] for u in names}
    for k, us in enumerate(texts):
        for u in us:
            if u in found:
                found[u].append(k)
    need, out = np.full(len(texts), times), []
    for u in sorted(names, key=lambda u: (-len(found[u]), u)):
        if np.count_nonzero(need[found[u]]) >= max(1, least / 3):
            out.append(u)
            need[found[u]] = np.maximum(need[found[u]] - 1, 0)
    return sorted(out)


def hash_of(unit: str) -> int:
    import zlib

    return zlib.crc32(unit.encode("utf-8", "surrogatepass"))


def calibrated(model: Model, high: np.ndarray, low: np.ndarray) -> Model:
    """Sigmoid from the worst margin of a text to the probability that it is toxic, by Newton steps on balanced labels."""
    x, y = np.r_[high, low], np.r_[np.full(len(high), 1 - 1 / (len(high) + 2)), np.full(len(low), 1 / (len(low) + 2))]
    weight = np.r_[np.full(len(high), 0.5 / len(high)), np.full(len(low), 0.5 / len(low))]
    a = np.array([1.0, 0.0])
    z = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-4 * a
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), gradient)
        a = a - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.bias, float(a[0]), float(a[1]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, each: int = FIT_DOCS) -> tuple[list[str], list[str]]:
    """Texts labelled 1 and 0: at most ``each`` of either, those of smallest hash of their id, held-out ids left out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    few = [own.where(F.col("toxic") == value).orderBy("h", "id").limit(each) for value in (1, 0)]
    # at most 2 * each rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(few[0].unionByName(few[1])), "id")
    rows = texts.where(F.col("text").isNotNull()).select("id", "toxic", "text").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own, known = spread.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [units(t) if t else set() for t in part.column(1).to_pylist()]
                new = list(set().union(*sets).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, list(set().union(*sets))
                known.update(zip(new, own.margins(new).tolist(), strict=True))
                worst = np.array([max(map(known.__getitem__, s), default=MARGIN_FLOOR) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(worst), pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted): learned from labels that aren't held out, scored for all documents."""
    model = fit(*training_texts(docs, labels))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                           (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
