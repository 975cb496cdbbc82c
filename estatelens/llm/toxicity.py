"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they stand for, and turns all else that is no
letter into spaces. Patterns are words, or word beginnings (stems), anchored at spaces. Matches inside an exception phrase
don't count. A text's weight sum and its weight for each hundred words give the score through a logistic function.

All is learned from a bounded sample of the labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` rows, those of the smallest
hashes): words and stems with log-odds weights, and as exception phrases the pairs of words that hold a match and are found in
clean texts far oftener than the match is. Near copies in the sample, found by their fingerprints, count once, so that a copied
text doesn't make its words look toxic. One third of the sample is kept back to fit the logistic function. A lexicon and
exceptions of one's own can be given besides. Every text is scored whole, in time that grows with its length.

Edge cases: null and empty texts score like a text without a match. Labels that are null, of null ids or of ids that no
document has are ignored; with no label of either class the given lexicon, none by default, and the default logistic function
hold. Of rows that share a labelled id one text counts. Very long texts are scored whole. Repeated rows are scored each, an
empty table gives an empty result. Result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, arrow_limits, byte_texts, cut, table
from .simhash import fingerprint

#: Bound of the sample that the lexicon and the logistic function are fitted on, in labelled rows.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: The least log-odds of an entry, the fewest texts that hold it, and the chance that an entry is an accident, at most.
LEAST_WEIGHT, LEAST_TEXTS, CHANCE = 1.5, 5, 1e-7
STEM_LENGTHS = range(3, 9)
NEAR_BITS = 5
#: Features that a task counts before it hands them on, which bounds its memory.
FLUSH = 100_000

# Characters that stand for a letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


class Fold(dict):
    """A table for str.translate that decides each character once."""

    def __missing__(self, code: int):
        c = chr(code)
        to = HOMOGLYPHS.get(c) or DIGITS.get(c) or (c if c.isalpha() else " ")
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            half = chr(code - 0xFEE0).lower()
            to = DIGITS.get(half) or (half if half.isalpha() else " ")
        elif 0x200B <= code <= 0x200F or code in (0xAD, 0xFEFF) or 0x300 <= code <= 0x36F:  # invisible, or on top of a letter
            to = None
        self[code] = to
        return to


FOLD = Fold()


def fold(text: str | None) -> str:
    """Letters and single spaces, with a space at both ends."""
    return f" {' '.join((text or '').lower().translate(FOLD).split())} "


def features(folded: str) -> set[str]:
    """The words (spaces at both ends) and their stems (a space before) of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEM_LENGTHS if n <= len(w))
    return out


class Model:
    """A lexicon with its exception phrases, and the logistic function's coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), coefficients: tuple[float, float, float] = (-3.0, 1.5, 0.5)):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self.automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.__init__(*state)

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, w in self.weights.items():
            self.automaton.add_word(k, (len(k), w))
        for x in self.exceptions:
            self.automaton.add_word(k := fold(x), (len(k), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """The sum of the matches' weights (of matches that start at one place, the heaviest) and the number of words."""
        if self.automaton is None:
            self.build()
        folded = fold(text)
        hits: dict[int, float] = {}
        harmless = []
        for end, (n, w) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = end - n + 1
            if w is None:
                harmless.append((start, end))
            elif w > hits.get(start, 0):
                hits[start] = w
        if harmless:
            # a hit is harmless if a phrase that begins by then ends after its start: the furthest end of those that have begun
            harmless.sort()
            begun, furthest = [a for a, _ in harmless], []
            for _, b in harmless:
                furthest.append(max(b, furthest[-1]) if furthest else b)
            hits = {s: w for s, w in hits.items() if not (k := bisect_right(begun, s)) or furthest[k - 1] <= s}
        return sum(hits.values()), folded.count(" ") - 1 if len(folded) > 2 else 0

    @staticmethod
    def inputs(weight: float, words: int) -> tuple[float, float]:
        return math.log1p(weight), math.log1p(100 * weight / (words + 20))

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.inputs(*self.measure(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def evidence(t: int, c: int, share: float) -> float:
    """How far t of t + c is above its expected share: the exponent of the chance of that (Chernoff's bound)."""
    n = t + c
    return t * math.log(t / (n * share)) + (c * math.log(c / (n * (1 - share))) if c else 0.0) if t > n * share else 0.0


def choose_entries(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: int = LEAST_TEXTS) -> dict[str, float]:
    """Of (feature, toxic texts, clean texts) the entries and their weights.

    Whole words come first. A stem becomes an entry for what the chosen words under it leave of its counts, if that still
    weighs enough; the longest stem that keeps nine tenths of it stands for the shorter ones.
    """

    def weight(t: int, c: int) -> float:
        return math.log((max(t, 0) + 0.5) / (toxic + 1)) - math.log((max(c, 0) + 0.5) / (clean + 1))

    def good(t: int, c: int) -> bool:
        return t >= least and weight(t, c) >= LEAST_WEIGHT and evidence(t, max(c, 0), toxic / (toxic + clean)) >= -math.log(CHANCE)

    words = {f: (t, c) for f, t, c in counts if f[-1] == " " and good(t, c)}
    left = {f: [t, c] for f, t, c in counts if f[-1] != " "}
    for f, (t, c) in words.items():
        for n in STEM_LENGTHS:
            if f[: n + 1] in left:
                left[f[: n + 1]][0] -= t
                left[f[: n + 1]][1] -= c
    left = {f: x for f, x in left.items() if good(*x)}
    longer: dict[str, list[str]] = {}
    for f in left:
        longer.setdefault(f[:-1], []).append(f)
    out = {f: weight(*x) for f, x in words.items()}
    taken: set[str] = set()
    for f in sorted(left, key=lambda x: (len(x), x)):
        if any(f[:n] in taken for n in range(2, len(f) + 1)):
            continue
        taken.add(f)
        while more := [g for g in longer.get(f, ()) if left[g][0] >= 0.9 * left[f][0]]:
            f = max(more, key=lambda g: (left[g][0], g))
        out[f] = weight(*left[f])
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def pairs_with(folded: str, weights: Mapping[str, float]) -> set[tuple[str, str]]:
    """(entry, phrase) for each entry of a folded text's words, the phrase being the word with the one before or behind it."""
    words = folded.split()
    out = set()
    for i, w in enumerate(words):
        for f in (f" {w} ", *(f" {w[:n]}" for n in STEM_LENGTHS if n <= len(w))):
            if f in weights:
                out |= {(f, f"{a} {b}") for a, b in zip(words[max(0, i - 1) : i + 1], words[max(1, i) : i + 2])} | {(f, "")}
    return out


def choose_exceptions(counts: list[tuple[str, str, int, int]], least: int = LEAST_TEXTS) -> tuple[str, ...]:
    """Of (entry, phrase, toxic texts, clean texts) the phrases that are clean though their entry is toxic; phrase '' counts the entry.

    A phrase needs ``least`` clean texts, more than toxic ones, and a chance of at most ``CHANCE`` of so many if it were like its entry elsewhere.
    """
    whole = {f: (t, c) for f, x, t, c in counts if not x}
    out = set()
    for f, x, t, c in counts:
        if x and c >= least and c > t:
            others_t, others_c = whole[f][0] - t, max(0, whole[f][1] - c)
            if others_t > 0 and evidence(c, t, (others_c + 0.5) / (others_t + others_c + 1)) >= -math.log(CHANCE):
                out.add(x)
    return tuple(sorted(out))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps on the ridge-penalised likelihood."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def near_distinct(rows: list[tuple[int, int]], bits: int = NEAR_BITS) -> list[int]:
    """Of (key, fingerprint) rows the keys whose fingerprint is over ``bits`` from that of every key taken before."""
    keys, fps = [], np.zeros(len(rows), np.uint64)
    for key, fp in rows:
        if not len(keys) or np.bitwise_count(fps[: len(keys)] ^ np.uint64(fp)).min() > bits:
            fps[len(keys)] = fp
            keys.append(key)
    return keys


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lexicon: Mapping[str, float] | None = None, exceptions: tuple[str, ...] = ()) -> Model:
    """The model learned from the labelled rows for which ``usable``, a condition on the labels' columns, holds.

    ``lexicon`` (words with weights) and ``exceptions`` (phrases) are added to what is learned; a learned weight comes first.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    given = {fold(k): w for k, w in (lexicon or {}).items()}
    known = labels.where(f"{label_col} IN (0, 1) AND {id_col} IS NOT NULL")
    known = (known if usable is None else known.where(usable)).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = {y: known.where(f"y = {y}").distinct().orderBy(F.xxhash64("k"), "k").limit(m) for y, m in ((0, MAX_CLEAN), (1, MAX_TOXIC))}
    ids = spark.createDataFrame([tuple(r) for y in chosen for r in chosen[y].collect()], "k long, y int")  # bounded by the two limits
    sample = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(ids), "k")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in byte_texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], names=["k", "t", "y", "fp"])

    # a text for each id, however many rows have it
    sample = sample.groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "t", "y")
    sample = cut(sample.mapInArrow(prints, "k long, t string, y int, fp long"))
    rows = sample.select("k", "y", "fp").orderBy(F.xxhash64("k"), "k", "y").collect()
    taken = {k: i % 3 == 2 for i, k in enumerate(near_distinct([(r["k"], r["fp"] % (1 << 64)) for r in rows]))}
    count = Counter(r["y"] for r in rows if taken.get(r["k"]) is False)
    if not count[0] or not count[1]:
        return Model(given, exceptions)
    shared = spark.sparkContext.broadcast(taken)

    def counted(found) -> DataFrame:
        """Of the sample's learning part, for each of what ``found`` names in a folded text, the toxic and the clean texts that have it."""

        def flush(seen: dict[str, list[int]]) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (1, 0))], names=["f", "t", "c"])
            seen.clear()
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, list[int]] = {}
            for b in batches:
                for k, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if shared.value.get(k) is False:
                        for f in found(fold(t)):
                            seen.setdefault(f, [0, 0])[y] += 1
                            if len(seen) > FLUSH:
                                yield flush(seen)
            yield flush(seen)

        return sample.select("k", "t", "y").mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    share = count[1] / (count[0] + count[1])
    floor = math.exp(LEAST_WEIGHT) * (count[1] + 1) / (count[0] + 1)
    # the conditions of an entry; those of a stem hold for what words leave of it, and are looked at again. The sample bounds how many pass
    strong = F.expr(f"t * ln(t / ((t + c) * {share!r})) + if(c > 0, c * ln(c / ((t + c) * {1 - share!r})), 0) >= {-math.log(CHANCE)!r}")
    fits = (F.col("t") >= LEAST_TEXTS) & (F.col("t") + 0.5 >= floor * (F.col("c") + 0.5)) & strong
    counts = [tuple(r) for r in counted(features).where(fits).orderBy("f").collect()]
    weights = given | choose_entries(counts, count[1], count[0])

    def phrases(folded: str) -> list[str]:
        return [f"{f}\n{x}" for f, x in pairs_with(folded, weights)]

    held = [(*r["f"].split("\n"), r["t"], r["c"]) for r in counted(phrases).where(F.col("f").endswith("\n") | ((F.col("c") >= LEAST_TEXTS) & (F.col("c") > F.col("t")))).collect()]
    model = Model(weights, (*choose_exceptions(held), *exceptions))

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*Model.inputs(*model.measure(t)), y) for k, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if shared.value.get(k)]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(3)], names=["a", "b", "y"])

    m = sample.select("k", "t", "y").mapInArrow(measures, "a double, b double, y double").toPandas().to_numpy()  # a row for each id kept back
    m = m[np.lexsort(m.T)]  # the sums below must not depend on the order of tasks
    if len(set(m[:, 2].tolist())) == 2:
        share = {y: size[y] / max(1, (m[:, 2] == y).sum()) for y in (0, 1)}  # back to the classes' own sizes
        weight = np.where(m[:, 2] == 1, share[1], share[0])
        model.coefficients = fit_logistic(m[:, :2], m[:, 2], weight / weight.mean())
    return model


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the score of every whole text."""

    def make():
        model.build()
        return lambda col: [pa.array([model.score(t) for t in col.to_pylist()], pa.float64())]

    return annotate(docs, [text_col], make, [T.StructField(out_col, T.DoubleType())], drop)


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the tables in ``sf_dir``, learned from the labels of ids whose crc32 modulo 5 isn't 0."""
    return train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fitted(spark, docs, sf_dir), drop=("text",))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
