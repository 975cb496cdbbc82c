"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text recognises all its substrings. A text is parsed, from its start to its
end, into the longest phrases that the automaton knows; the language that needs the fewest phrases for its letters wins.
Labelled text comes from a bounded sample (``SAMPLE_CHARS`` characters of the rows with the smallest hashes of their text).

Texts are parsed whole. To take many steps at a time a text is dealt to lanes of ``LANE`` characters, which are first parsed
as if a phrase began at each; then every lane is parsed again from the state that the lane before it ended in, up to where
both parses meet, until no lane's end changes. So phrases go on over the lanes' edges, and counts are those of one parse.

Letters are lower-cased; runs of all else are one space. Edge cases: `und` with score 0 for text that is null or has no
letter, and where nothing is learned. Rows of null lang or null text teach nothing. Ties go to the language first in
order. Repeated rows are judged alone; an empty table gives an empty result. Very long texts are parsed whole, each alone.
Result columns replace those of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

#: Bounds of the sample: characters of a language, rows read for it (about twice as many), characters of a row's piece, and
#: languages up to which each has a full sample; more languages share the same room.
SAMPLE_CHARS, SAMPLE_ROWS, ROW_CHARS, FULL_LANGUAGES = 60_000, 120, 1_000, 256
#: Characters of a lane, and of the texts that are parsed at a time (a longer text alone).
LANE, PART = 512, 1 << 21
UNDETERMINED = "und"


class SuffixAutomaton:
    """The smallest automaton of all substrings of a text, over symbols below ``size``; built online, state 0 is the start."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            cur = self.state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = self.state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            else:
                self.link[cur] = 0
            last = cur

    def state(self, length: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def steps(self, size: int) -> tuple[np.ndarray, ...]:
        """The transitions as two arrays: for each state a symbol, what it leads to, and the place in the dense table for all others; and that table.

        An entry is 2 * next state + 1 if a new phrase begins with the symbol. A symbol that can't go on ends the phrase, and is
        taken from the start; one unknown even there is a phrase alone. Most states go on with one symbol only, so that rows
        are few: the start's, and those of states that branch.
        """
        start = np.ones(size, np.int32)
        for c, q in self.next[0].items():
            start[c] = 2 * q + 1
        only, to, row = np.full(len(self.next), -1, np.int32), np.zeros(len(self.next), np.int32), np.zeros(len(self.next), np.int32)
        branching = [s for s, n in enumerate(self.next) if s and len(n) > 1]
        dense = np.tile(start, (len(branching) + 1, 1))
        for k, s in enumerate(branching, 1):
            row[s] = k
            for c, q in self.next[s].items():
                dense[k, c] = 2 * q
        for s, n in enumerate(self.next):
            if s and len(n) == 1:
                only[s], to[s] = next((c, 2 * q) for c, q in n.items())
        return np.stack([only, to, row * np.int32(size)], 1), dense.ravel()


class Alphabet:
    """Symbols of characters: 0 for a space or anything that is no letter, 1 for a letter that the samples lack, 2 and up for theirs."""

    def __init__(self, letters: set[str]):
        self.size = len(letters) + 2
        self.plane = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), np.uint16, 1 << 16)
        self.far: dict[int, int] = {}
        for k, c in enumerate(sorted(letters), 2):
            if ord(c) < 1 << 16:
                self.plane[ord(c)] = k
            else:
                self.far[ord(c)] = k

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols, one after the other, and their numbers: no two spaces in a row, none at an end."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.plane[flat & 0xFFFF]
        for i in np.flatnonzero(flat >> 16).tolist():
            c = int(flat[i])
            out[i] = self.far.get(c, int(chr(c).isalpha()))
        first = np.zeros(len(out), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        keep = out > 0
        if len(out):
            keep[1:] |= (out[1:] == 0) & (out[:-1] > 0) & ~first[1:]  # the first space of a run inside a text
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
        out = out[keep]
        if len(out):
            end = np.r_[doc[1:] != doc[:-1], True] & (out == 0)
            out, doc = out[~end], doc[~end]
        return out.astype(np.int32), np.bincount(doc, minlength=len(texts))


class Parser:
    """One language's automaton over its own alphabet."""

    def __init__(self, sample: str):
        sample = sample.lower()
        self.alphabet = Alphabet({c for c in sample if c.isalpha()})
        self.states, self.dense = SuffixAutomaton(self.alphabet.symbols([sample])[0].tolist()).steps(self.alphabet.size)

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = self.states.take(state, axis=0)
        return np.where(own[:, 0] == c, own[:, 1], self.dense.take(own[:, 2] + c))

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The phrases of each of the texts, whose symbols follow one another."""
        n_lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), n_lanes)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        starts = (np.cumsum(sizes) - sizes)[owner] + k * LANE
        lengths = np.minimum(LANE, sizes[owner] - k * LANE)
        seen = np.zeros(len(symbols), np.int32)  # what each symbol leads to
        counts, ends = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int32)
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros(len(owner), np.int32)
        for step, n in enumerate(np.searchsorted(-lengths[order], -np.arange(int(lengths.max()) if len(lengths) else 0), "left").tolist()):
            at = starts[order[:n]] + step
            to = self.after(state[:n], symbols[at])
            seen[at] = to
            state[:n] = to >> 1
        ends[order] = state
        if len(owner):
            counts = np.add.reduceat(seen & 1, starts, dtype=np.int64)
        # lanes whose lane before ended in a state other than the one they were last parsed from
        began = np.zeros(len(owner), np.int32)
        later = np.flatnonzero(k > 0)
        while len(todo := later[began[later] != ends[later - 1]]):
            began[todo] = ends[todo - 1]
            lane, state, step = todo, began[todo], 0
            while len(lane):
                at = starts[lane] + step
                to = self.after(state, symbols[at])
                counts[lane] += (to & 1) - (seen[at] & 1)
                going = to >> 1 != seen[at] >> 1  # else both parses are the same from here on
                seen[at] = to
                step += 1
                done = going & (lengths[lane] == step)
                ends[lane[done]] = to[done] >> 1
                going &= ~done
                lane, state = lane[going], to[going] >> 1
        return np.bincount(owner, counts, len(sizes)).astype(np.int64)


#: The parsers of the samples used last, which a Python worker keeps from task to task.
_built: dict[int, list[Parser]] = {}


class Model:
    """The labelled samples; automata are built where they are used, once in each worker."""

    def __init__(self, samples: dict[str, str]):
        self.samples = samples
        self.languages = sorted(samples)

    def parsers(self) -> list[Parser]:
        key = hash(tuple((k, self.samples[k]) for k in self.languages))
        if key not in _built:
            _built.clear()
            _built[key] = [Parser(self.samples[k]) for k in self.languages]
        return _built[key]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [language, text] and letters and spaces between them [text]; at most about ``PART`` characters at a time."""
        parts, size = [[]], 0
        for t in texts:
            t = (t or "").lower()
            if size + len(t) > PART and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append(t)
            size += len(t)
        counts, sizes = [], []
        for p in parts:
            read = [(x, *x.alphabet.symbols(p)) for x in self.parsers()]
            counts.append(np.array([x.phrases(symbols, own) for x, symbols, own in read]).reshape(len(read), len(p)))
            sizes.append(read[0][2] if read else np.zeros(len(p), np.int64))
        return np.concatenate(counts, 1), np.concatenate(sizes)


def train(docs: DataFrame, usable: Column | None = None, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of the rows that ``usable`` admits."""
    known = docs.where(f"{lang_col} IS NOT NULL AND {text_col} IS NOT NULL")
    known = known if usable is None else known.where(usable)
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a language
    if not sizes:
        return Model({})
    # with few rows expected, a language might by chance have none
    rows, chars = (max(30, x * FULL_LANGUAGES // max(FULL_LANGUAGES, len(sizes))) for x in (2 * SAMPLE_ROWS, SAMPLE_CHARS))
    # each language's rows of the smallest hashes, about ``rows`` different ones: one pass, whatever the number of languages
    below = {r["lang"]: -(1 << 63) + ((1 << 64) - 1) * min(rows, r["n"]) // max(1, r["n"]) for r in sizes}
    bound = docs.sparkSession.createDataFrame(list(below.items()), "lang string, bound long")
    # a piece from anywhere in the row, at a place that another hash of the text names
    size = min(ROW_CHARS, chars)
    piece = F.expr(f"substring(t, CAST(1 + pmod(xxhash64(h, t), greatest(1, length(t) - {size - 1})) AS INT), {size})")
    picked = known.join(F.broadcast(bound), "lang").where("h <= bound").withColumn("t", piece).groupBy("lang", "h").agg(F.min("t").alias("t"))
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        if sum(map(len, texts.setdefault(r["lang"], []))) < chars:
            texts[r["lang"]].append(r["t"])
    samples = {lang: "\n".join(x)[:chars] for lang, x in texts.items()}
    return Model(samples)


def identify(docs: DataFrame, model: Model, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred and score, how far the fewest phrases are below the next language's (0 to 1)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        def work(col: pa.Array) -> list[pa.Array]:
            texts = col.to_pylist()
            if not model.languages:
                return [pa.array([UNDETERMINED] * len(texts)), pa.array([0.0] * len(texts))]
            counts, sizes = model.phrases(texts)
            best = counts.argmin(0)  # of equals the first
            ordered = np.sort(counts, axis=0)
            second = ordered[1] if len(ordered) > 1 else 2 * ordered[0]
            score = np.sqrt(np.clip(1 - ordered[0] / np.maximum(second, 1), 0, 1))
            return [pa.array([model.languages[b] if n else UNDETERMINED for b, n in zip(best, sizes)], pa.string()), pa.array(np.where(sizes > 0, score, 0.0), pa.float64())]

        return work

    return annotate(docs, [text_col], make, fields, drop)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    out = identify(docs.select("doc_id", "text"), train(docs, fold != 2), drop=("text",))
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
