"""Benchmark decontamination with an FM-index for each shard of the training text.

An item's windows are its runs of ``window`` consecutive words (all of it, if it is shorter). A document word inside an
occurrence of a window is hit.

1. The windows (a stated query set) go to the executors in blocks of a checked size; the documents pass once a block.
2. A shard is the text of one Arrow batch. Words become symbols of the windows' alphabet; a word that no window has can
   be in no occurrence, so it only separates runs, and runs shorter than the shortest window hold none. The runs, with
   separators, are the text that the shard's FM-index is built on: suffix array by prefix doubling, Burrows-Wheeler
   transform, a wavelet matrix for ranks, and suffix positions sampled every ``SAMPLE`` words and at each run's start.
3. All windows of the block are searched backwards at once, and their rows walk by LF steps to a sampled position.
4. Occurrences become word spans and, merged, character spans to remove.

Edge cases: null text has no words; an item that is null or has no word has no window; an item_id that is null takes part
in hits but is not listed among the items. Texts are searched whole, however long. Repeated rows, of documents or items, are each judged alone (an item_id is
listed once a document). Empty tables work: no items, nothing hit. Columns that clash with the results are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, blocks, byte_texts, table

WINDOW = 10
#: Every so many words of the text keep their suffix position.
SAMPLE = 16
#: Words: runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased. Other bytes become spaces; no length changes.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of some items as symbols 1.. of their own alphabet (0: any other word)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = fold_words((text or "").encode("utf-8", "replace"))
            ids = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.owners = [sorted(x for x in s if x is not None) for s in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.words = np.zeros((len(owners), window), np.int64)
        for k, w in enumerate(owners):
            self.words[k, : len(w)] = w


class WaveletMatrix:
    """Ranks and accesses of a sequence of symbols, many at a time."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(seq), bits, []
        for b in range(bits - 1, -1, -1):
            one = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            zeros = len(seq) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol c is among the first i."""
        lo = np.zeros(len(c), np.int64)
        for b, ones, zeros in self.levels:
            up = ((c >> b) & 1).astype(bool)
            a, z = ones[lo], ones[i]
            lo, i = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, i - z)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each is before i."""
        c, lo = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for b, ones, zeros in self.levels:
            z = ones[i]
            up = ones[i + 1] > z
            a = ones[lo]
            lo, i = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, i - z)
            c |= up.astype(np.int64) << b
        return c, i - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling; each 0 is a symbol of its own (ordered by position), so comparisons end at it."""
    n = len(text)
    zero = text == 0
    k0 = int(zero.sum())
    rank = text + k0
    rank[zero] = np.arange(k0)
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 1) + after
        sa = np.argsort(pair, kind="stable")
        ordered = pair[sa]
        new = np.zeros(n, np.int64)
        new[sa] = np.cumsum(np.r_[0, (ordered[1:] != ordered[:-1]).astype(np.int64)])
        rank = new
        if n == 0 or rank.max() == n - 1:
            return sa
        step *= 2


class FMIndex:
    """Backward search and location over a text of symbols in which 0 separates runs; the text starts and ends with 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        self.text_len = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        top = int(text.max()) if len(text) else 0
        self.matrix = WaveletMatrix(bwt, max(1, top.bit_length()))
        counts = np.bincount(text, minlength=top + 2)
        self.before = np.r_[0, np.cumsum(counts)]
        self.top = top
        held = (sa % sample == 0) | (bwt == 0)  # a run's start, so that no walk crosses a separator
        self.held = np.r_[0, np.cumsum(held)].astype(np.int32)
        self.positions = sa[held]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of each phrase (its symbols at the left of its row of ``words``)."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.text_len, np.int64)
        for back in range(int(lengths.max()) if len(lengths) else 0):
            at = np.flatnonzero((back < lengths) & (lo < hi))
            c = words[at, lengths[at] - 1 - back]
            known = c <= self.top
            hi[at[~known]] = lo[at[~known]]
            at, c = at[known], c[known]
            first = self.before[c]
            lo[at], hi[at] = first + self.matrix.rank(c, lo[at]), first + self.matrix.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of the suffixes at ``rows``."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at = np.arange(len(rows))
        while len(at):
            r = rows[at]
            held = self.held[r + 1] > self.held[r]
            out[at[held]] = self.positions[self.held[r[held]]] + steps[at[held]]
            at, r = at[~held], r[~held]
            c, k = self.matrix.access(r)
            rows = rows.copy() if len(at) else rows
            rows[at] = self.before[c] + k
            steps[at] += 1
        return out


#: Occurrences that are located at a time, which bounds memory where one window is in very many places.
LOCATE = 1 << 20


def occurrences(texts: list[bytes | None], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a shard: arrays (document, first word, words, window) of all occurrences, and the documents' numbers of words."""
    n_words, parts, docs, offsets, at = [], [np.zeros(1, np.int64)], [], [], 0
    get = windows.symbol.get
    for k, t in enumerate(texts):
        words = fold_words(t) if t else []
        n_words.append(len(words))
        if len(words) < windows.shortest or not windows.shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= windows.shortest:
                parts += [ids[a:b], np.zeros(1, np.int64)]
                docs.append(k)
                offsets.append((at + 1, a))  # the run's first position in the shard's text, and in the document
                at += b - a + 1
    empty = np.zeros(0, np.int64)
    if not docs:
        return empty, empty, empty, empty, n_words
    index = FMIndex(np.concatenate(parts))
    lo, hi = index.search(windows.words, windows.lengths)
    starts = np.array([x for x, _ in offsets], np.int64)
    firsts, docs = np.array([x for _, x in offsets], np.int64), np.array(docs, np.int64)
    found = np.flatnonzero(hi > lo)
    out = []
    many = np.cumsum(hi[found] - lo[found])
    for group in np.split(found, np.flatnonzero(np.diff(many // LOCATE)) + 1) if len(found) else []:
        sizes = hi[group] - lo[group]
        which = np.repeat(group, sizes)
        rows = np.repeat(lo[group] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        pos = index.locate(rows)
        run = np.searchsorted(starts, pos, "right") - 1
        out.append((docs[run], firsts[run] + pos - starts[run], windows.lengths[which], which))
    if not out:
        return empty, empty, empty, empty, n_words
    return *(np.concatenate(x) for x in zip(*out)), n_words


def merged_spans(first: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint word spans [a, b), ascending, that cover the same words; spans that touch are one."""
    order = np.argsort(first, kind="stable")
    spans: list[list[int]] = []
    for a, n in zip(first[order].tolist(), length[order].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n)
        else:
            spans.append([a, a + n])
    return [tuple(x) for x in spans]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, inside.view(np.int8), 0]))
    return edge[::2], edge[1::2]


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """``text`` without its word spans, and those as code point spans."""
    starts, ends = word_bounds(text)
    before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]  # code points that begin before each byte
    at, kept, chars = 0, [], []
    for a, b in spans:
        x, y = int(starts[a]), int(ends[b - 1])
        kept.append(text[at:x])
        at = y
        chars.append((int(before[x]), int(before[y])))
    return b"".join([*kept, text[at:]]), chars


RESULTS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("clean_text", T.StringType()),
]
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", drop: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), spans (code points to remove) and clean_text, the text without them.

    Without ``clean``, spans and clean_text are null, which saves their cost. Null text stays null in clean_text.
    """
    sc = docs.sparkSession.sparkContext
    out, state = docs, "__hit_words"
    asked = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    n_blocks, parts = blocks(asked, "coalesce(octet_length(t), 0) + coalesce(octet_length(i), 0) + 40", weight=8)
    held = T.ArrayType(T.LongType())
    states = [T.StructField(f"{state}_a", held), T.StructField(f"{state}_b", held), T.StructField(f"{state}_items", T.ArrayType(T.StringType()))]
    names = [f.name for f in states]
    for n, block in enumerate(parts):
        sent, last = sc.broadcast([tuple(r) for r in block]), n == n_blocks - 1

        def make(sent=sent, last=last):
            windows = Windows(sent.value, window)

            def work(col: pa.Array, *before: pa.Array) -> list[pa.Array]:
                texts = byte_texts(col)
                doc, first, length, which, n_words = occurrences(texts, windows)
                order = np.argsort(doc, kind="stable")
                doc, first, length, which = doc[order], first[order], length[order], which[order]
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                past = [x.to_pylist() for x in before]
                hits, items, spans, cleaned, state_a, state_b = [], [], [], [], [], []
                for k, t in enumerate(texts):
                    a, b = bounds[k], bounds[k + 1]
                    f, w = first[a:b], length[a:b]
                    own = {x for j in np.unique(which[a:b]).tolist() for x in windows.owners[j]} if b > a else set()
                    if past:
                        f, w = np.r_[f, np.array(past[0][k], np.int64)], np.r_[w, np.array(past[1][k], np.int64)]
                        own |= set(past[2][k])
                    s = merged_spans(f, w) if len(f) else []
                    hits.append(sum(y - x for x, y in s))
                    items.append(sorted(own))
                    if not last:
                        state_a.append([x for x, _ in s])
                        state_b.append([y - x for x, y in s])
                    elif clean:
                        text, chars = cut_spans(t, s) if s else (t, [])
                        cleaned.append(text)
                        spans.append([{"start": x, "end": y} for x, y in chars])
                if not last:
                    return [pa.array(state_a, pa.list_(pa.int64())), pa.array(state_b, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                if not clean:
                    spans = cleaned = [None] * len(texts)
                return [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN)), pa.array(cleaned, pa.binary()).cast(pa.string())]

            return work

        out = annotate(out, [text_col, *(names if n else [])], make, RESULTS if last else states, drop=(*names, *drop) if last else ())
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), drop=("text",), clean=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP9 = r"""
WITH dw AS (
  SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), iw AS (
  SELECT DISTINCT item_id, u.win AS win, len(u.win) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) b,
       LATERAL (SELECT unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: w[i : i + 9])) AS win) u
  WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM iw), dwin AS (
  SELECT r, k, u.i AS i, w[u.i : u.i + k - 1] AS win
  FROM dw, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) u
  WHERE len(w) >= k
), occ AS (
  SELECT r, i, dwin.k AS k, item_id FROM dwin JOIN iw ON dwin.k = iw.k AND dwin.win = iw.win
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
