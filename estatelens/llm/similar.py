"""Near-dedup by resemblance: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

1. One Arrow pass gives each text a digest of its shingle set (XXH64, as in ``simhash``), the set's SimHash fingerprint, and
   its minima under ``BANDS * ROWS`` permutations, hashed to a value a band. Texts of equal digests are one point afterwards.
2. The vantage-point trees of ``simhash`` find the fingerprints within ``MAX_BITS`` of one another. Their links are checked by
   the exact similarity of the sets; those that hold make the first components.
3. What is similar lies further apart in most pairs: at 0.8 about 9 of 64 bits, and up to 18, where a tree prunes nothing. So
   points that share a band are candidates as well, but for bands whose points are all in one component by now. At similarity
   s a pair shares no band with probability (1 - s ** ROWS) ** BANDS, 0.000007 at 0.8 and less above. Each band's vantage is its
   point that shares bands with the most others. All points of a band are compared with the vantage, by their sets, and keep
   what they differ in from it. That joins most of a group.
4. Other pairs of a band come from these differences alone. With sets a, b that differ from the vantage h in A and B, the
   similarity depends on sizes and on how much A and B have in common. If not both are similar to h, they must have about
   half of the smaller in common, and so, with A and B in one order, one of the first elements (new ones come first, as they
   are rare). So of a group of copies that are each edited on their own few pairs are looked at, not all. Of a pair in one
   component the similarity doesn't matter. Candidates are checked by the exact similarity of their sets.
5. Connected components give each document the smallest id that its links reach.

Edge cases: texts that are null or have no word have the same, empty set. Fewer than five words are one shingle. Texts are
processed whole, however long. Ids, repeated rows, empty tables and other columns are as in ``simhash.near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import simhash
from .common import annotate, byte_texts, components, cut, only, without
from .simhash import MAX_BITS, SEED, majority

SHINGLE = 5
#: The least similarity, as a fraction; two sets that differ in d of s elements in all have it if MORE * d <= LESS * s.
LEAST = (4, 5)
LESS, MORE = LEAST[1] - LEAST[0], LEAST[1] + LEAST[0]
#: Longs of a set's parity sketch: two sets differ in at least as many elements as their sketches in bits.
SKETCH = 4
BANDS, ROWS = 30, 5
#: Shingles permuted at a time.
PART = 1 << 12
_rng = np.random.default_rng(SEED)
_XOR, _TIMES, _MIX = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(3))
_TIMES, _MIX = _TIMES | np.uint64(1), _MIX | np.uint64(1)


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, ascending."""
    words = text.lower().split() if text else []
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(x + 1 for x in ends[:-k])]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64))


def digest(own: np.ndarray) -> int:
    return xxh64_intdigest(own.tobytes(), SEED)


def bands(own: np.ndarray) -> np.ndarray:
    """A value for each band; equal where all the band's minima are."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), PART):
        np.minimum(low, ((own[None, i : i + PART] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=low)
    low ^= low >> np.uint64(31)
    low *= _MIX
    low ^= low >> np.uint64(29)
    return low.reshape(BANDS, ROWS).sum(1, dtype=np.uint64) ^ _XOR[:BANDS]


def signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with digest, fingerprint and bands instead of the text."""

    def make():
        def work(col: pa.Array) -> list[pa.Array]:
            sets = [shingles(t) for t in byte_texts(col)]
            flat = np.concatenate([bands(s) for s in sets]).view(np.int64)
            digests, fps = (pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64)) for f in (digest, majority))
            return [digests, fps, pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, np.int32), pa.array(flat))]

        return work

    return annotate(docs, [text_col], make, [T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))], drop=(text_col,))


def shingle_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with digest and shingles instead of the text."""

    def make():
        def work(col: pa.Array) -> list[pa.Array]:
            sets = [shingles(t) for t in byte_texts(col)]
            return [pa.array(np.array([digest(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

        return work

    return annotate(docs, [text_col], make, [T.StructField("digest", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))], drop=(text_col,))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) those whose sets are similar enough."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * LEAST[1] >= (len(x) + len(y) - common) * LEAST[0])
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def sketch(own: np.ndarray) -> np.ndarray:
    """For each of some classes of hashes, one bit: whether the set has an odd number of them."""
    odd = np.bincount((own.view(np.uint64) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def compared(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """For each (hub, point): whether they are linked, the sizes of both sets, n elements in which they differ, and of these the first, in order.

    ``short`` of these are enough to meet any point that isn't linked to the hub; a point that isn't itself has enough to meet any.
    """
    both = stars.join(sets.toDF("hub", "x"), "hub").join(sets.toDF("point", "y"), "point").select("hub", "point", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            linked, sizes, ns, short, first, bits = [], [], [], [], [], []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                new, lost = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                n = len(new) + len(lost)
                linked.append(MORE * n <= LESS * (len(x) + len(y)))
                # in common with another point's n must be over: (n - (own - hub) * LESS / MORE) / 2 if that isn't linked, else (n - (own + hub) * LESS / MORE) / 2
                reach = [max(0, min(n, -(-(MORE * n + LESS * (len(y) + by)) // (2 * MORE)))) for by in (-len(x), len(x))]
                sizes.append(len(y))
                bits.append(sketch(y))
                ns.append(n)
                short.append(reach[0])
                first.append(np.r_[new, lost][: reach[0] if linked[-1] else max(reach)])
            arrays = [t.column(0), t.column(1), pa.array(linked, pa.bool_()), *(pa.array(v, pa.int32()) for v in (sizes, ns, short)), *(pa.array(v, pa.list_(pa.int64())) for v in (first, bits))]
            yield pa.RecordBatch.from_arrays(arrays, names=["hub", "point", "linked", "size", "n", "short", "first", "bits"])

    return both.mapInArrow(check, "hub long, point long, linked boolean, size int, n int, short int, first array<long>, bits array<long>")


def met(seen: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of different components that differ from a hub in so many same elements that they may be linked."""
    rooted = seen.join(roots, seen["point"] == roots["node"], "left").withColumn("root", F.coalesce("root", "point"))
    words = [f"bits{i}" for i in range(SKETCH)]
    own = rooted.select("hub", "point", "linked", "size", "n", "short", "root", "first", *(F.col("bits")[i].alias(w) for i, w in enumerate(words)))
    tokens = own.select(*(c for c in own.columns if c != "first"), F.posexplode("first").alias("pos", "token"))
    left = tokens.where("pos < short").select("hub", "token", *(F.col(c).alias(f"l_{c}") for c in ("point", "linked", "size", "n", "root", "pos", *words)))
    right = tokens.where("NOT linked").select("hub", "token", "point", "size", "n", "root", "pos", "short", *words)
    pair = "l_root <> root AND (l_linked OR (pos < short AND l_point < point))"
    enough = f"{2 * MORE} * least(l_n - l_pos, n - pos) >= {MORE} * (l_n + n) - {LESS} * (l_size + size)"
    apart = f"{MORE} * ({' + '.join(f'bit_count(l_{w} ^ {w})' for w in words)}) <= {LESS} * (l_size + size)"
    pairs = left.join(right, ["hub", "token"]).where(f"{pair} AND {enough} AND {apart}")
    return pairs.select(F.least("l_point", "point").alias("a"), F.greatest("l_point", "point").alias("b")).distinct()


def sets_of(points: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, shingles) of the digests in ``points``."""
    within = points.select("digest").distinct().join(reps.select("digest", "own"), "digest").select("own").distinct()
    texts = docs.join(within, "own", "left_semi").select("text")
    return cut(shingle_sets(texts, "text").groupBy("digest").agg(F.first("shingles").alias("shingles")))


def by_fingerprint(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Components (node, root) of the digests whose fingerprints are linked by the vantage-point trees, and whose sets are similar."""
    firsts = cut(reps.groupBy("fp").agg(F.min("digest").alias("first")))
    same = reps.join(firsts, "fp").where("digest <> first").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    forest = cut(simhash.links(firsts.select("fp"), MAX_BITS).distinct())
    ends = [firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    apart = forest.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    pairs = cut(same.union(apart).distinct())
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("digest")), reps, docs)
    return cut(components(cut(similar(pairs, sets))))


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Components (node, root) of the digests in ``reps`` (digest, own, fp, bands) that have links; ``docs`` has the texts by own."""
    first = by_fingerprint(reps, docs)
    rooted = reps.select("digest", "bands").join(first.withColumnRenamed("node", "digest"), "digest", "left")
    dealt = cut(rooted.select("digest", F.coalesce("root", "digest").alias("root"), F.explode("bands").alias("band")))
    counts = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "n")
    shared = cut(dealt.select("digest", "band").join(counts, "band"))
    known = shared.groupBy("digest").agg(F.sum("n").alias("known"))
    hubs = shared.join(known, "digest").groupBy("band").agg(F.max(F.struct("known", "digest")).alias("best")).select("band", F.col("best.digest").alias("hub"))
    stars = shared.join(hubs, "band").where("digest <> hub").select("hub", F.col("digest").alias("point")).distinct()
    sets = sets_of(known, reps, docs)
    seen = cut(compared(stars, sets))
    joined = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    near = joined.union(seen.where("linked").select(F.col("hub").alias("a"), F.col("point").alias("b")))
    more = cut(similar(met(seen, cut(components(near))), sets))
    return components(near.union(more))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id isn't the smallest of their group; rows are known by id and text."""

    def surplus() -> DataFrame:
        known = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
        marked = cut(signatures(known, "text"))
        reps = cut(marked.groupBy("digest").agg(F.min("id").alias("rep"), F.min("own").alias("own"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
        comp = cut(links(reps, known.select("own", "text")))
        rooted = reps.select("digest", "rep").join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        low = rooted.groupBy("root").agg(F.min("rep").alias("low"))
        named = cut(rooted.join(low, "root").select("digest", "low"))
        return marked.select("id", "own", "digest").join(named, "digest").where("id <> low").select("id", "own").distinct()

    own = docs.withColumns({"__near_id": F.col(id_col).cast("long"), "__near_own": F.xxhash64(text_col)})
    return without(own, only(surplus), ("__near_id", "__near_own")).drop("__near_id", "__near_own")
