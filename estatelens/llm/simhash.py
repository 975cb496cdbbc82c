"""SimHash near-dedup with vantage-point trees.

1. One Arrow pass gives each text its fingerprint: XXH64 (seed 42) of each 3-word shingle, a bit set where over half agree.
2. Fingerprints are made distinct with map-side combine, so copies, however many, are one point afterwards.
3. A vantage-point tree, fitted on a bounded sample of the fingerprints, cuts Hamming space into shards. Every fingerprint
   is a member of one shard. At a node with vantage v and radius m, a link between a member inside (d <= m) and one outside
   spans at most ``max_bits``, so it suffices that those outside with d <= m + max_bits also visit the inside as guests; guests
   go to each side that the triangle bound does not exclude. So shards see exactly the pairs that can link.
4. In its shard the same tree goes on to leaves, where distances are counted. A shard returns a spanning forest of its links
   (at most one edge a fingerprint), never all pairs of a group.
5. Connected components of the forests give each document the smallest doc_id that its links reach.

The sample only places the cuts: every fingerprint is indexed, and the search is exact. The fit's bound is ``SAMPLE``.

Edge cases: a text that is null or has no word has fingerprint zero, linked like any other. Fewer than three words are one
shingle. Texts are processed whole, however long. A null doc_id never is a component's id; a component of only such rows has
a null one. Repeated rows get a row each. An empty table gives an empty result. Other columns are ignored, or pass through
``near_dedup`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import annotate, byte_texts, components, cut, only, table, without

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints a shard should have (8 MB, some tens with guests), the fewest and the most shards, and sampled fingerprints
#: for each shard. Guests grow with the tree's depth: rows dealt for each fingerprint are about 4 at depth 6 (up to 67 million
#: fingerprints), 7 at depth 8 and 13 at depth 10, so shards are as large as memory allows, and the search goes on in them.
SHARD, LEAST_SHARDS, MOST_SHARDS, SAMPLE_PER_SHARD = 1 << 20, 64, 1 << 16, 32
#: The sample's bound, in fingerprints of 8 bytes.
SAMPLE = MOST_SHARDS * SAMPLE_PER_SHARD
#: Distances counted in a leaf, and at a time.
LEAF, BLOCK = 1 << 19, 1 << 22


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if it is in over half of them."""
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        set_ += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint, unsigned. bytes.lower and bytes.split know ASCII only, and so exactly A-Z and [\\x20\\x09-\\x0D]."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(x + 1 for x in ends[:-k])]
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])], "<u8")
    return majority(h)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the fingerprint in ``out_col``, as the signed long of the same bits."""

    def make():
        return lambda col: [pa.array(np.array([fingerprint(t) for t in byte_texts(col)], np.uint64).view(np.int64))]

    return annotate(docs, [text_col], make, [T.StructField(out_col, T.LongType())], drop)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose_split(points: np.ndarray, slack: int) -> tuple[np.uint64, int, float]:
    """Of some points as vantages, the one whose median radius leaves the fewest others near the boundary; and that share."""
    best = (points[0], 0, 2.0)
    view = points[:: max(1, len(points) // 1024)]
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = distance(view, v)
        m = int(np.median(d))
        for radius in (m - 1, m):
            inside = float(np.mean(d <= radius))
            cost = max(inside, 1 - inside) + float(np.mean((d > radius) & (d <= radius + slack)))
            if 0 < inside < 1 and cost < best[2]:
                best = (v, radius, cost)
    return best


def fit_tree(sample: np.ndarray, depth: int, slack: int) -> list[tuple[int, int]]:
    """A tree as a heap of (vantage, radius); a node that can't be cut has radius 64, so all goes inside."""
    nodes: list[tuple[int, int]] = [(0, 64)] * ((1 << depth) - 1)

    def grow(at: int, points: np.ndarray, level: int) -> None:
        if level == depth or len(points) < 2:
            return
        v, radius, cost = choose_split(points, slack)
        if cost > 1.5:
            radius = 64
        nodes[at] = (int(v), radius)
        inside = distance(points, v) <= radius
        grow(2 * at + 1, points[inside], level + 1)
        grow(2 * at + 2, points[~inside], level + 1)

    grow(0, sample, 0)
    return nodes


def route(nodes: list[tuple[int, int]], depth: int, fps: np.ndarray, slack: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its members, its guests) of the fingerprints."""

    def down(at: int, level: int, members: np.ndarray, guests: np.ndarray):
        if not len(members) and not len(guests):
            return
        if level == depth:
            yield at - ((1 << depth) - 1), members, guests
            return
        v, radius = nodes[at]
        dm, dg = distance(members, np.uint64(v)), distance(guests, np.uint64(v))
        yield from down(2 * at + 1, level + 1, members[dm <= radius], np.r_[guests[dg <= radius + slack], members[(dm > radius) & (dm <= radius + slack)]])
        yield from down(2 * at + 2, level + 1, members[dm > radius], guests[dg > radius - slack])

    none = np.zeros(0, np.uint64)
    yield from down(0, 0, fps, none)


class Forest:
    """Union-find over positions, many links at a time; a root is its tree's smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent] != self.parent).any():
                self.parent[up] = self.parent[self.parent[up]]


def shard_links(members: np.ndarray, guests: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, root) pairs, of all links among the members and between members and guests."""
    points = np.unique(np.r_[members, guests])
    forest = Forest(len(points))

    def leaf(m: np.ndarray, q: np.ndarray) -> None:
        rows = max(1, BLOCK // max(1, len(q)))
        at_m, at_q = np.searchsorted(points, m), np.searchsorted(points, q)
        for i in range(0, len(m), rows):
            x, y = np.nonzero(np.bitwise_count(m[i : i + rows, None] ^ q[None, :]) <= max_bits)
            forest.link(at_m[i + x], at_q[y])

    def search(m: np.ndarray, g: np.ndarray) -> None:
        if not len(m):
            return
        if len(m) * (len(m) + len(g)) > LEAF and len(m) > 1:
            v, radius, cost = choose_split(m, max_bits)
            if cost < 1.5:
                dm, dg = distance(m, v), distance(g, v)
                search(m[dm <= radius], np.r_[g[dg <= radius + max_bits], m[(dm > radius) & (dm <= radius + max_bits)]])
                search(m[dm > radius], g[dg > radius - max_bits])
                return
        leaf(m, np.r_[m, g])

    search(np.unique(members), np.unique(guests))
    loose = forest.parent != np.arange(len(points))
    return points[loose], points[forest.parent[loose]]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b), a spanning forest of every shard's links, of the distinct fingerprints in column fp."""
    spark = fps.sparkSession
    n = fps.count()
    wanted = min(MOST_SHARDS, max(LEAST_SHARDS, n // SHARD))
    depth = (wanted - 1).bit_length()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit((1 << depth) * SAMPLE_PER_SHARD).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = spark.sparkContext.broadcast(fit_tree(sample, depth, max_bits) if len(sample) else [(0, 64)] * ((1 << depth) - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for shard, members, guests in route(nodes.value, depth, own, max_bits):
                both = np.r_[members, guests].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), shard, np.int32)), pa.array(both), pa.array(np.arange(len(both)) < len(members))], names=["shard", "fp", "member"])

    def solve(t: pa.Table) -> pa.Table:
        points, member = t.column("fp").to_numpy().view(np.uint64), t.column("member").to_numpy(zero_copy_only=False)
        a, b = shard_links(points[member], points[~member], max_bits)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return fps.select("fp").mapInArrow(deal, "shard int, fp long, member boolean").groupBy("shard").applyInArrow(solve, "a long, b long")


def classes(marked: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", fp_col: str = "fp", out_col: str = "component_id") -> DataFrame:
    """``marked`` (rows with an id and a fingerprint, best cut) with the smallest id that each row's links reach."""
    reps = cut(marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("rep")))
    comp = cut(components(links(reps, max_bits)))
    rooted = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("rep").alias(out_col))
    # fingerprints that stand for themselves need no join to learn their component
    named = cut(rooted.join(low, "root").select(F.col("fp").alias("__near_fp"), out_col))
    return marked.drop(*[c for c in marked.columns if c.lower() == out_col.lower()]).join(named, marked[fp_col] == F.col("__near_fp")).drop("__near_fp")


def near_dedup(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id isn't the smallest of their group.

    Rows are known by id and text, so an id that stands for one group and is surplus in another keeps its row in the first;
    rows that repeat a kept one all stay, and so do rows of null id. Which rows go is decided on fingerprints.
    """

    def surplus() -> DataFrame:
        known = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
        marked = cut(fingerprints(known, "text", "fp", drop=("text",)))
        return classes(marked, max_bits, "id").where("id <> component_id").select("id", "own").distinct()

    own = docs.withColumns({"__near_id": F.col(id_col).cast("long"), "__near_own": F.xxhash64(text_col)})
    return without(own, only(surplus), ("__near_id", "__near_own")).drop("__near_id", "__near_own")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = cut(fingerprints(docs, drop=("text",)))
    return classes(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
