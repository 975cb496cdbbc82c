"""Line dedup and SimHash against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from estatelens.llm import common, line_dedup, simhash


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_lines(rows):
    held, last = defaultdict(set), {}
    split = [(r[1] or "").split("\n") for r in rows]
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    key = lambda x: low(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for n, lines in enumerate(split):
        for x in lines:
            if len(key(x)) >= 20:
                held[key(x)].add(n)
                last[key(x)] = max(last.get(key(x), ids[n]), ids[n])
    out = []
    for n, lines in enumerate(split):
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and last[key(x)] != ids[n])]
        out.append((rows[n][0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(docs, corpus):
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert Counter(got) == Counter(brute_lines(corpus))
    assert sum(r[2] for r in got) > 20


def test_line_dedup_in_blocks_and_shards(docs, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "blocks", lambda rows, size: common.blocks(rows, size, limit=100))
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, out_col="text").select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert Counter(got) == Counter(brute_lines(corpus))


def test_line_dedup_with_routed_probes(docs, corpus, empty, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BLOCKS", 0)
    monkeypatch.setattr(line_dedup, "PROBES", 5)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, out_col="text").select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert Counter(got) == Counter(brute_lines(corpus))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_edges(spark, empty, docs):
    assert line_dedup.dedup_lines(empty).count() == 0
    clash = docs.withColumns({"N_Lines": F.lit("x"), "kept_text": F.lit(1), "other": F.lit(2)})
    out = line_dedup.dedup_lines(clash)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "other", "n_lines", "n_dropped", "kept_text"])
    assert out.count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_perfect_hash(n):
    h = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    d = line_dedup.build_mph(h)
    assert sorted(line_dedup.mph_slot(h, d, n).tolist()) == list(range(n))


def brute_fingerprint(t):
    words = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and counts[b] * 2 > len(shingles))


def brute_components(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_matches_brute_force(docs, corpus):
    fps = [brute_fingerprint(r[1]) for r in corpus]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(corpus, fps, brute_components([r[0] for r in corpus], fps)))
    marked = common.cut(simhash.fingerprints(docs.select("doc_id", "text"), drop=("text",)))
    got = simhash.classes(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_links_lose_none_with_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [int(c) for c in rng.integers(0, 1 << 63, 1500, dtype=np.uint64)]
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    comp = {r["node"]: r["root"] for r in common.components(edges).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for x, w in zip(signed, want):
        groups[w].add(comp.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_dedup_keeps_one_of_each_group(docs, corpus, empty):
    fps = [brute_fingerprint(r[1]) for r in corpus]
    comp = brute_components([r[0] for r in corpus], fps)
    want = Counter(r for r, c in zip(corpus, comp) if r[0] is None or r[0] == c)
    assert Counter(map(tuple, simhash.near_dedup(docs).collect())) == want
    assert simhash.near_dedup(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_rows_dealt_for_each_fingerprint_stay_few():
    """Members and guests at the depth that 10^8 fingerprints have."""
    rng = np.random.default_rng(1)
    depth = (10**8 // simhash.SHARD - 1).bit_length()
    nodes = simhash.fit_tree(rng.integers(0, 1 << 64, (1 << depth) * simhash.SAMPLE_PER_SHARD, np.uint64), depth, 2)
    fps = rng.integers(0, 1 << 64, 40_000, np.uint64)
    dealt = sum(len(m) + len(g) for _, m, g in simhash.route(nodes, depth, fps, 2))
    assert 1 <= dealt / len(fps) < 8


def test_keys_that_share_half_their_bits(spark):
    """Of two keys with the same first half both are found, each with its own count and largest id."""
    rows = [(5, 1, 3, 70), (5, 2, 4, 80), (5, 3, 2, 90), (-9, 1, 3, 60)]
    counts = spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, last_id long")
    index, n_shards = line_dedup.build_index(counts)
    held = line_dedup.LineIndex([tuple(r) for r in index.select(*line_dedup.PARTS).collect()], n_shards, 3)
    found, last = held.last_ids(np.array([5, 5, 5, -9, 5, 7]), np.array([1, 2, 3, 1, 9, 4]))
    assert found.tolist() == [True, True, False, True, False, False] and last[found].tolist() == [70, 80, 60]
