"""Near-dedup at similarity 0.8 against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
from estatelens.llm import similar

from .conftest import SCHEMA, prose
from .test_dedup import low


def shingle_set(t):
    words = re.findall("[^\x20\x09-\x0d]+", low(t or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or x and y and len(x & y) * 5 >= len(x | y) * 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return Counter(r for i, r in enumerate(rows) if r[0] is None or r[0] == least[root(i)])


def edited_rows():
    """Chains and stars of texts with 0 to 9 of 200 words replaced, on both sides of 0.8."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        words = prose(rng, 200).split(" ")
        for k in range(10):
            own = words[:]
            for at in rng.sample(range(200), k):
                own[at] = f"new{g}x{k}x{at}"
            rows.append((100 * g + k, " ".join(own), "en", "s0", 0))
            if g % 3 == 0:
                words = own
    return rows


def test_stage_takes_near_copies_of_similarity_08(spark):
    rows = edited_rows()
    want = kept_by_brute_force(rows)
    assert 12 < len(want) < 80
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert Counter(map(tuple, got.collect())) == want


def test_similar_dedup_edges(docs, corpus, empty):
    assert Counter(map(tuple, similar.similar_dedup(docs).collect())) == kept_by_brute_force(corpus)
    assert similar.similar_dedup(empty).count() == 0


def test_repeated_ids_lose_no_text(spark):
    """An id that is surplus in one group and stands for another keeps its row in the latter."""
    from estatelens.llm import simhash

    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(2, b, None, None, None), (5, b, None, None, None), (5, a, None, None, None), (9, a, None, None, None), (None, a, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for dedup in (similar.similar_dedup, simhash.near_dedup):
        assert Counter(r[:2] for r in map(tuple, dedup(df).collect())) == Counter([(2, b), (5, a), (None, a)])


def test_many_copies_with_own_edits(spark):
    """A large group around one text, most pairs of which lie below the threshold: none is lost, few are looked at."""
    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    rows = []
    for k in range(160):
        words = base[:]
        for at in rng.sample(range(120), k % 9):
            words[at] = f"own{k}x{at}"
        rows.append((1000 + k if k % 9 else 5000 + k, " ".join(words), "en", "s0", 0))
    assert Counter(map(tuple, similar.similar_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())) == kept_by_brute_force(rows)


def test_sketches_bound_differences():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 3, 50, 2000):
        x, y = (np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for _ in range(2))
        y = np.union1d(x[: n // 2], y)
        bits = int(np.bitwise_count((similar.sketch(x) ^ similar.sketch(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_fingerprints_and_their_trees_link_first(spark, monkeypatch):
    """The stage's links come from SimHash and its trees as far as those reach, and what they settle isn't looked at again."""
    from estatelens.llm import simhash

    rng = random.Random(6)
    rows = []
    for g in range(3):
        words = prose(rng, 600).split(" ")
        for k in range(4):
            rows.append((10 * g + k, " ".join([*words, f"end{k}"]), "en", "s0", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    made = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in similar.signatures(df.select("doc_id", "text"), "text").collect()}
    for r in rows:
        hashes = [simhash.xxh64_intdigest(s.encode(), 42) for s in shingle_set(r[1])]
        assert made[r[0]] == sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    trees, compared, looked = simhash.links, similar.compared, []
    calls = []
    monkeypatch.setattr(simhash, "links", lambda fps, bits: calls.append((fps.count(), bits)) or trees(fps, bits))
    monkeypatch.setattr(similar, "compared", lambda stars, sets: looked.append(stars.count()) or compared(stars, sets))
    got = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert Counter(map(tuple, got.collect())) == kept_by_brute_force(rows) == Counter(r for r in rows if r[0] % 10 == 0)
    near = all(min(bin(made[i] ^ made[j]).count("1") for j in range(i // 10 * 10, i)) <= 2 for i in made if i % 10)
    assert near and calls == [(len(set(made.values())), 2)] and looked == [0]
