"""Search, ranking, evidence and whole answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.operators import graph, retrieval, semantic

ENTRIES = [
    (0, "Payment Service", "shop", "src/pay.py", "code", 9, 1, ["AB-1"]),
    (1, "Refund journey", "shop", "features/refund.feature", "feature", 5, 1, ["AB-2"]),
    (2, "payment service", "billing", "src/other.py", "code", 4, 2, []),
    (3, "Ledger()", "billing", "src/ledger.py", "code", 3, 2, ["AB-1", "AB-3"]),
    (4, "Refund a payment", "shop", "features/refund.feature", "scenario", 1, 1, []),
]
EDGES = [(0, 1), (0, 3), (1, 4), (2, 3)]


@pytest.fixture(scope="module")
def index(spark):
    e = retrieval.searchable(spark.createDataFrame(ENTRIES, "eid long, label string, repo string, source_file string, kind string, degree long, community long, tickets array<string>"))
    edges = spark.createDataFrame(EDGES + [(b, a) for a, b in EDGES], "node long, other long")
    tickets = spark.createDataFrame([("AB-1", "the payment service fails on refund of a ledger entry"), ("AB-2", "refund refund refund"), ("AB-3", "unrelated prose about nothing at all, quite long indeed")], "id string, hay string")
    return e, edges, tickets


def test_search(index):
    e, _, _ = index
    assert [(r["eid"], r["score"]) for r in retrieval.search(e, "payment service").collect()] == [(0, 6), (2, 6)]
    assert [r["eid"] for r in retrieval.search(e, "refund", repo="shop", kinds=["scenario"]).collect()] == [4]


def test_rank(index):
    e, _, _ = index
    w = retrieval.label_weights(e, ["payment", "ledger"])
    assert w["payment"] == pytest.approx(math.log(1 + 5 / 4)) and w["ledger"] == pytest.approx(math.log(1 + 5 / 2))
    got = {r["eid"]: r["score"] for r in retrieval.rank_nodes(e, ["ledger"]).collect()}
    assert got[3] == pytest.approx(1000 * w["ledger"] + 0.5 * w["ledger"])
    multi = {r["eid"]: r["score"] for r in retrieval.rank_nodes(e, ["payment", "service"]).collect()}
    assert multi[0] > 10_000 and multi[0] > multi[4]


def test_boost_counts_injected_twice(spark, index):
    e, _, _ = index
    ranked = retrieval.rank_nodes(e, ["refund"])
    hits = spark.createDataFrame([(1, 3), (2, 4)], "community long, hits int")
    plain = {r["eid"]: r["score"] for r in ranked.collect()}
    got = {r["eid"]: r["score"] for r in retrieval.boost(ranked, e, hits).collect()}
    assert got[1] == pytest.approx(plain[1] + 120) and got[2] == 320


def brute_bm25(rows, terms):
    n, mean = len(rows), sum(len(h) for _, h in rows) / len(rows)
    df = {t: sum(t in h for _, h in rows) for t in terms}
    w = {t: math.log(1 + n / (1 + df[t])) for t in terms}
    bar = 0.9 * max((w[t] for t in terms if df[t] and len(t) > 1), default=0)
    out = []
    for i, h in rows:
        c = {t: h.count(t) for t in terms}
        if any(c[t] and len(t) > 1 and w[t] >= bar for t in terms):
            norm = 1.2 * (0.25 + 0.75 * len(h) / mean)
            out.append((i, sum(w[t] * c[t] * 2.2 / (c[t] + norm) for t in terms if c[t]), sum(c.values())))
    return sorted(out, key=lambda x: (-x[1], -x[2], x[0]))[:3]


def test_evidence(index):
    _, _, tickets = index
    rows = [tuple(r) for r in tickets.collect()]
    for terms in (["refund", "payment"], ["a", "refund"], ["absent", "refund"], ["absent"]):
        got = [tuple(r) for r in retrieval.bm25(tickets, terms).collect()]
        want = brute_bm25(rows, terms)
        assert [(i, h) for i, _, h in got] == [(i, h) for i, _, h in want] and [w for _, w, _ in got] == pytest.approx([w for _, w, _ in want])


def test_ask(spark, index):
    e, edges, tickets = index
    topics = spark.createDataFrame([(0, "refunds", ["refund", "money"]), (1, "other", ["refund"])], "pos int, slug string, keywords array<string>")
    near = spark.createDataFrame([("refund", "repayment", 0.8, 1)], "token string, other string, score double, rank int")
    dives = spark.createDataFrame([("shop",), ("shop-long",)], "repo string")
    ask = lambda q, **k: retrieval.ask(q, e, edges, tickets, **k)
    a = ask("What about AB-1?")
    assert a.view == "ticket" and retrieval.mode_of(a) == ["ticket"]
    a = ask("kubernetes zookeeper")
    assert a.view == "abstain" and a.missing == ["kubernet", "zookeeper"] and retrieval.mode_of(a) == ["abstain"]
    a = ask("Why was the refund made in shop?", neighbours=near, topics=topics, dives=dives)
    assert (a.view, a.topic, a.dive, a.expansions[0][0]) == ("why", "refunds", "shop", "repayment") and retrieval.mode_of(a) == ["brief", "dive", "tickets", "graph"]
    assert {r["ticket"] for r in a.frames["tickets"].collect()} <= {"AB-1", "AB-2", "AB-3"}
    assert ask("Which repos have the payment service").frames["repos"].where("label_lower = 'payment service'").first()["repos"] == ["billing", "shop"]
    assert {r["repo"] for r in ask("who uses the payment service").frames["used_by"].collect()} == {"shop", "billing"}
    assert {r["label"] for r in ask("refund journey").frames["scenarios"].collect()} == {"Refund a payment"}
    assert ask("impact of the ledger").frames["reached"].count() == 4
    assert ask("?!").view == "none"


def test_seeds_cover_terms(spark):
    rows = [(i, f"alpha item {i}", float(100 - i)) for i in range(12)] + [(50, "beta thing", 1.0), (51, "beta other", 0.5)]
    ranked = spark.createDataFrame(rows, "eid long, label_lower string, score double")
    assert retrieval.pick_seeds(ranked, ["alpha", "beta"]) == [*range(10), 50]


def test_knn_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    names = [f"{'abcd' if i % 5 == 0 else 'w' + chr(97 + i % 26) * 3}{i}" for i in range(60)]
    df = spark.createDataFrame([(n, [float(x) for x in r]) for n, r in zip(names, v)], "token string, v array<float>")
    got = {}
    for r in semantic.knn(df, "token", "v", least=0.3).orderBy("token", "rank").collect():
        got.setdefault(r["token"], []).append(r["other"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    for i, n in enumerate(names):
        order = [j for j in sorted(range(60), key=lambda j: (-s[i, j], names[j])) if j != i][:23]
        want = [names[j] for j in order if s[i, j] >= 0.3 and names[j][:4] != n[:4]][:6]
        assert got.get(n, []) == want


def test_vocabulary(spark):
    df = spark.createDataFrame([("Token token words",), ("token words",), ("token about",), (None,)], "text string")
    vocab = semantic.vocabulary(df, min_df=2)
    assert [tuple(r) for r in vocab.collect()] == [("token", 3), ("words", 2)] and len(semantic.vocabulary_hash(vocab)) == 64


def test_match_and_route(spark):
    q = spark.createDataFrame([(1, "Walk me through it"), (2, "which app does it"), (3, "who calls this"), (4, "what breaks"), (5, "why so"), (6, "tell me")], "i int, t string")
    assert [r[0] for r in q.orderBy("i").select(retrieval.route(F.col("t"))).collect()] == ["journey", "which_repos", "where_used", "impact", "why", "cluster"]
    assert graph.precision_bands(spark.createDataFrame([(0.9,), (0.5,), (0.1,)], "precision double")).count() == 3


def test_knn_of_many_copies_and_numbers(spark, monkeypatch):
    """No number of vectors is too large by itself; equal vectors are ties, which go by key as numbers do, in several passes too."""
    monkeypatch.setattr(semantic, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 6)), 40, 0), rng.normal(size=(30, 6))]).astype(np.float32)
    keys = [int(x) for x in rng.permutation(len(v))]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(keys, v)] + [(500, None), (501, [0.0] * 6)], "id long, v array<float>")
    monkeypatch.setattr(semantic, "MAX_VOCABULARY", 10)
    got = {}
    for r in semantic.knn(df, "id", "v", least=0.3, skip_stems=False).orderBy("token", "rank").collect():
        got.setdefault(int(r["token"]), []).append(int(r["other"]))
    u = semantic.unit(v)
    s = np.cumsum(u[:, None, :] * u[None, :, :], axis=2)[:, :, -1]
    for i, x in enumerate(keys):
        order = sorted((j for j in range(len(v)) if j != i and s[i, j] >= 0.3), key=lambda j: (-s[i, j], keys[j]))
        assert got.get(x, []) == [keys[j] for j in order[:6]]
    assert 500 not in got and 501 not in got


def test_knn_of_more_vectors_than_a_vocabulary(spark):
    """More than 15,000 vectors were an error."""
    df = spark.range(semantic.MAX_VOCABULARY + 1).selectExpr("id", "array(cast(id % 100 + 1 as float), 1f) AS v")
    out = semantic.knn(df, "id", "v", skip_stems=False)
    assert out.count() == 6 * (semantic.MAX_VOCABULARY + 1)
