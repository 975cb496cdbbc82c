"""Commit evidence, graph, resolution, layers, dossiers and gates on small constructed estates."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from estatelens.operators import dossier, gates, graph, history, intent, layers, resolve
from estatelens.settings import DEFAULTS
from estatelens.sources.schemas import COMMIT


def commit(i, subject, body="", files=("a.py",), repo="r1", author=("Ann", "ann@x.org"), day="2024-01-02", merge=False):
    person = {"name": author[0], "email": author[1]}
    return {"repository": repo, "sha": f"{i:040d}", "short_sha": f"{i:08d}", "subject": subject, "body": body, "author": person, "committer": person, "author_date": day + "T10:00:00+01:00", "committer_date": day + "T10:00:00+01:00", "files": [{"path": f, "additions": 1, "deletions": None, "binary": False} for f in files], "parents": [], "refs": [], "is_merge": merge}


@pytest.fixture(scope="module")
def commits(spark):
    template = "Please fill in the template below"
    rows = [commit(i, f"AB-{i % 3} change number {i} of the module", template + f"\nSome real prose about change {i}, mail me@x.org", day=f"2024-01-{i + 1:02d}") for i in range(6)]
    rows += [
        commit(10, "AB-0 CD-1: wip", "This paragraph explains the work in words.\n\nMore of it EF-9.", files=("a.py", "b.py")),
        commit(11, "no ticket in subject", "but the body says it is for GH-7, and why it is so", files=("c.py",)),
        commit(12, "AB-0 merged", merge=True),
        commit(13, "AB-1 bump", "Body of a bot that is long enough to count", author=("dep[bot]", "")),
        commit(14, "nothing here"),
        commit(15, "AB-2 other repository", repo="r2", files=("a.py",)),
    ]
    return spark.createDataFrame([{**dict.fromkeys(COMMIT.names), **r} for r in rows], COMMIT).withColumn("pos", F.col("sha").cast("long"))


def test_boilerplate_and_bodies(commits):
    assert [tuple(r)[:3] for r in intent.learn_boilerplate(commits).select("repo", "line", "seen").collect()] == [("r1", "please fill in the template below", 6)]
    rows = {r["pos"]: r for r in intent.with_bodies(commits).collect()}
    assert rows[0]["evidence"] == "Some real prose about change 0, mail [email address withheld]"
    assert rows[10]["description"] == "This paragraph explains the work in words." and rows[10]["tickets"] == ["AB-0", "CD-1"]
    assert rows[11]["tickets"] == ["GH-7"] and rows[13]["automated"] and rows[13]["evidence"] == ""
    assert Counter({r["reason"]: r["n"] for r in intent.discard_report(intent.with_bodies(commits)).collect()}) == Counter({"automated": 1})


def test_index_and_records(commits):
    rows = intent.with_bodies(commits)
    index = intent.file_ticket_index(rows)
    got = {(r["repo"], r["path"], r["ticket"]): (r["n"], r["first"], r["last"]) for r in index.collect()}
    assert got[("r1", "a.py", "AB-0")] == (3, "2024-01-01", "2024-01-06") and got[("r1", "b.py", "CD-1")] == (1, "2024-01-02", "2024-01-02")
    files = {(r["repo"], r["path"]): r["tickets"] for r in intent.file_tickets(index).collect()}
    assert files[("r1", "a.py")] == ["AB-0", "AB-1", "AB-2", "CD-1"]
    rec = {r["ticket"]: r for r in intent.ticket_records(rows).collect()}
    assert rec["AB-0"]["n"] == 3 and rec["AB-0"]["repos"] == ["r1"] and len(rec["AB-0"]["d"]) == 2 and len(rec["AB-0"]["b"]) == 2
    assert rec["AB-2"]["repos"] == ["r1", "r2"] and rec["CD-1"]["s"] == ["wip"]
    assert rec["AB-1"]["b"] is not None and rec["GH-7"]["d"] == ["no ticket in subject"]
    assert {r["field"] for r in intent.mined_values(intent.ticket_records(rows)).collect()} == {"d", "s", "b"}
    assert gates.evidence_findings(intent.mined_values(intent.ticket_records(rows))).count() == 0


def test_same_for_any_partitioning(spark, commits):
    a = sorted(map(repr, intent.ticket_records(intent.with_bodies(commits.repartition(1))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = sorted(map(repr, intent.ticket_records(intent.with_bodies(commits.repartition(5))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_titles_and_tracker(spark):
    old = spark.createDataFrame([("A-1", "old"), ("A-2", "two")], "ticket string, title string")
    new = spark.createDataFrame([(0, "A-1", "x"), (1, "A-1", "y")], "pos long, ticket string, title string")
    assert {tuple(r) for r in intent.upsert_titles(old, new).collect()} == {("A-1", "y"), ("A-2", "two")}


def test_history_measures(spark):
    ix = spark.createDataFrame([("r", p, t) for t, ps in {"T1": "abc", "T2": "ab", "T3": "ab", "T4": "d"}.items() for p in ps], "repo string, path string, ticket string")
    assert {tuple(r) for r in history.cochange_pairs(ix, least=2).collect()} == {("a", "b", 3)}
    assert history.cochange_pairs(ix, least=1, most_files=2).where("a = 'a' AND b = 'c'").count() == 0
    files = spark.createDataFrame([(f"f{i}", i, 10 - i) for i in range(9)], "path string, degree long, tickets long")
    assert sorted(r["path"] for r in history.hotspots(files, 9).collect()) == ["f7", "f8"]
    assert [tuple(r) for r in history.test_pairs(spark.createDataFrame([("x/Foo.java",), ("y/FooTest.java",), ("Bar.java",)], "path string")).collect()] == [("x/Foo.java", "y/FooTest.java")]


NODES = [("a", "Main", "r1", "a.py", 1, "code", None, 0), ("b", "Helper", "r1", "b.py", 1, "code", None, 1), ("c", "Main", "r2", "c.py", 2, "code", None, 2), ("f", "Paying", "r2", "p.feature", 2, None, "gherkin_feature", 3), ("t", "AB-1", "", None, None, None, "ticket", 4), ("m", "ab", "r1", "m.js", 1, "code", None, 5)]
LINKS = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "f"), ("f", "t"), ("a", "a"), ("m", "a")]


@pytest.fixture(scope="module")
def estate(spark):
    n = spark.createDataFrame(NODES, "id string, label string, repo string, source_file string, community long, file_type string, kind string, pos long").withColumn("type", F.lit(None).cast("string"))
    return n, spark.createDataFrame(LINKS, "source string, target string")


def test_graph_basics(estate):
    nodes, links = estate
    assert {r["id"]: r["degree"] for r in graph.degree(links).collect()} == {"a": 5, "b": 3, "c": 2, "f": 2, "t": 1, "m": 1}
    kept = graph.entries(nodes, links, DEFAULTS.with_overrides({"min_entry_degree": 3}))
    assert {r["id"]: r["entry_kind"] for r in kept.collect()} == {"a": "code", "b": "code", "f": "feature", "t": "ticket"}
    ranked = graph.with_rank(kept, F.desc("degree"), F.col("pos"))
    assert {r["id"]: r["eid"] for r in ranked.collect()} == {"a": 0, "b": 1, "f": 2, "t": 3}
    assert {tuple(r) for r in graph.kept_edges(links, ranked).collect()} == {(0, 1), (2, 3)}
    near = graph.top_neighbours(nodes, links, 2).where("node = 'b'").orderBy("rank").collect()
    assert [(r["other"], r["rank"]) for r in near] == [("a", 1)]


def test_traversal(spark, estate):
    nodes, links = estate
    seeds = spark.createDataFrame([("a",)], "node string")
    edges = graph.symmetric(links)
    assert {tuple(r) for r in graph.bfs(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("m", 1), ("c", 2)}
    assert graph.bfs(edges, seeds, 3, cap=2).where("dist = 2").count() == 0
    assert {r["repo"]: r["reached"] for r in graph.impact(graph.bfs(edges, seeds, 2), nodes).collect()} == {"r1": 3, "r2": 1}
    assert [(r["label_lower"], r["independent"]) for r in graph.same_label(nodes, "MAIN").collect()] == [("main", True)]
    assert graph.connected_labels(nodes, links).count() == 0


def test_remap_and_refusals(spark):
    old = spark.createDataFrame([(f"n{i}", "1" if i < 10 else "2" if i < 16 else "3") for i in range(20)], "node_id string, community string")
    new = spark.createDataFrame([(f"n{i}", "7" if i < 16 else "8") for i in range(20)], "node_id string, community string")
    graph.check_remap(old, new)
    got = {r["old"]: (r["new"], r["outcome"]) for r in graph.remap(old, new).collect()}
    assert got == {"1": ("7", "carried"), "2": ("7", "collision"), "3": ("8", "carried")}
    for bad in (new.limit(3), new.withColumn("node_id", F.concat(F.lit("z"), "node_id")), new.where("node_id IN ('n0','n1')").union(spark.createDataFrame([(f"q{i}", "9") for i in range(20)], "a string, b string"))):
        with pytest.raises(ValueError):
            graph.check_remap(old, bad)


def test_layer_replacement_is_idempotent(spark):
    nodes = spark.createDataFrame([("a", ""), ("p", "packages")], "id string, _origin string")
    links = spark.createDataFrame([("a", "p"), ("a", "a")], "source string, target string")
    fresh, fl = spark.createDataFrame([("q", "packages")], "id string, _origin string"), spark.createDataFrame([("a", "q")], "source string, target string")
    one = graph.replace_layer(nodes, links, "packages", fresh, fl)
    two = graph.replace_layer(*one, "packages", fresh, fl)
    for n, m in (one, two):
        assert {r["id"] for r in n.collect()} == {"a", "q"} and {tuple(r) for r in m.collect()} == {("a", "a"), ("a", "q")}


def test_contentless(spark):
    rows = spark.createDataFrame([("a", "r", "", None, []), ("b", None, None, None, None), ("c", "r", "x", None, None)], "id string, repo string, label string, file_type string, tickets array<string>")
    assert {tuple(r) for r in graph.contentless(rows).collect()} == {("r", 1), ("(no repository)", 1)}


def test_entity_resolution(spark):
    nodes = spark.createDataFrame([("c1", "x", "Same", "doc", "a/f.md"), ("c2", "x", "Same", "doc", "b/g.md"), ("c1", "y", "One", "doc", "a/One.v2.md"), ("c2", "y", "Two", "doc", "b/two.md"), ("c1", "k1", "host/path:1", "c", "z.md"), ("c2", "k2", "host/path:1", "c", "w.md"), ("c1", "p1", "readme", "c", "z.md"), ("c2", "p2", "readme", "c", "w.md"), ("c1", None, "x", "x", "x")], "chunk string, id string, label string, file_type string, source_file string")
    merged, remap = resolve.merge_nodes(nodes)
    ids = {r["final_id"]: r for r in merged.collect()}
    assert set(ids) == {"x", "a_one_v2_y", "b_two_y", "k1", "k2", "p1", "p2"} and ids["x"]["source_files"] == ["a/f.md", "b/g.md"] and ids["b_two_y"]["original_id"] == "y"
    assert resolve.overwritten(merged).count() == 0
    kept, moved, counts = resolve.consolidate(merged, remap)
    assert {r["final_id"] for r in kept.collect()} == set(ids) - {"k2"} and tuple(counts.first()) == (1, 1)
    edges = spark.createDataFrame([("c1", 0, "x", "y", "r"), ("c2", 0, "x", "y", "r"), ("c1", 1, "x", "k2", "r"), ("c3", 0, "y", "x", "r"), ("c3", 1, "gone", "x", "r"), ("c2", 1, "x", "k2", "r")], "chunk string, pos int, source string, target string, relation string")
    out, tally = resolve.resolve_edges(edges, moved)
    assert {(r["source"], r["target"]) for r in out.collect()} == {("x", "a_one_v2_y"), ("x", "b_two_y"), ("x", "k1")}
    assert {r["state"]: r["n"] for r in tally.collect()} == {"recovered": 3, "ambiguous": 1, "dangling": 1, "duplicate": 1}
    assert [r[0] for r in resolve.suffix_breaches(spark.createDataFrame([("a_c01",), ("b_chunk12_3",), ("ok",)], "final_id string")).orderBy("final_id").collect()] == ["a_c01", "b_chunk12_3"]


def test_services_and_deployments(spark):
    services = spark.createDataFrame([("pay-service",), ("id-service",), ("progress",), ("nope",)], "service string")
    repos = spark.createDataFrame([("context-pay",), ("pay-long-name",), ("video",), ("my-progression",)], "repo string")
    assert {tuple(r) for r in layers.match_services(services, repos).collect()} == {("pay-service", "context-pay"), ("progress", "my-progression")}


def test_digest_and_grounding(spark, estate):
    nodes, links = estate
    d = dossier.community_digest(nodes, graph.degree(links), settings=DEFAULTS.with_overrides({"min_community_size": 2})).orderBy("community").collect()
    assert [(r["community"], r["size"], r["repositories"], r["top_nodes"][0]) for r in d] == [(1, 3, ["r1"], "Main (a.py)"), (2, 2, ["r2"], "Main (c.py)")]
    prose = spark.createDataFrame([("1", "FooThing uses bar_baz, probably."), ("2", "FooThingTest in a.py")], "community string, text string")
    evidence = spark.createDataFrame([("1", "FooThing"), ("2", "FooThing"), ("2", "src/a.py")], "community string, identifier string")
    assert {tuple(r) for r in dossier.ungrounded(prose, evidence).collect()} == {("1", "bar_baz"), ("2", "a.py")}
    assert dossier.ungrounded(prose, evidence, estate=spark.createDataFrame([("bar-baz",), ("a.py",)], "identifier string")).count() == 0
    assert [r["word"] for r in dossier.speculation(prose).collect()] == ["probably"]
    v = {r["origin"]: (r["summaries"], r["flagged"]) for r in dossier.verify(prose, evidence, prose.where("community = '2'")).collect()}
    assert v == {"authored": (1, 1), "carried": (1, 1)}
    gate = dossier.prose_gate(prose.union(spark.createDataFrame([("9", "x" * 100)], "a string, b string")), evidence, 25, 60).orderBy("community")
    assert [r["reason"] for r in gate.collect()] == ["", "too-short", "unknown-id"]


def test_systematic_sample(spark):
    ids = [str(i) for i in range(37)]
    order = sorted(ids, key=lambda x: (len(x), x))
    got = sorted(r["id"] for r in dossier.sample_ids(spark.createDataFrame([(i,) for i in ids], "id string"), 10).collect())
    assert got == sorted(order[int(i * len(order) / 10)] for i in range(10))


def test_topic_dossier(spark, estate):
    nodes, links = estate
    topics = spark.createDataFrame([("pay", ["pay", "c.py"])], "slug string, keywords array<string>")
    out = dossier.topic_dossier(nodes, links, graph.degree(links), topics)
    assert {r["id"] for r in out["nodes"].collect()} == {"c", "f"} and [r["label"] for r in out["features"].collect()] == ["Paying"] and [r["ticket"] for r in out["tickets"].collect()] == ["AB-1"]


def test_gates(spark):
    nodes = spark.createDataFrame([("a", "r", "x.py", None), ("b", "r", "y.py", "pkg")], "id string, repo string, source_file string, _origin string")
    ix = spark.createDataFrame([("r", "x.py")], "repo string, path string")
    assert {r["layer"]: (r["joined"], r["dead"]) for r in gates.join_cardinality(nodes, ix).collect()} == {"semantic": (1, False), "pkg": (0, True)}
    assert not gates.missing_repo(nodes) and gates.missing_repo(nodes.withColumn("repo", F.lit("")))
    plan = gates.chunk_plan(spark.createDataFrame([("document", f"d/{i}.md") for i in range(5)] + [("image", "d/p.png"), ("document", "a.md")], "kind string, path string"), 2)
    got = {}
    for r in plan.orderBy("chunk", "pos").collect():
        got.setdefault(r["chunk"], []).append(r["path"])
    assert got == {"0001": ["d/p.png"], "0002": ["a.md"], "0003": ["d/0.md", "d/1.md"], "0004": ["d/2.md", "d/3.md"], "0005": ["d/4.md"]}
    repos = spark.createDataFrame([(x,) for x in ("app-one", "app-two", "lib[x]", "other")], "name string")
    assert {r["name"] for r in gates.selected(repos, [("prefix", "app-"), ("match", "lib[[]x]"), ("exclude", "app-two")]).collect()} == {"app-one", "lib[x]"}
    rules = spark.createDataFrame([(1, "prefix", "app-"), (2, "match", "zz*"), (3, "repo", "gone"), (4, "exclude", "nothing")], "line int, kind string, value string")
    assert sorted(r["line"] for r in gates.unmatched_rules(rules, repos).collect()) == [2, 3]
    files = spark.createDataFrame([("x/CLAUDE.md", ""), ("x/.claude/settings.json", '{"hooks": {}}'), ("y/settings.json", "{}"), ("z/.git/AGENTS.md", "")], "path string, content string")
    assert {tuple(r) for r in gates.corpus_config(files).collect()} == {("x/CLAUDE.md", "instructions"), ("x/.claude/settings.json", "executable"), ("x/.claude", "config-dir")}
    docs = spark.createDataFrame([("a/b.docx",), ("test/b.docx",), ("unit-tests/c.csv",), ("d.md",)], "path string")
    assert [r[0] for r in gates.convertible(docs).collect()] == ["a/b.docx"]
    md = spark.createDataFrame([("```bash\n$ pip install \\\n  x # why\n# no\n```\n```py\nx\n```",)], "content string")
    assert [r["command"] for r in gates.shell_commands(md).collect()] == ["pip install x"]
    prov = spark.createDataFrame([("2024-01-01T23:30:00-05:00",), ("2024-01-02T01:00:00+00:00",), ("never",)], "committed string")
    assert gates.latest_synced(prov).first()["latest"] == "2024-01-01"
    v = spark.createDataFrame([(None, "louvain"), ("leiden", None), ("leiden", "louvain"), ("leiden", "leiden")], "r string, h string")
    assert [r[0] for r in v.select(gates.partitioner_verdict(F.col("r"), F.col("h"))).collect()] == ["unrecorded", "undeterminable", "different", "same"]
    pages = gates.pages_of(spark.createDataFrame([(f"A-{i:03d}",) for i in range(25)], "ticket string"), 10)
    assert Counter(r["page"] for r in pages.collect()) == Counter({0: 10, 1: 10, 2: 5})


def test_chunk_plan_kinds(spark):
    """Code is planned only if asked for; unknown and empty kinds and chunks of no file are refused; absolute paths are reported."""
    files = spark.createDataFrame([("code", "d/a.py"), ("document", "d/a.md"), ("image", "d/b.png"), ("document", "/abs/c.md")], "kind string, path string")
    assert sorted(r["path"] for r in gates.chunk_plan(files).collect()) == ["/abs/c.md", "d/a.md", "d/b.png"]
    assert [r["path"] for r in gates.chunk_plan(files, kinds=("code",)).collect()] == ["d/a.py"]
    assert [r["path"] for r in gates.absolute_paths(gates.chunk_plan(files)).collect()] == ["/abs/c.md"]
    only = spark.createDataFrame([("d/a.md",)], "path string")
    assert [(r["chunk"], r["path"]) for r in gates.chunk_plan(files, only=only).collect()] == [("0001", "d/a.md")]
    for raw in ("documnet", "", " , "):
        with pytest.raises(ValueError):
            gates.requested_kinds(raw)
    with pytest.raises(ValueError):
        gates.chunk_plan(files, 0)


def test_running_sums_by_range(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "k long, w long").repartition(5)
    got = {r["k"]: r["s"] for r in graph.with_rank(df, F.col("k"), name="s", weight="w").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(200)}


def test_community_labels_from_evidence(spark):
    nodes = spark.createDataFrame([(f"n{i}", "r" if i % 3 else "q", None if i == 0 else f"L{i}", None, 1 + i % 2, None, i) for i in range(60)], "id string, repo string, label string, source_file string, community long, kind string, pos long")
    degrees = spark.createDataFrame([("n0", 9), ("n2", 5), ("n3", 7)], "id string, degree long")
    given = spark.createDataFrame([("1", ""), ("9", "x")], "community string, label string")
    got = {r["community"]: r["label"] for r in dossier.community_digest(nodes, degrees, given).collect()}
    assert got == {1: "r: L2", 2: "r: L3"}


def test_neighbours_of_ends_that_are_no_nodes(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "id string, label string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "a"), ("b", "a"), ("a", "a")], "source string, target string")
    got = sorted((r["node"], r["other"], r["degree"], r["rank"]) for r in graph.top_neighbours(nodes, links).collect())
    assert got == [("a", "b", 2, 1), ("b", "a", 6, 1), ("c", "a", 6, 1), ("x", "a", 6, 1)]


def test_gate_codes_and_documents_that_would_be_too_large(spark):
    from estatelens.operators import status
    from estatelens.plans import reports

    rows = spark.createDataFrame([("graph", True), ("dive", False)], "mode string, floor_broken boolean")
    assert status.gate_code(rows.limit(0), rows) == 2 and status.gate_code(rows, rows) == 1 and status.gate_code(rows, rows.where("mode = 'graph'").withColumn("floor_broken", F.lit(False))) == 0
    with pytest.raises(ValueError, match="too many"):
        reports.at_most(spark.range(5), 4, "rows")


def test_grounding_never_broadcasts_spellings(spark, tmp_path):
    """Of a small file Spark's estimate is far below what its spellings take, so they must not go through the driver."""
    folder = str(tmp_path / "e")
    spark.range(50).select(F.col("id").alias("community"), F.concat(F.lit("foo_"), "id", F.lit(".py")).alias("identifier"), F.concat(F.lit("foo_"), F.col("id") % 10, F.lit(" bar_x")).alias("text")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    out = dossier.ungrounded(rows.select("community", "text"), rows.select("community", "identifier"), estate=rows.where("community < 5").select("identifier"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r["identifier"] for r in out.collect()) == Counter({"bar_x": 50} | {f"foo_{i}": 4 for i in range(5, 10)})
