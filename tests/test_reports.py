"""Status, discovery, reports and answer parts."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens.operators import graph, status
from estatelens.plans import reports
from estatelens.sources import discovery, readers
from estatelens.sources.schemas import COMMIT

from .test_estate import commit


def test_status(spark):
    some, none = spark.range(3), spark.range(0)
    rows = status.report(spark, {"a": some, "b": none, "c": None})
    assert {tuple(r) for r in rows.collect()} == {("a", "finding", 3), ("b", "ok", 0), ("c", "unknown", None)}
    assert (status.exit_code(rows), status.exit_code(rows, strict=True), status.exit_code(rows, failing=("b",)), status.exit_code(rows, failing=("a",))) == (0, 1, 0, 1)
    assert status.layer_coverage(x=(some, none)) == {"x": (3, 0)}
    ix = spark.createDataFrame([("r1", "p"), ("r1", "q")], "repo string, path string")
    rec = spark.createDataFrame([("r1",), ("r2",)], "name string")
    assert tuple(status.intent_coverage(ix, rec).first()) == (1, 2) and [r[0] for r in status.unmined(ix, rec).collect()] == ["r2"]
    t = spark.createDataFrame([("x 1,234 nodes and 56 edges", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00+00:00"), ("nothing", None, None)], "t string, a string, b string")
    got = t.select(status.figure(F.col("t"), "nodes"), status.figure(F.col("t"), "edges"), status.stale(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1234, 56, True), (None, None, False)]
    claims = spark.createDataFrame([(3, 1)], "nodes long, edges long")
    assert status.claims_differ(claims, some, spark.range(1)).count() == 0 and status.claims_differ(claims, none, none).count() == 1
    assert [r["repo"] for r in status.behind(spark.createDataFrame([("b", 2), ("a", 2), ("c", 0), ("d", 9)], "repo string, behind long")).collect()] == ["d", "a", "b"]
    nodes = spark.createDataFrame([("a", "r", 1), ("b", "r", 2)], "id string, repo string, community long")
    gap = status.partitioner_gap(graph.clustering_counts(nodes), graph.clustering_counts(nodes.where("id = 'a'")))
    assert {r["figure"] for r in gap.collect()} == {"nodes", "communities", "clustered"}
    cites = spark.createDataFrame([("x.md",), ("y.md",), (None,)], "source_file string")
    assert [r[0] for r in status.dangling_citations(cites, spark.createDataFrame([("x.md",)], "path string")).collect()] == ["y.md"]


def test_discovery(spark):
    calls = []

    def runner(args):
        calls.append(args[2])
        names = ["app-1", "app-2", "lib"] if "teams" not in args[2] else ["lib", "team-only", "app-2"]
        return "\n".join(json.dumps({"name": n, "defaultBranch": "main" if "teams" not in args[2] else "dev"}) for n in names) + "\n\n"

    out = discovery.discover(spark, [("prefix", "app-"), ("team", "t"), ("exclude", "app-2"), ("fetch", "lib")], "o", runner)
    assert {tuple(r) for r in out.collect()} == {("app-1", "main", "estate"), ("lib", "main", "external"), ("team-only", "dev", "estate")} and len(calls) == 2
    assert [r["line"] for r in discovery.config_lines(out, "o").orderBy("name").collect()][0] == "app-1|git@github.com:o/app-1.git|main"
    links = spark.createDataFrame([("r", "a.md", None, None), ("r", "b.md", "c.md", True), ("r", "d.md", "e.bin", True), ("r", ".git/x.md", None, None), ("r", "f.bin", None, None)], "repo string, path string, target string, inside boolean")
    assert {tuple(r)[1:] for r in discovery.symlink_outcomes(links, [".md"]).collect()} == {("broken", 1), ("duplicating", 1), ("misattributing", 1)}
    p = spark.createDataFrame([("/s/a/b.md",), ("/t/c.md",)], "path string")
    assert [r[0] for r in p.select(discovery.store_relative(F.col("path"), "/s")).collect()] == ["a/b.md", "/t/c.md"]
    assert [r[0] for r in p.select(discovery.absolute(discovery.store_relative(F.col("path"), "/s"), "/s")).collect()] == ["/s/a/b.md", "/t/c.md"]
    assert discovery.uncached(p, p.limit(1)).count() == 1


def test_documents(spark, tmp_path):
    rows = [{**dict.fromkeys(COMMIT.names), **commit(i, "s", repo="r1" if i < 3 else "r2", day=f"202{i}-01-01", author=("Ann|B" if i else "Zed", "")), "repository_url": "u"} for i in range(4)]
    commits = spark.createDataFrame(rows, COMMIT).withColumn("pos", F.monotonically_increasing_id())
    prov = spark.createDataFrame([("r1", "abcdef0123456", "2024-05-06T00:00:00Z")], "name string, sha string, committed string")
    lines = reports.manifest(commits, prov)
    assert "| `r1` | 3 | 2024-05-06 (`abcdef01`) | `u` |" in lines and "| `r2` | 1 | — | `u` |" in lines
    index = reports.repository_index(commits, "r1")
    assert index[4:7] == ["| 2022 | 1 |", "| 2021 | 1 |", "| 2020 | 1 |"] and "| Ann\\|B | 2 |" in index
    page = reports.page("T", {"entries": spark.createDataFrame([("</script>",)], "label string")})
    (tmp_path / "p.html").write_text(page)
    block = readers.json_blocks(spark.createDataFrame([(page,)], "html string")).first()
    assert block["block_id"] == "entries" and json.loads(block["json"]) == [{"label": "</script>"}]
    with pytest.raises(ValueError):
        reports.page("T", {"x": spark.range(5)}, most=3)


def test_answer_parts(spark):
    c = spark.createDataFrame([(["no", "Has Refund in it", "refund again", "x refund", "refund 4"],), (["only one", "two", "three"],), (None,)], "comments array<string>")
    got = [r[0] for r in c.select(reports.comment_rows(["refund"])).collect()]
    assert got == [["Has Refund in it", "refund again", "x refund"], ["only one"], []]
    assert [r[0] for r in c.select(reports.comment_rows([])).collect()][1] == ["only one", "two"]
    v = spark.createDataFrame([("T", "d", "A refund"), ("T", "s", "nothing"), ("T", "b", "a")], "ticket string, field string, value string")
    assert [(r["field"], r["term"]) for r in reports.matching_evidence(v, ["a", "refund"]).collect()] == [("d", "refund")]
    s = spark.createDataFrame([(["Fix it", "Fix it now!", "Other"], "fix it now")], "s array<string>, d string")
    assert s.select(reports.other_subjects(F.col("s"), F.col("d"))).first()[0] == ["Other"]
    before = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["a"]), ("q3", ["a"])], "question string, met array<string>")
    now = spark.createDataFrame([("q1", ["b", "a"]), ("q2", ["b"]), ("q3", [])], before.schema)
    assert {r["question"]: r["state"] for r in reports.lost_answers(before, now).collect()} == {"q2": "moved", "q3": "lost"}
    assert json.loads(reports.baseline(before))["q1"] == ["a", "b"]
    q = spark.createDataFrame([(0, "# c"), (1, "Why | really? | graph, tickets")], "line int, value string")
    assert [(r["question"], r["accept"]) for r in reports.read_questions(q).collect()] == [("Why | really?", ["graph", "tickets"])]
    with pytest.raises(ValueError):
        reports.read_questions(q.limit(1))
    e = spark.createDataFrame([(0, 5, "feature", 1), (1, 5, "code", 9), (2, 7, "feature", 3), (3, -1, "code", 0)], "eid long, community long, kind string, degree long")
    assert [r["eid"] for r in reports.feature_cards(e, 1).collect()] == [2]
    assert [r["community"] for r in reports.summaries_for(e, spark.createDataFrame([(7, "t")], "community long, text string"), "eid", 3).collect()] == [7]
