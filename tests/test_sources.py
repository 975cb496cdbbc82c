"""Readers, parsers, sinks, the tracker and streaming."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from estatelens.operators import layers
from estatelens.settings import DEFAULTS
from estatelens.sources import parsers, readers, sinks, tracker
from estatelens.streaming import incremental

from .test_estate import commit


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_graph_documents(spark, tmp_path):
    doc = {"nodes": [{"id": "b", "label": 'decoy "nodes": ['}, {"id": "a", "community": 3, "metadata": {"kind": "feature", "tickets": ["A-1"]}}], "links": [{"source": "a", "target": "b"}]}
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump(doc, f)
    nodes, links = readers.read_graph(spark, str(tmp_path / "g.json.gz"))
    assert [(r["pos"], r["id"], r["kind"]) for r in nodes.orderBy("pos").collect()] == [(0, "b", None), (1, "a", "feature")] and links.count() == 1
    assert readers.read_graph(spark, str(tmp_path / "none.json"), required=False)[0].count() == 0
    put(tmp_path / "cut.json", json.dumps(doc)[:60])
    with pytest.raises(Exception):
        readers.read_graph(spark, str(tmp_path / "cut.json"))[0].count()
    assert readers.read_array(spark, str(tmp_path / "g.json.gz"), "links", readers.LINK).count() == 1


def test_config_lists(spark, tmp_path):
    rows = readers.read_topics(spark, put(tmp_path / "t.txt", "# topics\npay | Payments | Refund, pay ,\n\n")).collect()
    assert [(r["slug"], r["keywords"]) for r in rows] == [("pay", ["refund", "pay"])]
    with pytest.raises(ValueError, match="line 2"):
        readers.pipe_rows(spark, put(tmp_path / "bad.txt", "a | b | c\nx | | z\n"), ("a", "b", "c"))
    assert readers.read_filters(spark, put(tmp_path / "f.txt", "prefix app-\nexclude app-x\n")).count() == 2
    for text in ("exclude x\n", "match **\n", "nonsense x\n", "repo a\nfetch a\n"):
        with pytest.raises(ValueError):
            readers.read_filters(spark, put(tmp_path / "f2.txt", text))
    csv = put(tmp_path / "c.csv", "\ufeffSummary,Other,ISSUE KEY\nA title,x,AB-1\n,y,AB-2\nshort\n")
    assert [(r["ticket"], r["title"]) for r in readers.read_titles(spark, csv).collect()] == [("AB-1", "A title")]


def test_git_log(spark):
    R, U, G = parsers.RECORD, parsers.FIELD, parsers.FILES
    record = U.join(["a" * 40, "p1 p2", "Ann", "a@x", "2024-01-01T00:00:00Z", "Bob", "b@x", "2024-01-02T00:00:00Z", "main, tag: v1", "Subject", "Body\r\n\r\n\r\n\r\nend\n"])
    log = R + record + G + "\n3\t1\tsrc/a.py\n-\t-\timg.png\nnot a stat\n" + R + "broken" + R + record.replace("a" * 40, "b" * 40).replace("p1 p2", "p1") + G
    commits, skipped = parsers.parse_git_log(spark.createDataFrame([("r", "u", log)], "repository string, repository_url string, log string"))
    a, b = commits.orderBy("sha").collect()
    assert (a["is_merge"], a["additions"], a["deletions"], a["file_count"], a["body"], a["refs"]) == (True, 3, 1, 2, "Body\n\nend", ["main", "tag: v1"])
    assert [(f["path"], f["additions"], f["binary"]) for f in a["files"]] == [("src/a.py", 3, False), ("img.png", None, True)]
    assert (b["is_merge"], b["file_count"]) == (False, 0) and skipped.first()["skipped"] == 1


@pytest.fixture()
def clones(spark, tmp_path):
    root = tmp_path / "clones"
    put(root / "shop/features/pay/AB-9.feature", '@smoke @AB-1\nFeature: Paying\nScenario: Pay once AB-2\n  Given I have "5" coins\n  When I pay\nScenario Outline:\n')
    put(root / "shop/src/test/java/x/PaySteps.java", 'public class PaySteps {\n @Given("^I have {string} coins$")\n void a() {}\n @When("I pay")\n void b() {} }')
    put(root / "shop/package.json", '{"name": "shop", "dependencies": {"@org/lib": "1"}, "devDependencies": {"other": "2"}}')
    put(root / "lib/package.json", '{"name": "@org/lib"}')
    put(root / "lib/packages/sub/package.json", "not json")
    put(root / "shop/src/a.ts", 'import x from "@org/lib/deep";\nconst y = require(\'other\')')
    put(root / "shop/src/b.ts", "import z from '@org/libx'")
    put(root / "shop/node_modules/q/a.ts", 'from "@org/lib"')
    put(root / "infra/main.tf", 'module "a" { source = "git::https://github.com/org/mod-a.git?ref=1" }\nmodule "b" { source = "git@github.com:org/lib.git" }\nmodule "c" { source = "notgithub.com/org/x" }\nmodule "d" { source = "github.com/org/infra" }')
    put(root / "ops/ansible/group_vars/prd/shop-service_values.yaml.j2", "{% if x %}\na:\n  b: {{ secret }}\n  c: [1, two]\n{% endif %}\nd: null\n")
    put(root / "ops/ansible/group_vars/base_values.yml", "- not a mapping")
    return readers.read_files(spark, str(root), (".feature", ".java", ".json", ".ts", ".tf", ".j2", ".yml"))


def test_layers_from_files(spark, clones):
    features = parsers.parse_features(clones)
    f = features.first()
    assert (f["repo"], f["name"], f["area"], f["scenarios"], f["tickets"], f["tags"]) == ("shop", "Paying", "pay", ["Pay once AB-2"], ["AB-1", "AB-2", "AB-9"], ["AB-1", "smoke"])
    steps = parsers.parse_steps(clones)
    assert {r["step"]: r["symbol"] for r in steps.collect()} == {"i have ¤ coins": "PaySteps", "i pay": "PaySteps"} and f["steps"] == ["i have ¤ coins", "i pay"]
    base = spark.createDataFrame([("n1", "shop", "src/test/java/x/PaySteps.java", "PaySteps", 4), ("n2", "shop", "src/a.ts", "a", 4), ("n3", "infra", "main.tf", "main", 1)], "id string, repo string, source_file string, label string, community long")
    nodes, links = layers.gherkin_layer(features, steps, base)
    assert {(r["kind"], r["community"]) for r in nodes.collect()} == {("feature", 5), ("scenario", 5), ("ticket", None)}
    assert sorted(r["relation"] for r in links.collect()) == ["has_scenario", "implemented_by", "references", "references", "references"]
    packages, deps = parsers.parse_manifests(clones)
    assert {(r["repo"], r["package"]) for r in packages.collect()} == {("shop", "shop"), ("lib", "@org/lib")} and {r["package"] for r in deps.collect()} == {"@org/lib", "other"}
    sites = parsers.import_sites(clones, packages)
    assert [tuple(r) for r in sites.collect()] == [("shop", "@org/lib", "src/a.ts")]
    pn, pl = layers.package_layer(packages, deps, sites, base)
    assert [(r["id"], r["consumers"][0]["import_sites"]) for r in pn.collect()] == [("lib::@org/lib", 1)] and [(r["source"], r["target"]) for r in pl.collect()] == [("n2", "lib::@org/lib")]
    refs = parsers.module_references(clones)
    assert {(r["consumer"], r["provider"]) for r in refs.collect()} == {("infra", "mod-a"), ("infra", "lib")}
    mn, ml = layers.module_layer(refs, spark.createDataFrame([("lib",)], "name string"), base.select("repo", "id").where("id = 'n3'"))
    assert {r["label"]: r["repo"] for r in mn.collect()} == {"mod-a": "", "lib": "lib"} and ml.count() == 2


def test_values_files(spark, clones):
    values = parsers.parse_values(clones, parsers.glob_root("ansible/group_vars/**/*_values.yaml.j2"))
    got = {r["service"]: (r["environment"], r["config"]) for r in values.collect()}
    assert got == {"shop-service": ("prd", {"a.b": parsers.SET_AT_DEPLOY, "a.c.0": "1", "a.c.1": "two", "d": ""}), "base": ("_base", None)}
    matched = layers.match_services(values.select("service"), spark.createDataFrame([("shop",)], "repo string"))
    nodes, links = layers.deployment_layer(values, matched, spark.createDataFrame([(9,)], "community long"), spark.createDataFrame([("shop", "n1")], "repo string, id string"))
    assert {(r["kind"], r["community"]) for r in nodes.collect()} == {("environment", 10), ("deployment", 10)} and sorted(r["relation"] for r in links.collect()) == ["configures", "deployed_to"]
    assert tuple(layers.join_rate(values, matched).first()) == (2, 1)


def test_sinks(spark, tmp_path):
    assert sinks.gzip_bytes("x") == sinks.gzip_bytes("x") and gzip.decompress(sinks.gzip_bytes("é")) == "é".encode()
    df = spark.createDataFrame([("b", [1]), ("a", None)], "k string, v array<int>")
    assert sinks.json_document(df, "k", "v") == '{"a":null,"b":[1]}'
    commits = spark.createDataFrame([{**dict.fromkeys(readers.COMMIT.names), **commit(1, "A | b", "the body"), "file_count": 1, "additions": 1, "deletions": 0}], readers.COMMIT)
    md = commits.select(sinks.commit_markdown().alias("m")).first()["m"]
    assert "## 00000001: A \\| b" in md and "- **Parents:** None" in md and "| `a.py` | 1 | binary |" in md and md.endswith("---\n")
    sinks.write_year_files(commits, str(tmp_path / "y"))
    sinks.write_ndjson(commits, str(tmp_path / "n"))
    assert (tmp_path / "y/repo=r1/year=2024").is_dir() and readers.read_commits(spark, str(tmp_path / "n")).count() == 1
    html = sinks.markdown_html("# T\n\nSee **AB-1** in `x<y`\nshop too.\n- one\n- two\n| a | b |\n|---|---|\n| 1 | AB-2 |", base="https://t/", ticket=r"\b([A-Z]{2}-\d+)\b", repos=["shop"], org="o")
    assert html.startswith("<h2>T</h2>\n<p>See <b><a href=") and "<code>x&lt;y</code>" in html and "<ul><li>one</li><li>two</li></ul>" in html and "<th>a</th>" in html and "https://github.com/o/shop" in html
    assert sinks.to_html(spark.createDataFrame([(1, "# A"), (2, None)], "i int, md string"), "md").orderBy("i").collect()[0]["html"] == "<h2>A</h2>"
    assert sinks.script_json('{"a":"</script>"}') == '{"a":"<\\/script>"}'
    old = spark.createDataFrame([("estate", "a", "s1", "main", "d1", False), ("estate", "b", "s2", "main", "d2", False)], "scope string, name string, sha string, branch string, committed string, sync_failed boolean")
    new = spark.createDataFrame([("estate", "a", None, None, None, True), ("estate", "b", "s3", "main", "d3", False)], old.schema)
    assert {(r["name"], r["sha"], r["sync_failed"]) for r in sinks.merged_provenance(old, new).collect()} == {("a", "s1", True), ("b", "s3", False)}


def test_tracker(spark):
    keys = spark.createDataFrame([(f"AB-{i}",) for i in range(5)] + [("CD-1",), ("XX-1",)], "ticket string")
    cache = spark.createDataFrame([("AB-0", "fetched", "s", None), ("AB-1", "denied", None, None)], "ticket string, outcome string, summary string, comments array<string>")
    settings = DEFAULTS.with_overrides({"tracker_projects": ("AB", "CD"), "tracker_deny": ("CD",), "page_size": 2})
    assert {r["ticket"] for r in tracker.to_ask(keys, cache, settings).collect()} == {"AB-1", "AB-2", "AB-3", "AB-4"}
    calls, waits, kept = [], [], []

    def opener(url):
        calls.append(url)
        if len(calls) == 1:
            return 429, {"Retry-After": "9999"}, b""
        if "AB-3" in url:
            return 403, {}, b""
        return 200, {}, json.dumps({"issues": [{"key": "AB-1", "fields": {"summary": "mail a@b.co", "created": "2024-01-01T00:00", "status": {"name": "Done"}}}]}).encode()

    report = tracker.run(spark, keys, cache, "https://t", opener, lambda df: kept.extend(df.collect()), settings, waits.append)
    assert waits == [tracker.MAX_WAIT] and report == {"fetched": 1, "absent": 1, "denied": 2, "failed": 0, "requests": 2}
    got = {r["ticket"]: r for r in kept}
    assert got["AB-1"]["summary"] == "mail [email address withheld]" and got["AB-1"]["created"] == "2024-01-01" and got["AB-2"]["outcome"] == "absent"
    merged = tracker.upsert(cache, spark.createDataFrame([("AB-0", "denied"), ("AB-1", "fetched")], "ticket string, outcome string"))
    assert {r["ticket"]: r["outcome"] for r in merged.collect()} == {"AB-0": "fetched", "AB-1": "fetched"}
    raw = spark.createDataFrame([("A-1", "s", None, None, None, "2024", None, None, "", ["Jenkins build failed", " ", "me@x.org says " + "word " * 600])], tracker.ISSUES)
    c = tracker.projected(raw).first()
    assert len(c["comments"]) == 1 and c["comments"][0].startswith("[email address withheld] says") and len(c["comments"][0]) <= 2030 and c["description"] is None
    assert tracker.retry_delay("x") == 1.0 and tracker.retry_delay("-3") == 0.0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [commit(i, f"AB-{i % 2} x") for i in range(4)]
    for n, part in enumerate((rows[:3], rows[1:])):  # two commits come twice
        (src / f"{n}.json").write_text("\n".join(json.dumps(r) for r in part))
    stream = incremental.file_ticket_counts(incremental.commit_stream(spark, str(src), 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["ticket"], r["n"]) for r in spark.sql("SELECT * FROM counts").collect()} == {("AB-0", 2), ("AB-1", 2)}
    raw = spark.readStream.schema(readers.COMMIT).option("maxFilesPerTrigger", 1).json(str(src)).select("sha", "subject")
    merge = lambda old, new: old.unionByName(new).dropDuplicates(["sha"])
    incremental.upserting(raw, merge, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t/v=1")).count() == 4
    batch = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert incremental.windowed(batch, "t", "10 minutes", "1 hour", "k").first()["n"] == 2


def test_array_scan_holds_little_and_fails_on_truncation(spark, tmp_path):
    """Decoys in strings and deeper arrays are passed over; absent documents and arrays are empty; an array without an end is an error."""
    from estatelens.sources.schemas import L, S, struct

    node = struct(id=L, s=S)
    doc = {"x": '"nodes": [ {', "y": [{"nodes": [{"id": 99}]}], "nodes": [{"id": i, "s": 'a}"]\\{é'} for i in range(500)], "links": [{"nodes": [{"id": 3}]}]}
    text = json.dumps(doc, ensure_ascii=False)
    for name, data in (("g.json", text.encode()), ("g.json.gz", gzip.compress(text.encode())), ("pretty.json", json.dumps(doc, indent=1).encode())):
        (tmp_path / name).write_bytes(data)
        rows = readers.read_array(spark, str(tmp_path / name), "nodes", node).orderBy("pos").collect()
        assert [(r["pos"], r["id"], r["s"]) for r in rows] == [(i, i, 'a}"]\\{é') for i in range(500)]
    assert readers.read_array(spark, str(tmp_path / "g.json"), "none", node).count() == 0
    assert readers.read_array(spark, str(tmp_path / "absent.json"), "nodes", node).count() == 0
    for at in (text.index('"id": 0') + 3, text.index('"id": 400'), text.index("], \"links\"")):
        (tmp_path / "cut.json").write_text(text[:at])
        with pytest.raises(Exception, match="ends inside its array"):
            readers.read_array(spark, str(tmp_path / "cut.json"), "nodes", node).count()


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_array_scanner_in_pieces(size):
    doc = {"a": [1, {"nodes": [1]}], "nodes": [{"i": i, "m": {"k": [{}, "]"]}} for i in range(30)], "z": "]"}
    text = json.dumps(doc)
    scanner = readers.ArrayScanner("nodes")
    found = [x for i in range(0, len(text), size) for x in scanner.feed(text[i : i + size])]
    assert [json.loads(x) for x in found] == doc["nodes"] and scanner.state == "done"


def test_empty_chunk_folder_is_refused(spark, tmp_path):
    (tmp_path / "chunk_a_plan.json").write_text("{}")
    with pytest.raises(ValueError, match="no chunks"):
        readers.read_chunks(spark, str(tmp_path))


def test_settings_from_an_environment():
    from estatelens.settings import from_environment

    env = {"EL_PAGE_SIZE": "7", "EL_TRACKER_PROJECTS": "AB, CD,", "EL_SENSITIVE_PATTERNS": '{"code": "x+"}', "PAGE_SIZE": "9", "EL_TICKET_BROWSE_URL": "https://t.example"}
    got = from_environment(env, "EL_")
    assert (got.page_size, got.tracker_projects, got.ticket_browse_url) == (7, ("AB", "CD"), "https://t.example/") and {"code", "email-address"} <= set(got.sensitive_patterns)
    for bad in ({"EL_PAGE_SIZE": "x"}, {"EL_NONE": "1"}, {"EL_SENSITIVE_PATTERNS": "[]"}):
        with pytest.raises(ValueError):
            from_environment(bad, "EL_")


def test_sync_keeps_records_and_goes_on(spark):
    """Clones what is absent, fails one repository without the others, and hands on provenance after each."""
    from estatelens.sources import sync

    asked, kept = [], []

    def runner(args):
        asked.append(args)
        if "show-ref" in args and args[1].endswith("/b"):
            raise RuntimeError("no branch")
        return "abc\n" if "rev-parse" in args else ""

    known = spark.createDataFrame([("estate", "b", "old", "main", "2024", False)], sync.PROVENANCE)
    repos = [("estate", "a", "u/a", "main"), ("estate", "b", "u/b", "main"), ("external", "c", "u/c", "dev")]
    out, failures = sync.sync(spark, repos, "/x/", known, runner, lambda path: path == "/x/a/.git", lambda df: kept.append(df.count()))
    assert [f[0] for f in failures] == ["b"] and kept == [2, 2, 3]
    assert {(r["scope"], r["name"], r["sha"], r["sync_failed"]) for r in out.collect()} == {("estate", "a", "abc", False), ("estate", "b", "old", True), ("external", "c", "abc", False)}
    assert sum(a[0] == "clone" for a in asked) == 2


def test_semantic_index_by_a_model(spark):
    import numpy as np

    from estatelens.operators import semantic

    texts = spark.createDataFrame([("alpha beta gamma",), ("alpha beta gamma",), ("alpha beta gamma",)], "text string")
    got = {(r["token"], r["other"]) for r in semantic.semantic_index(texts, lambda words: np.array([[1.0, w == "gamma"] for w in words])).collect()}
    assert got == {("alpha", "beta"), ("beta", "alpha"), ("gamma", "alpha"), ("gamma", "beta"), ("alpha", "gamma"), ("beta", "gamma")}
    with pytest.raises(ValueError, match="at most"):
        semantic.knn(semantic.embedded(semantic.vocabulary(texts), lambda words: np.ones((len(words), 2))), "token", "vector", most=2)
