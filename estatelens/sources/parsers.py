"""Parsers from file contents (repo, path, content) to rows: git logs, Gherkin, step definitions, manifests, imports, Terraform, values files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_area, matches, normalise_message, normalise_step, split_lines, strip, text, tickets_of
from ..settings import DEFAULTS, STEP_LANGUAGES, Settings

RECORD, FIELD, FILES = "\x1e", "\x1f", "\x1d"
LOG_FIELDS = ("sha", "parents", "author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "refs", "subject", "body")
TERRAFORM = r"""source\s*=\s*"(?:git::)?(?:https://|git@|ssh://git@)?github\.com[/:][\w.-]+/([\w.-]+?)(?:\.git)?(?:[?/][^"]*)?\""""
VALUES_FILE = r"_values\.ya?ml(\.j2)?$"
SET_AT_DEPLOY = "<set-at-deploy-time>"


def numstat(lines: Column) -> Column:
    """Structs (path, additions, deletions, binary) of numstat lines; counts that are no numbers are null and mean binary."""
    good = F.filter(lines, lambda x: F.size(F.split(x, "\t", 3)) == 3)

    def one(x: Column) -> Column:
        p = F.split(x, "\t", 3)
        add, gone = F.element_at(p, 1).try_cast("long"), F.element_at(p, 2).try_cast("long")
        return F.struct(F.element_at(p, 3).alias("path"), add.alias("additions"), gone.alias("deletions"), (add.isNull() | gone.isNull()).alias("binary"))

    return F.transform(good, one)


def parse_git_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, skipped) of captured logs (repository, repository_url, log): records by RS, eleven fields by US, files after GS."""
    records = logs.select("repository", "repository_url", F.posexplode(F.split("log", RECORD)).alias("pos", "r")).where(strip(F.col("r")) != "")
    halves = F.split("r", FILES, 2)
    rows = records.withColumns({"f": F.split(F.element_at(halves, 1), FIELD, -1), "stat": F.coalesce(F.get(halves, F.lit(1)), F.lit(""))})
    good = rows.where(F.size("f") == len(LOG_FIELDS))
    f = {n: F.element_at("f", i + 1) for i, n in enumerate(LOG_FIELDS)}
    files = numstat(F.filter(split_lines(F.col("stat")), lambda x: strip(x) != ""))
    commits = good.select(
        "repository", "repository_url", "pos", strip(f["sha"]).alias("sha"), F.substring(strip(f["sha"]), 1, 8).alias("short_sha"), F.filter(F.split(f["parents"], " "), lambda x: x != "").alias("parents"),
        f["author_date"].alias("author_date"), f["committer_date"].alias("committer_date"), F.struct(f["author_name"].alias("name"), f["author_email"].alias("email")).alias("author"),
        F.struct(f["committer_name"].alias("name"), f["committer_email"].alias("email")).alias("committer"), F.filter(F.split(f["refs"], ", "), lambda x: x != "").alias("refs"),
        f["subject"].alias("subject"), normalise_message(f["body"]).alias("body"), files.alias("files"),
    )
    total = lambda k: F.aggregate("files", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[k], F.lit(0)))
    commits = commits.withColumns({"file_count": F.size("files"), "additions": total("additions"), "deletions": total("deletions"), "is_merge": F.size("parents") > 1})
    return commits, rows.where(F.size("f") != len(LOG_FIELDS)).groupBy("repository").agg(F.count("*").alias("skipped"))


def parse_features(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row a feature file that names its feature: repo, path, name, area, scenarios (in order), steps, tags, tickets."""
    lines = F.transform(split_lines(text("content")), strip)
    tail = lambda x: strip(F.regexp_replace(x, "^[^:]*:", ""))
    scenario = lambda x: x.startswith("Scenario:") | x.startswith("Scenario Outline:")
    keyword = r"^(Given|When|Then|And|But|\*)\s+"
    rows = files.withColumn("_l", lines)
    named = F.filter("_l", lambda x: x.startswith("Feature:"))
    tagged = F.filter("_l", lambda x: x.startswith("@"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    carry = F.filter("_l", lambda x: x.startswith("@") | scenario(x))
    out = rows.select(
        "repo", "path", F.nullif(F.coalesce(tail(F.get(named, F.size(named) - 1)), F.lit("")), F.lit("")).alias("name"), feature_area(F.col("path"), settings.features_dir).alias("area"),
        F.filter(F.transform(F.filter("_l", scenario), tail), lambda x: x != "").alias("scenarios"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_l", lambda x: x.rlike(keyword) & ~x.startswith("@")), lambda x: normalise_step(F.regexp_replace(x, keyword, ""))))).alias("steps"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(tagged, lambda x: F.split(x, r"\s+"))), lambda t: F.regexp_replace(t, "^@+", "")))).alias("tags"),
        F.array_sort(F.array_union(tickets_of(stem, settings.ticket_pattern), tickets_of(F.array_join(carry, "\n"), settings.ticket_pattern))).alias("tickets"),
    )
    return out.where("name IS NOT NULL")


def parse_steps(files: DataFrame, languages=STEP_LANGUAGES) -> DataFrame:
    """(repo, step, symbol, path) of step definitions; a later language, and within it a later file, overrides an equal step."""
    found = None
    for i, (_, (glob, annotation, symbol)) in enumerate(languages.items()):
        shape = r"^" + glob.replace(".", r"\.").replace("**/", "\0").replace("*", "[^/]*").replace("\0", "(?:.*/)?") + "$"
        own = files.where(F.col("path").rlike(shape))
        stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        name = F.coalesce(F.nullif(F.regexp_extract("content", symbol, 1), F.lit("")), stem) if symbol else stem
        rows = own.select("repo", "path", name.alias("symbol"), F.posexplode(matches(text("content"), "(?s)" + annotation, 1)).alias("at", "p"), F.lit(i).alias("lang"))
        found = rows if found is None else found.unionByName(rows)
    steps = found.withColumn("step", normalise_step(F.col("p")))
    return steps.groupBy("repo", "step").agg(F.max_by(F.struct("symbol", "path"), F.struct("lang", "path", "at")).alias("x")).select("repo", "step", "x.symbol", "x.path")


def parse_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, dependencies): names that package.json files at the root or one level below projects, packages or libs declare, and what root manifests depend on. Malformed files are passed over."""
    own = files.where(F.col("path").rlike(r"^(?:(?:projects|packages|libs)/[^/]+/)?package\.json$"))
    name = F.get_json_object("content", "$.name")
    packages = own.where(F.coalesce(name, F.lit("")) != "").select("repo", name.alias("package"), "path")
    deps = F.map_concat(*[F.coalesce(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>"), F.expr("map()").cast("map<string,string>")) for k in ("dependencies",)])
    dev = F.coalesce(F.from_json(F.get_json_object("content", "$.devDependencies"), "map<string,string>"), F.expr("map()").cast("map<string,string>"))
    roots = own.where("path = 'package.json'").select("repo", F.explode(F.array_distinct(F.concat(F.map_keys(deps), F.map_keys(dev)))).alias("package"))
    return packages, roots


def import_sites(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, package, path): sources that import a known package, by the module that an import or require names, or its first path segments."""
    source = files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs)$"))
    whole = matches(text("content"), r"""(?:from |require\()(?:"([^"]+)"|'[^']+')""", 1)
    single = matches(text("content"), r"""(?:from |require\()(?:'([^']+)'|"[^"]+")""", 1)
    seen = source.select("repo", "path", F.explode(F.array_distinct(F.concat(whole, single))).alias("m")).where("m <> ''")
    # a package is the module itself, or a prefix of it that ends at a slash: at most two segments, as scoped names have
    parts = F.split("m", "/")
    names = F.array_distinct(F.array(F.col("m"), F.element_at(parts, 1), F.array_join(F.slice(parts, 1, 2), "/")))
    return seen.select("repo", "path", F.explode(names).alias("package")).distinct().join(packages.select("package").distinct(), "package").select("repo", "package", "path")


def module_references(files: DataFrame) -> DataFrame:
    """(consumer, provider, files): repositories that Terraform files take modules from, themselves aside."""
    rows = files.where(F.col("path").endswith(".tf")).select(F.col("repo").alias("consumer"), "path", F.explode(F.array_distinct(matches(text("content"), TERRAFORM, 1))).alias("provider"))
    return rows.where("consumer <> provider").groupBy("consumer", "provider").agg(F.array_sort(F.collect_set("path")).alias("files"))


def strip_template(c: Column) -> Column:
    """Template text with its marks taken out, never evaluated."""
    out = F.regexp_replace(text(c), r"(?ms)^[ \t]*\{%.*?%\}[ \t]*$\n?", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)\{%.*?%\}", ""), r"(?s)\{\{.*?\}\}", SET_AT_DEPLOY)


def environment_of(path: Column, root: str, base: str = DEFAULTS.deploy_base_env) -> Column:
    rel = F.when(path.startswith(root), F.regexp_replace(F.substring(path, len(root) + 1, 1 << 20), "^/+|/+$", "")).otherwise(path)
    return F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(base)


def service_of(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), VALUES_FILE, "")


def glob_root(glob: str) -> str:
    parts = glob.split("/")
    return "/".join(parts[: next((i for i, p in enumerate(parts) if set(p) & set("*?[")), len(parts))])


def flatten_value(value: object, max_keys: int, max_chars: int) -> dict[str, str]:
    """Dotted keys to texts: the first keys in order, values cut."""
    flat: dict[str, str] = {}
    todo = [("", value)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict | list):
            pairs = x.items() if isinstance(x, dict) else enumerate(x)
            todo += [(f"{at}.{k}" if at or isinstance(x, list) else str(k), v) for k, v in pairs]
        else:
            flat[at] = "" if x is None else str(x)[:max_chars]
    return {k: flat[k] for k in sorted(flat)[:max_keys]}


def parse_values(files: DataFrame, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(repo, path, environment, service, config) of values files; config is null where the file doesn't parse to a mapping."""
    own = files.where(F.col("path").rlike(VALUES_FILE)).select("repo", "path", strip_template(F.col("content")).alias("content"))
    keys, chars = settings.deploy_max_keys, settings.deploy_value_chars

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                try:
                    x = yaml.safe_load(t)
                except yaml.YAMLError:
                    x = None
                out.append(list(flatten_value(x, keys, chars).items()) if isinstance(x, dict) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["repo", "path", "config"])

    parsed = own.mapInArrow(parse, "repo string, path string, config map<string,string>")
    return parsed.withColumns({"environment": environment_of(F.col("path"), root, settings.deploy_base_env), "service": service_of(F.col("path"))})
