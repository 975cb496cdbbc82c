"""Layers that stages add to a graph: features and scenarios, package and module reuse, deployments; and service-to-repository matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_id, text
from .retrieval import bounded

MAX_EVIDENCE = 5
MIN_STEM = 4


def edge(source: Column, target: Column, relation: str, file: Column | None = None) -> list[Column]:
    return [source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), (F.lit(None).cast("string") if file is None else file).alias("source_file")]


def mint_communities(names: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(name, community): ids above the graph's greatest, in order of the names; names are few (areas, environments)."""
    top = nodes.agg(F.coalesce(F.max("community"), F.lit(0)).alias("m")).first()["m"]
    return names.select(name).distinct().withColumn("community", F.dense_rank().over(Window.orderBy(name)).cast("long") + F.lit(top))


def gherkin_layer(features: DataFrame, steps: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of features, scenarios, tickets, and their step definitions' classes in the same repository."""
    areas = mint_communities(features, nodes, "area")
    f = features.join(bounded(areas), "area").withColumn("fid", norm_id(F.concat("repo", F.lit("_"), "path")))
    origin = F.lit("gherkin").alias("_origin")
    own = f.select(F.col("fid").alias("id"), F.col("name").alias("label"), "repo", F.col("path").alias("source_file"), "community", F.lit("feature").alias("kind"), "tickets", origin)
    scen = f.select("fid", "repo", "path", "community", F.posexplode("scenarios").alias("i", "label")).withColumn("sid", F.concat("fid", F.lit("_s"), "i"))
    scenarios = scen.select(F.col("sid").alias("id"), "label", "repo", F.col("path").alias("source_file"), "community", F.lit("scenario").alias("kind"), F.array().cast("array<string>").alias("tickets"), origin)
    tick = f.select("fid", "path", F.explode("tickets").alias("ticket"))
    tickets = tick.select(F.concat(F.lit("ticket_"), norm_id(F.col("ticket"))).alias("id"), F.col("ticket").alias("label")).distinct()
    tickets = tickets.select("id", "label", F.lit("").alias("repo"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("long").alias("community"), F.lit("ticket").alias("kind"), F.array("label").alias("tickets"), origin)
    bound = f.select("fid", "repo", F.explode("steps").alias("step")).join(steps.withColumnRenamed("path", "file"), ["repo", "step"])
    classes = nodes.select(F.col("id").alias("cid"), "repo", F.col("source_file").alias("file"), F.col("label").alias("symbol"))
    code = bound.join(classes, ["repo", "file", "symbol"]).select("fid", "cid", "file").distinct()
    links = scen.select(*edge(F.col("fid"), F.col("sid"), "has_scenario", F.col("path"))).unionByName(tick.select(*edge(F.col("fid"), F.concat(F.lit("ticket_"), norm_id(F.col("ticket"))), "references", F.col("path"))))
    return own.unionByName(scenarios).unionByName(tickets), links.unionByName(code.select(*edge(F.col("fid"), F.col("cid"), "implemented_by", F.col("file"))))


def package_layer(packages: DataFrame, dependencies: DataFrame, imports: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of packages that other repositories depend on: consumers by number, and an edge for each of a consumer's first importing files with a node (``reps``: repo, source_file, id)."""
    uses = dependencies.withColumnRenamed("repo", "consumer").join(packages.withColumnRenamed("repo", "provider"), "package").where("consumer <> provider")
    sites = imports.withColumnRenamed("repo", "consumer").join(uses.select("consumer", "package", "provider").distinct(), ["consumer", "package"])
    count = sites.groupBy("consumer", "package").agg(F.count("*").alias("sites"))
    consumers = uses.join(count, ["consumer", "package"], "left").groupBy("provider", "package").agg(F.array_sort(F.collect_set(F.struct(F.col("consumer").alias("repo"), F.coalesce("sites", F.lit(0).cast("long")).alias("import_sites")))).alias("consumers"))
    pid = F.concat("provider", F.lit("::"), "package")
    nodes = consumers.select(pid.alias("id"), F.col("package").alias("label"), F.col("provider").alias("repo"), F.lit("package").alias("type"), "consumers", F.lit("packages").alias("_origin"))
    known = sites.join(reps.select(F.col("repo").alias("consumer"), F.col("source_file").alias("path"), "id"), ["consumer", "path"])
    first = known.withColumn("rn", F.row_number().over(Window.partitionBy("consumer", "provider", "package").orderBy("path"))).where(F.col("rn") <= MAX_EVIDENCE)
    return nodes, first.select(*edge(F.col("id"), pid, "imports", F.col("path")))


def module_layer(references: DataFrame, estate: DataFrame, repo_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of Terraform modules; a provider outside the estate (name) keeps its node without a repository. ``repo_nodes``: repo, id."""
    provider = references.select("provider").distinct().join(estate.select(F.col("name").alias("provider")).withColumn("in_estate", F.lit(True)), "provider", "left").withColumn("in_estate", F.coalesce("in_estate", F.lit(False)))
    nodes = provider.select(F.concat("provider", F.lit("::module")).alias("id"), F.col("provider").alias("label"), F.when(F.col("in_estate"), F.col("provider")).otherwise("").alias("repo"), "in_estate", F.lit("packages").alias("_origin"))
    uses = references.join(repo_nodes.select(F.col("repo").alias("consumer"), "id"), "consumer")
    files = uses.select("id", "provider", F.explode(F.slice("files", 1, MAX_EVIDENCE)).alias("file"))
    return nodes, files.select(*edge(F.col("id"), F.concat("provider", F.lit("::module")), "uses_module", F.col("file")))


def anchors_under(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, package, id): the least id of a repository's nodes whose file's path begins with the package's folder (``packages``: repo, package, prefix)."""
    own = packages.select("repo", "package", "prefix").distinct()
    found = nodes.where(text("source_file") != "").select("repo", "source_file", "id").join(own, "repo").where(F.col("source_file").startswith(F.col("prefix")))
    return found.groupBy("repo", "package").agg(F.min("id").alias("id"))


def service_stem(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"_values\.ya?ml(\.j2)?$", ""), "-service$", "")), "[^a-z0-9]", "")


def match_services(services: DataFrame, repos: DataFrame) -> DataFrame:
    """(service, repo): a repository with a hyphen-parted segment equal to the service's stem, else one that contains a stem of four letters or more; the shortest, then the first, name wins."""
    s = services.select("service", service_stem(F.col("service")).alias("stem")).where("stem <> ''").distinct()
    r = repos.select("repo").distinct()
    parts = r.select("repo", F.explode(F.array_distinct(F.transform(F.split("repo", "-"), lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]", "")))).alias("stem"))
    exact = s.join(parts, "stem").select("service", "repo")
    rest = s.join(exact.select("service"), "service", "left_anti").where(F.length("stem") >= MIN_STEM)
    # a containing name has the stem's first four letters somewhere: an equality narrows the comparison
    flat = r.select("repo", F.regexp_replace(F.lower("repo"), "[^a-z0-9]", "").alias("flat")).where(F.length("flat") >= MIN_STEM)
    grams = flat.select("repo", "flat", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("flat") - (MIN_STEM - 1)), lambda i: F.substring(F.col("flat"), i, F.lit(MIN_STEM))))).alias("gram"))
    loose = rest.withColumn("gram", F.substring("stem", 1, MIN_STEM)).join(grams, "gram").where(F.col("flat").contains(F.col("stem"))).select("service", "repo")
    return exact.unionByName(loose).groupBy("service").agg(F.min_by("repo", F.struct(F.length("repo"), "repo")).alias("repo"))


def deployment_layer(values: DataFrame, matched: DataFrame, nodes: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): a node for each environment and each service in it, one community an environment, and a link to the service's repository (``anchors``: repo, id)."""
    own = values.where("config IS NOT NULL")
    env = mint_communities(own, nodes, "environment")
    rows = own.join(bounded(env), "environment").withColumn("did", norm_id(F.concat(F.lit("deploy_"), "environment", F.lit("_"), "service")))
    eid = norm_id(F.concat(F.lit("env_"), F.col("environment")))
    origin = F.lit("deployments").alias("_origin")
    environments = env.select(eid.alias("id"), F.col("environment").alias("label"), "community", F.lit("environment").alias("kind"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("map<string,string>").alias("config"), origin)
    out = rows.join(matched.withColumnRenamed("repo", "service_repo"), "service", "left")
    deployed = out.select(F.col("did").alias("id"), F.concat("service", F.lit(" ("), "environment", F.lit(")")).alias("label"), "community", F.lit("deployment").alias("kind"), F.col("service_repo").alias("repo"), "config", origin)
    links = rows.select(*edge(F.col("did"), eid, "deployed_to", F.col("path")))
    code = out.join(anchors.select(F.col("repo").alias("service_repo"), F.col("id").alias("aid")), "service_repo")
    return environments.unionByName(deployed), links.unionByName(code.select(*edge(F.col("did"), F.col("aid"), "configures", F.col("path"))))


def join_rate(values: DataFrame, matched: DataFrame) -> DataFrame:
    s = values.select("service").distinct().join(matched, "service", "left")
    return s.agg(F.count("*").alias("services"), F.count("repo").alias("matched"))


