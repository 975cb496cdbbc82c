"""Entity resolution of nodes and edges that chunks extracted apart from each other.

``chunk_nodes``: chunk, id, label, file_type, source_file. ``chunk_edges``: chunk, pos, source, target, relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spec_stem, strip, text

# Labels too common to name one thing.
GENERIC_LABELS = (
    "kustomization", "helmrelease", "helmrepository", "namespace", "configmap", "secret", "deployment", "service", "ingress", "serviceaccount", "role", "rolebinding",
    "clusterrole", "clusterrolebinding", "networkpolicy", "gitrepository", "provider", "variable", "output", "module", "resource", "data",
)
MIN_GLOBAL = 8
CHUNK_SUFFIX = r"_(c|chunk)\d{2,}(_\d+)?$"


def is_global_identifier(label: Column) -> Column:
    """Whether a label names one thing wherever it stands: long, without white space, not generic, and with a sign of an address."""
    t = strip(text(label))
    return (F.length(t) >= MIN_GLOBAL) & ~t.rlike(r"(?U)\s") & ~F.lower(t).isin(*GENERIC_LABELS) & t.rlike("[/:@]")


def merge_nodes(chunk_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, remap): one node for each (id, label, file_type); an id with several labels is prefixed with its file's stem.

    ``nodes``: final_id, original_id (null unless renamed), label, file_type, source_files. ``remap``: chunk, id, final_id.
    Two identities that end with one final id are an error, as either would hide the other.
    """
    rows = chunk_nodes.where("coalesce(id, '') <> ''").select("chunk", "id", text("label").alias("label"), text("file_type").alias("file_type"), F.nullif(text("source_file"), F.lit("")).alias("source_file"))
    one = rows.groupBy("id", "label", "file_type").agg(F.array_sort(F.collect_set("source_file")).alias("source_files"), F.count("*").alias("seen"))
    clash = rows.groupBy("id").agg(F.count_distinct("label").alias("n_labels"))
    stem = spec_stem(F.coalesce(F.get("source_files", F.lit(0)), F.col("label")))
    renamed = F.when(F.col("n_labels") > 1, F.when(stem != "", F.concat(stem, F.lit("_"), F.col("id"))).otherwise(F.col("id"))).otherwise(F.col("id"))
    nodes = one.join(clash, "id").withColumn("final_id", renamed).withColumn("original_id", F.when(F.col("n_labels") > 1, F.col("id")))
    remap = rows.join(nodes.select("id", "label", "file_type", "final_id"), ["id", "label", "file_type"]).groupBy("chunk", "id").agg(F.max_by("final_id", F.struct("label", "file_type")).alias("final_id"))
    return nodes.select("final_id", "original_id", "label", "file_type", "source_files", "seen"), remap


def overwritten(nodes: DataFrame) -> DataFrame:
    """Final ids that several identities claim; must be empty."""
    return nodes.groupBy("final_id").agg(F.count("*").alias("n")).where("n > 1")


def consolidate(nodes: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, remap, counts) with the ids of one global identifier folded into the least; other repeated labels are left and counted."""
    by_label = nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("final_id").alias("keep"), F.array_sort(F.collect_set("final_id")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("all_files"))
    many = by_label.where("n > 1")
    folded = many.where(is_global_identifier(F.col("label")))
    counts = many.agg(
        F.coalesce(F.sum(F.when(is_global_identifier(F.col("label")), F.col("n") - 1)), F.lit(0)).alias("consolidated"), F.coalesce(F.sum(F.when(~is_global_identifier(F.col("label")), 1)), F.lit(0)).alias("fragmented_left")
    )
    moves = folded.select(F.explode("ids").alias("final_id"), "keep")
    kept = nodes.join(folded.select("label", "keep", "ids", "all_files"), "label", "left").where("keep IS NULL OR final_id = keep")
    kept = kept.withColumn("source_files", F.coalesce("all_files", "source_files")).withColumn("consolidated_ids", F.when(F.col("keep").isNotNull(), F.array_except("ids", F.array("keep"))))
    moved = remap.join(moves, "final_id", "left").select("chunk", "id", F.coalesce("keep", "final_id").alias("final_id"))
    return kept.drop("keep", "ids", "all_files"), moved, counts


def resolve_edges(chunk_edges: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): ends by their own chunk's remap, else by an id that is unambiguous anywhere; the first of equal edges stays. Counts are of ends."""
    anywhere = remap.groupBy("id").agg(F.count_distinct("final_id").alias("n"), F.min("final_id").alias("only"))
    out = chunk_edges.withColumns({"relation": text("relation"), "source": text("source"), "target": text("target")})
    for end in ("source", "target"):
        own = remap.select("chunk", F.col("id").alias(end), F.col("final_id").alias("_own"))
        wide = anywhere.select(F.col("id").alias(end), "n", "only")
        out = out.join(own, ["chunk", end], "left").join(wide, end, "left")
        state = F.when(F.col("_own").isNotNull(), "own").when(F.col("n") == 1, "recovered").when(F.col("n") > 1, "ambiguous").otherwise("dangling")
        out = out.withColumns({f"{end}_state": state, f"{end}_id": F.coalesce("_own", F.when(F.col("n") == 1, F.col("only")))}).drop("_own", "n", "only")
    resolved = out.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    first = Window.partitionBy("source_id", "target_id", "relation").orderBy("chunk", "pos")
    numbered = resolved.withColumn("rn", F.row_number().over(first))
    edges = numbered.where("rn = 1").select("chunk", "pos", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation")
    ends = out.select(F.explode(F.array("source_state", "target_state")).alias("state")).where("state <> 'own'").groupBy("state").agg(F.count("*").alias("n"))
    duplicates = numbered.where("rn > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("state"), "n")
    return edges, ends.unionByName(duplicates)


def token_totals(chunks: DataFrame) -> DataFrame:
    """Tokens that all chunks took and gave; absent numbers count as none."""
    return chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])


def suffix_breaches(nodes: DataFrame) -> DataFrame:
    """Ids with a suffix that a chunk left."""
    return nodes.where(F.col("final_id").rlike(CHUNK_SUFFIX)).select("final_id")
