"""Readers: JSON documents, graphs, NDJSON, clones of repositories, config lists, CSV titles. Absent inputs are empty frames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import COMMIT, LINK, LIST, NODE, L, S, strings, struct


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document, gzipped if its name says so; no rows if it is absent. A document that isn't an object gives one row of nulls."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_graph(spark: SparkSession, path: str, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a node-link document, with their places in it; truncated documents fail."""
    schema = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("links", T.ArrayType(LINK))])
    if required:
        doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        doc = read_json(spark, path, schema)
    nodes = doc.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*").withColumn("kind", F.col("metadata.kind"))
    return nodes, doc.select(F.posexplode("links").alias("pos", "l")).select("pos", "l.*")


class ArrayScanner:
    """Cuts the objects of one named array of a document's top level out of its text, which comes in pieces; holds little more than an object."""

    def __init__(self, key: str):
        self.key, self.rest, self.depth, self.name = key, "", 0, None
        self.state = "outside"  # then "named", "inside", "done"
        self.decoder = json.JSONDecoder()

    def feed(self, piece: str) -> Iterator[str]:
        text = self.rest + piece
        at = self.seek(text) if self.state in ("outside", "named") else 0
        while self.state == "inside":
            at = GAP.match(text, at).end()
            if at >= len(text):
                break
            if text[at] == "]":
                self.state = "done"
                break
            try:
                _, end = self.decoder.raw_decode(text, at)
            except ValueError:  # an object that goes on in the next piece
                break
            if text[at] == "{":
                yield text[at:end]
            at = end
        self.rest = "" if self.state == "done" else text[at:]

    def seek(self, text: str) -> int:
        """Goes on through the top level to the array; where a string is cut, back to its start."""
        at = 0
        while found := TOKEN.search(text, at):
            token = found[0]
            if token == '"':  # no end yet
                return found.start()
            at = found.end()
            if token[0] == '"':
                self.name = token[1:-1] if self.depth == 1 else None
            elif token == "[" and self.depth == 1 and self.state == "named":
                self.state = "inside"
                return at
            elif token in "[{":
                self.depth += 1
            elif token in "]}":
                self.depth -= 1
            self.state = "named" if token == ":" and self.depth == 1 and self.name == self.key else "outside"
        return len(text)


#: Strings, or the start of one without an end, and the signs between them; and what may stand between an array's items.
TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|["\[\]{}:,]', re.DOTALL)
GAP = re.compile(r"[\s,]*")


def read_array(spark: SparkSession, path: str, key: str, item: T.StructType) -> DataFrame:
    """The objects of one named array of a document, with their places, in memory that doesn't grow with the document.

    The text is read in pieces that end at a brace, cut into objects by one task in the order of the file, and parsed by all.
    No rows if the document or the array is absent; a document that ends inside the array is an error.
    """
    try:
        pieces = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_block_start")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], T.StructType([T.StructField("pos", T.IntegerType()), *item.fields]))
        raise
    if not path.endswith(".gz"):  # other files may be read in several parts
        pieces = pieces.withColumn("i", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("file_block_start", "i")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, n, seen = ArrayScanner(key), 0, False
        for b in batches:
            seen = True
            found = list(scanner.feed("".join(x + "}" for x in b.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(found)), pa.int32()), pa.array(found, pa.string())], names=["pos", "json"])
            n += len(found)
        if seen and scanner.state == "inside":
            raise ValueError(f"{path}: the document ends inside its array")

    rows = pieces.select("value").mapInArrow(cut, "pos int, json string")
    return rows.repartition(max(1, spark.sparkContext.defaultParallelism)).select("pos", F.from_json("json", item, {"mode": "FAILFAST"}).alias("x")).select("pos", "x.*")


CHUNK_NODE = struct(**strings("id label file_type source_file"))
CHUNK = struct(nodes=T.ArrayType(CHUNK_NODE), edges=T.ArrayType(struct(**strings("source target relation"))), hyperedges=LIST, input_tokens=L, output_tokens=L)


def read_chunks(spark: SparkSession, folder: str, glob: str = "chunk_*.json") -> tuple[DataFrame, DataFrame]:
    """(chunks, unreadable) of a folder of extracted chunks: chunk (file name) with nodes, edges, hyperedges and tokens; and the names of files that don't parse or have no nodes.

    Plans (``*_plan.json``) are no chunks. A folder without chunks is an error, as merging nothing would look like success.
    """
    schema = T.StructType([*CHUNK.fields, T.StructField("_corrupt_record", S)])
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(folder)
    rows = raw.withColumn("chunk", F.col("_metadata.file_name")).where(~F.col("chunk").endswith("_plan.json"))
    if not rows.select("chunk").limit(1).count():
        raise ValueError(f"{folder}: no chunks")
    good = F.col("nodes").isNotNull() & F.col("_corrupt_record").isNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good).select("chunk")


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.explode("nodes").alias("n")).select("chunk", "n.*")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode("edges").alias("pos", "e")).select("chunk", "pos", "e.*")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit NDJSON with each record's place: splittable, explicit schema."""
    return spark.read.schema(COMMIT).json(path).withColumn("pos", F.monotonically_increasing_id())


def read_files(spark: SparkSession, root: str, suffixes: Sequence[str], skip: Sequence[str] = ("node_modules", ".terraform")) -> DataFrame:
    """(repo, path, content) of the files below ``root``/<repo>/ with one of the suffixes, outside the directories to skip."""
    glob = "*{" + ",".join(suffixes) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("/")[-1]
    rel = F.element_at(F.split("path", rf"/\Q{base}\E/", 2), 2)
    parts = F.split(rel, "/", 2)
    out = raw.select(F.element_at(parts, 1).alias("repo"), F.element_at(parts, 2).alias("path"), F.decode("content", "utf-8").alias("content"))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))) if skip else out


def pipe_rows(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A config list of ``a | b | c`` lines; comments and blank lines aside, a line without all its fields is an error that names it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("f", F.transform(F.split("value", r"\|"), lambda x: F.trim(x)))
    bad = rows.where((F.size("f") != len(names)) | F.exists("f", lambda x: x == "")).orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0]['line'] + 1}: {len(names)} fields expected")
    return rows.select("line", *[F.element_at("f", i + 1).alias(n) for i, n in enumerate(names)])


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    rows = pipe_rows(spark, path, ("slug", "title", "words"))
    words = F.filter(F.transform(F.split("words", ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    return rows.select(F.col("line").alias("pos"), "slug", "title", words.alias("keywords"))


RULE_KINDS = ("prefix", "match", "repo", "team", "fetch", "exclude")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """(line, kind, value) of repository filters; unknown kinds, an all-wildcard match, a repository both named and fetched, or no including rule are errors."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select("line", F.regexp_extract("value", r"^\s*(\S+)", 1).alias("kind"), F.trim(F.regexp_extract("value", r"^\s*\S+\s*(.*)$", 1)).alias("value"))
    found = [tuple(r) for r in rows.orderBy("line").collect()]  # a hand-written list
    for line, kind, value in found:
        if kind not in RULE_KINDS or not value:
            raise ValueError(f"{path}, line {line + 1}: unknown rule")
        if kind == "match" and not value.strip("*?"):
            raise ValueError(f"{path}, line {line + 1}: the pattern matches everything")
    both = {v for _, k, v in found if k == "repo"} & {v for _, k, v in found if k == "fetch"}
    if both or not any(k != "exclude" for _, k, _ in found):
        raise ValueError(f"{path}: " + (f"named and fetched: {sorted(both)}" if both else "no rule includes anything"))
    return rows


def read_titles(spark: SparkSession, path: str, key_names: Sequence[str] = ("issue key", "key"), title_names: Sequence[str] = ("summary", "title")) -> DataFrame:
    """(pos, ticket, title) of a CSV export whose columns are found by name, in any case; the first that fits wins."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    by_name = {c.lstrip("\ufeff").strip().lower(): c for c in reversed(df.columns)}
    picked = [next((by_name[n] for n in names if n in by_name), None) for names in (key_names, title_names)]
    if None in picked:
        raise ValueError(f"{path}: no ticket or no title column")
    out = df.select(F.monotonically_increasing_id().alias("pos"), F.trim(F.col(f"`{picked[0]}`")).alias("ticket"), F.trim(F.col(f"`{picked[1]}`")).alias("title"))
    return out.where("ticket <> '' AND title <> ''")


def json_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, block_id, json) of the embedded JSON script blocks of built pages."""
    pairs = F.regexp_extract_all(html, F.lit(r'(?s)(<script[^>]*type="application/json"[^>]*>.*?</script>)'), F.lit(1))
    blocks = pages.select(*[c for c in pages.columns if c != html], F.explode(pairs).alias("_b"))
    return blocks.withColumns({"block_id": F.regexp_extract("_b", r'id="([^"]*)"', 1), "json": F.regexp_extract("_b", r"(?s)^<script[^>]*>(.*)</script>$", 1)}).drop("_b")
