"""Sinks: NDJSON, per-year Markdown, deterministic gzip JSON, layers, provenance, and Markdown to HTML."""

from __future__ import annotations

import gzip
import html as html_lib
import io
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_markdown, strip, text


def gzip_bytes(data: str) -> bytes:
    """Gzip of a text that depends on the text alone: strongest level, no time, no name."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", compresslevel=9, mtime=0, fileobj=out) as f:
        f.write(data.encode("utf-8"))
    return out.getvalue()


def json_document(rows: DataFrame, key: str, value: str, most: int = 1_000_000) -> str:
    """A small artefact as one JSON object in key order; more than ``most`` rows are an error, as they belong in Parquet."""
    picked = rows.select(F.col(key).alias("k"), F.to_json(F.struct(F.col(value).alias("v"))).alias("v")).orderBy("k").limit(most + 1).collect()
    if len(picked) > most:
        raise ValueError("too large for one JSON document")
    return json.dumps({r["k"]: json.loads(r["v"]).get("v") for r in picked}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def write_ndjson(commits: DataFrame, path: str) -> None:
    """Commits as NDJSON, a folder for each repository."""
    commits.withColumn("repo_part", F.col("repository")).write.mode("overwrite").partitionBy("repo_part").json(path)


def commit_markdown() -> Column:
    """A commit as a Markdown section."""
    ticked = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("binary"))
    head = [
        F.concat(F.lit("## "), F.col("short_sha"), F.lit(": "), escape_markdown(F.col("subject"))),
        F.lit(""),
        F.concat(F.lit("- **Commit:** "), ticked(F.col("sha"))),
        F.concat(F.lit("- **Date:** "), F.col("author_date")),
        F.concat(F.lit("- **Author:** "), escape_markdown(F.col("author.name"))),
        F.concat(F.lit("- **Repository:** "), ticked(F.col("repository"))),
        F.concat(F.lit("- **Parents:** "), F.when(F.size("parents") > 0, F.array_join(F.transform("parents", ticked), ", ")).otherwise("None")),
        F.concat(F.lit("- **Merge commit:** "), F.when(F.col("is_merge"), "Yes").otherwise("No")),
        F.concat(F.lit("- **Files changed:** "), F.col("file_count").cast("string")),
        F.concat(F.lit("- **Lines:** +"), F.col("additions").cast("string"), F.lit(" / -"), F.col("deletions").cast("string")),
    ]
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("- **References:** "), F.array_join(F.transform("refs", lambda r: ticked(escape_markdown(r))), ", ")))
    body = strip(text("body"))
    prose = F.when(body != "", F.concat(F.lit("\n### Commit message\n\n"), body))
    row = lambda f: F.concat(F.lit("| "), ticked(escape_markdown(f["path"])), F.lit(" | "), number(f["additions"]), F.lit(" | "), number(f["deletions"]), F.lit(" |"))
    table = F.when(F.size("files") > 0, F.concat(F.lit("\n### Changed files\n\n| File | Additions | Deletions |\n|---|---:|---:|\n"), F.array_join(F.transform("files", row), "\n")))
    return F.concat_ws("\n", *head, refs, prose, table, F.lit(""), F.lit("---"), F.lit(""))


def write_year_files(commits: DataFrame, path: str) -> None:
    """Markdown of the commits by repository and author year, in date order within a file's part."""
    rows = commits.select(F.col("repository").alias("repo"), F.substring("author_date", 1, 4).alias("year"), "author_date", "sha", commit_markdown().alias("value"))
    rows.repartition("repo", "year").sortWithinPartitions("repo", "year", "author_date", "sha").select("repo", "year", "value").write.mode("overwrite").partitionBy("repo", "year").text(path)


def write_layer(frame: DataFrame, path: str) -> None:
    """Rows of the layers in ``frame`` (column _origin) replace those layers and leave the others."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_origin").parquet(path)


def merged_provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, name, sha, branch, committed, sync_failed): a new record replaces its old one; a failed sync keeps the old one, flagged."""
    o = old.select("scope", "name", F.struct("sha", "branch", "committed").alias("o"))
    both = o.join(new.select("scope", "name", F.struct("sha", "branch", "committed").alias("n"), F.coalesce("sync_failed", F.lit(False)).alias("failed")), ["scope", "name"], "full_outer")
    keep = F.when(F.col("failed") & F.col("o").isNotNull(), F.col("o")).otherwise(F.coalesce("n", "o"))
    return both.select("scope", "name", keep.alias("x"), F.coalesce("failed", F.lit(False)).alias("sync_failed")).select("scope", "name", "x.*", "sync_failed")


def inline_html(s: str, base: str = "", ticket: str = "", repos: Sequence[str] = (), org: str = "") -> str:
    """Escaped text with bold and code marks, and, outside tags, links for ticket ids and repository names."""
    out = html_lib.escape(s, quote=False)
    out = re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", out))
    rules = []
    if base and ticket:
        rules.append((re.compile(ticket), html_lib.escape(base)))
    if org and repos:
        names = "|".join(re.escape(r) for r in sorted(repos, key=lambda r: (-len(r), r)))
        rules.append((re.compile(rf"(?<![A-Za-z0-9/-])({names})(?![A-Za-z0-9-])"), f"https://github.com/{html_lib.escape(org)}/"))
    for pattern, prefix in rules:
        pieces = re.split(r"(<[^>]*>)", out)
        pieces[::2] = [pattern.sub(lambda m, p=prefix: f'<a href="{p}{m[1]}" target="_blank" rel="noopener">{m[1]}</a>', x) for x in pieces[::2]]
        out = "".join(pieces)
    return out


def markdown_html(md: str, **links) -> str:
    """Headings, tables, lists and paragraphs of constrained Markdown."""
    blocks: list[tuple[str, list[str]]] = []
    for raw in md.split("\n"):
        line = raw.strip()
        kind = "" if not line else "h" if line[0] == "#" else "t" if line[0] == "|" else "l" if line.startswith("- ") else "p"
        if kind and kind != "h" and blocks and blocks[-1][0] == kind:
            blocks[-1][1].append(line)
        else:
            blocks.append((kind, [line]))
    out = []
    for kind, lines in blocks:
        if kind == "h":
            level = min(len(lines[0]) - len(lines[0].lstrip("#")), 4) + 1
            out.append(f"<h{level}>{inline_html(lines[0].lstrip('#').strip(), **links)}</h{level}>")
        elif kind == "t":
            rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines]
            shown = [(i, r) for i, r in enumerate(rows) if not all(re.fullmatch(r":?-{3,}:?", c) for c in r)]
            cells = lambda i, r: "".join(f"<{'td' if i else 'th'}>{inline_html(c, **links)}</{'td' if i else 'th'}>" for c in r)
            out.append("<table class='rt'>" + "".join(f"<tr>{cells(i, r)}</tr>" for i, r in shown) + "</table>")
        elif kind == "l":
            out.append("<ul>" + "".join(f"<li>{inline_html(x[2:], **links)}</li>" for x in lines) + "</ul>")
        elif kind == "p":
            out.append(f"<p>{inline_html(' '.join(lines), **links)}</p>")
    return "\n".join(out)


def to_html(docs: DataFrame, col: str, out: str = "html", **links) -> DataFrame:
    """``docs`` with the HTML of a Markdown column, in Arrow batches."""
    kept = [f for f in docs.schema.fields if f.name != out]
    at, names = docs.columns.index(col), [f.name for f in kept]
    places = [docs.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if x is None else markdown_html(x, **links) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), made], names=[*names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def script_json(text_: str) -> str:
    """JSON that may stand inside a script element."""
    return text_.replace("</", "<\\/")
