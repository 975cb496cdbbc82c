"""Small documents and answer parts, made from aggregated frames; nothing here reads a whole table to the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_words, escape_markdown, text
from ..operators.history import authors, commits_by_year
from ..sources.sinks import script_json

#: Rows of a small document at most.
MOST = 100_000


def at_most(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df``, which goes into a small document; more rows than that are an error, never left out."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} {what}: too many for one document")
    return df


def synced_cell() -> Column:
    """Day and short sha of a provenance record, or a dash."""
    return F.when(text("sha") == "", "—").otherwise(F.concat(F.substring(text("committed"), 1, 10), F.lit(" (`"), F.substring("sha", 1, 8), F.lit("`)")))


def manifest(commits: DataFrame, provenance: DataFrame) -> list[str]:
    """Markdown rows of the repositories: commits, state when synced, source."""
    counts = commits.groupBy(F.col("repository").alias("name")).agg(F.count("*").alias("n"), F.min_by("repository_url", "pos").alias("url"))
    rows = counts.join(provenance.select("name", "sha", "committed"), "name", "left")
    line = F.concat(F.lit("| `"), "name", F.lit("` | "), F.col("n").cast("string"), F.lit(" | "), synced_cell(), F.lit(" | `"), F.coalesce("url", F.lit("Unknown")), F.lit("` |"))
    body = [r["line"] for r in at_most(rows.select("name", line.alias("line")), MOST, "repositories").orderBy("name").collect()]
    return ["# Repositories", "", "| Repository | Commits | Synced | Source |", "|---|---:|---|---|", *body, "", f"These {len(body)} repositories were read, and no others: what is missing here was never looked at."]


def repository_index(commits: DataFrame, repository: str) -> list[str]:
    """Markdown of one repository's history: commits by year, newest first, and its most frequent authors."""
    own = commits.where(F.col("repository") == repository)
    years = at_most(commits_by_year(own), MOST, "years").orderBy(F.desc("year")).collect()
    top = authors(own).orderBy("rank").select(escape_markdown(F.col("author")).alias("author"), "n").collect()
    out = [f"# {repository}", "", "| Year | Commits |", "|---:|---:|", *(f"| {r['year']} | {r['n']} |" for r in years)]
    return [*out, "", "| Author | Commits |", "|---|---:|", *(f"| {r['author']} | {r['n']} |" for r in top)]


def page(title: str, blocks: dict[str, DataFrame], most: int = MOST) -> str:
    """A self-contained page that holds each frame as a JSON block; frames are bounded, and larger ones an error."""
    parts = []
    for name, df in blocks.items():
        rows = df.limit(most + 1).toJSON().collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows")
        parts.append(f'<script type="application/json" id="{name}">[{script_json(",".join(rows))}]</script>')
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body>{''.join(parts)}</body></html>"


def summaries_for(entries: DataFrame, summaries: DataFrame, order: str, most: int) -> DataFrame:
    """The first communities, by where their first entry stands, that have prose."""
    first = entries.where("community IS NOT NULL AND community >= 0").groupBy("community").agg(F.min(order).alias("first"))
    return first.join(summaries, "community").orderBy("first").limit(most)


def feature_cards(entries: DataFrame, most: int) -> DataFrame:
    return entries.where("kind = 'feature'").orderBy(F.desc("degree"), "eid").limit(most)


def comment_rows(terms: Sequence[str], comments: str = "comments", chars: int = 400) -> Column:
    """Up to three comments with a term, else the first; without terms the first two; each clipped."""
    own = F.coalesce(F.col(comments), F.array().cast("array<string>"))
    clip = lambda x: clip_words(x, chars)
    if not terms:
        return F.transform(F.slice(own, 1, 2), clip)

    def has(x: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.lower(x).contains(t)
        return out

    hit = F.slice(F.filter(own, has), 1, 3)
    return F.transform(F.when(F.size(hit) > 0, hit).otherwise(F.slice(own, 1, 1)), clip)


def matching_evidence(values: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Values (ticket, field, value) that carry a term of over one letter, and the first term they carry."""
    hit = F.lit(None).cast("string")
    for t in reversed([t for t in terms if len(t) > 1]):
        hit = F.when(F.lower("value").contains(t), t).otherwise(hit)
    return values.withColumn("term", hit).where("term IS NOT NULL")


def other_subjects(c: Column, shown: Column) -> Column:
    """Subjects that say something the shown text doesn't: neither contains the other, letters and digits compared."""
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.filter(c, lambda s: ~bare(shown).contains(bare(s)) & ~bare(s).contains(bare(shown)))


def ticket_detail(tracker_title: Column, csv_title: Column, mined: Column) -> Column:
    """What a ticket is called: by the tracker, else the list of titles, else its first mined description."""
    blank = F.lit("")
    return F.coalesce(F.nullif(tracker_title, blank), F.nullif(csv_title, blank), F.get(mined, F.lit(0)))


def baseline(answers: DataFrame) -> str:
    """The accepted modes of each question (question, met), as one deterministic JSON text."""
    rows = at_most(answers.select("question", F.array_sort("met").alias("met")), MOST, "questions").orderBy("question").collect()
    return json.dumps({r["question"]: r["met"] for r in rows}, sort_keys=True, indent=1)


def lost_answers(before: DataFrame, now: DataFrame) -> DataFrame:
    """Questions (question, met) of the baseline that are met no longer, or by other modes."""
    joined = before.select("question", F.array_sort("met").alias("old")).join(now.select("question", F.array_sort("met").alias("new")), "question", "left")
    state = F.when(F.col("new").isNull() | (F.size("new") == 0), "lost").when(F.col("old") != F.col("new"), "moved")
    return joined.withColumn("state", state).where("state IS NOT NULL")


def read_questions(lines: DataFrame) -> DataFrame:
    """(line, question, accept) of `question | mode[,mode]` lines (line, value); an empty set is an error."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    out = rows.select("line", F.trim(F.regexp_extract("value", r"^(.*)\|[^|]*$", 1)).alias("question"), F.transform(F.split(F.regexp_extract("value", r"\|([^|]*)$", 1), ","), lambda m: F.trim(m)).alias("accept"))
    if not out.limit(1).count():
        raise ValueError("no question to ask")
    return out
