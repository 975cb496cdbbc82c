"""Clones kept at their remote's default branch, what each was synced to, and histories exported from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rstrip, text
from ..operators.history import exported
from .parsers import parse_git_log
from .sinks import merged_provenance, write_ndjson, write_year_files

PROVENANCE = "scope string, name string, sha string, branch string, committed string, sync_failed boolean"
Runner = Callable[[list[str]], str]


def sync_one(name: str, url: str, branch: str, root: str, runner: Runner, exists: Callable[[str], bool]) -> tuple[str, str, str]:
    """(sha, branch, committed) of a clone below ``root`` brought to its remote's branch; whatever is in the clone besides is dropped."""
    folder = f"{root.rstrip('/')}/{name}"
    if not exists(f"{folder}/.git"):
        runner(["clone", "--origin", "origin", url, folder])
    for step in (["remote", "set-url", "origin", url], ["fetch", "--force", "--prune", "--prune-tags", "--tags", "origin", "+refs/heads/*:refs/remotes/origin/*"], ["show-ref", "--verify", "--quiet", f"refs/remotes/origin/{branch}"], ["checkout", "-B", branch, f"origin/{branch}"], ["reset", "--hard", f"origin/{branch}"], ["clean", "-ffdx"]):
        runner(["-C", folder, *step])
    return runner(["-C", folder, "rev-parse", "HEAD"]).strip(), branch, runner(["-C", folder, "log", "-1", "--format=%cI"]).strip()


def sync(spark: SparkSession, repos: Iterable[tuple[str, str, str, str]], root: str, known: DataFrame, runner: Runner, exists: Callable[[str], bool], keep: Callable[[DataFrame], None] = lambda df: None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(provenance, failures) of the repositories (scope, name, url, branch), one after the other.

    One that fails keeps its record in ``known``, flagged, and costs the others nothing. ``keep`` gets the provenance after
    each, so that a run that ends has recorded what it has done.
    """
    rows: list[tuple] = []
    failures: list[tuple[str, str]] = []
    out = known
    for scope, name, url, branch in repos:
        try:
            rows.append((scope, name, *sync_one(name, url, branch, root, runner, exists), False))
        except (OSError, RuntimeError) as e:
            failures.append((name, str(e)))
            rows.append((scope, name, None, None, None, True))
        out = merged_provenance(known, spark.createDataFrame(rows, PROVENANCE)).where("sha IS NOT NULL")
        keep(out)
    return out, failures


def export_history(logs: DataFrame, path: str) -> DataFrame:
    """Writes the commits of captured logs (repository, repository_url, log) as NDJSON and as Markdown by year below ``path``; returns their counts."""
    commits, _ = parse_git_log(logs)
    write_ndjson(commits, f"{path}/commits")
    write_year_files(commits, f"{path}/history")
    return exported(commits)


def with_note(report: Column, marker: str, note: Column) -> Column:
    """A report with a note behind a marker; what stands from the marker on goes, so that doing it again changes nothing."""
    own = text(report)
    head = F.when(F.instr(own, marker) > 0, F.concat(rstrip(F.substring_index(own, marker, 1)), F.lit("\n"))).otherwise(own)
    return F.concat(head, F.lit(f"\n{marker}\n"), note)


# Fixed value: the flag by which a lock file or a list of requirements names a package index.
INDEX_FLAG = "--index-url"


def declares_index(content: Column) -> Column:
    """Whether a line of a lock file names a package index."""
    return text(content).rlike(rf"(?m)^[ \t]*{INDEX_FLAG}")


def index_url(content: Column) -> Column:
    """The index that a list of requirements names, by its first line that names one; null if none does."""
    return F.nullif(F.regexp_extract(text(content), rf"(?m)^[ \t]*{INDEX_FLAG}[ \t]+(\S.*?)[ \t]*$", 1), F.lit(""))
