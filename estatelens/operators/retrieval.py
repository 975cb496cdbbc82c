"""Retrieval: search, node ranking, BM25 ticket evidence, topic and dive matching, routing, absence, and whole answers.

``entries``: eid (rank order), label, label_lower, source_lower, repo, kind, degree, community, tickets, hay (all searchable text, lower case).
Terms of a question are few and bounded, so per-term work is a fixed set of columns in one pass over the entries, and document
frequencies of all terms come from one aggregation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_all, occurrences, stem, text, tokens
from ..settings import DEFAULTS, STOP_WORDS, Settings
from .graph import bfs

STOP = frozenset(STOP_WORDS.split())
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
K1, B, DECISIVE = 1.2, 0.75, 0.9
MAX_MATCHES, SHOWN, MAX_EVIDENCE, BOOST = 400, 100, 3, 40
# The question shapes, in the order they are tried.
ROUTES = (
    ("journey", r"\bjourney\b|\bscreens?\b|\bsteps\b|walk me|how (do|does|would) (a |an |the )?(user|adviser|prosecutor|clerk|legal)"),
    ("which_repos", r"\b(which|what|how many)\b[^?]*\b(repo|repositor|app|application|service)"),
    ("where_used", r"\b(where|who|what)\b[^?]*\b(use|uses|used|consume|consumes|depend|depends|reference|references|call|calls)\b"),
    ("impact", r"\b(impact|impacted|affect|affected|break|breaks|blast|changing|changed?)\b"),
    ("why", r"\bwhy\b|\bintent\b|\bpurpose\b|\brationale\b|\bbusiness reason\b"),
)


def stem_word(w: str) -> str:
    return re.sub("e?s$", "", re.sub("ies$", "y", w)) if len(w) > 4 else w


def query_terms(question: str) -> list[str]:
    """The question's words without stop words and single characters, unless nothing else is left; stemmed, each once."""
    words = re.findall("[a-z0-9]+", question.lower())
    content = [w for w in words if w not in STOP and len(w) > 1]
    return list(dict.fromkeys(map(stem_word, content or words)))


def terms_of(question: Column) -> Column:
    """``query_terms`` as an expression."""
    words = tokens(question)
    content = F.filter(words, lambda w: ~w.isin(*STOP) & (F.length(w) > 1))
    return F.array_distinct(F.transform(F.when(F.size(content) > 0, content).otherwise(words), stem))


def expand_terms(terms: Sequence[str], neighbours: DataFrame) -> list[tuple[str, float]]:
    """Up to three neighbours (token, other, score, rank) for each term, first come, with their discounted weight."""
    rows = neighbours.where(F.col("token").isin(*terms) & (F.col("rank") <= 3)).collect() if terms else []
    seen, out = set(terms), []
    for r in sorted(rows, key=lambda r: (list(terms).index(r["token"]), r["rank"])):
        if r["other"] not in seen:
            seen.add(r["other"])
            out.append((r["other"], max(0.1, r["score"] - 0.35)))
    return out


def searchable(nodes: DataFrame) -> DataFrame:
    """The derived columns that search reads, made once."""
    parts = [text("label"), text("repo"), text("source_file")]
    return nodes.withColumns({"label_lower": F.lower(text("label")), "source_lower": F.lower(text("source_file")), "hay": F.lower(F.concat_ws(" ", *parts))})


def search_score(terms: Sequence[str]) -> Column:
    """3 for a label that equals the query, 2 for one that a term begins, 1 for one that has all terms."""
    label = F.col("label_lower")
    begins = F.lit(False)
    for t in terms:
        begins = begins | label.startswith(t)
    return F.when(label == " ".join(terms), 3).otherwise(0) + F.when(begins, 2).otherwise(0) + F.when(contains_all(label, list(terms)), 1).otherwise(0)


def search(entries: DataFrame, query: str, repo: str | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """The first matches in rank order, scored, best first: what the search box shows."""
    terms = query.lower().split()
    found = entries.where(contains_all(F.col("hay"), terms))
    found = found if repo is None else found.where(F.col("repo") == repo)
    found = found if kinds is None else found.where(F.col("kind").isin(*kinds))
    return found.orderBy("eid").limit(MAX_MATCHES).withColumn("score", search_score(terms)).orderBy(F.desc("score"), "eid").limit(SHOWN)


def label_weights(entries: DataFrame, terms: Sequence[str]) -> dict[str, float]:
    """Each term's ln(1 + N / (1 + labels that have it)); one pass for all terms."""
    if not terms:
        return {}
    r = entries.agg(F.count("*").alias("n"), *[F.sum(F.col("label_lower").contains(t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return {t: math.log(1 + r["n"] / (1 + (r[f"t{i}"] or 0))) or 1.0 for i, t in enumerate(terms)}


def rank_nodes(entries: DataFrame, terms: Sequence[str], expansions: Sequence[tuple[str, float]] = (), weights: Mapping[str, float] | None = None) -> DataFrame:
    """Entries with a positive score: whole-query bonus, exact and prefix tiers scaled by squared coverage, substring, source and neighbour bonuses."""
    w = weights or label_weights(entries, [*terms, *(t for t, _ in expansions)])
    norm = F.col("label_lower")
    bare = F.regexp_replace(norm, r"\(\)$", "")
    joined, words = " ".join(terms), F.array_join(tokens(norm), " ")
    zero = F.lit(0.0)
    bonus = zero
    if len(terms) > 1:
        top = max(1.0, *(w[t] for t in terms))
        whole = (norm == joined) | (bare == joined) | (words == joined)
        bonus = F.when(whole, EXACT * 10 * top).when(norm.startswith(joined) | words.startswith(joined), PREFIX * 10 * top).otherwise(0.0)
    matched, tiered, flat = F.lit(0), zero, zero
    for t in terms:
        exact, begins, within = (norm == t) | (bare == t), norm.startswith(t) | bare.startswith(t), norm.contains(t)
        tiered = tiered + F.when(exact, EXACT * w[t]).when(begins, PREFIX * w[t]).otherwise(0.0)
        flat = flat + F.when(~exact & ~begins & within, SUBSTRING * w[t]).otherwise(0.0) + F.when(F.col("source_lower").contains(t), SOURCE * w[t]).otherwise(0.0)
        matched = matched + F.when(exact | begins | within, 1).otherwise(0)
    inferred = zero
    for t, x in expansions:
        inferred = inferred + F.when((norm == t) | (bare == t) | norm.startswith(t), SUBSTRING * w[t] * x).when(norm.contains(t), SOURCE * w[t] * x).otherwise(0.0)
    cover = matched / F.lit(max(1, len(terms)))
    return entries.withColumn("score", bonus + tiered * cover * cover + flat + inferred).where("score > 0")


def summary_hits(summaries: DataFrame, terms: Sequence[str], expansions: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """(community, hits) of the summaries that speak of the question: two for a term, one for a neighbour, three at least."""
    prose = F.lower("text")
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.when(prose.contains(t), 2).otherwise(0)
    for t, _ in expansions:
        hits = hits + F.when(prose.contains(t), 1).otherwise(0)
    return summaries.select("community", hits.alias("hits")).where("hits >= 3")


def boost(ranked: DataFrame, entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Ranked entries with 40 for each hit of their community's summary. A community that isn't ranked enters with its first entry, at 40 a hit, and is then boosted like the others."""
    absent = hits.join(ranked.select("community").distinct(), "community", "left_anti")
    first = entries.groupBy("community").agg(F.min("eid").alias("eid"))
    injected = entries.join(absent.join(first, "community").select("eid", "hits"), "eid").withColumn("score", F.col("hits") * float(BOOST)).drop("hits")
    both = ranked.unionByName(injected.select(*ranked.columns))
    return both.join(hits, "community", "left").withColumn("score", F.col("score") + F.coalesce("hits", F.lit(0)) * float(BOOST)).drop("hits")


def pick_seeds(ranked: DataFrame, terms: Sequence[str]) -> list[int]:
    """The ten best entries, then for each term that they miss its best; fourteen at most. At most ten and one row a term reach the driver."""
    order = (F.desc("score"), "eid")
    best = ranked.select("eid", "score", "label_lower").orderBy(*order)
    picked = [(r["eid"], r["label_lower"]) for r in best.limit(10).collect()]
    missing = [t for t in terms if not any(t in x for _, x in picked)]
    for t in missing:
        if not any(t in x for _, x in picked):
            hit = best.where(F.col("label_lower").contains(t)).limit(1).collect()
            if hit and hit[0]["eid"] not in {e for e, _ in picked}:
                picked.append((hit[0]["eid"], hit[0]["label_lower"]))
    return [e for e, _ in picked][:14]


def bm25(corpus: DataFrame, terms: Sequence[str], k: int | None = MAX_EVIDENCE, id_col: str = "id", hay: str = "hay") -> DataFrame:
    """(id, weight, hits) of the texts that hold a decisive term, best first.

    A term is decisive if its weight is at least nine tenths of the greatest that any term of over one character has, of
    those that the corpus holds. Statistics of all terms are one aggregation; scoring is a second pass without a shuffle.
    """
    text_ = F.col(hay)
    stats = corpus.agg(F.count("*").alias("n"), F.avg(F.length(text_)).alias("mean"), *[F.sum(text_.contains(t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    df = {t: stats[f"t{i}"] or 0 for i, t in enumerate(terms)}
    w = {t: math.log(1 + stats["n"] / (1 + df[t])) for t in terms}
    bar = DECISIVE * max([0.0, *(w[t] for t in terms if df[t] and len(t) > 1)])
    counts = {t: F.col(f"_h{i}") for i, t in enumerate(terms)}
    rows = corpus.select(F.col(id_col).alias("id"), F.length(text_).alias("_len"), *[occurrences(text_, t).alias(f"_h{i}") for i, t in enumerate(terms)])
    norm = K1 * (1 - B + B * (F.col("_len") / (stats["mean"] or 1.0)))
    weight, hits, decisive = F.lit(0.0), F.lit(0).cast("long"), F.lit(False)
    for t, n in counts.items():
        weight = weight + F.when(n > 0, w[t] * (n * (K1 + 1)) / (n + norm)).otherwise(0.0)
        hits = hits + n
        if len(t) > 1 and w[t] >= bar:
            decisive = decisive | (n > 0)
    out = rows.where(decisive).select("id", weight.alias("weight"), hits.alias("hits")).orderBy(F.desc("weight"), F.desc("hits"), "id")
    return out if k is None else out.limit(k)


def unevidenced(terms: Sequence[str], *corpora: tuple[DataFrame, str]) -> list[str]:
    """The terms that no text of any corpus (frame, column) has."""
    missing = list(terms)
    for df, col in corpora:
        if missing:
            r = df.agg(*[F.max(F.col(col).contains(t).cast("int")).alias(f"t{i}") for i, t in enumerate(missing)]).first()
            missing = [t for i, t in enumerate(missing) if not r[f"t{i}"]]
    return missing


def route(question: Column) -> Column:
    """The view that a question asks for."""
    out = F
    q = F.lower(question)
    for name, pattern in ROUTES:
        out = out.when(q.rlike(pattern), name)
    return out.otherwise("cluster")


def match_topics(questions: DataFrame, topics: DataFrame, expansions: Sequence[str] = (), question: str = "text", key: str = "qid") -> DataFrame:
    """Each question's topic: two for a keyword it has, one for a keyword that is a neighbour, at least one direct hit; the first topic wins ties.

    ``topics`` (pos, slug, keywords) are few by nature: a keyword table of at most ``MAX_TOPIC_ROWS`` rows is broadcast.
    """
    flat = topics.select("pos", "slug", F.explode("keywords").alias("k"))
    hit = F.lower(F.col(question)).contains(F.col("k"))
    near = F.col("k").isin(*expansions) if expansions else F.lit(False)
    scored = questions.select(key, question).join(bounded(flat), hit | near)
    per = scored.groupBy(key, "pos", "slug").agg(F.sum(F.when(hit, 2).otherwise(1)).alias("score"), F.sum(hit.cast("int")).alias("direct")).where("direct > 0")
    return per.groupBy(key).agg(F.max_by(F.struct("slug", "score"), F.struct("score", (-F.col("pos")).alias("p"))).alias("x")).select(key, "x.slug", "x.score")


MAX_TOPIC_ROWS = 50_000


def bounded(df: DataFrame, rows: int = MAX_TOPIC_ROWS) -> DataFrame:
    """``df`` marked for broadcast, once it is known to have at most so many rows; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def match_dive(question: str, repos: DataFrame, repo: str = "repo") -> str | None:
    """The longest repository name that the question mentions."""
    r = repos.where((F.col(repo) != "") & F.lit(question.lower()).contains(F.lower(repo))).orderBy(F.desc(F.length(repo)), repo).limit(1).collect()
    return r[0][repo] if r else None


def why_seed(entries: DataFrame, label: str) -> DataFrame:
    """Of the entries of a label the richest: tickets, then degree, then rank."""
    return entries.where(F.col("label_lower") == label.lower()).orderBy(F.desc(F.size("tickets")), F.desc("degree"), "eid").limit(1)


def weighted_tickets(reached: DataFrame, entries: DataFrame) -> DataFrame:
    """Tickets of the reached entries (eid, dist), each worth two less the distance."""
    return reached.join(entries.select("eid", "tickets"), "eid").select(F.explode("tickets").alias("ticket"), (2 - F.col("dist")).alias("w")).groupBy("ticket").agg(F.sum("w").alias("weight"))


def grouped(reached: DataFrame, entries: DataFrame, by: str, k: int = 8) -> DataFrame:
    """The groups (communities or repositories) with the most reached entries."""
    return reached.join(entries.select("eid", by), "eid").groupBy(by).agg(F.count("*").alias("n"), F.min("eid").alias("first")).orderBy(F.desc("n"), "first").limit(k)


def where_used(edges: DataFrame, entries: DataFrame, eids: Sequence[int]) -> DataFrame:
    """The direct neighbours of some entries, by repository."""
    near = edges.where(F.col("node").isin(*eids)).select(F.col("other").alias("eid")).distinct().where(~F.col("eid").isin(*eids))
    return near.join(entries.select("eid", "repo", "label"), "eid").groupBy("repo").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"))


def entries_with_ticket(entries: DataFrame, ticket: str) -> DataFrame:
    return entries.where(F.array_contains("tickets", ticket)).orderBy("eid")


@dataclass
class Answer:
    """What a question is answered with; frames are small and lazily read."""

    question: str
    view: str
    terms: list[str] = field(default_factory=list)
    expansions: list[tuple[str, float]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    seeds: list[int] = field(default_factory=list)
    topic: str | None = None
    dive: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)


def ask(question: str, entries: DataFrame, edges: DataFrame, tickets: DataFrame, *, neighbours: DataFrame | None = None, summaries: DataFrame | None = None, topics: DataFrame | None = None, dives: DataFrame | None = None, settings: Settings = DEFAULTS) -> Answer:
    """A question's answer: a ticket by its id; else absence if the estate has none of its words; else the routed view with ticket evidence.

    ``edges`` are symmetric (node, other) over eid; ``tickets`` has id and hay.
    """
    named = re.search(settings.ticket_pattern, question)
    if named:
        rows = tickets.where(F.col("id") == named[1])
        return Answer(question, "ticket", frames={"ticket": rows, "entries": entries_with_ticket(entries, named[1])})
    terms = query_terms(question)
    out = Answer(question, "none", terms)
    if not terms:
        return out
    out.expansions = expand_terms(terms, neighbours) if neighbours is not None else []
    ranked = rank_nodes(entries, terms, out.expansions)
    if summaries is not None:
        ranked = boost(ranked, entries, summary_hits(summaries, terms, out.expansions))
    spark = entries.sparkSession
    if topics is not None:
        best = match_topics(spark.createDataFrame([(0, question)], "qid int, text string"), topics, [t for t, _ in out.expansions]).collect()
        out.topic = best[0]["slug"] if best else None
    out.dive = match_dive(question, dives) if dives is not None else None
    out.missing = [] if out.topic or out.dive else unevidenced(terms, (entries, "hay"), (tickets, "hay"))
    if len(out.missing) == len(terms):
        out.view = "abstain"
        return out
    out.seeds = pick_seeds(ranked, terms)
    shape = next((name for name, p in ROUTES if re.search(p, question.lower())), "cluster")
    out.view = shape
    seeds = spark.createDataFrame([(e,) for e in out.seeds], "node long")
    top = entries.where(F.col("eid").isin(*out.seeds))
    if shape == "which_repos":
        out.frames["repos"] = entries.join(top.select("label_lower").distinct(), "label_lower").groupBy("label_lower").agg(F.array_sort(F.collect_set("repo")).alias("repos"))
    elif shape == "where_used":
        out.frames["used_by"] = where_used(edges, entries, out.seeds[:1])
    else:
        cap = {"impact": 2000, "why": 1200}.get(shape, 900)
        start = seeds
        if shape in ("impact", "why"):  # from the richest entry of the best label
            label = entries.where(F.col("eid") == out.seeds[0]).select("label_lower").first()["label_lower"]
            start = why_seed(entries, label).select(F.col("eid").alias("node"))
        reached = bfs(edges, start, 2, cap).withColumnRenamed("node", "eid")
        out.frames |= {"reached": reached, "communities": grouped(reached, entries, "community"), "repos": grouped(reached, entries, "repo"), "tickets": weighted_tickets(reached, entries)}
        if shape == "journey":
            features = ranked.where("kind = 'feature'").orderBy(F.desc("score"), "eid").limit(6)
            steps = edges.join(features.select(F.col("eid").alias("node")), "node").select(F.col("other").alias("eid"), F.col("node").alias("feature"))
            out.frames["scenarios"] = steps.join(entries.select("eid", "label", "kind"), "eid").where("kind = 'scenario'")
            if not features.limit(1).count():  # no features: the evidence is shown as a cluster
                out.view = "cluster"
                del out.frames["scenarios"]
    out.frames["evidence"] = bm25(tickets, terms)
    return out


def mode_of(answer: Answer) -> list[str]:
    """The modes that an answer satisfies, as a question set names them."""
    out = [m for m, on in (("brief", answer.topic), ("dive", answer.dive)) if on]
    if answer.view == "ticket":
        return [*out, "ticket"] if answer.frames["ticket"].limit(1).count() and answer.frames["entries"].limit(1).count() else [*out, "abstain"]
    if answer.view in ("abstain", "none"):
        return [*out, "abstain"]
    if answer.frames.get("evidence") is not None and answer.frames["evidence"].limit(1).count():
        out.append("tickets")
    return [*out, "graph"] if answer.seeds else out


def gate(questions: DataFrame) -> DataFrame:
    """By accepted mode, questions that declare it and those that an answer of theirs meets it (columns accept, met: arrays); a mode with none met fails."""
    rows = questions.select(F.explode("accept").alias("mode"), F.arrays_overlap("accept", "met").alias("ok"))
    return rows.groupBy("mode").agg(F.count("*").alias("declared"), F.sum(F.col("ok").cast("int")).cast("long").alias("passed")).withColumn("floor_broken", F.col("passed") == 0)
