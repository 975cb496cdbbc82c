"""Text rules as Column expressions.

``\\s``, ``\\w`` and ``\\b`` follow Unicode in the rules below, hence ``(?U)``; tokens for search are ASCII on purpose.
Absent text counts as empty throughout.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, TICKET_PATTERN

#: Line ends as the source data knows them: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
PLACEHOLDER = "¤"
# Shapes of commit text.
TRAILER_PREFIXES = ("co-authored-by:", "signed-off-by:", "reviewed-by:", "change-id:", "cherry-picked:", "on-behalf-of:")
TRAILER_LINE = r"^([A-Za-z][A-Za-z0-9-]{1,30}):(.*)$"
BOT_LINE = r"(?i)^(bumps \[|dependency-type:|- \[release notes\]|updated-dependencies:)"
JUNK = (
    r"(?i)^(wip|fix(es|ed)?|updated?|changes?|test(s|ing)?|merge.*|minor.*|address(ed|ing)? (pr |review )?comments?.*"
    r"|pr comments?.*|refactor(ing)?)$"
)
LEADING_TICKETS = r"(?U)^(?:[\s\[\(]*[A-Z][A-Z0-9]{1,9}-\d{1,6}[\]\)]*[\s:,\-–]*\s*)+"
MIN_DESCRIPTION, MIN_BODY, BODY_TICKETS, BODY_CHARS, EVIDENCE_CHARS = 12, 25, 3, 300, 4000


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def split_lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end adds no empty line, and an empty text has none."""
    parts = F.split(c, LINE_ENDS, -1)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tickets_of(c: Column, pattern: str = TICKET_PATTERN) -> Column:
    """Ticket ids in order of first appearance, each once."""
    return F.array_distinct(matches(text(c), "(?U)" + pattern if not pattern.startswith("(?") else pattern))


def ticket_prefix(c: Column) -> Column:
    """A ticket id's project: all before its last hyphen."""
    return F.regexp_extract(c, r"^(.*)-[^-]*$", 1)


def clean_description(c: Column) -> Column:
    """A subject without the ticket references that lead it."""
    return F.regexp_replace(F.regexp_replace(strip(text(c)), LEADING_TICKETS, ""), r"^[ .]+|[ .]+$", "")


def is_junk_description(c: Column) -> Column:
    """Too short, or a stock phrase."""
    return (F.length(c) < MIN_DESCRIPTION) | c.rlike(JUNK)


def normalise_line(c: Column) -> Column:
    """The key by which lines are compared."""
    return F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def normalise_message(c: Column) -> Column:
    """LF line ends, no more than one blank line in a row, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut before the last word that doesn't fit."""
    return F.when(F.length(c) <= limit, c).otherwise(rstrip(F.regexp_replace(F.substring(c, 1, limit), r"(?s) [^ ]*$", "")))


def clip_words(c: Column, limit: int) -> Column:
    """Like ``truncate`` with an ellipsis; a space at the very start is no place to cut."""
    head = F.substring(c, 1, limit)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(head, r"(?s)(?<=.) [^ ]*$", ""), F.lit("…")))


def withheld(rule: str) -> str:
    return f"[{rule.replace('-', ' ')} withheld]"


def rules_in_order(rules: Mapping[str, str] | None) -> list[tuple[str, str]]:
    return [(k, "(?U)" + v) for k, v in sorted((DEFAULTS.sensitive_patterns if rules is None else rules).items())]


def redact(c: Column, rules: Mapping[str, str] | None = None) -> Column:
    """Every match of every rule replaced by the rule's placeholder; rules go in order of name, each on the last one's output."""
    out = text(c)
    for name, pattern in rules_in_order(rules):
        out = F.regexp_replace(out, pattern, withheld(name).replace("\\", "\\\\").replace("$", "\\$"))
    return out


def redaction_counts(c: Column, rules: Mapping[str, str] | None = None) -> dict[str, Column]:
    """How many matches each rule takes out, in the order that ``redact`` has."""
    out, counts = text(c), {}
    for name, pattern in rules_in_order(rules):
        counts[name] = F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, withheld(name))
    return counts


def is_redaction_only(c: Column, rules: Mapping[str, str] | None = None) -> Column:
    """Whether no word is left beside placeholders."""
    out = text(c)
    for name, _ in rules_in_order(rules):
        out = F.replace(out, F.lit(withheld(name)), F.lit(" "))
    return ~out.rlike(r"(?U)\w")


def matched_rule(c: Column, rules: Mapping[str, str] | None = None) -> Column:
    """The first rule, by name, that the text matches; null if none."""
    return F.coalesce(*[F.when(text(c).rlike(p), F.lit(k)) for k, p in rules_in_order(rules)], F.lit(None).cast("string"))


def is_automated(name: Column, email: Column, identities: tuple[str, ...] = DEFAULTS.automation_identities) -> Column:
    """Whether an identity is a machine's: a `[bot]` mark, or a listed name as a whole word in the name or the mailbox."""
    name, email = text(name), text(email)
    bot = F.lower(name).contains("[bot]") | F.lower(email).contains("[bot]")
    if not identities:
        return bot
    listed = r"(?iU)\b(" + "|".join(r"\Q" + x + r"\E" for x in identities) + r")\b"
    return bot | name.rlike(listed) | F.substring_index(email, "@", 1).rlike(listed)


def is_trailer(line: Column) -> Column:
    """A line of metadata by its shape: a hyphenated key, or a value of one token. Bot and author marks, references and tickets are none."""
    probe = strip(line)
    key, value = F.regexp_extract(probe, TRAILER_LINE, 1), strip(F.regexp_extract(probe, TRAILER_LINE, 2))
    exempt = probe.rlike(BOT_LINE) | F.lower(probe).startswith("author: ") | key.rlike(r"^[A-Z][A-Z0-9]{1,9}$") | key.rlike("^(?:" + TICKET_PATTERN + ")$")
    return (key != "") & ~exempt & (key.contains("-") | ~value.contains(" "))


def is_plumbing(line: Column) -> Column:
    """A trailer, by name or by shape, or a separator line; learned boilerplate comes on top."""
    probe = lstrip(line)
    named = F.lit(False)
    for p in TRAILER_PREFIXES:
        named = named | F.lower(probe).startswith(p)
    return named | is_trailer(probe) | probe.rlike(r"^[-=]{3,}$")


def body_paragraphs(body: Column, boilerplate: Column | None = None) -> Column:
    """The kept lines of a body, as an array of paragraphs (arrays of lines) that blank lines part; ``boilerplate`` is an array of line keys."""
    lines = F.transform(split_lines(text(body)), rstrip)

    def step(acc: Column, line: Column) -> Column:
        keep = ~is_plumbing(line)
        if boilerplate is not None:
            keep = keep & ~F.array_contains(boilerplate, normalise_line(line))
        closed = F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return (
            F.when(line == "", F.struct(closed.alias("done"), F.array().cast("array<string>").alias("now")))
            .when(keep, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(line)).alias("now")))
            .otherwise(acc)
        )

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))
    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def rejection(flat: Column) -> Column:
    """Why the kept lines of a body are no prose, or an empty text."""
    lines = F.transform(F.split(flat, "\n", -1), lstrip)
    return (
        F.when(flat.rlike("(?i)dependabot") | F.exists(lines, lambda x: x.rlike(BOT_LINE)), "bot-text")
        .when(F.exists(lines, lambda x: F.lower(x).startswith("author: ")), "squashed-authors")
        .when(F.size(F.filter(lines, lambda x: x.startswith("* "))) >= 2, "merge-list")
        .when(F.length(flat) < MIN_BODY, "too-short")
        .otherwise("")
    )


def body_columns(body: Column, boilerplate: Column | None = None) -> Column:
    """A struct of a body's ``reason`` for rejection, its ``prose``, ``description``, ``evidence`` and ``tickets``; empty where rejected."""
    paragraphs = body_paragraphs(body, boilerplate)

    def parts(p: Column) -> Column:
        flat = F.array_join(F.flatten(p), "\n")
        reason = rejection(flat)
        ok = reason == ""
        prose = F.when(ok, flat).otherwise("")
        first = F.when(ok & (F.size(p) > 0), F.array_join(F.get(p, F.lit(0)), " ")).otherwise("")
        return F.struct(
            reason.alias("reason"), prose.alias("prose"), truncate(first, BODY_CHARS).alias("description"), truncate(prose, EVIDENCE_CHARS).alias("evidence"), F.slice(tickets_of(prose), 1, BODY_TICKETS).alias("tickets")
        )

    return F.get(F.transform(F.array(paragraphs), parts), F.lit(0))


def commit_description(subject: Column, body_description: Column) -> Column:
    """The subject's own words where they say something, else the body's opening."""
    cleaned = clean_description(subject)
    return F.when(~is_junk_description(cleaned), cleaned).otherwise(body_description)


def tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return matches(F.lower(text(c)), "[a-z0-9]+", 0)


def stem(c: Column) -> Column:
    """Words of over four letters lose a plural ending."""
    return F.when(F.length(c) > 4, F.regexp_replace(F.regexp_replace(c, "ies$", "y"), "e?s$", "")).otherwise(c)


def norm_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")


def spec_stem(c: Column) -> Column:
    """The id stem of a path: no last extension, all else that is no letter or digit one underscore."""
    path = strip(text(c))
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalise_step(c: Column) -> Column:
    """A step or step pattern with its parameters as placeholders, for comparison across languages."""
    out = F.regexp_replace(strip(text(c)), r"^[\^$]+|[\^$]+$", "")
    for pattern in (r"\{[a-zA-Z_]*(?::[^}]*)?\}", r"\((?:\?:)?[^)]*\)", '"[^"]*"', "<[^>]*>", r"(?U)\b\d+\b"):
        out = F.regexp_replace(out, pattern, PLACEHOLDER)
    return strip(F.lower(F.regexp_replace(out, r"(?U)\s+", " ")))


def feature_area(path: Column, features_dir: str = DEFAULTS.features_dir) -> Column:
    """The directory right below the features directory."""
    tail = F.when(F.instr(path, features_dir) > 0, F.expr("1")).isNotNull()
    rest = F.regexp_extract(path, r"\Q" + features_dir + r"\E(.*)$", 1)
    return F.when(tail & rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise("(root)")


def is_minified(label: Column) -> Column:
    return text(label).rlike(r"^[A-Za-z_$]{1,3}(\(\))?$")


def contains_all(haystack: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & haystack.contains(t)
    return out


def occurrences(haystack: Column, term: Column | str) -> Column:
    """How often a term is in a text, without overlaps."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(haystack) - F.length(F.replace(haystack, term, F.lit("")))) / F.length(term)).cast("long")


def strip_tags(html: Column) -> Column:
    """The visible text of markup."""
    return strip(F.regexp_replace(F.regexp_replace(text(html), "(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def escape_html(c: Column) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(text(c), r"([\\|])", r"\\$1")


def browse_link(ticket: Column, base: str) -> Column:
    return F.concat(F.lit(base), ticket) if base else ticket


def deployment_summary(config: Column, cap: int = DEFAULTS.deploy_page_keys) -> Column:
    """The first keys of a map, in order, as `k=v`."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(config)), 1, cap), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
