"""Text rules against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from estatelens.functions import text as X
from estatelens.operators import dossier, retrieval
from estatelens.settings import DEFAULTS, Settings, browse_url


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_tickets_in_order(spark):
    got = run(spark, ["AB-1 x CD-22, AB-1", "ab-1 A-1 ABCDEFGHIJKL-1 XY-1234567", None, "éAB-1 AB-2é"], X.tickets_of)
    assert got == [["AB-1", "CD-22"], [], [], []]


def test_descriptions(spark):
    got = run(spark, ["[AB-1] (CD-2): Fix the thing.", "AB-1 - AB-2 – done ..", " plain ", "AB-1", None], X.clean_description)
    assert got == ["Fix the thing", "done", "plain", "", ""]
    assert run(spark, ["wip", "short", "Merge branch main into x", "A useful description", "refactoring"], X.is_junk_description) == [True, True, True, False, True]


def test_lines_and_messages(spark):
    values = ["a\r\nb\rc\x0bd\x85e f\n", "x\u2028y\u2029z\x1cw\x1ev", "", "\n", None, "a\n\nb"]
    assert run(spark, values, lambda c: X.split_lines(X.text(c))) == [(v or "").splitlines() for v in values]
    assert run(spark, ["\r\n\n\n\na\r\n\n\n\nb  "], X.normalise_message) == ["a\n\nb"]
    assert run(spark, ["  A\t B  c "], X.normalise_line) == ["a b c"]


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_truncate(spark, limit):
    values = ["one two three four", "abcdefghijklmnop", "one two three", "", " leading space here"]

    def plain(t):
        if len(t) <= limit:
            return t
        head = t[:limit]
        return (head[: head.rindex(" ")] if " " in head else head).rstrip()

    assert run(spark, values, lambda c: X.truncate(c, limit)) == [plain(v) for v in values]


def test_redaction(spark):
    rules = {"email-address": DEFAULTS.sensitive_patterns["email-address"], "a-case": r"\bCASE/\d+\b"}
    values = ["mail é.b@c-d.org now CASE/12", "a@b.co", "clean", None]
    assert run(spark, values, lambda c: X.redact(c, rules)) == ["mail [email address withheld] now [a case withheld]", "[email address withheld]", "clean", ""]
    assert run(spark, values, lambda c: X.matched_rule(c, rules)) == ["a-case", "email-address", None, None]
    assert run(spark, values, lambda c: X.is_redaction_only(X.redact(c, rules), rules)) == [False, True, False, True]
    assert run(spark, values, lambda c: X.redaction_counts(c, rules)["email-address"]) == [1, 1, 0, 0]


def test_identities(spark):
    rows = [("Some [bot]", "x@y"), ("Jenkins", "j@y"), ("Ann", "renovate+1@y.org"), ("Ann", "ann@jenkins.org"), ("Jenkinson", ""), (None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, e string").select("i", X.is_automated(F.col("n"), F.col("e")).alias("o"), X.is_automated(F.col("n"), F.col("e"), ()).alias("p")).orderBy("i").collect()
    assert [r["o"] for r in got] == [True, True, True, False, False, False] and [r["p"] for r in got] == [True] + [False] * 5


BODIES = {
    "Signed-off-by: A <a@b>\nFormer-commit-id: abc": ("too-short", "", ""),
    "First paragraph of the\nbody text.\n\nSecond one. AB-1 CD-2 AB-1 EF-3 GH-4": ("", "First paragraph of the body text.", "First paragraph of the\nbody text.\nSecond one. AB-1 CD-2 AB-1 EF-3 GH-4"),
    "Bumps [x] from 1 to 2 and more text here": ("bot-text", "", ""),
    "Author: someone <a@b>\nand a lot of squashed things": ("squashed-authors", "", ""),
    "* one commit of a merge\n* another commit of a merge": ("merge-list", "", ""),
    "Tests: added unit tests for the pipe\n-----\nSeverity: minor\nREF: kept as reference": ("", "Tests: added unit tests for the pipe REF: kept as reference", "Tests: added unit tests for the pipe\nREF: kept as reference"),
    "boilerplate LINE here\nreal words that stay in this body": ("", "real words that stay in this body", "real words that stay in this body"),
    None: ("too-short", "", ""),
}


def test_bodies(spark):
    known = F.array(F.lit("boilerplate line here"))
    got = run(spark, list(BODIES), lambda c: X.body_columns(c, known))
    assert [(r["reason"], r["description"], r["prose"]) for r in got] == list(BODIES.values())
    assert got[1]["tickets"] == ["AB-1", "CD-2", "EF-3"]


def test_steps_ids_paths(spark):
    assert run(spark, ["^I pay \"5\" to <name> in {amount:d} of (x|y) 12 times$", "i pay {string}  to {name}"], X.normalise_step) == ["i pay ¤ to ¤ in ¤ of ¤ ¤ times", "i pay ¤ to ¤"]
    assert run(spark, ["A b--C__d!"], X.norm_id) == ["a_b_c_d"]
    assert run(spark, ["src/Foo-Bar.test.ts", ".hidden", "a/b", None], X.spec_stem) == ["src_foo_bar_test", "hidden", "a_b", ""]
    assert run(spark, ["x/features/pay/a.feature", "features/a.feature", "other/a"], X.feature_area) == ["pay", "(root)", "(root)"]
    assert run(spark, ["aB", "abcd", "f()", "x.y", None], X.is_minified) == [True, False, True, False, False]


def test_tokens_and_stems(spark):
    assert run(spark, ["Foo-Bar2 é"], X.tokens) == [["foo", "bar2"]]
    words = ["queries", "boxes", "is", "class", "services", "bus"]
    assert run(spark, words, X.stem) == [retrieval.stem_word(w) for w in words] == ["query", "box", "is", "clas", "servic", "bus"]
    assert retrieval.query_terms("How does the Payment services work?") == ["payment", "servic", "work"]
    assert retrieval.query_terms("what is it") == ["what", "is", "it"]


def test_clip_escape_strip(spark):
    assert run(spark, ["one two three"], lambda c: X.clip_words(c, 9)) == ["one two…"]
    assert run(spark, ["<a href='x'>1 & 2</a>"], X.escape_html) == ["&lt;a href=&#39;x&#39;&gt;1 &amp; 2&lt;/a&gt;"]
    assert run(spark, ["<p>a <b>b</b>\n c</p>"], X.strip_tags) == ["a b c"]
    assert run(spark, ["aXbXXc"], lambda c: X.occurrences(c, "X")) == [3]


def test_identifiers_of_prose(spark):
    text = "FooBar calls snake_case in main.py for AB-12 via one-two-three, end-to-end."
    assert sorted(run(spark, [text], dossier.prose_identifiers)[0]) == sorted(["FooBar", "snake_case", "main.py", "AB-12", "one-two-three"])
    assert set(run(spark, ["a.event.PayTest"], dossier.spellings)[0]) == {"a.event.PayTest", "a.event.PayTest.java", "a.event", "a.event.Pay", "event", "PayTest"}


def test_settings():
    with pytest.raises(ValueError, match="nonsense"):
        DEFAULTS.with_overrides({"nonsense": 1})
    s = DEFAULTS.with_overrides({"ticket_browse_url": " https://t/browse "}).with_rules('{"x": "y+"}')
    assert s.ticket_browse_url == "https://t/browse/" and list(s.sensitive_patterns) == ["email-address", "x"]
    assert browse_url("https://t/i?key=") == "https://t/i?key=" and browse_url("") == ""
    with pytest.raises(ValueError):
        Settings().with_rules("[1]")
    re.compile(DEFAULTS.comment_noise)
