"""Decontamination, license scans and PII against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import common, decontaminate, license_scan, pii

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(text, items, window=10):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(low(t))
        for win in {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in map(lambda x: None if x is None else str(x), found) if x is not None)


def bench_rows():
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(25))
    return [(1, long), (2, "Two words"), (10, "solo"), (3, long[5:90]), (4, ""), (5, None), (None, "alpha beta gamma"), (6, "the ÜBER-term, of 3.14"), (2, "Two words")], long


def passages(corpus):
    _, long = bench_rows()
    w = long.split()
    extra = ["x " + long + " y", long, " ".join(w[3:13]), " ".join(w[3:12]), "TWO  words, two.words; solo", "alpha beta gamma " * 40, "über TERM of 3 14", long + " " + long, " ".join(w[:12] + w[5:20])]
    return corpus[:12] + corpus[100:104] + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(extra)]


@pytest.mark.parametrize("blocks", [False, True])
def test_decontamination_matches_brute_force(spark, corpus, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(decontaminate, "blocks", lambda rows, size, weight: common.blocks(rows, size, limit=400, weight=weight))
    rows = passages(corpus)
    items, _ = bench_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out) == Counter((r[0], a, b, tuple(c)) for r in rows for a, b, c in [brute_hits(r[1], items)])
    for r in out:
        text, at, kept = r["text"], 0, []
        for s in r["spans"] or []:
            kept.append(text[at : s["start"]])
            at = s["end"]
        assert r["clean_text"] == (None if text is None else "".join(kept) + text[at:])
        assert sum(len(WORD.findall(low(text[s["start"] : s["end"]]))) for s in r["spans"]) == r["n_hit"]


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clash = docs.withColumns({"N_HIT": F.lit(1), "spans": F.lit(2)})
    assert [c for c in decontaminate.decontaminate(clash, bench).columns if c.lower() == "n_hit"] == ["n_hit"]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = np.r_[0, rng.integers(0, 4, rng.integers(1, 200)), 0].astype(np.int64)
        index = decontaminate.FMIndex(text, sample=5)
        phrases = [rng.integers(1, 5, rng.integers(1, 6)) for _ in range(20)]
        words = np.zeros((20, 6), np.int64)
        for k, p in enumerate(phrases):
            words[k, : len(p)] = p
        lo, hi = index.search(words, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == want


def test_license_scan_finds_notices(spark, docs, empty):
    notice = license_scan.TEMPLATES["MIT-permission"]
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("the of and a river stone or in to software".split()) for _ in range(n))
    dropped = " ".join(w for i, w in enumerate(notice.split()) if i % 12 != 5)
    rows = [
        (0, filler(300) + "\nReleased under the MIT License.\n" + filler(300), "MIT"),
        (1, filler(50) + " " + notice + " " + filler(50), "MIT-permission"),
        (2, filler(50) + " " + dropped + " " + filler(50), "MIT-permission"),
        (3, filler(2000), None),
        (4, "Licensed under the Apache License, Version 2.0.\n" + filler(80) + "\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
        (5, None, None),
        (6, "", None),
        (7, "license license license license version version 2.0 the the", None),
        (8, "LICENSED UNDER CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(df).collect()}
    for i, text, want in rows:
        assert (got[i][0]["license"] if got[i] else None) == want, i
        if want:
            span = text[got[i][0]["start"] : got[i][0]["end"]]
            assert span.lower().split()[0].strip("(") in text.lower() and len(span) > 8
    assert license_scan.scan_licenses(empty).count() == 0


def test_notice_among_many_copies(spark):
    """Copies at ever wider distances, and a text that is little else than one word of the template."""
    notice = "Licensed under the Apache License, Version 2.0."
    spread = " ".join(notice + " x" * (40 * k) for k in range(1, 90))
    rows = [(0, spread, "Apache-2.0"), (1, "license " * 5000 + notice + " license" * 5000, "Apache-2.0"), (2, "the license " * 20_000, None)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [got[i][0]["license"] if got[i] else None for i in range(3)] == [w for _, _, w in rows]


@pytest.mark.parametrize("before", ["all", "this", "this all the", "license this under all the"])
def test_notice_after_its_own_words(before):
    """A word of the notice that also occurs earlier must not be bound to the far copy, once or often."""
    scan = license_scan.Scanner().scan
    for name, notice in license_scan.TEMPLATES.items():
        for times in (1, 20):
            text = " x ".join([before] * times) + " x" * 200 + " y. " + notice + " z" * 100 + " " + before
            found = {k: (c, text[a:b]) for k, c, a, b in scan(text)}
            assert found[name][0] == 1.0 and found[name][1] in notice and len(found[name][1]) >= len(notice) - 2, (name, times)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(30))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))]
        got = license_scan.align(list(enumerate(a)), b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < y for x, y in zip([j for _, j in got], [j for _, j in got][1:]))
        assert len(got) <= brute_lcs(a, b)
    whole = [chr(97 + i) for i in range(20)]
    assert len(license_scan.align(list(enumerate(["z", *whole, "z"])), whole)) == 20


def test_every_notice_that_is_there_is_found():
    """Notices in texts of their own words, whole and with some words lost or put in: coverage is what the best window has."""
    rng = random.Random(21)
    scan = license_scan.Scanner().scan
    for name, notice in license_scan.TEMPLATES.items():
        own = license_scan.words_at(notice)[0]
        around = own + "the of and river stone".split()
        for trial in range(24):
            head, tail = (" ".join(rng.choice(around) for _ in range(rng.randrange(10, 200))) for _ in range(2))
            found = {k: c for k, c, *_ in scan(f"{head} {notice} {tail}")}
            assert found.get(name) == 1.0, (name, trial)
            if len(own) >= 20:
                words = [w for i, w in enumerate(own) if i % 12 != trial % 12]
                for _ in range(3):
                    words.insert(rng.randrange(len(words)), "otherword")
                found = {k: c for k, c, *_ in scan(f"{head} {' '.join(words)} {tail}")}
                assert found.get(name, 0) >= round((len(words) - 3) / len(own), 4), (name, trial)


def test_coverage_is_that_of_the_best_window():
    """Against the longest common subsequences of all windows: never more, and at least what is found without repeats."""
    rng = random.Random(22)
    template = [f"w{i}" for i in range(12)]
    scanner = license_scan.Scanner({"t": " ".join(template)}, least=0.5)
    for _ in range(150):
        words = [rng.choice(template + ["x"] * 12) for _ in range(rng.randrange(5, 60))]
        at = rng.randrange(len(words))
        words[at:at] = [w for w in template if rng.random() < 0.8]
        width = int(license_scan.SLACK * len(template)) + 1
        best = max(brute_lcs(words[i : i + width], template) for i in range(len(words))) / len(template)
        got = max([c for _, c, *_ in scanner.scan(" ".join(words))], default=0)
        assert got <= round(best, 4) and (got >= 0.5 or best < 0.75)


def test_templates_from_a_table(spark):
    df = spark.createDataFrame([("own", "Kept under our own house rules."), ("none", None), (None, "x")], "license string, text string")
    templates = license_scan.templates_of(df)
    docs = spark.createDataFrame([(1, "a b kept under our own house rules c"), (2, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.scan_licenses(docs, templates).collect()}
    assert got == {1: ["own"], 2: []}


def test_hostile_texts_end_soon():
    """Two million characters of what makes a search start over at every place."""
    import time

    began = time.monotonic()
    n = 1 << 21
    for text in ("a" * n + "@", "a@" + "b-" * (n // 2), "a@" * (n // 2), "1" * n, "1." * (n // 2), "+1" + "(" * n, "1 " * (n // 2), "AB12 " * (n // 5), "a.b@c." * (n // 6)):
        pii.find_spans(text)
    assert time.monotonic() - began < 120
    began = time.monotonic()
    text = ("word " * 3 + "x y z\n") * (n // 24)
    spans = [(7 * i, 7 * i + 3) for i in range(n // 64)]
    cleaned, chars = decontaminate.cut_spans(text.encode(), spans)
    assert len(chars) == len(spans) and time.monotonic() - began < 20


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            s = m.group()
            digits = [int(c) for c in s if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card":
                odd = digits[-1::-2]
                even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
                if not 13 <= len(digits) <= 19 or (sum(odd) + sum(even)) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_matches_brute_force(spark, docs, corpus):
    rng = random.Random(9)
    samples = ["a@b.co", "x.y+z@h-t.example.org.", "@a.b", "a@@b.c d@e", "1.2.3.4", "256.1.1.1 1.2.3.4.5", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "é@b.co ß4111111111111111", "٤٤١", "+44 20 7946 0958 1234 5678"]
    texts = samples + ["".join(rng.choice("a@.1 +-4b()é\n0") for _ in range(60)) for _ in range(400)] + [r[1] for r in corpus[:20]] + [None, "", "x " * 20_000 + "a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "iban"] == brute_pii(t), t
    joined = spark.createDataFrame([(1, "call +1 555 010 9999, a@b.co")], "doc_id long, text string")
    assert pii.find_pii(joined, redact_at=0.5).first()["redacted_text"] == "call [phone], [email]"


def test_pii_checksums_and_context():
    found = pii.find_spans("Bank transfer to IBAN DE89 3704 0044 0532 0130 00 today, not DE89 3704 0044 0532 0130 01.")
    assert [(k, e - s) for k, s, e, _ in found if k == "iban"] == [("iban", 27)]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    near, far = pii.find_spans("my card 4111111111111111")[0][3], pii.find_spans("order 4111111111111111")[0][3]
    assert near > pii.BASE_SCORE["card"] / 1000 > far


def test_pii_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    texts = ["IBAN DE89 3704 0044 0532 0130 00, and GB82WEST12345698765432 XX00 1234 5678 9012 345", "DE89 3704 0044 0532 0130 00 99 card 4111 1111 1111 1111", None, "", "FR1420041010050500013M02606x FR14 2004 1010 0505 0001 3M02 606"]
    texts += [" ".join(rng.choice(["a@b.co", "contact", "1.2.3.4", "version", "4111111111111111", "order", "+1 555 010 9999", "call", "DE89370400440532013000", "é", "12-34", "300.1.1.1"]) for _ in range(25)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op5_pii(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(pii.oracle_op5()).df()[list(got.columns)]
    assert sorted(map(repr, got.astype(object).values.tolist())) == sorted(map(repr, want.astype(object).values.tolist()))
    assert got.spans.str.contains("iban").sum() > 5


def test_pii_digest_query(spark, tmp_path):
    texts = ["mail a@b.co or c@d.ef, +1 (555) 010-9999", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(texts[0]))
    assert got[0]["n_email"] == 2 and got[0]["n_phone"] == 1 and got[0]["spans"] == want
    assert got[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_ibans_beside_other_capitals():
    one, two = "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"
    cases = [
        ("NO93 8601 1117 947 BIC DNBANOKK", ["NO93 8601 1117 947"]),
        (f"{one} {two}", [one, two]),
        (f"{two} {one} {one}", [two, one, one]),
        ("AB12 0000 1111 2222 NO93 8601 1117 947", ["NO93 8601 1117 947"]),
        (f"REF AB12 CDEF {one}", [one]),
        ("DE88 3704 0044 0532 0130 00", []),
    ]
    for text, want in cases:
        assert [text[a:b] for a, b in pii.ibans(text)] == want, text


def test_pii_of_an_empty_table(spark, empty):
    clash = empty.withColumn("PII", F.lit(1))
    assert pii.find_pii(clash, redact_at=0.5).count() == 0 and pii.find_pii(clash).columns.count("pii") == 1
