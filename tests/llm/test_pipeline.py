"""The pipeline and the registered queries over one small folder of tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from estatelens.llm import queries

from .conftest import SCHEMA, prose
from .test_dedup import brute_lines
from .test_search import bench_rows, brute_hits
from .test_similar import kept_by_brute_force


INSULTS = ("idiot", "moron", "scum")


def is_toxic(text):
    return any(x in (text or "").split() for x in INSULTS) or "idiot," in (text or "")


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    items, long = bench_rows()
    rows = [r for r in corpus if r[0] is not None] + [(200, "a text before\n" + long + "\nand after it", "en", "s0", 0), (201, "you idiot, you pathetic moron, you worthless scum " * 3, "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    # what is toxic is learned from labelled texts, which are no copies of one another
    rng = random.Random(4)
    for i in range(300, 540):
        words = prose(rng, 24).split(" ")
        if i % 4 == 0:
            words[3:3] = [rng.choice(INSULTS), *words[3:9], rng.choice(INSULTS)]
        rows.append((i, " ".join(words), "en", "s2", 0))
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300, 540)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, "http://a.org/x", "<p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(d + "/pages.parquet")
    return d, rows, items


def test_pipeline_against_brute_force(spark, folder):
    d, rows, items = folder
    kept = [r for r in rows if not is_toxic(r[1])]
    lined = [(r[0], x[3]) for r, x in zip(kept, brute_lines(kept))]
    near = list(kept_by_brute_force(lined).elements())
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in near)
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    texts = {r["doc_id"]: r["text"] for r in out}
    for i, t in near:
        if not brute_hits(t, items)[1]:
            assert texts[i] == t
    assert "a text before" in texts[200] and "and after it" in texts[200] and brute_hits(texts[200], items)[1] == 0


def test_stages_return_documents(spark, folder):
    d, _, _ = folder
    docs = spark.read.parquet(d + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, folder, name):
    d, rows, _ = folder
    assert queries.QUERIES[name](spark, d).count() == (2 if name.startswith("op10") else len(rows))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]


CLASHES = "_source _hash _n _k _s _i _w _lines _again _u _f _rest _dead_lines _gone _fp _hit_words_a Slot POSITION Score N_Words spans component_id lang_pred pii licenses".split()


def test_columns_that_clash(spark, docs):
    """Any extra column is kept as it is, unless a result has its name."""
    from pyspark.sql import functions as F

    from estatelens.llm import decontaminate, language_id, license_scan, line_dedup, mixing, pii, quality, simhash, toxicity, url_filter

    wide = docs.withColumns({c: F.lit(f"x{c}") for c in CLASHES}).withColumn("url", F.lit("http://a.org/"))
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    made = {
        "mix": mixing.mix(wide),
        "quality": quality.quality(wide, clean_col="clean"),
        "lines": line_dedup.dedup_lines(wide),
        "near": simhash.near_dedup(wide),
        "tox": toxicity.score_toxicity(wide, toxicity.Model({" bad ": 3.0})),
        "pii": pii.find_pii(wide, redact_at=0.5),
        "lic": license_scan.scan_licenses(wide),
        "lang": language_id.identify(wide, language_id.Model({"en": "alpha beta", "de": "ein das"})),
        "bench": decontaminate.decontaminate(wide, bench),
        "url": url_filter.filter_urls(wide),
    }
    for name, out in made.items():
        rows = out.collect()
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower), name
        kept = [c for c in CLASHES if c in out.columns and c not in ("spans", "pii", "licenses", "lang_pred")]
        assert all(r[c] == f"x{c}" for r in rows for c in kept), name
        assert len(kept) >= len(CLASHES) - 8, name


def test_pipeline_of_empty_tables_nulls_and_other_columns(spark, tmp_path):
    """No rows give no rows; nulls, repeated ids and columns of results' names crash nothing, and only the columns of documents go on."""
    from pyspark.sql import functions as F

    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)])):
        d = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "FP": F.lit(1), "position": F.lit(2)})
        docs.write.parquet(d + "/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
        spark.createDataFrame([(None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "FP" not in out.columns
        got = out.collect()
        assert sorted(r["position"] for r in got) == list(range(len(got)))
        # the row without an id stays, and of id 1, which is the least of each of its groups, every row
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1] or "") for r in rows)
