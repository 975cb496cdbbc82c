import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta river stone cloud paper green small large north south light dark seven eight nine".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(300)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, repeated lines, nulls, empties, one very long text, and rows that repeat a doc_id."""
    rng = random.Random(7)
    shared = [prose(rng, 9) for _ in range(4)]
    rows = []
    for i in range(80):
        lines = [prose(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  " + shared[i % 4].upper() + "\t")
        rows.append([i, "\n".join(lines), ("en", "fr", None)[i % 3], f"s{min(i % 7, 3)}", 0])
    for i in range(80, 90):
        rows.append([i, rows[5][1], "en", "s0", 0])
    for i in range(90, 100):
        words = rows[7][1].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append([i, " ".join(words), "en", "s0", 0])
    rows += [[100, None, None, None, None], [101, "", "en", "s1", 0], [102, " \t ", "en", "s1", 0], [103, "one", "en", "s1", 3], [104, "One", "en", "s1", 3], [105, prose(rng, 30_000), "en", "s2", 0]]
    rows += [[106, "Ünï cödé ÄÖÜ straße " * 20, "de", "s9", 0], [5, rows[5][1], "en", "s0", 0], [None, "no id at all here", "en", None, 0], [None, None, None, None, None]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
