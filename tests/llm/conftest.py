import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, component string, key int, size string, rank string, a string, taken string, name string, row int, lang_pred string, spans string, redacted string, carry_0 string, node int, cluster int, held_out string, `odd.name` string"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(3)
    pools = {"en": ["the", "house", "river", "is", "of", "light", "and", "stone", "walk", "garden"], "de": ["der", "fluss", "und", "licht", "nicht", "garten", "haus", "schön", "über", "straße"]}
    passage = words(rng, 60, pools["en"])
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, words(rng, rng.randint(3, 120), pools[lang] + [f"w{lang}{rng.randint(0, 400)}" for _ in range(60)]), lang, f"s{i % 5}"))
    for i in range(60, 80):  # near copies of a long text, each with one word changed
        w = words(random.Random(9), 150, [f"q{k}" for k in range(500)]).split()
        w[i] = "changed"
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(i, rows[5][1], "en", "s1") for i in range(80, 90)]  # exact copies
    rows += [(90 + i, words(rng, 30, pools["en"]) + " " + passage + " " + words(rng, 20, pools["de"]), "en", "s2") for i in range(4)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, "  \t\n ", "en", None), (103, "word", "en", "s0"), (104, "WORD", None, "s0"), (105, "1234 567", "de", ""), (106, "x " * 30000, "en", "s3"), (107, "é\u0085ü b c", "de", "s4")]
    rows += [rows[7], rows[7], (None, "no id here at all", "en", "s1"), (None, None, None, "s1"), (108, "abc " * 80, "en", "s1")]
    return rows


def table(spark, rows):
    full = [(*r, len(r[1]) if r[1] else None, "x", "x", 1, "x", "x", "x", "x", "x", 5, "x", "x", "x", "x", 1, 1, "x", "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    table(spark, odd_rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
