"""Collocations against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitloom.llm import phrases

from .conftest import table


def brute_force(rows, least, longest, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * counts[p[i : i + k]]}
        rows_ = []
        for p, a in found.items():
            if p not in drop:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def mined(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    common = ["of the", "New York  City", "a b a b a", "in spite of it all", "É\u0085x y"]
    rows = []
    for i in range(400):
        w = [rng.choice([*common, *(f"w{rng.randint(0, 30)}" for _ in range(6))]) + rng.choice(["", "", ".", ",", "\n", ";", "\t"]) for _ in range(rng.randint(0, 25))]
        rows.append((i, " ".join(w), rng.choice(["en", "en", "de", None]), "s"))
    return rows + [rows[3]] * 30 + [(900, "Same line here\n" * 300, "en", "s"), (901, "one two three four five six " * 50, "de", "s"), (902, None, "en", "s"), (903, "", None, "s"), (904, " \t . , ", "xx", "s")]


@pytest.mark.parametrize("options", [dict(least=20, longest=5, top=2000), dict(least=4, longest=5, top=15), dict(least=10, longest=3, top=50), dict(least=10, longest=2, top=50), dict(least=10, longest=5, top=500, share=80)])
def test_against_brute_force(spark, talk, options):
    want = brute_force(talk, **options)
    assert len(want) > 20
    assert mined(table(spark, talk), **options) == want


def test_odd_rows(spark, odd, odd_rows):
    want = brute_force(odd_rows, 3, 5, 2000)
    assert len(want) > 50 and mined(odd, least=3) == want


def test_stretches_overlap():
    """Cut into stretches of any length, the same n-grams come out."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["a b c d e f g h i j", "x", "a b c a b"]), pa.array([2, 1, 5])], ["lang", "piece", "times"])
            total = Counter()
            for b in run([batch]):
                for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[k] += n
            return total

    whole = phrases.grams(Rows(), (1, 2, 3, 4, 5))
    assert whole["a b\nen"] == 12 and whole["x\nde"] == 1 and whole["a b c d e\nen"] == 2
    before = phrases.STRETCH
    try:
        for phrases.STRETCH in (1, 2, 3, 7, 100):
            assert phrases.grams(Rows(), (1, 2, 3, 4, 5)) == whole
    finally:
        phrases.STRETCH = before


def test_bit_map_never_misses(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [("en", f"{a} {b}", 2, 5, 0) for a, b in zip(words, words[1:])]
    hashes = phrases.WordHashes()
    left, right = (hashes.of([w.encode() for w in ws]) for ws in (words[:-1], words[1:]))
    lang = hashes.of([b"en"] * len(left))
    pair = phrases.pair_hashes(lang, left, right)
    found = spark.createDataFrame([(*r[:4], int(p)) for r, p in zip(rows, pair.view(np.int64))], "lang string, phrase string, words int, n long, mark long")
    marks = phrases.mark_map(found)
    assert marks.marked(pair).all() and marks.marked(phrases.pair_hashes(lang, right, left)).mean() < 0.1


def test_large_numbers(spark):
    """Products beyond 64 bits are exact."""
    a, l, r, n = 3_000_000_000_001, 4_000_000_000_007, 5_000_000_000_011, 90_000_000_000_017
    c = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    k = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, phrase string, n long")
    row = phrases.scored(c, k, spark.createDataFrame([("en", n)], "lang string, n long"), 5).first()
    assert row["score"] == 1000 * a * n // (l * r) and (row["l"], row["r"]) == (l, r)


def test_nothing(spark, nothing):
    assert phrases.collocations(nothing).collect() == []
