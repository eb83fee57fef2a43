import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import graph, minhash, substring
from bitloom.llm.common import Workspace


def brute_components(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(minhash.TO_LOWER).split()
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    ids = [r[0] for r in rows]
    node = {}
    for i, s in zip(ids, sets):
        if s and i is not None:
            node[s] = min(node.get(s, i), i)
    low = dict(node)
    while True:
        new = {s: min([low[s], *(low[t] for t in node if minhash.is_link(len(s), len(t), len(s & t), percent))]) for s in node}
        if new == low:
            break
        low = new
    return sorted(((i, len(s), low.get(s, i) if s else i, (i is None and s not in low) or i == low.get(s, i) or (not s)) for i, s in zip(ids, sets)), key=str)


@pytest.mark.parametrize(("n", "percent", "limits"), [(2, 80, {}), (5, 80, {}), (2, 80, {"most_shingles": 100, "tile": 4, "chain": 3})])
def test_components_of_near_duplicates(odd, odd_rows, n, percent, limits):
    got = sorted((tuple(r) for r in minhash.near_duplicates(odd, n=n, percent=percent, **limits).collect()), key=str)
    assert got == brute_components(odd_rows, n, percent)


def test_exact_components_reaches_chains():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(2**40, 100, replace=False)).astype(np.uint64)]
    for _ in range(60):
        s = sets[-1].copy()
        s[rng.integers(100, size=5)] = rng.choice(2**40, 5).astype(np.uint64)
        sets.append(np.unique(s))
    sets += [np.sort(rng.choice(2**40, 50, replace=False)).astype(np.uint64) for _ in range(20)]
    got = minhash.exact_components(np.arange(len(sets)) + 7, sets, 80)
    assert set(got[:61]) == {7} and got[61:].tolist() == list(range(68, 88))


def test_circulant_estimates_jaccard():
    c, rng = minhash.Circulant(512), np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    assert abs((c(a) == c(b)).mean() - 1 / 3) < 0.08
    assert (c(a) == np.minimum(c(a[:900]), c(a[900:]))).all()


def test_graph_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(90)] + [(900, 700 + i) for i in range(80)]
    got = dict(graph.components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect())
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(1000):
        before = dict(low)
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert got == low


def brute_repeats(rows, length):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for (i, *_), w in zip(rows, texts):
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram", "most_bits"), [(35, 8, 30), (9, 4, 30), (35, 8, 20)])
def test_repeats(odd, odd_rows, length, gram, most_bits, monkeypatch):
    if most_bits == 20:  # a sketch too small to tell anything apart
        monkeypatch.setattr(substring, "sketch_bits", lambda *a, **k: 20)
        monkeypatch.setattr(substring.Filter, "__call__", lambda self, anchor: np.ones(len(anchor), bool))
    got = substring.remove_repeats(odd, length, gram, most_bits=most_bits).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)
    assert got == brute_repeats(odd_rows, length)


@pytest.mark.parametrize("least_heavy", [2, 64])
def test_one_common_phrase(spark, least_heavy):
    """An eight-word phrase in all kinds of windows: its windows are dealt by their own hash, and the result is the same."""
    rng = random.Random(7)
    phrase = [f"common{i}" for i in range(8)]
    rows = []
    for i in range(300):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(40)]
        rows.append((i, " ".join(w[:20] + phrase + w[20:])))
    rows += [(300 + i, rows[i][1]) for i in range(5)] + [(400, "p " + rows[9][1] + " q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.remove_repeats(docs, least_heavy=least_heavy).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)
    assert got == brute_repeats(rows, 35)
    # the phrase's smallest gram is the anchor of a few windows of each document
    windows = substring.Windows(35, 8)
    texts = [t.encode() for _, t in rows[:300]]
    _, at, place, g, h = windows.read(texts)
    anchors, n = np.unique(g[place], return_counts=True)
    if n.max() >= 300:
        heavy = anchors[n >= 300]
        f = substring.Filter([(-1, 0, heavy.tobytes())], 20, 2)
        keys = f.key(g[place], windows.whole(h)[at])
        assert np.unique(keys, return_counts=True)[1].max() < n.max() / 20
    merged = substring.merged(substring.sketch(docs, 20, 2, 35, 8), 100).where("row = -1").collect()
    assert {x for r in merged for x in np.frombuffer(r["bits"], np.uint64).tolist()} == set(anchors[n >= 100].tolist())


def test_copies_of_one_row_share_their_stretches(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    rows = [(1, text)] * 200 + [(None, text)] * 50
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 250 and all((r["n_words"], r["n_removed"], r["kept"]) == (60, 60, "") for r in got)


def test_op_columns(spark):
    shown = lambda q: [(f.name, f.dataType.simpleString()) for f in q(spark, "/root/testdata/sf0.001").schema]
    assert shown(minhash.op7) == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert shown(substring.op8) == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]


def test_one_id_with_different_texts_keeps_both(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "x"), (2, a, "z"), (1, a.replace(" ", "  "), "w"), (3, "", "e"), (3, " ", "e"), (3, None, "n")]
    got = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    kept = sorted(((r["doc_id"], (r["text"] or "").split()[:1], r["lang"]) for r in got), key=str)
    assert len([k for k in kept if k[0] == 1 and k[1] == ["a0"]]) == 1 and (1, ["b0"], "y") in kept
    assert len(kept) == 5 and not [k for k in kept if k[0] == 2]  # the empty texts have no copies


def test_repeats_across_flushes(spark):
    rng = random.Random(5)
    base = [str(rng.randint(0, 9)) for _ in range(400)]
    rows = [(i, " ".join(base[rng.randint(0, 300) :][: rng.randint(1, 100)] + [str(rng.randint(0, 9)) for _ in range(20)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(docs, 12, 5).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)
    assert got == brute_repeats(rows, 12)


def test_empty(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(nothing).count() == 0
    assert substring.remove_repeats(nothing).count() == 0


def test_keep_one(odd, odd_rows):
    got = minhash.keep_one(odd, n=2, percent=80)
    assert got.columns == odd.columns
    kept = [r["doc_id"] for r in got.collect()]
    want = {i for i, _, c, k in brute_components(odd_rows, 2, 80) if k and i is not None}
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 2
