"""Chains, closures, components, owners, containment, bases, running values, samples, trees: against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import codes
from bitloom.operators import links, ranges, score, sets


def chains_by_hand(rows):
    before = {}
    for own, b in rows:
        if own is not None:
            before[own] = min((x for x in (before.get(own), b) if x is not None), default=None)
    out = {}
    for own in before:
        path, at = [own], own
        while before[at] in before and before[at] not in path:
            at = before[at]
            path.append(at)
        if before[at] in path:
            out[own] = (None, None, "cycle" if before[at] == own or own in path[path.index(before[at]) :] else "after cycle")
        else:
            out[own] = (at, len(path), "chained" if before[at] is None else "broken")
    return out


def test_a_shuffled_chain_of_ten_thousand(spark):
    name = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(10_000)]
    rows = [(name[i], name[i - 1] if i else None) for i in range(10_000)]
    random.Random(1).shuffle(rows)
    got = {r["own"]: r for r in links.chains(spark.createDataFrame(rows, "own string, before string"), "own", "before").collect()}
    assert all(got[name[i]]["rank"] == i + 1 and got[name[i]]["chain"] == name[0] and got[name[i]]["status"] == "chained" for i in range(10_000))
    assert {r["successors"] for r in got.values()} == {0, 1}


@pytest.mark.parametrize("seed", range(3))
def test_chains_with_breaks_forks_and_cycles(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [(i, rng.choice([None, rng.randrange(n), rng.randrange(n), rng.randrange(n), 1000 + i])) for i in range(n)]
    rows += [rows[3], rows[4], (5, 6), (None, 4), (None, None), (70, 70), (71, 72), (72, 71), (73, 71)]
    got = {r["own"]: r for r in links.chains(spark.createDataFrame(rows, "own long, before long"), "own", "before").collect()}
    want = chains_by_hand(rows)
    assert {k: (r["chain"], r["rank"], r["status"]) for k, r in got.items()} == want
    before = {k: min((b for o, b in rows if o == k and b is not None), default=None) for k in want}
    assert all(got[k]["successors"] == sum(b == k for b in before.values()) and got[k]["copies"] == sum(o == k for o, _ in rows) for k in want)


def test_nothing_linked(spark):
    none = spark.createDataFrame([], "own string, before string")
    assert links.chains(none, "own", "before").collect() == []
    edges = spark.createDataFrame([], "child long, parent long")
    assert links.closure(edges).collect() == [] and links.components(edges).collect() == []


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 20, 15), (2, 25, 40), (3, 12, 60), (4, 30, 30)])
def test_closure_and_components(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 103), (None, 3), (3, None)]
    reach = {(p, c) for c, p in edges if c is not None and p is not None}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    df = spark.createDataFrame(edges, "child long, parent long")
    assert sorted(map(tuple, links.closure(df).collect())) == sorted(reach)
    start = spark.createDataFrame([(0,), (3,), (999,), (None,)], "changed long")
    assert sorted(map(tuple, links.reached(df, start).collect())) == sorted(x for x in reach if x[0] in (0, 3))
    vertices = {v for c, p in edges if c is not None and p is not None for v in (c, p)}
    same = {v: {v} | {w for w in vertices if (v, w) in reach and (w, v) in reach} for v in vertices}
    assert sorted(map(tuple, links.components(df).collect())) == sorted((v, min(s), len(s), (v, v) in reach) for v, s in same.items())


def test_longest_prefix_owns(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rules = [(word(rng.randint(0, 4)), rng.choice("xyz")) for _ in range(25)] + [(None, "x"), ("a", None)]
    paths = [word(rng.randint(0, 7)) for _ in range(80)] + [None, "", "ünï"]
    got = {r["path"]: (r["owner"], r["owners"]) for r in score.owners(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, "prefix string, owner string")).collect()}
    want = {}
    for p in paths:
        hit = [(len(q), o) for q, o in rules if q is not None and o is not None and p is not None and p.startswith(q)]
        want[p] = (max(hit)[1] if hit else None, len({o for _, o in hit}))
    assert got == want
    assert "NestedLoop" not in score.owners(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame(rules, "prefix string, owner string"))._jdf.queryExecution().toString()


def test_containing(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([*range(9), None]) for _ in range(rng.randint(0, 5))]) for i in range(70)] + [(80, None), (81, []), (82, [100, 101]), (83, [100])]
    got = {r["key"]: (r["maximal"], r["smallest"]) for r in sets.containing(spark.createDataFrame(rows, "key long, items array<long>"), "key", "items").collect()}
    plain = {k: frozenset(x for x in v or [] if x is not None) for k, v in rows}
    for k, s in plain.items():
        above = sorted((len(t), min(j for j, u in plain.items() if u == t)) for t in set(plain.values()) if t > s)
        assert got[k] == (not above, above[0][1] if above else None)
    assert sets.containing(spark.createDataFrame([], "key long, items array<long>"), "key", "items").collect() == []


@pytest.mark.parametrize("width", [1, 7, 20, 64])
def test_independent_rows_and_span(spark, width):
    rng = random.Random(width)
    masks = [rng.getrandbits(width) & rng.getrandbits(width) for _ in range(200)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = [(i, signed(m)) for i, m in enumerate(masks)] + [(500, None), (501, 0)]
    random.Random(0).shuffle(rows)
    want = codes.independent(masks)[0] if isinstance(codes.independent(masks), tuple) else codes.independent(masks)
    first, basis = [], []
    for i, m in enumerate(masks):
        if len(sets.echelon([*basis, m])) > len(basis):
            first.append(i)
            basis = sets.echelon([*basis, m])
    assert len(first) == len(want)
    for parts in (1, 3, 70):
        df = spark.createDataFrame(rows, "id long, mask long").repartition(parts)
        assert sorted(r["id"] for r in sets.independent_rows(df, ["id"], "mask", fan=8).collect()) == first
    some = sets.echelon([m & ((1 << 64) - 1) for m in masks[:5]])
    tested = [0, *masks[:20], *(masks[0] ^ masks[i] for i in range(5)), (1 << 64) - 1]
    got = [r["ok"] for r in spark.createDataFrame([(i, signed(m)) for i, m in enumerate(tested)], "i long, m long").orderBy("i").select(sets.in_span(F.col("m"), some).alias("ok")).collect()]
    assert got == [len(sets.echelon([*some, m])) == len(some) for m in tested]


def test_running_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 40), i, rng.choice([None, rng.randint(-5, 50)])) for i in range(500)] + [(None, 500, 3)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(7)
    total, want = 0, []
    for a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += v or 0
        want.append((a, b, v, total))
    found = ranges.running(df, ["a", "b"], F.col("v"), parts=9)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("__g" in line or "__part" not in line for line in plan.splitlines() if "SinglePartition" in line)  # only sums of groups of ranges
    caps = [-1, 0, 100, 2000, total, 10**9]
    positive = [(a, b, abs(v or 0)) for a, b, v in rows]
    up, first = 0, {}
    for a, b, v in sorted(positive, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        up += v
        for c in caps:
            if up > c and c not in first:
                first[c] = (a, b, up)
    got = {r["cap"]: (r["a"], r["b"], r["running"]) for r in ranges.first_crossings(spark.createDataFrame(positive, "a long, b long, v long"), ["a", "b"], F.col("v"), caps).collect()}
    assert got == first
    assert ranges.running(df.where("a > 1000"), ["a", "b"]).collect() == []


def test_samples_agree(spark):
    keys = [(i % 300,) for i in range(900)] + [(None,)]
    draw = lambda rows, parts: [r["k"] for r in ranges.digest_sample(spark.createDataFrame(rows, "k long").repartition(parts), "k", "s", 40).collect()]
    want = sorted(range(300), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())[:40]
    assert draw(keys, 1) == draw(keys, 11) == want
    assert draw([k for k in keys if k[0] is not None and k[0] % 2], 3)[:10] == [k for k in sorted(range(1, 300, 2), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())][:10]


def test_trees(spark):
    rows = [(i * 3, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, sha string").repartition(5)
    level, want = [s for _, s in rows], []
    while True:
        level = [hashlib.sha256(",".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        want.append(level)
        if len(level) == 1:
            break
    nodes = ranges.tree(df, "k", "sha", 4)
    got = {(r["level"], r["node"]): (r["sha"], r["n"]) for r in nodes.collect()}
    assert {k: s for k, (s, _) in got.items()} == {(i, j): s for i, l in enumerate(want) for j, s in enumerate(l)}
    assert got[len(want) - 1, 0][1] == 150 and got[0, 37] == (want[0][37], 2)
    other = ranges.tree(df.withColumn("sha", F.when(F.col("k") == 300, "other").otherwise(F.col("sha"))), "k", "sha", 4)
    assert sorted(map(tuple, ranges.changed_nodes(nodes, other).collect())) == [(i, 100 // 4 ** (i + 1)) for i in range(len(want))]
    proof = ranges.inclusion(nodes, df, "k", "sha", spark.createDataFrame([(300,), (444,)], "k long"), 4).collect()
    for k in (300, 444):
        now = dict(rows)[k]
        for r in sorted((r for r in proof if r["k"] == k), key=lambda r: r["level"]):
            assert r["siblings"][r["place"]] == now
            now = hashlib.sha256(",".join(r["siblings"]).encode()).hexdigest()
        assert now == want[-1][0]
    assert ranges.tree(df.where("k < 0"), "k", "sha").collect() == []
