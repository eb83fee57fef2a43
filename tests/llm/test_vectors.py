import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import neighbours, vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, key string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((220, 16)).astype(np.float32)
    for i in range(40, 90):  # a dense group
        x[i] = x[40] + 0.05 * rng.standard_normal(16)
    for i in range(90, 120):  # a chain: neighbours link, ends don't
        x[i] = x[i - 1] + 0.3 * rng.standard_normal(16)
    x[130:140] = x[129]  # equal vectors
    out = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    out[150] = (150, None)
    out[151] = (151, [0.0] * 16)
    out[152] = (152, [float("nan")] + [1.0] * 15)
    out[153] = (153, [float("inf")] + [1.0] * 15)
    out[154] = (154, [None] + [1.0] * 15)
    out[155] = (155, [])
    out[156] = (156, [1.0, 2.0, 3.0])
    out[157] = (None, out[3][1])
    return [*out, out[7], (300, [2 * v for v in out[45][1]])]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, np.array(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]


def test_nearest_is_exact(vectors, rows):
    ok = [(i, v.astype(np.float32).astype(float)) for i, v in usable(rows)]
    for blocks in ({}, {"query_block": 3, "candidate_block": 16}):
        got = {}
        for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, **blocks).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = {}
        for i, q in ok:
            if i % 20 == 0:
                near = sorted((float(neighbours.exact(q[None], v[None])[0]), j) for j, v in ok if j != i and len(v) == len(q))[:10]
                want[i] = [(k + 1, j, s) for k, (s, j) in enumerate(near)]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_nearest_in_wide_vectors(spark):
    """Widths at which one product of int8 vectors isn't exact in float32; near ties on purpose."""
    rng = np.random.default_rng(12)
    x = (1 + 1e-6 * rng.standard_normal((60, 1536))).astype(np.float32)
    x[30:] = rng.choice([-1, 1], (30, 1536))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(vectors, F.col("vec_id") % 7 == 0, candidate_block=16).collect()}
    for i in range(0, 60, 7):
        near = sorted((float(neighbours.exact(x[i : i + 1].astype(float), x[j : j + 1].astype(float))[0]), j) for j in range(60) if j != i)[:10]
        assert [got[i, k + 1] for k in range(10)] == [(j, s) for s, j in near]


def test_the_plan_doesnt_grow_with_queries(spark):
    rng = np.random.default_rng(13)
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 8)))], "vec_id long, embedding array<float>")
    sizes = [len(neighbours.nearest(vectors, F.col("vec_id") % n == 0, query_block=4)._jdf.queryExecution().executedPlan().toString().splitlines()) for n in (200, 2)]
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("tile", [512, 16])
def test_links_and_components(vectors, rows, tile):
    got = {}
    for r in vecdedup.near_duplicates(vectors, tile=tile, passes=48, window=64).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    ok = usable(rows)
    links = {k: [j for j, (_, b) in enumerate(ok) if j != k and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9] for k, (_, a) in enumerate(ok)}
    low = {k: ok[k][0] for k in links}
    while True:
        new = {k: min([low[k], *(low[j] for j in links[k])]) for k in links}
        if new == low:
            break
        low = new
    want = {}
    for k, (i, _) in enumerate(ok):
        want.setdefault(i, []).append((len(links[k]), low[k], low[k] == i))
    seen = {i for i, _ in ok}
    for i, _ in rows:
        if i not in seen:
            want.setdefault(i, []).append((0, i, True))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    assert vecdedup.near_duplicates(none).count() == 0


def test_passes_grow_with_the_table():
    for n in (100, 80_000, 1_000_000, 20_000_000):
        passes = vecdedup.passes_for(n, 32, 0.9, 0.001)
        met = (1 - np.arccos(0.9) / np.pi) ** max(0, np.log2(n / 32))
        assert passes >= 24 and (1 - met) ** passes <= 0.001
    assert vecdedup.passes_for(20_000_000, 32, 0.9, 0.001) > 100


def test_production_passes(spark):
    """Pairs near the threshold with the values that the query uses."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 32))
    b = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.91 * a + (1 - 0.91**2) ** 0.5 * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(2 * i + j, [float(v) for v in x[i]]) for i in range(1500) for j, x in enumerate((a, b))]
    got = vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("n_links = 1").count()
    assert got >= 2 * 1495


def test_pairs_across_partition_edges(spark):
    """One pass, each row compared with the next: many small partitions find what one does."""
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 300, 16))
    rows = [(2 * i + j, [float(v) for v in a[i] + 0.2 * j * b[i]]) for i in range(300) for j in (0, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = []
        for n in (1, 150):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(vecdedup.near_duplicates(vectors, passes=1, window=1).where("n_links = 1").count())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[1] >= found[0] > 100


def test_one_key_over_many_tasks(spark):
    """Rows of one key, one pass, each row compared with the next: only edges on several levels make one group of them."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal(16)
    rows = [(i + 1, [float(v) for v in base + 1e-6 * rng.standard_normal(16)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        got = vecdedup.near_duplicates(vectors, passes=1, window=1, edge_rows=1).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r["vec_id"] for r in got) == [i for i, _ in rows]
    assert {(r["n_links"], r["component_id"], r["kept"] == (r["vec_id"] == 1)) for r in got} == {(299, 1, True)}


def test_a_copy_is_a_byte_a_component():
    rng = np.random.default_rng(4)
    x, ids = rng.standard_normal((5, 64)), np.arange(5) * 7
    packed = neighbours.pack(x, ids)
    assert {len(p) for p in packed} == {64 + 24} and 64 + 24 <= x[0].nbytes / 4
    (t,) = neighbours.tiles(np.arange(5), packed).values()
    assert t.ids.tolist() == ids.tolist() and (np.sqrt(((x - t.q * t.scale[:, None]) ** 2).sum(axis=1)) <= t.left).all()


def test_pairs_are_thinned_and_sent_on():
    """However few pairs a task may hold, what it sends on holds each query's nearest."""
    rng = np.random.default_rng(5)
    x, ids = rng.standard_normal((400, 8)), np.arange(400)
    t = neighbours.Tile(ids, neighbours.pack(x, ids))
    q = neighbours.Tile(ids[:20], neighbours.pack(x[:20], ids[:20]))
    for most in (0, 50, 10**6):
        search, sent = neighbours.Search(q, 3), []
        for i in range(0, 400, 40):
            search.add(neighbours.Tile(ids[i : i + 40], neighbours.pack(x[i : i + 40], ids[i : i + 40])))
            sent += [search.thin(most)]
        pairs = {(i, j) for s in (*sent, search.left()) if s for i, j in zip(s[0].tolist(), s[1].tolist())}
        for i in range(20):
            d = np.linalg.norm(x - x[i], axis=1)
            assert {(i, int(j)) for j in np.argsort(d)[1:4]} <= pairs
    assert len(search.pairs) == 0
