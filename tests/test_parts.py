"""Functions, sources, planners and streaming on small cases."""

import hashlib
import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import bitloom
from bitloom.functions import bits, codes, records, variants
from bitloom.operators import decode, score
from bitloom.plans import dag, orders
from bitloom.sources import files, generators
from bitloom.streaming import rounds


def test_codes():
    assert ["".join("01"[r >> i & 1] for i in range(18)) for r in codes.CHECKS_18][0] == "101100000110000100"
    for code in (codes.C18, *codes.LADDER[:3]):
        hx, hz = codes.checks(code)
        assert all((a & b).bit_count() % 2 == 0 for a in hx for b in hz)
        logical = codes.logical_basis(code)
        assert all((v & h).bit_count() % 2 == 0 for v in logical for h in hx)
        assert len(logical) == code[0] - len(codes.independent(hx)) - len(codes.independent(hz))


def test_reduction():
    rng = random.Random(1)
    for _ in range(50):
        rows = [rng.getrandbits(12) for _ in range(rng.randint(1, 10))]
        reduced, pivots = codes.reduced(rows, 12)
        assert len(reduced) == len(codes.independent(rows)) == len(pivots)
        null = codes.nullspace(rows, 12)
        assert len(null) == 12 - len(pivots) and all((v & r).bit_count() % 2 == 0 for v in null for r in rows)


def brute_fill_order(scopes, n):
    adj = {v: {u for s in scopes if v in s for u in s if u != v} for v in range(n)}
    out = []
    while adj:
        cost = {v: sum(b not in adj[a] for a, b in itertools.combinations(sorted(adj[v]), 2)) for v in adj}
        v = min(adj, key=lambda x: (cost[x], x))
        out.append((v, len(adj[v]), cost[v]))
        for a, b in itertools.combinations(sorted(adj[v]), 2):
            adj[a].add(b)
            adj[b].add(a)
        for u in adj.pop(v):
            adj[u].discard(v)
    return out


def test_min_fill_scores_stay_right():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(3, 16)
        scopes = [tuple(rng.sample(range(n), rng.randint(1, 3))) for _ in range(rng.randint(2, 24))]
        assert orders.eliminate(scopes, n, "min_fill") == brute_fill_order(scopes, n)


def test_junction_tree_runs_through_every_variable():
    scopes = codes.scopes(codes.C18)
    order = [v for v, _, _ in orders.eliminate(scopes, 7, "min_fill")]
    cliques = orders.bags(scopes, order)
    tree = orders.junction_tree(cliques)
    assert all(any(set(s) <= c for c in cliques) for s in scopes)
    for v in range(7):
        own = {i for i, c in enumerate(cliques) if v in c}
        linked = {i for e in tree for i in e[:2] if e[0] in own and e[1] in own}
        assert len(own) == 1 or linked == own


def test_graph_interning():
    g = dag.Graph()
    a, b = g.add("T", 1), g.add("T", 2)
    assert g.add("ADD", a, b) == g.add("ADD", b, a) and g.add("ITE", 0, a, a) == a and g.add("T", 1) == a
    root = g.add("MUL", g.add("ADD", a, b), g.add("ITE", 1, a, b))
    assert dag.evaluate(g, root, np.arange(4), "sum_product")[0].tolist() == [3, 3, 6, 6]


def test_minima_are_independent(spark):
    rows = spark.createDataFrame([(0, 0, 1, 1, 2, 3), (0, 0, 1, 1, 1, 4)], "syn long, lab long, m9 long, m2 long, w int, e long")
    r = decode.classes(rows).first()
    assert (r["w"], r["rep"], r["key"]) == (1, 4, 3)


def test_paired_outcomes_skip_unknown(spark):
    a = spark.createDataFrame([(0, True), (1, None), (2, False), (3, True)], "idx int, success boolean")
    b = spark.createDataFrame([(0, False), (1, True), (2, True), (3, True)], "idx int, success boolean")
    assert tuple(decode.compare(a, b).first()) == (1, 1, 1, 3)


def test_collision_between_labels(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, 1), ("c", 2.0, 1)], "k string, s double, y int")
    assert score.gap(rows, "s", "y").first()[0] == 0.0 and score.alternations(rows, "s", "y").first()[0] == 0
    assert {tuple(r)[-1] for r in score.collisions(rows, "s", "y", "k").collect()} == {0, 1}


def test_coverage_and_differences(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    o = spark.createDataFrame([(1,), (1,), (4,), (3,)], "k int")
    assert sorted(map(tuple, score.coverage(e, o, "k").collect())) == [(1, "repeated"), (2, "missing"), (4, "unknown")]
    assert sorted(map(tuple, score.differences(e, o).collect())) == [(1, "right"), (2, "left"), (4, "right")]


def test_bit_functions(spark):
    rng = random.Random(4)
    xs = [rng.getrandbits(40) for _ in range(50)] + [0]
    d = spark.createDataFrame([(x,) for x in xs], "x long")
    masks = [rng.getrandbits(40) for _ in range(7)]
    got = d.select("x", bits.syndrome("x", masks).alias("s"), bits.encode("x", 40).alias("b"), bits.lift("x", masks).alias("l"), bits.gather("x", [3, 0, 9]).alias("g")).collect()
    for r in got:
        x = r["x"]
        assert r["s"] == sum(((x & m).bit_count() & 1) << i for i, m in enumerate(masks))
        assert int(r["b"][::-1], 2) == x
        lifted = 0
        for i, m in enumerate(masks):
            lifted ^= m * (x >> i & 1)
        assert r["l"] == lifted and r["g"] == (x >> 3 & 1) | (x & 1) << 1 | (x >> 9 & 1) << 2


def test_record_rules(spark):
    rows = spark.createDataFrame([(1, "ok-1", 3, [1, 2]), (2, None, -1, [1, 1]), (3, "bad", None, None)], "id int, name string, n int, items array<int>")
    schema = {"required": ["name"], "additionalProperties": False, "properties": {"id": {"type": "integer"}, "name": {"type": "string", "pattern": "ok-[0-9]"}, "n": {"type": ["integer", "null"], "minimum": 0}, "items": {"type": "array", "uniqueItems": True, "items": {"minimum": 1}}}}
    got = sorted(map(tuple, records.violations(rows, "id", records.schema_rules(schema, dict(rows.dtypes))).collect()))
    assert got == [(2, "items:uniqueItems"), (2, "n:minimum"), (2, "name:required"), (3, "name:pattern")]
    assert "id:type" in {r[1] for r in records.violations(rows, "id", records.schema_rules({"properties": {"id": {"type": "string"}}}, dict(rows.dtypes))).collect()}
    assert "name:unknown" in records.schema_rules({"additionalProperties": False, "properties": {}}, dict(rows.dtypes))


def test_record_functions(spark):
    d = spark.createDataFrame([('{"b": 1.5, "a": [true, null, "é"]}',), ("nope",), ('{"x": NaN}',)], "t string")
    want = hashlib.sha256(b'{"a":[true,null,"\\u00e9"],"b":1.5}').hexdigest()
    assert [r[0] for r in d.select(records.canonical_sha256("t")).collect()] == [want, None, None]
    blob = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary").select(records.blob_id(F.col("c"))).first()[0]
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a"
    p = spark.createDataFrame([(x,) for x in ("a/b.txt", "/a", "a/../b", "a//b", "a/*.py", "a/./b")], "p string")
    assert [r[0] for r in p.select(records.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False]
    t = spark.createDataFrame([(x,) for x in ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z")], "t string")
    assert [r[0] is not None for r in t.select(records.aware_timestamp(F.col("t"))).collect()] == [True, True, False, False]
    k = spark.createDataFrame([(["a", "c"],), (["a", "b"],)], "k array<string>")
    assert [r[0] for r in k.select(records.key_problems(F.col("k"), ["a", "b"])).collect()] == [["+c", "-b"], []]


def test_flattened_equality(spark):
    full = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": true}')], "k int, t string")
    for text, paths in (('{"a": {"b": [1, 2]}}', []), ('{"a": {"b": [1, "2"]}}', ["$.a.b[1]"]), ('{"c": 1, "d": 0}', ["$.c", "$.d"])):
        public = spark.createDataFrame([(1, text)], "k int, t string")
        got = records.projected_differences(variants.leaves(public, "k", "t"), variants.leaves(full, "k", "t"), "k")
        assert sorted(r["path"] for r in got.collect()) == paths


def test_file_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"version": "1", "items": [{"id": "x", "n": 1}, {"id": "y", "n": 2}, {"id": "y", "n": 3}]}))
    schema = "version string, items array<struct<id: string, n: int>>"
    assert files.registry(spark, str(tmp_path / "r.json"), schema, "items", F.col("id") == "x").first()["n"] == 1
    for bad in ("y", "z"):
        with pytest.raises(ValueError):
            files.registry(spark, str(tmp_path / "r.json"), schema, "items", F.col("id") == bad)
    cells = tmp_path / "cells"
    for i in range(3):
        (cells / f"d{i}").mkdir(parents=True)
        (cells / f"d{i}" / f"{i}.receipt.json").write_text(json.dumps({"shard": i}))
    assert {r["shard"] for r in files.receipts(spark, str(cells), "shard int", "*.receipt.json").collect()} == {0, 1, 2}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.json", "{}")
        z.writestr("in/two.txt", "hi")
    m = files.archive_members(spark, str(tmp_path / "a.zip"))
    assert bytes(files.only_member(m, "two.txt").first()["content"]) == b"hi"
    with pytest.raises(ValueError):
        files.only_member(m, ".none")
    (tmp_path / "rows.jsonl").write_text('{"i": 0, "s": "a"}\n{"i": "x", "s": "b"}\n{"i": 2, "s": "c", "more": 1}\n')
    good, bad = files.strict_rows(spark, str(tmp_path / "rows.jsonl"), "i int, s string")
    assert {r["i"] for r in good.collect()} == {0} and bad.count() == 2
    (tmp_path / "time.txt").write_text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03.50\n\tMaximum resident set size (kbytes): 4321\n")
    assert tuple(files.time_report(spark, str(tmp_path / "time.txt")).first()) == (3723.5, 4321)
    files.write_canonical(spark, {"b": 1, "a": "é"}, str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text() == '{\n  "a": "\\u00e9",\n  "b": 1\n}\n'
    man = {r["path"]: (r["bytes"], r["sha256"]) for r in files.manifest(spark, str(cells)).collect()}
    assert man["d1/1.receipt.json"] == (12, hashlib.sha256(b'{"shard": 1}').hexdigest())


def test_streaming_rounds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(h, t, rng.getrandbits(18)) for h in range(5) for t in range(4)]
    source = tmp_path / "in"
    for part in (0, 2):  # two batches
        spark.createDataFrame([r for r in rows if part <= r[1] < part + 2], "history long, t long, f long").coalesce(1).write.mode("append").parquet(str(source))
    s = spark.readStream.schema("history long, t long, f long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    q = rounds.running_detectors(s).writeStream.format("memory").queryName("detectors").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["history"], r["t"]): r["change"] for r in spark.sql("select * from detectors").collect()}
    assert got == {(h, t): f for h, t, f in rows}


def test_inverse_and_solve():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(1, 40)
        columns = [rng.getrandbits(n) for _ in range(n)]
        if len(codes.independent(columns)) < n:
            with pytest.raises(ValueError, match="dependent"):
                codes.inverse(columns)
            continue
        target = rng.getrandbits(n)
        x = codes.solve(columns, target)
        total = 0
        for i, c in enumerate(columns):
            total ^= c * (x >> i & 1)
        assert total == target
    assert codes.inverse([1, 2, 4]) == [1, 2, 4]


def test_draws_go_on_until_enough(spark):
    """With few bits most draws repeat, so many more than twice the wanted number are needed."""
    got = generators.noise_corpus(spark, 10, "seed", accepted=200)
    rows = [r["error"] for r in got.where("role = 'bsc_p_0_1'").collect()]
    assert len(rows) == len(set(rows)) == 200
    with pytest.raises(ValueError, match="only 4"):
        generators.noise_corpus(spark, 3, "seed", accepted=5)
    sample = generators.selector_sample(spark, 8, "seed", drawn=240)
    assert sample.count() == 240 + 10 and sample.select("coordinate").distinct().count() == 250


def test_archives_depend_on_contents_alone():
    a = [("b/x", b"1"), ("a", b"22")]
    assert files.tarball(a) == files.tarball(reversed(a)) != files.tarball([("b/x", b"1"), ("a", b"23")])


def test_ordinals(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (4,), (5,), (9,)], "i long")
    assert sorted(map(tuple, files.ordinal_problems(rows, "i").collect())) == [(1, "repeated"), (4, "gap before"), (9, "gap before")]


def test_separator_order_is_an_elimination_order():
    """Each variable once, and no wider than the tree's largest bag."""
    scopes = codes.scopes(codes.LADDER[0])
    bags = orders.bags(scopes, [v for v, _, _ in orders.eliminate(scopes, 30, "min_fill")])
    order = orders.separator_order(bags, *orders.rooted(bags, orders.junction_tree(bags)))
    assert sorted(order) == list(range(30))
    assert max(w["joint"] for w in orders.work(scopes, order)) == max(map(len, bags))


def test_shared_folder_is_never_made_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        bitloom.shared_folder(Session())
