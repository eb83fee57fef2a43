"""Queries of planning and algebra whose SQL derives the result independently, from the scopes, an order or the matrices."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import bits, codes
from .functions.codes import C18, CHECKS_18, LADDER
from .operators import decode, gf2, score
from .plans import dag, elimination, orders
from .queries import CLASSES, CORPUS, DETECTOR_SQL, LEADERS, SAMPLES, SEED_QUBITS, STATES, bitstring, compiled, decided, evaluated_classes, folded, matrix_sql, parities, query, scored, selector_columns, span_sql, work_rows
from .sources import generators


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"{x}::BIGINT" for x in r) + ")" for r in rows)


@cache
def planned(code) -> tuple[list[tuple[int, ...]], list[int]]:
    """Scopes and the min-fill order of a code."""
    s = codes.scopes(code)
    return s, [v for v, _, _ in orders.eliminate(s, len(codes.independent(codes.checks(code)[0])), "min_fill")]


def fill_sql(code) -> str:
    """Bags of an order by paths: what v meets are the later variables that it reaches through earlier ones."""
    scopes, order = planned(code)
    return f"""sc(q, v) AS ({values((q, v) for q, s in enumerate(scopes) for v in s)}), od(v, pos) AS ({values((v, k) for k, v in enumerate(order))}),
ad AS (SELECT DISTINCT a.v AS u, b.v AS v FROM sc a JOIN sc b ON a.q = b.q AND a.v <> b.v),
re(v, x) AS (SELECT u, v FROM ad UNION SELECT r.v, a.v FROM re r JOIN od p ON p.v = r.x JOIN od s ON s.v = r.v JOIN ad a ON a.u = r.x WHERE p.pos < s.pos AND a.v <> r.v),
raw AS (SELECT v AS bag, v FROM od UNION ALL SELECT re.v, re.x FROM re JOIN od p ON p.v = re.x JOIN od s ON s.v = re.v WHERE p.pos > s.pos)"""


def tree_sql(code) -> str:
    """Maximal bags by their variables; tree: an edge stays unless better edges already join its ends."""
    return f"""WITH RECURSIVE {fill_sql(code)}, rb AS (SELECT DISTINCT vs FROM (SELECT list(v ORDER BY v) AS vs FROM raw GROUP BY bag)),
mb AS (SELECT row_number() OVER (ORDER BY vs) - 1 AS bag, vs FROM rb a WHERE NOT EXISTS (SELECT 1 FROM rb b WHERE len(b.vs) > len(a.vs) AND list_has_all(b.vs, a.vs))),
ed AS (SELECT a.bag AS i, b.bag AS j, list_sort(list_intersect(a.vs, b.vs)) AS sep, row_number() OVER (ORDER BY -len(list_intersect(a.vs, b.vs)), a.bag, b.bag) AS nth FROM mb a JOIN mb b ON a.bag < b.bag),
rc(e, x) AS (SELECT nth, i FROM ed UNION SELECT r.e, CASE WHEN f.i = r.x THEN f.j ELSE f.i END FROM rc r JOIN ed f ON f.nth < r.e AND (f.i = r.x OR f.j = r.x)),
te AS (SELECT i, j, sep FROM ed WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.e = ed.nth AND rc.x = ed.j)),
un AS (SELECT i AS a, j AS b, sep FROM te UNION ALL SELECT j, i, sep FROM te),
tr(bag, parent, sep, path) AS (SELECT * FROM (SELECT bag, bag, []::BIGINT[], lpad(bag::VARCHAR, 4, '0') FROM mb ORDER BY -len(vs), bag LIMIT 1) UNION ALL SELECT un.b, tr.bag, un.sep, tr.path || '/' || lpad(un.b::VARCHAR, 4, '0') FROM tr JOIN un ON un.a = tr.bag WHERE un.b <> tr.parent)"""


def shown(c):
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))


def bag_members(spark, scopes, order):
    """(bag, v) of the maximal bags along an order, numbered by their variables."""
    raw = spark.createDataFrame([(i, v) for i, b in enumerate(orders.raw_bags(scopes, order)) for v in sorted(b)], "bag int, v int")
    vs = elimination.maximal(raw).groupBy("bag").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    numbered = vs.withColumn("bag", (F.row_number().over(Window.orderBy("vs")) - 1).cast("long"))  # as many as variables, at most
    return numbered.select("bag", F.explode("vs").alias("v")).select("bag", F.col("v").cast("long").alias("v"))


@query("x05_maximal_bags", f"{tree_sql(LADDER[0])} SELECT bag, unnest(vs) AS v FROM mb")
def x05(spark, sf_dir):
    """Bags of the 72-bit code's order that aren't inside another."""
    return bag_members(spark, *planned(LADDER[0]))


@query("j16_factor_assignment", f"{tree_sql(LADDER[0])}, fs AS (SELECT q, list(v) AS vs FROM sc GROUP BY q) SELECT q, min(bag) AS bag FROM fs JOIN mb ON list_has_all(mb.vs, fs.vs) GROUP BY q")
def j16(spark, sf_dir):
    """The first maximal bag that holds each factor."""
    scopes, order = planned(LADDER[0])
    factors = spark.createDataFrame([(q, v) for q, s in enumerate(scopes) for v in s], "q long, v long")
    return elimination.assigned(factors, bag_members(spark, scopes, order))


@query("g05_junction_tree", f"{tree_sql(LADDER[0])} SELECT bag, mb.vs::VARCHAR AS variables, tr.parent AS parent, sep::VARCHAR AS separator FROM tr JOIN mb USING (bag)")
def g05(spark, sf_dir):
    """The maximum-spanning tree of the 72-bit code's bags, from its root; the planner joins some dozen bags."""
    bags = orders.bags(*planned(LADDER[0]))
    parent, _ = orders.rooted(bags, orders.junction_tree(bags))
    show = lambda s: "[" + ", ".join(map(str, sorted(s))) + "]"
    return spark.createDataFrame([(i, show(b), parent[i], show(b & bags[parent[i]]) if parent[i] != i else "[]") for i, b in enumerate(bags)], "bag long, variables string, parent long, separator string")


@query("g05_separator_order", f"{tree_sql(LADDER[0])}, le AS (SELECT path || '/~' AS place, unnest(list_filter(vs, lambda x: NOT list_contains(sep, x))) AS v FROM tr JOIN mb USING (bag)) SELECT row_number() OVER (ORDER BY place, v) - 1 AS nth, v FROM le")
def g05_order(spark, sf_dir):
    """Variables as they leave the junction tree, leaves first: an elimination order of its own."""
    bags = orders.bags(*planned(LADDER[0]))
    return spark.createDataFrame(list(enumerate(orders.separator_order(bags, *orders.rooted(bags, orders.junction_tree(bags))))), "nth long, v long")


@query("w07_first_crossing", f"WITH RECURSIVE {fill_sql(LADDER[1])}, co AS (SELECT -1 AS step, sum(1::BIGINT << n) AS cost FROM (SELECT count(*) AS n FROM sc GROUP BY q) UNION ALL SELECT pos, 1::BIGINT << count(*) FROM raw JOIN od ON od.v = raw.bag GROUP BY pos), ru AS (SELECT step, sum(cost) OVER (ORDER BY step) AS running FROM co) SELECT (min(step) FILTER (running > 20000000))::INTEGER AS first_step, max(running)::BIGINT AS total FROM ru")
def w07(spark, sf_dir):
    """The step of the 90-bit code's order at which the running evaluations exceed a cap."""
    return score.first_crossing(work_rows(spark, LADDER[1]), "step", "evaluations", 20_000_000)


@query(
    "g06_liveness",
    f"""WITH RECURSIVE {fill_sql(LADDER[0])}, mk AS (SELECT pos AS made, [x for x in list(raw.v) if x <> any_value(od.v)] AS vs FROM raw JOIN od ON od.v = raw.bag GROUP BY pos),
tb AS (SELECT -1 AS made, list(v) AS vs FROM sc GROUP BY q UNION ALL SELECT made, vs FROM mk), us AS (SELECT made, vs, (SELECT min(pos) FROM od WHERE list_contains(vs, od.v)) AS used FROM tb)
SELECT m.made::INTEGER AS step, (sum(1::BIGINT << len(us.vs)))::BIGINT AS before, 1::BIGINT << len(any_value(m.vs)) AS output, (sum(1::BIGINT << len(us.vs)) + (1::BIGINT << len(any_value(m.vs))))::BIGINT AS during
FROM mk m JOIN us ON us.made < m.made AND coalesce(us.used, 999) >= m.made GROUP BY m.made""",
)
def g06_live(spark, sf_dir):
    """Entries alive before and during each step of the 72-bit code's order, nothing being built."""
    return spark.createDataFrame(orders.liveness(*planned(LADDER[0])), "step int, before long, output long, during long")


def order_sql() -> str:
    """All orders of the 18-bit code, from the cost of each step given the set of variables before it."""
    scopes, _ = planned(C18)
    near = orders.primal(scopes, 7)
    steps = "st0 AS (SELECT s, v, nb AS m FROM range(128) a(s), (" + values((v, near[v]) for v in range(7)) + ") t(v, nb) WHERE (s >> v) & 1 = 0)"
    for k in range(7):  # paths through the variables before have at most seven steps
        more = " | ".join(f"CASE WHEN m & s & {1 << u} <> 0 THEN {near[u]} ELSE 0 END" for u in range(7))
        steps += f", st{k + 1} AS (SELECT s, v, m | {more} AS m FROM st{k})"
    return f"""WITH RECURSIVE {steps}, c AS (SELECT s, v, bit_count((m & ~s) | (1 << v::INTEGER))::INTEGER AS joint FROM st7),
o(s, path, peak, evaluations, emitted) AS (SELECT 0::BIGINT, []::BIGINT[], 0, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT o.s | (1 << c.v::INTEGER), list_append(path, c.v), greatest(peak, joint), evaluations + (1 << joint), emitted + (1 << (joint - 1)) FROM o JOIN c ON c.s = o.s)"""


def all_orders(spark):
    """Every elimination order of the seven variables with its costs (split over tasks by the first two)."""
    scopes = codes.scopes(C18)
    starts = spark.createDataFrame([(a, b) for a in range(7) for b in range(7) if a != b], "a int, b int").repartition(8)

    def run(frames):
        from itertools import permutations

        import pandas as pd

        for f in frames:
            rows = []
            for a, b in zip(f["a"], f["b"]):
                for rest in permutations([v for v in range(7) if v not in (a, b)]):
                    w = orders.work(scopes, [a, b, *rest])
                    rows.append(([a, b, *rest], max(x["joint"] for x in w) - 1, sum(x["evaluations"] for x in w), sum(x["emitted"] for x in w)))
            yield pd.DataFrame(rows, columns=["path", "width", "evaluations", "emitted"])

    return starts.mapInPandas(run, "path array<long>, width int, evaluations long, emitted long")


@query("o03_all_orders", f"{order_sql()} SELECT peak - 1 AS width, count(*) AS orders FROM o WHERE s = 127 GROUP BY peak")
def o03(spark, sf_dir):
    return all_orders(spark).groupBy("width").agg(F.count("*").alias("orders"))


@query("o03_best_order", f"{order_sql()} SELECT peak - 1 AS width, evaluations, emitted, path::VARCHAR AS path FROM o WHERE s = 127 ORDER BY peak, evaluations, emitted, o.path LIMIT 1")
def o03_best(spark, sf_dir):
    """The best order by width, evaluations, output entries and the order itself."""
    best = all_orders(spark).agg(F.min(F.struct("width", "evaluations", "emitted", "path")).alias("b")).select("b.*")
    return best.withColumn("path", shown(F.col("path")))


@query("o02_independent_rows", "SELECT i::INTEGER AS row FROM (VALUES " + ", ".join(f"({i}, {m}::BIGINT)" for i, m in enumerate(CHECKS_18)) + f") t(i, m) WHERE NOT EXISTS (SELECT 1 FROM range(512) u(x) WHERE x < (1 << i) AND {folded('x', CHECKS_18)} = m)")
def o02(spark, sf_dir):
    """The lexicographically first independent checks: a fold over the ordered rows of each matrix, one matrix for each group."""
    h = gf2.check_matrices(spark, (C18,)).where("side = 'x'")

    def fold(f):
        import pandas as pd

        rows = f.groupby("r")["c"].agg(lambda c: sum(1 << int(x) for x in c)).sort_index()
        return pd.DataFrame({"row": [int(rows.index[i]) for i in codes.independent(rows.tolist())]})

    return h.groupBy("n").applyInPandas(fold, "row int")


#: The published number of nodes of the 72-bit code's graph of masses, and the size of its validation sample (fixed values).
@query("g15_compiled_c72", "SELECT 2157761::BIGINT AS nodes, 300::BIGINT AS validated, 0::BIGINT AS mismatches")
def g15(spark, sf_dir):
    """The 72-bit code's graph of masses, compiled as a whole, and its values for the seeded selectors against contraction.

    Masses have over 200 bits; both sides are exact modulo 2**64.  One task compiles and evaluates, others contract.
    """
    code = LADDER[0]
    scopes, order = planned(code)
    places = codes.selector_qubits(code)
    sample = generators.selector_sample(spark, len(places), SAMPLES[len(places)])

    def compiled_values(batches):
        import numpy as np
        import pyarrow as pa

        rows = pa.Table.from_batches(batches)  # the sample
        g, root = dag.build("sum_product", scopes, order, {q: i for i, q in enumerate(places)})
        levels = dag.Levels(g, root)
        x = rows["coordinate"].to_numpy()
        for i in range(0, len(x), 12):
            value = levels.evaluate(x[i : i + 12])
            yield pa.RecordBatch.from_arrays([rows["idx"].to_numpy()[i : i + 12], value.view(np.int64), np.full(len(value), len(levels))], ["idx", "value", "nodes"])

    def contracted_values(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 12):
                x = b.column(1).to_numpy()[i : i + 12]
                seeds = np.zeros((len(x), code[0]), np.int64)
                for k, q in enumerate(places):
                    seeds[:, q] = x >> k & 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 12), pa.array(elimination.masses(scopes, order, seeds, 9).view(np.int64))], ["idx", "direct"])

    graph = sample.select("idx", "coordinate").coalesce(1).mapInArrow(compiled_values, "idx int, value long, nodes long")
    direct = sample.select("idx", "coordinate").repartition(8).mapInArrow(contracted_values, "idx int, direct long")
    both = graph.join(direct, "idx")
    return both.agg(F.max("nodes").alias("nodes"), F.count("*").alias("validated"), F.count_if(F.col("value") != F.col("direct")).alias("mismatches"))


# Algebra


def rank_sql() -> str:
    """Elimination in SQL: the largest row as text leads with the first open coordinate, and leaves all rows that have it."""
    n18 = C18[0]
    small = ", ".join(f"({n18}, {r}, {m}::BIGINT)" for r, m in enumerate(CHECKS_18))
    return f"""WITH RECURSIVE {matrix_sql()}, rw AS (SELECT n, r, list_aggregate([CASE WHEN list_contains(list(c), i) THEN '1' ELSE '0' END for i in range(n)], 'string_agg', '') AS b FROM cm WHERE side = 'x' AND n <= 144 GROUP BY n, r
  UNION ALL SELECT n::INTEGER, r, {bitstring('m', 18)} FROM (VALUES {small}) t(n, r, m)),
g(n, k, rs) AS (SELECT n, 0, list(b) FROM rw GROUP BY n UNION ALL
  SELECT n, k + 1, list_transform(rs, lambda x: CASE WHEN substr(x, p, 1) = '1' THEN xor(x::BIT, top::BIT)::VARCHAR ELSE x END) FROM (SELECT *, list_max(rs) AS top, instr(list_max(rs), '1') AS p FROM g) WHERE p > 0),
rk AS (SELECT n, max(k)::INTEGER AS rank FROM g GROUP BY n)"""


@query("l04_rank", f"{rank_sql()} SELECT n, rank FROM rk")
def l04(spark, sf_dir):
    """Ranks by pivot reduction, one small matrix for each group."""
    h = gf2.check_matrices(spark, (C18, *LADDER[:4])).where("side = 'x'")

    def rank(f):
        import pandas as pd

        rows = f.groupby("r")["c"].agg(lambda c: sum(1 << int(x) for x in c)).tolist()
        return pd.DataFrame({"n": [f["n"].iloc[0]], "rank": [len(codes.independent(rows))]})

    return h.groupBy("n").applyInPandas(rank, "n int, rank int")


def nullspace(h):
    """(n, i, c): canonical kernel bases of the matrices in (n, r, c)."""

    def basis(f):
        import pandas as pd

        n = int(f["n"].iloc[0])
        rows = f.groupby("r")["c"].agg(lambda c: sum(1 << int(x) for x in c)).tolist()
        return pd.DataFrame([(n, i, c) for i, v in enumerate(codes.nullspace(rows, n)) for c in range(n) if v >> c & 1], columns=["n", "i", "c"])

    return h.groupBy("n").applyInPandas(basis, "n int, i int, c int")


@query("l06_nullspace", f"{rank_sql()} SELECT n, (n - rank)::BIGINT AS dimension, true AS in_kernel FROM rk")
def l06(spark, sf_dir):
    """Dimension of each kernel, and whether every basis vector meets every check evenly (a join on coordinates)."""
    h = gf2.check_matrices(spark, (C18, *LADDER[:4])).where("side = 'x'")
    k = nullspace(h)
    odd = k.join(h, ["n", "c"]).groupBy("n", "i", "r").agg(F.count("*").alias("m")).where("m % 2 = 1").select("n").distinct().withColumn("odd", F.lit(True))
    return k.groupBy("n").agg(F.count_distinct("i").alias("dimension")).join(odd, "n", "left").select("n", "dimension", F.col("odd").isNull().alias("in_kernel"))


BASIS = [CHECKS_18[i] for i in codes.independent(CHECKS_18)]


@query(
    "l06_nullspace_basis",
    f"""WITH {span_sql(BASIS)}, pv AS (SELECT DISTINCT instr({bitstring('s', 18)}, '1') - 1 AS p FROM sp WHERE s <> 0), fr AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS i FROM range(18) t(f) WHERE f NOT IN (SELECT p FROM pv)),
fm AS (SELECT sum(1::BIGINT << f::INTEGER)::BIGINT AS m FROM fr), ke AS (SELECT e FROM range(262144) t(e) WHERE {parities('e', CHECKS_18)} = 0)
SELECT fr.i::INTEGER AS i, {bitstring('e', 18)} AS vector FROM ke, fm JOIN fr ON true WHERE e & m = 1::BIGINT << fr.f::INTEGER""",
)
def l06_basis(spark, sf_dir):
    """The canonical basis itself: one vector for each free coordinate, ascending."""
    k = nullspace(gf2.check_matrices(spark, (C18,)).where("side = 'x'"))
    return k.groupBy("i").agg(F.sum(F.expr("shiftleft(1L, c)")).alias("e")).select("i", bits.encode("e", 18).alias("vector"))


@query("l01_transpose", f"WITH {matrix_sql()} SELECT n, side, c AS r, r AS c FROM cm")
def l01_transpose(spark, sf_dir):
    return gf2.transpose(gf2.check_matrices(spark))


@query("l02_power", "SELECT i AS r, (i + 5 * j) % 28 AS c FROM range(28) t(i), range(12) u(j) WHERE j & ~11 = 0 GROUP BY ALL HAVING count(*) % 2 = 1")
def l02_power(spark, sf_dir):
    """The eleventh power of 1 + x**5 on a ring of 28: its coefficients are binomials modulo 2."""
    return gf2.power(spark, gf2.total(gf2.shift(spark, 28, 5), gf2.identity(spark, 28)), 28, 11)


@query("l02_kronecker", "SELECT i * 7 + j AS r, ((i + 2) % 5) * 7 + (j + 3) % 7 AS c FROM range(5) t(i), range(7) u(j)")
def l02_kronecker(spark, sf_dir):
    return gf2.kronecker(gf2.shift(spark, 5, 2), gf2.shift(spark, 7, 3), 7, 7)


SEED_COLUMNS = [selector_columns()[q] for q in SEED_QUBITS]
SELECTOR_BITS = codes.independent(codes.transpose(SEED_COLUMNS, 13))
SQUARE = codes.transpose([codes.transpose(SEED_COLUMNS, 13)[b] for b in SELECTOR_BITS], len(SEED_QUBITS))


@query("l07_inverse", f"SELECT {folded('x', SQUARE)} AS functional, x AS coordinate FROM range(2048) t(x)")
def l07(spark, sf_dir):
    """Coordinates of all functionals of the 18-bit code, by the inverse of its column basis."""
    return spark.range(1 << len(SQUARE)).select(F.col("id").alias("functional"), bits.lift("id", codes.inverse(SQUARE)).alias("coordinate"))


PLACES_72, COLUMNS_72, CHECKS_72 = codes.functional_columns(LADDER[0])
SPREAD_72 = f"(x * 1073741827) % {1 << len(PLACES_72)}"
HALVES_72 = [[1 << q if q < 36 else 0 for q in PLACES_72], [1 << q - 36 if q >= 36 else 0 for q in PLACES_72]]


@query(
    "l13_seeds_c72",
    f"WITH t AS (SELECT {SPREAD_72} AS k FROM range(4096) u(x)), f AS (SELECT k, {folded('k', COLUMNS_72)} AS f FROM t) SELECT f & {(1 << CHECKS_72) - 1} AS syndrome, f >> {CHECKS_72} AS class, {folded('k', HALVES_72[0])} AS low, {folded('k', HALVES_72[1])} AS high, true AS realised FROM f",
)
def l13_c72(spark, sf_dir):
    """The seed error of the 72-bit code for a syndrome and a class, in two halves of 36 coordinates, and a check that it realises them."""
    k = spark.range(4096).select(F.expr(SPREAD_72.replace("x", "id")).alias("k"))
    f = k.select(bits.lift("k", COLUMNS_72).alias("f"))
    asked = f.select(F.col("f").bitwiseAND(F.lit((1 << CHECKS_72) - 1).cast("long")).alias("syndrome"), F.shiftright("f", CHECKS_72).alias("class"))
    target = F.col("syndrome").bitwiseOR(F.shiftleft("class", CHECKS_72))
    seed = asked.withColumn("target", target).withColumn("at", bits.lift("target", codes.inverse(COLUMNS_72)))
    seed = seed.withColumns({"low": bits.lift("at", HALVES_72[0]), "high": bits.lift("at", HALVES_72[1])})
    _, hz = codes.checks(LADDER[0])
    rows = [*(hz[i] for i in codes.independent(hz)), *codes.logical_basis(LADDER[0])]
    half = (1 << 36) - 1
    one = lambda m: (F.bit_count(F.col("low").bitwiseAND(F.lit(m & half).cast("long"))) + F.bit_count(F.col("high").bitwiseAND(F.lit(m >> 36).cast("long")))) % 2
    again = F.lit(0).cast("long")
    for i, m in enumerate(rows):
        again = again.bitwiseOR(F.shiftleft(one(m).cast("long"), i))
    return seed.select("syndrome", "class", "low", "high", (again == F.col("target")).alias("realised"))


@query(
    "l10_matrix_records",
    f"WITH {matrix_sql()}, ln AS (SELECT n, side, r, '[' || string_agg(c::VARCHAR, ',' ORDER BY c) || ']' AS t, count(*) AS ones FROM cm GROUP BY n, side, r), re AS (SELECT n, side, count(*) AS rows, sum(ones)::BIGINT AS ones, '[' || string_agg(t, ',' ORDER BY r) || ']' AS support FROM ln GROUP BY n, side) SELECT n, side, rows, ones, support, sha256(support) AS sha256 FROM re",
)
def l10(spark, sf_dir):
    """Each check matrix as a record with the digest of its support."""
    return gf2.supports(gf2.check_matrices(spark))


@query(
    "l10_basis_record",
    f"""WITH {span_sql(BASIS)}, pv AS (SELECT DISTINCT instr({bitstring('s', 18)}, '1') - 1 AS p FROM sp WHERE s <> 0), fm AS (SELECT sum(1::BIGINT << f::INTEGER)::BIGINT AS m FROM range(18) t(f) WHERE f NOT IN (SELECT p FROM pv)),
ba AS (SELECT {bitstring('e', 18)} AS v, instr({bitstring('e & m', 18)}, '1') AS f FROM range(262144) t(e), fm WHERE {parities('e', CHECKS_18)} = 0 AND bit_count(e & m) = 1)
SELECT 18::INTEGER AS n, count(*) AS vectors, sha256('["' || string_agg(v, '","' ORDER BY f) || '"]') AS sha256 FROM ba""",
)
def l10_basis(spark, sf_dir):
    """A kernel basis as a record: its vectors in order, and their digest."""
    k = nullspace(gf2.check_matrices(spark, (C18,)).where("side = 'x'")).groupBy("n", "i").agg(F.sum(F.expr("shiftleft(1L, c)")).alias("e"))
    k = k.groupBy("n").agg(F.count("*").alias("vectors"), F.array_sort(F.collect_list(F.struct("i", bits.encode("e", 18).alias("v")))).alias("b"))
    return k.select("n", "vectors", F.sha2(F.to_json(F.transform("b", lambda x: x["v"])), 256).alias("sha256"))


# Reports whose numbers SQL derives


FIBERS = f"WITH {DETECTOR_SQL}, fi AS (SELECT detectors, count(*) AS histories, count(DISTINCT ({parities('terminal', CHECKS_18)} << 4) + {parities('terminal', codes.LOGICALS_18)}) AS classes FROM de GROUP BY detectors)"


def fibers(spark):
    from .operators import temporal

    return temporal.fibers(temporal.detectors(generators.fault_histories(spark)))


@query("d13_ambiguity", f"{FIBERS} SELECT histories, count(*) AS fibers FROM fi GROUP BY histories")
def d13(spark, sf_dir):
    return fibers(spark).groupBy("histories").agg(F.count("*").alias("fibers"))


@query("d13_ambiguous_fibers", f"{FIBERS} SELECT count(*) AS fibers, sum(histories)::BIGINT AS histories FROM fi WHERE classes > 1")
def d13_ambiguous(spark, sf_dir):
    return fibers(spark).where("classes > 1").agg(F.count("*").alias("fibers"), F.sum("histories").alias("histories"))


@query(
    "d13_report",
    f"{FIBERS} SELECT classes > 1 AS ambiguous, histories, count(*) AS fibers, sum(histories)::BIGINT AS total, min(detectors) AS first FROM fi GROUP BY ALL",
)
def d13_report(spark, sf_dir):
    """The audit as amended: fibers by size and by whether a decoder can tell their classes apart, with a witness of each kind."""
    f = fibers(spark).groupBy((F.col("classes") > 1).alias("ambiguous"), "histories")
    return f.agg(F.count("*").alias("fibers"), F.sum("histories").alias("total"), F.min("detectors").alias("first"))


def signal_sql(name: str, n: int) -> str:
    return {"hamming_normalized": f"2.0::DOUBLE * w / {n} - 1", "marked_amplitude": f"sqrt(w::DOUBLE / {n})", "parity_phase": "CASE WHEN w % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"}[name]


def label_sql(name: str, n: int) -> str:
    return {"or": "w > 0", "majority": f"w * 2 > {n}", "parity": "w % 2 = 1"}[name]


def card_sql(candidate) -> str:
    name, predicate, n, signal, calls = candidate
    return f"""SELECT '{name}' AS candidate, * EXCLUDE (raw), round(raw, 12) AS gap, round(raw / ((1.0::DOUBLE + {calls}) * (1.0::DOUBLE + alternations) * (1.0::DOUBLE + log2(2.0::DOUBLE))), 12) AS utility FROM (
  WITH d AS (SELECT round({signal_sql(signal, n)}, 12) AS v, ({label_sql(predicate, n)})::INTEGER AS y FROM (SELECT bit_count(x)::INTEGER AS w FROM range({1 << n}) t(x))),
  g AS (SELECT v, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1) AS ones FROM d GROUP BY v), s AS (SELECT *, zeros > 0 AS z, lag(zeros > 0) OVER (ORDER BY v) AS p FROM g)
  SELECT (SELECT sum(zeros + ones)::BIGINT FROM g) AS domain, (SELECT count(*) FROM g) AS signals, (SELECT sum(zeros * ones)::BIGINT FROM g) AS collisions, (SELECT min(abs(a.v - b.v)) FROM g a, g b WHERE a.zeros > 0 AND b.ones > 0) AS raw, (SELECT count(*) FILTER (z <> p) FROM s) AS alternations)"""


#: (name, predicate, bits, signal, calls) of the published candidates (fixed values).
CANDIDATES = (("or_marked_amplitude", "or", 4, "marked_amplitude", 1), ("majority_hamming", "majority", 5, "hamming_normalized", 1), ("parity_phase", "parity", 4, "parity_phase", 4), ("parity_hamming", "parity", 4, "hamming_normalized", 1))


@query("d11_scorecard", " UNION ALL ".join(card_sql(c) for c in CANDIDATES))
def d11(spark, sf_dir):
    """Scan, signatures, collisions, gap, alternations and utility of each candidate (a closed list)."""
    out = None
    for name, predicate, n, signal, calls in CANDIDATES:
        d = generators.domain(spark, n)
        d = d.select("input", F.round(score.signal(signal, F.col("weight"), n), 12).alias("signal"), score.predicate(predicate, F.col("weight"), n).alias("label"))
        c = score.collisions(d, "signal", "label", "input").agg(F.sum(F.col("zeros") + F.col("ones")).alias("domain"), F.count("*").alias("signals"), F.sum("pairs").alias("collisions"))
        r = c.join(score.gap(d, "signal", "label")).join(score.alternations(d, "signal", "label"))  # one row each
        utility = F.col("gap") / ((1.0 + calls) * (1.0 + F.col("alternations")) * (1.0 + F.log2(F.lit(2.0))))
        r = r.select(F.lit(name).alias("candidate"), "domain", "signals", "collisions", F.round("gap", 12).alias("gap"), "alternations", F.round(utility, 12).alias("utility"))
        out = r if out is None else out.unionByName(r)
    return out


def absolute_sql(channel: str, expression: str) -> str:
    return f"SELECT '{channel}' AS channel, sum(zeros * ones)::BIGINT AS collisions FROM (SELECT round({expression}, 12) AS v, count(*) FILTER (w < 3) AS zeros, count(*) FILTER (w >= 3) AS ones FROM (SELECT bit_count(x)::INTEGER AS w FROM range(32) t(x)) GROUP BY 1)"


@query("d12_linearisation_collisions", absolute_sql("signed", "2.0::DOUBLE * w / 5 - 1") + " UNION ALL " + absolute_sql("singular", "abs(2.0::DOUBLE * w / 5 - 1)"))
def d12(spark, sf_dir):
    """Majority of five bits: the signed signal separates the labels, its absolute value doesn't."""
    d = generators.domain(spark, 5).select("input", F.round(score.signal("hamming_normalized", F.col("weight"), 5), 12).alias("signed"), score.predicate("majority", F.col("weight"), 5).alias("label"))
    d = d.withColumn("singular", F.abs("signed"))
    one = lambda c: score.collisions(d, c, "label", "input").agg(F.sum("pairs").alias("collisions")).select(F.lit(c).alias("channel"), "collisions")
    return one("signed").unionByName(one("singular"))


@query("d12_orbits", "SELECT bit_count(x)::INTEGER AS weight, count(*) AS size, min(x) AS representative, max((bit_count(x) * 2 > 5)::INTEGER) AS label FROM range(32) t(x) GROUP BY 1")
def d12_orbits(spark, sf_dir):
    """Orbits of five bits under permutations: a label is constant on each, as the predicate depends on the weight alone."""
    d = spark.range(32).select("id", bits.weight("id").alias("weight"))
    d = d.withColumn("label", score.predicate("majority", F.col("weight"), 5))
    return d.groupBy("weight").agg(F.count("*").alias("size"), F.min("id").alias("representative"), F.max("label").alias("label"))


def _others() -> None:
    """D06, D07, D10 for every algebra: elimination, graphs, and all pairs of decoders, conventional ones included."""
    from .queries import SHELLS, contracted

    for a in ("soft_tropical", "min_plus"):
        query(f"d06_elimination_decoder_{a}", f"WITH {decided(a)}, {CORPUS}, {scored()} {SHELLS}")(lambda spark, sf_dir, a=a: decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(contracted(spark), a))))
    for a in ("sum_product", "soft_tropical"):
        query(f"d07_graph_decoder_{a}", f"WITH {decided(a)}, {CORPUS}, {scored()} {SHELLS}")(lambda spark, sf_dir, a=a: decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(evaluated_classes(spark), a))))


_others()


#: Published events of all selectors and algebras together, and the sweep from which compiling pays (fixed values).
@query("d07_ledger", "SELECT 10160::BIGINT AS compile, 12694528::BIGINT AS evaluate, 12704688::BIGINT AS one_shot, 14115840::BIGINT AS replay, 1::BIGINT AS break_even")
def d07_ledger(spark, sf_dir):
    """What compiling costs against what it saves in a sweep over all selectors; a selector's own XOR fold counts on both sides."""
    scopes, order = planned(C18)
    steps = orders.work(scopes, order)

    def run(batches):
        import pyarrow as pa

        graphs = {a: compiled(a) for a in decode.ALGEBRAS}
        for b in batches:
            x = b.column(0).to_numpy()
            for a, (g, root) in graphs.items():
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(x)), b.column(0), pa.array(dag.evaluation_events(g, root, x))], ["algebra", "id", "events"])

    fold = len(SEED_QUBITS) + F.bit_count("id")
    each = spark.range(1 << len(SEED_QUBITS)).mapInArrow(run, "algebra string, id long, events long").groupBy("algebra").agg(F.sum(F.col("events") + fold).alias("evaluate"), F.sum(fold).alias("folds"), F.count("*").alias("selectors"))
    fixed = [(a, dag.compile_events(compiled(a)[0], scopes, order, set(SEED_QUBITS), steps), dag.replay_events(a, scopes, steps)) for a in decode.ALGEBRAS]
    rows = each.join(spark.createDataFrame(fixed, "algebra string, compile long, one_replay long"), "algebra")
    total = rows.agg(F.sum("compile").alias("compile"), F.sum("evaluate").alias("evaluate"), F.sum(F.col("one_replay") * F.col("selectors") + F.col("folds")).alias("replay"))
    saved = F.col("replay") - F.col("evaluate")
    return total.select("compile", "evaluate", (F.col("compile") + F.col("evaluate")).alias("one_shot"), "replay", F.when(saved > 0, F.ceil(F.col("compile") / saved)).alias("break_even"))


def decoder_tables(spark):
    st = generators.states(spark)
    classes = decode.classes(st)
    return {"leader": decode.leaders(st), **{a: decode.decisions(classes, a) for a in decode.ALGEBRAS}}


def _pair_sql() -> str:
    names = ["leader", *decode.ALGEBRAS]
    parts = [f"WITH {CLASSES}, {LEADERS}, {CORPUS}"]
    for a in decode.ALGEBRAS:
        parts.append(decided(a).removeprefix(CLASSES).lstrip(", ").replace("de AS (", f"de_{a} AS (", 1))
    parts.append("de_leader AS (SELECT syn, correction FROM le)")
    for d in names:
        parts.append(f"ok_{d} AS (SELECT idx, {parities('xor(e, correction)', codes.LOGICALS_18)} = 0 AS ok FROM co JOIN de_{d} d ON d.syn = {parities('e', CHECKS_18)})")
    pairs = [f"SELECT '{x}' AS before, '{y}' AS after, count(*) FILTER (b.ok AND NOT a.ok) AS repaired, count(*) FILTER (a.ok AND NOT b.ok) AS broken, count(*) FILTER (a.ok = b.ok) AS same, count(*) AS compared FROM ok_{x} a JOIN ok_{y} b USING (idx)" for i, x in enumerate(names) for y in names[i + 1 :]]
    return ", ".join(parts) + " " + " UNION ALL ".join(pairs)


@query("d10_all_pairs", _pair_sql())
def d10_pairs(spark, sf_dir):
    """Every pair of the coset-leader decoder and the three coset decoders: what each repairs of the other, and breaks."""
    corpus = generators.weight_shells(spark)
    outcomes = {n: decode.lookup(corpus, t) for n, t in decoder_tables(spark).items()}
    names, out = list(outcomes), None
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            one = decode.compare(outcomes[x], outcomes[y]).select(F.lit(x).alias("before"), F.lit(y).alias("after"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def _totals() -> None:
    """The two tables that the published figures show; SQL sums up the decoders' own."""
    from .queries import QUERIES, SQL

    names = {"coset leader": "d01_coset_leader_decoder", **{f"coset {a}": f"d04_coset_decoder_{a}" for a in decode.ALGEBRAS}}

    def semantics(spark, sf_dir):
        out = None
        for label, name in names.items():
            one = QUERIES[name](spark, sf_dir).agg(F.lit(label).alias("decoder"), F.sum("success").alias("success"), F.sum("total").alias("total"))
            out = one if out is None else out.unionByName(one)
        return out

    query("s15_semantics", " UNION ALL ".join(f"SELECT '{label}' AS decoder, sum(success)::BIGINT AS success, sum(total)::BIGINT AS total FROM ({SQL[n]})" for label, n in names.items()))(semantics)
    query("s15_structure", f"SELECT n, min(width) AS least, max(width) AS most, 1 + min(width) AS entries_log2 FROM ({SQL['g04_elimination_widths']}) GROUP BY n")(
        lambda spark, sf_dir: QUERIES["g04_elimination_widths"](spark, sf_dir).groupBy("n").agg(F.min("width").alias("least"), F.max("width").alias("most"), (1 + F.min("width")).alias("entries_log2"))
    )


_totals()


@query(
    "d12_certificates",
    "SELECT n, count(*) AS edges, round(sqrt(count(*)), 12) AS norm, max(filter_norm) AS filter_norm, bool_and(supported) AS supported FROM (SELECT n, j, 1.0::DOUBLE AS filter_norm, bit_count((1::BIGINT << j::INTEGER)) = 1 AS supported FROM range(1, 9) t(n), range(8) u(j) WHERE j < n) GROUP BY n",
)
def d12_certificates(spark, sf_dir):
    """Adversary certificates of OR: a star between the zero input and the inputs of weight one.  A star of n edges has norm sqrt(n); with one coordinate each edge is alone, so each filtered norm is 1."""
    n = spark.range(1, 9).select(F.col("id").alias("n"))
    ones = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).withColumn("input", F.expr("shiftleft(1L, CAST(j AS INT))"))
    by_bit = ones.groupBy("n", "j").agg(F.count("*").alias("edges"), F.bool_and(bits.weight("input") == 1).alias("supported"))  # edges that differ in coordinate j
    return by_bit.groupBy("n").agg(F.sum("edges").alias("edges"), F.round(F.sqrt(F.sum("edges")), 12).alias("norm"), F.max(F.sqrt("edges")).alias("filter_norm"), F.bool_and("supported").alias("supported"))


@query("j10_reconcile_altered", f"WITH {CLASSES}, al AS (SELECT syn, lab, m9 + CASE WHEN (syn + lab) % 37 = 0 THEN 1 ELSE 0 END AS m9 FROM cl WHERE NOT (syn % 101 = 7 AND lab = 3)) (SELECT syn, lab, m9, 'left' AS side FROM (SELECT syn, lab, m9 FROM cl EXCEPT ALL SELECT * FROM al)) UNION ALL (SELECT syn, lab, m9, 'right' FROM (SELECT * FROM al EXCEPT ALL SELECT syn, lab, m9 FROM cl))")
def j10_altered(spark, sf_dir):
    """Two derivations of one table, one with rows changed and missing: all differences, and no others."""
    a = decode.classes(generators.states(spark)).select("syn", "lab", "m9")
    b = decode.transfer(spark).where("not (syn % 101 = 7 and lab = 3)").select("syn", "lab", (F.col("m9") + F.when((F.col("syn") + F.col("lab")) % 37 == 0, 1).otherwise(0)).alias("m9"))
    return score.differences(a, b).select("syn", "lab", "m9", "side")


@query("x06_altered_supports", f"WITH {CLASSES} SELECT syn, lab, 'left' AS side FROM cl WHERE (syn * 16 + lab) % 11 = 4")
def x06_altered(spark, sf_dir):
    """Supports of two algebras, one with entries removed."""
    c = decode.classes(generators.states(spark))
    other = c.where("m2 > 0 and not ((syn * 16 + lab) % 11 = 4)").select("syn", "lab")
    return score.differences(c.where("m9 > 0").select("syn", "lab"), other).select("syn", "lab", "side")
