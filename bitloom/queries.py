"""Named queries of the engine, each with the SQL that gives the same rows.

``query(name, sql)`` registers a function (spark, sf_dir) -> DataFrame.  Where
``sql`` is None, tests compare the query with an independent formulation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bits, codes, records, variants
from .functions.codes import C18, CHECKS_18, LADDER, LOGICALS_18
from .operators import decode, gf2, score, temporal
from .plans import dag, elimination, orders
from .sources import generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces for generated relations


def parities(x: str, masks: list[int]) -> str:
    return "(" + " + ".join(f"((bit_count({x} & {m})::BIGINT % 2) << {i})" for i, m in enumerate(masks)) + ")"


def powers(base: int, exponent: str, most: int) -> str:
    return f"([{', '.join(f'{base**i}::BIGINT' for i in range(most + 1))}])[{exponent} + 1]"


def bitstring(x: str, width: int) -> str:
    return f"reverse(lpad(bin({x}), {width}, '0'))"


STATES = f"""st AS (
  SELECT e, bit_count(e)::INTEGER AS w, {parities('e', CHECKS_18)} AS syn, {parities('e', LOGICALS_18)} AS lab,
         {powers(9, '(18 - bit_count(e)::INTEGER)', 18)} AS m9, {powers(2, '(18 - bit_count(e)::INTEGER)', 18)} AS m2
  FROM range(262144) t(e)
)"""
CLASSES = STATES + """, cl AS (
  SELECT syn, lab, sum(m9)::BIGINT AS m9, sum(m2)::BIGINT AS m2, min(w * 262144 + e) // 262144 AS w, min(w * 262144 + e) % 262144 AS rep, min(e) AS key, count(*) AS n
  FROM st GROUP BY syn, lab
)"""
CORPUS = f"""co AS (
  SELECT e, bit_count(e)::INTEGER AS w, row_number() OVER (ORDER BY bit_count(e), {bitstring('e', 18)} DESC) - 1 AS idx
  FROM range(262144) t(e) WHERE bit_count(e) <= 4
)"""
ORDER_OF = {"sum_product": "m9 DESC", "soft_tropical": "m2 DESC", "min_plus": "w ASC"}


def decided(algebra: str) -> str:
    return f"""{CLASSES}, de AS (
  SELECT syn, rep AS correction FROM (SELECT *, row_number() OVER (PARTITION BY syn ORDER BY {ORDER_OF[algebra]}, key) AS nth FROM cl) WHERE nth = 1
)"""


def scored(table_: str = "de") -> str:
    """Outcomes (idx, w, success) of corpus errors under a table of corrections."""
    return f"""oc AS (
  SELECT idx, co.w, {parities('xor(e, correction)', CHECKS_18)} = 0 AND {parities('xor(e, correction)', LOGICALS_18)} = 0 AS success
  FROM co JOIN {table_} d ON d.syn = {parities('e', CHECKS_18)}
)"""


SHELLS = "SELECT w, count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failure FROM oc GROUP BY w"

# Sources


@query("s01_domain_scan", "SELECT x AS ord, lpad(bin(x), 5, '0') AS input, bit_count(x)::INTEGER AS weight FROM range(32) t(x) WHERE bit_count(x) IN (1, 3)")
def s01(spark, sf_dir):
    return generators.domain(spark, 5, [1, 3])


@query("s02_state_space", "SELECT e AS id FROM range(262144) t(e)")
def s02(spark, sf_dir):
    return spark.range(1 << 18)


@query("s03_weight_shells", f"WITH {CORPUS} SELECT idx, w, {bitstring('e', 18)} AS error FROM co")
def s03(spark, sf_dir):
    return generators.weight_shells(spark).select("idx", "w", bits.encode("e", 18).alias("error"))


FAULTS = """fa AS (
  SELECT NULL::INTEGER AS a, NULL::INTEGER AS b UNION ALL SELECT a::INTEGER, NULL FROM range(75) t(a)
  UNION ALL SELECT a::INTEGER, b::INTEGER FROM range(75) t(a), range(75) u(b) WHERE a < b
), fo AS (
  SELECT a, b, (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER AS fault_weight FROM fa
), fh AS (
  SELECT *, row_number() OVER (ORDER BY fault_weight, a, b) - 1 AS idx FROM fo
)"""


@query("s04_temporal_faults", f"WITH {FAULTS} SELECT idx, fault_weight, list_aggregate([CASE WHEN i = a OR i = b THEN '1' ELSE '0' END for i in range(75)], 'string_agg', '') AS fault_history FROM fh")
def s04(spark, sf_dir):
    h = generators.fault_histories(spark)
    mark = F.transform(F.sequence(F.lit(0), F.lit(74)), lambda i: F.when((i == F.col("a")) | (i == F.col("b")), "1").otherwise("0"))
    return h.select("idx", "fault_weight", F.concat_ws("", mark).alias("fault_history"))


def noise_sql(width: int, seed: str) -> str:
    return f"""
WITH d AS (
  SELECT k, c, CASE WHEN substr(sha256('{seed}'::BLOB || unhex(lpad(hex(k), 16, '0')) || unhex(lpad(hex(c), 8, '0'))), 1, 16) < '{generators.TENTH}' THEN '1' ELSE '0' END AS bit
  FROM range(512) t(k), range({width}) u(c)
), v AS (
  SELECT k, string_agg(bit, '' ORDER BY c) AS error FROM d GROUP BY k
), f AS (
  SELECT error, min(k) AS k, length(replace(any_value(error), '0', '')) AS weight FROM v GROUP BY error
), n AS (
  SELECT *, row_number() OVER (ORDER BY k) AS nth FROM f WHERE weight > 1
)
SELECT 0 AS idx, 'zero' AS role, 0::INTEGER AS weight, repeat('0', {width}) AS error
UNION ALL SELECT c + 1, 'unit', 1, repeat('0', c) || '1' || repeat('0', {width - 1} - c) FROM range({width}) t(c)
UNION ALL SELECT nth + {width}, 'bsc_p_0_1', weight, error FROM n WHERE nth <= 256
"""


#: Seeds of the published corpora (fixed values).
SEEDS = {72: "TCM-QDEC-COMPARE-001::72::BSC0.1::v1", 90: "TCM-QDEC-COMPARE-001::90::BSC0.1::v1"}
for _n, _seed in SEEDS.items():
    query(f"s05_noise_corpus_{_n}", noise_sql(_n, _seed))(lambda spark, sf_dir, n=_n, seed=_seed: generators.noise_corpus(spark, n, seed))


def sample_sql(rank: int, seed: str) -> str:
    # the digest's bits, hexadecimal digit by digit, most significant first
    digit = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
    return f"""
WITH h AS (
  SELECT k, sha256('{seed}'::BLOB || unhex(lpad(hex(k), 16, '0'))) AS d FROM range(512) t(k)
), b AS (
  SELECT k, substr(list_aggregate([({digit})[strpos('0123456789abcdef', d[i])] for i in range(1, 17)], 'string_agg', ''), 1, {rank}) AS s FROM h
), c AS (
  SELECT k, list_sum([CASE WHEN s[i + 1] = '1' THEN 1::BIGINT << i ELSE 0 END for i in range({rank})])::BIGINT AS coordinate FROM b
), f AS (
  SELECT coordinate, min(k) AS k FROM c WHERE bit_count(coordinate) > 1 AND coordinate <> {(1 << rank) - 1} GROUP BY coordinate
), n AS (
  SELECT coordinate, row_number() OVER (ORDER BY k) AS nth FROM f
)
SELECT 0 AS idx, 0::BIGINT AS coordinate
UNION ALL SELECT i + 1, 1::BIGINT << i FROM range({rank}) t(i)
UNION ALL SELECT {rank + 1}, {(1 << rank) - 1}
UNION ALL SELECT nth + {rank + 1}, coordinate FROM n WHERE nth <= 256
"""


#: Seeds of the published selector samples (fixed values).
SAMPLES = {42: "QLDPC-SCALE-001A::selector-validation::v1", 49: "QLDPC-SCALE-001B::90::selector-validation::v1"}
for _n, _seed in SAMPLES.items():
    query(f"s06_selector_sample_{_n}", sample_sql(_n, _seed))(lambda spark, sf_dir, n=_n, seed=_seed: generators.selector_sample(spark, n, seed))

# Scalar functions


@query("p01_weight", "SELECT e, bit_count(e)::INTEGER AS weight FROM range(4096) t(e)")
def p01(spark, sf_dir):
    return spark.range(4096).select(F.col("id").alias("e"), bits.weight("id").alias("weight"))


@query(
    "p02_predicates",
    "SELECT e, (w > 0)::INTEGER AS any_set, (2 * w > 9)::INTEGER AS majority, w % 2 AS parity, (w = 3)::INTEGER AS exactly_three FROM (SELECT e, bit_count(e)::INTEGER AS w FROM range(512) t(e))",
)
def p02(spark, sf_dir):
    w = bits.weight("id")
    p = lambda name, **k: score.predicate(name, w, 9, **k)
    return spark.range(512).select(F.col("id").alias("e"), p("or").alias("any_set"), p("majority").alias("majority"), p("parity").alias("parity"), p("exact_weight", target=3).alias("exactly_three"))


@query(
    "p03_signatures",
    "SELECT w, round(2.0::DOUBLE * w / 7 - 1, 12) AS hamming, round(sqrt(w / 7.0::DOUBLE), 12) AS amplitude, CASE WHEN w % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS phase FROM range(8) t(w)",
)
def p03(spark, sf_dir):
    w = F.col("id")
    s = lambda name: score.signal(name, w, 7)
    return spark.range(8).select(w.alias("w"), F.round(s("hamming_normalized"), 12).alias("hamming"), F.round(s("marked_amplitude"), 12).alias("amplitude"), s("parity_phase").alias("phase"))


@query("p04_rounding_classes", "SELECT round(l_discount * l_tax, 3) AS signature, count(*) AS n FROM lineitem GROUP BY 1")
def p04(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.round(F.col("l_discount") * F.col("l_tax"), 3).alias("signature")).agg(F.count("*").alias("n"))


@query("p05_euclidean", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def p05(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pair = v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pair.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(bits.euclidean(F.col("a.v"), F.col("b.v")), 9).alias("distance"))


@query("p06_parity", f"SELECT e, (bit_count(e & {CHECKS_18[0]}) % 2)::INTEGER AS parity FROM range(262144) t(e)")
def p06(spark, sf_dir):
    return spark.range(1 << 18).select(F.col("id").alias("e"), bits.parity("id", CHECKS_18[0]).alias("parity"))


@query("p07_syndrome", f"WITH {CORPUS} SELECT idx, {bitstring(parities('e', CHECKS_18), 9)} AS syndrome FROM co")
def p07(spark, sf_dir):
    return generators.weight_shells(spark).select("idx", bits.encode(bits.syndrome("e", CHECKS_18), 9).alias("syndrome"))


@query("p08_selector", f"WITH {CORPUS} SELECT idx, {parities('e', LOGICALS_18)} AS lab, {parities('e', [*CHECKS_18, *LOGICALS_18])} AS selector FROM co")
def p08(spark, sf_dir):
    c = generators.weight_shells(spark)
    return c.select("idx", bits.syndrome("e", LOGICALS_18).alias("lab"), bits.syndrome("e", [*CHECKS_18, *LOGICALS_18]).alias("selector"))


@query("p09_mass", f"SELECT w::INTEGER AS w, {powers(9, '(18 - w)', 18)} AS m9, {powers(2, '(18 - w)', 18)} AS m2 FROM range(19) t(w)")
def p09(spark, sf_dir):
    w = F.col("id").cast("int")
    return spark.range(19).select(w.alias("w"), bits.power_of(9, 18 - w, 18).alias("m9"), bits.power_of(2, 18 - w, 18).alias("m2"))


@query("p10_codecs", f"SELECT e, {bitstring('e', 20)} AS s, e AS back, [i for i in range(20) if (e >> i) & 1 = 1]::VARCHAR AS support FROM (SELECT o_orderkey % 1048576 AS e FROM orders)")
def p10(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1048576).alias("e"))
    places = F.transform(bits.support("e", 20), lambda x: x.cast("string"))
    return e.select("e", bits.encode("e", 20).alias("s"), bits.decode(bits.encode("e", 20)).alias("back"), F.concat(F.lit("["), F.concat_ws(", ", places), F.lit("]")).alias("support"))


@query("p11_label_parser", "SELECT * FROM (VALUES ('L0', 1::BIGINT), ('L3,R0', 520), ('R8', 131072), ('L9', -1), ('L1,L1', -1), ('X2', -1), ('L01', -1), ('L2,L5,R7', 65572)) t(labels, mask)")
def p11(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("L0", "L3,R0", "R8", "L9", "L1,L1", "X2", "L01", "L2,L5,R7")], "labels string")
    return rows.select("labels", F.coalesce(bits.parse_labels(F.split("labels", ","), 9), F.lit(-1).cast("long")).alias("mask"))


def selector_columns() -> list[int]:
    rows = [*CHECKS_18, *LOGICALS_18]
    return [sum((r >> q & 1) << i for i, r in enumerate(rows)) for q in range(18)]


SEED_QUBITS = codes.independent(selector_columns())


def folded(x: str, masks: list[int]) -> str:
    out = "0::BIGINT"
    for i, m in enumerate(masks):
        out = f"xor({out}, (({x} >> {i}) & 1) * {m}::BIGINT)"
    return out


@query("p12_selector_lift", f"SELECT x AS coordinate, {folded('x', [1 << q for q in SEED_QUBITS])} AS seed FROM range(2048) t(x)")
def p12(spark, sf_dir):
    return spark.range(2048).select(F.col("id").alias("coordinate"), bits.lift("id", [1 << q for q in SEED_QUBITS]).alias("seed"))


BASIS_18 = codes.independent(CHECKS_18)


@query("p13_gather", f"WITH {CORPUS} SELECT idx, {parities('e', [CHECKS_18[i] for i in BASIS_18])} AS packed FROM co")
def p13(spark, sf_dir):
    c = generators.weight_shells(spark).withColumn("syn", bits.syndrome("e", CHECKS_18))
    return c.select("idx", bits.gather("syn", BASIS_18).alias("packed"))


# Aggregates and windows over the 2**18 state space


@query("a01_sum_product", f"WITH {CLASSES} SELECT syn, lab, m9, n FROM cl")
def a01(spark, sf_dir):
    return decode.classes(generators.states(spark)).select("syn", "lab", "m9", "n")


@query("a02_soft_tropical", f"WITH {CLASSES} SELECT syn, lab, m2 FROM cl")
def a02(spark, sf_dir):
    return decode.classes(generators.states(spark)).select("syn", "lab", "m2")


@query("a03_min_plus", f"WITH {CLASSES} SELECT syn, lab, w, rep FROM cl")
def a03(spark, sf_dir):
    return decode.classes(generators.states(spark)).select("syn", "lab", "w", "rep")


@query("a04_canonical_key", f"WITH {CLASSES} SELECT syn, lab, key FROM cl")
def a04(spark, sf_dir):
    return decode.classes(generators.states(spark)).select("syn", "lab", "key")


def marginal_sql() -> str:
    pick = lambda q, f: f"CASE WHEN {f} THEN {1 << q}::BIGINT ELSE 0 END"
    on, off = (lambda q: f"(e >> {q}) & 1 = 1"), (lambda q: f"(e >> {q}) & 1 = 0")
    more = lambda q, m: f"sum({m}) FILTER ({on(q)}) > sum({m}) FILTER ({off(q)})"
    less = lambda q: f"min(w) FILTER ({on(q)}) < min(w) FILTER ({off(q)})"
    each = lambda f: " + ".join(pick(q, f(q)) for q in range(18))
    return f"SELECT syn, {each(lambda q: more(q, 'm9'))} AS sum_product, {each(lambda q: more(q, 'm2'))} AS soft_tropical, {each(less)} AS min_plus FROM st GROUP BY syn"


@query("a05_marginals", f"WITH {STATES} {marginal_sql()}")
def a05(spark, sf_dir):
    return decode.marginals(generators.states(spark))


@query("a06_shells", f"WITH {decided('sum_product')}, {CORPUS}, {scored()} {SHELLS}")
def a06(spark, sf_dir):
    table_ = decode.decisions(decode.classes(generators.states(spark)), "sum_product")
    return decode.shells(decode.lookup(generators.weight_shells(spark), table_))


@query("a07_histogram", f"WITH {STATES} SELECT syn, w, count(*) AS n FROM st GROUP BY syn, w")
def a07(spark, sf_dir):
    return generators.states(spark).groupBy("syn", "w").agg(F.count("*").alias("n"))


@query("a09_orbits", "SELECT w, count(*) AS size, (min(m) = max(m)) AS constant, min(m) AS lo FROM (SELECT bit_count(e)::INTEGER AS w, (bit_count(e) * 2 > 15)::INTEGER AS m FROM range(32768) t(e)) GROUP BY w")
def a09(spark, sf_dir):
    d = spark.range(1 << 15).select(bits.weight("id").alias("w")).withColumn("m", score.predicate("majority", F.col("w"), 15))
    return d.groupBy("w").agg(F.count("*").alias("size"), (F.min("m") == F.max("m")).alias("constant"), F.min("m").alias("lo"))


def envelope_sql(algebra: str) -> str:
    best = {"sum_product": "max(m9)", "soft_tropical": "max(m2)", "min_plus": "min(w)"}[algebra]
    own = {"sum_product": "m9", "soft_tropical": "m2", "min_plus": "w"}[algebra]
    return f"""WITH {CLASSES}, {CORPUS}, wi AS (
  SELECT * FROM (SELECT *, {best} OVER (PARTITION BY syn) AS best FROM cl) WHERE {own} = best
), h AS (
  SELECT {parities('e', CHECKS_18)} AS syn, {parities('e', LOGICALS_18)} AS lab, count(*) AS hits FROM co GROUP BY 1, 2
), g AS (
  SELECT wi.syn, min(coalesce(hits, 0)) AS low, max(coalesce(hits, 0)) AS high, arg_min(coalesce(hits, 0), key) AS chosen
  FROM wi LEFT JOIN h ON wi.syn = h.syn AND wi.lab = h.lab GROUP BY wi.syn
) SELECT sum(low)::BIGINT AS low, sum(high)::BIGINT AS high, sum(chosen)::BIGINT AS chosen FROM g"""


for _a in decode.ALGEBRAS:
    query(f"a10_envelope_{_a}", envelope_sql(_a))(lambda spark, sf_dir, a=_a: decode.envelope(generators.weight_shells(spark), decode.classes(generators.states(spark)), a))


@query(
    "a11_ledger",
    "SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id % 4, -1) AS shard, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type), ())",
)
def a11(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 4)
    sets = e.groupingSets([["event_type", "shard"], ["event_type"], []], "event_type", "shard")
    rolled = sets.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rolled.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("shard", F.lit(-1)).alias("shard"), "n", "total")


@query("a12_statistics", f"WITH {CLASSES} SELECT min(m9) AS least, max(m9) AS most, round(avg(m9), 3) AS mean, count(*) AS n FROM cl")
def a12(spark, sf_dir):
    return decode.classes(generators.states(spark)).agg(F.min("m9").alias("least"), F.max("m9").alias("most"), F.round(F.avg("m9"), 3).alias("mean"), F.count("*").alias("n"))


LEADERS = f"""le AS (
  SELECT syn, e AS correction, w FROM (SELECT *, row_number() OVER (PARTITION BY syn ORDER BY w, {bitstring('e', 18)} DESC) AS nth FROM st) WHERE nth = 1
)"""


@query("a13_coset_leaders", f"WITH {STATES}, {LEADERS} SELECT * FROM le")
def a13(spark, sf_dir):
    return decode.leaders(generators.states(spark))


@query("a14_distance", f"WITH {STATES} SELECT w AS distance, count(*) AS multiplicity FROM st WHERE syn = 0 AND lab <> 0 GROUP BY w ORDER BY w LIMIT 1")
def a14(spark, sf_dir):
    return decode.distance(generators.states(spark))


@query("a17_total_mass", f"WITH {STATES} SELECT sum(m9)::BIGINT AS mass FROM st")
def a17(spark, sf_dir):
    return generators.states(spark).agg(F.sum("m9").alias("mass"))


for _a in decode.ALGEBRAS:
    _best = {"sum_product": "max(m9)", "soft_tropical": "max(m2)", "min_plus": "min(w)"}[_a]
    _own = decode.ALGEBRAS[_a][0]
    query(f"w01_ties_{_a}", f"WITH {CLASSES}, t AS (SELECT syn, count(*) AS ties FROM (SELECT *, {_best} OVER (PARTITION BY syn) AS best FROM cl) WHERE {_own} = best GROUP BY syn) SELECT ties, count(*) AS syndromes FROM t GROUP BY ties")(
        lambda spark, sf_dir, a=_a: decode.winners(decode.classes(generators.states(spark)), a).groupBy("syn").agg(F.count("*").alias("ties")).groupBy("ties").agg(F.count("*").alias("syndromes"))
    )
    query(f"w02_decisions_{_a}", f"WITH {decided(_a)} SELECT syn, correction FROM de")(lambda spark, sf_dir, a=_a: decode.decisions(decode.classes(generators.states(spark)), a).select("syn", "correction"))


@query("w03_alternations", "WITH v AS (SELECT 2.0::DOUBLE * w / 12 - 1 AS v, w % 2 AS m FROM range(13) t(w)), l AS (SELECT m, lag(m) OVER (ORDER BY v) AS p FROM v) SELECT count(*) FILTER (m <> p) AS alternations FROM l")
def w03(spark, sf_dir):
    d = generators.domain(spark, 12).withColumn("label", score.predicate("parity", F.col("weight"), 12)).withColumn("signal", F.round(score.signal("hamming_normalized", F.col("weight"), 12), 12))
    return score.alternations(d, "signal", "label")


#: Published widths by code and policy (fixed values).
WIDTHS = {72: (24, 18, 18), 90: (28, 25, 25), 108: (33, 30, 30), 144: (31, 38, 34), 288: (71, 83, 79), 784: (253, 223, 201)}


def ladder_widths(spark: SparkSession) -> DataFrame:
    """G04 fanned out over (code, policy): each is a small sequential problem of its own."""
    jobs = spark.createDataFrame([(c[0], p) for c in LADDER for p in orders.POLICIES], "n int, policy string").repartition(len(LADDER) * 3)

    def run(frames):
        by_n = {c[0]: c for c in LADDER}
        for f in frames:
            f["width"] = [orders.width(orders.eliminate(codes.scopes(by_n[n]), len(codes.independent(codes.checks(by_n[n])[0])), p)) for n, p in zip(f["n"], f["policy"])]
            yield f

    return jobs.mapInPandas(run, "n int, policy string, width int")


PUBLISHED = "VALUES " + ", ".join(f"({n}::INTEGER, '{p}', {w}::INTEGER)" for n, ws in WIDTHS.items() for p, w in zip(orders.POLICIES, ws))


@query("g04_elimination_widths", f"SELECT * FROM ({PUBLISHED}) t(n, policy, width)")
def g04(spark, sf_dir):
    return ladder_widths(spark)


@query("w04_ladder_deltas", f"SELECT n, policy, width - lag(width, 1, width) OVER (PARTITION BY policy ORDER BY n) AS delta FROM ({PUBLISHED}) t(n, policy, width)")
def w04(spark, sf_dir):
    w = Window.partitionBy("policy").orderBy("n")
    return ladder_widths(spark).select("n", "policy", (F.col("width") - F.coalesce(F.lag("width").over(w), F.col("width"))).alias("delta"))


@query("w05_monotone", f"SELECT policy, bool_and(width >= coalesce(p, 0)) AS monotone FROM (SELECT *, lag(width) OVER (PARTITION BY policy ORDER BY n) AS p FROM ({PUBLISHED}) t(n, policy, width)) GROUP BY policy")
def w05(spark, sf_dir):
    w = Window.partitionBy("policy").orderBy("n")
    grown = ladder_widths(spark).withColumn("p", F.coalesce(F.lag("width").over(w), F.lit(0)))
    return grown.groupBy("policy").agg(F.bool_and(F.col("width") >= F.col("p")).alias("monotone"))


@query(
    "w06_running_xor",
    "SELECT conv_id, turn, total, xor(total, coalesce(lag(total) OVER (PARTITION BY conv_id ORDER BY turn), 0)) AS change FROM (SELECT conv_id, turn, bit_xor(length(text)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM conversations)",
)
def w06(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return score.running_xor(c, "conv_id", "turn", "size").select("conv_id", "turn", "total", "change")


@query("w08_first_witnesses", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 4")
def w08(spark, sf_dir):
    return score.ranked(table(spark, sf_dir, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], 4).select("event_type", "event_id")


# Joins


@query("j01_lookup", f"WITH {decided('min_plus')}, {CORPUS} SELECT idx, correction FROM co JOIN de ON de.syn = {parities('e', CHECKS_18)}")
def j01(spark, sf_dir):
    t = decode.decisions(decode.classes(generators.states(spark)), "min_plus")
    return decode.lookup(generators.weight_shells(spark), t).select("idx", "correction")


def span_sql(masks: list[int]) -> str:
    return f"sp AS (SELECT {folded('x', masks)} AS s FROM range({1 << len(masks)}) t(x))"


BASIS_MASKS = [CHECKS_18[i] for i in BASIS_18]


@query("j02_span_membership", f"WITH {decided('sum_product')}, {CORPUS}, {span_sql(BASIS_MASKS)} SELECT idx, xor(e, correction) IN (SELECT s FROM sp) AS member FROM co JOIN de ON de.syn = {parities('e', CHECKS_18)}")
def j02(spark, sf_dir):
    t = decode.decisions(decode.classes(generators.states(spark)), "sum_product")
    residual = decode.lookup(generators.weight_shells(spark), t).select("idx", F.col("e").bitwiseXOR(F.col("correction")).alias("s"))
    span = spark.range(1 << len(BASIS_MASKS)).select(bits.lift("id", BASIS_MASKS).alias("s"), F.lit(True).alias("member"))
    return residual.join(F.broadcast(span), "s", "left").select("idx", F.coalesce("member", F.lit(False)).alias("member"))


@query("j03_membership_by_reduction", f"WITH {span_sql(BASIS_MASKS)} SELECT e, e IN (SELECT s FROM sp) AS member FROM range(262144) t(e)")
def j03(spark, sf_dir):
    rows, pivots = codes.reduced(BASIS_MASKS, 18)
    x = F.col("id")
    for r, p in zip(rows, pivots):
        x = F.when(F.shiftright(x, p).bitwiseAND(F.lit(1).cast("long")) == 1, x.bitwiseXOR(F.lit(r).cast("long"))).otherwise(x)
    return spark.range(1 << 18).select(F.col("id").alias("e"), (x == 0).alias("member"))


@query(
    "j04_label_gap",
    "SELECT round(min(abs(a.v - b.v)), 9) AS gap FROM (SELECT DISTINCT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') a, (SELECT DISTINCT o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F') b",
)
def j04(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return score.gap(o, "v", "label").select(F.round("gap", 9).alias("gap"))


@query(
    "j05_collisions",
    "SELECT lang || '/' || source AS signature, count(*) FILTER (quality = 0) AS zeros, count(*) FILTER (quality = 1) AS ones, coalesce(min(doc_id) FILTER (quality = 0), -1) AS zero_first, coalesce(min(doc_id) FILTER (quality = 1), -1) AS one_first, count(*) FILTER (quality = 0) * count(*) FILTER (quality = 1) AS pairs FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def j05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source").alias("signature"))
    return score.collisions(d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "signature", "quality", "doc_id").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("zero_first", "one_first")})


@query("j06_coset_minimum", f"WITH {span_sql(BASIS_MASKS)} SELECT e, min(xor(e, s)) AS key FROM range(262144) t(e), sp GROUP BY e")
def j06(spark, sf_dir):
    """Errors of one coset have one selector, so a group-by gives the minima of all cosets; no error meets the whole span."""
    e = spark.range(1 << 18).select(F.col("id").alias("e"), bits.lift("id", selector_columns()).alias("selector"))
    return e.join(F.broadcast(e.groupBy("selector").agg(F.min("e").alias("key"))), "selector").select("e", "key")  # 2048 cosets


@query("j07_coset_key", f"WITH {CLASSES} SELECT count(*) AS classes, count(DISTINCT key) AS keys, min(n) AS least, max(n) AS most FROM cl")
def j07(spark, sf_dir):
    return decode.classes(generators.states(spark)).agg(F.count("*").alias("classes"), F.count_distinct("key").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("j09_paired_outcomes", "SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS repaired, count(*) FILTER (quality = 1 AND toxic = 0) AS broken, count(*) FILTER (quality = toxic) AS same, count(*) AS compared FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def j09(spark, sf_dir):
    side = lambda c: table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), (F.col(c) == 1).alias("success"))
    return decode.compare(side("quality"), side("toxic"))


@query("j10_reconcile", f"WITH {CLASSES} SELECT syn, lab, m9, 'left' AS side FROM cl WHERE false")
def j10(spark, sf_dir):
    a = decode.classes(generators.states(spark)).select("syn", "lab", "m9", "m2", "w", "rep", "key")
    b = decode.transfer(spark).select("syn", "lab", "m9", "m2", "w", "rep", "key")
    return score.differences(a, b).select("syn", "lab", "m9", "side")


@query("j11_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j11(spark, sf_dir):
    parent = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return score.orphans(table(spark, sf_dir, "orders"), parent, "o_custkey", "c_custkey").select("o_orderkey")


@query("j12_coverage", "SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY doc_id HAVING count(*) > 1")
def j12(spark, sf_dir):
    return score.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


RULES = (("http://th", "a"), ("http://", "b"), ("https://", "c"), ("http://thn", "a"))


@query(
    "j13_path_owner",
    "WITH r(prefix, owner) AS (VALUES " + ", ".join(f"('{p}', '{o}')" for p, o in RULES) + ") SELECT url AS path, arg_max(owner, length(prefix) * 10 + ascii(owner) - 97) AS owner, count(DISTINCT owner) AS owners FROM (SELECT DISTINCT url FROM pages) LEFT JOIN r ON starts_with(url, prefix) GROUP BY url",
)
def j13(spark, sf_dir):
    return score.owners(table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct(), spark.createDataFrame(RULES, "prefix string, owner string"))


INCIDENCE = "inc AS (SELECT q, v FROM (VALUES " + ", ".join(f"({q}::BIGINT, {m}::BIGINT)" for q, m in enumerate(codes.transpose(BASIS_MASKS, 18))) + ") t(q, m), range(7) u(v) WHERE (m >> v) & 1 = 1)"


def incidence(spark: SparkSession) -> DataFrame:
    """(q, v): which factor holds which variable."""
    m = spark.createDataFrame(list(enumerate(codes.transpose(BASIS_MASKS, 18))), "q long, m long")
    return m.select("q", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("v"), "m").where(F.expr("shiftright(m, v) & 1 = 1")).select("q", F.col("v").cast("long").alias("v"))


@query("j14_incidence", f"WITH {INCIDENCE} SELECT q, v FROM inc")
def j14(spark, sf_dir):
    return incidence(spark)


@query("j15_primal_graph", f"WITH {INCIDENCE} SELECT DISTINCT a.v AS u, b.v AS v FROM inc a JOIN inc b ON a.q = b.q AND a.v < b.v")
def j15(spark, sf_dir):
    i = incidence(spark)
    return i.alias("a").join(i.alias("b"), (F.col("a.q") == F.col("b.q")) & (F.col("a.v") < F.col("b.v"))).select(F.col("a.v").alias("u"), F.col("b.v").alias("v")).distinct()


# Sets and linear algebra


@query("x01_span", f"WITH {span_sql(BASIS_MASKS)} SELECT DISTINCT s FROM sp")
def x01(spark, sf_dir):
    return spark.range(1 << len(BASIS_MASKS)).select(bits.lift("id", BASIS_MASKS).alias("s")).distinct()


@query("x02_reachable_states", "SELECT q, 1::BIGINT << r AS states FROM (VALUES " + ", ".join(f"({q + 1}, {len(codes.independent(selector_columns()[: q + 1]))})" for q in range(18)) + ") t(q, r)")
def x02(spark, sf_dir):
    """Distinct partial selectors after each coordinate.

    A partial error over the first q coordinates is a number below 2**q, and its selector doesn't depend on q: so a
    selector is reachable as soon as the least error that has it is below 2**q.  One group-by gives all counts.
    """
    first = spark.range(1 << 18).groupBy(bits.lift("id", selector_columns()).alias("sel")).agg(F.min("id").alias("x"))
    counts = first.agg(*[F.count_if(F.col("x") < (1 << q)).alias(f"q{q}") for q in range(1, 19)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{q}").alias("states")) for q in range(1, 19)])).alias("s")).select("s.q", "s.states")


@query("x04_key_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def x04(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("x06_equal_supports", f"WITH {CLASSES} SELECT syn, lab FROM cl WHERE false")
def x06(spark, sf_dir):
    c = decode.classes(generators.states(spark))
    return score.differences(c.where("m9 > 0").select("syn", "lab"), c.where("m2 > 0").select("syn", "lab")).select("syn", "lab")


@query("l01_cyclic_shift", "SELECT i AS r, (i + 5) % 28 AS c FROM range(28) t(i)")
def l01(spark, sf_dir):
    return gf2.shift(spark, 28, 5)


@query("l02_product_and_sum", "WITH p AS (SELECT i AS r, (i + 5) % 12 AS c FROM range(12) t(i)), u AS (SELECT * FROM p UNION ALL SELECT i, i FROM range(12) t(i)) SELECT a.r, b.c FROM u a JOIN u b ON a.c = b.r GROUP BY a.r, b.c HAVING count(*) % 2 = 1")
def l02(spark, sf_dir):
    s = gf2.total(gf2.shift(spark, 12, 5), gf2.shift(spark, 12, 0))
    return gf2.product(s, s)


def matrix_sql() -> str:
    rows = []
    for n, l, m, a, b in LADDER:
        rows.append(f"({n}, {l}, {m}, {list(a)}, {list(b)})")
    at = lambda i, j: f"((({i}) % l + l) % l) * m + ((({j}) % m + m) % m)"
    x = [at("i + a[1]", "j"), at("i", "j + a[2]"), at("i", "j + a[3]"), "l * m + " + at("i", "j + b[1]"), "l * m + " + at("i + b[2]", "j"), "l * m + " + at("i + b[3]", "j")]
    z = [at("i", "j - b[1]"), at("i - b[2]", "j"), at("i - b[3]", "j"), "l * m + " + at("i - a[1]", "j"), "l * m + " + at("i", "j - a[2]"), "l * m + " + at("i", "j - a[3]")]
    return f"""cm AS (
  SELECT n::INTEGER AS n, 'x' AS side, (i * m + j)::INTEGER AS r, unnest([{', '.join(x)}])::INTEGER AS c FROM (VALUES {', '.join(rows)}) t(n, l, m, a, b), range(28) u(i), range(14) v(j) WHERE i < l AND j < m
  UNION ALL
  SELECT n::INTEGER, 'z', (i * m + j)::INTEGER, unnest([{', '.join(z)}])::INTEGER FROM (VALUES {', '.join(rows)}) t(n, l, m, a, b), range(28) u(i), range(14) v(j) WHERE i < l AND j < m
)"""


@query("l03_check_matrices", f"WITH {matrix_sql()} SELECT n, side, r, c FROM cm")
def l03(spark, sf_dir):
    return gf2.check_matrices(spark)


@query("l08_commutation", f"WITH {matrix_sql()}, k AS (SELECT x.n, x.r AS xr, z.r AS zr, count(*) AS k FROM cm x JOIN cm z ON x.n = z.n AND x.c = z.c AND x.side = 'x' AND z.side = 'z' GROUP BY ALL) SELECT n, count(*) AS overlapping, count(*) FILTER (k % 2 = 1) AS odd FROM k GROUP BY n")
def l08(spark, sf_dir):
    return gf2.odd_overlaps(gf2.check_matrices(spark))


@query("l09_logical_validation", f"SELECT i, {parities('m', CHECKS_18)} = 0 AS in_kernel, NOT EXISTS (SELECT 1 FROM range(128) t(x) WHERE {folded('x', BASIS_MASKS)} = m) AS outside FROM (VALUES " + ", ".join(f"({i}, {m}::BIGINT)" for i, m in enumerate(LOGICALS_18)) + ") l(i, m)")
def l09(spark, sf_dir):
    l = spark.createDataFrame(list(enumerate(LOGICALS_18)), "i int, m long")
    span = spark.range(128).select(bits.lift("id", BASIS_MASKS).alias("m"), F.lit(True).alias("inside"))
    return l.join(F.broadcast(span), "m", "left").select("i", (bits.syndrome("m", CHECKS_18) == 0).alias("in_kernel"), F.col("inside").isNull().alias("outside"))


@query("l11_selector_seeds", f"SELECT x AS coordinate, {folded('x', [selector_columns()[q] for q in SEED_QUBITS])} AS selector, {folded('x', [1 << q for q in SEED_QUBITS])} AS seed FROM range(2048) t(x)")
def l11(spark, sf_dir):
    return spark.range(1 << len(SEED_QUBITS)).select(F.col("id").alias("coordinate"), bits.lift("id", [selector_columns()[q] for q in SEED_QUBITS]).alias("selector"), bits.lift("id", [1 << q for q in SEED_QUBITS]).alias("seed"))


# Decoders


@query("d01_coset_leader_decoder", f"WITH {STATES}, {LEADERS}, {CORPUS}, {scored('le')} {SHELLS}")
def d01(spark, sf_dir):
    return decode.shells(decode.lookup(generators.weight_shells(spark), decode.leaders(generators.states(spark))))


def greedy_sql() -> str:
    columns = [sum((r >> q & 1) << i for i, r in enumerate(CHECKS_18)) for q in range(18)]
    listed = "[" + ", ".join(str(c) for c in columns) + "]"
    return f"""WITH RECURSIVE {CORPUS}, s(idx, e, w, r, c, k) AS (
  SELECT idx, e, w, {parities('e', CHECKS_18)}, 0::BIGINT, 0 FROM co
  UNION ALL
  SELECT idx, e, w, xor(r, ({listed})[q + 1]), xor(c, 1::BIGINT << q), k + 1 FROM (
    SELECT s.*, u.q, row_number() OVER (PARTITION BY idx ORDER BY bit_count(xor(r, ({listed})[u.q + 1])), u.q) AS nth
    FROM s, range(18) u(q) WHERE r <> 0 AND k < 18 AND bit_count(xor(r, ({listed})[u.q + 1])) < bit_count(r)
  ) WHERE nth = 1
), f AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY k DESC) AS nth FROM s),
g AS (SELECT idx, w, k, r <> 0 AS stalled, r = 0 AND {parities('xor(e, c)', CHECKS_18)} = 0 AND {parities('xor(e, c)', LOGICALS_18)} = 0 AS success FROM f WHERE nth = 1)
SELECT count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (stalled) AS stalled, sum(k)::BIGINT AS iterations,
       sum((k + stalled::INTEGER) * 18)::BIGINT AS comparisons FROM g"""


@query("d02_greedy_decoder", greedy_sql())
def d02(spark, sf_dir):
    g = decode.greedy(generators.weight_shells(spark))
    return g.agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if("stalled").alias("stalled"), F.sum("iterations").cast("long").alias("iterations"), F.sum("comparisons").cast("long").alias("comparisons"))


for _a in decode.ALGEBRAS:

    def _naive(spark, sf_dir, a=_a):
        t = decode.marginals(generators.states(spark)).select("syn", F.col(a).alias("correction"))
        o = decode.lookup(generators.weight_shells(spark), t)
        return o.agg(F.count_if("success").alias("success"), F.count_if(~F.col("consistent")).alias("inconsistent"), F.count("*").alias("total"))

    query(
        f"d03_naive_{_a}",
        f"WITH {STATES}, na AS (SELECT syn, {_a} AS correction FROM ({marginal_sql()})), {CORPUS}, o AS (SELECT {parities('xor(e, correction)', CHECKS_18)} AS s, {parities('xor(e, correction)', LOGICALS_18)} AS l FROM co JOIN na ON na.syn = {parities('e', CHECKS_18)}) SELECT count(*) FILTER (s = 0 AND l = 0) AS success, count(*) FILTER (s <> 0) AS inconsistent, count(*) AS total FROM o",
    )(_naive)

    def _coset(spark, sf_dir, a=_a):
        return decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(decode.classes(generators.states(spark)), a)))

    query(f"d04_coset_decoder_{_a}", f"WITH {decided(_a)}, {CORPUS}, {scored()} {SHELLS}")(_coset)

    def _transfer(spark, sf_dir, a=_a):
        return decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(decode.transfer(spark), a)))

    query(f"d05_transfer_decoder_{_a}", f"WITH {decided(_a)}, {CORPUS}, {scored()} {SHELLS}")(_transfer)


@query("d10_decoder_comparison", f"WITH {decided('sum_product')}, {LEADERS}, {CORPUS}, x AS (SELECT idx, {parities('xor(e, correction)', LOGICALS_18)} = 0 AS ok FROM co JOIN le d ON d.syn = {parities('e', CHECKS_18)}), y AS (SELECT idx, {parities('xor(e, correction)', LOGICALS_18)} = 0 AS ok FROM co JOIN de d ON d.syn = {parities('e', CHECKS_18)}) SELECT count(*) FILTER (y.ok AND NOT x.ok) AS repaired, count(*) FILTER (x.ok AND NOT y.ok) AS broken, count(*) FILTER (x.ok = y.ok) AS same, count(*) AS compared FROM x JOIN y USING (idx)")
def d10(spark, sf_dir):
    st, corpus = generators.states(spark), generators.weight_shells(spark)
    return decode.compare(decode.lookup(corpus, decode.leaders(st)), decode.lookup(corpus, decode.decisions(decode.classes(st), "sum_product")))


# Planning


def work_rows(spark: SparkSession, code, policy: str = "min_fill") -> DataFrame:
    """One row for the local factors' entries (step -1), and one for each elimination."""
    s = codes.scopes(code)
    order = [v for v, _, _ in orders.eliminate(s, len(codes.independent(codes.checks(code)[0])), policy)]
    local = {"step": -1, "variable": -1, "factors": len(s), "joint": max(map(len, s)), "output": 0, "evaluations": sum(1 << len(x) for x in s), "emitted": 0, "reads": 0, "multiplies": 0}
    return spark.createDataFrame([local, *orders.work(s, order)], "step int, variable int, factors int, joint int, output int, evaluations long, emitted long, reads long, multiplies long")


#: The published work of the 72-bit code (fixed values).
@query("g06_work_c72", "SELECT 1066940::BIGINT AS evaluations, 4811278::BIGINT AS reads, 19::INTEGER AS peak, 30::BIGINT AS steps")
def g06(spark, sf_dir):
    return work_rows(spark, LADDER[0]).agg(F.sum("evaluations").alias("evaluations"), F.sum("reads").alias("reads"), F.max("joint").alias("peak"), F.count_if(F.col("step") >= 0).alias("steps"))


#: The published work of the 90-bit code (fixed values).
@query("g06_work_c90", "SELECT 201384562::BIGINT AS evaluations, 26::INTEGER AS peak")
def g06_c90(spark, sf_dir):
    return work_rows(spark, LADDER[1]).agg(F.sum("evaluations").alias("evaluations"), F.max("joint").alias("peak"))


@query("g13_cap_gate", f"SELECT n, policy, CASE WHEN width + 1 <= 20 THEN 'pass' ELSE 'fail' END AS gate FROM ({PUBLISHED}) t(n, policy, width)")
def g13(spark, sf_dir):
    """2**(width + 1) entries against a cap of 2**20: exponents are compared, as the counts don't fit a BIGINT."""
    return ladder_widths(spark).select("n", "policy", F.when(F.col("width") + 1 <= 20, "pass").otherwise("fail").alias("gate"))


# Validation


@query("v05_work_units", "SELECT a || '/class-' || lpad(c::VARCHAR, 3, '0') AS unit FROM (VALUES ('sum_product'), ('soft_tropical'), ('min_plus')) t(a), range(256) u(c)")
def v05(spark, sf_dir):
    a = spark.createDataFrame([(x,) for x in decode.ALGEBRAS], "a string")
    return a.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda c: F.concat("a", F.lit("/class-"), F.lpad(c.cast("string"), 3, "0")))).alias("unit"))


@query("v07_shards", "SELECT o_orderkey % 64 AS shard, count(*) AS n, bit_xor(o_orderkey) AS mark FROM orders GROUP BY 1")
def v07(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 64).alias("shard")).agg(F.count("*").alias("n"), F.bit_xor("o_orderkey").alias("mark"))


# Histories over rounds

DETECTOR_SQL = f"""{FAULTS}, pl AS (
  SELECT q, CASE WHEN q < 18 THEN {parities('(1::BIGINT << (q % 18))', [CHECKS_18[i] for i in (0, 1, 2, 5, 6, 7, 8)])} << 0
                 WHEN q < 36 THEN {parities('(1::BIGINT << (q % 18))', [CHECKS_18[i] for i in (0, 1, 2, 5, 6, 7, 8)])} << 7
                 WHEN q < 54 THEN {parities('(1::BIGINT << (q % 18))', [CHECKS_18[i] for i in (0, 1, 2, 5, 6, 7, 8)])} << 14
                 ELSE (129::BIGINT << (q - 54) % 7) << (7 * ((q - 54) // 7)) END AS d,
         CASE WHEN q < 54 THEN 1::BIGINT << (q % 18) ELSE 0 END AS t
  FROM range(75) r(q)
), de AS (
  SELECT idx, xor(coalesce(x.d, 0), coalesce(y.d, 0)) AS detectors, xor(coalesce(x.t, 0), coalesce(y.t, 0)) AS terminal
  FROM fh LEFT JOIN pl x ON x.q = a LEFT JOIN pl y ON y.q = b
)"""


@query("l12_detectors", f"WITH {DETECTOR_SQL} SELECT idx, detectors, terminal FROM de")
def l12(spark, sf_dir):
    return temporal.detectors(generators.fault_histories(spark))


@query("a08_detector_fibers", f"WITH {DETECTOR_SQL} SELECT detectors, count(*) AS histories, count(DISTINCT ({parities('terminal', CHECKS_18)} << 4) + {parities('terminal', LOGICALS_18)}) AS classes FROM de GROUP BY detectors")
def a08(spark, sf_dir):
    return temporal.fibers(temporal.detectors(generators.fault_histories(spark)))


# Elimination and compiled graphs

ORDER_18 = [v for v, _, _ in orders.eliminate(codes.scopes(C18), 7, "min_fill")]


def contracted(spark: SparkSession) -> DataFrame:
    seeds = spark.range(1 << len(SEED_QUBITS)).select(F.col("id").alias("class"), bits.lift("id", [1 << q for q in SEED_QUBITS]).alias("seed"))
    out = elimination.contract(seeds, codes.scopes(C18), ORDER_18).join(seeds, "class")
    return out.select(bits.syndrome("seed", CHECKS_18).alias("syn"), bits.syndrome("seed", LOGICALS_18).alias("lab"), "m9", "m2", "w", "rep", "key")


@query("g03_elimination", f"WITH {CLASSES} SELECT syn, lab, m9, m2, w, rep, key FROM cl")
def g03(spark, sf_dir):
    return contracted(spark)


@query("d06_elimination_decoder", f"WITH {decided('sum_product')}, {CORPUS}, {scored()} {SHELLS}")
def d06(spark, sf_dir):
    return decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(contracted(spark), "sum_product")))


def compiled(algebra: str):
    return dag.build(algebra, codes.scopes(C18), ORDER_18, {q: i for i, q in enumerate(SEED_QUBITS)})


def evaluated(spark: SparkSession) -> DataFrame:
    """(coordinate, m9, m2, w, rep, key): each task evaluates whole graphs as vectors over its selectors."""
    graphs = spark.sparkContext.broadcast({a: compiled(a) for a in decode.ALGEBRAS})

    def run(frames):
        import pandas as pd

        for f in frames:
            x = f["id"].to_numpy()
            v = {a: dag.evaluate(*g, x, a) for a, g in graphs.value.items()}
            yield pd.DataFrame({"coordinate": x, "m9": v["sum_product"][0], "m2": v["soft_tropical"][0], "w": v["min_plus"][0], "rep": v["min_plus"][1], "key": v["min_plus"][2]})

    return spark.range(1 << len(SEED_QUBITS)).mapInPandas(run, "coordinate long, m9 long, m2 long, w long, rep long, key long")


def evaluated_classes(spark: SparkSession) -> DataFrame:
    seed = bits.lift("coordinate", [1 << q for q in SEED_QUBITS])
    return evaluated(spark).select(bits.syndrome(seed, CHECKS_18).alias("syn"), bits.syndrome(seed, LOGICALS_18).alias("lab"), "m9", "m2", F.col("w").cast("int").alias("w"), "rep", "key")


#: The published numbers of nodes (fixed values).
@query("g08_graph_nodes", "SELECT * FROM (VALUES ('sum_product', 371), ('soft_tropical', 371), ('min_plus', 388)) t(algebra, nodes)")
def g08(spark, sf_dir):
    rows = []
    for a in decode.ALGEBRAS:
        g, root = compiled(a)
        rows.append((a, len(g.reachable(root))))
    return spark.createDataFrame(rows, "algebra string, nodes int")


@query("g09_graph_values", f"WITH {CLASSES} SELECT syn, lab, m9, m2, w, rep, key FROM cl")
def g09(spark, sf_dir):
    return evaluated_classes(spark)


@query("d07_graph_decoder", f"WITH {decided('min_plus')}, {CORPUS}, {scored()} {SHELLS}")
def d07(spark, sf_dir):
    return decode.shells(decode.lookup(generators.weight_shells(spark), decode.decisions(evaluated_classes(spark), "min_plus")))


# Records


@query("p14_canonical_digest", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha FROM nation""")
def p14(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", records.canonical_sha256(F.to_json(F.struct("n_regionkey", "n_nationkey", "n_name"))).alias("sha"))


@query("p15_content_digest", "SELECT item_id, sha256(text) AS sha FROM benchmark")
def p15(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))


@query("p16_exact_keys", "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN '-k' ELSE '' END AS problems FROM events")
def p16(spark, sf_dir):
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", records.key_problems(keys, ["k"])).alias("problems"))


CUSTOMER_SCHEMA = {
    "required": ["c_custkey", "c_name"],
    "properties": {
        "c_custkey": {"type": "integer", "minimum": 1},
        "c_name": {"type": "string", "pattern": "Customer#[0-9]+", "minLength": 5},
        "c_acctbal": {"type": "number", "minimum": 0},
        "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]},
    },
}


@query(
    "p17_schema_violations",
    "SELECT c_custkey, 'c_custkey:minimum' AS rule FROM customer WHERE c_custkey < 1 UNION ALL SELECT c_custkey, 'c_name:pattern' FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]+') UNION ALL SELECT c_custkey, 'c_name:minLength' FROM customer WHERE length(c_name) < 5 UNION ALL SELECT c_custkey, 'c_acctbal:minimum' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_mktsegment:enum' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
)
def p17(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return records.violations(c, "c_custkey", records.schema_rules(CUSTOMER_SCHEMA, dict(c.dtypes)))


@query("p18_guards", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 THEN 0 ELSE 1 END + CASE WHEN isfinite(l_extendedprice) THEN 0 ELSE 1 END + CASE WHEN length(l_returnflag) > 0 THEN 0 ELSE 1 END AS broken FROM lineitem")
def p18(spark, sf_dir):
    ok = [F.col("l_quantity") >= 10, F.abs("l_extendedprice") < float("inf"), F.length("l_returnflag") > 0]
    broken = sum(((~F.coalesce(x, F.lit(False))).cast("int") for x in ok), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", broken.alias("broken"))


@query("p19_safe_paths", "WITH p AS (SELECT page_id, substr(url, 8) AS path FROM pages) SELECT page_id, NOT (list_contains(string_split(path, '/'), '') OR list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '..')) AND NOT regexp_matches(path, '[*?\\[\\]\\\\]') AS safe FROM p")
def p19(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.safe_path(F.expr("substring(url, 8)")).alias("safe"))


@query("p20_timestamps", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_ms(date_trunc('second', ts)) // 1000 ELSE -1 END AS seconds FROM events")
def p20(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_timestamp(records.aware_timestamp(text)), F.lit(-1)).cast("long").alias("seconds"))


@query("p21_normalised_names", "SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name, contains(lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')), '00') AS hit FROM supplier")
def p21(spark, sf_dir):
    n = records.normalised(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", n.alias("name"), F.contains(n, F.lit("00")).alias("hit"))


@query("p22_utility", "SELECT p_partkey, round(p_retailprice / ((1.0::DOUBLE + p_size) * (1.0::DOUBLE + p_partkey % 5) * (1.0::DOUBLE + log2(1.0::DOUBLE + p_partkey % 7))), 9) AS utility FROM part")
def p22(spark, sf_dir):
    u = records.utility(F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 5, F.col("p_partkey") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(u, 9).alias("utility"))


@query("p23_projected_equality", "SELECT event_id, '$.k' AS path FROM events WHERE event_id % 10 = 0")
def p23(spark, sf_dir):
    """Leaves of altered records that differ from the full ones."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    altered = e.withColumn("props", F.when(F.col("event_id") % 10 == 0, F.regexp_replace("props", r": (\d+)", ': "$1"')).otherwise(F.col("props")))
    return records.projected_differences(variants.leaves(altered, "event_id", "props"), variants.leaves(e, "event_id", "props"), "event_id").select("event_id", "path")


@query("o01_canonical_order", f"WITH {decided('sum_product')} SELECT row_number() OVER (ORDER BY {bitstring('syn', 9)}) AS nth, {bitstring('syn', 9)} AS syndrome, {bitstring('correction', 18)} AS correction FROM de")
def o01(spark, sf_dir):
    d = decode.decisions(decode.classes(generators.states(spark)), "sum_product")
    d = d.select(bits.encode("syn", 9).alias("syndrome"), bits.encode("correction", 18).alias("correction"))
    return d.withColumn("nth", F.row_number().over(Window.orderBy("syndrome")).cast("long"))


@query("o05_latest_receipt", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def o05(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


# More of the algebra, planning and validation


@query("l05_reduced_echelon", f"WITH {span_sql(BASIS_MASKS)}, p AS (SELECT s, length({bitstring('s', 18)}) - length(ltrim({bitstring('s', 18)}, '0')) AS place FROM sp WHERE s <> 0), q AS (SELECT DISTINCT place FROM p) SELECT place, {bitstring('s', 18)} AS line FROM p WHERE (SELECT count(*) FROM q WHERE q.place <> p.place AND substr({bitstring('p.s', 18)}, (q.place + 1)::INTEGER, 1) = '1') = 0")
def l05(spark, sf_dir):
    """Reduced rows: of all combinations, those with a pivot of their own and zeros in the other pivots."""
    h = gf2.check_matrices(spark, (C18,)).where("side = 'x'")

    def reduce_(f):
        import pandas as pd

        rows = f.groupby("r")["c"].agg(lambda c: sum(1 << int(x) for x in c)).tolist()
        reduced, pivots = codes.reduced(rows, 18)
        return pd.DataFrame({"place": pivots, "line": ["".join("01"[r >> i & 1] for i in range(18)) for r in reduced]})

    return h.groupBy("n").applyInPandas(reduce_, "place long, line string")


@query("l13_class_seeds", f"WITH st AS (SELECT e, {parities('e', [*CHECKS_18, *LOGICALS_18])} AS sel FROM range(262144) t(e)), se AS (SELECT e, sel FROM st WHERE e & ~{sum(1 << q for q in SEED_QUBITS)} = 0) SELECT sel AS selector, e AS seed FROM se")
def l13(spark, sf_dir):
    """Each reachable selector with the seed that realises it."""
    c = spark.range(1 << len(SEED_QUBITS)).select(bits.lift("id", [1 << q for q in SEED_QUBITS]).alias("seed"))
    return c.select(bits.syndrome("seed", [*CHECKS_18, *LOGICALS_18]).alias("selector"), "seed")


@query("a15_diagnostics", greedy_sql().rsplit("SELECT count(*) AS total", 1)[0] + "SELECT stalled, count(*) AS inputs, sum(k)::BIGINT AS iterations, count(*) FILTER (success) AS success FROM g GROUP BY stalled")
def a15(spark, sf_dir):
    g = decode.greedy(generators.weight_shells(spark))
    return g.groupBy("stalled").agg(F.count("*").alias("inputs"), F.sum("iterations").cast("long").alias("iterations"), F.count_if("success").alias("success"))


@query("a16_stream_digest", "WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r(conv_id, i, h) AS (SELECT conv_id, 0::BIGINT, '' FROM t GROUP BY conv_id UNION ALL SELECT r.conv_id, t.i, sha256(r.h || t.text) FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1), m AS (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id) SELECT r.conv_id, r.h AS digest FROM r JOIN m USING (conv_id, i)")
def a16(spark, sf_dir):
    return temporal.chained_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("x03_scope_algebra", f"WITH {INCIDENCE}, a AS (SELECT x.v AS variable, list(DISTINCT y.v ORDER BY y.v) AS u FROM inc x JOIN inc y ON x.q = y.q GROUP BY x.v) SELECT variable, u::VARCHAR AS joint, list_filter(u, lambda z: z <> variable)::VARCHAR AS output FROM a")
def x03(spark, sf_dir):
    s = incidence(spark).groupBy("q").agg(F.array_sort(F.collect_set("v")).alias("scope"))
    u = s.select(F.explode("scope").alias("variable"), "scope").groupBy("variable").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("scope")))).alias("u"))
    show = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
    return u.select("variable", show(F.col("u")).alias("joint"), show(F.array_except("u", F.array("variable"))).alias("output"))


#: The published structure of single instances (fixed values).
@query("d14_feasibility", "SELECT * FROM (VALUES (72, 12, 30, 18, 524288::BIGINT), (90, 8, 41, 25, 67108864)) t(n, k, rank, width, peak)")
def d14(spark, sf_dir):
    """Structure of single instances: logical dimension, rank, width and the largest table."""
    jobs = spark.createDataFrame([(72,), (90,)], "n int")

    def run(frames):
        import pandas as pd

        by_n = {c[0]: c for c in LADDER}
        for f in frames:
            out = []
            for n in f["n"]:
                rank = len(codes.independent(codes.checks(by_n[n])[0]))
                width = orders.width(orders.eliminate(codes.scopes(by_n[n]), rank, "min_fill"))
                out.append((n, len(codes.logical_basis(by_n[n])), rank, width, 1 << width + 1))
            yield pd.DataFrame(out, columns=["n", "k", "rank", "width", "peak"])

    return jobs.mapInPandas(run, "n int, k int, rank int, width int, peak long")


@query("v01_domain_rules", "SELECT o_orderkey, 'positive price' AS rule FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'known status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'urgent is open' FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'O'")
def v01(spark, sf_dir):
    rules = {"positive price": F.col("o_totalprice") > 1000, "known status": F.col("o_orderstatus").isin("F", "O"), "urgent is open": ~F.col("o_orderpriority").startswith("1") | (F.col("o_orderstatus") == "O")}
    return records.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("g07_plan_evaluation", f"WITH {CLASSES} SELECT syn, lab, m9, m2, w, rep, key FROM cl")
def g07(spark, sf_dir):
    """Each task contracts the factors for its selectors at once, by the planned order."""
    scopes = codes.scopes(C18)

    def run(frames):
        for f in frames:
            yield f.assign(**elimination.evaluate_plan(scopes, ORDER_18, f["seed"].to_numpy()))

    seeds = spark.range(1 << len(SEED_QUBITS)).select(bits.lift("id", [1 << q for q in SEED_QUBITS]).alias("seed"))
    seeds = seeds.withColumns({"syn": bits.syndrome("seed", CHECKS_18), "lab": bits.syndrome("seed", LOGICALS_18)})
    return seeds.mapInPandas(run, "seed long, syn long, lab long, m9 long, m2 long, w int, rep long, key long").drop("seed")


#: The published bounds (fixed values).
@query("g11_node_bounds", "SELECT * FROM (VALUES (0, 802159899::BIGINT), (1, 802158780), (2, 574427108), (3, 573812180)) t(refinement, bound)")
def g11(spark, sf_dir):
    """Upper bounds on the nodes of the 90-bit code's min-plus graph, each tighter than the last; nothing is built."""
    code = LADDER[1]
    s = codes.scopes(code)
    order = [v for v, _, _ in orders.eliminate(s, len(codes.independent(codes.checks(code)[0])), "min_fill")]
    return spark.createDataFrame(list(enumerate(orders.node_bounds(s, codes.selector_qubits(code), order, 1 + code[0]))), "refinement int, bound long")


from . import queries_files, queries_links, queries_plans, queries_rules  # noqa: E402, F401  (they register more, with what is defined above)
