"""Queries of validation: rules, chains, receipts, catalogues, shards and rewrites.  Altered inputs are made from the tables, so that each rule is broken somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import own_folder
from .functions import records, variants
from .functions.codes import CHECKS_18, LOGICALS_18
from .operators import score

from .queries import BASIS_18, query, table
from .queries_plans import CANDIDATES, LADDER, card_sql, d11, planned

# Schemas and guards

PROFILE_SCHEMA = {
    "type": "object",
    "required": ["id", "name", "profile", "marks"],
    "properties": {
        "id": {"type": "integer", "minimum": 2},
        "name": {"type": "string", "pattern": "Customer#[0-9]*[02468]", "minLength": 5},
        "profile": {"type": "object", "required": ["nation", "segment"], "additionalProperties": False, "properties": {"nation": {"type": "integer", "minimum": 5}, "segment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}}},
        "marks": {"type": "array", "uniqueItems": True, "items": {"type": ["integer", "null"], "minimum": 1}},
    },
}


@query(
    "p17_nested_violations",
    """WITH c AS (SELECT *, c_custkey % 17 <> 0 AS has, [c_custkey % 3, c_custkey % 5, c_custkey % 7] AS marks FROM customer)
SELECT c_custkey, '$.id' AS path, 'minimum' AS rule FROM c WHERE c_custkey < 2 UNION ALL SELECT c_custkey, '$.name', 'pattern' FROM c WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')
UNION ALL SELECT c_custkey, '$.name', 'minLength' FROM c WHERE length(c_name) < 5 UNION ALL SELECT c_custkey, '$.profile', 'required' FROM c WHERE NOT has
UNION ALL SELECT c_custkey, '$.profile.extra', 'unknown' FROM c WHERE has AND c_custkey % 13 = 0 UNION ALL SELECT c_custkey, '$.profile.nation', 'minimum' FROM c WHERE has AND c_nationkey < 5 AND c_custkey % 19 <> 0
UNION ALL SELECT c_custkey, '$.profile.nation', 'required' FROM c WHERE has AND c_custkey % 19 = 0
UNION ALL SELECT c_custkey, '$.profile.segment', 'enum' FROM c WHERE has AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL SELECT c_custkey, '$.marks', 'uniqueItems' FROM c WHERE len(list_distinct(marks)) < 3
UNION ALL SELECT c_custkey, '$.marks[' || (i - 1) || ']', 'minimum' FROM c, range(1, 4) t(i) WHERE marks[i] < 1""",
)
def p17_nested(spark, sf_dir):
    """JSON documents with nested objects and arrays, each violation with its path."""
    k = F.col("c_custkey")
    profile = F.struct(F.when(k % 19 != 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(k % 13 == 0, 1).alias("extra"))  # nulls are left out of the text
    text = F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 17 != 0, profile).alias("profile"), F.array(k % 3, k % 5, k % 7).alias("marks")))
    return variants.violations(table(spark, sf_dir, "customer").select("c_custkey", text.alias("document")), "c_custkey", "document", PROFILE_SCHEMA)


@query("p18_unique_texts", "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN [] WHEN c_custkey % 5 = 0 THEN [c_name, '  '] WHEN c_custkey % 4 = 0 THEN [c_name, c_mktsegment, c_name] ELSE [c_name, c_mktsegment] END AS x FROM customer) SELECT c_custkey, len(x) > 0 AND len(list_filter(x, lambda i: trim(i) = '')) = 0 AND len(list_distinct(x)) = len(x) AS valid FROM a")
def p18_unique(spark, sf_dir):
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    x = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(name, F.lit("  "))).when(k % 4 == 0, F.array(name, segment, name)).otherwise(F.array(name, segment))
    return table(spark, sf_dir, "customer").select("c_custkey", records.unique_texts(x).alias("valid"))


@query(
    "p20_intervals",
    "SELECT event_id, 'start' AS rule FROM events WHERE event_id % 7 = 2 UNION ALL SELECT event_id, 'finish' FROM events WHERE event_id % 11 = 3 UNION ALL SELECT event_id, 'order' FROM events WHERE event_id % 5 = 4 AND event_id % 7 <> 2 AND event_id % 11 <> 3",
)
def p20_intervals(spark, sf_dir):
    """Starts and finishes as texts in different offsets; some without an offset, some in the wrong order."""
    k = F.col("event_id")
    start = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 7 == 2, "").otherwise("Z"))
    moved = F.col("ts") + F.make_dt_interval(mins=F.when(k % 5 == 4, 59).otherwise(61))  # an hour ahead by the clock is the same time in +01:00
    finish = F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 11 == 3, "").otherwise("+01:00"))
    e = table(spark, sf_dir, "events").select("event_id", start.alias("start"), finish.alias("finish"))
    return records.violations(e, "event_id", records.in_order(F.col("start"), F.col("finish")))


# Domain rules, chains, history

#: Declared metrics of the candidates; one of each is wrong.
DECLARED = (("or_marked_amplitude", 16, 5, 0, 0.5, 2, 0.0625), ("majority_hamming", 32, 6, 1, 0.4, 1, 0.05), ("parity_phase", 16, 2, 0, 1.0, 1, 0.1), ("parity_hamming", 32, 5, 0, 0.5, 4, 0.025))
METRICS = ("domain", "signals", "collisions", "gap", "alternations", "utility")


@query(
    "v01_expected_metrics",
    f"WITH r AS ({' UNION ALL '.join(card_sql(c) for c in CANDIDATES)}), d(candidate, {', '.join(METRICS)}) AS (VALUES " + ", ".join(f"('{n}', {', '.join(f'{x}::DOUBLE' for x in v)})" for n, *v in DECLARED) + ") " + " UNION ALL ".join(f"SELECT r.candidate, '{m}' AS metric FROM r JOIN d USING (candidate) WHERE abs(r.{m}::DOUBLE - d.{m}) > 1e-9" for m in METRICS),
)
def v01_metrics(spark, sf_dir):
    """Declared metrics of each candidate against those that are computed."""
    declared = spark.createDataFrame([(n, *map(float, v)) for n, *v in DECLARED], "candidate string, " + ", ".join(f"{m}_declared double" for m in METRICS))
    both = d11(spark, sf_dir).join(declared, "candidate")
    rules = {m: F.abs(F.col(m).cast("double") - F.col(f"{m}_declared")) <= 1e-9 for m in METRICS}
    return records.violations(both, "candidate", rules).withColumnRenamed("rule", "metric")


@query(
    "v02_predecessor_chain",
    """WITH c AS (SELECT item_id, sha256(text) AS own, lag(sha256(text)) OVER (ORDER BY item_id) AS before, sha256(CASE WHEN item_id % 9 = 0 THEN text || '.' ELSE text END) AS told FROM benchmark)
SELECT item_id, 'self_digest' AS rule FROM c WHERE own <> told UNION ALL SELECT item_id, 'predecessor' FROM c WHERE before IS NOT NULL AND item_id % 7 = 3 UNION ALL SELECT item_id, 'predecessor' FROM c WHERE before IS NULL AND item_id % 7 = 3
UNION ALL SELECT item_id, 'status' FROM c WHERE item_id % 11 = 5 UNION ALL SELECT item_id, 'scope' FROM c WHERE item_id % 13 = 6""",
)
def v02(spark, sf_dir):
    """Records that name their own digest, their predecessor's, a status and what they exclude: all are checked."""
    k = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.sha2("text", 256).alias("own"))
    n = b.select((k + 1).alias("item_id"), F.col("own").alias("before"))
    r = b.join(n, "item_id", "left")
    told = F.sha2(F.when(k % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)
    excluded = F.when(k % 13 == 6, F.array(F.lit("claims"))).otherwise(F.array(F.lit("claims"), F.lit("promotion")))
    r = r.withColumns({"told": told, "told_before": F.when(k % 7 == 3, F.lit("x")).otherwise(F.col("before")), "status": F.when(k % 11 == 5, "DRAFT").otherwise("COMPLETE"), "excluded": excluded})
    rules = {
        "self_digest": F.col("own") == F.col("told"),
        "predecessor": F.col("told_before").eqNullSafe(F.col("before")),
        "status": F.col("status") == "COMPLETE",
        "scope": F.array_contains("excluded", "promotion"),
    }
    return records.violations(r, "item_id", rules)


@query(
    "v03_history_equality",
    """SELECT doc_id, CASE WHEN doc_id % 19 = 4 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ledger' END AS problem FROM documents WHERE doc_id % 19 = 4 OR doc_id % 7 = 0 OR doc_id % 29 = 8
UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 23 = 5""",
)
def v03(spark, sf_dir):
    """Source, target and a ledger of (path, bytes, digest), reconciled by full outer joins; the target lacks, alters and adds files, the ledger is wrong of some."""
    record = lambda d: d.select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
    k, docs = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = record(docs)
    target = docs.where(k % 19 != 4).withColumn("text", F.when(k % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    target = record(target.unionByName(docs.where(k % 23 == 5).withColumn("doc_id", -1 - k)))
    ledger = source.withColumn("bytes", F.when(k % 29 == 8, F.col("bytes") + 1).otherwise(F.col("bytes")))
    side = lambda d, name: d.select("doc_id", F.struct("bytes", "sha").alias(name))
    all_ = side(source, "s").join(side(target, "t"), "doc_id", "full_outer").join(side(ledger, "l"), "doc_id", "full_outer")
    problem = F.when(F.col("s").isNull(), "added").when(F.col("t").isNull(), "missing").when(F.col("s") != F.col("t"), "changed").when(~F.col("l").eqNullSafe(F.col("s")), "ledger")
    return all_.select("doc_id", problem.alias("problem")).where("problem is not null")


def identity(files, key: str, chunk: int = 1000):
    """One digest of the ordered records (key, sha): chunks of consecutive keys first, so that no task holds more than one chunk."""
    one = files.groupBy(F.floor(F.col(key) / chunk).alias("c")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(key, "sha"))), lambda x: x["sha"])), 256).alias("sha"))
    top = one.groupBy(F.floor(F.col("c") / chunk).alias("d")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("c", "sha"))), lambda x: x["sha"])), 256).alias("sha"))
    return top.agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("d", "sha"))), lambda x: x["sha"])), 256).alias("identity"))


def identity_sql(sha: str) -> str:
    return f"SELECT sha256(string_agg(sha, ',' ORDER BY d)) AS identity FROM (SELECT c // 1000 AS d, sha256(string_agg(sha, ',' ORDER BY c)) AS sha FROM (SELECT doc_id // 1000 AS c, sha256(string_agg({sha}, ',' ORDER BY doc_id)) AS sha FROM documents GROUP BY 1) GROUP BY 1)"


@query("v03_identity", f"SELECT 'source' AS side, identity FROM ({identity_sql('sha256(coalesce(text, chr(0)))')}) UNION ALL SELECT 'target', identity FROM ({identity_sql('sha256(coalesce(text, chr(0)) || (CASE WHEN doc_id = 7 THEN chr(120) ELSE repeat(chr(120), 0) END))')})".replace("chr(0)", "''"))
def v03_identity(spark, sf_dir):
    """The ordered identity of a history, and that of one with a single character more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    one = lambda d, side: identity(d.select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id").select(F.lit(side).alias("side"), "identity")
    return one(docs, "source").unionByName(one(other, "target"))


# Component catalogues

#: (component, owner, path prefix, depends on, checks): an invented catalogue with one fault of each kind.
CATALOGUE = (
    ("algebra", "a", "src/algebra/", ("bits",), ("unit",)),
    ("bits", "a", "src/bits/", (), ("unit", "types")),
    ("decoders", "b", "src/decoders/", ("algebra", "graphs"), ("unit", "slow")),
    ("graphs", "b", "src/graphs/", ("algebra",), ("unit",)),
    ("loop_a", "c", "src/loop/a/", ("loop_b",), ("unit",)),
    ("loop_b", "c", "src/loop/b/", ("loop_c",), ("unit",)),
    ("loop_c", "c", "src/loop/c/", ("loop_a",), ("unit",)),
    ("own_parent", "c", "src/own/", ("own_parent",), ("unit",)),
    ("lost", "c", "src/lost/", ("nowhere",), ("unit",)),
    ("unchecked", "c", "src/unchecked/", (), ()),
    ("unowned", " ", "src/unowned/", ("bits",), ("unit",)),
    ("pathless", "d", "", (), ("types",)),
    ("odd_check", "d", "src/odd/", (), ("unit", "magic")),
)
CHECKS = ("slow", "types", "unit")
CHANGED = ("src/bits/shift.py", "src/graphs/dag.py", "src/decoders/x.py", "docs/readme.md")


def listed(x) -> str:
    return "[" + ", ".join(f"'{i}'" for i in x) + "]::VARCHAR[]"


CATALOGUE_SQL = "cat(component, owner, prefix, needs, checks) AS (VALUES " + ", ".join(f"('{c}', '{o}', '{p}', {listed(d)}, {listed(k)})" for c, o, p, d, k in CATALOGUE) + "), dep AS (SELECT component AS child, unnest(needs) AS parent FROM cat)"


def catalogue(spark):
    return spark.createDataFrame([(c, o, p, list(d), list(k)) for c, o, p, d, k in CATALOGUE], "component string, owner string, prefix string, needs array<string>, checks array<string>")


def reach(spark, depends):
    """(child, parent, path): everything that each component depends on, however far; a component met again ends its path."""
    return spark.sql(
        """WITH RECURSIVE r AS (
             SELECT child, parent, array(child) AS path FROM {d} UNION ALL
             SELECT r.child, d.parent, array_append(r.path, r.parent) FROM r JOIN {d} d ON d.child = r.parent WHERE NOT array_contains(r.path, r.parent)
           ) SELECT DISTINCT child, parent FROM r""",
        d=depends,
    )


@query(
    "v04_catalogue_problems",
    f"""WITH RECURSIVE {CATALOGUE_SQL}, re(child, parent) AS (SELECT child, parent FROM dep UNION SELECT r.child, d.parent FROM re r JOIN dep d ON d.child = r.parent)
SELECT component, 'no owner' AS problem FROM cat WHERE trim(owner) = '' UNION ALL SELECT component, 'no path' FROM cat WHERE prefix = '' UNION ALL SELECT component, 'no checks' FROM cat WHERE len(checks) = 0
UNION ALL SELECT component, 'unknown check' FROM cat WHERE NOT list_has_all({listed(CHECKS)}, checks) UNION ALL SELECT child, 'self dependency' FROM dep WHERE child = parent
UNION ALL SELECT child, 'unknown dependency' FROM dep WHERE parent NOT IN (SELECT component FROM cat) UNION ALL SELECT child, 'cycle' FROM re WHERE child = parent""",
)
def v04_problems(spark, sf_dir):
    c = catalogue(spark)
    depends = c.select(F.col("component").alias("child"), F.explode("needs").alias("parent"))
    rules = {"no owner": records.non_empty(F.col("owner")), "no path": F.col("prefix") != "", "no checks": F.size("checks") > 0, "unknown check": F.size(F.array_except("checks", F.array(*map(F.lit, CHECKS)))) == 0, "self dependency": ~F.array_contains("needs", F.col("component"))}
    own = records.violations(c, "component", rules).withColumnRenamed("rule", "problem")
    unknown = depends.join(c.select(F.col("component").alias("parent")), "parent", "left_anti").select(F.col("child").alias("component"), F.lit("unknown dependency").alias("problem"))
    cycles = reach(spark, depends).where("child = parent").select(F.col("child").alias("component"), F.lit("cycle").alias("problem"))
    return own.unionByName(unknown.distinct()).unionByName(cycles)


@query("v04_affected_components", f"WITH RECURSIVE {CATALOGUE_SQL}, r(changed, affected) AS (SELECT component, component FROM cat UNION SELECT r.changed, d.child FROM r JOIN dep d ON d.parent = r.affected) SELECT changed, affected FROM r")
def v04(spark, sf_dir):
    """Components that depend on each changed one, however far, itself included."""
    c = catalogue(spark)
    depends = c.select(F.col("component").alias("child"), F.explode("needs").alias("parent"))
    known = c.select(F.col("component").alias("parent"))
    down = reach(spark, depends).join(known, "parent").select(F.col("parent").alias("changed"), F.col("child").alias("affected"))
    return down.unionByName(c.select(F.col("component").alias("changed"), F.col("component").alias("affected"))).distinct()


@query(
    "v04_routed_checks",
    f"""WITH RECURSIVE {CATALOGUE_SQL}, ch(path) AS (VALUES {', '.join(f"('{x}')" for x in CHANGED)}), ow AS (SELECT path, component FROM ch LEFT JOIN cat ON prefix <> '' AND starts_with(path, prefix)),
r(path, affected) AS (SELECT path, component FROM ow WHERE component IS NOT NULL UNION SELECT r.path, d.child FROM r JOIN dep d ON d.parent = r.affected)
SELECT DISTINCT path, unnest(checks) AS "check" FROM r JOIN cat ON component = affected UNION SELECT path, unnest({listed(CHECKS)}) FROM ow WHERE component IS NULL""",
)
def v04_checks(spark, sf_dir):
    """The checks that each changed path calls for: those of all components it affects, or every check where no component owns it."""
    c = catalogue(spark)
    paths = spark.createDataFrame([(x,) for x in CHANGED], "path string")
    owned = score.owners(paths, c.where("prefix <> ''").select("prefix", F.col("component").alias("owner"))).select("path", "owner")
    affected = owned.join(v04(spark, sf_dir), F.col("owner") == F.col("changed")).select("path", F.col("affected").alias("component"))
    mine = affected.join(c, "component").select("path", F.explode("checks").alias("check"))
    every = owned.where("owner is null").select("path", F.explode(F.array(*map(F.lit, CHECKS))).alias("check"))
    return mine.unionByName(every).distinct()


# Receipts, shards, jobs

RECEIPT_SQL = {
    "record type": "o_orderkey % 41 = 1",
    "manifest": "o_orderkey % 37 = 2",
    "provider": "o_orderkey % 17 = 0",
    "attempt": "o_orderkey % 5 NOT IN (1, 2, 3)",
    "started": "o_orderkey % 19 = 3",
    "finished": "o_orderkey % 43 = 4",
    "order": "o_orderkey % 23 = 5 AND o_orderkey % 19 <> 3 AND o_orderkey % 43 <> 4",
    "semantics": "o_orderkey % 31 = 6",
    "promotion": "o_orderkey % 29 = 7",
    "status": "o_orderkey % 13 = 8",
}


@query("v06_receipt_rules", " UNION ALL ".join(f"SELECT o_orderkey, '{rule}' AS rule FROM orders WHERE {broken}" for rule, broken in RECEIPT_SQL.items()))
def v06(spark, sf_dir):
    """Receipts of runs: identity, provider, attempts, times, claims and outcome, each rule broken by some."""
    k = F.col("o_orderkey")
    text = lambda moved: F.date_format(F.col("o_orderdate") + F.make_dt_interval(mins=moved), "yyyy-MM-dd'T'HH:mm:ss")
    receipts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 41 == 1, "OTHER").otherwise("RECEIPT").alias("record_type"),
        F.when(k % 37 == 2, "0").otherwise("1").alias("manifest"),
        F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("run-"), k)).alias("execution_id"),
        (k % 5).alias("attempt"),
        F.concat(text(F.lit(0)), F.when(k % 19 == 3, "").otherwise("Z")).alias("started"),
        F.concat(text(F.when(k % 23 == 5, -1).otherwise(0)), F.when(k % 43 == 4, "x").otherwise("Z")).alias("finished"),
        (k % 31 == 6).alias("semantics_changed"),
        (k % 29 == 7).alias("promotion_claim"),
        F.when(k % 13 == 8, 1).otherwise(0).alias("returncode"),
    )
    time = records.in_order(F.col("started"), F.col("finished"))
    rules = {
        "record type": F.col("record_type") == "RECEIPT",
        "manifest": F.col("manifest") == "1",
        "provider": records.non_empty(F.col("execution_id")),
        "attempt": F.col("attempt").between(1, 3),
        "started": time["start"],
        "finished": time["finish"],
        "order": time["order"],
        "semantics": ~F.col("semantics_changed"),
        "promotion": ~F.col("promotion_claim"),
        "status": F.col("returncode") == 0,
    }
    return records.violations(receipts, "o_orderkey", rules)


@query(
    "v07_shard_coverage",
    """WITH e AS (SELECT o_orderkey % 64 AS shard, count(*) AS n FROM orders GROUP BY 1) SELECT shard, 'missing' AS problem FROM e WHERE shard = 5 UNION ALL SELECT shard, 'repeated' FROM e WHERE shard = 9
UNION ALL SELECT 70, 'unknown' UNION ALL SELECT shard, 'incomplete' FROM e WHERE shard = 12 AND (SELECT count(*) FROM orders WHERE o_orderkey % 128 = 12) > 0""",
)
def v07_coverage(spark, sf_dir):
    """Results of 64 shards against the whole: one shard is missing, one came twice, one isn't of this run, one lacks rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 64).alias("shard"))
    shards = lambda d: d.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor("o_orderkey").alias("mark"))
    expected = shards(o)
    came = shards(o.where("shard <> 5 and not o_orderkey % 128 = 12"))
    came = came.unionByName(came.where("shard = 9")).unionByName(spark.createDataFrame([(70, 1, 1)], "shard long, n long, mark long"))
    found = score.coverage(expected, came, "shard")
    e = expected.select("shard", F.struct("n", "mark").alias("e"))
    less = came.join(e, "shard").where(F.struct("n", "mark") != F.col("e")).select("shard", F.lit("incomplete").alias("problem")).distinct()
    return found.unionByName(less)


@query("v08_ordered_map", """SELECT event_id AS idx, sha256(replace(props, ' ', '')) AS value FROM events""")
def v08(spark, sf_dir):
    """Python work (canonical JSON and its digest) spread over tasks, each result with the index of its input: order is data, not delivery."""
    import hashlib
    import json

    def run(frames):
        for f in frames:
            yield f.assign(value=[hashlib.sha256(records.canonical(json.loads(x)).encode()).hexdigest() for x in f["props"]])[["idx", "value"]]

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "props").mapInPandas(run, "idx long, value string")


@query(
    "v08_canonical_events",
    """SELECT event_id AS idx, sha256('{"a":{"x":[' || user_id || ',{"k":null}],"y":true},"event":"' || event_type || '","z":' || event_id || '}') AS value FROM events""",
)
def v08_canonical(spark, sf_dir):
    """Events as JSON with members in other orders and spaces between, by the digest of their canonical form; no Python."""
    k, spelled = F.col("event_id").cast("string"), F.concat
    one = spelled(F.lit('{ "z": '), k, F.lit(', "event": "'), "event_type", F.lit('", "a": {"y": true, "x": ['), F.col("user_id").cast("string"), F.lit(', {"k": null}]}}'))
    two = spelled(F.lit('{"a":{"x":['), F.col("user_id").cast("string"), F.lit(',{"k" :null} ],"y":true},"z":'), k, F.lit(',"event":"'), "event_type", F.lit('"}'))
    text = F.when(F.col("event_id") % 2 == 0, one).otherwise(two)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.sha2(variants.canonical(text), 256).alias("value"))


@query(
    "v07_shard_files",
    """WITH e AS (SELECT o_orderkey % 64 AS shard, o_orderkey FROM orders), c AS (SELECT * FROM e WHERE shard <> 5 AND NOT o_orderkey % 128 = 12 UNION ALL SELECT * FROM e WHERE shard = 9)
SELECT shard, 'missing' AS problem FROM e GROUP BY shard HAVING shard NOT IN (SELECT shard FROM c) UNION ALL
SELECT shard, 'incomplete' FROM (SELECT shard, count(*) AS n FROM e GROUP BY shard) JOIN (SELECT shard, count(DISTINCT o_orderkey) AS m FROM c GROUP BY shard) USING (shard) WHERE m < n UNION ALL SELECT shard, 'repeated' FROM c GROUP BY shard HAVING count(*) > count(DISTINCT o_orderkey)""",
)
def v07_files(spark, sf_dir):
    """Shards as folders of JSON files against their manifest, both written by tasks: one is missing, one lacks rows, one came twice."""
    root = own_folder(spark, "shards")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 64).alias("shard"))
    o.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("o_orderkey", "o_totalprice")).alias("mark")).write.parquet(f"{root}/manifest")
    came = o.where("shard <> 5 and not o_orderkey % 128 = 12")
    came.unionByName(o.where("shard = 9")).write.partitionBy("shard").json(f"{root}/shards")
    read = spark.read.schema("o_orderkey long, o_totalprice double, shard long").json(f"{root}/shards")
    rows = read.groupBy("shard", "o_orderkey", "o_totalprice").agg(F.count("*").alias("times"))  # before marks: a row that came twice would cancel
    found = rows.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("o_orderkey", "o_totalprice")).alias("mark"), F.max("times").alias("times"))
    told = spark.read.schema("shard long, n long, mark long").parquet(f"{root}/manifest")
    absent = score.coverage(told, found, "shard")
    both = told.select("shard", F.struct("n", "mark").alias("told")).join(found, "shard")
    less = both.where(F.struct("n", "mark") != F.col("told")).select("shard", F.lit("incomplete").alias("problem"))
    return absent.unionByName(less).unionByName(both.where("times > 1").select("shard", F.lit("repeated").alias("problem")))


JOBS_SQL = """jb AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'GPU' WHEN '2' THEN 'TPU' WHEN '3' THEN 'FPGA' ELSE 'CPU' END AS variant, CASE WHEN o_orderkey % 3 = 0 THEN 'T4' WHEN o_orderkey % 3 = 1 THEN 'V5E1' ELSE NULL END AS accelerator,
  o_orderkey % 47 = 3 AS authorized, CASE WHEN o_orderkey % 53 = 4 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'exact_candidate' ELSE 'probe' END AS workload, o_orderstatus <> 'F' AS enabled FROM orders),
pr AS (SELECT o_orderkey, 'variant' AS rule FROM jb WHERE variant = 'FPGA' UNION ALL SELECT o_orderkey, 'accelerator' FROM jb WHERE (variant = 'CPU' AND accelerator IS NOT NULL) OR (variant = 'GPU' AND coalesce(accelerator, '') <> 'T4') OR (variant = 'TPU' AND coalesce(accelerator, '') <> 'V5E1')
  UNION ALL SELECT o_orderkey, 'authorization' FROM jb WHERE authorized UNION ALL SELECT o_orderkey, 'workload' FROM jb WHERE workload = 'unknown' UNION ALL SELECT o_orderkey, 'must be disabled' FROM jb WHERE workload = 'exact_candidate' AND enabled)"""


def jobs(spark, sf_dir):
    k, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(first == "1", "GPU").when(first == "2", "TPU").when(first == "3", "FPGA").otherwise("CPU").alias("variant"),
        F.when(k % 3 == 0, "T4").when(k % 3 == 1, "V5E1").alias("accelerator"),
        (k % 47 == 3).alias("authorized"),
        F.when(k % 53 == 4, "unknown").when(k % 5 == 0, "exact_candidate").otherwise("probe").alias("workload"),
        (F.col("o_orderstatus") != "F").alias("enabled"),
    )


def job_rules() -> dict:
    variant, accelerator, workload = F.col("variant"), F.col("accelerator"), F.col("workload")
    fits = F.when(variant == "CPU", accelerator.isNull()).when(variant == "GPU", accelerator.eqNullSafe("T4")).when(variant == "TPU", accelerator.eqNullSafe("V5E1")).otherwise(True)
    return {
        "variant": variant.isin("CPU", "GPU", "TPU"),
        "accelerator": fits,
        "authorization": ~F.col("authorized"),
        "workload": workload.isin("probe", "preflight", "exact_candidate"),
        "must be disabled": (workload != "exact_candidate") | ~F.col("enabled"),
    }


@query("v09_job_problems", f"WITH {JOBS_SQL} SELECT o_orderkey, rule FROM pr")
def v09_problems(spark, sf_dir):
    return records.violations(jobs(spark, sf_dir), "o_orderkey", job_rules())


@query("v09_pending_jobs", f"WITH {JOBS_SQL} SELECT o_orderkey FROM jb WHERE enabled AND o_orderkey NOT IN (SELECT o_orderkey FROM pr) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def v09(spark, sf_dir):
    """What a resumed run still has to do: valid, enabled jobs without a green receipt."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    broken = v09_problems(spark, sf_dir).select("o_orderkey")
    return jobs(spark, sf_dir).where("enabled").select("o_orderkey").join(broken, "o_orderkey", "left_anti").join(done, "o_orderkey", "left_anti")


# Rewrites, caps, eligibility


def xor(*columns):
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def bit(i: int):
    return F.shiftright("id", i).bitwiseAND(F.lit(1).cast("long"))


def receipt(assignments, name: str, originals: int, holds, mismatch):
    """Over all values of the original bits (low) and the auxiliary ones: how many extensions satisfy the relations, and how many of them differ from the original value."""
    kept = assignments.withColumns({"holds": holds, "differs": mismatch})
    each = kept.groupBy((F.col("id") % (1 << originals)).alias("original")).agg(F.count_if("holds").alias("extensions"), F.count_if(F.col("holds") & F.col("differs")).alias("differ"))
    return each.agg(F.lit(name).alias("receipt"), F.count("*").alias("originals"), F.min("extensions").alias("least"), F.max("extensions").alias("most"), F.sum("differ").alias("mismatches"))


def receipt_sql(name: str, originals: int, auxiliaries: int, holds: str, mismatch: str) -> str:
    return f"SELECT '{name}' AS receipt, count(*) AS originals, min(n) AS least, max(n) AS most, sum(d)::BIGINT AS mismatches FROM (SELECT id % {1 << originals} AS o, count(*) FILTER ({holds}) AS n, count(*) FILTER (({holds}) AND ({mismatch})) AS d FROM range({1 << (originals + auxiliaries)}) t(id) GROUP BY 1)"


def b(i: int) -> str:
    return f"((id >> {i}) & 1)"


ROW_WEIGHT = CHECKS_18[BASIS_18[0]].bit_count()
SUPPORT = (1 << ROW_WEIGHT) - 1
WRONG = "a chain that misses a term"


@query(
    "g12_rewrite",
    " UNION ALL ".join([
        receipt_sql("terminal", 3, 1, f"{b(3)} = xor(xor({b(0)}, {b(1)}), {b(2)})", "false"),
        receipt_sql("chain", 3, 2, f"{b(3)} = xor({b(0)}, {b(1)}) AND {b(4)} = xor({b(3)}, {b(2)})", f"{b(4)} <> xor(xor({b(0)}, {b(1)}), {b(2)})"),
        receipt_sql(WRONG, 3, 2, f"{b(3)} = xor({b(0)}, {b(1)}) AND {b(4)} = {b(3)}", f"{b(4)} <> xor(xor({b(0)}, {b(1)}), {b(2)})"),
        receipt_sql("a free auxiliary", 3, 2, f"{b(4)} = xor(xor({b(0)}, {b(1)}), {b(2)})", "false"),
        receipt_sql("increment", ROW_WEIGHT, 1, f"{b(ROW_WEIGHT)} = bit_count(id & {SUPPORT}) % 2", "false"),
        receipt_sql("first detector", ROW_WEIGHT + 1, 1, f"{b(ROW_WEIGHT + 1)} = bit_count(id & {SUPPORT}) % 2", f"xor({b(ROW_WEIGHT + 1)}, {b(ROW_WEIGHT)}) <> bit_count(id & {2 * SUPPORT + 1}) % 2"),
        receipt_sql("later detector", ROW_WEIGHT + 2, 1, f"{b(ROW_WEIGHT + 2)} = bit_count(id & {SUPPORT}) % 2", f"xor(xor({b(ROW_WEIGHT + 2)}, {b(ROW_WEIGHT)}), {b(ROW_WEIGHT + 1)}) <> bit_count(id & {4 * SUPPORT + 3}) % 2"),
    ]),
)
def g12(spark, sf_dir):
    """Auxiliary variables have one value for each original assignment, and rewritten factors its value; two wrong rewrites are told apart."""
    all3, parity = xor(bit(0), bit(1), bit(2)), lambda m: (F.bit_count(F.col("id").bitwiseAND(F.lit(m).cast("long"))) % 2).cast("long")
    w, never = ROW_WEIGHT, F.lit(False)
    r = lambda n: spark.range(1 << n)
    out = [
        receipt(r(4), "terminal", 3, bit(3) == all3, never),
        receipt(r(5), "chain", 3, (bit(3) == xor(bit(0), bit(1))) & (bit(4) == xor(bit(3), bit(2))), bit(4) != all3),
        receipt(r(5), WRONG, 3, (bit(3) == xor(bit(0), bit(1))) & (bit(4) == bit(3)), bit(4) != all3),
        receipt(r(5), "a free auxiliary", 3, bit(4) == all3, never),
        receipt(r(w + 1), "increment", w, bit(w) == parity(SUPPORT), never),
        receipt(r(w + 2), "first detector", w + 1, bit(w + 1) == parity(SUPPORT), xor(bit(w + 1), bit(w)) != parity(2 * SUPPORT + 1)),
        receipt(r(w + 3), "later detector", w + 2, bit(w + 2) == parity(SUPPORT), xor(bit(w + 2), bit(w), bit(w + 1)) != parity(4 * SUPPORT + 3)),
    ]
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first


@query(
    "g12_selectors",
    " UNION ALL ".join(f"SELECT {j} AS selector, {m.bit_count()} AS weight, count(*) AS assignments, count(*) FILTER (bit_count(x) % 2 <> bit_count(xor(xor(x & {(1 << m.bit_count()) - 1}, (x >> {m.bit_count()}) & {(1 << m.bit_count()) - 1}), x >> {2 * m.bit_count()})) % 2) AS mismatches FROM range({1 << 3 * m.bit_count()}) t(x)" for j, m in enumerate(LOGICALS_18)),
)
def g12_selectors(spark, sf_dir):
    """The parity of three rounds on an operator's support is that of their sum: all assignments of each operator."""
    out = None
    for j, m in enumerate(LOGICALS_18):
        w = m.bit_count()
        part = lambda i, w=w: F.shiftright("id", i * w).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        differs = F.bit_count("id") % 2 != F.bit_count(xor(part(0), part(1), part(2))) % 2
        one = spark.range(1 << 3 * w).agg(F.lit(j).alias("selector"), F.lit(w).alias("weight"), F.count("*").alias("assignments"), F.count_if(differs).alias("mismatches"))
        out = one if out is None else out.unionByName(one)
    return out


SENSITIVITY = (1, 2, 4, 8)
STATUS_SQL = "CASE WHEN o_totalprice > 60000 * m OR o_totalprice * 0.75 > 40000 * m THEN 'definite fail' WHEN o_totalprice * 1.5 <= 40000 * m THEN 'certified pass' ELSE 'indeterminate' END"


def adjudicated(spark, sf_dir):
    """Each record at each multiplier of the caps (a closed list); a bound on the wrong side of its cap decides, else nothing does."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("exact"), (F.col("o_totalprice") * 0.75).alias("lower"), (F.col("o_totalprice") * 1.5).alias("upper"))
    o = o.withColumn("multiplier", F.explode(F.array(*map(F.lit, SENSITIVITY))))
    fails = (F.col("exact") > 60000 * F.col("multiplier")) | (F.col("lower") > 40000 * F.col("multiplier"))
    status = F.when(fails, "definite fail").when(F.col("upper") <= 40000 * F.col("multiplier"), "certified pass").otherwise("indeterminate")
    return o.select("o_orderkey", "multiplier", status.alias("status"), (~fails).alias("cleared"))


@query("g13_adjudication", f"SELECT o_orderkey, m::INTEGER AS multiplier, {STATUS_SQL} AS status FROM orders, (VALUES {', '.join(f'({m})' for m in SENSITIVITY)}) t(m)")
def g13_adjudication(spark, sf_dir):
    """Pass, definite fail or indeterminate, from exact values, lower and upper bounds."""
    return adjudicated(spark, sf_dir).select("o_orderkey", "multiplier", "status")


@query("w09_first_passing", f"SELECT o_orderkey, coalesce(min(m) FILTER ({STATUS_SQL} <> 'definite fail'), -1)::INTEGER AS multiplier FROM orders, (VALUES {', '.join(f'({m})' for m in SENSITIVITY)}) t(m) GROUP BY o_orderkey")
def w09(spark, sf_dir):
    """The first multiplier at which each record clears its caps, or -1."""
    return adjudicated(spark, sf_dir).groupBy("o_orderkey").agg(F.coalesce(F.min(F.when(F.col("cleared"), F.col("multiplier"))), F.lit(-1)).alias("multiplier"))


#: Local tables of the algebras, by the parity of a factor's variables (fixed values), and a hard constraint to compare with.
LOCAL = (("sum_product", 9.0, 1.0), ("soft_tropical", 2.0, 1.0), ("min_plus", 0.0, 1.0), ("hard_constraint", 1.0, 0.0))


@query(
    "g14_hard_factors",
    "WITH f AS (SELECT q, count(*)::INTEGER AS arity FROM (" + "SELECT * FROM (VALUES " + ", ".join(f"({q}, {v})" for q, s in enumerate(planned(LADDER[0])[0]) for v in s) + ") t(q, v)) GROUP BY q), l(algebra, zero, one) AS (VALUES " + ", ".join(f"('{a}', {z}::DOUBLE, {o}::DOUBLE)" for a, z, o in LOCAL) + "), e AS (SELECT algebra, q, CASE WHEN bit_count(x) % 2 = 0 THEN zero ELSE one END AS w FROM f, l, range(64) t(x) WHERE x < (1 << arity)), h AS (SELECT algebra, q, bool_and(algebra = 'min_plus' OR w > 0) AS soft FROM e GROUP BY algebra, q)"
    " SELECT algebra, count(*) AS factors, count(*) FILTER (NOT soft) AS hard, bool_and(soft) AS full_support FROM h GROUP BY algebra",
)
def g14(spark, sf_dir):
    """Whether any factor of the 72-bit code forbids an assignment: every entry of every factor's table, in each algebra.  Costs are finite, so none of theirs does."""
    f = spark.createDataFrame([(q, len(s)) for q, s in enumerate(planned(LADDER[0])[0])], "q int, arity int")
    entries = f.withColumn("x", F.explode(F.expr("sequence(0L, shiftleft(1L, arity) - 1)")))
    l = spark.createDataFrame(LOCAL, "algebra string, zero double, one double")
    e = entries.join(F.broadcast(l)).withColumn("w", F.when(F.bit_count("x") % 2 == 0, F.col("zero")).otherwise(F.col("one")))  # four algebras
    soft = F.bool_and((F.col("algebra") == "min_plus") | (F.col("w") > 0))
    each = e.groupBy("algebra", "q").agg(soft.alias("soft"))
    return each.groupBy("algebra").agg(F.count("*").alias("factors"), F.count_if(~F.col("soft")).alias("hard"), F.bool_and("soft").alias("full_support"))
