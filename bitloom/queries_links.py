"""Queries over the given tables that need rounds or ranges: chains, closures, containment, bases, running values, samples, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import own_folder
from .operators import links, ranges, score, sets
from .queries import SQL, query, table
from .streaming import ordered

# Chains by digest

TURNS_SQL = """t AS (SELECT conv_id, turn, sha256(concat_ws('|', conv_id, turn, role, text)) AS own FROM conversations),
f AS (SELECT conv_id, arg_min(own, turn) AS first, arg_max(own, turn) AS last FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, t.turn, t.own, CASE WHEN t.conv_id % 13 = 5 AND t.turn = 0 THEN last WHEN t.conv_id % 11 = 3 AND t.turn = 2 THEN first WHEN t.conv_id % 7 = 2 AND t.turn = 1 THEN sha256('lost') ELSE p.own END AS before
  FROM t JOIN f USING (conv_id) LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1)"""


@query(
    "v02_turn_chains",
    f"""WITH RECURSIVE {TURNS_SQL},
w(own, chain, rank, status) AS (SELECT own, own, 1::BIGINT, CASE WHEN before IS NULL THEN 'chained' ELSE 'broken' END FROM r WHERE before IS NULL OR before NOT IN (SELECT own FROM r)
  UNION ALL SELECT r.own, w.chain, w.rank + 1, w.status FROM w JOIN r ON r.before = w.own),
x AS (SELECT own, before FROM r WHERE own NOT IN (SELECT own FROM w)),
c(a, b) AS (SELECT own, before FROM x UNION SELECT c.a, x.before FROM c JOIN x ON x.own = c.b),
n AS (SELECT before AS own, count(*) AS successors FROM r WHERE before IS NOT NULL GROUP BY before)
SELECT conv_id, turn, chain, rank, coalesce(status, CASE WHEN own IN (SELECT a FROM c WHERE a = b) THEN 'cycle' ELSE 'after cycle' END) AS status, coalesce(successors, 0) AS successors
FROM r LEFT JOIN w USING (own) LEFT JOIN n USING (own)""",
)
def v02_turns(spark, sf_dir):
    """Turns of conversations that name the digest of the turn before: in some conversations one names a lost digest, one is named twice, or the first names the last."""
    k = F.col("conv_id")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256).alias("own"))
    ends = t.groupBy("conv_id").agg(F.min_by("own", "turn").alias("first"), F.max_by("own", "turn").alias("last"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("told"))
    r = t.join(before, ["conv_id", "turn"], "left").join(ends, "conv_id")
    told = F.when((k % 13 == 5) & (F.col("turn") == 0), F.col("last")).when((k % 11 == 3) & (F.col("turn") == 2), F.col("first")).when((k % 7 == 2) & (F.col("turn") == 1), F.sha2(F.lit("lost"), 256))
    r = r.select("conv_id", "turn", "own", told.otherwise(F.col("told")).alias("before"))
    found = links.chains(r, "own", "before").drop("copies")
    return r.select("conv_id", "turn", "own").join(found, "own").drop("own")


@query(
    "v02_document_history",
    """WITH d AS (SELECT doc_id, sha256(concat_ws('|', doc_id, text)) AS own, row_number() OVER (ORDER BY doc_id) AS i FROM documents), h AS (SELECT *, max(CASE WHEN i = 1 OR i % 397 = 5 THEN i END) OVER (ORDER BY i) AS start FROM d)
SELECT h.doc_id, s.doc_id AS chain, h.i - h.start + 1 AS rank, CASE WHEN h.start = 1 THEN 'chained' ELSE 'broken' END AS status FROM h JOIN d s ON s.i = h.start""",
)
def v02_documents(spark, sf_dir):
    """All documents as one history, each naming the digest of the one before, with a lost predecessor after every 397."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("own"))
    d = ranges.running(d, ["doc_id"]).withColumnRenamed("running", "i")
    before = d.select((F.col("i") + 1).alias("i"), F.col("own").alias("told"))
    r = d.join(before, "i", "left").select("doc_id", "own", F.when(F.col("i") % 397 == 5, F.sha2(F.lit("lost"), 256)).otherwise(F.col("told")).alias("before"))
    found = links.chains(r, "own", "before").select("own", "chain", "rank", "status")
    named = d.select(F.col("own").alias("chain"), F.col("doc_id").alias("name"))
    return d.select("doc_id", "own").join(found, "own").join(named, "chain").select("doc_id", F.col("name").alias("chain"), "rank", "status")


# What a change reaches, and cycles

PARTS_SQL = "e AS (SELECT DISTINCT a.l_partkey AS child, b.l_partkey AS parent FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber % 7 + 1 WHERE a.l_quantity >= 49)"


def needs(spark, sf_dir, item: str):
    """(child, parent): what a line of 49 or more calls for is on the next line of its order."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = l.where("l_quantity >= 49").select("l_orderkey", (F.col("l_linenumber") % 7 + 1).alias("next"), F.col(item).alias("child"))
    b = l.select("l_orderkey", F.col("l_linenumber").alias("next"), F.col(item).alias("parent"))
    return a.join(b, ["l_orderkey", "next"]).select("child", "parent").distinct()


def components_sql(edges: str) -> str:
    return f"""WITH RECURSIVE {edges}, r(a, b) AS (SELECT parent, child FROM e UNION SELECT r.a, e.child FROM r JOIN e ON e.parent = r.b), v AS (SELECT child AS v FROM e UNION SELECT parent FROM e),
m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a UNION SELECT v, v FROM v), c AS (SELECT a AS vertex, min(b) AS component, count(*) AS size FROM m GROUP BY a)
SELECT vertex, component, size, vertex IN (SELECT a FROM r WHERE a = b) AS cyclic FROM c"""


@query("v04_part_closure", f"WITH RECURSIVE {PARTS_SQL}, r(changed, affected) AS (SELECT parent, child FROM e UNION SELECT r.changed, e.child FROM r JOIN e ON e.parent = r.affected) SELECT changed, affected FROM r")
def v04_closure(spark, sf_dir):
    """Every part that a change of a part reaches."""
    return links.closure(needs(spark, sf_dir, "l_partkey"))


@query("v04_part_cycles", components_sql(PARTS_SQL))
def v04_cycles(spark, sf_dir):
    """Parts that call for each other, round about: components of the graph, most of them of one part."""
    return links.components(needs(spark, sf_dir, "l_partkey"))


@query("v04_supplier_cycles", components_sql(PARTS_SQL.replace("l_partkey", "l_suppkey")))
def v04_suppliers(spark, sf_dir):
    """The same for suppliers, where nearly all are one component."""
    return links.components(needs(spark, sf_dir, "l_suppkey"))


# Rules from a table

HOST, SECTION = "^[a-z]+://[^/]+/", "^[a-z]+://[^/]+/[^/]+/"


@query(
    "j13_page_sections",
    f"""WITH r AS (SELECT regexp_extract(url, '{HOST}') AS prefix, 'host ' || page_id % 5 AS owner FROM pages WHERE page_id % 2 = 0 UNION SELECT regexp_extract(url, '{SECTION}'), 'section ' || page_id % 3 FROM pages WHERE page_id % 3 = 0),
h AS (SELECT DISTINCT url, prefix, owner FROM pages JOIN (SELECT * FROM r WHERE prefix <> '') r ON starts_with(url, prefix))
SELECT p.url AS path, arg_max(owner, (length(prefix), owner)) AS owner, count(DISTINCT owner) AS owners FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN h ON p.url = h.url GROUP BY p.url""",
)
def j13_sections(spark, sf_dir):
    """Owners of pages by rules for hosts and sections that come from the pages themselves, as many as there are."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    hosts = p.where(k % 2 == 0).select(F.regexp_extract("url", HOST, 0).alias("prefix"), F.concat(F.lit("host "), (k % 5).cast("string")).alias("owner"))
    parts = p.where(k % 3 == 0).select(F.regexp_extract("url", SECTION, 0).alias("prefix"), F.concat(F.lit("section "), (k % 3).cast("string")).alias("owner"))
    return score.owners(p.select(F.col("url").alias("path")), hosts.union(parts).where("prefix <> ''"))


# containment


@query(
    "x05_maximal_baskets",
    """WITH b AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS items FROM lineitem GROUP BY l_orderkey), d AS (SELECT items, min(l_orderkey) AS name, len(items) AS size FROM b GROUP BY items), i AS (SELECT name, size, unnest(items) AS item FROM d),
c AS (SELECT a.name, o.name AS super, o.size AS super_size FROM i a JOIN i o ON a.item = o.item AND o.size > a.size GROUP BY a.name, a.size, o.name, o.size HAVING count(*) = a.size),
s AS (SELECT name, arg_min(super, (super_size, super)) AS smallest FROM c GROUP BY name)
SELECT l_orderkey, smallest IS NULL AS maximal, smallest FROM b JOIN d ON b.items = d.items LEFT JOIN s ON s.name = d.name""",
)
def x05_baskets(spark, sf_dir):
    """Orders as sets of parts: which lie within another's, and the smallest that holds each."""
    return sets.containing(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("items")), "l_orderkey", "items")


# masks

MASKS_SQL = "m AS (SELECT l_orderkey, bit_xor(1::BIGINT << (l_partkey % 60)::INTEGER) AS mask FROM lineitem GROUP BY l_orderkey)"


def order_masks(spark, sf_dir):
    """An order's parts, folded to 60 bits."""
    one = F.expr("shiftleft(1L, cast(l_partkey % 60 AS int))")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_xor(one).alias("mask"))


@query(
    "o02_independent_orders",
    f"""WITH RECURSIVE {MASKS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, mask) AS i FROM m),
s(i, basis, l_orderkey, mask, kept) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, false UNION ALL
  SELECT i, CASE WHEN x <> 0 THEN list_reverse_sort(list_append(basis, x)) ELSE basis END, l_orderkey, mask, x <> 0
  FROM (SELECT o.*, s.basis, list_reduce(list_prepend(o.mask, s.basis), lambda m, b: least(m, xor(m, b))) AS x FROM s JOIN o ON o.i = s.i + 1 WHERE len(s.basis) < 60))
SELECT l_orderkey, mask FROM s WHERE kept""",
)
def o02_orders(spark, sf_dir):
    """The first orders whose masks are independent; their number is the rank of all."""
    return sets.independent_rows(order_masks(spark, sf_dir), ["l_orderkey"], "mask")


@query("j03_orders_in_span", f"WITH {MASKS_SQL} SELECT l_orderkey, bit_count(mask) % 2 = 0 AS spanned FROM m")
def j03_span(spark, sf_dir):
    """Orders that are sums of orders with an even number of bits; these span all masks of even weight (which the SQL presumes)."""
    m = order_masks(spark, sf_dir)
    basis = sets.independent_rows(m.where("bit_count(mask) % 2 = 0"), ["l_orderkey"], "mask")
    return m.select("l_orderkey", sets.in_span(F.col("mask"), sets.echelon([r["mask"] for r in basis.select("mask").collect()])).alias("spanned"))  # 64 rows at most


# Orders over a whole table

CAPS = (10**8, 10**9, 10**10, 10**11)
LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]


@query(
    "w07_price_crossing",
    f"""WITH l AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem), s AS (SELECT *, (sum(cents) OVER (ORDER BY {', '.join(LINE)} ROWS UNBOUNDED PRECEDING))::BIGINT AS running, row_number() OVER (ORDER BY {', '.join(LINE)}) AS i FROM l),
c(cap) AS (VALUES {', '.join(f'({c}::BIGINT)' for c in CAPS)}), f AS (SELECT cap, min(i) AS i FROM c JOIN s ON running > cap GROUP BY cap) SELECT cap, l_orderkey, l_linenumber, l_partkey, running FROM f JOIN s USING (i)""",
)
def w07_prices(spark, sf_dir):
    """In order of ship dates, the line at which the running price passes each cap."""
    l = table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))  # noqa: E741
    return ranges.first_crossings(l.select(*LINE), LINE, F.col("cents"), list(CAPS)).select("cap", "l_orderkey", "l_linenumber", "l_partkey", "running")


@query("o01_order_ranks", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def o01_ranks(spark, sf_dir):
    """The place of every order by date."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ranges.running(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("running").alias("place"))


for _name, _table, _key in (("s06_orders_sample", "orders", "o_orderkey"), ("s06_lines_sample", "lineitem", "l_orderkey")):

    @query(_name, f"SELECT key, draw FROM (SELECT DISTINCT {_key} AS key, sha256('sample:' || {_key}) AS draw FROM {_table}) ORDER BY draw, key LIMIT 256")
    def s06_sample(spark, sf_dir, name=_table, key=_key):
        """256 orders by digest; of those that have lines, both tables draw the same."""
        return ranges.digest_sample(table(spark, sf_dir, name).select(F.col(key).alias("key")), "key", "sample", 256)


# trees

FAN = 16


def tree_sql(sha: str, fan: int = FAN) -> str:
    """CTEs l0 .. l5 and nodes with the levels of a tree over documents, none above the root; six levels hold fan**6 documents."""
    out = [f"f0 AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, {sha} AS sha FROM documents)", f"l0 AS (SELECT 0 AS level, pos // {fan} AS node, count(*) AS n, sha256(string_agg(sha, ',' ORDER BY pos)) AS sha FROM f0 GROUP BY 2)"]
    for i in range(1, 6):
        out.append(f"l{i} AS (SELECT {i} AS level, node // {fan} AS node, sum(n)::BIGINT AS n, sha256(string_agg(sha, ',' ORDER BY l{i - 1}.node)) AS sha FROM l{i - 1} WHERE (SELECT count(*) FROM l{i - 1}) > 1 GROUP BY l{i - 1}.node // {fan})")
    return ", ".join([*out, "nodes AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(6)) + ")"])


def digests(spark, sf_dir, change: bool = False):
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") == 7, F.concat(text, F.lit("x"))).otherwise(text) if change else text
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"))


SHA = "sha256(coalesce(text, ''))"


@query("v03_tree", f"WITH {tree_sql(SHA)} SELECT * FROM nodes")
def v03_tree(spark, sf_dir):
    """The ordered identity of a history, with all nodes that lead to it."""
    return ranges.tree(digests(spark, sf_dir), "doc_id", "sha256", FAN)


@query(
    "v03_changed_nodes",
    f"WITH a AS (WITH {tree_sql(SHA)} SELECT * FROM nodes), b AS (WITH {tree_sql(SHA.replace('text, ' + repr(''), 'CASE WHEN doc_id = 7 THEN text || chr(120) ELSE text END, ' + repr('')))} SELECT * FROM nodes) SELECT a.level, a.node FROM a JOIN b USING (level, node) WHERE a.sha <> b.sha",
)
def v03_changed(spark, sf_dir):
    """Where a history with a single character more differs: one node a level."""
    return ranges.changed_nodes(ranges.tree(digests(spark, sf_dir), "doc_id", "sha256", FAN), ranges.tree(digests(spark, sf_dir, True), "doc_id", "sha256", FAN))


@query(
    "v03_inclusion",
    f"WITH {tree_sql(SHA)}, w AS (SELECT doc_id, pos FROM f0 WHERE doc_id % 50 = 3) SELECT doc_id, level, (pos // pow({FAN}, level)::BIGINT % {FAN})::INTEGER AS place, sha AS proves FROM w JOIN nodes ON node = pos // pow({FAN}, level + 1)::BIGINT",
)
def v03_inclusion(spark, sf_dir):
    """Proofs that some documents are part of the history, each step hashed: the last gives the root's digest."""
    d = digests(spark, sf_dir)
    proofs = ranges.inclusion(ranges.tree(d, "doc_id", "sha256", FAN), d, "doc_id", "sha256", d.where("doc_id % 50 = 3"), FAN)
    return proofs.select("doc_id", "level", "place", F.sha2(F.concat_ws(",", "siblings"), 256).alias("proves"))


# 2.11: histories on a stream


@query("w06_stream", SQL["w06_running_xor"])
def w06_stream(spark, sf_dir):
    """The running XOR of conversations that come as a stream, their turns dealt to files out of order and read one file a batch."""
    folder = own_folder(spark, "stream")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("history"), F.col("turn").alias("t"), F.length("text").cast("long").alias("f"))
    c.repartition(4, F.xxhash64("t", "history")).write.parquet(f"{folder}/in")
    with ordered.state_store(spark):
        s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = ordered.running_xor(s).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("history").alias("conv_id"), F.col("t").alias("turn"), "total", "change")
