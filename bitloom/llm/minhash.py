"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard on full sets.

1. A document's set holds its distinct word shingles, as 64-bit hashes.  Equal
   sets are one node from here on, so a group of exact copies costs one row.  A
   node is named by a row of its own, and ids are looked up last: an id may hold
   several texts, and one row of it may be there many times.
2. Circulant MinHash: one permutation (sigma) breaks up the shingle hashes, one
   (pi), shifted circularly by k, gives coordinate k: pi(sigma(x) + k).  Both are
   bijections of 32-bit words, so no other permutations are drawn or stored.
3. ``bands`` of ``rows`` coordinates are bucket keys.  In a bucket, each node
   meets its smallest node and the one before it: linear in the bucket.
   Pairs whose sizes, or whose signatures (by five standard errors), rule the
   threshold out are dropped; the others join nodes to clusters.
4. A cluster's full sets go, once each, to one task, which finds the exact
   components by an index of shingles: a node is compared with those that no
   link has reached yet, so that a group of near copies costs little more than
   reading it, and no pair leaves the task.  Clusters above ``most_shingles`` are
   too large for that: their pairs are confirmed one by one in a join instead.
5. Buckets that hold nodes of several clusters are split by size: a class of
   sizes, and the next smaller one, hold all pairs whose sizes allow a link.
   Classes with several clusters are compared by signature, in tiles; what could
   be linked is confirmed on full sets.  So no colliding pair that could join two
   components goes unseen.

A pair at Jaccard J shares no bucket with probability (1 - J**rows)**bands:
1.5e-5 at 0.8 with the defaults, and falling fast above it.  Step 3 loses a pair
that shares one with probability 3e-7 at the threshold (five standard errors of
the signature's agreement), and less above it.

Edge cases: null text or text without words has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of the whole sequence;
rows without an id take the component of their set, if others have it, and
aren't kept then; repeated rows are one node and each returned; an id with several
texts is a row for each, each in its own text's component; a text of any length is
read whole (its set, 8 bytes a word, must fit a task's memory); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, Workspace, groups, mix64, read, small, text_bytes
from .graph import components

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a sequence of word hashes."""
    if not len(hashes):
        return np.empty(0, U64)
    width = min(n, len(hashes))
    out = np.full(len(hashes) - width + 1, U64(width))
    for i in range(width):
        out = mix64(out) + hashes[i : len(hashes) - width + 1 + i] * U64(0x9E3779B97F4A7C15)
    return np.unique(mix64(out))


class Circulant:
    """Signatures of ``size`` coordinates from two permutations of 32-bit words."""

    BLOCK = 2048

    def __init__(self, size: int):
        self.size = size
        self.shift = np.arange(size, dtype=np.uint32)[None, :]
        self.a, self.b = (np.empty((self.BLOCK, size), np.uint32) for _ in range(2))

    @staticmethod
    def sigma(x: np.ndarray) -> np.ndarray:
        y = (x >> U64(32)).astype(np.uint32)
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        return y ^ (y >> np.uint32(16))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        y = self.sigma(values)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(y), self.BLOCK):
            part = y[i : i + self.BLOCK, None]
            a, b = self.a[: len(part)], self.b[: len(part)]
            np.add(part, self.shift, out=a)  # wraps: the circular shift
            for right, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(a, np.uint32(right), out=b)
                np.bitwise_xor(a, b, out=a)
                np.multiply(a, np.uint32(times), out=a)
            np.right_shift(a, np.uint32(16), out=b)
            np.bitwise_xor(a, b, out=a)
            np.minimum(out, a.min(axis=0), out=out)
        return out


def signature_rows(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (the set's name), keys (one for each band), sketch (low bytes of the signature), th (hash of the text)."""

    def run(batches):
        words, circulant = WordHashes(), Circulant(bands * rows)
        salt = mix64(np.arange(1, bands + 1, dtype=U64))
        for b in small(batches, 1):
            out: dict[str, list] = {"n": [], "s1": [], "s2": [], "keys": [], "sketch": []}
            seen: dict = {}
            for text in text_bytes(b.column(1)):
                s = shingles(words.of(text.translate(TO_LOWER).split()), n)
                if not len(s):
                    row = (0, None, None, None, None)
                else:
                    name = tuple(int(x) for x in np.array([np.add.reduce(s), np.add.reduce(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)))], U64).view(np.int64))
                    if name not in seen:
                        sig = circulant(s)
                        key = salt.copy()
                        for column in sig.reshape(bands, rows).T:
                            key = mix64(key ^ column.astype(U64)) + U64(1)
                        seen[name] = key.view(np.int64), (sig & np.uint32(255)).astype(np.uint8).tobytes()
                    row = (len(s), *name, *seen[name])
                for column, value in zip(out.values(), row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out.values(), kinds)), b.column(2)], ["doc_id", *out, "th"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return texts.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary, th long")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, near: int = 1_000_000) -> DataFrame:
    """wanted (node, id, th, repeated) -> (node, set): sorted 64-bit hashes of all shingles.

    A node whose row is there several times comes once from each task at most.
    """

    def run(batches):
        words, seen = WordHashes(), set()
        for b in small(batches, 2):
            kept, sets = [], []
            for i, (node, repeated, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)))):
                if repeated:
                    if node in seen:
                        continue
                    seen.add(node)
                kept.append(node)
                sets.append(shingles(words.of(text.translate(TO_LOWER).split()), n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    # few nodes go to where the texts are; many meet them by a shuffle
    wanted = F.broadcast(wanted) if wanted.count() <= near else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    return texts.join(wanted, ["id", "th"]).select("node", "repeated", "text").mapInArrow(run, "node long, set binary")


def once(batches, node: int):
    """Batches without rows whose node is that of the row before."""
    last = None
    for b in batches:
        if b.num_rows:
            x = b.column(node).to_numpy(zero_copy_only=False)
            fresh = np.append(x[0] != last, x[1:] != x[:-1])
            last = x[-1]
            yield b if fresh.all() else b.filter(pa.array(fresh))


def is_link(na, nb, common, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * common >= percent * (na + nb - common)


def exact_components(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest node of each one's component, by full sets."""
    size = np.array([len(s) for s in sets])
    out, left = np.full(len(nodes), -1), np.arange(len(nodes))
    flat = owner = np.empty(0, np.int64)
    stale = True
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            start = int(left[0])
            out[start] = start
            queue, left = [start], left[1:]
        i = queue.pop()
        if not len(left):
            out[queue] = out[i]
            break
        if stale:  # an index of what no link has reached yet
            flat = np.concatenate([sets[j] for j in left])
            owner = np.repeat(left, size[left])
            order = np.argsort(flat, kind="stable")
            flat, owner, indexed, stale = flat[order], owner[order], len(left), False
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(nodes))[left]
        hit = is_link(size[i], size[left], common, percent) & (common > 0)
        if hit.any():
            new = left[hit]
            out[new] = out[i]
            queue += new.tolist()
            left = left[~hit]
            stale = len(left) * 2 < indexed
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, out, nodes)
    return low[out]


def likely(size: int, percent: int) -> float:
    """Agreeing low bytes of two signatures below which a link is ruled out: a coordinate agrees with probability j at least."""
    j = percent / 100
    return size * (j - 5 * (j * (1 - j) / size) ** 0.5)


def likely_pairs(nodes: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    info = nodes.select("node", "n", "sketch")
    p = pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
    p = p.join(info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b").where(fits)
    least = likely(size, percent)

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, size) for i in (2, 3))
            m = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(m) for i in (0, 1)], ["a", "b"])

    return p.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def confirm(ws: Workspace, docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table that are links, each by a join with both full sets."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ws.table(used.join(nodes.select("node", "id", "th", "repeated"), "node"), "used")
    single = sets_of(docs, wanted, n).repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: once(batches, 0), "node long, set binary")
    sets = ws.table(single, "sets")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges two sorted runs
                ok.append(is_link(len(x), len(y), int((both[1:] == both[:-1]).sum()), percent))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(m) for i in (0, 1)], ["a", "b"])

    q = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    links = ws.table(q.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    ws.drop(sets)
    return links


def within_clusters(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """clusters (node, cluster) -> edges (a, b) that join each exact component to its smallest node."""
    sets = sets_of(docs, clusters.select("node").join(nodes.select("node", "id", "th", "repeated"), "node"), n)

    def run(batches):
        for t in groups(once(batches, 1), 0):
            order = np.argsort(t["node"].to_numpy())
            nodes, raw = t["node"].to_numpy()[order], t["set"].take(pa.array(order)).to_pylist()
            low = exact_components(nodes, [np.frombuffer(x, U64) for x in raw], percent)
            m = low != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[m]), pa.array(low[m])], ["a", "b"])

    sent = sets.join(clusters, "node").select("cluster", "node", "set")
    return sent.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(run, "a long, b long")


def across_clusters(members: DataFrame, percent: int, size: int, tile: int) -> DataFrame:
    """members (key, node, cluster, n, sketch, own, tiles) -> pairs (a, b) of one key but two clusters, one of them its own, that could be links."""
    least = likely(size, percent)
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    one = members.select("*", mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    one = one.withColumn("place", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))

    def run(batches):
        for t in groups(batches, 0):
            if t.num_rows < 2:
                continue
            node, cluster, n, own = (t[c].to_numpy() for c in ("node", "cluster", "n", "own"))
            x = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, size)
            a, b = [], []
            for i in range(len(node)):
                fits = np.flatnonzero((cluster[i + 1 :] != cluster[i]) & (own[i + 1 :] | own[i]) & (np.minimum(n[i], n[i + 1 :]) * 100 >= np.maximum(n[i], n[i + 1 :]) * percent)) + i + 1
                fits = fits[(x[fits] == x[i]).sum(axis=1) >= least] if len(fits) else fits
                a += [int(node[i])] * len(fits)
                b += node[fits].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    one = one.select("place", "node", "cluster", "n", "sketch", "own").repartition("place").sortWithinPartitions("place")
    return one.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept; options as of ``labelled``."""
    return labelled(docs, **options).select("doc_id", "n_shingles", "component_id", "kept")


def labelled(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 28, rows: int = 5, chain: int = 4096, tile: int = 2048, most_shingles: int = 4_000_000) -> DataFrame:
    """documents -> doc_id, th, s1, s2, n_shingles, component, component_id, kept; n-word shingles, similarity of at least ``percent`` hundredths."""
    ws, size = Workspace(docs.sparkSession, "minhash"), bands * rows
    all_ = ws.table(signature_rows(docs, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    named = all_.where("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("first"), (F.count("*") > 1).alias("repeated"))
    names = ws.table(named.select("s1", "s2", F.col("first.row").alias("node"), F.col("first.doc_id").alias("id"), "repeated"), "names")
    nodes = ws.table(names.drop("s1", "s2").join(all_.select(F.col("row").alias("node"), "n", "keys", "sketch", "th"), "node"), "nodes")
    member = nodes.select("node", F.explode("keys").alias("key"))
    crowd = ws.table(member.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("rep")).where("members > 1"), "crowd")
    member = ws.table(member.join(crowd, "key"), "members")
    ws.drop(crowd)
    # small buckets in order of ids, so that a group's buckets give the same pairs; large ones in an order of their own, for other partners
    place = F.when(F.col("members") > 8, F.xxhash64("node", "key")).otherwise(F.col("node"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / chain).cast("int"))
    before = F.lag("node").over(Window.partitionBy("key", "part").orderBy("place", "node"))
    star = member.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    path = member.withColumn("part", part).withColumn("place", place).select(before.alias("a"), F.col("node").alias("b")).where("a is not null and a <> b")
    pairs = star.unionByName(path).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = ws.table(likely_pairs(nodes, pairs, percent, size), "pairs")
    clusters = components(ws, pairs).withColumnRenamed("component", "cluster")
    weight = clusters.join(nodes.select("node", "n"), "node").groupBy("cluster").agg(F.sum("n").alias("shingles"))
    clusters = ws.table(clusters.join(ws.table(weight, "weights"), "cluster"), "clusters")
    small = clusters.where(F.col("shingles") <= most_shingles).select("node", "cluster")
    links = ws.table(within_clusters(docs, ws.table(small, "small"), nodes, n, percent), "links")
    large = clusters.where(F.col("shingles") > most_shingles).select("node")
    big = not large.isEmpty()
    if big:
        mine = ws.table(pairs.join(large, pairs.a == large.node, "left_semi"), "large")
        links = links.unionByName(confirm(ws, docs, mine, nodes, n, percent))
        done = ws.table(components(ws, links), "done")
        # in a large cluster, components stand for clusters from here on
        again = large.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
        clusters = ws.table(small.unionByName(again), "reclustered")
    placed = member.select("key", "node").join(clusters.select("node", "cluster"), "node", "left")
    placed = placed.select("key", "node", F.coalesce("cluster", "node").alias("cluster"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("key")
    placed = placed.join(ws.table(mixed, "mixed"), "key", "left_semi").join(nodes.select("node", "n", "sketch"), "node")
    # sizes of a possible link are less than one class apart
    of = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).cast("long")
    own = placed.select(F.xxhash64("key", of).alias("key"), "node", "cluster", "n", "sketch", F.lit(True).alias("own"))
    guest = placed.select(F.xxhash64("key", of + 1).alias("key"), "node", "cluster", "n", "sketch", F.lit(False).alias("own"))
    classed = ws.table(own.unionByName(guest), "classed")
    sizes = classed.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("own").alias("owned"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    sizes = ws.table(sizes.where("owned and low <> high").select("key", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "classes")
    late = ws.table(across_clusters(classed.join(sizes, "key"), percent, size, tile), "late")
    if not late.isEmpty():
        links = links.unionByName(confirm(ws, docs, late, nodes, n, percent))
    comps = components(ws, links)
    low = comps.join(names.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("low"))
    low = ws.table(comps.join(low, "component"), "lowest")
    label = names.join(low, "node", "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("component", "node").alias("component"), F.coalesce("low", "id").alias("low"))
    label = ws.table(label, "labels")
    out = all_.select("doc_id", "th", "n", "s1", "s2").join(label, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), "left")
    of = F.coalesce("low", "doc_id")
    return out.select("doc_id", "th", "s1", "s2", F.col("n").alias("n_shingles"), "component", of.alias("component_id"), F.coalesce(F.col("doc_id") == of, of.isNull()).alias("kept"))


def keep_one(docs: DataFrame, near: int = 2_000_000, **options) -> DataFrame:
    """The documents with one of each group of near duplicates left: its smallest id, one row of it.

    Rows that share that id but hold unlinked texts all stay, each in its own group; of its linked texts one stays.  Documents
    without an id stay, as no id stands for them.
    """
    ws = Workspace(docs.sparkSession, "keep")
    kept = labelled(docs, **options).where("kept and doc_id is not null")
    texts = kept.groupBy("doc_id", F.coalesce("component", "th").alias("of"), F.col("component").isNull().alias("empty"), "th").agg(F.count("*").alias("rows"))
    first = texts.groupBy("doc_id", "of", "empty").agg(F.min_by(F.struct("th", "rows"), "th").alias("x"))
    first = ws.table(first.select(F.col("doc_id").alias("__kept"), F.col("x.th").alias("__th"), F.col("x.rows").alias("__rows")), "kept")
    first = F.broadcast(first) if first.count() <= near else first
    found = docs.join(first, (docs.doc_id == F.col("__kept")) & (F.xxhash64(docs.text) == F.col("__th")))
    mine = [docs[f"`{c}`"] for c in docs.columns]
    once = found.where(F.col("__rows") == 1).select(*mine)
    again = found.where(F.col("__rows") > 1).dropDuplicates(["__kept", "__th"]).select(*mine)
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=2, percent=80)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM w
), g AS (
  SELECT min(doc_id) AS node, any_value(n) AS n, k FROM (SELECT doc_id, len(s) AS n, list_sort(s)::VARCHAR AS k FROM s WHERE len(s) > 0) GROUP BY k
), x AS (
  SELECT g.node, g.n, unnest(s.s) AS t FROM g JOIN s ON s.doc_id = g.node
), p AS (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.node < b.node GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (
  SELECT node, node FROM g UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS node, min(b) AS component FROM reach GROUP BY a
), m AS (
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component END AS component_id
  FROM s LEFT JOIN g ON g.k = list_sort(s.s)::VARCHAR LEFT JOIN c ON c.node = g.node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM m
"""
