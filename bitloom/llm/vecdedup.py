"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors are one (grouped before anything else, with their number).
2. Each pass gives a vector 64 sign bits of random projections, joined to one
   key.  All passes are one table, range-partitioned and sorted by (pass, key):
   similar vectors share long prefixes, so they meet in the order.  What is
   sorted is a vector's int8 form with the length of what rounding left.  A task
   compares each row with the ``window`` rows after it: bounds of the cosine tell
   which pairs are certainly linked, of which a forest is sent on, not the pairs;
   pairs that the bounds leave open and the forest doesn't join are decided by
   the original vectors, in double precision, after all passes.  The first and
   last ``window`` rows of all tasks are compared once more, in order, so that
   pairs across the edges of tasks count too: in tasks of about ``edge_rows``
   rows, whose own first and last rows go on to a next level, until one task
   holds them all.  As ranges may end anywhere, a key that a third of all rows
   share is many tasks.
3. The forests of all passes unite to components.
4. Links are then counted exactly within each component, found by a window or
   not.  With angles measured from the component's centre, two vectors are
   certainly linked if their angles add up to no more than the threshold's
   angle, so in a tight component the count is its size.  Only vectors too far
   out for that are compared, in tiles of about ``tile`` by ``tile`` rows that
   send on counts.  A group with a third of all rows is many tiles.

A pair is missed only where no chain of found links joins it: for two vectors
at angle t among n others, about (1 - (1 - t/pi)^log2(n/window))^passes.  The
number of passes is the least, and at least 24, that keeps this below ``miss``
at the threshold's angle for the n distinct vectors there are.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing and stand for themselves;
widths never mix; repeated rows are equal vectors; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read
from .graph import components
from .vectors import by_width, scaled, usable


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def keys(x: np.ndarray, passes: int, seed: int, bits: int = 64) -> np.ndarray:
    """(rows, passes) keys of concatenated signs."""
    out = np.empty((len(x), passes), dtype=np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], bits))
        out[:, p] = np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def passes_for(n: int, window: int, threshold: float, miss: float, least: int = 24) -> int:
    """Passes after which an isolated pair at the threshold among ``n`` vectors is missed with probability ``miss`` at most."""
    met = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return max(least, math.ceil(math.log(miss) / math.log1p(-met))) if met < 1 else least


def rounded(x: np.ndarray) -> list[bytes]:
    """Unit vectors as int8 components, their scale, and the length of what rounding left (float32, rounded up)."""
    u = unit(x)
    scale = (np.abs(u).max(axis=1) / 127).astype(np.float32)
    q = np.clip(np.rint(u / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    left = np.sqrt(((u - q * scale[:, None].astype(np.float64)) ** 2).sum(axis=1))
    numbers = np.column_stack([scale, left * (1 + 1e-6) + 1e-7]).astype("<f4")
    return [a.tobytes() + b.tobytes() for a, b in zip(q, numbers)]


def restored(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rounded vectors of one width, and what rounding left of each."""
    x = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    numbers = np.ascontiguousarray(x[:, -8:]).view("<f4")
    return x[:, :-8].view(np.int8).astype(np.float32) * numbers[:, :1], numbers[:, 1]


def forest(ids: np.ndarray, y: np.ndarray, left: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at most ``window`` rows apart: edges of a spanning forest of those certainly linked, and open pairs that it doesn't join."""
    root = np.arange(len(ids))
    open_a, open_b = [], []

    def settle() -> None:
        while not np.array_equal(root, root[root]):
            root[:] = root[root]

    for s in range(1, min(window, len(ids) - 1) + 1):
        i = np.flatnonzero((root[:-s] != root[s:]) & (ids[:-s] != ids[s:]))
        if not len(i):
            continue
        cosine = np.einsum("ij,ij->i", y[i], y[i + s])
        slack = left[i] * (1 + left[i + s]) + left[i + s] + 1e-4  # and float32 sums
        may = cosine + slack >= threshold
        sure = cosine - slack >= threshold
        open_a.append(i[may & ~sure])
        open_b.append(i[may & ~sure] + s)
        i = i[sure]
        for a, b in zip(i.tolist(), (i + s).tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        settle()
    linked = np.flatnonzero(root != np.arange(len(ids)))
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (open_a, open_b))
    apart = root[a] != root[b]
    return ids[linked], ids[root[linked]], ids[a[apart]], ids[b[apart]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 32, tile: int = 4096, seed: int = 11, miss: float = 0.001, edge_rows: int = 250_000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of the input: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "vecdedup")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    ok = usable(F.col("v")) & F.col("vec_id").isNotNull()
    distinct = rows.where(ok).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # two rows with one id but different vectors share the representative's name; ids are taken as given
    distinct = ws.table(distinct, "distinct")
    if passes is None:
        passes = passes_for(distinct.count(), window, threshold, miss)

    def project(batches):
        for b in batches:
            for r, x in by_width(b.column(1)):
                k = keys(x, passes, seed)
                rep = np.repeat(b.column(0).to_numpy(zero_copy_only=False)[r], passes)
                blobs = rounded(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(passes, dtype=np.int32), len(x))), pa.array(k.ravel()), pa.array(rep), pa.array([y for y in blobs for _ in range(passes)], pa.binary())], ["pass", "key", "rep", "x"])

    names = ["a", "b", "sure", "pass", "key", "rep", "x"]

    def links(ids, blobs):
        width = np.array([len(y) for y in blobs])
        for w in np.unique(width):
            r = np.flatnonzero(width == w)
            a, b, c, d = forest(ids[r], *restored([blobs[i] for i in r]), window, threshold)
            if len(a) + len(c):
                sure = np.arange(len(a) + len(c)) < len(a)
                pairs = [pa.array(np.concatenate(x)) for x in ((a, c), (b, d))]
                yield pa.RecordBatch.from_arrays([*pairs, pa.array(sure), *(pa.nulls(len(sure), k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

    def edge(b):
        return pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, pa.int64())] * 2, pa.nulls(b.num_rows, pa.bool_()), *b.columns], names)

    def link(batches):
        """Links, then the first and last rows."""
        tail_ids, tail, seen, last = np.empty(0, np.int64), [], 0, []
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.concatenate([tail_ids, b.column(2).to_numpy(zero_copy_only=False)])
            blobs = tail + b.column(3).to_pylist()
            yield from links(ids, blobs)
            tail_ids, tail = ids[-window:], blobs[-window:]
            head = min(b.num_rows, max(0, window - seen))
            if head:
                yield edge(b.slice(0, head))
            seen += b.num_rows
            if head < b.num_rows:  # rows sent as first ones aren't sent again
                last.append(b.slice(head))
                while len(last) > 1 and sum(x.num_rows for x in last[1:]) >= window:
                    last.pop(0)
        spare = sum(x.num_rows for x in last) - window
        for i, x in enumerate(last):
            yield edge(x.slice(max(0, spare)) if i == 0 else x)

    order = ["pass", "key", "rep"]  # a range may end within a key, so that one key may hold a third of all rows
    found_type = "a long, b long, sure boolean, pass int, key long, rep long, x binary"
    sent = distinct.select("rep", "v").mapInArrow(project, "pass int, key long, rep long, x binary").repartitionByRange(*order)
    levels, tasks = [], 0
    while tasks != 1:
        levels.append(ws.table(sent.sortWithinPartitions(*order).mapInArrow(link, found_type), "found"))
        edges = levels[-1].where("rep is not null").select(*order, "x")
        tasks = math.ceil(edges.count() / max(edge_rows, 4 * window)) or 1  # each level has half the rows of the one before, or fewer
        sent = edges.repartitionByRange(tasks, *order) if tasks > 1 else edges.repartition(1)
    levels.append(ws.table(sent.sortWithinPartitions(*order).mapInArrow(link, found_type), "found"))
    pairs = functools.reduce(DataFrame.unionByName, levels).where("a is not null").select("a", "b", "sure")
    pairs = ws.table(pairs, "pairs")
    ws.drop(*levels)
    comps = components(ws, pairs.where("sure").select("a", "b").unionByName(decided(distinct, pairs.where("not sure").select("a", "b"), threshold)))
    members = distinct.join(comps, distinct.rep == comps.node).select("component", "rep", "n", "v")
    counts = links_within(ws, ws.table(members, "members"), threshold, tile)
    of = distinct.join(comps.join(counts, comps.node == counts.id, "left"), distinct.rep == comps.node, "left")
    of = of.select("v", F.coalesce("component", "rep").alias("component"), F.coalesce(F.col("links"), F.col("n")).alias("weight"))
    of = of.withColumnRenamed("v", "w")
    kept = rows.withColumn("ok", ok).withColumn("k", F.when(F.col("ok"), F.col("v")))
    out = kept.join(of, F.col("k") == F.col("w"), "left")
    component = F.coalesce(F.col("component"), F.col("vec_id"))
    links = F.when(F.col("weight").isNull(), F.lit(0)).otherwise(F.col("weight") - 1).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def decided(distinct: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are linked, by the vectors (rep, v) themselves."""

    def run(batches):
        for b in batches:
            linked = np.zeros(b.num_rows, bool)
            va, vb = b.column(2), b.column(3)
            for r, x in by_width(va):
                y = by_width(vb.take(pa.array(r)))[0][1]  # windows hold one width
                linked[r] = cosines(scaled(x), scaled(y)) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(linked)) for i in (0, 1)], ["a", "b"])

    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = p.join(distinct.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(distinct.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    return p.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def links_within(ws: Workspace, members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """members (component, rep, n, v) -> (id, links): vectors linked with it, itself and its copies included."""
    most = math.acos(threshold)

    def partial(batches):
        for b in batches:
            c = b.column(0).to_numpy(zero_copy_only=False)
            for r, x in by_width(b.column(1)):
                name, at = np.unique(c[r], return_inverse=True)
                total = np.zeros((len(name), x.shape[1]))
                np.add.at(total, at, unit(x))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([bytes(y) for y in total], pa.binary())], ["component", "x"])

    def merge(key, t):
        x = np.sum([np.frombuffer(y) for y in t["x"].to_pylist()], axis=0)
        return pa.table({"component": pa.array([key[0].as_py()], pa.int64()), "centre": pa.array([x.tobytes()], pa.binary())})

    # one partial sum for each component and task
    sums = members.select("component", "v").mapInArrow(partial, "component long, x binary")
    centres = ws.table(sums.groupBy("component").applyInArrow(merge, "component long, centre binary"), "centres")

    def angle(batches):
        for b in batches:
            centre = b.column(b.schema.get_field_index("centre")).to_pylist()
            out = np.zeros(b.num_rows)
            for r, x in by_width(b.column(b.schema.get_field_index("v"))):
                y = np.frombuffer(b"".join([centre[i] for i in r])).reshape(len(r), -1)
                with np.errstate(invalid="ignore"):
                    out[r] = np.nan_to_num(np.arccos(np.clip(cosines(scaled(x), y), -1, 1)), nan=np.pi)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in ("component", "rep", "n")], pa.array(out)], ["component", "rep", "n", "angle"])

    angles = members.join(centres, "component").mapInArrow(angle, "component long, rep long, n long, angle double")
    angles = ws.table(angles, "angles")
    sizes = ws.table(angles.groupBy("component").agg(F.sum("n").alias("weight"), F.count("*").alias("size"), F.max("angle").alias("widest")), "sizes")
    tight = F.col("angle") + F.col("widest") <= most - 1e-7
    placed = angles.join(sizes, "component")
    sure = placed.where(tight).select(F.col("rep").alias("id"), F.col("weight").alias("links"))
    loose = ws.table(placed.where(~tight).select("component", "rep"), "loose")
    if loose.isEmpty():
        return ws.table(sure, "links")
    wide = loose.groupBy("component").agg(F.count("*").alias("far")).join(sizes, "component")
    wide = wide.select("component", F.ceil(F.col("far") / tile).cast("int").alias("nl"), F.ceil(F.col("size") / tile).cast("int").alias("nr"))
    all_ = ws.table(members.join(wide, "component").join(loose.select("rep", F.lit(True).alias("far")), "rep", "left"), "wide")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = all_.where("far").select("component", block("nl").alias("l"), spread("nr").alias("r"), F.lit(True).alias("left"), "rep", "n", "v")
    right = all_.select("component", spread("nl").alias("l"), block("nr").alias("r"), F.lit(False).alias("left"), "rep", "n", "v")

    def compare(key, t):
        is_left = t["left"].to_numpy()
        out = {"id": [], "links": []}
        a, b = t.filter(pa.array(is_left)), t.filter(pa.array(~is_left))
        for ra, xa in by_width(a["v"]):
            ids, total = a["rep"].to_numpy()[ra], np.zeros(len(ra), np.int64)
            xa = scaled(xa)
            for rb, xb in by_width(b["v"]):
                if xa.shape[1] == xb.shape[1]:
                    xb, other, n = scaled(xb), b["rep"].to_numpy()[rb], b["n"].to_numpy()[rb]
                    for i in range(0, len(xa), 512):
                        for j in range(0, len(xb), 512):
                            p, q = xa[i : i + 512], xb[j : j + 512]
                            linked = (p @ q.T / np.sqrt((p * p).sum(1)[:, None] * (q * q).sum(1)[None, :])) >= threshold
                            linked |= ids[i : i + 512, None] == other[None, j : j + 512]
                            total[i : i + 512] += linked @ n[j : j + 512]
            out["id"].append(ids)
            out["links"].append(total)
        return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for k, v in out.items()})

    counted = left.unionByName(right).groupBy("component", "l", "r").applyInArrow(compare, "id long, links long")
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    return ws.table(sure.unionByName(counted), "links")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
