"""Nearest neighbours by a block matrix join: int8 tiles, error bounds, exact recomputation, heaps.

1. Each vector becomes int8 components, a scale, and the exact length of what rounding left, in one binary of a byte a component
   and 24 more.  Originals are written once and not sent around.
2. Queries are dealt to blocks of at most about ``query_block`` rows, candidates to blocks of about ``candidate_block`` rows, and
   each block of queries meets each block of candidates at a place of its own: the binaries of a row go once to each
   block of the other side, so nothing passes the driver and the plan doesn't depend on the number of queries.  A place
   holds its queries and reads its candidates in batches, so a block of candidates may be larger than memory.
3. A task multiplies int8 tiles of queries and candidates (in stretches of at most 1024 components, whose products float32 holds
   exactly).  With x = x' + e, |e| known exactly, the true distance is within |e| + |f| of the distance of the quantised
   vectors, so a pair whose lower bound is above the k-th smallest upper bound of its query can't be among the k
   nearest.  A place keeps those k upper bounds for each query and sends on the pairs that are left; the same bound over all
   places then leaves little more than k pairs for each query.
4. These fetch their two originals, distances are computed in double precision, one component after the other, and the heaps of k
   for each query merge in a last aggregate.  Nothing is approximate: recall is 1.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another width than the query aren't
candidates; a candidate with the query's own id is never returned; distances are
those of double precision, so they overflow to infinity, or vanish, where their squares do; repeated
rows each count; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read
from .vectors import by_width, usable

#: Squares of shorter distances lose digits or vanish; so they count as equal until they are recomputed.
TINY = 1e-150
TAIL = np.dtype([("scale", "<f8"), ("left", "<f8"), ("id", "<i8")])
CANDIDATE = 1 << 62


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale of each row, and the length of what rounding left."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    scale = np.maximum(scale, 1e-300)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    with np.errstate(over="ignore"):
        left = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, left * (1 + 1e-9) + 1e-300


def squares(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (q.astype(np.float64) ** 2).sum(axis=1) * scale**2


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed one component after the other."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for i in range(a.shape[1]):
            d = a[:, i] - b[:, i]
            total += d * d
    return np.sqrt(total)


def pack(x: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """int8 components, scale, length of the rest and id of each row."""
    q, scale, left = quantise(x)
    tail = np.empty(len(x), TAIL)
    tail["scale"], tail["left"], tail["id"] = scale, left, ids
    both = np.concatenate([q.view(np.uint8), tail.view(np.uint8).reshape(len(x), TAIL.itemsize)], axis=1)
    return [row.tobytes() for row in both]


class Tile:
    """Packed rows of one width."""

    def __init__(self, rows: np.ndarray, packed: list[bytes]):
        both = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        tail = np.ascontiguousarray(both[:, -TAIL.itemsize :]).view(TAIL)[:, 0]
        self.rows, self.q = rows, both[:, : -TAIL.itemsize].view(np.int8)
        self.scale, self.left, self.ids = tail["scale"].copy(), tail["left"].copy(), tail["id"].copy()
        self.square = squares(self.q, self.scale)


def tiles(rows: np.ndarray, packed: list[bytes]) -> dict[int, Tile]:
    """Packed rows by width."""
    size = np.array([len(p) for p in packed])
    return {int(w) - TAIL.itemsize: Tile(rows[size == w], [p for p in packed if len(p) == w]) for w in np.unique(size)}


class Search:
    """Queries of a place and one width: the k least upper bounds of each, and pairs that may still be among its k nearest."""

    def __init__(self, queries: Tile, k: int):
        self.queries, self.k = queries, k
        self.best = np.full((len(queries.rows), k), np.inf)  # least upper bounds, in any order
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def limit(self) -> np.ndarray:
        return self.best.max(axis=1)

    def add(self, c: Tile, tile: int = 2048) -> None:
        s = self.queries
        for a in range(0, len(s.rows), tile):
            qa = s.q[a : a + tile].astype(np.float32)
            for b in range(0, len(c.rows), tile):
                qb = c.q[b : b + tile].astype(np.float32)
                # 1024 products of int8 add up to whole numbers below 2**24, which float32 holds exactly
                dot = sum((qa[:, i : i + 1024] @ qb[:, i : i + 1024].T).astype(np.float64) for i in range(0, qa.shape[1], 1024))
                with np.errstate(over="ignore", invalid="ignore"):  # of great components: no bound, so they are recomputed
                    both = s.square[a : a + tile, None] + c.square[None, b : b + tile]
                    d = np.sqrt(np.maximum(both - 2 * dot * s.scale[a : a + tile, None] * c.scale[None, b : b + tile], 0))
                    # subtraction of squares: its rounding error, in terms of the distance
                    slack = s.left[a : a + tile, None] + c.left[None, b : b + tile] + TINY + np.sqrt(1e-14 * both)
                    upper, lower = d + slack, d - slack
                own = s.ids[a : a + tile, None] == c.ids[None, b : b + tile]
                upper[own | np.isnan(upper)] = np.inf
                lower[np.isnan(lower)] = -np.inf
                near = np.concatenate([self.best[a : a + tile], upper], axis=1)
                self.best[a : a + tile] = np.partition(near, self.k - 1, axis=1)[:, : self.k]
                i, j = np.nonzero((lower <= self.best[a : a + tile].max(axis=1)[:, None]) & ~own)
                self.pairs.append((a + i, c.rows[b + j], lower[i, j], upper[i, j]))
                self.held += len(i)

    def left(self):
        """Takes out the pairs that the bounds leave, as (query, candidate, lower, upper)."""
        i, j, lower, upper = (np.concatenate(x) for x in zip(*self.pairs)) if self.pairs else (np.empty(0, int),) * 4
        self.pairs, self.held = [], 0
        m = lower <= self.limit()[i]
        return i[m], j[m], lower[m], upper[m]

    def thin(self, most: int = 2_000_000):
        """Pairs to send on now, where there are more than a task should hold."""
        if self.held > most:
            kept = self.left()
            if len(kept[0]) > most // 2:
                return kept
            self.pairs, self.held = [kept], len(kept[0])
        return None


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int = 32768, candidate_block: int = 1 << 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "nearest")
    base = vectors.where(usable(F.col(vector)) & F.col(id_column).isNotNull())
    base = base.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = ws.table(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries, width = base.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    a = -(-n_queries // max(1, min(query_block, (1 << 24) // width)))  # of queries; memory of a block is bounded at any width
    b = max(-(-n // candidate_block), min(64, n // 4096), 1)  # of candidates; several for a small table too, so that tasks share it

    def packed(batches):
        for batch in batches:
            ids, out = batch.column(1).to_numpy(zero_copy_only=False), [b""] * batch.num_rows
            for r, x in by_width(batch.column(3)):
                for i, p in zip(r.tolist(), pack(x, ids[r])):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["row", "q", "code"])

    coded = ws.table(base.select("row", "vec_id", "q", "v").mapInArrow(packed, "row long, q boolean, code binary"), "coded")
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = coded.where("q").withColumn("other", spread(b)).select((deal(a) * b + F.col("other")).alias("place"), "row", "code")
    right = coded.withColumn("other", spread(a)).select((F.col("other") * b + deal(b)).alias("place"), (F.col("row") + CANDIDATE).alias("row"), "code")

    def run(batches):
        """Rows by place, queries first."""
        place, waiting, searches = None, [], {}

        def pairs(search, found):
            i, j, lower, upper = found
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(search.queries.rows[i]), pa.array(j), pa.array(lower), pa.array(upper)], ["query", "candidate", "lower", "upper"])

        def done():
            for s in searches.values():
                yield from pairs(s, s.left())

        for batch in batches:
            if not batch.num_rows:
                continue
            places, row, code = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            kind = row >= CANDIDATE
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(places)]
            for i, j in zip(edges, edges[1:]):
                if places[i] != place:
                    yield from done()
                    place, searches = places[i], {}
                    waiting.clear()
                here = (row[i:j], code.slice(i, j - i).to_pylist())
                if not kind[i]:
                    waiting.append(here)
                    continue
                if waiting:  # queries of the place are complete
                    held = tiles(np.concatenate([r for r, _ in waiting]), [p for _, part in waiting for p in part])
                    searches = {w: Search(t, k) for w, t in held.items()}
                    waiting.clear()
                for w, t in tiles(here[0] - CANDIDATE, here[1]).items():
                    if w in searches:
                        searches[w].add(t)
                        over = searches[w].thin()
                        if over:
                            yield from pairs(searches[w], over)
        yield from done()

    both = left.unionByName(right).repartition("place").sortWithinPartitions("place", "row")
    met = ws.table(both.mapInArrow(run, "query long, candidate long, lower double, upper double"), "pairs")
    # the k-th least upper bound over all places
    nth = F.row_number().over(Window.partitionBy("query").orderBy("upper", "candidate"))
    limit = met.select("query", "candidate", "upper").withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query").agg(F.max("upper").alias("upper"), F.count("*").alias("n"))
    limit = limit.select("query", F.when(F.col("n") == k, F.col("upper")).otherwise(float("inf")).alias("most"))
    open_ = met.join(limit, "query").where(F.col("lower") <= F.col("most")).select("query", "candidate")
    of = lambda name: base.select(F.col("row").alias(name), F.col("vec_id").alias(f"{name}_id"), F.col("v").alias(f"{name}_v"))
    pairs_ = open_.join(of("query"), "query").join(of("candidate"), "candidate")

    def distances(batches):
        for batch in batches:
            if batch.num_rows:
                score = np.empty(batch.num_rows)
                for (r, x), (_, y) in zip(by_width(batch.column(3)), by_width(batch.column(4))):
                    score[r] = exact(x, y)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    found = pairs_.select("query", "query_id", F.col("candidate_id").alias("vec_id"), "query_v", "candidate_v").mapInArrow(distances, "query long, query_id long, vec_id long, score double")
    # heaps merge: k smallest (score, id) of each query
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
