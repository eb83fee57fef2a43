"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Tokenise each whole text, close it with an end id, and cut only what is
   longer than a sequence: the first piece takes the remainder, the rest are
   full.  One row per piece: length and CRC of its ids (plus ids on request).
2. Pieces are ranked within their length by a two-step prefix sum (salted, so
   that one very common length isn't one task).  From here on, equal lengths are
   one run (length, ranks), and sequences with equal gaps are runs as well: a few
   thousand rows, whatever the corpus holds.
3. Bulk-synchronous supersteps.  Pieces and gaps are range-sorted: range r holds
   sizes above size / 8**(r + 1), up to size / 8**r.  In a superstep all ranges that
   have both are swept at once, each in a task of its own: its pieces, longest first,
   go to their successor, the smallest gap that holds them; where more pieces than
   places meet, the lower rank wins and the others stay.  Then gaps are updated and
   move to the range of what is left of them, and it repeats.  Pieces that are
   the longest left over go on to the next range with gaps, and open sequences in range
   0; shorter ones keep to their own range until then, whose gaps no longer piece could
   take.  So a step is the work of several tasks, the outcome is that of one sweep over
   all, and steps without work don't happen.
4. A distributed look-up gives each piece the place of its rank: sequence and
   offset.  What it looks up are the runs of step 3, sent to all tasks.

Edge cases: null or empty text is the end id alone; repeated rows and null ids
are packed row by row; a text of any length is tokenised whole, long runs of white
space included (its ids must fit a task's memory, 4 bytes each); an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read, small

SIZE = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Characters for which both libraries split and merge alike (tested); other texts take the slower library.
PLAIN = r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*"
#: A run of white space this long takes the slower library too: the faster one's pattern recurses on it, and ends the process.
RUN_OF_SPACE = r"[\t\n\r\x20\xa0]{5000}"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokeniser:
    """ids of ``tokenizers`` for the given file; texts of plain characters go through
    ``tiktoken`` with the same vocabulary, which gives the same ids several times as fast."""

    def __init__(self, path: str, ranks_path: str | None = None):
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = list(self.slow.get_added_tokens_decoder().values())
        self.special = [t.content for t in self.special]
        self.plain, self.run, self.fast = re.compile(PLAIN), re.compile(RUN_OF_SPACE), None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and self.plain.fullmatch(text) and not any(s in text for s in self.special) and not (len(text) >= 5000 and self.run.search(text)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, path: str, ranks_path: str | None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, piece, start, length, ids_crc32[, ids]."""

    def run(batches):
        tok = Tokeniser(path, ranks_path)
        for b in small(batches, 1):
            out = ([], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(tok.ids(text.as_py() or ""), np.uint32(0)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    row = (doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), ids[i:j].tobytes() if keep_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_ids else 5], names[: 6 if keep_ids else 5])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], size: int, opens: int | None = None) -> tuple[list, list, list]:
    """Best fit within one range, longest pieces first; pieces (length, first rank, number), gaps (gap, first sequence, number).

    Returns placements (length, first rank, number, first sequence, pieces per sequence, offset), the pieces without a place
    and the gaps left.  With ``opens``, pieces without a place open sequences of that number and above.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    stay: list[tuple[int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, number)
    for gap, first, number in sorted(gaps, reverse=True):
        bins.setdefault(gap, []).append((first, number))
    sizes = sorted(bins)

    def give(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in bins:
                insort(sizes, gap)
                bins[gap] = []
            bins[gap].append((first, number))

    for length, rank, left in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while left:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                first, number = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    sizes.pop(i)
            elif opens is None:
                stay.append((length, rank, left))
                break
            else:
                gap, first = size, opens
                number = -(-left // (size // length))
                opens += number
            each = gap // length
            full = min(number, left // each)
            rest = left - full * each if full < number and left - full * each < each else 0
            if full or rest:
                placed.append((length, rank, full * each + rest, first, each, size - gap))
            give(gap - each * length, first, full)
            give(gap - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            give(gap, first + used, number - used)
            rank += full * each + rest
            left -= full * each + rest
    return placed, stay, [(gap, *run) for gap, runs in bins.items() for run in runs]


def class_of(length: int, size: int) -> int:
    """The range of a piece or gap: the largest r with length <= size / 8**r."""
    r = 0
    while length * 8 ** (r + 1) <= size:
        r += 1
    return r


PIECE, GAP, PLACED = 0, 1, 2
RUN = "kind int, size long, first long, n long, sequence long, per long, offset long"


def ranged(size: int):
    """The range of a run's size, as a column."""
    edges = [size // 8**r for r in range(1, class_of(1, size) + 1)]  # sizes up to edges[r - 1] are in range r at least
    return sum((F.when(F.col("size") <= e, 1).otherwise(0) for e in edges), F.lit(0))


def superstep(state: DataFrame, step: int, size: int, moves: dict[int, int]) -> DataFrame:
    """Runs of pieces and gaps after one superstep, and what it placed; ``moves``: the range that each class of pieces sweeps."""
    to = F.when(F.col("kind") == GAP, ranged(size))
    for start, at in moves.items():
        to = to.when(ranged(size) == start, F.lit(at))
    here = state.withColumn("range", F.when(to.isin(list(moves.values())), to).cast("int"))

    def run(key, t):
        part = lambda kind, *columns: list(zip(*(t.filter(pc.equal(t["kind"], kind))[c].to_pylist() for c in columns)))
        opens = step << 40 if key[0].as_py() == 0 else None
        placed, stay, left = sweep(part(PIECE, "size", "first", "n"), part(GAP, "size", "sequence", "n"), size, opens)
        rows = [(PLACED, *x) for x in placed] + [(PIECE, *x, 0, 0, 0) for x in stay] + [(GAP, gap, 0, n, first, 0, 0) for gap, first, n in left]
        kinds = [pa.int32(), *[pa.int64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["kind", "size", "first", "n", "sequence", "per", "offset"])

    swept = here.where("range is not null").groupBy("range").applyInArrow(run, RUN)
    return swept.unionByName(here.where("range is null").drop("range"))


def moves_of(pieces: set[int], gaps: set[int], place: int) -> dict[int, int]:
    """Which range each class of pieces sweeps next: the longest the first one with gaps from ``place`` on, or range 0; others their own."""
    longest = min(pieces)
    return {c: c for c in pieces if c != longest and c in gaps} | {longest: next((r for r in range(place, 0, -1) if r in gaps), 0)}


def placements(ws: Workspace, counts: DataFrame, size: int = SIZE) -> DataFrame:
    """counts (length, n) -> runs (length, first, n, sequence, per, offset): where each rank of a length is placed."""
    none = F.lit(0).cast("long")
    state = counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), none.alias("first"), "n", none.alias("sequence"), none.alias("per"), none.alias("offset"))
    state = ws.table(state, "pieces")
    done, step, place, before = None, 0, 0, None
    while True:
        there = {(r["kind"], r["range"]) for r in state.select("kind", ranged(size).alias("range")).distinct().collect()}  # a few ranges
        pieces = {r for kind, r in there if kind == PIECE}
        if not pieces:
            break
        if min(pieces) != before:
            before = place = min(pieces)
        moves = moves_of(pieces, {r for kind, r in there if kind == GAP}, place)
        place = moves[before] - 1
        out = ws.table(superstep(state, step, size, moves), f"step{step}")
        state = out.where(F.col("kind") < PLACED)
        placed = out.where(F.col("kind") == PLACED)
        done = placed if done is None else done.unionByName(placed)
        step += 1
    done = state if done is None else done
    return done.withColumnRenamed("size", "length").drop("kind")


def pack(ws: Workspace, items: DataFrame, size: int = SIZE, columns: list[str] | None = None) -> DataFrame:
    """items with ``length`` (1..size) and ``row`` (a number of its own) -> the same rows with sequence_id and offset.

    ``items`` must be a written table, so that each row keeps its number.
    """
    columns = columns or [c for c in items.columns if c != "row"]
    salt = max(1, int(items.count() ** 0.5) // 8)
    keyed = items.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salt)))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = ws.table(keyed.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    runs = placements(ws, counts.groupBy("length").agg(F.sum("n").alias("n")), size).toArrow()  # runs, not documents
    runs = np.array([runs[c].to_numpy() for c in ("length", "first", "sequence", "per", "offset")], dtype=np.int64).T.reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    # the counts grow with the corpus: never broadcast
    ranked = keyed.withColumn("nth", F.row_number().over(within) - 1).join(counts.hint("merge"), ["length", "salt"])
    ranked = ranked.select(*columns, (F.col("ahead") + F.col("nth")).alias("rank"))
    shared = items.sparkSession.sparkContext.broadcast(runs)

    def look_up(batches):
        t = shared.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = t[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            new = [pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)]
            kept = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(kept + new, [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(look_up, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = "byte_bpe_50k.tiktoken", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    ws = Workspace(docs.sparkSession, "pack")
    path = tokenizer or vocabulary_path(TOKENIZER)
    items = pieces(docs, path, vocabulary_path(ranks) if ranks and tokenizer is None else None, size, keep_ids)
    return pack(ws, ws.table(items.withColumn("row", F.monotonically_increasing_id()), "pieces"), size)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
