"""Repeated passages: count-min prefilter, then exact groups of the windows left.

A window is ``length`` consecutive words.  Windows that repeat have equal
words, so they also share the smallest hash among their ``gram``-word grams and
its place; that gram is the window's anchor, and neighbouring windows mostly
have the same one (one anchor for about every 14 words).

Pass 1: each partition counts its anchors' hashes in a count-min sketch; the
sparse sketches merge by blocks of cells, one after the other as they come in.  An anchor's count bounds the count
of each of its windows from above, so a window whose anchor isn't estimated to
repeat doesn't repeat.  What is kept of the merged sketch is one bit a cell
("two or more"), at most ``most_bits`` in each row of it, whatever the corpus.
Pass 2: only windows estimated repeated go on, by anchor hash, with a hash of
their own 35 words; both (128 bits) name a window.  Each task first groups its
own: what repeats there is known, and one occurrence is sent for all, so a very
common passage is a row from each task, not from each document.  The others are
counted exactly after the shuffle.  Anchors that are very common (a frequent
8-word phrase in all kinds of windows) are found with the sketch, and their
windows are dealt by their own hash as well, so that they aren't one task.
Pass 3: the repeated stretches, each once, meet their documents, and covered
words go.

The sketch only saves work; where it fills up, more windows are counted exactly
and the result is the same.

Edge cases: null text has no words; texts shorter than a window lose nothing;
overlapping occurrences within one document count; rows without an id and
repeated rows are documents like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, Workspace, mix64, read, slices, text_bytes

BLOCK_BITS = 20
HEAVY_BITS = 10


class Rolling:
    """Hashes of all runs of ``width`` words, from prefix sums of h[i] * base**-i modulo 2**64."""

    def __init__(self, width: int, base: int, salt: int):
        self.width, self.base, self.salt = width, base | 1, U64(salt)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if len(h) < self.width:
            return np.empty(0, U64)
        if len(self.up) < len(h):
            ones = np.ones(2 * len(h), U64)
            self.up, self.down = (np.cumprod(np.concatenate([ones[:1], ones[1:] * U64(b)])) for b in (self.base, self.inverse))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h ^ self.salt) * self.down[: len(h)])])
        n = len(h) - self.width + 1
        return mix64((total[self.width :] - total[:n]) * self.up[:n])


class Windows:
    """Windows of a batch of texts: document, place, anchor hash, window hash."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.words = WordHashes()
        self.grams = Rolling(gram, 0x2545F4914F6CDD1D, 0x1F83D9ABFB41BD6B)
        self.whole = Rolling(length, 0x9E3779B97F4A7C15, 0x5BE0CD19137E2179)

    def read(self, texts: list[bytes]):
        """-> (starts of documents in the words of all, valid window places, place of each one's anchor, gram hashes, word hashes)"""
        split = [t.split() for t in texts]
        start = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        h = np.concatenate([self.words.of(w) for w in split]) if split else np.empty(0, U64)
        n = len(h) - self.length + 1
        if n <= 0:
            none = np.empty(0, np.int64)
            return start, none, none, np.empty(0, U64), h
        g = self.grams(h)
        last = np.repeat(start[1:], np.diff(start)) - self.length  # last window of each word's document
        at = np.flatnonzero(np.arange(n) <= last[:n])
        # sliding minimum with its place: blocks of doubling width, the earlier one on ties
        width, value, place = self.length - self.gram + 1, g, np.arange(len(g))
        k = 1
        while k < width:
            step = min(k, width - k)
            later = value[step:] < value[:-step]
            place = np.where(later, place[step:], place[:-step])
            value = np.where(later, value[step:], value[:-step])
            k += step
        return start, at, place[at], g, h


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(anchor ^ U64(0x51ED270B7F4A7C15 * (row + 1) & (2**64 - 1))) >> U64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int, depth: int, length: int, gram: int) -> DataFrame:
    """(row, block, once, more): cells that a partition saw once, and more than once; row -1: its commonest anchors and their counts."""

    def run(batches):
        reader, anchors = Windows(length, gram), []
        for b in batches:
            texts = text_bytes(b.column(0))
            for x, y in slices(texts):
                _, _, place, g, _ = reader.read(texts[x:y])
                anchors.append(g[np.unique(place)])
        found = np.concatenate(anchors) if anchors else np.empty(0, U64)
        anchor, n = np.unique(found, return_counts=True)
        often = n > 1 + (len(found) >> 13)  # fewer than 2**13
        anchor, n = anchor[often], n[often]
        block = (anchor >> U64(64 - HEAVY_BITS)).astype(np.int64)
        cut = np.flatnonzero(np.diff(block)) + 1
        for a, m, k in zip(np.split(anchor, cut), np.split(n, cut), block[np.concatenate([[0], cut])].tolist() if len(anchor) else ()):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([k], pa.int32()), pa.array([a.tobytes()]), pa.array([m.astype(np.int64).tobytes()])], ["row", "block", "once", "more"])
        for row in range(depth if len(found) else 0):
            cell, n = np.unique(cells(found, row, bits), return_counts=True)
            block = cell >> BLOCK_BITS
            cut = np.flatnonzero(np.diff(block)) + 1
            low = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            for c, m, k in zip(np.split(low, cut), np.split(n, cut), block[np.concatenate([[0], cut])].tolist()):
                columns = [pa.array([row], pa.int32()), pa.array([k], pa.int32()), pa.array([c[m == 1].tobytes()]), pa.array([c[m > 1].tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "block", "once", "more"])

    return docs.select("text").mapInArrow(run, "row int, block int, once binary, more binary")


def merged(parts: DataFrame, heavy: int) -> DataFrame:
    """(row, block, bits): compressed bit map of the cells seen twice or more in all; row -1: anchors counted ``heavy`` times or more.

    Parts of a block are merged as they pass, so a task holds one block's cells, however many partitions there are.
    """
    names = ["row", "block", "bits"]

    def one(row, block, data):
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names)

    def fold(held):
        anchor, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return [(anchor, np.bincount(at, np.concatenate([x for _, x in held])).astype(np.int64))]

    def run(batches):
        key, n, held, size = None, None, [], 0

        def done():
            if key is None:
                return
            if key[0] >= 0:
                yield one(*key, zlib.compress(np.packbits(n > 1).tobytes(), 1))
                return
            anchor, count = fold(held)[0]
            if (count >= heavy).any():
                yield one(*key, anchor[count >= heavy].tobytes())

        for b in batches:
            for row, block, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if (row, block) != key:
                    yield from done()
                    key, n, held, size = (row, block), np.zeros(1 << BLOCK_BITS if row >= 0 else 0, np.uint8), [], 0
                if row >= 0:
                    c = np.frombuffer(once.as_buffer(), np.uint32)
                    n[c] = np.minimum(n[c] + 1, 2)
                    n[np.frombuffer(more.as_buffer(), np.uint32)] = 2
                else:
                    held.append((np.frombuffer(once.as_buffer(), U64), np.frombuffer(more.as_buffer(), np.int64)))
                    size += len(held[-1][0])
                    if size > 1_000_000:
                        held, size = fold(held), 0
        yield from done()

    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(run, "row int, block int, bits binary")


class Filter:
    def __init__(self, blocks, bits: int, depth: int):
        self.bits, self.depth = bits, depth
        self.map = np.zeros((depth, max(1 << bits >> 3, 1 << BLOCK_BITS >> 3)), np.uint8)
        self.heavy = np.sort(np.concatenate([np.empty(0, U64), *(np.frombuffer(data, U64) for row, _, data in blocks if row < 0)]))
        for row, block, data in (x for x in blocks if x[0] >= 0):
            at = block << BLOCK_BITS >> 3
            self.map[row, at : at + (1 << BLOCK_BITS >> 3)] = np.frombuffer(zlib.decompress(data), np.uint8)

    def key(self, anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Where windows are counted: by their anchor, and where that is common by a part of their own hash."""
        if not len(self.heavy):
            return anchor
        i = np.minimum(np.searchsorted(self.heavy, anchor), len(self.heavy) - 1)
        return np.where(self.heavy[i] == anchor, mix64(anchor ^ mix64(window >> U64(56))), anchor)

    def __call__(self, anchor: np.ndarray) -> np.ndarray:
        ok = np.ones(len(anchor), bool)
        for row in range(self.depth):
            c = cells(anchor, row, self.bits)
            ok &= (self.map[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


SENT = "anchor long, doc_id long, name long, start int, n int, windows binary"


def runs(*same: np.ndarray) -> np.ndarray:
    """Starts of stretches whose rows follow each other (equal in all but the last, which counts up by one)."""
    if not len(same[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(same[0]), bool)
    new[1:] = same[-1][1:] != same[-1][:-1] + 1
    for s in same[:-1]:
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def candidates(docs: DataFrame, shared, bits: int, depth: int, length: int, gram: int, most: int = 1_000_000) -> DataFrame:
    """Stretches of windows estimated repeated: with their hashes, to be counted; or without, where a task knows already."""

    def flush(keep, docs_, names, doc, place, anchor, window):
        anchor = keep.key(anchor, window)
        order = np.lexsort((window, anchor))
        a, w = anchor[order], window[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(first) - 1
        again = np.bincount(group)[group] > 1
        send, known = np.empty(len(a), bool), np.empty(len(a), bool)
        send[order], known[order] = first, again
        for kind in (send, known):
            i = np.flatnonzero(kind)
            if not len(i):
                continue
            r = runs(doc[i], anchor[i], place[i]) if kind is send else runs(doc[i], place[i])
            n = np.diff(np.append(r, len(i)))
            d = doc[i[r]]
            ids = pa.array(docs_).take(pa.array(d))
            name = names[d]
            if kind is send:
                key, raw = anchor[i[r]].view(np.int64), window[i].tobytes()
                end = np.cumsum(n) * 8
                blobs = pa.array([raw[x:y] for x, y in zip((end - n * 8).tolist(), end.tolist())], pa.binary())
            else:
                key = mix64(name.view(U64) + d.astype(U64)).view(np.int64)
                blobs = pa.nulls(len(r), pa.binary())
            columns = [pa.array(key), ids.cast(pa.int64()), pa.array(name), pa.array(place[i[r]].astype(np.int32)), pa.array(n.astype(np.int32)), blobs]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "name", "start", "n", "windows"])

    def run(batches):
        reader, keep = Windows(length, gram), Filter(shared.value, bits, depth)
        ids, names, held, n = [], [], [], 0
        for b in batches:
            texts = text_bytes(b.column(1))
            for x, y in slices(texts):
                start, at, place, g, h = reader.read(texts[x:y])
                if len(at):
                    repeated = keep(g[place])
                    at, place = at[repeated], place[repeated]
                if not len(at):
                    continue
                doc = np.searchsorted(start, at, side="right") - 1
                held.append((doc + len(ids), at - start[doc], g[place], reader.whole(h)[at]))
                n += len(at)
                ids += b.column(0).slice(x, y - x).to_pylist()
                names.append(b.column(2).slice(x, y - x).to_numpy(zero_copy_only=False))
                if n >= most:
                    yield from flush(keep, pa.array(ids, pa.int64()), np.concatenate(names), *(np.concatenate(c) for c in zip(*held)))
                    ids, names, held, n = [], [], [], 0
        if n:
            yield from flush(keep, pa.array(ids, pa.int64()), np.concatenate(names), *(np.concatenate(c) for c in zip(*held)))

    return docs.select("doc_id", "text", "name").mapInArrow(run, SENT)


def counted(sent: DataFrame) -> DataFrame:
    """(doc_id, name, start, n): stretches of windows that repeat, from rows sorted by anchor within their partition."""

    def settle(t: pa.Table):
        n = t["n"].to_numpy()
        window = np.frombuffer(b"".join(t["windows"].to_pylist()), U64)
        row = np.repeat(np.arange(len(n)), n)
        anchor = t["anchor"].to_numpy()[row]
        order = np.lexsort((window, anchor))
        a, w = anchor[order], window[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(first) - 1
        hit = np.empty(len(a), bool)
        hit[order] = np.bincount(group)[group] > 1
        place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + t["start"].to_numpy()[row])[hit]
        row = row[hit]
        r = runs(row, place)
        take = pa.array(row[r])
        length = np.diff(np.append(r, len(row))).astype(np.int32)
        return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(take), t["name"].combine_chunks().take(take), pa.array(place[r].astype(np.int32)), pa.array(length)], ["doc_id", "name", "start", "n"])

    def run(batches):
        open_: list[pa.Table] = []  # rows of the last anchor, which may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            known = t.filter(t["windows"].is_null())
            for k in known.select(["doc_id", "name", "start", "n"]).to_batches():
                yield k
            t = t.filter(t["windows"].is_valid())
            if not t.num_rows:
                continue
            last = t["anchor"].to_numpy()
            if open_ and open_[-1]["anchor"][-1].as_py() == last[0] == last[-1]:
                open_.append(t)
                continue
            cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0
            done = pa.concat_tables([*open_, t.slice(0, cut)])
            if done.num_rows:
                yield settle(done)
            open_ = [t.slice(cut)]
        if open_:
            yield settle(pa.concat_tables(open_))

    return sent.mapInArrow(run, "doc_id long, name long, start int, n int")


def sketch_bits(characters: int, gram_share: int = 10, least: int = 20, most: int = 30) -> int:
    """Cells of a sketch row: about ten for each anchor (one for 80 characters), at most 2**most."""
    return int(min(most, max(least, np.ceil(np.log2(max(1, characters / 80 * gram_share))))))


def stretches(docs: DataFrame, length: int = 35, gram: int = 8, depth: int = 2, most_bits: int = 30, least_heavy: int = 64) -> DataFrame:
    """docs (doc_id, text, name) -> (doc_id, name, start, n): windows start..start+n-1 of a text repeat somewhere."""
    spark = docs.sparkSession
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch_bits(characters, most=most_bits)
    # anchors in more than one of 16384, or of which a task could hold too many: at most max(2**14, anchors / 2**20)
    heavy = max(least_heavy, min(characters // 80 >> 14, 1 << 20))
    blocks = merged(sketch(docs, bits, depth, length, gram), heavy).toArrow()  # one bit a cell: at most depth * 2**most_bits bits, compressed
    shared = spark.sparkContext.broadcast(list(zip(*(blocks[c].to_pylist() for c in ("row", "block", "bits")))))
    sent = candidates(docs, shared, bits, depth, length, gram)
    return counted(sent.repartition("anchor").sortWithinPartitions("anchor"))


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 8, depth: int = 2, most_bits: int = 30, least_heavy: int = 64) -> DataFrame:
    """documents -> doc_id, n_words, n_removed, kept (the words left, joined by a space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("name", F.xxhash64(F.coalesce("text", F.lit(""))))
    hits = stretches(docs, length, gram, depth, most_bits, least_heavy)
    hits = hits.groupBy("doc_id", "name").agg(F.collect_set(F.struct("start", "n")).alias("hits"))  # equal rows have equal stretches
    hits = Workspace(docs.sparkSession, "substring").table(hits, "hits").withColumnsRenamed({"doc_id": "d", "name": "m"})
    both = docs.join(hits, F.coalesce("doc_id", F.lit(0)).eqNullSafe(F.coalesce("d", F.lit(0))) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("name") == F.col("m")), "left")

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, hit in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
                words = text.split()
                covered = np.zeros(len(words) + 1, np.int32)
                for x in hit or ():
                    covered[x["start"]] += 1
                    covered[x["start"] + x["n"] + length - 1] -= 1
                gone = np.cumsum(covered)[:-1] > 0 if hit else np.zeros(len(words), bool)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if hit else words
                for column, value in zip(out, (len(words), int(gone.sum()), b" ".join(kept).decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), v AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), h AS (
  SELECT r, i FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)
), x AS (
  SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM h) GROUP BY r
), y AS (
  SELECT d.r, d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda e, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN x USING (r)
)
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y
"""
