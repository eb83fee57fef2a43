"""Language-model scores from a hierarchical Pitman-Yor process.

Restaurants, from the top:

* one for each context of a word, the word right before it.  Every word is a context of its own, and so is
  the start of a text (context 0); words without training tokens have empty restaurants.  ``pooled`` is a
  smaller model, in which words outside the dictionary share context 0.  The dictionary is what the driver and
  all tasks know: words that occur at least min(sqrt(n), n / 2**FREQUENT_BITS) times, and twice, among n
  training tokens, so at most max(sqrt(n), 2**FREQUENT_BITS);
* the words' common parent, whose customers are the tables of all contexts; its
  base measure is diffuse, so it serves each word at one table, and what it
  leaves to the base is the probability of a word not seen before.

As in the base score, all words without training tokens are one outcome, so
both scores are probabilities over the same outcomes and sum to one.

Seating is sampled by Gibbs sweeps, bulk-synchronously: in a sweep the customers
of each dish (word) of a restaurant leave, and sit down again one after the
other by the Chinese-restaurant rule, given the totals of all restaurants after
the last sweep; then totals and discounts (n1 / (n1 + 2 n2), from dishes with
one and two customers) are brought up to date.  Tables are a column of the
model.  The first ``most_exact`` customers of a dish sit one by one, further
ones in blocks of two per cent.  Predictive probabilities are averaged over the
samples after ``burn`` sweeps.

Data flow: rows are blobs of packed integers, one for each place and flush, so
that no row is a token.  Pairs of dictionary words (context, word) are dealt to
places by blocks of 2**12 consecutive pairs, so a frequent word or context is
spread; pairs with a rarer word are dealt by the word's 64-bit hash, and pairs of
a rarer context with a dictionary word by the context's.  Only totals of
dictionary words reach the driver and all tasks; those of rarer contexts are asked
for and told between places after each sweep (``link``).  Scoring: pairs with
more than n / 2**FREQUENT_BITS tokens are fewer than 2**FREQUENT_BITS, whatever
the corpus, and sent to all tasks; the other tokens of a flush meet the model
at their places, and sums for each document come back to the flush's place; pairs
of a rarer context and a rarer word go by the context's place to the word's.

Edge cases: null text is empty and scores its end alone; with no training
document every token is unseen and has probability one; repeated rows and null
ids are rows like others; very long texts are read whole; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, mix64, read, small, text_bytes, training
from .minhash import TO_LOWER

END = b""
FREQUENT_BITS = 20
#: Strengths of contexts and of their parent.
THETA = (10.0, 10.0)
FLUSH = 1_200_000
BLOCK_BITS = 12
PLACE_BITS = 16
#: Bytes of numbers that are worth packing.
PACKED_FROM = 128
#: Contexts outside the dictionary are named by this bit and the other 63 of the word's hash.
RARE = U64(1 << 63)


def seat(c: np.ndarray, alpha: np.ndarray, d: float, rng, most_exact: int = 24) -> np.ndarray:
    """Tables of dishes with ``c`` customers; alpha: strength times the parent's probability."""
    t = (c > 0).astype(np.float64)
    live, n = np.flatnonzero(c > 1), 1
    while len(live):
        step = 1 if n < most_exact else max(1, n // 50)
        p = alpha[live] / (alpha[live] + n - d * t[live])
        if step == 1:
            t[live] += rng.random(len(live)) < p
        else:
            t[live] += rng.binomial(np.minimum(step, c[live] - n).astype(np.int64), p)
        n += step
        live = live[c[live] > n]
    return t


# Packed integers


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as byte planes, as many as the largest needs, by zstd where that is smaller (shuffles compress by matches alone)."""
    x = np.ascontiguousarray(x).astype("<u8", copy=False)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(planes) >= PACKED_FROM:
        packed = pa.compress(planes, "zstd", asbytes=True)
        if len(packed) < len(planes):
            return len(x).to_bytes(7, "little") + bytes([width]) + packed
    return len(x).to_bytes(8, "little") + planes


def expand(blob: bytes) -> np.ndarray:
    size, packed = int.from_bytes(blob[:7], "little"), blob[7]  # planes, if packed
    out = np.zeros((size, 8), np.uint8)
    if len(blob) > 8:
        rest = pa.decompress(blob[8:], packed * size, "zstd") if packed else blob[8:]
        planes = np.frombuffer(rest, np.uint8).reshape(-1, size)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def climb(x: np.ndarray) -> bytes:
    """Ascending numbers, by their steps."""
    return squeeze(np.diff(x.astype(U64, copy=False), prepend=U64(0)))


def scale(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype=U64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Tokens(dict):
    """Tokens of texts: hash and number in the dictionary (from 1 by hash; 0 for other words); a bounded cache of words."""

    LIMIT = 400_000

    def __init__(self, words: np.ndarray = np.empty(0, U64), pooled: bool = True):
        self.words, self.fresh, self.pooled = words, [], pooled
        self.hash, self.number = np.empty(1024, U64), np.empty(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def look(self, words: list[bytes]) -> np.ndarray:
        """Places of words in ``hash`` and ``number``."""
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            n, end = len(self) - len(self.fresh), len(self)
            new = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), U64, end - n)
            self.fresh = []
            if end > len(self.hash):
                self.hash, self.number = (np.concatenate([x[:n], np.zeros(2 * end - n, x.dtype)]) for x in (self.hash, self.number))
            self.hash[n:end], self.number[n:end] = new, 0
            if len(self.words):
                i = np.minimum(np.searchsorted(self.words, new), len(self.words) - 1)
                self.number[n:end] = np.where(self.words[i] == new, i + 1, 0)
        return at

    @staticmethod
    def split(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
        """All tokens, and where each text's end."""
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += text.translate(TO_LOWER).split()
            words.append(END)
            ends.append(len(words))
        return words, ends

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, numbers and contexts of all tokens of the texts, each text closed by END; and tokens of each text."""
        words, ends = self.split(texts)
        at = self.look(words)
        h, number = self.hash[at], self.number[at]
        code = number.astype(U64)
        if not self.pooled:
            code = np.where(number == 0, h | RARE, code)
        context = np.zeros(len(at), U64)
        context[1:] = code[:-1]
        ends = np.array(ends, np.int64)
        context[ends[:-1]] = 0
        return h, number, context, np.diff(ends, prepend=0)


class Places:
    """Where pairs are dealt to; ``size``: words of the dictionary and the rest, as one factor of a pair's number."""

    def __init__(self, tokens: int, words: int):
        self.size = words + 1
        self.pairs = max(1, min(64, tokens >> PLACE_BITS), tokens >> 22)
        self.rare = max(1, self.pairs // 4)

    def numbers(self, place: int) -> bool:
        """Whether words of a row at a place are numbers of the dictionary."""
        return place < self.pairs or place >= self.pairs + self.rare

    def of_pairs(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(U64) >> U64(BLOCK_BITS)) % U64(self.pairs)).astype(np.int64)

    def of_rare(self, h: np.ndarray) -> np.ndarray:
        """In order of the hash."""
        return self.pairs + ((h >> U64(40)) * U64(self.rare) >> U64(24)).astype(np.int64)

    def of_contexts(self, code: np.ndarray) -> np.ndarray:
        """In order of the code of a context outside the dictionary."""
        return self.rare + self.of_rare(code << U64(1))


def cuts(place: np.ndarray):
    """(place, from, to) of an array sorted by place."""
    first = runs(place) if len(place) else []
    return zip(place[first].tolist() if len(place) else (), list(first), [*list(first)[1:], len(place)])


# Counting


def word_counts(texts: DataFrame) -> DataFrame:
    """text -> (h, n): training tokens of each word, END among them."""

    def run(batches):
        tokens, n = Tokens(), np.zeros(0, np.int64)  # n: by place in the cache

        def flush():
            seen = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(tokens.hash[seen].view(np.int64)), pa.array(n[seen])], ["h", "n"])

        for b in small(batches, 0):
            if len(tokens) > tokens.LIMIT:  # it is about to be cleared
                yield flush()
                n = np.zeros(0, np.int64)
            at = tokens.look(tokens.split(text_bytes(b.column(0)))[0])
            new = np.bincount(at, minlength=len(tokens))
            new[: len(n)] += n
            n = new
        if len(n):
            yield flush()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


#: keys: pairs of dictionary words, or hashes of rarer words, ascending; contexts of the latter, ``each`` of one word; n: tokens
#: (at places of rarer contexts keys are their codes, and ``contexts`` numbers of words).  From size on, contexts are places in
#: ``others``, codes of rarer contexts, ascending, with their customers (guests) and tables (seats, as many as ``tables``)
MODEL = "place int, keys binary, each binary, contexts binary, n binary, tables array<binary>, others binary, guests binary, seats array<binary>"
NAMES = [x.split()[0] for x in MODEL.split(", ")]
KINDS = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.list_(pa.binary())]


def model_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)


def merged_pairs(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = runs(key) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def merged_rare(h: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((context, h))
    h, context, n = h[order], context[order], n[order]
    first = runs(h, context) if len(h) else np.empty(0, np.int64)
    return h[first], context[first], np.add.reduceat(n, first) if len(h) else n


def pack_rare(h: np.ndarray, context: np.ndarray, n: np.ndarray, size: int) -> tuple[list[bytes], bytes]:
    """The first columns of a model's row, and its ``others``."""
    word = runs(h) if len(h) else np.empty(0, np.int64)
    far = context >= RARE
    others = np.unique(context[far])
    context = context.copy()
    context[far] = U64(size) + np.searchsorted(others, context[far]).astype(U64)
    return [climb(h[word]), squeeze(np.diff(np.append(word, len(h)))), squeeze(context), squeeze(n)], climb(others)


def unpack_rare(keys: bytes, each: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the word (its place among them) of each entry."""
    h, size = scale(keys), expand(each).astype(np.int64)
    return h, np.repeat(np.arange(len(h)), size)


def pair_counts(texts: DataFrame, words: np.ndarray, places: Places, pooled: bool = True) -> DataFrame:
    """text -> the model's rows, with one table for each dish."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    batch = model_rows

    def run(batches):
        tokens, held, size = Tokens(shared.value, pooled), [], 0

        def flush():
            h, number, context = (np.concatenate(x) for x in zip(*held))
            known, far = number > 0, context >= RARE
            near = known & ~far
            key, n = np.unique(context[near].astype(np.int64) * places.size + number[near], return_counts=True)
            place = places.of_pairs(key)
            order = np.argsort(place, kind="stable")
            place, key, n = place[order], key[order], n[order]
            for p, i, j in cuts(place):
                yield p, climb(key[i:j]), None, None, squeeze(n[i:j]), None, None, None, None
            after = known & far
            for place, *x in ((places.of_rare, h[~known], context[~known]), (places.of_contexts, context[after], number[after].astype(U64))):
                keys, other, n = merged_rare(*x, np.ones(len(x[0]), np.int64))
                for p, i, j in cuts(place(keys)):
                    columns, others = pack_rare(keys[i:j], other[i:j], n[i:j], places.size)
                    yield p, *columns, None, others, None, None

        for b in small(batches, 0):
            h, number, context, _ = tokens.read(text_bytes(b.column(0)))
            held.append((h, number, context))
            size += len(h)
            if size >= FLUSH:
                yield batch(list(flush()))
                held, size = [], 0
        if size:
            yield batch(list(flush()))

    def settle(place, parts):
        """Merges what a place got."""
        if place < places.pairs:
            key, n = (np.concatenate(x) for x in zip(*parts))
            key, n = merged_pairs(key, n)
            return place, climb(key), None, None, squeeze(n), [squeeze(np.ones(len(n), np.int64))], None, None, []
        h, context, n = merged_rare(*(np.concatenate(x) for x in zip(*parts)))
        columns, others = pack_rare(h, context, n, places.size)
        return place, *columns, [squeeze(np.ones(len(n), np.int64))], others, None, []

    def merge(batches):
        open_, parts, size, limit = None, [], 0, 0
        for b in batches:
            for row in b.to_pylist():
                if parts and row["place"] != open_:
                    yield batch([settle(open_, parts)])
                    parts, size, limit = [], 0, 0
                open_ = row["place"]
                if open_ < places.pairs:
                    parts.append((scale(row["keys"]).astype(np.int64), expand(row["n"]).astype(np.int64)))
                else:
                    h, word = unpack_rare(row["keys"], row["each"])
                    context, others = expand(row["contexts"]), scale(row["others"])
                    far = context >= U64(places.size) if len(others) else np.zeros(len(context), bool)
                    context[far] = others[(context[far] - U64(places.size)).astype(np.int64)]
                    parts.append((h[word], context, expand(row["n"]).astype(np.int64)))
                size += len(parts[-1][0])
                if size > max(2 * limit, 4_000_000):  # merge now and then, so that only distinct pairs are held
                    fold = merged_pairs if open_ < places.pairs else merged_rare
                    parts = [fold(*(np.concatenate(x) for x in zip(*parts)))]
                    size = limit = len(parts[0][0])
        if parts:
            yield batch([settle(open_, parts)])

    return texts.mapInArrow(run, MODEL).repartition("place").sortWithinPartitions("place").mapInArrow(merge, MODEL)


# Seating


class Sample:
    """Totals after a sweep: customers and tables of contexts; of dictionary words the customers at the parent; discounts."""

    def __init__(self, contexts: np.ndarray, tables: np.ndarray, parent: np.ndarray, rare: list[float], ones: list[float]):
        self.customers, self.tables, self.parents = contexts, tables, parent
        seen = parent > 0
        self.words, self.dishes = parent.sum() + rare[0], seen.sum() + rare[1]
        n1, n2 = (parent == 1).sum() + rare[2], (parent == 2).sum() + rare[3]
        self.d = [min(0.95, max(0.05, (a + 1) / (a + 2 * b + 2))) for a, b in (ones, (n1, n2))]

    def shares(self) -> np.ndarray:
        """What each context leaves to the common parent."""
        return (THETA[0] + self.d[0] * self.tables) / (THETA[0] + self.customers)

    def share(self) -> float:
        """What the parent leaves to words not seen."""
        return (THETA[1] + self.d[1] * self.dishes) / (THETA[1] + self.words)

    def parent(self, customers: np.ndarray) -> np.ndarray:
        return (customers - self.d[1]) / (THETA[1] + self.words)


def entries(row: dict, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of the model: keys, the word and the context of each entry, and tokens.  Words are numbers, or places in keys; contexts are numbers, or ``size`` and places in others."""
    n = expand(row["n"]).astype(np.int64)
    if row["place"] < places.pairs:
        key = scale(row["keys"]).astype(np.int64)
        return key, key % places.size, key // places.size, n
    h, word = unpack_rare(row["keys"], row["each"])
    if row["place"] < places.pairs + places.rare:
        return h, word, expand(row["contexts"]).astype(np.int64), n
    return h, expand(row["contexts"]).astype(np.int64), places.size + np.searchsorted(scale(row["others"]), h)[word], n


def link(ws: Workspace, table: DataFrame, places: Places) -> list[DataFrame]:
    """Tables with rows of rarer words, and of rarer contexts, whose customers and latest tables of rarer contexts are brought up to date.

    A row of rarer words asks each place of contexts for the totals of those that it has entries of, and tells its own share of them;
    a place of contexts adds up what it is told and has itself, and answers.
    """
    first = places.pairs + places.rare  # the first place of contexts

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                _, _, context, n = entries(row, places)
                others, t = scale(row["others"]), expand(row["tables"][-1]).astype(np.float64)
                far = context >= places.size
                guests, seats = (np.bincount(context[far] - places.size, x[far], len(others)) for x in (n, t))
                rows = [(p, 1, row["place"], climb(others[i:j]), None, squeeze(seats[i:j]), squeeze(guests[i:j]), None, None, None, None) for p, i, j in cuts(places.of_contexts(others))]
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [KINDS[0], pa.int32(), pa.int32(), *KINDS[1:]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "kind", "source", *NAMES[1:]])

    def groups(batches):
        open_, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if held and row["place"] != open_:
                    yield held
                    held = []
                open_ = row["place"]
                held.append(row)
        if held:
            yield held

    def answer(batches):
        for rows in groups(batches):
            if rows[0]["kind"] == 0:
                own, *asks = rows
            else:
                none = squeeze(np.empty(0))
                own, asks = {"place": rows[0]["place"], "keys": none, "each": none, "contexts": none, "n": none, "tables": [none], "seats": []}, rows
            h, word = unpack_rare(own["keys"], own["each"])
            asked = [scale(r["keys"]) for r in asks]
            others = np.unique(np.concatenate([h, *asked]))
            totals = np.zeros((2, len(others)))
            at = np.searchsorted(others, h)[word]
            totals[0] += np.bincount(at, expand(own["n"]).astype(np.float64), len(others))
            totals[1] += np.bincount(at, expand(own["tables"][-1]).astype(np.float64), len(others))
            ats = [np.searchsorted(others, x) for x in asked]
            for i, r in zip(ats, asks):
                totals[0][i] += expand(r["n"]).astype(np.float64)
                totals[1][i] += expand(r["contexts"]).astype(np.float64)
            yield batch([(own["place"], 0, None, *(own[x] for x in NAMES[1:6]), climb(others), squeeze(totals[0]), [*own["seats"], squeeze(totals[1])])])
            for i, r in zip(ats, asks):
                yield batch([(r["source"], 1, r["place"], None, None, squeeze(totals[1][i]), squeeze(totals[0][i]), None, None, None, None)])

    def settle(batches):
        for rows in groups(batches):
            own, *answers = rows
            guests, seats = (np.concatenate([np.empty(0, U64), *(expand(r[x]) for r in answers)]) for x in ("n", "contexts"))
            own |= {"guests": squeeze(guests), "seats": [*own["seats"], squeeze(seats)]}
            yield model_rows([tuple(own[x] for x in NAMES)])

    kinds = "place int, kind int, source int, " + MODEL.split(", ", 1)[1]
    with_kind = table.select("place", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("source"), *NAMES[1:])
    words, contexts = with_kind.where(F.col("place") < first), with_kind.where(F.col("place") >= first)
    asks = table.where(F.col("place") < first).mapInArrow(ask, kinds)
    answers = contexts.unionByName(asks).repartition("place").sortWithinPartitions("place", "kind").mapInArrow(answer, kinds)
    answers = ws.table(answers, "answers")
    words = words.unionByName(answers.where("kind = 1")).repartition("place").sortWithinPartitions("place", "kind", "source")
    return [ws.table(words.mapInArrow(settle, MODEL), "links"), answers]


def totals(table: DataFrame, places: Places) -> Sample:
    """Sums over the model's latest tables: arrays of the dictionary's size, and a few numbers."""
    k = places.size

    def run(batches):
        total = np.zeros(3 * k + 6)
        for b in batches:
            for row in b.to_pylist():
                keys, word, context, n = entries(row, places)
                t = expand(row["tables"][-1]).astype(np.float64)
                near = context < k
                total[:k] += np.bincount(context[near], n[near], k)
                total[k : 2 * k] += np.bincount(context[near], t[near], k)
                total[3 * k + 4 :] += [(n == 1).sum(), (n == 2).sum()]
                if places.numbers(row["place"]):
                    total[2 * k : 3 * k] += np.bincount(word, t, k)
                else:
                    u = np.bincount(word, t, len(keys))
                    total[3 * k : 3 * k + 4] += [u.sum(), len(u), (u == 1).sum(), (u == 2).sum()]
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "n"])

    found = table.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(3 * k + 6)
    total[found["i"].to_numpy()] = found["n"].to_numpy()
    return Sample(total[:k], total[k : 2 * k], total[2 * k : 3 * k], total[3 * k : 3 * k + 4].tolist(), total[3 * k + 4 :].tolist())


def sweep(table: DataFrame, places: Places, sample: Sample, number: int, keep: bool, seed: int) -> DataFrame:
    """The model with all dishes seated anew, given the totals of the latest tables; ``keep`` those as well."""
    shared = table.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        g = shared.value
        strength = THETA[0] + g.d[0] * g.tables
        for b in batches:
            for row in b.to_pylist():
                keys, word, context, n = entries(row, places)
                old = expand(row["tables"][-1]).astype(np.float64)
                customers = g.parents if places.numbers(row["place"]) else np.bincount(word, old, len(keys))
                rng = np.random.default_rng([seed, number, row["place"]])
                all_ = np.append(strength, THETA[0] + g.d[0] * expand(row["seats"][-1]).astype(np.float64)) if row["seats"] else strength
                t = seat(n, all_[context] * g.parent(customers)[word], g.d[0], rng)
                kept = slice(None) if keep else slice(-1)
                row["tables"] = [*row["tables"][kept], squeeze(t.astype(np.int64))]
                row["seats"] = row["seats"][kept]  # those of the new tables are added by ``link``
                yield model_rows([tuple(row[x] for x in NAMES)])

    return table.mapInArrow(run, MODEL)


class Model:
    """The table, whose ``tables`` are those of the kept samples; the dictionary with its counts."""

    def __init__(self, table: DataFrame, words: np.ndarray, counts: np.ndarray, places: Places, samples: list[Sample], tokens: int, distinct: int, pooled: bool = True):
        self.table, self.words, self.counts, self.places, self.samples, self.tokens, self.distinct, self.pooled = table, words, counts, places, samples, tokens, distinct, pooled


def train(ws: Workspace, texts: DataFrame, sweeps: int = 3, burn: int = 1, seed: int = 5, pooled: bool = True) -> Model:
    """``pooled``: words outside the dictionary share context 0; else each is a context of its own."""
    counts = ws.table(word_counts(texts), "counts")
    n, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    least = max(2, min(math.isqrt(n) + 1, (n >> FREQUENT_BITS) + 1))
    often = counts.where(F.col("n") >= least).toArrow()  # at most max(sqrt(n), 2**FREQUENT_BITS) words
    words = often["h"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(words)
    words, number = words[order], often["n"].to_numpy()[order]
    ws.drop(counts)
    places = Places(n, len(words))

    def linked(table: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The model's rows, and the tables that hold them."""
        if pooled:
            return table, [table]
        words, contexts = link(ws, table.where(F.col("place") >= places.pairs), places)
        near = table.where(F.col("place") < places.pairs)
        return near.unionByName(words).unionByName(contexts.where("kind = 0").select(*NAMES)), [table, words, contexts]

    table, held = linked(ws.table(pair_counts(texts, words, places, pooled), "pairs"))
    samples = [totals(table, places)]
    for s in range(sweeps):
        after, new = linked(ws.table(sweep(table, places, samples[-1], s, s > burn, seed), "seats"))
        ws.drop(*held)
        table, held = after, new
        samples.append(totals(table, places))
    return Model(table, words, number, places, samples[burn + 1 :], n, distinct, pooled)


# Scoring


class Known:
    """What all tasks know: the dictionary, shares and parents of the samples, and frequent pairs with their probabilities."""

    def __init__(self, m: Model, log_all: float):
        self.words, self.places, self.pooled = m.words, m.places, m.pooled
        self.base = np.append(0.0, np.log10(m.counts + 0.5) - log_all)
        self.unknown = math.log10(0.5) - log_all
        self.log_all = log_all
        s = m.samples
        self.shares = np.array([x.shares() for x in s]).reshape(len(s), -1)  # what contexts leave to the parent
        self.parents = np.array([x.parent(x.parents) for x in s]).reshape(len(s), -1)  # of dictionary words
        self.share = np.array([x.share() for x in s])  # what the parent leaves to words not seen
        self.unseen = (self.shares * self.share[:, None]).mean(axis=0)  # a word not seen, after each context
        self.by = [(x.d, THETA[0] + x.customers) for x in s]
        self.rare = [(x.d[1], THETA[1] + x.words) for x in s]
        self.keys, self.log_p = np.empty(0, np.int64), np.empty(0)

    def backed(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability by way of the parent."""
        return (self.shares[:, context] * self.parents[:, word]).mean(axis=0)

    def others(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a row of the model: codes of its rarer contexts, what each leaves to the parent, and its customers with the strength."""
        if not row["seats"]:
            return np.empty(0, U64), np.empty((len(self.by), 0)), np.empty(0)
        total = THETA[0] + expand(row["guests"]).astype(np.float64)
        return scale(row["others"]), np.array([(THETA[0] + d[0] * expand(t).astype(np.float64)) / total for (d, _), t in zip(self.by, row["seats"])]), total

    def probabilities(self, row: dict) -> tuple[np.ndarray, ...]:
        """Of a row of the model: keys, word and context of each entry, its probability; of rare words the tokens, and probabilities of the parent; its rarer contexts, and their shares."""
        keys, word, context, n = entries(row, self.places)
        tables = [expand(t).astype(np.float64) for t in row["tables"]]
        others, far, guests = self.others(row)
        shares = np.concatenate([self.shares, far], axis=1) if len(others) else self.shares
        own = np.mean([(n - d[0] * t) / (np.append(total, guests) if len(others) else total)[context] for (d, total), t in zip(self.by, tables)], axis=0)
        if self.places.numbers(row["place"]):
            return keys, word, context, own + (shares[:, context] * self.parents[:, word]).mean(axis=0), None, None, others, far
        parents = np.array([(np.bincount(word, t, len(keys)) - d) / total for t, (d, total) in zip(tables, self.rare)])
        p = own + (shares[:, context] * parents[:, word]).mean(axis=0)
        return keys, word, context, p, np.bincount(word, n, len(keys)), parents, others, far


def frequent_pairs(m: Model, known: Known, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with more than ``least`` tokens, which are fewer than tokens / least, and their log-probabilities."""
    shared = m.table.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        for b in batches:
            for row in b.to_pylist():
                i = np.flatnonzero(expand(row["n"]).astype(np.int64) > least)
                if len(i):
                    keys, _, _, p, *_ = known.probabilities(row)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(np.log10(p[i]))], ["key", "log_p"])

    t = m.table.where(F.col("place") < m.places.pairs).mapInArrow(run, "key long, log_p double").toArrow()
    key, log_p = t["key"].to_numpy(), t["log_p"].to_numpy()
    order = np.argsort(key)
    return key[order], log_p[order]


#: What goes to places: rows of the model, tokens of a flush (``times`` a key, documents of each), and the documents of a flush.
SENT = "place int, kind int, flush long, keys binary, each binary, contexts binary, n binary, tables array<binary>, docs binary"
SENT += ", others binary, guests binary, seats array<binary>"
MODEL_ROW, TOKENS, HEAD, SUMS, RARE_PAIRS = 0, 1, 2, 3, 4


def score(docs: DataFrame, is_training: Column, sweeps: int = 3, burn: int = 1, seed: int = 5, pooled: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``pooled`` as for training."""
    spark = docs.sparkSession
    ws = Workspace(spark, "hpylm")
    docs = docs.select("doc_id", "text", (~is_training).alias("held_out"))
    m = train(ws, docs.where(~F.col("held_out")).select("text"), sweeps, burn, seed, pooled)
    log_all = float(np.log10(m.tokens + 0.5 * (m.distinct + 1)))
    known = Known(m, log_all)
    known.keys, known.log_p = frequent_pairs(m, known, m.tokens >> FREQUENT_BITS)
    shared = spark.sparkContext.broadcast(known)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    head_type = f"ids array<{id_type}>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, score array<double>"
    names = [x.split()[0] for x in f"{SENT}, {head_type}".split(", ")]
    places = m.places

    def send(batches):
        """For each flush its documents, with the sums of what is known here, and its other tokens by place."""
        known = shared.value
        tokens, held, size, flush = Tokens(known.words, known.pooled), [], 0, None
        id_arrow = None

        def batch(kinds, columns):
            given = dict(zip([x for x, _ in kinds], columns))
            size = len(columns[0])
            types = {"place": pa.int32(), "kind": pa.int32(), "flush": pa.int64(), "tables": pa.list_(pa.binary()), "seats": pa.list_(pa.binary()), "ids": pa.list_(id_arrow), "held": pa.list_(pa.bool_()), "tokens": pa.list_(pa.int64()), "known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64())}
            return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(size, types.get(x, pa.binary())) for x in names], names)

        def settle():
            h, number, context, n = (np.concatenate(x) for x in list(zip(*held))[:4])
            doc = np.repeat(np.arange(len(n)), n)
            is_known = number > 0
            seen = np.bincount(doc[is_known], minlength=len(n))
            base = np.bincount(doc, known.base[number], len(n))
            far = context >= RARE
            i = np.flatnonzero(is_known & ~far)
            key = context[i].astype(np.int64) * places.size + number[i]
            order = np.argsort(key)
            key, d = key[order], doc[i[order]]
            first = runs(key) if len(key) else np.empty(0, np.int64)
            key, times = key[first], np.diff(np.append(first, len(key)))
            if len(known.keys):
                at = np.minimum(np.searchsorted(known.keys, key), len(known.keys) - 1)
                here = known.keys[at] == key
                log_p = np.where(here, known.log_p[at], 0.0)
            else:
                here, log_p = np.zeros(len(key), bool), np.zeros(len(key))
            score = np.bincount(d, np.repeat(log_p, times), len(n))
            whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
            ids, flags = (pa.concat_arrays([x[k] for x in held]) for k in (4, 5))
            lists = [whole(ids, id_arrow), whole(flags, pa.bool_()), whole(n, pa.int64()), whole(seen, pa.int64()), whole(base, pa.float64()), whole(score, pa.float64())]
            one = [pa.array([flush % (places.pairs + places.rare)], pa.int32()), pa.array([HEAD], pa.int32()), pa.array([flush])]
            yield batch([(x, 0) for x in ("place", "kind", "flush", "ids", "held", "tokens", "known", "base", "score")], one + lists)
            rows = []
            d = d[np.repeat(~here, times)]
            key, times = key[~here], times[~here]
            place = places.of_pairs(key)
            order = np.argsort(place, kind="stable")
            start = np.cumsum(times) - times
            place, key, start, times = place[order], key[order], start[order], times[order]
            d = d[np.repeat(start - np.cumsum(times) + times, times) + np.arange(len(d))]
            ends = np.append(0, np.cumsum(times))
            for p, i, j in cuts(place):
                rows.append((p, climb(key[i:j]), squeeze(times[i:j]), None, squeeze(d[ends[i] : ends[j]])))
            rows = [(p, TOKENS, *r) for p, *r in rows]
            for mask, kind, of, a, b in ((~is_known & ~far, TOKENS, places.of_rare, h, context), (is_known & far, TOKENS, places.of_contexts, context, number), (~is_known & far, RARE_PAIRS, places.of_contexts, context, h)):
                i = np.flatnonzero(mask)
                order = i[np.lexsort((b[i], a[i]))]
                key, other, d = a[order], b[order], doc[order]
                for p, i, j in cuts(of(key)):
                    first = runs(key[i:j])
                    rows.append((p, kind, climb(key[i:j][first]), squeeze(np.diff(np.append(first, j - i))), squeeze(other[i:j]), squeeze(d[i:j])))
            if rows:
                p, kind, keys, each, contexts, d = zip(*rows)
                yield batch([(x, 0) for x in ("place", "kind", "flush", "keys", "each", "contexts", "docs")], [pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array([flush] * len(p)), *(pa.array(x, pa.binary()) for x in (keys, each, contexts, d))])

        for b in small(batches, 1):
            id_arrow = b.schema.field(0).type
            flush = b.column(3)[0].as_py() if flush is None else flush
            held.append((*tokens.read(text_bytes(b.column(1))), b.column(0), b.column(2)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from settle()
                held, size, flush = [], 0, None
        if held:
            yield from settle()

    rows = docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
    sent = rows.mapInArrow(send, f"{SENT}, {head_type}")
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in head_type.split(", "))]
    model = m.table.select("place", F.lit(MODEL_ROW).alias("kind"), F.lit(None).cast("long").alias("flush"), "keys", "each", "contexts", "n", "tables", F.lit(None).cast("binary").alias("docs"), "others", "guests", "seats", *none)
    contexts_from = places.pairs + places.rare

    def meet(batches):
        """Tokens find their probabilities; sums for each document go back to its flush.  Heads and sums pass.

        Rarer words after rarer contexts come first to the context's place, take what it leaves to the parent, and go on to the word's.
        """
        known, row, found = shared.value, None, None
        schema = None
        pairs, size = [], 0

        def rest():
            """What is held of pairs: at their context's place by word on its way, at their word's by flush, summed up."""
            flush, doc, *x = (np.concatenate(c) for c in zip(*pairs))
            if x[0].dtype == U64:
                h, code, shares = x[0], x[1], x[2:]
                order = np.lexsort((code, h))
                flush, doc, h, code, shares = flush[order], doc[order], h[order], code[order], [v[order] for v in shares]
                rows = []
                for p, i, j in cuts(places.of_rare(h)):
                    first = runs(h[i:j])
                    others, one, at = np.unique(code[i:j], return_index=True, return_inverse=True)
                    sources, source = np.unique(flush[i:j], return_inverse=True)
                    rows.append({"place": p, "kind": RARE_PAIRS, "keys": climb(h[i:j][first]), "each": squeeze(np.diff(np.append(first, j - i))), "contexts": squeeze(at), "docs": squeeze(doc[i:j]), "others": climb(others), "n": squeeze(source), "guests": climb(sources), "tables": [v[i:j][one].tobytes() for v in shares]})
            else:
                order = np.lexsort((doc, flush))
                flush, doc = flush[order], doc[order]
                first = runs(flush, doc)
                sums = [np.add.reduceat(v[order], first) for v in x]
                flush, doc = flush[first], doc[first]
                new = runs(flush)
                rows = [{"place": int(flush[i]) % contexts_from, "kind": SUMS, "flush": int(flush[i]), "docs": squeeze(doc[i:j]), "n": squeeze(sums[0][i:j]), "keys": sums[1][i:j].tobytes(), "each": sums[2][i:j].tobytes()} for i, j in zip(new, [*new[1:], len(flush)])]
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], names)

        for b in batches:
            schema = b.schema
            kinds = b.column(1).to_numpy(zero_copy_only=False)
            pass_ = (kinds == HEAD) | (kinds == SUMS)
            heads = b.filter(pa.array(pass_))
            if heads.num_rows:
                yield heads
            out = []
            for i in np.flatnonzero(~pass_):
                r = b.slice(i, 1).select(names[:12]).to_pylist()[0]
                if r["kind"] == MODEL_ROW:
                    row, found = r, known.probabilities(r)
                    continue
                if row is None or row["place"] != r["place"]:
                    none = squeeze(np.empty(0))
                    row = {"place": r["place"], "keys": none, "each": none, "contexts": none, "n": none, "tables": [none] * len(known.by), "others": none, "guests": none, "seats": []}
                    found = known.probabilities(row)
                if r["kind"] == RARE_PAIRS:
                    if pairs and (r["place"] >= contexts_from) != (pairs[0][2].dtype == U64):
                        yield rest()
                        pairs, size = [], 0
                    pairs.append((along if r["place"] >= contexts_from else arrive)(known, r, found))
                    size += len(pairs[-1][0])
                    if size >= FLUSH:
                        yield rest()
                        pairs, size = [], 0
                    continue
                out.append((r["flush"], *settle(known, r, found)))
            if out:
                flush, docs_, n, base, score = zip(*out)
                count = len(out)
                given = {"place": pa.array([f % contexts_from for f in flush], pa.int32()), "kind": pa.array([SUMS] * count, pa.int32()), "flush": pa.array(flush), "docs": pa.array(docs_, pa.binary()), "n": pa.array(n, pa.binary()), "keys": pa.array(base, pa.binary()), "each": pa.array(score, pa.binary())}
                yield pa.RecordBatch.from_arrays([given.get(x, pa.nulls(count, b.schema.field(x).type)) for x in names], names)
        if pairs:
            yield rest()

    def along(known, r, found):
        """Pairs of rarer words at their context's place: flush, document, word, context, and what the context leaves to the parent; all, where it isn't known."""
        *_, others, far = found
        each = expand(r["each"]).astype(np.int64)
        code = scale(r["keys"])
        shares = np.ones((len(known.by), len(code)))
        if len(others):
            at = np.minimum(np.searchsorted(others, code), len(others) - 1)
            here = others[at] == code
            shares[:, here] = far[:, at[here]]
        h = expand(r["contexts"])
        return np.full(len(h), r["flush"], np.int64), expand(r["docs"]).astype(np.int64), h, np.repeat(code, each), *np.repeat(shares, each, axis=1)

    def arrive(known, r, found):
        """Pairs of rarer words at their word's place: flush, document, whether known, base score and score."""
        keys, word, context, p, count, parents, others, _ = found
        key, each = scale(r["keys"]), expand(r["each"]).astype(np.int64)
        at_code = expand(r["contexts"]).astype(np.int64)
        shares = np.array([np.frombuffer(x) for x in r["tables"]])[:, at_code]
        value, c = (shares * known.share[:, None]).mean(axis=0), np.zeros(len(at_code))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at, seen = np.repeat(at, each), np.repeat(keys[at] == key, each)
            c[seen] = count[at[seen]]
            value[seen] = (shares[:, seen] * parents[:, at[seen]]).mean(axis=0)
            if len(others):
                code = scale(r["others"])[at_code]
                k = np.minimum(np.searchsorted(others, code), len(others) - 1)
                width = places.size + len(others)
                mine, pair = word * width + context, at * width + places.size + k
                i = np.minimum(np.searchsorted(mine, pair), len(mine) - 1)
                here = seen & (others[k] == code) & (mine[i] == pair)
                value[here] = p[i[here]]
        flush = scale(r["guests"]).astype(np.int64)[expand(r["n"]).astype(np.int64)]
        return flush, expand(r["docs"]).astype(np.int64), (c > 0).astype(float), np.log10(c + 0.5) - known.log_all, np.log10(np.maximum(value, 1e-300))

    def settle(known, r, found):
        """Documents of a flush's tokens here; known tokens and base score (rare words only), and score of each."""
        keys, word, context, p, count, parents, others, far = found
        key, d = scale(r["keys"]), expand(r["docs"]).astype(np.int64)
        each = expand(r["each"]).astype(np.int64)
        if r["place"] < places.pairs:
            key = key.astype(np.int64)
            value = known.backed(key // places.size, key % places.size)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                here = keys[at] == key
                value[here] = p[at[here]]
            score = np.bincount(d, np.repeat(np.log10(np.maximum(value, 1e-300)), each))
            docs_ = np.flatnonzero(score)
            return squeeze(docs_), None, None, score[docs_].tobytes()
        k = expand(r["contexts"]).astype(np.int64)
        if r["place"] >= contexts_from:  # words of the dictionary after rarer contexts
            shares = np.ones((len(known.by), len(k)))
            if len(others):
                at = np.minimum(np.searchsorted(others, key), len(others) - 1)
                at, seen = np.repeat(at, each), np.repeat(others[at] == key, each)
                shares[:, seen] = far[:, at[seen]]
            value = (shares * known.parents[:, k]).mean(axis=0)
            if len(others) and len(context):
                mine, pair = (context - places.size) * places.size + word, at * places.size + k
                i = np.minimum(np.searchsorted(mine, pair), len(mine) - 1)
                here = seen & (mine[i] == pair)
                value[here] = p[i[here]]
            score = np.bincount(d, np.log10(np.maximum(value, 1e-300)))
            docs_ = np.flatnonzero(score)
            return squeeze(docs_), None, None, score[docs_].tobytes()
        value, c = known.unseen[k], np.zeros(len(k))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at, seen = np.repeat(at, each), np.repeat(keys[at] == key, each)
            c[seen] = count[at[seen]]
            value[seen] = (known.shares[:, k[seen]] * parents[:, at[seen]]).mean(axis=0)
            width = places.size + len(others)
            mine, pair = word * width + context, at * width + k
            i = np.minimum(np.searchsorted(mine, pair), len(mine) - 1)
            here = seen & (mine[i] == pair)
            value[here] = p[i[here]]
        sums = [np.bincount(d, x) for x in ((c > 0).astype(float), np.log10(c + 0.5) - known.log_all, np.log10(np.maximum(value, 1e-300)), np.ones(len(d)))]
        docs_ = np.flatnonzero(sums[3])
        return squeeze(docs_), squeeze(sums[0][docs_]), sums[1][docs_].tobytes(), sums[2][docs_].tobytes()

    def finish(batches):
        """Documents of a flush, head first, with all their sums."""
        head, sums = None, None

        def done():
            ids, held = (head.column(names.index(x)).flatten() for x in ("ids", "held"))
            tokens = head.column(names.index("tokens")).flatten()
            return pa.RecordBatch.from_arrays([ids, held, tokens, *(pa.array(s.astype(np.int64) if i == 0 else s) for i, s in enumerate(sums))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            kinds = b.column(1).to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                if kinds[i] == HEAD:
                    if head is not None:
                        yield done()
                    head, sums = r, [r.column(names.index(x)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in ("known", "base", "score")]
                    continue
                cell = lambda x, r=r: r.column(names.index(x))[0].as_py()
                d = expand(cell("docs")).astype(np.int64)
                if cell("n") is not None:
                    sums[0][d] += expand(cell("n"))
                    sums[1][d] += np.frombuffer(cell("keys"))
                sums[2][d] += np.frombuffer(cell("each"))
        if head is not None:
            yield done()

    if not pooled:  # tokens after rarer contexts meet these first
        sent = ws.table(sent, "sent")
        far = F.col("place") >= contexts_from
        after = model.where(far).unionByName(sent.where(far)).repartition("place").sortWithinPartitions("place", "kind").mapInArrow(meet, f"{SENT}, {head_type}")
        model, sent = model.where(~far), sent.where(~far).unionByName(after)
    met = model.unionByName(sent).repartition("place").sortWithinPartitions("place", "kind").mapInArrow(meet, f"{SENT}, {head_type}")
    out = met.repartition("flush").sortWithinPartitions("flush", "kind").mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), ~training(1, 5), pooled=False)
