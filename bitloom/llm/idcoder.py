"""Context-mixing range coder for blocks of token ids, many blocks in step.

Three models predict the next id, all reset at the start of a block:

* order 0 counts the ids that came and that no other model named; an id that it hasn't counted is one of the vocabulary;
* order 1 and order 2 name an id that came after the id, or the two ids, before (hashed to slots), with a confidence of 0, 1 or more.

They are mixed in whole numbers.  The number line of a step, 2**BITS long, holds one after the other the id that order 2 names,
the one that order 1 names, the ids that order 0 has counted, each as long as its count, and all ids of the vocabulary, equally
long.  The share of each of these four kinds is how often it held the id among all steps of the block with the same
confidences and agreement.  Counts of order 0 and shares are brought up to date at the places EDGES of a block, from all ids
before; what is named, and how surely, after every id.  Shares drive a range coder whose state of 64 bits takes and gives words
of 32 (rANS: it encodes from the last id to the first, and decodes forwards).  Nothing is floating point, so all machines decode
alike.

numpy steps through up to ``LANES`` blocks at once, one id of each at a time; a block's bytes don't depend on its
neighbours.  What order 0 holds is a list of a block's ids so far, sorted, in which a value of the line is a place: so nothing is
searched, and memory is below 200 KB a lane, whatever the vocabulary.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Blocks that are coded in step, and ids in a block.
LANES, BLOCK = 2048, 4096
EDGES = (64, 256, 768, 1792)
SLOT_BITS, KEYS = 8, 32
SLOTS = 1 << SLOT_BITS
#: The number line, and the least of it that is left to ids of the vocabulary.
BITS = 31
LINE, LEAST = 1 << BITS, 1 << 23
#: Bits of a place in a block, and of an id.
PLACE, ID = 12, 18
#: Above all ids with their places.
NONE = np.uint32(1 << PLACE + ID)
#: Lanes whose ids are sorted at once, and that get their intervals at once; steps that are taken with one table of slots (what fits a core's cache).
SORTED, FITTED, WINDOW = 64, 16, 8
#: What is taken to have been seen of a key: the id named by order 2, by order 1, counted by order 0, none of these.
PRIOR = (1, 1, 1, 1)
NAMED2, NAMED1, COUNTED, NEW, NOTHING = range(5)
#: magic, version, documents, ids, words, vocabulary, crc32 of the ids, crc32 of the rest of the record.
HEAD = struct.Struct("<4s7I")
MAGIC, VERSION = b"idmx", 3
#: Numbers as arrays, which numpy takes faster than single ones.
U64_1 = np.ones(1, np.uint64)
U1, U2, U3, SLOT = (np.array(x, np.uint32) for x in (1, 2, 3, 32 - SLOT_BITS))
START, WORD, AHEAD, ROOM, WITHIN, FIELD, ID_AT, FIRST_AT = (np.array(x, np.uint64) for x in (1 << 32, 32, BITS, 64 - BITS, LINE - 1, (1 << 20) - 1, 40, 20))
MIX1, MIX2, MIX3 = (np.array(x, np.uint32) for x in (2654435761, 2246822519, 3266489917))


class Damaged(ValueError):
    """A block that isn't what was written."""


class Names:
    """Orders 1 and 2 of all lanes, which go up to date with each id."""

    def __init__(self, lanes: int):
        self.named = np.empty(2 * lanes * SLOTS, np.uint32)  # id * 4 + confidence
        self.base = np.arange(2 * lanes).reshape(2, lanes) * SLOTS

    def reset(self) -> None:
        self.named[:] = 0
        lanes = self.base.shape[1]
        self.slot, self.mixed, self.hashed = self.base.copy(), np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32)

    def begin(self, k: int) -> np.ndarray:
        """For the first k lanes: the key of their shares; ``held`` has names and confidences of both orders."""
        self.at = self.slot[:, :k]
        self.held = self.named.take(self.at, mode="clip")
        return keys(self.held[0], self.held[1])

    def learn(self, ids: np.ndarray) -> None:
        """Goes on by one id of each lane."""
        k = len(ids)
        self.update(self.at, self.held, ids << U2 | U1)
        mixed = self.mixed[:, :k]
        np.multiply(ids, MIX1, out=mixed[0])
        np.multiply(mixed[0] + self.hashed[:k], MIX2, out=mixed[1])
        np.add(self.base[:, :k], mixed >> SLOT, out=self.slot[:, :k])
        np.multiply(ids, MIX3, out=self.hashed[:k])

    def update(self, at: np.ndarray, held: np.ndarray, came: np.ndarray) -> None:
        """A name that is right gets sure; a sure one that is wrong gets less so, another one gives way."""
        self.named[at] = np.where((held ^ came) <= U3, held | U2, np.where(held & U2, held ^ U2, came))

    def follow(self, padded: np.ndarray, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Keys and kinds (what no model named counts as COUNTED) of all ids, which stand below two rows of 0."""
        most, lanes = len(live), padded.shape[1]
        key, kind = np.empty((most, lanes), np.uint8), np.empty((most, lanes), np.uint8)
        held = np.zeros((WINDOW, 2, lanes), np.uint32)
        for t in range(0, most, WINDOW):
            n = min(WINDOW, most - t)
            came = padded[t + 2 : t + 2 + n] << U2 | U1
            mixed = np.empty((n, 2, lanes), np.uint32)
            np.multiply(padded[t + 1 : t + 1 + n], MIX1, out=mixed[:, 0])
            np.multiply(mixed[:, 0] + padded[t : t + n] * MIX3, MIX2, out=mixed[:, 1])
            mixed >>= SLOT
            slot = self.base[:, :lanes] + mixed
            for j in range(n):
                k = live[t + j]
                at = slot[j, :, :k]
                held[j, :, :k] = now = self.named.take(at, mode="clip")
                self.update(at, now, came[j, :k])
            one, two = held[:n, 0], held[:n, 1]
            key[t : t + n] = keys(one, two)
            two = (two ^ came <= U3) & (two & U3 > 0)
            one = (one ^ came <= U3) & (one & U3 > 0)
            kind[t : t + n] = np.where(two, np.uint8(NAMED2), np.where(one, np.uint8(NAMED1), np.uint8(COUNTED)))
        return key, kind


def keys(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Confidences of what orders 1 and 2 hold, and whether they name the same."""
    return (one ^ two <= U3).view(np.uint8) << 4 | ((two & U3) << U2 | one & U3).astype(np.uint8)


class Shares:
    """The mixture of the first lanes, from all ids before a place of the block."""

    def __init__(self, vocabulary: int, seen: np.ndarray):
        """seen: (lane, key, kind) how often."""
        key = np.arange(KEYS)
        one, two, agree = key & 3, key >> 2 & 3, key >> 4
        counted = seen[:, :, COUNTED:].sum(axis=(1, 2))[:, None]
        can = np.broadcast_to(np.stack([two > 0, (one > 0) & ~((agree > 0) & (two > 0)), key >= 0, key >= 0], axis=1), seen.shape).copy()
        can[:, :, COUNTED] = counted > 0
        seen = (seen + np.array(PRIOR)) * can
        a = (LINE - LEAST) * seen[:, :, :NEW] // seen.sum(axis=2)[:, :, None]
        low = np.zeros(seen.shape, np.uint32)
        low[:, :, 1:] = np.cumsum(a, axis=2)
        unit = np.empty(seen.shape, np.uint32)
        unit[:, :, :COUNTED] = np.maximum(a[:, :, :COUNTED], 1)
        unit[:, :, COUNTED] = np.maximum(a[:, :, COUNTED] // np.maximum(counted, 1), 1)
        unit[:, :, NEW] = (LINE - low[:, :, NEW].astype(np.int64)) // vocabulary
        self.low, self.unit = low.reshape(-1), unit.reshape(-1)  # where a kind begins, and how long one of it is
        self.edges = [low[:, :, i].reshape(-1).copy() for i in (NAMED1, COUNTED, NEW)]


class Counts:
    """Order 0 of some lanes: their ids that no model named, sorted, with places."""

    def __init__(self, ids: np.ndarray, kind: np.ndarray):
        self.most, self.lanes = ids.shape
        x = np.where((kind == COUNTED) | (kind == NEW), ids << np.uint32(PLACE) | np.arange(self.most, dtype=np.uint32)[:, None], NONE).T.copy()
        x.sort(axis=1)
        self.sorted = x

    def held(self) -> np.ndarray:
        """For each place of the sorted ids: id, where it begins and how often it is there, packed."""
        ids = self.sorted >> np.uint32(PLACE)
        new = np.ones(ids.shape, bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        first = np.flatnonzero(new)
        times = np.diff(first, append=new.size)
        return np.repeat(ids.reshape(-1)[first].astype(np.int64) << 40 | first % self.most << 20 | times, times).view(np.uint64)

    def told(self, stretches: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all ids: start and times among those counted before their stretch; and which of them weren't counted: their start is the id."""
        real = self.sorted < NONE
        x = self.sorted[real]
        place, ids = x & np.uint32((1 << PLACE) - 1), x >> np.uint32(PLACE)
        number = real.sum(axis=1)
        row = np.repeat(np.arange(self.lanes), number)
        stretch = np.repeat(np.arange(len(stretches), dtype=np.uint8), [to - t for t, to in stretches]).take(place)
        new = np.ones(len(x), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
        run = np.flatnonzero(new)
        part = new.copy()  # of a run: what lies in one stretch
        part[1:] |= stretch[1:] != stretch[:-1]
        part = np.flatnonzero(part)
        first = run.take(np.cumsum(new).take(part) - 1)
        n, long, low, of = part - first, np.diff(part, append=len(x)), ids.take(part), stretch.take(part)
        ahead = (np.cumsum(number) - number).take(row.take(part))  # where the lane begins
        for s, (t, _) in enumerate(stretches):
            i = np.flatnonzero((of == s) & (n > 0))
            if len(i):
                count = np.zeros(len(x) + 1, np.int32)
                np.cumsum(place < t, out=count[1:])
                low[i] = count.take(first[i]) - count.take(ahead[i])
        at = place.astype(np.int64) * self.lanes + row
        start, times, never = np.zeros(self.sorted.size, np.uint32), np.ones(self.sorted.size, np.uint32), np.zeros(self.sorted.size, bool)
        start[at], times[at], never[at] = np.repeat(low, long), np.repeat(np.maximum(n, 1), long), np.repeat(n == 0, long)
        return tuple(x.reshape(self.most, self.lanes) for x in (start, times, never))


class Coder:
    """Encodes and decodes blocks of at most ``block`` ids below ``vocabulary``."""

    def __init__(self, vocabulary: int, block: int = BLOCK, lanes: int = LANES):
        if not 0 < vocabulary <= 1 << ID or block > 1 << PLACE or lanes > 1 << 16:
            raise ValueError("block, lanes or vocabulary too large")
        self.vocabulary, self.block, self.lanes = vocabulary, block, lanes
        self.names: Names | None = None

    def _start(self, sizes: np.ndarray) -> Names:
        if self.names is None or self.names.base.shape[1] < len(sizes):
            self.names = Names(min(self.lanes, max(16, 1 << int(len(sizes) - 1).bit_length())))
        self.names.reset()
        return self.names

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Range-coded words of each block."""
        return [x for i in range(0, len(blocks), self.lanes) for x in self._encode(blocks[i : i + self.lanes])]

    def decode(self, coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
        """The ids that ``encode`` got, given their numbers."""
        return [x for i in range(0, len(coded), self.lanes) for x in self._decode(coded[i : i + self.lanes], sizes[i : i + self.lanes])]

    def _encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        most, lanes = int(sizes.max(initial=0)), len(blocks)
        if most > self.block:
            raise ValueError("a block is too long")
        if any(len(b) and not 0 <= b.min() <= b.max() < self.vocabulary for b in blocks):
            raise ValueError("an id is outside the vocabulary")
        padded = np.zeros((most + 2, lanes), np.uint32)
        ids = padded[2:]
        for lane, i in enumerate(order):
            ids[: sizes[i], lane] = blocks[i]
        live = np.searchsorted(-sizes[order], -np.arange(most), side="left").tolist()  # lanes with an id at each step
        key, kind = self._start(sizes).follow(padded, live)
        kind[np.arange(most)[:, None] >= sizes[order]] = NOTHING
        start, length = np.empty((most, lanes), np.uint32), np.empty((most, lanes), np.uint32)
        for i in range(0, lanes, FITTED):
            some = np.s_[:, i : i + FITTED]
            start[some], length[some] = self._intervals(ids[some].copy(), key[some].copy(), kind[some].copy())
        del key, kind
        state, given = np.full(lanes, START), [(np.empty(0, np.uint16), np.empty(0, np.uint32))]  # lanes and their words
        for t in range(most - 1, -1, -1):
            k = live[t]
            x, size = state[:k], length[t, :k].astype(np.uint64)
            full = np.flatnonzero(x >= size << ROOM)
            if len(full):
                y = x[full]
                given.append((full.astype(np.uint16), y.astype(np.uint32)))
                x[full] = y >> WORD
            times = x // size
            size *= times
            x -= size
            x += times << AHEAD
            x += start[t, :k]
        lane, words = (np.concatenate(x) for x in zip(*reversed(given)))
        words = words[np.argsort(lane, kind="stable")].astype("<u4")
        ends = np.cumsum(np.bincount(lane, minlength=lanes))
        coded: list = [b""] * lanes
        for lane, i in enumerate(order):
            coded[i] = int(state[lane]).to_bytes(8, "little") + words[ends[lane - 1] if lane else 0 : ends[lane]].tobytes()
        return coded

    def _intervals(self, ids: np.ndarray, key: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths on the number line of all ids of some lanes."""
        stretches = self._stretches(len(ids))
        start, length, new = Counts(ids, kind).told(stretches)
        kind[new] = NEW
        seen = np.zeros((ids.shape[1], KEYS, 4), np.int64)
        rows = np.arange(0, len(seen) * KEYS, KEYS)
        for t, to in stretches:
            shares = Shares(self.vocabulary, seen)
            row = rows + key[t:to]
            at = (row << 2) + np.minimum(kind[t:to], NEW)
            unit = shares.unit.take(at)
            length[t:to] *= unit
            start[t:to] *= unit
            start[t:to] += shares.low.take(at)
            self._count(seen, row, kind[t:to])
        return start, length

    def _decode(self, coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
        sizes = np.array(sizes, dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        most, lanes = int(sizes.max(initial=0)), len(coded)
        if any(len(c) < 8 or len(c) % 4 for c in coded):
            raise Damaged("a block is too short")
        given = [coded[i] for i in order]
        state = np.array([int.from_bytes(c[:8], "little") for c in given], np.uint64)
        words = np.frombuffer(b"".join(c[8:] for c in given), "<u4").astype(np.uint32)
        ends = np.cumsum([len(c) // 4 - 2 for c in given])
        at = np.append(0, ends[:-1])
        words = np.append(words, np.uint32(0))
        live = np.searchsorted(-sizes[order], -np.arange(most), side="left").tolist()
        names = self._start(sizes)
        ids = np.zeros((most, lanes), np.uint32)
        key, kind = np.zeros((most, lanes), np.uint8), np.full((most, lanes), NOTHING, np.uint8)
        seen, rows = np.zeros((lanes, KEYS, 4), np.int64), np.arange(0, lanes * KEYS, KEYS)
        for first, to in self._stretches(most):
            shares = Shares(self.vocabulary, seen)
            one, zero, new = shares.edges
            held = [Counts(ids[:first, i : i + SORTED].copy(), kind[:first, i : i + SORTED].copy()).held() for i in range(0, lanes, SORTED)] if first else []
            held, lane = np.concatenate([*held, U64_1]), np.arange(lanes) * first  # at the end, what stands for an id that isn't counted
            other = np.array(len(held) - 1)
            for t in range(first, to):
                k = live[t]
                key[t, :k] = now = names.begin(k)
                row = rows[:k] + now
                x = state[:k]
                value = (x & WITHIN).astype(np.uint32)
                counted = value >= zero.take(row, mode="clip")
                fresh = value >= new.take(row, mode="clip")
                kind[t, :k] = what = (value >= one.take(row, mode="clip")).view(np.uint8) + counted.view(np.uint8) + fresh.view(np.uint8)
                row <<= 2
                row += what
                unit = shares.unit.take(row, mode="clip")
                value -= shares.low.take(row, mode="clip")
                start = value // unit
                counted ^= fresh
                entry = held.take(np.where(counted, lane[:k] + start, other), mode="clip")
                start *= fresh
                came = np.where(what < COUNTED, np.where(what, names.held[0], names.held[1]) >> U2, (entry >> ID_AT).astype(np.uint32) + start)
                start += (entry >> FIRST_AT & FIELD).astype(np.uint32)
                value -= start * unit
                unit *= (entry & FIELD).astype(np.uint32)
                x = (x >> AHEAD) * unit
                x += value
                need = np.flatnonzero(x < START)
                if len(need):
                    i = at[need]
                    x[need] = x[need] << WORD | words.take(i, mode="clip")
                    at[need] = i + 1
                state[:k] = x
                ids[t, :k] = came
                names.learn(came)
            for i in range(0, lanes, SORTED):
                some = np.s_[first:to, i : i + SORTED]
                self._count(seen[i : i + SORTED], rows[: len(seen[i : i + SORTED])] + key[some], kind[some])
        if (at != ends).any() or (state != START).any():
            raise Damaged("a block's end isn't where its ids end")
        out: list = [None] * lanes
        for lane, i in enumerate(order):
            out[i] = ids[: sizes[i], lane].astype("<u4")
        return out

    @staticmethod
    def _stretches(most: int) -> list[tuple[int, int]]:
        """From each edge to the next."""
        edges = [0, *(e for e in EDGES if e < most), most]
        return [(i, j) for i, j in zip(edges, edges[1:]) if i < j]

    @staticmethod
    def _count(seen: np.ndarray, row: np.ndarray, kind: np.ndarray) -> None:
        """Adds what a stretch holds; past a block's end is nothing."""
        lanes, keys, _ = seen.shape
        seen += np.bincount((row << 3 | kind).reshape(-1), minlength=8 * lanes * keys).reshape(lanes, keys, 8)[:, :, :4]


def crc_of(ids: np.ndarray, before: int = 0) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"), before)


def record(ids: np.ndarray, coded: bytes, documents: list[tuple[int | None, int]], vocabulary: int) -> bytes:
    """One block as it is stored: head, ids and ends of the documents that end in it, coded ids."""
    names = np.array([0 if d is None else d for d, _ in documents], "<i8").tobytes()
    ends = np.array([e for _, e in documents], "<u4").tobytes()
    nulls = np.array([d is None for d, _ in documents], "u1").tobytes()
    rest = names + ends + nulls + coded
    fields = (MAGIC, VERSION, len(documents), len(ids), len(coded) // 2, vocabulary, crc_of(ids))
    return HEAD.pack(*fields, zlib.crc32(rest, zlib.crc32(HEAD.pack(*fields, 0)))) + rest


def parse(blob: bytes) -> tuple[int, int, int, list[tuple[int | None, int]], bytes]:
    """Vocabulary, number of ids, their crc, documents and coded ids of a stored block; raises ``Damaged``."""
    if len(blob) < HEAD.size:
        raise Damaged("a block is too short")
    magic, version, n_documents, n, words, vocabulary, crc, check = HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise Damaged("not a block of this format")
    rest = blob[HEAD.size :]
    if len(rest) != 13 * n_documents + 2 * words or zlib.crc32(rest, zlib.crc32(HEAD.pack(magic, version, n_documents, n, words, vocabulary, crc, 0))) != check:
        raise Damaged("checksum of a block")
    names = np.frombuffer(rest, "<i8", n_documents).tolist()
    ends = np.frombuffer(rest, "<u4", n_documents, 8 * n_documents).tolist()
    nulls = np.frombuffer(rest, "u1", n_documents, 12 * n_documents).tolist()
    return vocabulary, n, crc, [(None if z else d, e) for d, e, z in zip(names, ends, nulls)], rest[13 * n_documents :]
