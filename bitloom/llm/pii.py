"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

Patterns (email, ip, card, phone) give the base spans, leftmost and not
overlapping within a kind.  The field labels words O or begin/inside of two
more kinds: ``secret`` (access keys, passwords, tokens and the like) and
``contact`` (addresses and numbers in forms that the patterns don't take, such
as "name (at) host (dot) org" or a number after "call").  Its features are
shapes of the word and its neighbours; it is trained here, by maximum
likelihood, on a small labelled table made from templates, and decoded by
Viterbi for a batch of sequences at once.  Spans that touch a base span are
left out, so base spans always stay as they are.

Words without digits or signs ("plain" words) have one shape each, unless they are
16 capital letters or more.  The trained
weights are checked for the property that plain words next to plain words can't
be better labelled than O; so only words within ``REACH`` of another word need
decoding, and the result is that of the whole text.

Edge cases: null text is empty and has no span; repeated rows and null ids are
handled like others; very long texts are read whole, and decoded in stretches
that carry the state on, with the same result (their words' places, 16 bytes
each, must fit a task's memory); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_all, read, small

#: Words (padded) that are decoded in one go.
CELLS = 100_000
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "contact")
LABELS = ("O", "B-secret", "I-secret", "B-contact", "I-contact")
REACH = 4

HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, in code points."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        free = 0  # where the last match ended
        for m in HOST.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                free = m.end()
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            # more than three digits after leading zeros are above 255
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() <= 38 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return out


# The field: features, training, decoding

#: Words that announce personal data (fixed values).
CUES = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "bearer", "credential", "login", "call", "phone", "tel", "mobile", "fax", "mail", "e-mail", "email", "contact", "ssn", "account", "(at)", "[at]", "(dot)", "[dot]")
MARK = re.compile(r"[0-9@=]|\((?:at|dot)\)|\[(?:at|dot)\]|(?-i:[A-Z]{16})", re.IGNORECASE)


def cue(word: str) -> str:
    w = word.lower().strip(".,;:!?\"'")
    return w if w in CUES else ""


def marked(word: str) -> bool:
    return MARK.search(word) is not None


def shape(word: str) -> list[str]:
    """Features of a word by itself.  Plain words have one of few lists."""
    c = cue(word)
    if not marked(word):
        return ["plain"] + [f"cue:{c}"] * bool(c)
    out = ["marked"] + [f"cue:{c}"] * bool(c)
    w = word.strip(".,;:!?\"'()")
    digits, letters = sum(x.isdigit() for x in w), sum(x.isalpha() for x in w)
    out.append("digits:" + ("all" if digits == len(w) else "none" if not digits else "most" if digits > letters else "some"))
    out.append(f"length:{min(len(w), 40) // 4}")
    kinds = re.sub(r"[^A-Za-z0-9]", "", w)
    if digits and letters:
        out.append("mixed:" + ("upper" if kinds.isupper() else "hex" if re.fullmatch("[0-9a-f]+", kinds) else "other"))
        turns = len(re.findall(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", w))
        out.append(f"turns:{min(turns, 6) // 2}")
    if re.fullmatch("[A-Z2-7]{16,}", w):
        out.append("start:" + w[:4])
    if "=" in w:
        name, _, value = w.partition("=")
        out.append(f"assigns:{cue(name) and 'cue'}:{'long' if len(value) >= 8 else 'short'}")
    for sign in "@-()/:.":
        if sign in w:
            out.append(f"has:{sign}")
    out.append("pattern:" + re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", w))))[:10])
    return out


def examples(seed: int = 7, number: int = 600) -> list[tuple[list[str], list[int]]]:
    """The labelled table: invented sentences, each word with its label."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda chars, n: "".join(pick(chars) for _ in range(n))
    lower, digits, hexa, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number_ = lambda *parts: "-".join(some(digits, n) for n in parts)
    name = lambda: some(lower, int(rng.integers(2, 9)))
    plain = lambda: name() + pick(["", "", "", "", ",", "."])
    end = lambda: pick(["", "", "", ".", ","])
    secret = [
        lambda: ["AKIA" + some(upper, 16) + end()],
        lambda: ["AKIA" + some(upper[:26], 16) + end()],
        lambda: [pick(["password", "passwd", "pwd", "secret", "token"]) + "=" + some(hexa if rng.random() < 0.6 else lower + digits, int(rng.integers(10, 30))) + end()],
        lambda: [pick(["token", "secret", "api_key", "key", "password"]), pick(["=", ":"]), '"' + some(hexa, int(rng.integers(20, 42))) + '"' + end()],
        lambda: [pick(["token", "apikey", "bearer"]), some(lower + digits, int(rng.integers(18, 36)))],
    ]
    contact = [
        lambda: [name(), pick(["(at)", "[at]"]), name(), pick(["(dot)", "[dot]"]), pick(["com", "org", "net", "de"]) + end()],
        lambda: [pick(["call", "phone", "tel", "mobile", "fax"]) + pick(["", ":"]), pick([number_(3, 3, 4), number_(3, 4), number_(4, 6)]) + end()],
        lambda: ["ssn" + pick(["", ":"]), number_(3, 2, 4) + end()],
    ]
    harmless = [
        lambda: ["CC", "BY-NC", some("1234", 1) + ".0" + end()],
        lambda: ["Version", some("123", 1) + ".0."],
        lambda: [some(upper[:26], int(rng.integers(16, 24))) + end()],
        lambda: [some(digits, int(rng.integers(1, 7))) + end()],
        lambda: [some(digits, int(rng.integers(12, 20))) + end()],
        lambda: [".".join(some(digits, int(rng.integers(1, 4))) for _ in range(4)) + end()],
        lambda: [name() + "." + some(digits, 2) + "@" + name() + some(digits, 1) + ".example.com" + end()],
        lambda: ["+1", "(" + some(digits, 3) + ")", number_(3, 4) + end()],
        lambda: [pick(["19", "20"]) + some(digits, 2) + end()],
        lambda: [number_(4, 2, 2) + end()],
        lambda: [name() + some(digits, 1) + end()],
        lambda: [some(digits, 2) + ":" + some(digits, 2)],
        lambda: [name(), "=", some(digits, int(rng.integers(1, 4)))],
        lambda: [name() + "=" + some(digits, int(rng.integers(1, 4)))],
        lambda: [pick(CUES[:22]), name()],
        lambda: [some(lower, 1) + some(digits, 1) + pick(["", some(lower, 2)])],
    ]
    out = []
    for _ in range(number):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 7))):
                words.append(plain())
                labels.append(0)
            r = rng.random()
            part = pick(secret)() if r < 0.3 else pick(contact)() if r < 0.55 else pick(harmless)()
            kind = 1 if r < 0.3 else 3 if r < 0.55 else 0
            # the cue stays outside: what follows it is personal
            skip = next((i for i, w in enumerate(part) if kind and not cue(w) and w not in "=:"), 0)
            if kind == 3 and part[1:2] and part[1] in ("(at)", "[at]"):
                skip = 0
            words += part
            labels += [0] * skip + ([kind] + [kind + 1] * (len(part) - skip - 1) if kind else [0] * len(part))
        out.append((words, labels))
    return out


class Field:
    """Weights by feature for the word itself, the word before and the word after; transitions."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.cache: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def vectors(self, word: str):
        """Contributions of a word to the label scores of itself, of the next word and of the word before."""
        key = word if marked(word) else cue(word)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            zero = np.zeros(len(LABELS))
            f = shape(word)
            self.cache[key] = tuple(sum((self.weights.get(at + x, zero) for x in f), zero) for at in ("own ", "before ", "after "))
        return self.cache[key]

    def scores(self, words: list[str]) -> np.ndarray:
        v = [self.vectors(w) for w in words]
        out = np.array([x[0] for x in v])
        if len(v) > 1:
            out[1:] += [x[1] for x in v[:-1]]
            out[:-1] += [x[2] for x in v[1:]]
        return out

    def plain_is_outside(self) -> bool:
        """Whether a plain word among plain words is best labelled O whatever its labelled neighbours."""
        zero = np.zeros(len(LABELS))
        plain = [["plain"], *(["plain", f"cue:{c}"] for c in CUES if not marked(c))]
        gain = sum(np.max([sum((self.weights.get(at + x, zero) for x in f), zero) - sum((self.weights.get(at + x, zero)[0] for x in f), 0.0) for f in plain], axis=0) for at in ("own ", "before ", "after "))
        enter = self.moves - self.moves[0, 0]
        return bool((gain[1:] + np.maximum(enter[0, 1:], enter[1:, 1:].max(axis=0)) + np.maximum(0, (self.moves[1:, 0] - self.moves[0, 0]).max()) < 0).all())

    def decode(self, sequences: list) -> list[np.ndarray]:
        """Viterbi; the state before and after each sequence is O.

        Sequences of like length go in step, so many that they hold ``CELLS`` words at most when padded; one longer than
        that goes by itself, in stretches that carry the state on.
        """
        out: list = [None] * len(sequences)
        group: list[int] = []

        def decode_group():
            for i, y in zip(group, self._in_step([sequences[i][:] for i in group]) if len(group) > 1 or len(sequences[group[0]]) <= CELLS else [self._alone(sequences[group[0]])]):
                out[i] = y
            group.clear()

        for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
            if group and (len(group) + 1) * len(sequences[i]) > CELLS:
                decode_group()
            group.append(i)
        if group:
            decode_group()
        return out

    def _alone(self, words) -> np.ndarray:
        n = len(words)
        back, state = np.zeros((n, len(LABELS)), np.int8), None
        for a in range(0, n, CELLS):
            b, first = min(n, a + CELLS), max(0, a - 1)
            scores = self.scores(words[first : min(n, b + 1)])[a - first : b - first]
            for t in range(a, b):
                if state is None:
                    state = scores[0] + self.moves[0]
                    continue
                path = state[:, None] + self.moves
                back[t] = path.argmax(axis=0)
                state = path.max(axis=0) + scores[t - a]
        y, label = np.zeros(n, np.int8), int((state + self.moves[:, 0]).argmax())
        for t in range(n - 1, -1, -1):
            y[t] = label
            label = back[t, label]
        return y

    def _in_step(self, sequences: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        scores = np.zeros((len(sequences), lengths.max(), len(LABELS)))
        for k, i in enumerate(order):
            scores[k, : lengths[i]] = self.scores(sequences[i])
        sizes = lengths[order]
        back = np.zeros(scores.shape, np.int8)
        state = scores[:, 0] + self.moves[0]
        last = state.copy()
        for t in range(1, scores.shape[1]):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
            path = state[:live, :, None] + self.moves
            back[:live, t] = path.argmax(axis=1)
            state = path.max(axis=1) + scores[:live, t]
            last[:live] = state
        label = (last + self.moves[:, 0]).argmax(axis=1)
        out: list = [None] * len(sequences)
        for k, i in enumerate(order):
            y, n = np.zeros(sizes[k], np.int8), label[k]
            for t in range(sizes[k] - 1, -1, -1):
                y[t] = n
                n = back[k, t, n]
            out[i] = y
        return out


def train(table: list[tuple[list[str], list[int]]], rounds: int = 110, ridge: float = 0.02, rate: float = 0.25) -> Field:
    """Maximum likelihood by gradient ascent (Adam); forward-backward in batches padded to one length."""
    names: dict[str, int] = {}
    rows = []
    for words, _ in table:
        f = [shape(w) for w in words]
        rows.append([[names.setdefault(at + x, len(names)) for at, j in (("own ", t), ("before ", t - 1), ("after ", t + 1)) if 0 <= j < len(f) for x in f[j]] for t in range(len(f))])
    n, longest, k = len(table), max(len(r) for r in rows), len(LABELS)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    for i, (words, labels) in enumerate(table):
        mask[i, : len(words)] = True
        gold[i, : len(words)] = labels
    flat = [(i * longest + t, x) for i, r in enumerate(rows) for t, f in enumerate(r) for x in f]
    cell, feature = np.array(flat).T
    # sums by word and by feature, as sums of stretches of sorted rows
    words_at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    by_feature = np.argsort(feature, kind="stable")
    features_at = np.flatnonzero(np.append(True, np.diff(feature[by_feature]) != 0))
    w, moves = np.zeros((len(names), k)), np.zeros((k, k))
    banned = np.zeros((k, k), bool)
    for b in (2, 4):
        banned[[a for a in range(k) if a not in (b - 1, b)], b] = True
    onehot = np.eye(k)[gold] * mask[:, :, None]
    gold_moves = np.zeros((k, k))
    for i in range(n):
        y = [0, *gold[i][mask[i]], 0]
        np.add.at(gold_moves, (y[:-1], y[1:]), 1)
    size = mask.sum(axis=1)
    m, v = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    soft = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for step in range(1, rounds + 1):
        s = np.zeros((n * longest, k))
        s[cell[words_at]] = np.add.reduceat(w[feature], words_at)
        s = s.reshape(n, longest, k)
        tr = np.where(banned, -30.0, moves)
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = s[:, 0] + tr[0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], soft(fwd[:, t - 1, :, None] + tr, 1) + s[:, t], fwd[:, t - 1])
        z = soft(fwd[:, -1] + tr[:, 0], 1)
        bwd[np.arange(n), size - 1] = tr[:, 0]
        for t in range(longest - 2, -1, -1):
            inside = mask[:, t + 1, None]
            bwd[:, t] = np.where(inside, soft(tr + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), bwd[:, t])
        p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + tr + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = pair.sum(axis=(0, 1))
        seen[0] += p[:, 0].sum(axis=0)
        seen[:, 0] += p[np.arange(n), size - 1].sum(axis=0)
        gw = np.add.reduceat((onehot - p).reshape(-1, k)[cell[by_feature]], features_at)
        for x, g, i in ((w, gw - ridge * w, 0), (moves, np.where(banned, 0, gold_moves - seen) - ridge * moves, 1)):
            g = g / n
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += rate * (1 - step / (rounds + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return Field({name: w[i] for name, i in names.items()}, np.where(banned, -30.0, moves))


@functools.cache
def field() -> Field:
    f = train(examples())
    if not f.plain_is_outside():
        raise AssertionError("plain words must be outside on their own")
    return f


WORDS = re.compile(r"[^ \t-\r]+")


class Words:
    """Words of a stretch of a text, made when asked for; iteration gives their places."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self):
        return zip(self.starts.tolist(), self.ends.tolist())

    def __getitem__(self, part: slice) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts[part].tolist(), self.ends[part].tolist())]


def near_marks(text: str) -> list[Words]:
    """Sequences of words around words with digits or signs."""
    if not MARK.search(text):
        return []
    place = np.fromiter((x for m in WORDS.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    starts, ends = place[:, 0].copy(), place[:, 1].copy()
    signs = np.flatnonzero(np.fromiter((marked(text[a:b]) for a, b in place), bool, len(place)))
    if not len(signs):
        return []
    low, high = np.maximum(signs - REACH, 0), np.minimum(signs + REACH + 1, len(starts))
    begins = np.flatnonzero(np.append(True, low[1:] > high[:-1]))  # stretches that meet are one sequence
    return [Words(text, starts[a:b], ends[a:b]) for a, b in zip(low[begins], high[np.append(begins[1:] - 1, len(high) - 1)])]


def covered(spans: list[tuple[int, int, str]]):
    """A function (start, end) -> whether any of the spans overlaps that."""
    sorted_ = sorted(spans)
    starts, ends = [a for a, _, _ in sorted_], list(accumulate((b for _, b, _ in sorted_), max))

    def touches(a: int, b: int) -> bool:
        n = bisect_left(starts, b)
        return n > 0 and ends[n - 1] > a

    return touches


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], model: Field) -> list[list[tuple[int, int, str]]]:
    """The field's spans for each text, without those that touch a base span."""
    where = [(d, s) for d, t in enumerate(texts) for s in near_marks(t)]
    touches = {d: covered(base[d]) for d, _ in where}
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (d, words), labels in zip(where, model.decode([s for _, s in where])):
        for i in np.flatnonzero((labels == 1) | (labels == 3)).tolist():
            j = i + 1
            while j < len(words) and labels[j] == labels[i] + 1:
                j += 1
            a, b = int(words.starts[i]), int(words.ends[j - 1])
            while b > a and texts[d][b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and texts[d][a] in "\"'":
                a += 1
            if a < b and not touches[d](a, b):
                found[d].append((a, b, LABELS[labels[i]][2:]))
    return found


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, the first and longest."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Field | None = None, text: str = "text", names: tuple[str, str, str] = ("base_spans", "spans", "redacted")) -> DataFrame:
    """All columns of ``docs`` with base and all spans, arrays of (start, end, kind), and redacted text, under names that ``docs`` doesn't have."""
    shared = docs.sparkSession.sparkContext.broadcast(model or field())
    at = docs.columns.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for b in small(batches, at):
            texts = [t or "" for t in b.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [ordered(x + y) for x, y in zip(base, added_spans(texts, base, shared.value))]
            structs = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in row] for row in rows], span) for rows in ([ordered(x) for x in base], every)]
            clean = pa.array([redact(t, s) for t, s in zip(texts, every)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *structs, clean], [*b.schema.names, "x0", "x1", "x2"])

    kind = "array<struct<start: int, end: int, kind: string>>"
    return map_all(docs, run, dict(zip(names, (kind, kind, "string"))))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(field())
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:])]

    def run(batches):
        for b in small(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [x + y for x, y in zip(base, added_spans(texts, base, shared.value))]
            counts = [pa.array([sum(s[2] == k for s in row) for row in rows], pa.int64()) for rows, kinds in ((base, BASE), (every, KINDS[4:])) for k in kinds]
            digest = pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base])
            yield pa.RecordBatch.from_arrays([b.column(0), *counts[:4], digest, pa.array([joined(row) for row in every]), *counts[4:]], names)

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:]))
