"""Language identification by mixture inference.

A document is a mixture of languages: its words come from language l with
proportion p[l], and a word's likelihood under l is the product of its byte
trigrams' (hashed to ``2**bits`` cells, smoothed).  Expectation-maximisation
estimates the proportions.  Which languages are in the mixture is chosen by
penalised likelihood: the likeliest one, two or more languages, up to all, each further one
at a price of ``price`` * log(words) / 2.  The prediction is the language
with the largest proportion; the score is that proportion, estimated with the
chosen languages and shrunk by the evidence (words) there is.

Trigram counts are learned from at most about ``sample`` labelled rows, taken
evenly by a hash of the row.  Each language may have an equal part of them, and
what rarer ones don't need goes to the others, so that a rare language is
learned from all its rows.  Only text is an input of a prediction.

Edge cases: null text or text without a letter (Unicode category L) gives ``und`` with score 0; with
no labelled row at all every prediction is ``und``; rows without a label are
predicted like others; repeated rows and null ids are rows like others; very
long texts are processed whole, in pieces; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_all, read, small, training

UNKNOWN = "und"


WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters (Unicode category L): numbers that ``re`` takes for parts of words are cut out."""
    words = WORD.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [w for x in words for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def cells(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of all words, each set off by a space before and after; and where each word's begin."""
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    width = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(width + 2)])[:-1]
    code = flat[:-2] << np.uint32(16) | flat[1:-1] << np.uint32(8) | flat[2:]
    inside = np.ones(len(code) + 2, bool)
    ends = np.cumsum(width + 2)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that reach over a word's end
    keep = np.flatnonzero(inside[: len(code)])
    cell = (code[keep] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return cell.astype(np.int64), np.searchsorted(keep, start)


def quota(sizes: list[int], total: int) -> float:
    """The number that each may take so that together they take ``total``, or all there is."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        each = left / (len(sizes) - i)
        if n > each:
            return each
        left -= n
    return max(sizes, default=0)


def learn(docs: DataFrame, is_training, sample: int, bits: int) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each trigram cell in each."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_training)
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    most = quota(list(size.values()), sample)
    shares = [(lang, int(min(1.0, most / n) * (1 << 30))) for lang, n in size.items()]
    shares = spark.createDataFrame(shares, "__lang string, __share long")
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("__share"))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in small(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w.encode() for w in letters(text.lower())]
                if words:
                    n = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                    n += np.bincount(cells(words, bits)[0], minlength=1 << bits)
        for lang, n in counts.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array(i), pa.array(n[i])], ["lang", "cell", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    t = found.toArrow()  # at most 2**bits cells for each language
    langs = sorted(set(t["lang"].to_pylist()))
    n = np.zeros((1 << bits, len(langs)))
    n[t["cell"].to_numpy(), [langs.index(x) for x in t["lang"].to_pylist()]] = t["n"].to_numpy()
    return langs, np.log((n + 0.2) / (n.sum(axis=0) + 0.2 * (1 << bits))).astype(np.float32) if langs else n


class Words:
    """Log-likelihood vectors of words; a bounded cache."""

    LIMIT = 400_000

    def __init__(self, logp: np.ndarray, bits: int):
        self.logp, self.bits, self.at = logp, bits, {}
        self.value = np.zeros((1024, logp.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.LIMIT:
            self.at = {}
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if new:
            n = len(self.at)
            if n + len(new) > len(self.value):
                self.value = np.concatenate([self.value[:n], np.zeros((n + 2 * len(new), self.value.shape[1]), np.float32)])
            cell, start = cells([w.encode() for w in new], self.bits)
            self.value[n : n + len(new)] = np.add.reduceat(self.logp[cell], start, axis=0)
            self.at.update(zip(new, range(n, n + len(new))))
        return self.value[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def em(likelihood: np.ndarray, start: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; ``likelihood`` is relative to each word's best language."""
    n = np.diff(np.append(start, len(likelihood)))
    p = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = likelihood * np.repeat(p, n, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        p = np.add.reduceat(r, start, axis=0) / n[:, None]
    total = np.einsum("ij,ij->i", likelihood, np.repeat(p, n, axis=0))
    return p, np.add.reduceat(np.log(np.maximum(total, 1e-300)), start)


def infer(log: np.ndarray, start: np.ndarray, price: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(best language, score) of documents whose words' log-likelihoods are consecutive rows of ``log``."""
    n = np.diff(np.append(start, len(log)))
    rel = np.maximum(np.exp((log - log.max(axis=1, keepdims=True)).astype(np.float64)), 1e-12)
    langs = log.shape[1]
    full, value = em(rel, start, np.ones((len(start), langs)), rounds)
    # no mixture of any languages is likelier than this (Jensen), so larger sets are tried only where they can win
    gain = np.add.reduceat(rel / np.einsum("ij,ij->i", rel, np.repeat(full, n, axis=0))[:, None], start, axis=0) / n[:, None]
    bound = value + n * np.log(gain.max(axis=1)) + 1e-6
    alone = np.add.reduceat(np.log(rel), start, axis=0)
    best_set = np.zeros((len(start), langs))
    best_set[np.arange(len(start)), alone.argmax(axis=1)] = 1.0
    best_p, best = best_set, alone.max(axis=1).astype(np.float64)
    rank = np.argsort(np.argsort(-full, axis=1), axis=1)
    for k in range(2, langs + 1):
        cost = (k - 1) * price * np.log(n + 1) / 2
        d = np.flatnonzero(bound - cost > best)
        if not len(d):
            break
        inside = np.repeat(bound - cost > best, n)
        p, value = em(rel[inside], np.cumsum(n[d]) - n[d], (rank[d] < k).astype(float), rounds)
        value = value - cost[d]
        better = value > best[d]
        best[d[better]], best_p[d[better]] = value[better], p[better]
    top = best_p.argmax(axis=1)
    # one word is weak evidence: the estimate from all languages weighs in like two words
    both = (best_p[np.arange(len(top)), top] * n + full[np.arange(len(top)), top] * 2) / (n + 2)
    return top, np.clip(both, 0.0, 1.0)


def identify(docs: DataFrame, is_training, sample: int = 40_000, bits: int = 16, price: float = 4.0, chunk: int = 150_000, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` (text, lang, doc_id among them) with the prediction and its score, under names that ``docs`` doesn't have."""
    langs, logp = learn(docs, is_training, sample, bits)
    shared, at = docs.sparkSession.sparkContext.broadcast((langs, logp)), docs.columns.index("text")

    def run(batches):
        langs, logp = shared.value
        table = Words(logp, bits) if langs else None
        for b in small(batches, at):
            pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            rows, words, starts, n = [], [], [], 0

            def settle():
                if rows:
                    log = table.of(words)
                    top, s = infer(log, np.array(starts), price)
                    for r, t, v in zip(rows, top.tolist(), s.tolist()):
                        pred[r], score[r] = langs[t], v

            for r, text in enumerate(b.column(at).to_pylist()):
                w = letters(text.lower()) if text and langs else ()
                if w:
                    rows.append(r)
                    starts.append(len(words))
                    words += w
                    if len(words) >= chunk:
                        settle()
                        rows, words, starts = [], [], []
            settle()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score)], [*b.schema.names, "x0", "x1"])

    return map_all(docs, run, dict(zip(names, ("string", "double"))))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = training(0, 5)
    out = identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
