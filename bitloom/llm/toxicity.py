"""Toxicity by a weighted lexicon.

Text is folded (case, homoglyphs, digit and sign substitutions, invisible
characters) and matched in one pass of an Aho-Corasick automaton.  Terms are
whole words, or stems that a word begins with.  Terms found inside an exception
phrase don't count.  The score is a logistic function of the summed weights and
the text's length in words, both as logarithms, so that the sum is normalised
by a power of the length, which is learned with the rest.

The lexicon is learned from at most about ``sample`` labelled rows of each
class: words and beginnings of words (4 to 24 letters) that are much commoner in
toxic documents, in at least 0.4 % of them, and are followed there by many
different words (which passages that are copied from document to document are
not).  Its weights are log-odds.  Its size is bounded by that of the sample.

Edge cases: null or empty text has no term and gets the score of that; with no
labelled row of one class, only the built-in terms count; a document labelled
twice counts twice, and with both labels for both; repeated rows, null ids and
very long texts are handled like others; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read, small, training

#: Letters of other scripts that look like Latin ones (fixed values), and the letter each stands for.
HOMOGLYPHS = dict(zip("аеорсухіѕјԁһӏмтвнкɡαοερντικυχѡⅼ", "aeopcyxisjdhlmtbhkgaoepvtikuxwl"))
#: Signs and digits used for letters (fixed values).
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
#: i and l, and what stands for either, are one letter after folding.
SAME = {"l": "i", "ı": "i", "ł": "i"}
#: Insults that count whatever the labels say (fixed values).
BUILT_IN = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting")
#: Phrases in which a term is harmless (fixed values).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "trash collection", "clown fish", "circus clown", "pond scum",
    "loser bracket", "losers bracket", "sore loser", "class clown", "not stupid", "not an idiot", "not a moron", "not pathetic", "not worthless",
)


def folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in range(0xFF21, 0xFF3B):  # full-width letters
        table[c] = table[c + 0x20] = chr(c - 0xFF21 + 97)
    for c in (*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD):  # invisible
        table[c] = None
    for a, b in (*HOMOGLYPHS.items(), *SUBSTITUTES.items(), *SAME.items()):
        table[ord(a)] = SAME.get(b, b)
    return table


FOLD = folding()
WORD = re.compile(r"[^\W_]+")


#: Signs stand for letters only inside words, or the last two also before one.
SIGNS = re.compile(r"[@$!](?![^\W_])|(?<![^\W_])@")


def fold(text: str) -> str:
    text = text.lower()
    if "!" in text or "@" in text or "$" in text:
        text = SIGNS.sub(" ", text)
    return text.translate(FOLD)


class Lexicon:
    """term -> (weight, is stem), with exceptions, as one automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, terms in (("word", words), ("stem", stems)):
            for t, w in terms.items():
                entries.setdefault(t, []).append((kind, len(t), w, t))
        for e in exceptions:
            entries.setdefault(fold(e), []).append(("pass", len(fold(e)), 0.0, e))
        for t, v in entries.items():
            self.machine.add_word(t, v)
        self.machine.make_automaton()

    def match(self, folded: str) -> tuple[float, int]:
        """Summed weight and number of different terms."""
        hits, spared = [], []
        n = len(folded)
        for end, found in self.machine.iter(folded):
            for kind, size, weight, term in found:
                start = end + 1 - size
                if start and folded[start - 1].isalnum():
                    continue
                if kind != "stem" and end + 1 < n and folded[end + 1].isalnum():
                    continue
                (spared if kind == "pass" else hits).append((start, end, weight, term))
        if spared:
            spared = sorted(s[:2] for s in spared)
            reach = list(accumulate((end for _, end in spared), max))  # how far the phrases up to each one reach
            first = [start for start, _ in spared]
            inside = lambda h: (i := bisect_right(first, h[0])) and reach[i - 1] >= h[1]
            hits = [h for h in hits if not inside(h)]
        best: dict[int, tuple[float, str]] = {}  # one term for each place
        for start, _, weight, term in hits:
            if weight > best.get(start, (0.0, ""))[0]:
                best[start] = weight, term
        return sum(w for w, _ in best.values()), len({t for _, t in best.values()})


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """Logarithms of the summed weights and of the length in words."""
    folded = fold(text or "")
    return np.log1p(lexicon.match(folded)[0]), np.log1p(len(text.split()) if text else 0)


def term_counts(rows: DataFrame, shortest: int = 4, longest: int = 24) -> DataFrame:
    """(term, stem, pos, neg, next): documents of each class with the term; next: bits of the hashed words that follow it in toxic ones."""

    def run(batches):
        import xxhash

        pos: dict = {}
        neg: dict = {}
        after: dict = {}
        for b in small(batches, 0):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(fold(text or ""))
                terms: dict[tuple[str, bool], int] = {}
                for w, nxt in dict.fromkeys(zip(words, [*words[1:], ""])):
                    bit = 1 << (xxhash.xxh3_64_intdigest(nxt) & 63) if toxic else 0
                    for t in ((w, False), *((w[:k], True) for k in range(shortest, min(longest, len(w)) + 1))):
                        terms[t] = terms.get(t, 0) | bit
                for t, bits in terms.items():
                    if toxic:
                        pos[t] = pos.get(t, 0) + 1
                        after[t] = after.get(t, 0) | bits
                    else:
                        neg[t] = neg.get(t, 0) + 1
        keys = list(pos | neg)
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            bits = np.array([after.get(t, 0) for t in k], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in k]), pa.array([s for _, s in k]), pa.array([pos.get(t, 0) for t in k], pa.int64()), pa.array([neg.get(t, 0) for t in k], pa.int64()), pa.array(bits)], ["term", "stem", "pos", "neg", "next"])

    counts = rows.select("text", "toxic").mapInArrow(run, "term string, stem boolean, pos long, neg long, next long")
    return counts.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("bit_count(bit_or(next))").alias("followers"))


def choose(terms: list, n_pos: int, n_neg: int, least_odds: float) -> tuple[dict, dict]:
    """Words and stems from counted terms.  A stem stands only where it says more than the one word it may come from."""
    odds = lambda t: float(np.log((t["pos"] + 0.5) / (n_pos + 1)) - np.log((t["neg"] + 0.5) / (n_neg + 1)))
    words = {t["term"]: (odds(t), t["pos"]) for t in terms if not t["stem"]}
    stems: dict[str, tuple[float, int]] = {}
    for t in sorted((t for t in terms if t["stem"]), key=lambda t: len(t["term"])):
        s = t["term"]
        if any(s.startswith(k) for k in stems):
            continue
        whole = max((p for w, (_, p) in words.items() if w.startswith(s)), default=0)
        if t["pos"] > 1.5 * whole:
            stems[s] = odds(t), t["pos"]
    words = {w: v for w, v in words.items() if not any(w.startswith(s) for s in stems)}
    # chance finds are far below the terms that the class is labelled for
    floor = max([least_odds, *(o - 4 for o, _ in (*words.values(), *stems.values()))])
    keep = lambda d: {t: round(o, 4) for t, (o, _) in d.items() if o >= floor}
    return keep(words), keep(stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * [1, 1, 0.01]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1, 1, 0.01])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, is_training, sample: int = 6000, least_odds: float = 3.0) -> tuple[dict, dict, np.ndarray]:
    # other labels say nothing
    labelled = labels.where(F.col("toxic").isin(0, 1) & is_training).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, size.get(1, 0)))).otherwise(min(1.0, 2 * sample / max(1, size.get(0, 0))))
    labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    # the sample is bounded, so its ids go to where the texts are, and its texts are kept as a table
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(labelled), "id").select("id", "text", "toxic")
    rows = Workspace(docs.sparkSession, "toxicity").table(rows, "sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    built_in = {fold(w): 4.0 for w in BUILT_IN}
    if not n_pos or not n_neg:
        return built_in, {}, np.array([3.0, -0.3, -2.5])
    least = max(4, n_pos // 250)
    found = term_counts(rows).where((F.col("pos") >= least) & (F.col("followers") >= 4) & ((F.col("pos") + 0.5) / (n_pos + 1) > float(np.exp(least_odds)) * (F.col("neg") + 0.5) / (n_neg + 1)))
    terms = found.orderBy(F.desc("pos"), "term", "stem").collect()  # each in many documents of a bounded sample
    words, stems = choose(terms, n_pos, n_neg, least_odds)
    words = {w: v for w, v in built_in.items() if not any(w.startswith(s) for s in stems)} | words
    shared = docs.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches):
        lexicon = Lexicon(*shared.value)
        for b in small(batches, 0):
            f = np.array([features(t, lexicon) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), b.column(1)], ["weight", "length", "toxic"])

    t = rows.select("text", "toxic").mapInArrow(run, "weight double, length double, toxic int").toArrow()  # the bounded sample
    w = logistic(np.column_stack([t["weight"].to_numpy(), t["length"].to_numpy()]), t["toxic"].to_numpy().astype(float))
    return words, stems, w


def score(docs: DataFrame, labels: DataFrame, is_training, **options) -> DataFrame:
    """doc_id, toxic_score (0 to 1)."""
    model = learn(docs, labels, is_training, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words, stems, w = shared.value
        lexicon = Lexicon(words, stems)
        for b in small(batches, 1):
            f = np.array([features(t, lexicon) for t in b.column(1).to_pylist()]).reshape(-1, 2)
            z = f @ w[:2] + w[2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "toxic_score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, toxic_score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = training(1, 3)
    out = score(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
