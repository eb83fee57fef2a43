"""Collocations: phrases of two to five words that stay together, by weighted n-gram counts.

1. Texts are cut into pieces at punctuation and line ends, pieces into words; equal pieces of a language become one row with
   their multiplicity (partial counts before the shuffle, so a line that is everywhere is one row a task).
2. Tasks turn pieces into weighted n-grams, add up equal ones of a stretch of words, and deal them to buckets by hash; each
   bucket is counted by duckdb, which spills to the task's scratch disk beyond its memory, and only counts of ``least`` and
   more leave it.  First single words, then pairs, then phrases of three to five words.  A pair can only be that frequent if
   both words are, a longer phrase if each pair in it is: what was found is marked in a bit map (16 bits each, at most 2**30),
   and what holds an unmarked word or pair isn't dealt.  The map never misses what is frequent; where it fills up, more is
   counted and the result is the same.
3. Each candidate asks for the counts of the parts of each of its cuts.  Requests and counts meet by a shuffle on the part, the
   answers go back to their candidate, and its cut of the lowest score counts.
4. Phrases inside a longer one that is as frequent are dropped.  A longer phrase is never more frequent than what lies between,
   so a look at those of one word more is enough.

Scores are whole numbers of 38 digits.  Memory of a task: a stretch of half a million words, the bit map, duckdb's limit.

Edge cases: null or empty text has no pieces; a null language is ``und``; texts of any length are cut into stretches that overlap
by the longest phrase; repeated rows count each; ids don't matter; other columns are ignored; ties in score and count go by the
phrase's UTF-8 bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, Workspace, mix64, read, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRETCH = 500_000
COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): distinct pieces, their words joined by single spaces."""
    lower = F.translate("text", UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    clean = cut.select("lang", F.btrim(F.regexp_replace("piece", r"[\x20\x09]+", " "), F.lit(" ")).alias("piece")).where("piece <> ''")
    return clean.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def pair_hashes(lang: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """From hashes of languages and words."""
    return mix64(mix64(mix64(left) + right) ^ lang)


class Marks:
    """A bit map over hashes of words or pairs."""

    def __init__(self, data: bytes, bits: int):
        self.map, self.right = np.frombuffer(data, np.uint8), U64(64 - bits)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> self.right
        return (self.map[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1


def grams(found: DataFrame, orders: tuple[int, ...], marks=None, width: int = 2) -> DataFrame:
    """(lang, piece, times) -> (key, n): weighted n-grams, with sums over stretches; a key is the phrase, a line end and the language.

    With ``marks`` of words (width 1) or pairs (2), those whose words or pairs are all marked.
    """

    def run(batches):
        hashes = WordHashes()
        nothing = U64(hashes[b""])
        for b in small(batches, 1):
            words = pc.split_pattern(b.column(1), " ")
            flat, count = words.flatten(), words.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(count)), count)
            left = np.cumsum(count)[row] - np.arange(len(row))  # words from here to the end of the piece
            times = b.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(row), STRETCH):
                stop = min(len(row), at + STRETCH)
                reach = min(len(row), stop + max(orders) - 1)
                w, own, rest = flat.slice(at, reach - at), row[at:stop], left[at:stop]
                joined = np.ones(reach - at, bool)  # this word and the next may be parts of a phrase
                if marks is not None:
                    codes = pc.dictionary_encode(w)
                    if isinstance(codes, pa.ChunkedArray):
                        codes = codes.combine_chunks()
                    of = hashes.of([x.encode() for x in codes.dictionary.to_pylist()])[codes.indices.to_numpy()]
                    lang = hashes.of([x.encode() for x in b.column(0).to_pylist()])[row[at:reach]]
                    if width == 1:
                        alone = marks.value.marked(pair_hashes(lang, of, nothing))
                        joined[:-1] = alone[:-1] & alone[1:]
                    else:
                        joined[:-1] = marks.value.marked(pair_hashes(lang[:-1], of[:-1], of[1:]))
                for n in orders:
                    good = rest >= n
                    for i in range(n - 1 if marks is not None else 0):
                        shifted = np.zeros(len(good), bool)
                        part = joined[i : i + len(good)]
                        shifted[: len(part)] = part
                        good = good & shifted
                    i = np.flatnonzero(good)
                    if len(i):
                        phrase = pc.binary_join_element_wise(*(w.take(pa.array(i + j)) for j in range(n)), " ")
                        key = pc.binary_join_element_wise(phrase, b.column(0).take(pa.array(own[i])), "\n")
                        t = pa.table({"key": key, "n": times[own[i]]}).group_by("key").aggregate([("n", "sum")])
                        yield from t.rename_columns({"n_sum": "n"}).select(["key", "n"]).cast(COUNTS).to_batches()

    return found.select("lang", "piece", "times").mapInArrow(run, "key string, n long")


def counted(weighted: DataFrame, least: int, memory: str = "256MB") -> DataFrame:
    """(key, n) -> (lang, phrase, words, n, mark) of those that come to ``least``; ``mark`` is the hash of one or two words."""

    def run(batches):
        import os
        import shutil
        import tempfile

        import duckdb

        spill = tempfile.mkdtemp(prefix="phrases-", dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            came = pa.RecordBatchReader.from_batches(COUNTS, (pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=COUNTS) for b in batches))
            con.register("came", came)
            hashes = WordHashes()
            for b in con.sql(f"SELECT key, sum(n)::BIGINT AS n FROM came GROUP BY key HAVING sum(n) >= {int(least)}").to_arrow_reader(65536):
                keys = [k.split("\n", 1) for k in b.column(0).to_pylist()]
                words = [p.split(" ") for p, _ in keys]
                two = [(*w, "")[:2] if len(w) < 3 else ("", "") for w in words]
                lang = hashes.of([x.encode() for _, x in keys])
                mark = pair_hashes(lang, hashes.of([a.encode() for a, _ in two]), hashes.of([c.encode() for _, c in two]))
                columns = [pa.array([x for _, x in keys]), pa.array([p for p, _ in keys]), pa.array([len(w) for w in words], pa.int32()), b.column(1), pa.array(mark.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n", "mark"])
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return weighted.repartition("key").mapInArrow(run, "lang string, phrase string, words int, n long, mark long")


def mark_map(found: DataFrame) -> Marks:
    """The bit map of counted words or pairs: at most 2**30 bits come to the driver, whatever their number."""
    bits = min(30, max(20, (16 * found.count()).bit_length()))
    cell = F.shiftrightunsigned("mark", 64 - bits) + 1  # cells of the bit map functions begin with 1
    parts = found.groupBy(F.bitmap_bucket_number(cell).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("map"))
    data = bytearray(1 << bits - 3)
    for r in parts.toLocalIterator():  # one part of 4096 bytes after the other
        data[(r["at"] - 1) * 4096 : r["at"] * 4096] = r["map"]
    return Marks(bytes(data), bits)


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, a) -> the same with l, r, n and score of the lowest-scoring cut."""
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda side, k: F.struct(F.lit(side).alias("side"), F.call_function("substring_index", "phrase", F.lit(" "), k).alias("part"))
    asked = cut.withColumn("x", F.explode(F.array(part("l", F.col("k")), part("r", F.col("k") - F.col("words")))))
    asked = asked.select("lang", F.col("x.part").alias("part"), "phrase", "a", "k", "x.side")
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    answered = asked.join(known.hint("merge"), ["lang", "part"])  # counts grow with the corpus: never broadcast
    answer = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f"))).alias(f"{side}{k}")
    cuts = range(1, longest)
    back = answered.groupBy("lang", "phrase").agg(F.first("a").alias("a"), *(answer(s, k) for s in "lr" for k in cuts)).join(totals, "lang")
    whole = lambda c: c.cast("decimal(19,0)")
    wide = back.withColumns({f"d_{c}": whole(F.col(c)) for c in ("a", "n", *(f"{s}{k}" for s in "lr" for k in cuts))})
    of = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(d_a * 1000 * d_n) div (d_l{k} * d_r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]
    best = wide.withColumn("cut", F.array_min(F.array_compact(F.array(*of))))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """documents -> each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``share``: hundredths of a phrase's count that a longer one must have to stand for it.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    found = ws.table(pieces(docs), "pieces")
    words = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    totals = found.groupBy("lang").agg(F.sum(F.col("times") * words).alias("n"))
    counts = step = ws.table(counted(grams(found, (1,)), least), "words")
    for orders, width in (((2,), 1), (tuple(range(3, longest + 1)), 2)):
        if orders and orders[-1] <= longest:
            marks = docs.sparkSession.sparkContext.broadcast(mark_map(step))
            step = ws.table(counted(grams(found, orders, marks, width), least), f"words{orders[-1]}")
            counts = counts.unionByName(step)
    counts = counts.select("lang", "phrase", "words", "n")
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    inner = lambda k: F.call_function("substring_index", "phrase", F.lit(" "), k)
    longer = candidates.where("words > 2").select("lang", F.explode(F.array(inner(F.col("words") - 1), inner(1 - F.col("words")))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    alone = candidates.join(longer.hint("merge"), ["lang", "phrase"], "left").where((F.lit(100).cast("decimal(19,0)") * F.coalesce("most", F.lit(0)) < F.col("a") * F.lit(share).cast("decimal(19,0)")) | F.col("most").isNull())
    result = scored(ws.table(alone.select("lang", "phrase", "words", "a"), "alone"), counts, ws.table(totals, "totals"), longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # tasks keep their own first ``top`` before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS times FROM d GROUP BY ALL
), i AS (
  SELECT lang, w, times, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, sum(times)::BIGINT AS f FROM i GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT c.lang, s.phrase FROM (
    SELECT lang, a, m, array_to_string(w[j:j + m - 1], ' ') AS phrase FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS j FROM c, range(2, 5) t(m) WHERE m < k)
  ) s JOIN c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100 * s.a >= 100 * c.a
), cut AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.j, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * cut.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = cut.x JOIN g r ON r.lang = cut.lang AND r.phrase = cut.y JOIN n ON n.lang = cut.lang
), b AS (
  SELECT * FROM s ANTI JOIN inside USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""
