import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import mix, pack


def fill_up(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshares the excess again and again."""
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(size.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return full
        rate = (total - sum(full.values())) / sum(w[s] for s in open_)
        over = {s: cap * size[s] for s in open_ if rate * w[s] > cap * size[s]}
        if not over:
            return full | {s: rate * w[s] for s in open_}
        full |= over


def word_count(t):
    return len((t or "").encode().split())


def test_targets_and_copies(odd, odd_rows):
    got = mix.mix(odd).collect()
    assert len(got) == len(odd_rows)
    size = Counter()
    for r in odd_rows:
        size[r[3]] += word_count(r[1])
    want, taken, largest = fill_up(dict(size)), Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1)


def test_reruns_agree_and_strata_split(odd):
    a = sorted(map(tuple, mix.mix(odd, stratum=3).drop("source").collect()), key=str)
    b = sorted(map(tuple, mix.mix(odd.repartition(5), stratum=3, broadcast_sources=0).drop("source").collect()), key=str)
    assert a == b


@pytest.mark.parametrize("same_text", [True, False])
def test_one_id_for_all_rows(spark, same_text):
    """Null ids, with one text or many: strata are split, reruns agree, targets are met and no stratum is a whole source."""
    rows = [(None if i % 3 else 7, "a b c" if same_text else f"w{i} " * (1 + i % 5), "s" if i % 4 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mix.mix(x, stratum=16, broadcast_sources=0).collect()), key=str) for x in (docs.coalesce(1), docs.repartition(7)))
    assert one == two and len(one) == 3000
    size = Counter()
    for r in rows:
        size[r[2]] += word_count(r[1])
    want = fill_up(dict(size))
    for s in size:
        assert abs(sum(r[6] for r in one if r[1] == s) - want[s]) <= 5 and all(r[4] == pytest.approx(want[s]) for r in one if r[1] == s)
    ws = mix.Workspace(spark, "split")
    keyed = docs.select("source", F.lit("0").alias("class"), F.lit(0).alias("part"), F.lit(3).cast("long").alias("size"), F.lit(5).alias("key"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    assert mix.split(ws, keyed, 16).groupBy("source", *mix.STRATUM).count().agg(F.max("count")).first()[0] <= 48


def test_equal_ids_with_different_texts_repeat_alike(spark):
    docs = spark.createDataFrame([(1, f"t{i} x", "s") for i in range(40)], "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mix.repeat_to_targets(x).collect())) for x in (docs.coalesce(1), docs.repartition(5)))
    assert one == two and len(one) == 60


def test_many_sources(spark):
    rows = [(i, "a " * (i % 37 + 1), f"s{i * 7919 % 1000:04d}") for i in range(4000)]
    size = Counter()
    for r in rows:
        size[r[2]] += word_count(r[1])
    want = fill_up(dict(size))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["source"]: r["target"] for r in mix.mix(docs, broadcast_sources=0).collect()}
    assert got == {s: pytest.approx(v, rel=1e-9) for s, v in want.items()}


def test_rows_are_repeated(odd):
    got = mix.repeat_to_targets(odd)
    assert got.columns == odd.columns
    want = sum(r["copies_taken"] for r in mix.mix(odd).collect())
    assert got.count() == want


def test_empty_tables(nothing):
    assert mix.mix(nothing).count() == 0
    assert pack.pack_documents(nothing).count() == 0


def test_plain_texts_give_the_same_ids():
    t = pack.Tokeniser(pack.vocabulary_path(pack.TOKENIZER), pack.vocabulary_path("byte_bpe_50k.tiktoken"))
    slow = lambda s: t.slow.encode(s, add_special_tokens=False).ids
    chars = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x20AC)]
    rng = random.Random(4)
    for c in chars:
        for s in (c, f"a{c}b", f" {c}", c + c, f"1{c}2", f"  {c}  x", f"{c}\n", f"don'{c}"):
            assert t.ids(s).tolist() == slow(s)
    for _ in range(2000):
        s = "".join(rng.choice(chars if rng.random() < 0.5 else " \n\t'aZ1.é") for _ in range(rng.randint(1, 60)))
        assert t.ids(s).tolist() == slow(s)
    for s in ("<|endoftext|>", "a<|endoftext|>b", "漢字 テスト", "😀 ok", ""):
        assert t.ids(s).tolist() == slow(s)


def test_round_trip(odd, odd_rows):
    got = pack.pack_documents(odd, keep_ids=True).collect()
    t = pack.Tokeniser(pack.vocabulary_path(pack.TOKENIZER))
    want = defaultdict(Counter)
    for r in odd_rows:
        want[r[0]][tuple([*t.ids(r[1] or "").tolist(), 0])] += 1
    places, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], ids))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, texts in want.items():
        if sum(texts.values()) == 1:
            assert tuple(np.concatenate([x for _, x in sorted(pieces[doc], key=lambda p: p[0])]).tolist()) == next(iter(texts))
    assert sum(r["length"] for r in got) == sum(len(t) * n for v in want.values() for t, n in v.items())


def test_whole_documents_give_the_same_ids():
    """All texts of a table, of any length, by both libraries."""
    import pyarrow.parquet as pq

    t = pack.Tokeniser(pack.vocabulary_path(pack.TOKENIZER), pack.vocabulary_path("byte_bpe_50k.tiktoken"))
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert t.ids(text or "").tolist() == t.slow.encode(text or "", add_special_tokens=False).ids


def best_fit(counts, size):
    """Sequences of best fit for one piece at a time, longest first."""
    gaps, opened = [], 0
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        i = bisect_left(gaps, length)
        left = gaps.pop(i) if i < len(gaps) else size
        opened += left == size
        if left > length:
            insort(gaps, left - length)
    return opened


def filled(runs, counts, size):
    """Checks that each rank of each length has one place and pieces don't overlap; the number of sequences."""
    places = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, n, sequence, per, offset in runs:
        for k in range(n):
            ranks[length].append(first + k)
            places[sequence + k // per].append((offset + k % per * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_sweep_is_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        size = rng.choice([10, 100, 2048])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 50))}
        placed, stay, _ = pack.sweep([(x, 0, n) for x, n in counts.items()], [], size, 0)
        assert not stay and filled(placed, counts, size) == best_fit(counts, size)


def test_conflicts_go_to_the_lower_rank():
    # five pieces of 7 meet three gaps: the tightest first, ranks in order, and two pieces stay
    placed, stay, left = pack.sweep([(7, 0, 5)], [(9, 100, 1), (7, 200, 2), (6, 300, 4)], 10)
    assert sorted(placed) == [(7, 0, 2, 200, 1, 3), (7, 2, 1, 100, 1, 1)] and stay == [(7, 3, 2)]
    assert sorted(left) == [(2, 100, 1), (6, 300, 4)]
    # a longer piece goes before a shorter one that fits the same gap
    placed, stay, _ = pack.sweep([(5, 0, 1), (6, 0, 1)], [(6, 1, 1)], 10)
    assert placed == [(6, 0, 1, 1, 1, 4)] and stay == [(5, 0, 1)]


@pytest.mark.parametrize("counts", [{2048: 3}, {1: 5000}, {1500: 4, 500: 9, 48: 30, 7: 11, 1: 3}, {700: 500, 690: 500, 640: 40, 200: 100, 30: 2000, 2: 10}, {1024: 7, 1025: 7, 1023: 7}])
def test_supersteps(spark, counts):
    """Pieces and gaps of different ranges are different tasks' rows; the outcome is that of one sweep."""
    ws = pack.Workspace(spark, "supersteps")
    table = spark.createDataFrame(list(counts.items()), "length long, n long").repartition(3)
    runs = pack.placements(ws, table).select("length", "first", "n", "sequence", "per", "offset").collect()
    assert filled([tuple(r) for r in runs], counts, pack.SIZE) == best_fit(counts, pack.SIZE)


def test_repeated_rows_spread_and_runs_stay_few(spark):
    """Equal rows and null ids are ranked by their own numbers; a larger corpus of the same lengths has as many runs."""
    ws = pack.Workspace(spark, "runs")
    size = {}
    for k in (1, 16):
        counts = spark.createDataFrame([(x, 40 * k) for x in range(1, 400)], "length long, n long")
        size[k] = pack.placements(ws, counts).count()
    assert size[16] < 2 * size[1]
    same = spark.createDataFrame([(None, "equal text")] * 3000, "doc_id long, text string").repartition(3)
    got = pack.pack_documents(same)
    assert got.count() == 3000 and got.select("sequence_id", "offset").distinct().count() == 3000
    assert got.agg({"length": "sum"}).first()[0] <= 2048 * got.select("sequence_id").distinct().count()


def test_op5_columns(spark):
    got = pack.op5(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]


def test_several_tasks_place_in_one_superstep(spark):
    """After the longest pieces, those of all shorter ranges are placed at once, each range by a task of its own; no step is empty."""
    rng = random.Random(12)
    counts = {}
    for _ in range(3000):
        x = rng.choice([rng.randint(257, 2048), rng.randint(33, 256), rng.randint(5, 32), rng.randint(1, 4)])
        counts[x] = counts.get(x, 0) + 1
    ws = pack.Workspace(spark, "concurrent")
    steps = []
    plain = ws.table

    def spy(df, tag):
        out = plain(df, tag)
        if tag.startswith("step"):
            steps.append(out.where("kind = 2").select(pack.ranged(2048).alias("r")).distinct().collect())
        return out

    ws.table = spy
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    runs = pack.placements(ws, table).select("length", "first", "n", "sequence", "per", "offset").collect()
    assert filled([tuple(r) for r in runs], counts, pack.SIZE) == best_fit(counts, pack.SIZE)
    assert all(steps) and max(map(len, steps)) >= 2 and len(steps) <= 8
    assert pack.moves_of({1, 2, 3}, {0, 2, 3}, 1) == {2: 2, 3: 3, 1: 0} and pack.moves_of({2, 3}, {0, 1, 3}, 2) == {3: 3, 2: 1}
