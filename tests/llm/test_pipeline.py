"""The pipeline on odd rows, stage by stage, against plain formulations on each stage's own input."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import minhash, pack, pii
from bitloom.llm.common import Workspace
from bitloom.llm.minhash import TO_LOWER

from .test_mix_pack import fill_up, word_count


@pytest.fixture(scope="module")
def stages(spark, odd):
    ws, docs, out = Workspace(spark, "stages"), odd, [odd]
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.table(stage(spark, docs, ""), name)
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "personal_data", "mix_sources", "best_fit_packing"]


def test_language_stage(stages):
    before, after = rows(stages[0]), Counter(rows(stages[1]))
    with_letters = Counter(r for r in before if re.search(r"[^\W\d_]", r[1] or ""))
    assert not after - with_letters
    clean = Counter(r for r in before if r[0] is not None and r[0] < 60)
    assert not clean - after


def test_near_duplicate_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {}
    for i, t, *_ in before:
        w = (t or "").encode().translate(TO_LOWER).split()
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    ids = sorted(i for i in sets if i is not None)
    link = lambda a, b: minhash.is_link(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), 80)
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *(low[j] for j in ids if link(i, j))]) for i in ids}
        if new == low:
            break
        low = new
    assert sorted(i for i, *_ in after if i is not None) == sorted(set(low.values()))


def test_personal_data_stage(stages):
    before = {i: t for i, t, *_ in rows(stages[2])}
    for i, t, *_ in rows(stages[3]):
        spans = pii.base_spans(before[i] or "")
        assert t == pii.redact(before[i], [*spans, *pii.added_spans([before[i]], [spans], pii.field())[0]])
        assert not pii.base_spans(t)


def test_mixing_stage(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    size = Counter()
    for r, n in before.items():
        size[r[3]] += n * word_count(r[1])
    taken, want = Counter(), fill_up(dict(size))
    for r, n in after.items():
        assert n <= 2 * before[r]
        taken[r[3]] += n * word_count(r[1])
    for s in size:
        largest = max(word_count(r[1]) for r in before if r[3] == s)
        assert abs(taken[s] - want[s]) <= largest


def test_packing_stage(stages):
    tok = pack.Tokeniser(pack.vocabulary_path(pack.TOKENIZER))
    want = Counter()
    for i, t, *_ in rows(stages[4]):
        want[i] += len(tok.ids(t or "")) + 1
    got, used = Counter(), Counter()
    for r in stages[5].collect():
        got[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert got == want and max(used.values()) <= 2048
    assert len(used) <= math.ceil(sum(want.values()) / 2048) + 2


def test_empty(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_language_stage_without_labels(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    got = Counter(r["text"] for r in corpus_pipeline.language(spark, unlabelled, "").collect())
    assert got == Counter(r["text"] for r in odd.collect() if re.search(r"[^\W\d_]", r["text"] or ""))
