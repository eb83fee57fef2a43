"""Ids as files: coder round trips, damage, documents against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import idcoder, idfile
from bitloom.llm.pack import vocabulary_path

from .conftest import table


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 70000).flatmap(lambda v: st.tuples(st.just(v), st.lists(st.lists(st.integers(0, v - 1), max_size=60), min_size=1, max_size=6))))
def test_coder_round_trip(case):
    vocabulary, blocks = case
    coder = idcoder.Coder(vocabulary, block=64, lanes=4)
    back = coder.decode(coder.encode([np.array(b, np.int64) for b in blocks]), [len(b) for b in blocks])
    assert [x.tolist() for x in back] == blocks


def test_full_blocks_and_prediction():
    rng = np.random.default_rng(5)
    random = rng.integers(0, 49408, 4096)
    blocks = [random, np.zeros(4096, int), np.full(4096, 49407), np.tile(rng.integers(0, 49408, 40), 103)[:4096], rng.zipf(1.2, 4096) % 49408]
    coder = idcoder.Coder(49408)
    coded = coder.encode(blocks)
    assert all((x == y).all() for x, y in zip(coder.decode(coded, [len(b) for b in blocks]), blocks))
    assert len(coded[0]) < 4096 * 2.02 and len(coded[1]) < 60 and len(coded[3]) < 800  # random ids cost log2(49408) bits, what repeats nearly none
    assert coder.encode([blocks[3]])[0] == coded[3]  # a block's bytes don't depend on its neighbours
    with pytest.raises(ValueError):
        coder.encode([np.array([49408])])


def test_memory_of_a_lane():
    import tracemalloc

    rng = np.random.default_rng(6)
    blocks = [rng.zipf(1.1, 4096) % (1 << 18) for _ in range(64)]
    tracemalloc.start()
    try:
        coder = idcoder.Coder(1 << 18)
        back = coder.decode(coder.encode(blocks), [4096] * 64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all((x == y).all() for x, y in zip(back, blocks)) and peak / 64 < 700_000  # 2.6 MB a lane with a tree of counts


def test_a_block_ends_with_its_ids():
    coder = idcoder.Coder(100)
    coded = coder.encode([np.arange(50)])[0]
    for hurt in (coded + b"\0\0\0\0", coded[:-4], coded[:4]):
        with pytest.raises(idcoder.Damaged):
            coder.decode([hurt], [50])


def test_words_are_kept_between_tasks(monkeypatch):
    path = vocabulary_path(idfile.TOKENIZER)
    assert idfile.tokeniser(path) is idfile.tokeniser(path)
    tok = idfile.WordTokeniser(path)
    monkeypatch.setattr(idfile.WordTokeniser, "LIMIT", 3)  # cleared again and again, also within a text
    for t in ("one two, two three's one 4x one", "Über ÜBER œuvre-x, one", ""):
        assert tok.ids(t).tolist() == tok.library.encode(t, add_special_tokens=False).ids


def test_damage_is_found():
    ids = np.arange(50)
    blob = idcoder.record(ids, idcoder.Coder(100).encode([ids])[0], [(7, 20), (None, 50)], 100)
    assert idcoder.parse(blob)[3] == [(7, 20), (None, 50)]
    for i in range(len(blob)):
        with pytest.raises(idcoder.Damaged):
            idcoder.parse(blob[:i] + bytes([blob[i] ^ 1]) + blob[i + 1 :])
    with pytest.raises(idcoder.Damaged):
        idcoder.parse(blob[:-2])


def test_words_one_by_one_are_the_librarys_ids():
    tok = idfile.WordTokeniser(vocabulary_path(idfile.TOKENIZER))
    letters = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), 0x20AC, 9, 10, 13)]
    texts = [a + b for i, a in enumerate(letters) for b in ("", "a", "'s", letters[(i * 7 + 3) % len(letters)] + "z 1", "\n" + a)]
    texts += ["It's  foo3bar\tÜBER hello,\nWorld '''tis we'll 'REal", "İSTANBUL ŉx ǅ", "<|endoftext|>", "日本 語", "é é", "\u0085a b", " " * 100_000 + "x", "\n" * 100_000]
    for t in texts:
        assert tok.ids(t).tolist() == tok.library.encode(t, add_special_tokens=False).ids, t[:40]


def test_words_are_looked_up_once_for_all_texts():
    tok = idfile.WordTokeniser(vocabulary_path(idfile.TOKENIZER))
    asked = []
    tok.learn = lambda piece: asked.append(piece) or idfile.WordTokeniser.learn(tok, piece)
    texts = ["One two,  two three's", None, "", "日本 語 <|endoftext|>", "two, ONE\n", "<|endoftext|>", " a\xa0b one!\tœuvre", "\0 \x001 one", "x" * 70_000, "Über! über, ÜBER"] * 3
    ids, stops = tok.of(texts, (1, 7))
    want = [[*tok.library.encode(t or "", add_special_tokens=False).ids, 1, 7] for t in texts]
    assert ids.tolist() == sum(want, []) and stops.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert len(asked) == len(set(asked)) > 5
    assert [x.tolist() for x in tok.of([])] == [[], []]


def test_words_of_letters_by_rank():
    tok = idfile.WordTokeniser(vocabulary_path(idfile.TOKENIZER))
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéèñßöüçœıȥ"), n, p=np.array([25] * 26 + [3] * 10) / 680)) for n in rng.integers(1, 24, 3000)] + ["a" * n for n in range(1, 40)]
    got = [list(np.frombuffer(tok.word(w), "<u4")) for w in words]
    assert tok.pieces and got == [tok.library.encode(w, add_special_tokens=False).ids for w in words]


def test_tokens_that_a_model_does_not_leave_whole_go_to_the_library(tmp_path):
    import json

    with open(vocabulary_path(idfile.TOKENIZER), encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["ab", "c</w>"]]  # abc is left as a, bc, which are abc together
    singles = {t: i for t, i in model["vocab"].items() if i < 512}
    model["vocab"], model["merges"] = singles | {a + b: 512 + i for i, (a, b) in enumerate(merges)}, merges
    path = tmp_path / "small.json"
    path.write_text(json.dumps(told))
    tok = idfile.WordTokeniser(str(path))
    assert tok.pieces is None and tok.ids("abcd abc, cab").tolist() == tok.library.encode("abcd abc, cab", add_special_tokens=False).ids


def test_more_blocks_in_step_for_less_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    blocks = [rng.zipf(1.1, 4096) % 49408 for _ in range(256)]
    tracemalloc.start()
    try:
        coder = idcoder.Coder(49408)
        back = coder.decode(coder.encode(blocks), [4096] * 256)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all((x == y).all() for x, y in zip(back, blocks))
    assert coder.lanes >= 2048 and peak / 256 < 200_000  # 512 lanes of 500,000 before


def by_brute_force(rows, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        out.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def test_documents_against_library(spark, odd, odd_rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    want, total = by_brute_force(odd_rows, vocabulary_path(idfile.TOKENIZER))
    for part_bytes in (1 << 25, 4000):
        idfile.write_ids(odd, path, part_bytes=part_bytes)
        got = idfile.read_ids(spark, path, keep_ids=True).orderBy("start").collect()
        assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
        at = 0
        for r in got:
            assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        assert at == total
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_nothing_and_damaged_files(spark, nothing, tmp_path):
    path = f"file://{tmp_path}/none"
    idfile.write_ids(nothing, path)
    assert idfile.read_ids(spark, path).count() == 0
    rows = [(i, f"some words {i}", "en", "s") for i in range(6)]
    idfile.write_ids(table(spark, rows), path)
    whole = spark.read.parquet(path)
    hurt = whole.selectExpr("part", "block", "concat(substring(record, 1, 40), unhex('00'), substring(record, 42)) AS record")
    with pytest.raises(Exception, match="Damaged"):
        idfile.decoded(hurt).collect()
    with pytest.raises(Exception, match="lacks block 0"):
        idfile.decoded(whole.selectExpr("part", "block + 1 AS block", "record")).collect()
