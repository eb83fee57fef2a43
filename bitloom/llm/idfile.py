"""Token ids as files: documents in order of their ids, tokenised, range-coded in blocks, and read back.

1. Documents are range-sorted by id (ties by a hash of the text) into parts of about ``part_bytes`` of text; a part is one
   task's.  It tokenises its texts (what stands between white space is looked up once in each few MB), closes each with an end
   id, and cuts the stream of ids into blocks of 4096, whatever documents they belong to.
2. Blocks are range-coded by adaptive mixing of order-0 to order-2 predictions (``idcoder``), each from a fresh state.  A
   block's record has a head, the ids and ends of the documents that end in it, and two checksums: of its ids, and of its
   bytes.  Any block can be decoded by itself; a damaged one is named by part and number.
3. Records are the rows (part, block, record) of Parquet files, written by Spark's writer and so committed by task: a lost
   executor's parts are made again, with the same bytes.
4. Reading deals whole parts to tasks, in order of blocks, and decodes up to 2048 blocks at once, so that memory is bounded by
   these and by one document.  Ids before a part are a prefix sum over parts, in two steps.

Edge cases: null or empty text is the end id alone; null ids come first, and rows without one are read back with a null id;
repeated rows are a document each; equal ids with other texts are ordered by a hash of the text; a text of any length may
span blocks (a document's ids must fit a task's memory while they are tokenised, not while they are read); other columns are
ignored; an empty table gives no files and reads back as no rows, given its folder.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read, small
from .idcoder import BLOCK, LANES, Coder, Damaged, crc_of, parse, record
from .pack import vocabulary_path

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Lower-cased words are looked up one by one where a text has only these characters, for which normal form, case and the split
#: into words are the same as in the library (tested); other texts go to the library whole.
PLAIN = r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*"
#: How the vocabulary's file splits lower-cased text into words: these, letters, single digits, runs of other signs (fixed values).
ENDINGS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Signs that may follow a word's letters, of which none begins an ending.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of lower-cased letters; and for a byte that ends a word another one, which no letter has.
WITHIN = frozenset([*range(0x61, 0x7B), *range(0x80, 0x100)])
LAST = [bytes([c - 0x20 if 0x61 <= c < 0x7B else c - 0x80 if 0x80 <= c < 0xC0 else c]) for c in range(256)]
PACKED = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: What no plain text has: stands for the end of a text, and with a number for a whole text.
MARK = "\0"
BLOCKS = "part int, block int, record binary"


def one_by_rank(path: str, model, letters: dict[int, int]):
    """A function from a word of plain letters, lower-cased, its last byte as in LAST, to its ids, by ``tiktoken``; None where it might differ.

    The library joins pairs of its list, in order; ``tiktoken`` joins any two that are a token, in order of ids.  Both go the same
    way unless the library comes to a pair that makes a token and isn't the listed one.  It would come to it in the token by
    itself, too, which it would leave in two.  So it is enough that it leaves each token whole.
    """
    import json

    import tiktoken
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        told = json.load(f)["model"]
    vocabulary, merges, suffix = told["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in told["merges"]], told["end_of_word_suffix"]
    made = [vocabulary[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    inside = BPE(vocabulary, merges)  # for tokens that don't end a word
    byte = {chr(x): c for c, x in letters.items()}
    byte = {chr(c): byte.get(chr(c), c) for c in range(256)} | byte
    ranks = {}
    for token, i in vocabulary.items():
        ends = token.endswith(suffix)
        shown = token.removesuffix(suffix)
        b = bytes(byte[c] for c in shown)
        if all(c in WITHIN for c in b) and (not ends or b[-1] < 0xC0):
            if [t.id for t in (model if ends else inside).tokenize(shown)] != [i]:
                return None
            ranks[b[:-1] + LAST[b[-1]] if ends else b] = i
    if not ranks.keys() >= {*(bytes([c]) for c in WITHIN), *(LAST[c] for c in WITHIN)}:
        return None
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordTokeniser(dict):
    """ids of a text by the given file; ids of words, and of what stands between white space, are kept in a bounded cache."""

    LIMIT = 500_000

    def __init__(self, path: str):
        import os
        import re
        import unicodedata

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others for 256, 257, ...
        self.letters = {c: 256 + i for i, c in enumerate(sorted({*range(256)} - {*shown}))}
        self.pieces = one_by_rank(path, self.model, self.letters)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = re.compile(PLAIN)
        near = sorted({x for c in range(0x2030) if self.plain.fullmatch(chr(c)) for x in chr(c).lower()})
        of = lambda kind: "".join(re.escape(c) for c in near if unicodedata.category(c)[0] == kind)
        self.words = re.compile(f"{ENDINGS}|[{of('L')}]+|[{of('N')}]|[^\\s{of('L')}{of('N')}]+")

    def ids(self, text: str) -> np.ndarray:
        return self.of([text])[0]

    def of(self, texts: list[str | None], end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each with its end, one after the other; and where each text stops."""
        whole, shown = {MARK: np.array(end, "<u4").tobytes()}, []
        for text in texts:
            if not text:
                shown.append(MARK)
            elif self.plain.fullmatch(text) and not any(s in text for s in self.special):
                shown.append(f"{text.lower()} {MARK}")
            else:
                name = f"{MARK}{len(whole)}"
                whole[name] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                shown.append(f"{name} {MARK}")
        if not shown:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        split = pc.ascii_split_whitespace(pa.array(shown, pa.large_string()))
        pieces = split.values.dictionary_encode()
        kinds = len(pieces.dictionary)
        names = pc.binary_join(pa.ListArray.from_arrays([0, kinds], pieces.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")
        found = [whole[p] if p[:1] == MARK else self.learn(p) if x is None else x for p, x in zip(names, map(self.get, names))]
        if len(self) > self.LIMIT:  # what this text has is kept
            self.clear()
            self.update((p, x) for p, x in zip(names, found) if p[:1] != MARK)
        flat = np.frombuffer(b"".join(found), "<u4")
        long = np.fromiter(map(len, found), np.int64, kinds) >> 2
        code = pieces.indices.to_numpy()
        times = long.take(code)
        stops = np.cumsum(times)
        at = np.repeat((np.cumsum(long) - long).take(code) - (stops - times), times)
        at += np.arange(len(at))
        return flat.take(at), stops.take(split.offsets.to_numpy()[1:] - 1)

    def learn(self, piece: str) -> bytes:
        """ids of what stands between white space, word by word."""
        word = piece if piece.isalpha() else piece.rstrip(SIGNS)
        if not word.isalpha():
            x = b"".join(map(self.word, self.words.findall(piece)))
        elif len(word) == len(piece):
            x = self.word(word)
        else:
            signs = piece[len(word) :]
            x = self.get(signs)
            if x is None:
                x = self[signs] = self.word(signs)
            x = (self.get(word) or self.word(word)) + x
        self[piece] = x
        return x

    def word(self, word: str) -> bytes:
        """ids of a word, from the library's model, which takes a word's bytes as characters, or as it would give them."""
        if self.pieces and word.isalpha():
            b = word.encode()
            ids = self.pieces(b[:-1] + LAST[b[-1]])
        else:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)


@cache
def tokeniser(path: str) -> WordTokeniser:
    """One for all tasks of a Python worker."""
    return WordTokeniser(path)


#: Bytes of text of a part: on the check's documents about two times as many blocks as are coded in step.
PART = 28 << 20


def ordered(docs: DataFrame, part_bytes: int) -> DataFrame:
    """doc_id, text in ascending order over as many tasks as there are parts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    return texts.repartitionByRange(max(1, -(-size // part_bytes)), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")


def blocks(docs: DataFrame, path: str, end: int = END, part_bytes: int = PART) -> DataFrame:
    """documents -> (part, block, record), parts and blocks in order of doc_id."""

    def run(batches):
        tok = tokeniser(path)
        coder = Coder(tok.size)
        part, number = TaskContext.get().partitionId(), 0
        full: list[tuple[np.ndarray, list]] = []
        rest, ends = np.empty(0, "<u4"), []  # ids since the last full block; documents that end in them

        def coded():
            nonlocal number
            rows = [record(ids, x, found, tok.size) for (ids, found), x in zip(full, coder.encode([ids for ids, _ in full]))]
            out = pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(range(number, number + len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["part", "block", "record"])
            number += len(rows)
            full.clear()
            return out

        for b in small(batches, 1, 8_000_000):
            ids, stops = tok.of(b.column(1).to_pylist(), (end,))
            ends += zip(b.column(0).to_pylist(), (stops + len(rest)).tolist())
            ids = np.concatenate([rest, ids])
            told, cut = 0, len(ids) // BLOCK * BLOCK
            for at in range(0, cut, BLOCK):
                first = told
                while told < len(ends) and ends[told][1] <= at + BLOCK:
                    told += 1
                full.append((ids[at : at + BLOCK], [(doc_id, stop - at) for doc_id, stop in ends[first:told]]))
                if len(full) == coder.lanes:
                    yield coded()
            rest, ends = ids[cut:], [(doc_id, stop - cut) for doc_id, stop in ends[told:]]
        if len(rest):
            full.append((rest, ends))
        if full:
            yield coded()

    return ordered(docs, part_bytes).mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, part_bytes: int = PART) -> None:
    """Writes the ids of all documents below the folder ``path``, replacing what is there."""
    blocks(docs, tokenizer or vocabulary_path(TOKENIZER), end, part_bytes).write.mode("overwrite").option("compression", "none").parquet(path)


def decoded(rows: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(part, block, record) -> a row for each document: doc_id, part, first (its place in the part), n_tokens, ids_crc32[, ids]."""

    def run(batches):
        coder, part, number = None, None, 0
        before = done = count = crc = 0  # ids of the part; of them, those of finished documents; of the open document; their crc
        parts: list[np.ndarray] = []
        waiting: list = []

        def flush():
            nonlocal coder, part, number, before, count, crc
            if not waiting:
                return
            out: list[list] = [[], [], [], [], [], []]
            heads = [parse(x) for _, _, x in waiting]
            if coder is None or coder.vocabulary != heads[0][0]:
                coder = Coder(heads[0][0])
            for (p, n, _), (_, _, told, documents, _), ids in zip(waiting, heads, coder.decode([h[4] for h in heads], [h[1] for h in heads])):
                if p != part:
                    part, number, before, count, crc = p, 0, 0, 0, 0
                    parts.clear()
                if n != number:
                    raise Damaged(f"part {p} lacks block {number}")
                if crc_of(ids) != told:
                    raise Damaged(f"ids of block {n} of part {p}")
                at = 0
                for doc_id, stop in documents:
                    crc, count = crc_of(ids[at:stop], crc), count + stop - at
                    if keep_ids:
                        parts.append(ids[at:stop])
                    for column, value in zip(out, (doc_id, p, before, count, crc, np.concatenate(parts).tobytes() if keep_ids else None)):
                        column.append(value)
                    before, count, crc, at = before + count, 0, 0, stop
                    parts.clear()
                if at < len(ids):
                    crc, count = crc_of(ids[at:], crc), count + len(ids) - at
                    if keep_ids:
                        parts.append(ids[at:])
                number += 1
            waiting.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "part", "first", "n_tokens", "ids_crc32", "ids"]
            m = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:m], kinds)], names[:m])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                waiting.append(row)
                if len(waiting) == LANES:
                    yield from flush()
        yield from flush()

    inorder = rows.select("part", "block", "record").repartition("part").sortWithinPartitions("part", "block")
    return inorder.mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """A row for each document of the folder ``path``: doc_id, start (ids before it), n_tokens, ids_crc32[, ids]."""
    ws = Workspace(spark, "idfile")
    found = ws.table(decoded(spark.read.schema(BLOCKS).parquet(path), keep_ids), "documents")
    # ids before each part: within groups of 1024 parts, and before each group
    sizes = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.expr("part div 1024"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(groups, "group")
    starts = ws.table(starts.select("part", (F.col("inner") + F.col("ahead")).alias("ahead")), "starts")
    out = found.join(starts, "part").withColumn("start", F.col("ahead") + F.col("first"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'ids').root}/files"
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
