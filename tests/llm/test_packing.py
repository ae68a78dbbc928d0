import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rubricon.llm import packing
from rubricon.llm.vocabulary import Words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_fullest_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(60):
        stock = {rng.randint(1, 25): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        sums = (sum(k * n for k, n in zip(stock, ns)) for ns in product(*(range(n + 1) for n in stock.values())))
        used = packing.fullest(stock, room)
        assert all(n <= stock[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def first_fit_decreasing(stock, size):
    room = []
    for length in sorted(stock, reverse=True):
        for _ in range(stock[length]):
            at = next((i for i, r in enumerate(room) if r >= length), None)
            if at is None:
                room.append(size - length)
            else:
                room[at] -= length
    return len(room)


def test_plan_places_every_piece_once():
    rng = random.Random(4)
    stock = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    table = packing.plan(stock, 64)
    filled = defaultdict(list)
    for length, n in stock.items():
        rows = np.flatnonzero(table["length"] == length)
        for at in range(n):
            r = rows[np.searchsorted(table["first"][rows], at, side="right") - 1]
            k, m = at - table["first"][r], table["multiplicity"][r]
            filled[table["bin"][r] + k // m].append((table["offset"][r] + (k % m) * length, length))
    assert sum(map(len, filled.values())) == sum(stock.values())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= 1.02 * first_fit_decreasing(stock, 64)


def check(rows, out):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want.append((i, at // 2048, at, len(part) // 4, zlib.crc32(part)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_odd_rows(documents, odd_rows):
    check(odd_rows, packing.best_fit(documents(odd_rows), PATH).collect())


def test_words_equal_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = ["it's DON'T we'Ll 12ab", "<|endoftext|>x <|startoftext|>", "á ﬁ ＡＢ Ω…", "ÀÉ×÷ßÿ'S", "\x1c\x85 a\xa0b", "日本語 text 🙂🙂"]
    rows += [(-i, t) for i, t in enumerate(odd, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.best_fit(docs, PATH).collect()
    assert check(rows, out) <= 1.01 * sum(r.length for r in out) / 2048 + 1


def test_empty_table(documents):
    assert packing.best_fit(documents([]), PATH).collect() == []


def test_few_words_are_kept():
    words, plain = Words(PATH), Words(PATH)
    text = " ".join(f"w{i}" for i in range(200_000))
    assert words.encode(text) == words.encode(text)
    assert len(words.known) + len(words.older) <= 160_000
    words.CACHE = 3
    again = ["alpha Beta gamma", "Beta delta eps zeta eta", "alpha x" + "y" * 70, "Beta alpha"]
    assert [words.encode(t) for t in again] == [plain.encode(t) for t in again]
    assert len(words.known) <= 3 and len(words.older) <= 160_000


def test_batches_to_python_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(48, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 1 << 19).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        spark.conf.unset(key)
        packing.pieces(docs, PATH)
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 8 << 20
        spark.conf.set(key, "16m")
        packing.pieces(docs, PATH)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, before)
