import random

import numpy as np
import pandas as pd
import pytest

from rubricon.llm import bpe
from rubricon.llm.vocabulary import ByteLevel

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_tree_concatenation_equals_one_pass():
    codec, rng = ByteLevel.of(PATH), random.Random(6)
    for alphabet in ("ab", "the andingerion", "aé日🙂", "0123456789"):
        raw = "".join(rng.choices(alphabet, k=30_000)).encode()
        parts = [codec.merge(h) for h in bpe.halves(raw)]
        assert len(parts) > 4
        assert bpe.concatenated(parts, codec) == codec.merge(raw)


def test_leaves_cover_the_text():
    rng = random.Random(7)
    text = "".join(rng.choices([" ", "\n", "\t", "a", "bc", "é", "<|endoftext|>", "x" * 9000, "1" * 9000], k=400))
    assert b"".join(raw for _, _, raw in bpe.leaves(text, ByteLevel.of(PATH).parts)).decode() == text


def test_documents_are_joined_at_seams(spark, library, monkeypatch):
    """Texts like the driver's of more than a leaf go through joins; their windows agree early."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 8192").collect()
    codec, joins, windows = ByteLevel.of(PATH), [], []
    seamed, encode = bpe.seamed, codec.encode

    def counted(a, b, codec):
        joins.append((len(a), len(b)))
        return seamed(a, b, codec)

    monkeypatch.setattr(bpe, "seamed", counted)
    for d in docs:
        rows = [(1, 1, i, grp, single, np.array(codec.merge(raw) if single else encode(raw.decode()), "<u4").tobytes()) for i, (grp, single, raw) in enumerate(bpe.leaves(d.text, codec.parts))]
        part = pd.DataFrame(rows, columns=["id", "mark", "leaf", "grp", "single", "ids"])
        codec.encode = lambda t: windows.append(len(t)) or encode(t)
        try:
            (ids,) = bpe._tree(PATH)(part)["ids"]
        finally:
            del codec.encode
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(d.text, add_special_tokens=False).ids
    assert len(joins) >= len(docs) > 5
    assert np.mean(windows) < 200


def check(spark_rows, df, library):
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in spark_rows), key=str)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe.decoded(df, PATH).collect()]
    assert sorted(got, key=str) == want


def test_odd_rows(documents, odd_rows, library):
    check(odd_rows, bpe.encoded(documents(odd_rows), PATH), library)


def test_long_texts_go_through_the_tree(documents, library):
    rng = random.Random(8)
    pieces = [" ", "  ", "\n", "\t", " \t ", "word", "don't", "é", "<|endoftext|>", "q" * 9000, "ab1" * 5000, "日本" * 3000, "\x1c", "\xa0"]
    rows = [(i, "".join(rng.choices(pieces, k=60))) for i in range(6)]
    rows += [(99, rows[0][1]), (0, rows[0][1]), (50, "a b " * 20_000)]
    check(rows, bpe.encoded(documents(rows), PATH, leaf_chars=500), library)


def test_empty_table(documents):
    assert bpe.decoded(bpe.encoded(documents([]), PATH), PATH).collect() == []
