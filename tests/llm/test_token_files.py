import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scanweave.llm import token_files as T
from scanweave.llm.byte_coder import ByteCoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
RAW = open(PATH, "rb").read()
TOKENIZER = Tokenizer.from_file(PATH)
CODER = ByteCoder(RAW)


def brute(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def got(spark, docs):
    return sorted((tuple(r) for r in T.read_summary(spark, T.write_ids(docs, RAW)).collect()), key=repr)


TEXTS = [None, "", " ", "a b", " lead", "trail ", "two  blanks", "a\n b\t c", "x<|endoftext|>y <|endoftext|> z", "it's we're 12 345 #!", "é 名前 🙂 ok", "w" * 5000, "long words " * 30000, "a  b", "tab\tin side"]


def test_cases(spark):
    rows = list(enumerate(TEXTS)) + [(3, "a b"), (3, "again"), (None, "no id"), (-5, "neg")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int")
    assert got(spark, docs) == brute(rows)
    assert got(spark, docs.limit(0)) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = T.write_ids(docs, RAW)
    assert sorted((tuple(r) for r in T.read_summary(spark, path).collect()), key=repr) == brute(rows)
    flat = [x for i, t in sorted(rows) for x in [*TOKENIZER.encode(t, add_special_tokens=False).ids, 0]]
    asked = [0, 1, 777, 65536, len(flat) - 1, len(flat) + 5]
    found = {r.position: r.id for r in T.ids_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()}
    assert found == {p: flat[p] for p in asked if p < len(flat)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'é\n\t 1! <|endoftext|>"), max_size=30), min_size=1, max_size=6))
def test_pieces(texts):
    assert [x.tolist() for x in CODER.encode(pa.array(texts))] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000))
def test_codes(ids):
    codes = T.Codes(T.pack(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids and [codes[i] for i in range(len(ids))][:600] == ids[:600]
    if ids:
        assert codes[len(ids) - 1] == ids[-1]


def test_pieces_are_learnt_in_blocks_and_forgotten(monkeypatch):
    import random

    import pyarrow as pa
    from scanweave.llm import byte_coder

    monkeypatch.setattr(byte_coder, "MEMO", 5)
    rng = random.Random(3)
    words = ["a", "b<|", "<|endoftext|>", "x<|endoftext|>y", "é", "12", "　", "", "日本", "\tq", "can't", "z\n", "\x1c", "w" * 300]
    coder, library = byte_coder.ByteCoder(RAW), ByteCoder(RAW).tokenizer
    for _ in range(6):
        texts = ["", " ", "<|endoftext|> a"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(60)]
        got = [list(map(int, ids)) for ids in coder.encode(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(coder.known) <= max(5, len(words))
