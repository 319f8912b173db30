import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scanweave.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
RAW = open(PATH, "rb").read()
TOKENIZER = Tokenizer.from_file(PATH)
VOCABULARY = B.Vocabulary(RAW)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = []
    for doc_id, text in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(TOKENIZER.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def got(docs, words):
    df = B.digests(B.encode(docs, RAW, B.lexicon_of(docs, RAW, words), decoded=True))
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [None, "", " \n\t ", "Hello   World's they're 12345 !!?", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "a<|endoftext|>b <|startoftext|> c<|endoftext", "é a ́x y z\x1cq\x85w",
         "名前は日本 🙂🙂 x" * 3, "z" * 3000 + " " + "ab1!" * 2000, "'S'T'RE 'll", "​﻿  　 x y", "word " * 20000]


@pytest.mark.parametrize("words", [3, 500])
def test_cases(spark, words):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    assert got(docs, words) == brute(rows)
    assert got(docs.limit(0), words) == []


def test_decode_alone(spark):
    ids = TOKENIZER.encode("Some text, decoded.", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in B.decode(df, RAW).collect()} == {1: TOKENIZER.decode(ids), 2: "", 3: None}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs, 5000) == brute([(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60))
def test_any_text(text):
    import pyarrow as pa
    coder = B.Coder(VOCABULARY, B.Lexicon(B.compile_lexicon({"a": VOCABULARY.merge("a")})))
    assert coder.encode(pa.array([text]))[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_transducer():
    words = {w: [i, i + 1][: i % 3] for i, w in enumerate(["a", "ab", "abc", "bc", "c", "xbc", "nation", "station", "stations", "é"])}
    lexicon = B.Lexicon(B.compile_lexicon(words))
    names = [*words, "", "abcd", "stat", "z", "nations"]
    assert [lexicon.ids_of(k).tolist() if k >= 0 else None for k in lexicon.numbers(names)] == [words.get(n) for n in names]
