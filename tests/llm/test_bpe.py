"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskframe.llm import bpe, queries
from riskframe.llm.bpe import WordBpe, decode, encode

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return WordBpe(PATH)


def same(own, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = own.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    assert got == want
    assert own.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_query_matches_library(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.QUERIES["op3_bpe"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_awkward_texts(own, library):
    same(own, library, [
        "", " ", "aaaa aaaaa aaaaaaaaaaaaaaaaaaaaa", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ǅ ﬀ ẞ", "don't WE'LL 'tis it's", "é ẛ̣",
        "<|endoftext|>a<|startoftext|> b <|endoftext", "x<|endoftext|><|endoftext|>y", "日本語 한국어 한", "a b　c d\x85e\x1cf\x00g",
        "👍🏽👨‍👩‍👧 ‍﻿", "1234567 ²³ ½ Ⅷ", "___ --- !!! \t\r\n\x0b\x0c", "\U0001d400\U0010ffff", "É" * 50 + "z" * 5000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2fff), st.sampled_from("aetn 's'll\n<|>"))), max_size=5))
def test_random_texts(own, library, texts):
    same(own, library, texts)


def test_random_words(own, library):
    rng = random.Random(4)
    syllables = ["th", "e", "in", "ing", "er", "aa", "a", "ß", "ö", "'t", "1", " "]
    same(own, library, ["".join(rng.choices(syllables, k=rng.randint(0, 400))) for _ in range(200)])


def test_edge_rows(rows, library):
    long = "word " * 300_000
    df = rows("doc_id long, text string, ids string", (1, None, "x"), (1, "", "x"), (None, "Hi there", "x"), (3, long, "x"))
    coded = encode(df, "doc_id", "text", PATH)
    got = sorted(((r.id, list(r.ids)) for r in coded.collect()), key=lambda r: (r[0] or 0, len(r[1])))
    assert [x[1] for x in got] == [library.encode("Hi there").ids, [], [], library.encode(long).ids]
    texts = {r.id: r.text for r in decode(coded, "id", "ids", PATH).collect()}
    assert texts[1] == "" and texts[None] == library.decode(library.encode("Hi there").ids)
    nothing = rows("id long, ids array<int>", (5, None), (6, [10**6, -1, 0]))
    assert sorted((r.id, r.text) for r in decode(nothing, "id", "ids", PATH).collect()) == [(5, ""), (6, "!")]
    assert encode(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_memory_forgets_what_is_met_least():
    own, memory = WordBpe(PATH), bpe.Memory()
    want = own.encode(["the cat", "the dog the cat"])
    own.encode(["the the cat", "the dog"], memory)
    memory.shrink(2)
    assert list(memory.number) == ["cat", "the"] and memory.met.tolist() == [0, 1]
    got = own.encode(["the cat", "the dog the cat"], memory)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
