"""Encoding, decoding, counting and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuslens.llm import packing, token_counts, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "a  b", "Hello  world's <|endoftext|> foo é 日本 1234 <|startoftext|>x  İSTΣ Σ", "a" * 5000, "$" * 999 + "a\x1cb \x1f\x85c",
       "don't I'VE 'LL", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "՘ab Ᲊx", "▁▁x ▁", "<s> </s> <unk> <0x0A>", " " * 100,
       "日本語 テスト 😀😀", "0.5,6.x,.y", "é.à,b", "\x00a", "x́y é"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def bpe():
    return word_bpe.WordBpe(WORDS, remembered=200)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(PIECES, remembered=200)


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PIECES)


def test_ids_and_decoded_texts_equal_the_library(bpe, library):
    r = random.Random(1)
    made = ["".join(r.choice("abcdefgh ABC.,'012é日\n<|>Σ") for _ in range(r.randint(0, 90))) for _ in range(500)]
    for text, ids in zip(ODD + made, bpe.encode(ODD + made)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library(text):
    bpe, library = word_bpe.codec(WORDS), Tokenizer.from_file(WORDS)
    assert next(bpe.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_the_library(text):
    assert token_counts.counter(PIECES).count(text) == len(SentencePieceProcessor(model_file=PIECES).encode(text))


def test_counts_equal_the_library(counter, model):
    r = random.Random(2)
    made = ["".join(r.choice(" \n\t.,aeéxX1-_'\"日<>s▁") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text in ODD + made:
        assert counter.count(text) == len(model.encode(text)), repr(text)


def test_round_trip_of_a_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (101, "a b", "y"), (101, "a b", "y"), (None, "c", None)]
    got = word_bpe.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string"), WORDS).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    encoded = word_bpe.encode(spark.createDataFrame([(1, "Hello you"), (2, None)], "doc_id bigint, text string"), WORDS)
    assert {r["doc_id"]: r["text"] for r in word_bpe.decode(encoded, WORDS).collect()} == {1: "hello</w> you</w>", 2: ""}


def test_count_table(spark, model):
    rows = [(1, "Hello you"), (2, None), (3, ""), (3, ""), (4, "a b " * 3000)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), PIECES).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PIECES).count() == 0


def check_packing(rows, capacity, pieces):
    """Every piece once, sequences gapless from 0 and within the capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(rows) == pieces
    return len(by_sequence)


def test_documents_are_cut_and_packed(spark, library):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "Stone", "xyzzy", "1"]) for _ in range(int(r.lognormvariate(3, 1.2))))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "the " * 300), (1003, "the " * 99), (1004, "a b"), (1004, "a b")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), WORDS, capacity=100).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = sum(-(-len(ids[i]) // 100) for i, _ in rows)
    used = check_packing(got, 100, pieces)
    assert used <= sum(len(ids[i]) for i, _ in rows) / 100 * 1.05 + 1
    for x in got:
        part = ids[x["doc_id"]][x["start"] : x["start"] + 100]
        assert x["start"] == 100 * x["piece"] and x["length"] == len(part)
        assert x["ids_crc32"] == zlib.crc32(np.array(part, "<u4"))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1))
def test_plans_use_every_document_once(histogram):
    patterns = packing.plan_bins(histogram, 40)
    used = {}
    for p in patterns:
        assert sum(size * n for size, n in p.parts) <= 40 and p.times >= 1
        for size, n in p.parts:
            used[size] = used.get(size, 0) + n * p.times
    assert used == histogram
    # no two bins that would fit into one
    fills = sorted(sum(s * n for s, n in p.parts) for p in patterns for _ in range(p.times))
    assert len(fills) < 2 or fills[0] + fills[1] > 40


def test_two_documents_replace_the_smallest():
    # greedy: 6 + 3 leaves 1; 2 + 2 instead of 3 fill the bin
    patterns = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert patterns[0].parts == [(6, 1), (2, 2)]


def test_workers_remember_for_one_operator_at_a_time():
    bpe = word_bpe.codec(WORDS)
    assert word_bpe.codec(WORDS) is bpe
    count = token_counts.counter(PIECES)
    assert token_counts.counter(PIECES) is count
    # the counter's start made the worker forget the codec, and the other way round
    assert word_bpe.codec(WORDS) is not bpe
    assert token_counts.counter(PIECES) is not count
