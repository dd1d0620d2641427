"""Token files: exact round trips, damage, and the query's columns against plain encoding."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forestflux.llm import tokens
from forestflux.llm.queries import tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 1000])
def test_round_trip(n):
    r = np.random.default_rng(n)
    for ids, nibbles in ((r.integers(0, 65536, n), 4), (np.full(n, 7), 4), (r.integers(0, 5, n), 4), (r.integers(0, 1 << 20, n), 6)):
        ids = ids.astype(np.uint32)
        words = tokens.encode_blocks(ids, nibbles, 256)
        assert (tokens.decode_blocks(words, n, nibbles, 256) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(0).integers(0, 300, 1024).astype(np.uint32)
    words = tokens.encode_blocks(ids, 4, 256)
    assert (tokens.decode_blocks(words[2:3], 256, 4, 256) == ids[512:768]).all()


def test_damage_is_found():
    ids = np.random.default_rng(0).integers(0, 50257, 700).astype(np.uint32)
    data = bytearray(tokens.pack(np.array([1, 2]), np.array([False, False]), np.array([300, 400]), ids, 4))
    assert (tokens.unpack(bytes(data))[3] == ids).all()
    for at in (12, len(data) - 400):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokens.unpack(bytes(bad))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'., \t\n\r 　é1$<|endoftext|>日"), max_size=40), max_size=6))
def test_pieces_equal_whole_texts(texts):
    e = tokens.encoder(tokenizer_path())
    ids, n = e.encode([t.encode() for t in texts], 2)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_query_columns(docs):
    df, rows = docs
    e = tokens.encoder(tokenizer_path())
    got = sorted(map(tuple, tokens.encode_and_read(df, tokenizer_path()).collect()), key=lambda x: x[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        ids = np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(docs):
    assert tokens.encode_and_read(docs[0].limit(0), tokenizer_path()).count() == 0


def test_files_sort_by_number():
    names = ["part-1000000-0000.tok", "part-999999-0001.tok", "part-999999-0000.tok", "part-000002-0010.tok", "part-000002-10000.tok"]
    assert sorted(names, key=tokens._numbers) == [names[3], names[4], names[2], names[1], names[0]]


def test_coded_words_stay():
    """Files of earlier versions can be read: the coded words of given ids are fixed, hits, misses and a short last block among them."""
    r = np.random.default_rng(4)
    ids = np.where(r.random(3000) < 0.5, np.arange(3000) % 7, r.integers(0, 65536, 3000)).astype(np.uint32)
    assert [zlib.crc32(b"".join(w.astype("<u2").tobytes() for w in tokens.encode_blocks(ids, n, 256))) for n in (4, 6)] == [3006655907, 4109883539]


def test_words_are_encoded_once_whatever_signs_follow():
    """Pieces are words and signs, so their number does not grow with the combinations of both."""
    e = tokens.Encoder(tokenizer_path())
    words, signs = [f"word{'abcdefghij'[i]}é" for i in range(10)], [",", ".", "!", "?", ";", ":", ")", '"', "%%%", "12"]
    text = " ".join(w + s for w in words for s in signs)
    ids, n = e.encode([text.encode()], 2)
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids + [2] and n.tolist() == [len(ids)]
    assert len(e.known) <= len(words) + len(signs) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZésreS'19.,_×÷ÿĀɀ²٣🙂’ \t\n\v\x00\x1c\x7f\x85"), max_size=30), max_size=6))
def test_cuts_within_words(texts):
    """Letters, digits, signs, apostrophes and characters of several bytes side by side."""
    e = tokens.encoder(tokenizer_path())
    ids, n = e.encode([t.encode() for t in texts], 2)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    """The pieces kept are bounded; a text that needs more than are kept is still encoded whole."""
    monkeypatch.setattr(tokens, "_CACHE_PIECES", 3)
    e = tokens.Encoder(tokenizer_path())
    for text in ("one two three", "four five six seven", "one two three", "one two nine ten"):
        ids, _ = e.encode([text.encode()], 2)
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids + [2]
