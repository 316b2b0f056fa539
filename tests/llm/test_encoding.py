"""Prefix BPE and token shards beside the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallybook.llm import bpe, token_files

TEXTS = [
    "", "  ", "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>", "İSTANBUL ΑΣ ΣΑΣ H̱ ẖ", "it's WE'LL can't 'd''s 12345 a\x85b\xa0c\x1cd",
    "日本語 한글", "a" * 3000, "\x00\x01 \x7f ﻿", "² ½ Ⅷ ﬁ", "\U0001f389\U0001f389", "word. word, word., $. 1. é.",
]


def made_up(seed):
    draw = random.Random(seed)
    for _ in range(200):
        yield "".join(draw.choice("thinerandouoesatlyabcxyz '.,é") for _ in range(draw.randrange(1, 60)))


@pytest.mark.parametrize("text", [*TEXTS, *made_up(3)])
def test_same_ids_as_the_library(vocabulary, library, text):
    own = bpe.encoder(vocabulary)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encoding_of_odd_rows(odd_docs, no_docs, vocabulary, library):
    got = bpe.encoding_digests(odd_docs, vocabulary).collect()
    full = bpe.encode_documents(odd_docs, vocabulary).collect()
    want = []
    for row in odd_docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in full) == sorted((w[0] or 0, w[1]) for w in want)
    assert bpe.encoding_digests(no_docs, vocabulary).count() == 0


def test_pieces_beyond_the_memory(vocabulary, library, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_PIECES", 5)
    own = token_files.LibraryEncoder(vocabulary)
    texts = [t.encode() for t in [*TEXTS, *made_up(4)]]
    for _ in range(2):
        got = own.encode_all(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(40))
def test_shard_round_trip(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(0, 700, draw.integers(0, 6)).astype(np.uint32)
    ids = (draw.integers(0, 2 ** draw.integers(1, 32), lengths.sum()) * (draw.random(lengths.sum()) < draw.choice([1, 0.1]))).astype(np.uint32)
    if len(ids) and seed % 5 == 0:
        ids[0] = 2**32 - 1
    shard = token_files.Shard(token_files.pack(lengths, ids))
    assert (shard.blocks() == ids).all() and len(shard.blocks()) == len(ids)
    ends = np.cumsum(lengths)
    for k, length in enumerate(lengths):
        assert (shard.document(k) == ids[ends[k] - length : ends[k]]).all()


def test_outliers_are_exceptions():
    ids = np.array([5] * 255 + [2**31], dtype=np.uint32)
    shard = token_files.Shard(token_files.pack(np.array([256], dtype=np.uint32), ids))
    assert shard.widths.tolist() == [0] and shard.places.tolist() == [255] and (shard.blocks() == ids).all()


@pytest.mark.parametrize("shard_ids", [1, 700, 1 << 20])
def test_files(spark, odd_docs, vocabulary, library, tmp_path, shard_ids):
    out = str(tmp_path / "shards")
    token_files.write_token_files(odd_docs, out, vocabulary, shard_ids=shard_ids)
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: (r.part, r.shard, r.place))
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start, sums = 0, {}
    for row in got:
        assert row.start == start
        start += row.n_tokens
        sums.setdefault(row.doc_id, []).append((row.n_tokens, row.ids_crc32))
    want = {}
    for row in odd_docs.collect():
        tokens = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(row.doc_id, []).append((len(tokens), zlib.crc32(tokens.tobytes())))
    assert {k: sorted(v) for k, v in sums.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_files(spark, no_docs, vocabulary, tmp_path):
    token_files.write_token_files(no_docs, str(tmp_path / "none"), vocabulary)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_words_are_asked_once_whatever_follows_them(vocabulary, library):
    """Capitals beside letters beyond ASCII and any punctuation at a word's end ask nothing new of the library."""
    own, asked = token_files.LibraryEncoder(vocabulary), []

    class Counted:
        def encode_batch_fast(self, pieces, add_special_tokens):
            asked.extend(pieces)
            return library.encode_batch_fast(pieces, add_special_tokens=add_special_tokens)

    own.library = Counted()
    texts = ["Strand### strand café### é", "strand%%% STRAND. café$$$ Strand, ñ CAFé*** ###", "Strand? strand's (strand) é.", "H̱### harbour"]
    got = [np.frombuffer(g, "<u4").tolist() for t in texts for g in own.encode_all([t.encode()])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("strand") == asked.count("café") == 1 and not {"Strand", "STRAND", "strand%%%", "café$$$"} & {*asked}
