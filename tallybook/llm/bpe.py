"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

Every prefix of a word has one encoding, so one last token. An automaton finds the
tokens that end at each place; a token is the last one of the prefix if it is
compatible with the last token of the prefix before it, that is, if the two together
encode to just these two: built side by side, no merge across their border comes
first. Following the stored tokens back gives the ids.

Texts are cut at ASCII white space, which the vocabulary's rules always drop; a piece
of text is encoded once per worker while the memory of pieces has room. Pieces with
characters beyond Latin letters take the library's own normaliser and pre-tokeniser,
as those depend on its Unicode tables. Null and empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallybook.llm.common import map_batches, texts

#: How the vocabulary splits text and marks the end of a word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters that stand for themselves in byte-level vocabularies; the others follow from 256 on.
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))

MOST_PIECES = 400_000
MOST_PAIRS = 500_000
LATIN = re.compile("[\t-ͯ]*").fullmatch
ENDED = 0x10000


def byte_letters() -> list[str]:
    others = iter(range(256, 512))
    return [chr(b) if b in PLAIN_BYTES else chr(next(others)) for b in range(256)]


class PrefixBPE:
    """Encoder for one vocabulary file with merges and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.strings = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks = {(self.units(a), self.units(b)): r for r, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"])}
        self.ids = {self.units(t): i for t, i in model["vocab"].items()}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for (left, right), rank in self.ranks.items():
            self.parts.setdefault(left + right, (left, right, rank))
        if len(self.parts) != len(self.ranks):
            raise ValueError("a token of two merges")
        self.right_spines = {t: self.spine(t, True) for t in self.ids}
        self.left_spines = {t: self.spine(t, False) for t in self.ids}
        self.automaton = ahocorasick.Automaton()
        for token in self.tokens_that_encode_to_themselves():
            self.automaton.add_word(token, (len(token), self.ids[token]))
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.split = regex.compile(SPLIT)
        self.names = {i: t for t, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[str, str, int]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.blanks = False

    @staticmethod
    def units(token: str) -> str:
        """The token with its last letter marked if it ends a word."""
        bare = token.removesuffix(WORD_END)
        return token if bare == token or not bare else bare[:-1] + chr(ord(bare[-1]) + ENDED)

    def spine(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The tokens that stand at one edge of ``token`` while it is built, each with the rank that ends it."""
        edge, ended = [], float("inf")
        while True:
            edge.append((token, ended))
            if token not in self.parts:
                return edge[::-1]
            left_part, right_part, ended = self.parts[token]
            token = right_part if right else left_part

    def undisturbed(self, before: str, token: str) -> bool:
        """Whether both are built to their ends side by side, with no merge across their border before."""
        left, right = self.right_spines[before], self.left_spines[token]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            if x_ends == y_ends == float("inf"):
                return True
            across = self.ranks.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                return False  # of equal ranks the leftmost merges first
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two together encode to just these two."""
        left, right = self.names[before], self.names[token]
        known = (left, right) not in self.ranks and self.undisturbed(left, right)
        if len(self.pairs) < MOST_PAIRS:
            self.pairs[before << 32 | token] = known
        return known

    def tokens_that_encode_to_themselves(self) -> list[str]:
        """In order of rank, so parts come before the tokens made of them."""
        good = {t for t in self.ids if t not in self.parts}
        for token, (left, right, rank) in sorted(self.parts.items(), key=lambda item: item[1][2]):
            if any(self.parts[p][2] >= rank for p in (left, right) if p in self.parts):
                raise ValueError("a merge uses a token of a later merge")
            if left in good and right in good and self.undisturbed(left, right):
                good.add(token)
        return [t for t in self.ids if t in good]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        found = self.words.get(word)
        if found is None:
            letters = "".join([self.letters[b] for b in word.encode()])
            letters = letters[:-1] + chr(ord(letters[-1]) + ENDED)
            last, sizes = [-1] * len(letters), [0] * len(letters)
            known, compatible = self.pairs.get, self.compatible
            for end, (size, token) in self.automaton.iter(letters):
                if last[end] < 0:
                    if size <= end:
                        before = last[end - size]
                        fits = known(before << 32 | token)
                        if not (compatible(before, token) if fits is None else fits):
                            continue
                    last[end], sizes[end] = token, size
            ids, at = [], len(letters) - 1
            while at >= 0:
                ids.append(last[at])
                at -= sizes[at]
            found = tuple(reversed(ids))
            if len(self.words) < MOST_PIECES:
                self.words[word] = found
        return found

    def pre_tokens(self, piece: str) -> list[str]:
        if piece.isascii():
            return self.split.findall(piece.lower())
        if LATIN(piece):
            return self.split.findall(unicodedata.normalize("NFC", piece).lower())
        steps = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        values = {c: b for b, c in enumerate(self.letters)}
        return [bytes(values[c] for c in token).decode("utf-8", "replace") for token, _ in steps]

    def encode_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self.special_cut.split(piece) if self.special_cut and "<" in piece else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.pre_tokens(part):
                    ids.extend(self.encode_word(word))
        return ids

    def known_piece(self, piece: bytes) -> tuple[str, str, int]:
        """The piece's ids and tokens, written out, and their number."""
        ids = self.encode_piece(piece.decode("utf-8", "replace"))
        found = (" ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]), len(ids))
        self.blanks |= not ids
        if len(self.pieces) < MOST_PIECES:
            self.pieces[piece] = found
        return found

    def encode_text(self, text: bytes) -> tuple[str, str, int]:
        """Ids and decoded text of a whole text (both joined by one space), and the number of ids."""
        if text.isascii() and b"<|" not in text:
            text = text.lower()  # as the normaliser does; fewer different pieces
        get, known = self.pieces.get, self.known_piece
        parts = [get(p) or known(p) for p in text.split()]
        if self.blanks:  # pieces without ids, such as a wide space
            parts = [p for p in parts if p[2]]
        if not parts:
            return "", "", 0
        ids, decoded, counts = zip(*parts)
        return " ".join(ids), " ".join(decoded), sum(counts)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_text((text or "").encode())[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as the library does for vocabularies without a decoder."""
        return " ".join(self.strings[i] for i in ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every whole text."""

    def work(batch: pa.RecordBatch):
        bpe = encoder(path)
        rows = [bpe.encode_text(t) for t in batch.column(1).to_pylist()]
        ids = [np.array(r[0].split(), dtype=np.int32) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[2] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return map_batches(texts(df, id_col, text_col), work, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encoding_digests(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the written ids and of the decoded text, digested where they are made."""

    def work(batch: pa.RecordBatch):
        bpe = encoder(path)
        ids, decoded, count = [], [], []
        for text in batch.column(1).to_pylist():
            a, b, n = bpe.encode_text(text)
            ids.append(hashlib.sha256(a.encode()).hexdigest())
            decoded.append(hashlib.sha256(b.encode()).hexdigest())
            count.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(texts(df, id_col, text_col), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
