"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Texts are read as UTF-8; bytes that aren't are read as U+FFFD, which is then what is encoded and decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, default_vocabulary, id_and_text, table, utf8
from .encoding import blocks

NEVER = 1 << 30


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    A part is known by the position of its first byte. Leaf i of a segment tree has the rank of the pair that begins at
    part i, and every inner node the least rank below; the leftmost leaf with the root's rank is merged next. A merge
    changes two leaves and takes one out, each along one path to the root.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    width = 1 << (n - 2).bit_length()  # a leaf for each pair
    tree = [NEVER] * width + [get(piece[i : i + 2], NEVER) for i in range(n - 1)] + [NEVER] * (width - n + 1)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    while (least := tree[1]) != NEVER:
        k = 1
        while k < width:
            k += k
            if tree[k] != least:
                k += 1
        left = k - width
        right = following[left]
        after = following[right]
        following[left] = after
        changed = [(k, NEVER if after == n else get(piece[left : following[after]], NEVER))]
        if after < n:
            before[after] = left
            changed.append((width + right, NEVER))
        elif right < n - 1:
            changed.append((width + right, NEVER))
        if left:
            p = before[left]
            changed.append((width + p, get(piece[p:after], NEVER)))
        for k, rank in changed:  # point updates, each up to where the least below stays the same
            tree[k] = rank
            while k > 1:
                other = tree[k ^ 1]
                if other < rank:
                    rank = other
                k >>= 1
                if tree[k] == rank:
                    break
                tree[k] = rank
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern.

    With the pattern of the public files, a text is taken apart at single spaces between two characters that aren't white
    space: no match of that pattern goes on across such a space, which begins the next match. With any other pattern, the
    matches of the whole text are found. The ids of the parts, and of the matches within, are remembered in two bounded
    memories that are emptied when full; that changes speed alone.
    """

    def __init__(self, path: str, pattern: str, remembered: int = 800_000, longest: int = 32):
        import public_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._bytes = {str(rank): token for token, rank in self.ranks.items()}
        self._matches = regex.compile(pattern).finditer
        self._apart = pattern == public_tokenizers.PATTERN
        self._remembered, self._longest = remembered, longest
        self._pieces: dict[str, str] = {}
        self._parts: dict[str, str] = {}

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [int(i) for i in self.listed(text).split()]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join([self._bytes[str(i)] for i in ids])

    def listed(self, text: str) -> str:
        """The ids of a whole text in decimal, joined by spaces."""
        return " ".join([ids for ids in self._coded(text) if ids])

    def _learn(self, part: str) -> str:
        """A part's ids in decimal."""
        known, out = self._pieces, []
        for m in self._matches(part):
            match = m[0]
            if not match:
                continue
            coded = known.get(match)
            if coded is None:
                coded = " ".join(map(str, merge(match.encode("utf-8"), self.ranks)))
                if len(match) <= self._longest:
                    known[match] = coded
            out.append(coded)
        return " ".join(out)

    def _coded(self, text: str) -> list[str]:
        """The ids of the parts of a text in a row."""
        if len(self._pieces) > self._remembered:
            self._pieces.clear()
        if 2 * len(self._parts) > self._remembered:
            self._parts.clear()
        if not text:
            return []
        if not self._apart:
            return [self._learn(text)]
        words = text.split(" ")
        known = self._parts
        out = list(map(known.get, words))
        out[0] = self._learn(words[0]) if whole(words[0]) else None
        if None in out:
            for i, coded in enumerate(out):
                if coded is None:
                    word = words[i]
                    if not whole(word):
                        return self._joined(words)
                    if not (coded := known.get(word)):  # learned just now
                        coded = self._learn(" " + word)
                        if len(word) <= self._longest:
                            known[word] = coded
                    out[i] = coded
        return out

    def _joined(self, words: list[str]) -> list[str]:
        """The same where some words begin or end with white space: these stay in one part with their neighbours."""
        parts = [words[0]]
        for before, word in zip(words, words[1:], strict=False):
            safe = before and word and not before[-1].isspace() and not word[0].isspace()
            if safe:
                parts.append(" " + word)
            else:
                parts[-1] += " " + word
        return [self._learn(p) for p in parts if p]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes that these ids decode to."""
        listed = self.listed(text)
        ids = listed.split(" ") if listed else []
        decoded = b"".join(map(self._bytes.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def whole(word: str) -> bool:
    """Whether a word is there and neither begins nor ends with white space."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each rank file and Python worker."""
    return ByteBPE(path, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or default_vocabulary("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts; null and empty texts have no ids. Every row is encoded, repeated ones too."""
    settings = _settings(path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = codec(*settings)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "ids": [bpe.encode(t.decode("utf-8", "replace")) for t in utf8(batch.column("text"))]}

    return arrow_map(id_and_text(documents, id_col, text_col), "doc_id long, ids array<int>", each)


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids decode to nothing."""
    settings = _settings(path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = codec(*settings)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "decoded": [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), "doc_id long, decoded binary", each)


def round_trip_digests(documents: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes that they decode to."""
    settings = _settings(path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = codec(*settings)
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("doc_id")
            for i, j in blocks(texts):
                n, coded, decoded = zip(*[bpe.digest(t.decode("utf-8", "replace")) for t in texts[i:j]], strict=True)
                yield {"doc_id": ids.slice(i, j - i), "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded}

    return arrow_map(id_and_text(documents, id_col, text_col), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each)


def op7_byte_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes all ``documents``."""
    return round_trip_digests(table(spark, sf_dir, "documents"))
