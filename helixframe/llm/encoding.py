"""Token ids of whole texts by a public word BPE, for operators that need lengths or digests of encoded documents.

The vocabulary lower-cases, drops white space and never merges across it or between its pre-tokens, so a text's ids are
its pre-tokens' ids in a row. A block of texts is cut into pre-tokens at once, by the classes of its bytes; the distinct
ones are looked up in a table of those seen before, and the rest are encoded by the tokenizers library, many to a call, as
a call takes several times longer than the pre-token in it; the ids that end one tell them apart. Only ASCII and U+00C0 to U+00FF are cut here: a white-space delimited chunk with any other byte, an apostrophe (contractions), a special
token's string or a very long pre-token goes to the library as a whole. A file whose normaliser, pre-tokenizer or
added tokens are others than those that this cutting stands for is left to the library wholly. The ids are those of the
library's plain call without special tokens added, in which the strings of special tokens that a text holds become them.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

SPACE, LETTER, DIGIT, OTHER = range(4)
#: Pre-tokens of up to this many bytes are cut here, as this many 64-bit words.
WORDS = 4
LONGEST = 8 * WORDS
#: So many pre-tokens are one text to the library.
TOGETHER = 8192

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = LETTER
_CLASS[48:58] = DIGIT
_CLASSES = _CLASS.tobytes()
_LEAD = 0xC3  # of U+00C0 to U+00FF; × and ÷ among them aren't letters
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


#: What the cutting stands for. The normaliser and the pre-tokenizer of the vocabulary file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


def cut_here(path: str) -> tuple[bool, list[bytes], np.ndarray | None]:
    """Whether a tokenizer file splits texts as this module does, the strings of its added tokens, and which ids end a pre-token.

    The last is None for vocabularies that don't mark the end of a pre-token.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = told.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].isascii() and not any(c.isspace() for c in t["content"]) for t in added)
    same = told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == _PRE_TOKENIZER and not told.get("truncation") and not told.get("padding")
    model, ends = told["model"], None
    if suffix := model.get("end_of_word_suffix"):
        ends = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in added)]), bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    return plain and same and model["type"] == "BPE" and not model.get("dropout"), [t["content"].encode() for t in added], ends


class Encoder:
    """Encodes blocks of texts; what it remembers is bounded and emptied when full, which changes speed alone."""

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._plain, self._special, self._ends = cut_here(path)
        self._remembered = remembered
        self._forget()

    def _forget(self) -> None:
        """The table: key, bytes and words of each pre-token, and where its ids lie; slots have a row by the high bits of its key.

        Row 0 is no pre-token's: a slot of 0 is free.
        """
        self._keys, self._size, self._words = np.zeros(1, np.uint64), np.zeros(1, np.uint8), np.zeros((1, WORDS), np.uint64)
        self._start, self._count, self._ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self._slots = np.zeros(1 << 20, np.int32)

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each); the library's results are held for some texts at a time."""
        ids, counts = [np.empty(0, np.uint32)], []
        for k in range(0, len(texts), 2048):
            found = [e.ids for e in self._tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[k : k + 2048]], add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter((i for each in found for i in each), np.uint32))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _of_pre_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library`, for pre-tokens cut here, many to a call; should one not be one to the library, each by itself."""
        if self._ends is None:
            return self._library(words)
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            found = np.array(self._tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self._ends[found])
            if len(ends) == len(part) and ends[-1] == len(found) - 1:
                n = np.diff(ends, prepend=-1)
            else:
                found, n = self._library(part)
            ids.append(found)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _pieces(self, raw: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and begin, length and kind (True: for the library) of each piece of text between white space."""
        kind = np.frombuffer(text.translate(_CLASSES), np.uint8)
        space = kind == SPACE
        wide = raw >= 128
        follows = np.concatenate(([False], raw[:-1] == _LEAD))
        odd = (raw == 39) | (wide & ~follows & (raw != _LEAD)) | (follows & ((raw == 0x97) | (raw == 0xB7)))
        for token in self._special:
            at = text.find(token)
            while at >= 0:
                odd[at] = True
                at = text.find(token, at + 1)
        low = np.frombuffer(bytearray(text.lower()), np.uint8)
        low[follows & (raw >= 0x80) & (raw <= 0x9E)] += 32
        change = np.concatenate(([True], kind[1:] != kind[:-1]))
        cut = change | (kind == DIGIT)
        begins = cut & ~space
        at = np.flatnonzero(begins)
        chunk = np.cumsum(np.concatenate(([True], space[:-1]))[at])  # number of the white-space delimited chunk
        ends = np.flatnonzero(np.append(cut, True)[1:]) + 1
        ends = ends[~space[ends - 1]]
        long = ends - at > LONGEST
        strange = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 1, bool)
        strange[chunk[np.searchsorted(at, np.flatnonzero(odd & ~space), "right") - 1]] = True
        strange[chunk[long]] = True
        library = strange[chunk]
        if library.any():  # one piece for each such chunk
            first = np.concatenate(([True], chunk[1:] != chunk[:-1]))
            last = np.concatenate((chunk[1:] != chunk[:-1], [True]))
            ends_of = np.zeros(len(strange), np.int64)
            ends_of[chunk[last]] = ends[last]
            keep = ~library | first
            ends = np.where(library, ends_of[chunk], ends)[keep]
            at, library = at[keep], library[keep]
        return low, at, ends - at, library

    def counts(self, texts: list[bytes]) -> list[int]:
        """How many ids each UTF-8 text has."""
        if not texts:
            return []
        if not self._plain:
            return self._library(texts)[1].tolist()
        _, count, _, upto = self._found(texts)
        return np.diff(np.concatenate(([0], np.cumsum(count)))[upto]).tolist()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        if not self._plain:
            ids, counts = self._library(texts)
            ends = np.cumsum(counts)
            return [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
        start, count, ids, upto = self._found(texts)
        total = np.cumsum(count)
        every = np.repeat(start - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)
        out = ids[every].astype("<u4").tobytes()
        upto = np.concatenate(([0], total))[upto].tolist()
        return [out[4 * a : 4 * b] for a, b in zip(upto, upto[1:], strict=False)]

    def _found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of the ids of each piece of the texts, the ids that these are places in, and the pieces before each text and the end."""
        text = b"\n".join([*texts, b""])
        raw = np.frombuffer(text, np.uint8)
        low, at, size, library = self._pieces(raw, text)
        begin_of_text = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(self._keys) > self._remembered:
            self._forget()
        plain = ~library
        start[plain], count[plain], ids = self._looked_up(low, at[plain], size[plain])
        if library.any():
            where = np.flatnonzero(library)
            chunks = [text[a : a + n] for a, n in zip(at[where].tolist(), size[where].tolist(), strict=True)]
            different = list(dict.fromkeys(chunks))
            found, counts = self._library(different)
            place = dict(zip(different, zip((len(ids) + np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True), strict=True))
            start[where], count[where] = np.array([place[c] for c in chunks]).T
            ids = np.concatenate((ids, found))
        return start, count, ids, np.searchsorted(at, begin_of_text)

    def _rows(self, key: np.ndarray) -> np.ndarray:
        """The row of each key in the table, 0 if it has none; a slot taken by another key sends on to the next."""
        slot = (key >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)
        row = self._slots[slot]
        left = np.flatnonzero((self._keys[row] != key) & (row > 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self._slots)
            row[left] = self._slots[slot[left]]
            left = left[(self._keys[row[left]] != key[left]) & (row[left] > 0)]
        return row

    def _put(self, key: np.ndarray, row: np.ndarray) -> None:
        """Takes a free slot for each of these different keys, of which the table has none."""
        slot = (key >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)
        while len(row):
            free = self._slots[slot] == 0
            self._slots[slot[free]] = row[free]
            left = self._slots[slot] != row  # of several rows for a slot the last has it
            row, slot = row[left], (slot[left] + 1) % len(self._slots)

    def _looked_up(self, low: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of the ids of each pre-token, and the ids that these are places in.

        A pre-token's key is a hash of its words; equal bytes are what counts, so two pre-tokens with one key are told
        apart: the one that isn't in the table goes to the library each time.
        """
        padded = np.concatenate((low, np.zeros(LONGEST + 8, np.uint8)))
        from_byte = np.ndarray((len(low) + LONGEST,), "<u8", padded.data, strides=(1,))
        words = np.zeros((len(at), WORDS), np.uint64)
        key = size.astype(np.uint64) * _MIX[0]
        having = [np.flatnonzero(size > 8 * k) if k else slice(None) for k in range(WORDS)]  # a word there
        for k, here in enumerate(having):
            words[here, k] = from_byte[at[here] + 8 * k] & _MASK[np.minimum(size[here] - 8 * k, 8)]
            key[here] = (key[here] ^ words[here, k]) * _MIX[k]
            key[here] ^= key[here] >> np.uint64(29)
        row = self._rows(key)
        absent = np.flatnonzero(row == 0)
        if len(absent):
            new = absent[np.unique(key[absent], return_index=True)[1]]
            low_bytes = low.tobytes()
            ids, counts = self._of_pre_tokens([low_bytes[a : a + n] for a, n in zip(at[new].tolist(), size[new].tolist(), strict=True)])
            self._start = np.concatenate((self._start, len(self._ids) + np.cumsum(counts) - counts))
            self._count = np.concatenate((self._count, counts))
            self._size = np.concatenate((self._size, size[new].astype(np.uint8)))
            self._words = np.concatenate((self._words, words[new]))
            self._keys = np.concatenate((self._keys, key[new]))
            self._ids = np.concatenate((self._ids, ids))
            rows = np.arange(len(self._keys) - len(new), len(self._keys), dtype=np.int32)
            if 2 * len(self._keys) > len(self._slots):
                self._slots = np.zeros(4 << len(self._keys).bit_length(), np.int32)
                rows = np.arange(1, len(self._keys), dtype=np.int32)
            self._put(self._keys[rows], rows)
            row[absent] = self._rows(key[absent])
        start, count, pool = self._start[row], self._count[row], self._ids
        other = self._size[row] != size
        for k, here in enumerate(having):
            other[here] |= self._words[row[here], k] != words[here, k]
        if len(clash := np.flatnonzero(other)):
            low_bytes = low.tobytes()
            ids, counts = self._of_pre_tokens([low_bytes[a : a + n] for a, n in zip(at[clash].tolist(), size[clash].tolist(), strict=True)])
            start[clash], count[clash] = len(pool) + np.cumsum(counts) - counts, counts
            pool = np.concatenate((pool, ids))
        return start, count, pool


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def blocks(texts: list[bytes], most: int = 1_000_000):
    """Index ranges of ``texts`` of about ``most`` bytes, so that the parts of a batch held at once stay small."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
