"""Token ids of many texts with a byte-level BPE tokenizer file.

The tokenizer's pre-tokens never share tokens, and texts repeat their pre-tokens. So texts are cut into
pre-tokens with NumPy (by character class, for all texts of a batch at once), distinct pre-tokens are
encoded by the `tokenizers` library, and ids are gathered. Texts that hold one of the tokenizer's special tokens
go through the library whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

OTHER, LETTER, NUMBER, WHITE = range(4)
MEMO = 1_000_000
#: What follows an apostrophe in the pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Character class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = name
    table[0xD800:0xE000] = OTHER
    return table


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each UTF-8 byte belongs to."""
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 0x3F for i in range(4)]
        first = data[lead].astype(np.int64)
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | b[1], np.where(first < 0xF0, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        of = table[point]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        for i in range(4):
            kind[lead[size > i] + i] = of[size > i]
    return kind


def cut(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. data: UTF-8 of all texts; first: where each non-empty text begins."""
    n = len(data)
    kind = kinds(data)
    begin = np.zeros(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin[first] = True
    text_begin = np.zeros(n + 1, bool)
    text_begin[first] = True
    text_begin[n] = True
    # white space before something else of the same text gives its last character away: a space joins what follows
    after = np.flatnonzero(begin & ~text_begin[:-1])
    after = after[(kind[after] != WHITE) & (kind[after - 1] == WHITE)]
    last = after - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    begin[last] = True
    begin[after[data[after - 1] == 32]] = False
    # contractions: a lone apostrophe that begins its token, and the letters after it
    lone = np.flatnonzero(data[:-1] == 39) if n > 1 else after[:0]
    lone = lone[begin[lone] & (kind[lone + 1] == LETTER) & ~text_begin[lone + 1]]
    if len(lone):
        padded = np.append(data, [0, 0])
        one, two = padded[lone + 1], np.where(text_begin[np.minimum(lone + 2, n)], 0, padded[lone + 2])
        size = np.zeros(len(lone), np.int64)
        for c in CONTRACTIONS:
            hit = one == ord(c[0]) if len(c) == 1 else (one == ord(c[0])) & (two == ord(c[1]))
            size[(size == 0) & hit] = len(c)
        lone, size = lone[size > 0], size[size > 0]
        begin[lone + 1] = False
        rest = lone + 1 + size
        rest = rest[rest < n]
        begin[rest] = True
    return np.flatnonzero(begin)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = special
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The entry of each word in the memo, which then holds all of them."""
        if len(self.words) + len(words) > MEMO:
            self._forget()
        entry = pc.index_in(words, value_set=self.words)
        missing = entry.is_null()
        new = words.filter(missing)
        entry = entry.to_numpy(zero_copy_only=False)
        if len(new):
            coded = self.tokenizer.encode(new.to_pylist(), is_pretokenized=True, add_special_tokens=False)
            size = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(new))
            entry = np.nan_to_num(entry).astype(np.int64)
            entry[missing.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate((self.flat, np.array(coded.ids, np.uint32)))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        return entry.astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large strings without nulls) as unsigned 32-bit integers, and where each text's end (len(texts) + 1 places)."""
        holds = np.zeros(len(texts), bool)
        for token in self.special:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._plain(texts)
        ids, ends = self._plain(pc.if_else(pa.array(holds), "", texts))
        parts = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if odd else ids[ends[i] : ends[i + 1]] for i, odd in enumerate(holds.tolist())]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, raw = texts.buffers()
        edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if edge[0] == edge[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        begin = cut(data, np.unique(edge[:-1][np.diff(edge) > 0]))
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data))
        coded = words.dictionary_encode()
        entry = self._learn(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        size = (self.at[1:] - self.at[:-1])[entry]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.at[entry] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, edge)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
