"""Ids of whole texts with the tokenizers library, one call per distinct piece of text instead of one per occurrence.

A byte-level BPE tokenizer first cuts a text by a fixed pattern (letters, digits, other signs, each with at most one space before;
white space; English contractions) and then merges inside each piece, so equal pieces have equal ids.  The cut is
made with numpy over code points; the library encodes each piece a worker has not met yet.  Texts with
code points from 0x250 on (whose classes depend on the Unicode version) go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from tripline.llm.text import prefix_hash, span_hash, splitmix

END_ID = 2
#: Pieces a worker remembers, and the first code point that is left to the library.
CACHE, PLAIN_LIMIT = 2_000_000, 0x250
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CACHES: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file lies; found at run time, also on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    out = np.full(PLAIN_LIMIT, _OTHER, np.uint8)
    for c in range(PLAIN_LIMIT):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = _SPACE
        elif chr(c).isalpha():
            out[c] = _LETTER
        elif chr(c).isnumeric():
            out[c] = _DIGIT
    return out


def cuts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces begin; ``code`` ends each text with code point 0 of kind 255, a piece of its own."""
    n = len(code)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = change.copy()
    # white space before something else: its last character is cut off, and joins what follows if it is a space
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != 255)
    begin |= last
    join = last & (code == 32)
    begin[1:][join[:-1]] = False
    # contractions: an apostrophe that begins a piece, and the letters after it
    quote = np.flatnonzero((code == 39) & begin)
    if len(quote):
        a = np.minimum(quote + 1, n - 1)
        b = np.minimum(quote + 2, n - 1)
        c1, c2 = code[a], code[b]
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        begin[a[one | two]] = False
        begin[b[one]] = True
        after = np.minimum(quote + 3, n - 1)
        begin[b[two]] = False
        begin[after[two]] = True
        # after a contraction a space still joins what follows; a letter or sign begins a new piece
    return np.flatnonzero(begin)


class Encoder:
    """One per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.kinds = np.concatenate((_classes(), np.array([255], np.uint8)))
        self.values = splitmix(np.arange(PLAIN_LIMIT, dtype=np.uint64))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first of each (one more than texts); code points below the limit only."""
        joined = "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        kind = self.kinds[code]
        kind[ends] = 255
        begin = cuts(code, kind)
        end = np.append(begin[1:], len(code))
        real = kind[begin] != 255
        start, end = begin[real], end[real]
        hashes = splitmix(span_hash(prefix_hash(self.values[code]), start, end) + (end - start).astype(np.uint64))
        which, unique = pd.factorize(hashes)
        unique = unique.astype(np.uint64)
        first = np.zeros(len(unique), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        where = self.find(unique)
        new = np.flatnonzero(where < 0)
        if len(new):
            got = self.whole([joined[start[first[i]] : end[first[i]]] for i in new])
            self.add(unique[new], got)
            where = self.find(unique)
        count, at = self.count[where][which], self.at[where][which]
        offset = np.cumsum(count) - count
        ids = self.ids[np.repeat(at - offset, count) + np.arange(count.sum())]
        pieces = np.searchsorted(start, np.concatenate(([0], ends + 1)))
        return ids, np.append(offset, len(ids))[pieces]

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, got: list[np.ndarray]) -> None:
        count = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(keys, kind="stable")
        to = np.searchsorted(self.keys, keys[order])
        self.ids = np.concatenate((self.ids, *got))
        self.keys, self.at, self.count = np.insert(self.keys, to, keys[order]), np.insert(self.at, to, at[order]), np.insert(self.count, to, count[order])

    def encode(self, texts: list[str | None], block_chars: int = 2 << 20) -> list[np.ndarray]:
        """Ids of each text as unsigned 16-bit numbers; None is empty."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        block: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if block:
                if len(self.keys) > CACHE:
                    self.clear()
                ids, first = self.plain([texts[i] for i in block])
                for k, i in enumerate(block):
                    out[i] = ids[first[k] : first[k + 1]]
                block.clear()
                size = 0

        odd: list[int] = []
        for i, t in enumerate(texts):
            if not t.isascii() and np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).max() >= PLAIN_LIMIT:
                odd.append(i)
                continue
            block.append(i)
            size += len(t)
            if size >= block_chars:
                flush()
        flush()
        if odd:
            for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
        return out


def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    if name not in _CACHES:
        _CACHES[name] = Encoder(tokenizer_path(name))
    return _CACHES[name]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
