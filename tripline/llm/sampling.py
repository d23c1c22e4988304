"""Operator 4, SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling.

A text with its spaces written as U+2581, and one in front, is cut before each run of U+2581 and around control characters; no piece of the vocabulary crosses such a cut,
so the piece lattice of the text is a chain of the words' lattices.  A piece weighs exp(alpha * log p); p is the model's score for
unigram models, and for BPE models, whose scores are ranks, 1 / (rank + 2) up to a constant (Zipf's law).  A character without a piece of its own is
an edge of its UTF-8 byte pieces.  The pieces that end at a character are found in a trie of the pieces read backwards, from all characters side by side, and
only while something matches.  Forward filtering runs once per distinct word of a block, all words side by side; backward
sampling runs for all occurrences side by side.  The random numbers are a hash of row key, occurrence and step, so a row's sample depends on nothing
but its key, its text, the vocabulary and the seed.  Decoding joins pieces and bytes and gives the text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.text import blocks, prefix_hash, span_hash, splitmix
from tripline.llm.tokens import tokenizer_path

ALPHA, SEED, BLOCK = 1.0, 1, 1 << 19
_MARK, _LITERAL = 0x2581, 0x110000  # a U+2581 of the text itself is kept apart
_MODELS: dict[str, "Lattice"] = {}


def _length_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return splitmix(span_hash(prefix, start, end) + (end - start).astype(np.uint64))


def _trie(words: list[np.ndarray], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters 1 .. ``letters``, read backwards, as a double array.

    Letter c leads from state s to state base[s] + c if owner[base[s] + c] is s, and nowhere otherwise; the root is state 0.  Also the state of each word.
    """
    children: list[dict[int, int]] = [{}]
    parent, letter, last = [0], [0], []
    for word in words:
        s = 0
        for c in word[::-1].tolist():
            if c not in children[s]:
                children[s][c] = len(children)
                children.append({})
                parent.append(s)
                letter.append(c)
            s = children[s][c]
        last.append(s)
    # the root's children lie at 1 .. letters; states of several children look for room above, the largest first, and single children fill the gaps
    size = np.fromiter(map(len, children), np.int64, len(children))
    base = np.zeros(len(children), np.int64)
    free = np.ones(2 * (letters + len(children)), bool)
    free[: letters + 1] = False
    several = np.flatnonzero(size[1:] > 1) + 1
    lo = letters + 1
    for s in several[np.argsort(-size[several], kind="stable")].tolist():
        c = np.sort(np.fromiter(children[s], np.int64))
        while True:
            if lo + 512 + letters > len(free):
                free = np.concatenate((free, np.ones(len(free) + 512 + letters, bool)))
            at = np.flatnonzero(free[lo : lo + 512]) + lo
            fits = np.flatnonzero(free[at[:, None] + (c - c[0])].all(axis=1))
            if len(fits):
                break
            lo += 512
        base[s] = at[fits[0]] - c[0]
        free[base[s] + c] = False
    single = np.flatnonzero(size[1:] == 1) + 1
    gaps = np.flatnonzero(np.concatenate((free, np.ones(len(single), bool))))[: len(single)]
    base[single] = gaps - np.array([c for s in single.tolist() for c in children[s]], np.int64)
    slot = base[parent] + np.array(letter)
    room = int(max(base.max(), slot.max())) + letters + 1
    at_slot, owner = np.zeros(room, np.int64), np.full(room, -1)
    at_slot[slot] = base
    owner[slot[1:]] = slot[parent[1:]]
    return at_slot, owner, slot[last]


class Lattice:
    """A vocabulary's pieces; one per worker process."""

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        scores = np.array([model.get_score(i) for i in range(n)])
        unigram = (scores != np.round(scores)).any()
        self.values = splitmix(np.arange(0x110001, dtype=np.uint64))
        self.bytes_id = np.zeros(256, np.int32)
        self.piece: list[bytes] = [b""] * n
        words, ids = [], []
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(p[3:5], 16)
                self.bytes_id[b] = i
                self.piece[i] = bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[i] = p.replace("▁", " ").encode()
                if not any(ord(c) < 0x20 for c in p) and "▁" not in p.lstrip("▁"):
                    words.append(p)
                    ids.append(i)
        logp = scores if unigram else -np.log(np.maximum(-scores, 0) + 2)
        self.ids, self.weight = np.array(ids, np.int32), alpha * logp[ids]
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        alphabet = np.unique(code)
        self.letter = np.zeros(0x110001, np.int64)  # 0: in no piece
        self.letter[alphabet] = np.arange(1, len(alphabet) + 1)
        self.base, self.owner, state = _trie(np.split(self.letter[code], np.cumsum(size)[:-1]), len(alphabet))
        self.longest = int(size.max())
        # a state's piece (-1: none) and its weight; the root stands for a character without a piece
        self.ends, self.score = np.full(len(self.base), -1, np.int64), np.zeros(len(self.base))
        self.ends[state], self.score[state] = self.ids, self.weight
        self.score[0] = float(alpha * logp[ids].min() * 2)
        lengths = np.fromiter(map(len, self.piece), np.int64, n)
        self.at, self.size, self.data = np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(self.piece), np.uint8)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """A sampled segmentation of each text; ``keys`` are the rows' 64-bit seeds."""
        joined = "\n".join(["▁" + t.replace("▁", chr(0x10FFFF)).replace(" ", "▁") if t else "" for t in texts]) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # U+10FFFF is no character; where a text held it itself, it stays what it is
        lengths = np.fromiter((len(t) + (1 if t else 0) for t in texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths) - 1
        stand_in = np.flatnonzero(code == 0x10FFFF)
        if len(stand_in):
            owner = np.searchsorted(ends, stand_in)
            literal = np.array([texts[o][p - (ends[o] - lengths[o] + 1) - 1] == "▁" for o, p in zip(owner, stand_in, strict=True)])
            code[stand_in[literal]] = _LITERAL
        mark, control = code == _MARK, code < 0x20
        begin = control.copy()
        begin[1:] |= control[:-1] | (mark[1:] & ~mark[:-1])
        begin[0] = True
        begin[ends] = True
        begin[np.minimum(ends[:-1] + 1, len(code) - 1)] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(code))
        real = np.ones(len(start), bool)
        real[np.searchsorted(start, ends)] = False  # the newlines between texts
        start, end = start[real], end[real]
        first = np.searchsorted(start, np.concatenate(([0], ends + 1)))
        prefix = prefix_hash(self.values[code])
        which, unique = pd.factorize(_length_hash(prefix, start, end))
        at = np.zeros(len(unique), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]
        # nodes: positions 0 .. size of each word, all words' first positions first, longest words first; edges: pieces that end there, longest first
        size = (end - start)[at]
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        which, size, w_start = rank[which], size[order], start[at][order]
        count = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1 if len(size) else 1))
        node0 = np.cumsum(count) - count
        n_nodes = int(count.sum())
        depth = np.repeat(np.arange(len(count)), count)
        at = w_start[np.arange(n_nodes) - node0[depth]] + depth - 1  # a node's last character
        live = np.arange(len(size), n_nodes)
        letter = self.letter[code]
        state, char = np.zeros(len(live), np.int64), at[live]
        found = np.zeros(n_nodes, np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for length in range(1, self.longest + 1):
            # no need to look where a word begins: no piece goes on before its U+2581, and none has a control character
            to = self.base[state] + letter[char]
            ok = self.owner[to] == state
            if length == 1:
                lone = live[~ok | (self.ends[to] < 0)]
                parts.append((lone, found[lone], lone - node0[depth[lone]] + node0[depth[lone] - 1], np.zeros(len(lone), np.int64)))
                found[lone] = 1
            live, state, char = live[ok], to[ok], char[ok] - 1
            if not len(live):
                break
            hit = self.ends[state] >= 0
            node = live[hit]
            parts.append((node, found[node], node - node0[depth[node]] + node0[depth[node] - length], state[hit]))
            found[node] += 1
        edge0 = np.concatenate(([0], np.cumsum(found)))
        source, state = np.zeros((2, int(edge0[-1])), np.int64)
        for node, shorter, below, by in parts:
            e = edge0[node + 1] - 1 - shorter
            source[e], state[e] = below, by
        piece, weight = self.ends[state], self.score[state]
        piece[edge0[lone + 1] - 1] = -1 - code[at[lone]]  # the character's bytes
        # forward filtering, one position of all words at a time; an edge's share is of its node's total
        alpha, total, share = np.zeros(n_nodes), np.ones(n_nodes), np.zeros(len(source))
        for n, m in zip(node0[1:], np.append(node0, n_nodes)[2:], strict=True):
            a, b = edge0[n], edge0[m]
            head = edge0[n:m] - a
            value = alpha[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, head)
            share[a:b] = np.exp(value - np.repeat(top, found[n:m]))
            total[n:m] = np.add.reduceat(share[a:b], head)
            alpha[n:m] = top + np.log(total[n:m])
        share[edge0[len(size) + 1 :] - 1] = np.inf  # a node's last edge takes what rounding leaves
        # backward sampling, one piece of all occurrences at a time
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        seed = splitmix(keys[doc] + splitmix(np.arange(len(which), dtype=np.uint64) - first[doc].astype(np.uint64)))
        live = np.arange(len(which))
        node = node0[size[which]] + which
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            seed = splitmix(seed)
            u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            e = edge0[node]
            left = u * total[node]
            on = np.flatnonzero(left > share[e])
            while len(on):
                left[on] -= share[e[on]]
                e[on] += 1
                on = on[left[on] > share[e[on]]]
            taken.append((live, piece[e]))
            node = source[e]
            going = node >= len(size)
            live, node, seed = live[going], node[going], seed[going]
        steps = np.zeros(len(which), np.int64)
        for who, _ in taken:
            steps[who] += 1
        last = np.cumsum(steps) - 1
        out = np.zeros(int(steps.sum()), np.int64)
        for k, (who, got) in enumerate(taken):
            out[last[who] - k] = got
        bounds = np.concatenate(([0], np.cumsum(steps)))[first]
        # characters without a piece become their bytes
        odd = np.flatnonzero(out < 0)
        if len(odd):
            lone, kind = np.unique(-1 - out[odd], return_inverse=True)
            parts = [("▁" if c == _LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in lone.tolist()]
            n_bytes = np.fromiter(map(len, parts), np.int64, len(parts))
            data = self.bytes_id[np.frombuffer(b"".join(parts), np.uint8)]
            n = np.ones(len(out), np.int64)
            n[odd] = n_bytes[kind]
            new_at = np.concatenate(([0], np.cumsum(n)))
            wide = np.repeat(out, n)
            step = np.arange(int(n[odd].sum())) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])
            wide[np.repeat(new_at[odd], n[odd]) + step] = data[np.repeat((np.cumsum(n_bytes) - n_bytes)[kind], n[odd]) + step]
            out, bounds = wide, new_at[bounds]
        return [out[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of sequences of ids."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self.size[flat]
        end = np.cumsum(size)
        data = self.data[np.repeat(self.at[flat] - end + size, size) + np.arange(int(size.sum()))].tobytes()
        at = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum([len(x) for x in ids])))]
        return [data[a + (b > a) : b] for a, b in zip(at, at[1:], strict=False)]  # without the space in front


def lattice(name: str = "piece_bpe_32k.model", alpha: float = ALPHA) -> Lattice:
    if (name, alpha) not in _MODELS:
        _MODELS[name, alpha] = Lattice(tokenizer_path(name), alpha)
    return _MODELS[name, alpha]


def encode(docs: DataFrame, seed: int = SEED, vocabulary: str = "piece_bpe_32k.model", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, ids): a sampled segmentation of every row's text, as little-endian signed 32-bit numbers, reproducible by doc_id and ``seed``.

    Null and empty texts have no ids; a null doc_id has a key of its own; repeated rows are sampled alike; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = splitmix(batch.column(0).fill_null(-1).to_numpy().view(np.uint64) ^ splitmix(np.array([seed], np.uint64)))
            for b in blocks(batch.column(1), BLOCK):
                got = lattice(vocabulary, alpha).sample(texts[b.lo : b.hi], keys[b.lo : b.hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.size), pa.array([x.astype("<i4").tobytes() for x in got], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Add ``text``, the UTF-8 bytes that ``ids`` stand for."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = lattice(vocabulary).decode([np.frombuffer(x.as_buffer(), "<i4") if x.is_valid else np.zeros(0, np.int32) for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in encoded.dtypes) + ", text binary")
