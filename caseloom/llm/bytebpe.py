"""Token ids of a byte-level BPE tokenizer file for whole Arrow batches, equal to those of the tokenizers library.

The library splits a text into pieces (a word with the space before it, digits, signs, white space) and merges bytes
inside each.  Here numpy finds the pieces of many texts at once, and each different piece is encoded once by the
library and then kept in a table of bounded size.  Texts with characters beyond Latin, with apostrophes (contractions)
or with "<|" (special tokens) go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from .textnum import mix

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = 0x250
_WHITE = {0x20, *range(0x09, 0x0E), 0x85, 0xA0}
_KIND = np.array([3 if c in _WHITE else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(LATIN)], np.uint8)
_CODE = np.random.default_rng(77).integers(1, 1 << 63, LATIN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _merger(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary for tiktoken, which merges single pieces faster; None where ids don't follow the merges' order."""
    model = json.loads(Path(path).read_text())["model"]
    merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if None in ids or any(a >= b for a, b in pairwise(ids)) or len(set(ids)) < len(ids):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    made = {a + b for a, b in merges}
    ranks = {bytes(signs[c] for c in x): i for x, i in model["vocab"].items() if x in made or len(x) == 1 and x in signs}
    return tiktoken.Encoding("pieces", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """ids(texts): (flat uint16 or int64 ids, offsets by text). Slots hold the latest piece of each hash slot."""

    def __init__(self, path: str, slots: int = 1 << 19, most_ids: int = 1 << 21) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mask, self.most = np.uint64(slots - 1), most_ids
        self._clear(slots)
        self.powers = np.ones(1, np.uint64)
        self.merger = _merger(path)

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        if self.merger:
            return [self.merger.encode_ordinary(x) for x in pieces]
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _clear(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.start = np.zeros(slots, np.int64)
        self.length = np.zeros(slots, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, codes: str) -> None:
        new, where = np.unique(hashes, return_index=True)
        pieces = [codes[a:b] for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
        if self.used > self.most:
            self._clear(len(self.keys))
        ids = self._pieces(pieces)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        slot = (new & self.mask).astype(np.int64)
        self.keys[slot] = new
        self.start[slot] = self.used + np.cumsum(lengths) - lengths
        self.length[slot] = lengths
        self.used += total

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=offsets[1:])
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = _KIND[codes]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        white = kind == 3
        before_white = np.zeros(n, bool)
        before_white[1:] = white[:-1]
        before_white &= ~first[:n]
        next_solid = np.zeros(n, bool)
        next_solid[:-1] = ~white[1:]
        next_solid &= ~first[1:]
        begin = np.zeros(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        blank = np.zeros(n, bool)
        blank[1:] = codes[:-1] == 0x20
        begin = np.where(white, ~before_white | next_solid, np.where(before_white, ~blank, begin)) | first[:n]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        if len(self.powers) < n:
            powers = np.full(max(n, 1 << 16), _STEP, np.uint64)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
            back = np.full(len(powers), np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
            back[0] = 1
            self.back = np.multiply.accumulate(back)
        sums = np.add.reduceat(_CODE[codes] * self.powers[:n], starts)
        hashes = mix(sums * self.back[starts])
        slot = (hashes & self.mask).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        where, length = self.start[slot], self.length[slot]
        flat = self.flat
        if len(miss):
            self._learn(hashes[miss], starts[miss], ends[miss], joined)
            still = self.keys[slot] != hashes
            where, length, flat = self.start[slot], self.length[slot], self.flat
            if still.any():  # two pieces of this chunk share a slot, or the table was emptied
                odd = np.flatnonzero(still)
                new, inverse = np.unique(hashes[odd], return_inverse=True)
                at = np.zeros(len(new), np.int64)
                at[inverse] = odd
                ids = self._pieces([joined[starts[i] : ends[i]] for i in at.tolist()])
                own = np.fromiter(map(len, ids), np.int64, len(ids))
                where, length = where.copy(), length.copy()
                where[odd] = (len(flat) + np.cumsum(own) - own)[inverse]
                length[odd] = own[inverse]
                flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.int32, int(own.sum()))])
        upto = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        out = flat[np.repeat(where - upto[:-1], length) + np.arange(upto[-1])]
        return out, upto[np.searchsorted(starts, offsets)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them with add_special_tokens=False."""
        whole = "".join(texts)
        plain = "'" not in whole and "<|" not in whole and (whole.isascii() or int(np.frombuffer(whole.encode("utf-32-le"), np.uint32).max()) < LATIN)
        fast = [i for i, x in enumerate(texts) if plain or "'" not in x and "<|" not in x and (x.isascii() or max(x) < chr(LATIN))]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        if fast:
            flat, offsets = self._fast([texts[i] for i in fast])
            edges = offsets.tolist()
            for k, i in enumerate(fast):
                out[i] = flat[edges[k] : edges[k + 1]]
        slow = sorted(set(range(len(texts))) - set(fast))
        for i, x in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            out[i] = np.array(x.ids, np.int32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def batch_ids(texts: pa.Array, path: str, max_chars: int = 1 << 18):
    """Yields the ids of each text in turn (null: none), encoding about max_chars at a time."""
    own, size = [], 0
    for x in texts:
        own.append(x.as_py() or "")
        size += len(own[-1])
        if size >= max_chars:
            yield from encoder(path).ids(own)
            own, size = [], 0
    if own:
        yield from encoder(path).ids(own)
