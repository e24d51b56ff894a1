"""Edit distances of one text to many, for tasks that compare blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KNOWN_BYTES = 32 << 20  # of a block's letters whose places are kept as bits
FULL = ~np.uint64(0)


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def codes(texts: list[str]) -> tuple[tuple[np.ndarray, ...], np.ndarray, dict[int, np.ndarray]]:
    """(letters, where each begins among the places sorted by letter, these places in all texts set end to end, where each text begins there; lengths;
    places of letters as bits, filled as they are asked for) of texts sorted by falling length.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    whole = letters_of("".join(texts))
    order = np.argsort(whole, kind="stable").astype(np.int32)
    letters, firsts = np.unique(whole[order], return_index=True)
    return (letters, np.append(firsts, len(whole)), order, np.cumsum(lengths) - lengths), lengths, {}


def _bits(letter: int, places: tuple[np.ndarray, ...], lengths: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """(words, texts): bit i of word w is set where a text's position 64 w + i holds the letter."""
    found = known.get(letter)
    if found is None:
        letters, firsts, order, begins = places
        found = np.zeros((-(-int(lengths[0]) // 64), len(lengths)), dtype=np.uint64)
        k = int(np.searchsorted(letters, letter))
        if k < len(letters) and letters[k] == letter:
            at = order[firsts[k] : firsts[k + 1]].astype(np.int64)
            text = np.searchsorted(begins, at, "right") - 1  # empty texts come last
            at -= begins[text]
            np.add.at(found.reshape(-1), (at >> 6) * len(lengths) + text, np.uint64(1) << (at & 63).astype(np.uint64))
        if (len(known) + 1) * found.nbytes > KNOWN_BYTES:
            known.clear()
        known[letter] = found
    return found


def edit_distances(text: np.ndarray, places: tuple[np.ndarray, ...], lengths: np.ndarray, known: dict[int, np.ndarray], near: np.ndarray | None = None) -> np.ndarray:
    """Distances of a text to a block (see codes()), or to those at the ascending places near of it.

    A column of the table, of an other text's letters, is a bit vector of as many words as that text needs; all others go side by side, a letter of
    the text at a time.  The last column's differences add up to the distance.
    """
    own = {c: _bits(c, places, lengths, known) for c in set(text.tolist())} if lengths.max(initial=0) else {}
    if near is not None:
        own, lengths = {c: bits[:, near] for c, bits in own.items()}, lengths[near]
    ends = [int(np.searchsorted(-lengths, -64 * w)) for w in range(max(1, -(-int(lengths.max(initial=0)) // 64)))]  # texts longer than w words come first
    plus = [np.full(n, FULL) for n in ends]
    minus = [np.zeros(n, dtype=np.uint64) for n in ends]
    xv, xh, ph = (np.empty(max(ends[0], 1), dtype=np.uint64) for _ in range(3))
    one, top = np.uint64(1), np.uint64(63)
    for c in text.tolist() if ends[0] else ():
        up = down = None
        for w, n in enumerate(ends):
            p, q, a, b, h = plus[w], minus[w], xv[:n], xh[:n], ph[:n]
            eq = own[c][w, :n]
            np.bitwise_or(eq, q, out=a)
            if down is not None:
                eq = eq | down[:n]
            np.bitwise_and(eq, p, out=b)
            b += p
            b ^= p
            b |= eq
            np.bitwise_or(b, p, out=h)
            np.invert(h, out=h)
            h |= q
            b &= p
            before, under = up, down
            if w + 1 < len(ends):
                up, down = h[: ends[w + 1]] >> top, b[: ends[w + 1]] >> top
            h <<= one
            b <<= one
            h |= one if before is None else before[:n]
            if under is not None:
                b |= under[:n]
            np.bitwise_or(a, h, out=p)
            np.invert(p, out=p)
            p |= b
            np.bitwise_and(h, a, out=q)
    score = np.full(len(lengths), len(text), dtype=np.int64)
    for w, n in enumerate(ends):
        within = FULL >> (64 - np.minimum(lengths[:n] - 64 * w, 64)).astype(np.uint64)
        score[:n] += np.bitwise_count(plus[w] & within).astype(np.int64) - np.bitwise_count(minus[w] & within)
    return score


def _ints(lists: pa.Array, n: int) -> np.ndarray:
    """Lists of one length as a table."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def nearest_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, other, distance) of rows (other_block, salt, side, text, bound, d) in that order: for each text of side 1 its nearest of side 0 of its block, if
    within its bound; ties go to the first text.  A block comes once, its texts are compared with it as they come.
    """
    of, held, away, block = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("other_block", "salt", "side")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        found = []
        for a, b in zip(starts, starts[1:]):
            at, part = tuple(keys[:2, a].tolist()), batch.slice(a, b - a)
            texts, d = part.column("text").to_pylist(), _ints(part.column("d"), b - a)
            if at != of:
                of, held, away, block = at, [], [], None
            if keys[2, a] == 0:
                held += texts
                away.append(d)
                continue
            if block is None:
                order = sorted(range(len(held)), key=lambda k: -len(held[k]))
                held, away = [held[k] for k in order], np.concatenate(away)[order]
                block = codes(held)
            lengths = block[1]
            for text, bound, own in zip(texts, part.column("bound").to_pylist(), d):
                near = np.flatnonzero((np.abs(lengths - len(text)) <= bound) & (np.abs(away - own).max(axis=1) <= bound))
                if not len(near):
                    continue
                few = len(near) < 0.8 * len(lengths)
                distance = edit_distances(letters_of(text), *block, near if few else None)
                least = int(distance.min())
                if least <= bound:
                    hits = np.flatnonzero(distance == least)
                    found.append((text, min(held[k] for k in (near[hits] if few else hits)), least))
        if found:
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in list(zip(*found))[:2]], pa.array([f[2] for f in found], pa.int32())], ["text", "other", "distance"])
