"""Fill-in-middle transformation of documents by rank and select over packed boundary bits.

A chunk of texts gets two packed bitvectors: line ends and first bytes of code points, a bit per byte, each with a directory of the
bits before every block.  A text's number of lines is the difference of two ranks, the byte cuts after the drawn lines are selects,
and the lengths of the pieces in code points are ranks again, so texts are neither split into lines nor decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded
from .textnum import text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile(b"|".join(re.escape(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)))
PLAIN, PSM, SPM = "plain", "psm", "spm"
SPAN, BLOCK = 1 << 20, 64  # bytes whose bits are packed at a time; bytes of a directory's block


class Bits:
    """A packed bitvector with the number of ones before each block."""

    def __init__(self, packed: np.ndarray) -> None:
        blocks = len(packed) // BLOCK + 1
        self.packed = np.zeros(blocks * BLOCK, np.uint8)
        self.packed[: len(packed)] = packed
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.packed).reshape(blocks, BLOCK).sum(1, dtype=np.int64), out=self.before[1:])

    def _inside(self, blocks: np.ndarray) -> np.ndarray:
        """Ones in a block up to each of its bits, that bit included."""
        own = self.packed.reshape(-1, BLOCK)[blocks]
        return np.cumsum(np.unpackbits(own, axis=1, bitorder="little"), axis=1, dtype=np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, bit = np.divmod(at, 8 * BLOCK)
        upto = self._inside(block)
        return self.before[block] + np.where(bit > 0, upto[np.arange(len(at)), np.maximum(bit, 1) - 1], 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 1."""
        block = np.searchsorted(self.before, k, "left") - 1
        upto = self._inside(block)
        return block * 8 * BLOCK + (upto >= (k - self.before[block])[:, None]).argmax(1)


def _packed(data: np.ndarray, holds) -> np.ndarray:
    """Bits of holds(bytes), a span of bytes at a time."""
    spans = [np.packbits(holds(data[a : a + SPAN]), bitorder="little") for a in range(0, len(data), SPAN)]
    return np.concatenate(spans) if spans else np.zeros(0, np.uint8)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> Bits:
    """Bits of the last byte of each line: line feeds, and the end of each text that has one."""
    packed = _packed(data, lambda x: x == 10)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    np.bitwise_or.at(packed, last >> 3, np.left_shift(1, last & 7).astype(np.uint8))
    return Bits(packed)


def code_points(data: np.ndarray) -> Bits:
    """Bits of the first byte of each code point."""
    return Bits(_packed(data, lambda x: (x & 0xC0) != 0x80))


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers below 2^32 for each id: the first 8-digit groups of sha256 of ``seed:id`` (of ``seed:`` for a null id)."""
    out = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(out, ">u4").reshape(-1, 4).astype(np.int64)


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a mark."""
    out = np.zeros(len(offsets) - 1, bool)
    for found in MARK.finditer(data):
        row = int(np.searchsorted(offsets, found.start(), "right")) - 1
        if found.end() <= offsets[row + 1]:
            out[row] = True
    return out


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n lines, form, prefix_chars, middle_chars, output) of every whole text.

    Lines keep their line feeds; what follows the last one is a line too.  Of n lines the prefix ends after the smaller of two draws
    from 0 to n, the middle after the larger.  ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first;
    empty or null texts and such that hold a mark stay plain, with null lengths.  Draws depend on seed and id only, so reruns
    agree and rows that repeat an id and text repeat their result; a null id draws by its absence.  An empty table gives no
    row; other columns, whatever their names, are not read.  A text of any length is cut whole: besides its bytes and the output it
    needs a quarter of its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for row, data, offsets in text_chunks(batch, "text"):
                count = len(offsets) - 1
                own = ids.slice(row, count)
                yield _cut(own, data, offsets, draws(own.to_pylist(), seed), rate, spm)

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def _cut(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int, spm: int) -> pa.RecordBatch:
    ends, starts = line_ends(data, offsets), code_points(data)
    lines = ends.rank(offsets)
    n = np.diff(lines)
    first, second = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    cut = lambda k: np.where(k > 0, ends.select(np.maximum(1, lines[:-1] + k)) + 1, offsets[:-1])
    a, b = cut(first), cut(second)
    plain = (n == 0) | (h[:, 2] % 100 >= rate) | _marked(data, offsets)
    suffix_first = h[:, 3] % 100 < spm
    points = [starts.rank(x) for x in (offsets[:-1], a, b)]
    view, pieces, sizes = memoryview(data), [], []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for lo, x, y, hi, whole, turned in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
        if whole:
            pieces.append(view[lo:hi])
        elif turned:
            pieces += (s, view[y:hi], p, view[lo:x], m, view[x:y])
        else:
            pieces += (p, view[lo:x], s, view[y:hi], m, view[x:y])
        sizes.append(hi - lo + (0 if whole else 9))
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    output = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(b"".join(pieces)))
    form = np.where(plain, PLAIN, np.where(suffix_first, SPM, PSM))
    counts = [pa.array(points[i + 1] - points[i], pa.int64(), mask=plain) for i in range(2)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(form.tolist(), pa.string()), *counts, output], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that fill_in_middle made output of: its pieces lie between marks, which no transformed text holds."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
