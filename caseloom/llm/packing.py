"""Packing documents into training windows by sum-of-squares online packing.

Each task packs the rows of its partition as they come.  What a document has beyond whole windows goes to the fill
level h for which the sum of squares of the counts of partly filled windows by level grows least; the counts are an
array by level.  At the end of a partition, and whenever too many windows are open, the open windows are filled from
each other by cutting, and the last is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import trimmed
from .bytebpe import batch_ids, encoder
from .shared import bounded

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
Piece = tuple[object, int, np.ndarray, int]  # document, ids before it, ids, the document's number of ids


class Packer:
    """Sum-of-squares packing into windows of so many ids; closed sequences gather in ``closed``."""

    def __init__(self, window: int, most_open: int = 4096) -> None:
        self.window, self.most_open = window, most_open
        # Half more at level 0 and less at the top: then n[h + r] - n[h] orders new, grown and completed windows alike.
        self.counts = np.zeros(window + 1)
        self.counts[0], self.counts[window] = 0.5, -0.5
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.n_open = 0
        self.closed: list[list[Piece]] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self.closed.append([(doc, a, ids[a : a + self.window], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:].copy(), len(ids)))

    def place(self, piece: Piece) -> None:
        r, n = len(piece[2]), self.counts
        had = n[: self.window - r + 1]
        growth = np.where(had > 0, n[r:] - had, np.inf)
        level = len(growth) - 1 - int(np.argmin(growth[::-1]))  # of equals the fullest
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            n[level] -= 1
            self.n_open -= 1
        if level + r == self.window:
            self.closed.append(window)
        else:
            n[level + r] += 1
            self.open[level + r].append(window)
            self.n_open += 1
            if self.n_open > self.most_open:
                self.drain(last=False)

    def drain(self, last: bool = True) -> None:
        """Fills the fullest open windows from the emptiest; ``last`` cuts what remains into powers of two."""
        left = [x for h in sorted(self.open, reverse=True) for x in self.open[h]]
        self.open.clear()
        self.counts[1 : self.window] = 0
        self.n_open = 0
        i, j = 0, len(left) - 1
        fill = sum(len(p[2]) for p in left[0]) if left else 0
        while i < j:
            doc, start, ids, total = left[j].pop()
            room = self.window - fill
            if len(ids) > room:
                left[j].append((doc, start + room, ids[room:], total))
                ids = ids[:room]
            left[i].append((doc, start, ids, total))
            fill += len(ids)
            if not left[j]:
                j -= 1
            if fill == self.window:
                self.closed.append(left[i])
                i += 1
                fill = sum(len(p[2]) for p in left[i]) if i <= j else 0
        if i == j and left[i]:
            if not last:
                rest = sum(len(p[2]) for p in left[i])
                self.counts[rest] += 1
                self.open[rest].append(left[i])
                self.n_open = 1
                return
            for bit in reversed(range(self.window.bit_length())):
                if fill >> bit & 1:
                    self.closed.append(_taken(left[i], 1 << bit))


def _taken(pieces: list[Piece], n: int) -> list[Piece]:
    """Removes n ids from the front of pieces."""
    out = []
    while n:
        doc, start, ids, total = pieces.pop(0)
        if len(ids) > n:
            pieces.insert(0, (doc, start + n, ids[n:], total))
            ids = ids[:n]
        out.append((doc, start, ids, total))
        n -= len(ids)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id; a null or empty text is end_id alone.  Every id lies in exactly one piece,
    the pieces of a sequence lie gapless from offset 0, no sequence exceeds ``window``, and a sequence below it is a
    power of two long.  Documents longer than a window are cut at its multiples, others at most to fill up open windows.
    Repeated rows are packed each for itself, null ids stay null, an empty table gives no rows, other columns are not
    read.  sequence_id holds the partition and a number in it.  Memory a task: the open windows (at most 4,096) and the
    encoder's table; nothing is shuffled, so a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = Packer(window), np.array([end_id], np.int32)
        first = TaskContext.get().partitionId() << 33
        made = 0

        def rows() -> pa.RecordBatch:
            nonlocal made
            columns: list[list] = [[] for _ in range(7)]
            for sequence in packer.closed:
                offset = 0
                for doc, start, ids, total in sequence:
                    row = doc, start, len(ids), ids.astype("<u4").tobytes(), total, first + made, offset
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += len(ids)
                made += 1
            packer.closed = []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch_ids(batch.column("text"), tokenizer_path), strict=True):
                packer.add(doc, np.concatenate([ids, end]))
                if len(packer.closed) >= 250:
                    yield rows()
        packer.drain()
        yield rows()
        encoder.cache_clear()  # built in half a second; kept, it would stand beside whatever the worker does next

    return bounded(docs).selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(trimmed(run), SCHEMA)
