"""Exact retrieval of the largest inner products of integer vectors, by buckets of about equally long vectors.

Vectors are sorted by length and packed into buckets.  For a query whose k-th best product so far is known, a bucket's
longest vector gives the cosine that a better one must have there.  Above one the bucket is passed over; a high one bounds single
coordinates, so candidates come from the sorted values of the query's largest coordinates; otherwise those long enough are
multiplied as a block.  Products of all candidates are verified in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, kept

ROWS, GROUP = 1024, 256  # vectors of a block, queries that are multiplied with it at a time
LOW = np.iinfo(np.int64).min
HIGH_COSINE, FOCUS = 0.9, 5  # from this local cosine coordinates decide; so many of a query's coordinates do
TASK = 1 << 28  # products that a task is given, about
QUANTISED = "dim int, norm2 double, id long, label long, vec binary"
BLOCKS = "dim int, longest double, first long, n int, ids binary, labels binary, rows binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label: str | None = None, scale: int = 256) -> DataFrame:
    """(dim, norm2, id, label, vec: floor(scale * x) of each component as 32-bit integers) of usable rows.

    Rows with a null id or a null or empty vector, with null or non-finite components, or a null label where one is asked for, are
    left out, and so are vectors whose squared length is 2^62 or more, as their products would not fit a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.asarray(pc.fill_null(vec.flatten(), float("nan")), np.float64)
            start = np.cumsum(size) - size
            usable = (size > 0) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            if label is not None:
                usable &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(size[usable]).tolist():
                at = np.flatnonzero(usable & (size == d))
                with np.errstate(over="ignore", invalid="ignore"):
                    rows = np.floor(scale * x[start[at][:, None] + np.arange(d)])
                    norm2 = (rows * rows).sum(1)
                good = np.isfinite(rows).all(1) & (norm2 < 2.0**62)
                if good.any():
                    own = batch.take(pa.array(at[good]))
                    raw = np.ascontiguousarray(rows[good], np.int32)
                    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (4 * d)
                    binary = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), d, np.int32)), pa.array(norm2[good]), own.column("id"), own.column("label"), binary], ["dim", "norm2", "id", "label", "vec"])

    labels = F.col(label).cast("long") if label is not None else F.lit(None).cast("long")
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("id"), labels.alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, QUANTISED)


def packed(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Blocks of so many consecutive rows of one dimension, in the order of their partitions; a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if held and held[0].column("dim")[0].as_py() != dims[a]:
                        yield _block(held)
                        held = []
                    stop = min(b, a + most - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, stop - a))
                    if sum(h.num_rows for h in held) == most:
                        yield _block(held)
                        held = []
                    a = stop
        if held:
            yield _block(held)

    return rows.mapInArrow(run, BLOCKS)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    ids, labels = (np.asarray(pc.fill_null(table.column(c), 0), np.int64) for c in ("id", "label"))
    longest = float(np.sqrt(table.column("norm2").to_numpy().max()))
    rows = b"".join(table.column("vec").to_pylist())
    columns = [[held[0].column("dim")[0].as_py()], [longest], [int(ids[0])], [len(ids)], [ids.tobytes()], [labels.tobytes()], [rows]]
    types = [pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "longest", "first", "n", "ids", "labels", "rows"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, float, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, longest, ids, labels, rows as doubles) of each block."""
    for batch in batches:
        for dim, longest, ids, labels, rows in zip(*(batch.column(c) for c in ("dim", "longest", "ids", "labels", "rows")), strict=True):
            x = np.frombuffer(rows.as_buffer(), np.int32).reshape(-1, dim.as_py()).astype(np.float64)
            yield dim.as_py(), longest.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64), x


def multiplied(q: np.ndarray, x: np.ndarray, length: float) -> np.ndarray:
    """Integer products of all rows, given a bound of two rows' lengths multiplied: below 2^53 doubles hold every partial sum."""
    if length < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best (score, id) of each of n lists, higher scores first, then smaller ids.  Lists of other rows can be merged in."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.score, self.id = np.full((n, k), LOW), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, LOW) if floor is None else floor

    def bar(self, at: np.ndarray) -> np.ndarray:
        """Scores below can't enter the lists any more."""
        return np.maximum(self.score[at, -1], self.floor[at])

    def offer(self, at: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ids for the lists at; LOW is no score."""
        bar = self.bar(at)
        good = (s >= bar[:, None]) & (s > LOW)
        if s.shape[1] > self.k and np.count_nonzero(good) > 4 * self.k * len(at):
            bar = np.maximum(bar, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k])
            good &= s >= bar[:, None]
        r, c = np.nonzero(good)
        self.enter(at[r], s[r, c], ids[c])

    def enter(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Single (list, score, id) entries."""
        fresh = (scores > self.score[lists, -1]) | ((scores == self.score[lists, -1]) & (ids < self.id[lists, -1]))
        lists, scores, ids = lists[fresh], scores[fresh], ids[fresh]
        if not len(lists):
            return
        own = np.unique(lists)
        lists = np.r_[np.repeat(own, self.k), lists]
        scores, ids = np.r_[self.score[own].ravel(), scores], np.r_[self.id[own].ravel(), ids]
        order = np.lexsort((ids, ~scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.searchsorted(lists, own)
        take = first[:, None] + np.arange(self.k)
        self.score[own], self.id[own] = scores[take], ids[take]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.score > LOW)
        return r, self.score[r, c], self.id[r, c]


class Asked:
    """A bounded set of query rows, by dimension."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] or 0 for r in rows], np.int64)
        dims = np.array([r["dim"] for r in rows])
        self.of = {}
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = np.frombuffer(b"".join(bytes(rows[i]["vec"]) for i in at), np.int32).reshape(-1, d).astype(np.float64)
            self.of[d] = (at, x, np.sqrt((x * x).sum(1)))

    def __len__(self) -> int:
        return len(self.ids)


def asked_chunks(queries: DataFrame, most_bytes: int) -> Iterator[list]:
    """The rows of quantised queries, chunk by chunk, each of about most_bytes; rows that repeat id, label and vector come once."""
    queries = kept(queries.distinct(), "queries")
    chunks = -(-(queries.agg(F.sum(F.length("vec") + 32)).first()[0] or 0) // most_bytes)
    for chunk in range(chunks):
        rows = queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)) == chunk).collect()
        if rows:
            yield rows


def tasks_of(blocks: DataFrame, n_blocks: int, queries: int) -> DataFrame:
    """The blocks dealt to tasks of about equal work, long vectors first."""
    parts = min(max(1, n_blocks), max(blocks.sparkSession.sparkContext.defaultParallelism, n_blocks * ROWS * queries // TASK))
    return blocks.repartition(parts, "first", "longest").sortWithinPartitions(F.desc("longest"))


def _coordinates(x: np.ndarray, q: np.ndarray, length: float, cosine: float, bucket: dict) -> np.ndarray:
    """Rows of a bucket whose values at the query's largest coordinates allow the cosine."""
    if not bucket:
        size = np.sqrt((x * x).sum(1))
        bucket["unit"] = unit = x / np.where(size > 0, size, 1)[:, None]
        bucket["order"] = order = np.argsort(unit, axis=0)
        bucket["sorted"] = np.ascontiguousarray(np.take_along_axis(unit, order, 0).T)
    own = q / length
    focus = np.argsort(-np.abs(own))[:FOCUS]
    turn, reach = np.arccos(np.clip(own[focus], -1, 1)), np.arccos(min(1.0, cosine)) + 1e-7
    least, most = np.cos(np.minimum(np.pi, turn + reach)) - 1e-9, np.cos(np.maximum(0, turn - reach)) + 1e-9
    spans = [(np.searchsorted(bucket["sorted"][f], lo), np.searchsorted(bucket["sorted"][f], hi, "right")) for f, lo, hi in zip(focus, least, most, strict=True)]
    narrow = int(np.argmin([b - a for a, b in spans]))
    found = bucket["order"][slice(*spans[narrow]), focus[narrow]]
    values = bucket["unit"][found[:, None], focus]
    return found[((values >= least) & (values <= most)).all(1)]


def _searched(asked: Asked, dim: int, longest: float, ids: np.ndarray, x: np.ndarray, best: Best) -> None:
    """Offers a bucket's rows, longest first, to the lists of all queries of its dimension."""
    if dim not in asked.of:
        return
    every, q, lengths = asked.of[dim]
    bucket: dict = {}
    sizes = np.sqrt((x * x).sum(1))
    for a in range(0, len(every), GROUP):
        at, own, length = every[a : a + GROUP], q[a : a + GROUP], lengths[a : a + GROUP]
        bar = best.bar(at).astype(np.float64)
        local = np.where(bar > 0, bar / np.maximum(length * longest, 1e-300), -1.0)
        high = (local >= HIGH_COSINE) & (local <= 1 + 1e-9)
        for i in np.flatnonzero(high):
            found = _coordinates(x, own[i], length[i], local[i] - 1e-9, bucket)
            found = found[ids[found] != asked.ids[at[i]]]
            if len(found):
                best.enter(np.full(len(found), at[i]), multiplied(own[i : i + 1], x[found], length[i] * longest)[0], ids[found])
        block = np.flatnonzero(local < HIGH_COSINE)
        if len(block):
            least = np.where(bar[block] > 0, bar[block] / np.maximum(length[block], 1e-300) * (1 - 1e-9), 0.0).min()
            upto = int(np.searchsorted(-sizes, -least, "right"))
            s = multiplied(own[block], x[:upto], float(length[block].max() * longest))
            s[asked.ids[at[block]][:, None] == ids[:upto]] = LOW
            best.offer(at[block], s, ids[:upto])


def _scan(blocks: DataFrame, n_blocks: int, rows: list, k: int, floor: np.ndarray | None) -> DataFrame:
    """(q: place in rows, id, score): the k best of each query among all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((rows, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, floor = shared.value
        asked = Asked(rows)
        best = Best(len(asked), k, floor)
        for dim, longest, ids, _, x in blocks_of(batches):
            _searched(asked, dim, longest, ids, x, best)
        q, score, found = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(score)], ["q", "id", "score"])

    found = tasks_of(blocks, n_blocks, len(rows)).mapInArrow(run, "q long, id long, score long")
    return ranked(found, k, "q")


def ranked(found: DataFrame, k: int, *lists: str) -> DataFrame:
    """The k best rows of each list with their rank from 1: higher scores first, then smaller ids."""
    order = Window.partitionBy(*lists).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, most_bytes: int = 8 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest integer products for each query; exact.

    Components are floor(scale * x), x as double; ties go to the smaller id, and fewer than k rows are returned where there are
    no more.  A query's own rows, those with its id, are no candidates; other rows that repeat an id are candidates each, repeated
    queries are asked once.  Rows with a null id, null or empty vectors, null or non-finite components or a squared length of 2^62 or
    more after scaling take no part; zero vectors do, and vectors of another dimension than the query's are not compared.
    Empty tables give no rows; columns besides the two are not read.  Queries are broadcast in chunks of most_bytes; a
    sixteenth of the buckets gives each a first bound before all of them are searched.
    """
    ordered = quantised(vectors, id_col, vec_col, scale=scale).repartitionByRange("dim", F.desc("norm2"), "id").sortWithinPartitions("dim", F.desc("norm2"), "id")
    buckets = kept(packed(ordered), "buckets")
    n_buckets = buckets.count()
    sample = buckets.where(F.pmod(F.xxhash64("first", "longest"), F.lit(16)) == 0)
    out = [vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")]
    for rows in asked_chunks(quantised(queries, id_col, vec_col, scale=scale), most_bytes):
        floor = np.full(len(rows), LOW)
        for r in _scan(sample, max(1, n_buckets // 16), rows, k, None).where(F.col("rank") == k).collect():  # a row a query of the chunk
            floor[r["q"]] = r["score"]
        names = vectors.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "q long, query_id long")
        found = _scan(buckets, n_buckets, rows, k, floor).join(F.broadcast(names), "q")
        out.append(kept(found.select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "top"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
