"""Hard negatives of anchors by blocked dense products.

Anchors are broadcast in chunks and multiplied with blocks of candidates; doubles hold the integer products exactly below 2^53.
A first pass over all blocks keeps each anchor's best rows of its own label, lists that merge.  Each of these sets a window of
scores, and a second pass keeps the best rows of other labels inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .products import GROUP, LOW, Asked, Best, asked_chunks, blocks_of, multiplied, packed, quantised, ranked, tasks_of
from .shared import kept


def _pass(blocks: DataFrame, n_blocks: int, rows: list, lists: int, k: int, offer, payload=None) -> DataFrame:
    """(q: place in rows, w: which of its lists, id, score, rank) after offer(best, places, anchors' ids and labels, products, ids, labels, payload) for all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((rows, payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, payload = shared.value
        asked = Asked(rows)
        best = Best(len(asked) * lists, k)
        for dim, longest, ids, labels, x in blocks_of(batches):
            if dim not in asked.of:
                continue
            every, q, lengths = asked.of[dim]
            for a in range(0, len(every), GROUP):
                at = every[a : a + GROUP]
                s = multiplied(q[a : a + GROUP], x, float(lengths[a : a + GROUP].max() * longest))
                offer(best, at, asked.ids[at][:, None], asked.labels[at][:, None], s, ids, labels, payload)
        place, score, found = best.entries()
        q, w = np.divmod(place, lists)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(w), pa.array(found), pa.array(score)], ["q", "w", "id", "score"])

    return ranked(tasks_of(blocks, n_blocks, len(rows)).mapInArrow(run, "q long, w long, id long, score long"), k, "q", "w")


def _positives(best, at, anchor, label, s, ids, labels, _) -> None:
    best.offer(at, np.where((labels == label) & (ids != anchor), s, LOW), ids)


def _negatives(best, at, anchor, label, s, ids, labels, windows) -> None:
    low, high = windows
    other = np.where(labels != label, s, LOW)
    lists = low.shape[1]
    for w in range(lists):
        some = np.flatnonzero(low[at, w] <= high[at, w])
        if len(some):
            own, own_at = other[some], at[some]
            inside = (own <= high[own_at, w][:, None]) & (own >= low[own_at, w][:, None]) & (own > LOW)
            best.offer(own_at * lists + w, np.where(inside, own, LOW), ids)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    most_bytes: int = 8 << 20, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors; exact.

    An anchor's positives are its best rows of the same label, its negatives for one of them the best rows of other labels whose
    score is low to high percent of the positive's; higher scores come first, ties by the smaller id.  Scores are integer products of
    floor(scale * x).  A positive score below zero leaves no window, zero only scores of zero.  Rows with the anchor's id are no positives
    of it; other rows that repeat an id count each, repeated anchors once.  Rows with a null id or label, a null or empty
    vector, null or non-finite components or a squared length of 2^62 or more after scaling take no part; vectors of another dimension
    than the anchor's are not compared.  Empty tables give no rows; other columns are not read.  Anchors are broadcast
    in chunks of most_bytes.
    """
    spark = vectors.sparkSession
    blocks = kept(packed(quantised(vectors, id_col, vec_col, label_col, scale)), "blocks")
    n_blocks = blocks.count()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = spark.createDataFrame([], names)
    for rows in asked_chunks(quantised(anchors, id_col, vec_col, label_col, scale), most_bytes):
        found = _pass(blocks, n_blocks, rows, 1, positives, _positives).collect()  # at most so many rows for each anchor of the chunk
        floor, ceiling = np.ones((len(rows), positives), np.int64), np.zeros((len(rows), positives), np.int64)
        for r in found:
            floor[r["q"], r["rank"] - 1] = -(-low * r["score"] // 100)
            ceiling[r["q"], r["rank"] - 1] = high * r["score"] // 100
        met = _pass(blocks, n_blocks, rows, positives, negatives, _negatives, (floor, ceiling))
        of = spark.createDataFrame([(r["q"], r["rank"] - 1, rows[r["q"]]["id"], r["id"], r["score"]) for r in found], "q long, w long, anchor_id long, positive_id long, positive_score long")
        made = met.join(F.broadcast(of), ["q", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        result = result.unionByName(kept(made, "negatives"))
    return result
