"""Nearest variants by blocks: bit vectors against the plain table, small blocks against all pairs."""

import random

import numpy as np
import pyarrow as pa

from caseloom.functions import distances
from caseloom.functions.distances import codes, edit_distances
from caseloom.operators import matching

from test_matching import edit, log_of


def test_edit_distances_over_words_of_64():
    rng = random.Random(1)
    for most in (5, 64, 65, 140):
        texts = sorted(["".join(rng.choice("abcd") for _ in range(rng.randint(0, most))) for _ in range(30)] + ["a" * most, ""], key=lambda t: -len(t))
        block = codes(texts)
        for t in texts[:6] + ["xyz", ""]:
            found = edit_distances(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), *block)
            assert list(found) == [edit(t, x) for x in texts]


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(matching, "LEFTS", 7)
    monkeypatch.setattr(matching, "RIGHTS", 9)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABC") for _ in range(rng.randint(1, 12)))
    mine, theirs = [word() for _ in range(30)], [word() for _ in range(25)]
    found = matching.nearest_variants(log_of(spark, mine), log_of(spark, theirs), 2)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # pairs are compared by blocks
    assert {"".join(r.variant): (r.distance, r.nearest) for r in found.collect()} == {m: min((edit(m, t), list(t)) for t in set(theirs)) for m in set(mine)}


def test_a_block_comes_once_for_all_texts_compared_with_it(monkeypatch):
    monkeypatch.setattr(distances, "KNOWN_BYTES", 1)  # letters' places are found again and again
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 70)))
    rows, expected = [], []
    for block, salt in ((0, 0), (0, 1), (4, 0)):
        rights, lefts = list({word() for _ in range(23)}), list({word() for _ in range(9)})
        pivots = rights[:2]
        rows += [(block, salt, 0, t, 0, [edit(t, p) for p in pivots]) for t in rights]
        for t in lefts:
            d = [edit(t, p) for p in pivots]
            rows.append((block, salt, 1, t, min(d), d))
            least = min((edit(t, x), x) for x in rights)
            expected.append((t, least[1], least[0]))
    names = ["other_block", "salt", "side", "text", "bound", "d"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32())]
    whole = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for size in (5, 1000):  # blocks and texts begin and end inside batches
        batches = [whole.slice(k, size) for k in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in distances.nearest_of_blocks(iter(batches)) for r in b.to_pylist()]
        assert sorted(found) == sorted(expected)
