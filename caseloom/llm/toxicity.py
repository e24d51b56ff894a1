"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Terms are words (letters only, lower case) and their leading 4, 5 and 6 characters as families.  The index holds a bounded sample
of labelled texts over the terms whose rates in the two labels differ beyond chance, all of them; idf comes from all documents.
Cosine over every word of a text finds texts on the same matters rather than texts with the same insults (README has figures),
so words that tell nothing about the label weigh nothing, as stop words do.  Examples lie in blocks; each term keeps its largest weight by block.  A text's blocks are scored from the
highest bound down until no further block can enter the k nearest, so the nearest are exact.  Their votes, weighted by
cosine, give a raw score that a logistic curve fitted on the examples themselves (each left out in turn) calibrates.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, kept

BLOCK, NEAREST, FAMILY = 64, 16, (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Counts of words and of word families of a text."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower() if text else "")).items():
        out[word] += n
        for k in FAMILY:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


class Lookup:
    """Places of the known terms in a text; words seen lately are remembered with their terms."""

    def __init__(self, names: list[str]) -> None:
        self.place, self.seen = {t: i for i, t in enumerate(names)}, {}

    def __call__(self, text: str | None) -> Counter:
        out: Counter = Counter()
        if not text or not self.place:
            return out
        if len(self.seen) > 1 << 18:
            self.seen.clear()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            found = self.seen.get(word)
            if found is None:
                names = [word, *(word[:k] + "*" for k in FAMILY if len(word) > k)]
                found = self.seen[word] = tuple(self.place[t] for t in names if t in self.place)
            for t in found:
                out[t] += n
        return out


def choose_terms(rows: list[Counter], toxic: np.ndarray) -> list[str]:
    """Terms whose rate by label differs twelvefold and by more than chance among all terms (likelihood ratio), the strongest first."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    have1, have0 = Counter(), Counter()
    for row, y in zip(rows, toxic.tolist(), strict=True):
        (have1 if y else have0).update(row.keys())
    every = have1.keys() | have0.keys()
    least = 2 * np.log(max(1, len(every))) + 4  # so that of all terms tried few pass by chance
    found = []
    for t in every if n1 and n0 else ():
        a, b = have1[t], have0[t]
        n, k = n1 + n0, a + b
        cells = ((a, n1 * k), (b, n0 * k), (n1 - a, n1 * (n - k)), (n0 - b, n0 * (n - k)))
        score = 2 * sum(o * np.log(o * n / e) for o, e in cells if o) if k >= 3 else 0.0
        if score > least and abs(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) > np.log(12):
            found.append((-score, t))
    return [t for _, t in sorted(found)]


class Index:
    """Examples by term: postings (example, weight), and the largest weight by block."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.top = np.zeros((n_terms, self.blocks), np.float32)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for i, v in enumerate(vectors):
            for t, w in v.items():
                postings[t].append((i, w))
                self.top[t, i // BLOCK] = max(self.top[t, i // BLOCK], np.nextafter(np.float32(w), np.float32(2)))
        self.who = [np.array([i for i, _ in p], np.int64) for p in postings]
        self.weight = [np.array([w for _, w in p]) for p in postings]
        edges = np.arange(self.blocks + 1) * BLOCK
        self.cut = [np.searchsorted(w, edges) for w in self.who]

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, of equals the first; (cosine, example), best first."""
        if not query or not self.n:
            return []
        which = list(query)
        bound = np.array([query[t] for t in which], np.float32) @ self.top[which] * np.float32(1 + 1e-5)
        best: list[tuple[float, int]] = []
        least = 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == k and bound[block] < least:
                break
            score = np.zeros(BLOCK)
            for t in which:
                a, b = self.cut[t][block], self.cut[t][block + 1]
                if a < b:
                    score[self.who[t][a:b] - block * BLOCK] += query[t] * self.weight[t][a:b]
            best += [(score[i], block * BLOCK + i) for i in np.flatnonzero(score > max(0.0, least - 1e-12)).tolist() if block * BLOCK + i != skip]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                least = best[-1][0]
        return best


def _vector(row: Counter, idf: np.ndarray) -> dict[int, float]:
    """The unit vector of counts by a term's place."""
    found = {t: (1 + np.log(n)) * idf[t] for t, n in row.items()}
    norm = float(np.sqrt(sum(w * w for w in found.values())))
    return {t: w / norm for t, w in sorted(found.items())} if norm else {}


def _raw(near: list[tuple[float, int]], toxic: np.ndarray, prior: float) -> float:
    """Votes weighted by cosine; the prior counts as half a vote."""
    weight = sum(s for s, _ in near)
    return (sum(s for s, i in near if toxic[i]) + 0.5 * prior) / (weight + 0.5)


class Model:
    def __init__(self, packed: bytes) -> None:
        got = np.load(io.BytesIO(packed), allow_pickle=False)
        self.names = [str(t) for t in got["names"]]
        self.lookup = Lookup(self.names)
        self.ids, self.toxic, self.idf = got["ids"], got["toxic"], got["idf"]
        self.prior, self.slope, self.shift, self.bare = (float(x) for x in got["numbers"])
        rows, cols, counts = got["rows"], got["cols"], got["counts"]
        own: list[Counter] = [Counter() for _ in range(len(self.ids))]
        for r, c, n in zip(rows.tolist(), cols.tolist(), counts.tolist(), strict=True):
            own[r][c] = n
        self.counts = own
        self.vectors = [_vector(x, self.idf) for x in own]
        self.index = Index(self.vectors, len(self.names))

    def calibrate(self) -> tuple[float, float, float]:
        """(slope, shift, score without a neighbour), from each example's other neighbours, by Newton steps."""
        near = [self.index.nearest(v, NEAREST, skip=i) for i, v in enumerate(self.vectors)]
        some = np.array([bool(x) for x in near], bool)
        y = self.toxic.astype(float)
        bare = float((y[~some].sum() + self.prior) / ((~some).sum() + 1)) if len(y) else 0.0
        if not some.any() or len(set(self.toxic[some].tolist())) < 2:
            return 6.0, -3.0, bare
        x = np.array([_raw(n, self.toxic, self.prior) for n in near])[some]
        n1, n0 = y[some].sum(), (1 - y[some]).sum()
        goal = np.where(y[some] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a = np.stack([x, np.ones_like(x)], 1)
        w = np.array([6.0, -3.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - goal) + 1e-3 * (w - [6.0, -3.0]))
        return float(w[0]), float(w[1]), bare

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(_vector(self.lookup(text), self.idf), NEAREST)
        if not near:
            return self.bare, near
        return float(1 / (1 + np.exp(-np.clip(self.slope * _raw(near, self.toxic, self.prior) + self.shift, -30, 30)))), near


def _pack(names, ids, toxic, idf, numbers, rows, cols, counts) -> bytes:
    out = io.BytesIO()
    np.savez(out, names=np.array(names, "U") if names else np.zeros(0, "U1"), ids=np.array(ids, np.int64), toxic=np.array(toxic, bool), idf=idf, numbers=np.array(numbers), rows=rows, cols=cols, counts=counts)
    return out.getvalue()


def fit(docs: DataFrame, labelled: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A model from at most about most_rows rows of labelled (id, toxic), half of each label where there are enough.

    The bound is on rows; whole texts are used.  Rows are chosen by their hash, equal rows count once (of several
    texts of one id, any), rows with a null id, text or label are left out.  idf counts the documents of all of docs that hold
    each chosen term.
    """
    spark = bounded(docs).sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), (F.col("toxic") > 0).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    counts = kept(rows.groupBy("toxic").agg(F.count("*").alias("n")), "labels")
    share = counts.select("toxic", (F.lit(most_rows / 2) / F.col("n")).alias("share"))
    keyed = rows.withColumn("key", F.xxhash64("id", "toxic"))
    chosen = keyed.join(share, "toxic").where(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20)).dropDuplicates(["id", "toxic"])
    chosen = kept(chosen.orderBy("key").limit(2 * most_rows), "chosen")  # a bound in any case: it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "id").dropDuplicates(["key"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((k, -1 if i is None else i, y, terms(t)) for b in batches for k, i, y, t in zip(*(b.column(c).to_pylist() for c in ("key", "id", "toxic", "text")), strict=True))
        toxic = np.array([y for _, _, y, _ in own], bool)
        names = choose_terms([x for *_, x in own], toxic)
        place = {t: i for i, t in enumerate(names)}
        found = [(r, place[t], n) for r, (*_, x) in enumerate(own) for t, n in sorted(x.items()) if t in place]
        r, c, n = (np.array(v, np.int32) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        packed = _pack(names, [i for _, i, _, _ in own], toxic, np.ones(len(names)), [float(toxic.mean()) if len(toxic) else 0.0, 6, -3, 0], r, c, n)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    found = sample.select("key", "id", "toxic", "text").repartition(1).mapInArrow(learn, "model binary").first()
    none = np.zeros(0, np.int32)  # no task runs over an empty sample
    first = bytes(found["model"]) if found else _pack([], [], [], np.zeros(0), [0.0, 6, -3, 0], none, none, none)
    got = dict(np.load(io.BytesIO(first)))
    names = [str(t) for t in got["names"]]
    shared = spark.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, seen, n = Lookup(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                n += 1
                for t in lookup(text):
                    seen[t] += 1
        seen[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["term", "n"])

    held = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in held.collect()}  # a row per chosen term of the sample
    total = df.get(len(names), 0)
    idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(len(names))])
    parts = [names, got["ids"], got["toxic"], idf, got["numbers"], got["rows"], got["cols"], got["counts"]]
    model = Model(_pack(*parts))
    # Half of the sample is toxic where labels allow; the calibration keeps to the sample, the prior to the labels.
    slope, shift, bare = model.calibrate()
    rates = {r["toxic"]: r["n"] for r in counts.collect()}  # two rows at most
    prior = rates.get(True, 0) / max(1, sum(rates.values()))
    weight = (prior / max(1e-9, model.prior)) if 0 < model.prior < 1 else 1.0
    odds = bare / max(1e-9, 1 - bare) * weight / max(1e-9, (1 - prior) / max(1e-9, 1 - model.prior))
    parts[4] = [model.prior, slope, shift, odds / (1 + odds)]
    return _pack(*parts)


def score_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """One row (id_col, score, predicted, evidence) per row of docs; evidence lists the nearest examples (id, toxic, cosine).

    A text without any of the model's terms, a null or empty one too, has no neighbour and gets the rate of label 1 among
    such examples.  Of equally near examples the first in the index count.  Rows are scored one by one, whole, however long; repeated rows and null
    ids stand for themselves, an empty table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.bool_()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(shared.value)
        for b in batches:
            found = [scorer.score(t) for t in b.column(text_col).to_pylist()]
            score = np.array([s for s, _ in found], float)
            near = [[{"id": int(scorer.ids[i]), "toxic": bool(scorer.toxic[i]), "cosine": float(c)} for c, i in n[:evidence]] for _, n in found]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, near_type)], [id_col, "score", "predicted", "evidence"])

    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, evidence array<struct<id: long, toxic: boolean, cosine: double>>")
