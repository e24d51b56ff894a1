"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams (ASCII letters in lower case, other bytes
beyond ASCII as they are, all else a gap).  As the softmax is linear, embedding times weights is one table of logits
by bucket, and a text's logits are the mean of its grams' rows.  A temperature fitted on held-back texts calibrates
the score; below the score that all but ``reject`` of the right held-back answers reach, a prediction is rejected.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import trimmed
from .shared import bounded, kept
from .textnum import text_chunks

BUCKETS, DIMENSIONS, ORDERS = 1 << 16, 16, (2, 3, 4)
_LETTER = np.zeros(256, np.uint32)
for _c in range(256):
    _LETTER[_c] = _c if _c >= 0x80 or chr(_c).isalpha() else 0
    if 65 <= _c <= 90:
        _LETTER[_c] = _c + 32
_GAP = 4  # longer than a gram, so none reaches into the next text


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket of the gram at each place, 0 for a gap alone; each row's first place)."""
    lengths = np.diff(offsets)
    padded = np.zeros(len(data) + _GAP * (len(lengths) + 1), np.uint32)
    shift = _GAP * np.arange(1, len(lengths) + 1)
    letters = _LETTER[data]
    capital = np.flatnonzero((letters[1:] >= 0x80) & (letters[1:] <= 0x9E) & (letters[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    letters[capital] += 0x20  # A-grave to capital thorn in UTF-8
    padded[np.arange(len(data)) + np.repeat(shift, lengths)] = letters
    first = offsets[:-1] + shift - _GAP
    n = len(padded) - _GAP
    code = padded[:n].copy()
    for order in range(2, max(ORDERS) + 1):
        code = code * np.uint32(0x01000193) + padded[order - 1 : order - 1 + n]
        if order in ORDERS:
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            bucket = (h >> np.uint32(16)).astype(np.uint16)
            bucket[code == 0] = 0
            yield bucket, first


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    found = np.concatenate([b for b, _ in gram_buckets(data, np.array([0, len(data)]))])
    which, n = np.unique(found[found > 0], return_counts=True)
    return which.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[bytes], langs: list[str], epochs: int = 6, rate: float = 0.1, reject: float = 0.002, seed: int = 5) -> dict:
    """The model of labelled texts: names, logits by bucket, bias, temperature and least accepted score."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    spans = []
    for t in texts:  # a short span of each text besides the whole, so that short texts are known too
        words = t.split()
        a = int(rng.integers(0, max(1, len(words))))
        spans.append(b" ".join(words[a : a + int(rng.integers(1, 12))]))
    rows = [_features(t) for t in [*texts, *spans]]
    y = np.concatenate([y, y]) if len(texts) else y
    held = np.tile(rng.random(len(texts)) < 0.2, 2) if len(texts) >= 10 else np.zeros(len(rows), bool)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = np.flatnonzero(~held)
    seen, seen_w, seen_b = np.full(BUCKETS, 1e-9, np.float32), np.full(weights.shape, 1e-6, np.float32), np.full(bias.shape, 1e-6, np.float32)
    for epoch in range(epochs if len(names) > 1 else 0):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(order).tolist():
            which, part = rows[i]
            if not len(which):
                continue
            mean = part @ table[which]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = part[:, None] * (weights @ p)  # steps are scaled by the root of past squared gradients
            turn = np.outer(mean, p)
            seen_w += turn * turn
            seen_b += p * p
            seen[which] += (back * back).mean(1)
            weights -= step * turn / np.sqrt(seen_w)
            bias -= 0.1 * step * p / np.sqrt(seen_b)
            table[which] -= step * back / np.sqrt(seen[which])[:, None]
    logits = (table @ weights).astype(np.float32)
    logits[0] = 0
    z = np.array([part @ logits[which] + bias for i, (which, part) in enumerate(rows) if held[i] and len(which)]).reshape(-1, max(1, len(names)))
    answer = np.array([y[i] for i in range(len(rows)) if held[i] and len(rows[i][0])], np.int64)
    temperature, least = 1.0, 0.0
    if len(answer):
        doubt = 1 / (len(answer) + 2)  # as if one more answer had been wrong

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            logs = s - np.log(np.exp(s).sum(1, keepdims=True))
            others = (logs.sum(1) - logs[np.arange(len(s)), answer]) / max(1, len(names) - 1)
            return -float(((1 - doubt) * logs[np.arange(len(s)), answer] + doubt * others).mean())

        temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
        s = np.exp((z - z.max(1, keepdims=True)) / temperature)
        s /= s.sum(1, keepdims=True)
        right = s.argmax(1) == answer
        if right.any():
            least = min(0.5, float(np.quantile(s[right].max(1), reject)))
    return {"names": names, "logits": logits, "bias": bias, "temperature": temperature, "least": least}


def _packed(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, names=np.array(model["names"], object).astype("U") if model["names"] else np.zeros(0, "U1"), **{k: np.asarray(v) for k, v in model.items() if k != "names"})
    return out.getvalue()


def sampled(labelled: DataFrame, most_rows: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text, key) of about most_rows different rows; a language's share is that of its different texts."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    keyed = rows.withColumn("key", F.xxhash64("lang", "text"))
    counts = keyed.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    quota = counts.withColumn("langs", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row a language
    share = kept(quota.select("lang", (F.lit(most_rows) / F.col("langs") / F.col("n")).alias("share")), "share")  # its size is known: texts stay in place
    return bounded(keyed).join(share, "lang").where(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20)).dropDuplicates(["key"])


def fit(labelled: DataFrame, most_rows: int = 3000, text_col: str = "text", lang_col: str = "lang") -> bytes:
    """A model of at most about most_rows rows of labelled (text, lang), as many of each language as there are or fit.

    The bound is on rows; a row's whole text is used.  Rows are chosen by their hash, equal rows count once; rows with
    null text or language are left out.  Training runs in one task on those rows; the model (65,536 buckets by language)
    is all that comes to the driver.
    """
    sample = sampled(labelled, most_rows, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((k, t, x) for b in batches for k, t, x in zip(*(b.column(c).to_pylist() for c in ("key", "text", "lang")), strict=True))
        model = train([t.encode() for _, t, _ in own], [x for _, _, x in own])
        yield pa.RecordBatch.from_arrays([pa.array([_packed(model)], pa.binary())], ["model"])

    found = sample.select("key", "text", "lang").repartition(1).mapInArrow(trimmed(run), "model binary").first()
    return bytes(found["model"]) if found else _packed(train([], []))  # no task runs over an empty sample


def _predictor(model: bytes):
    """A function of (batch, text column) to (languages, scores, accepted)."""
    got = np.load(io.BytesIO(model))
    names, logits, bias, temperature, least = ([str(x) for x in got["names"]], got["logits"], got["bias"], float(got["temperature"]), float(got["least"]))
    by_lang = [np.ascontiguousarray(logits[:, k]) for k in range(len(names))]

    def predict(batch: pa.RecordBatch, text_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = batch.num_rows
        if not names:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        total, grams = np.zeros((n, len(names))), np.zeros(n)
        for row, data, offsets in text_chunks(batch, text_col, 1 << 19):
            rows = slice(row, row + len(offsets) - 1)
            for bucket, first in gram_buckets(data, offsets):
                grams[rows] += np.add.reduceat(bucket > 0, first, dtype=np.int64)
                for k, column in enumerate(by_lang):
                    total[rows, k] += np.add.reduceat(column[bucket], first, dtype=np.float64)
        letters = pc.match_substring_regex(batch.column(text_col), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)  # no text becomes a Python string
        z = (total / np.maximum(grams, 1)[:, None] + bias) / temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = np.where(letters, p[np.arange(n), best], 0.0)
        said = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return said, score, letters & (score >= least)

    return predict


def identify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, lang_pred, score, accepted) per row of docs.

    lang_pred is a language of the model, or ``und`` (score 0, not accepted) for a text that is null or without a letter, or
    if the model has no languages.  Whole texts are read.  score is the calibrated probability of lang_pred; accepted
    tells whether it reaches the model's least score.  Each row stands for itself: repeated rows and null ids too.  An empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(shared.value)
        for batch in batches:
            said, score, accepted = predict(batch, text_col)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(said, pa.string()), pa.array(score), pa.array(accepted)], [id_col, "lang_pred", "score", "accepted"])

    return bounded(docs).select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def accepted_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language identify() accepts; only texts go to Python, a boolean comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = _predictor(shared.value)
        for text in texts:
            yield pa.array(predict(pa.RecordBatch.from_arrays([text], ["text"]), "text")[2])

    return bounded(docs).where(accepted(F.col(text_col)))
