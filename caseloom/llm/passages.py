"""Repeated passages by sparse suffix arrays.

Of a document's suffixes only those at minimisers are kept: places whose 8-word hash is the least of 32 in a row.  The
choice depends on the words alone, so copies of a passage keep the same places: one of at least 50 words holds, for every run of
50 words in it, a kept suffix with 19 words or more of the run to its right.  Suffixes whose first 19 words no other document's
share are dropped.  The others are sorted by their words, over all documents; neighbours are compared, which gives the lengths
of common beginnings, and matches are extended left: of the suffixes between which no common beginning is too short, those with
equal words before them hold the same run.  Where common beginnings cross the end of a chunk, one suffix of each run goes on: these
are sorted again, by the words before them, and what then still crosses an end, which is little, meets by the hashes of its runs.
Overlapping runs join into passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed
from .shared import bounded, kept
from .textnum import mix, run_hashes, text_chunks, word_bounds, word_hashes

GRAM, STEPS = 8, 5
ROW = 1 << STEPS  # minimisers are chosen among so many places
BITS = 1 << 22  # places of the table of documents with spans, 512 KB
CHUNK = 16_000  # sorted suffixes that a task compares at a time


class Suffixes:
    """Kept suffixes of a chunk of texts: for each run of ``least`` words its start and the place of the suffix chosen for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int) -> None:
        self.words, self.first = word_hashes(data, offsets, lower=False)
        n = len(self.words)
        value = run_hashes(self.words, GRAM)
        place = np.arange(len(value))
        for k in range(STEPS):
            step = 1 << k
            if len(value) <= step:
                value, place = value[:0], place[:0]
                break
            right = value[step:] < value[:-step]
            value = np.where(right, value[step:], value[:-step])
            place = np.where(right, place[step:], place[:-step])
        lengths = np.diff(self.first)
        start = np.zeros(n, bool)
        for a, k in zip(self.first[:-1][lengths >= least].tolist(), lengths[lengths >= least].tolist(), strict=True):
            start[a : a + k - least + 1] = True
        self.start = np.flatnonzero(start)
        self.chosen = place[self.start] if len(self.start) else self.start
        self.keys = run_hashes(self.words, least - ROW + 1)

    def digest(self, row: int) -> int:
        own = self.words[self.first[row] : self.first[row + 1]]
        n = np.arange(1, len(own) + 1, dtype=np.uint64)
        return int(mix((mix(own + n)).sum(keepdims=True) + np.array([len(own)], np.uint64)).view(np.int64)[0])


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id_col, digest, n_words, n_repeated, n_removed, spans) of the documents with passages of ``least`` words or more that others hold.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text as it stands.  n_repeated counts the words inside runs of ``least`` words
    that also occur in another document; spans lists those that a document with a smaller id holds too, as (start, end) in words,
    and n_removed counts their words.  So the first holder keeps each run.  Repeats inside one document don't count.  Texts
    below ``least`` words, null texts and rows with a null id take no part; of rows with one id and different texts each is judged by
    itself (digest tells them apart), and equal rows with one id are one document.  An empty table gives no rows; other
    columns are not read.
    """
    if least < ROW + GRAM:
        raise ValueError(f"least must be {ROW + GRAM} or more")
    texts = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, data, offsets in text_chunks(batch, "text"):
                words, first = word_hashes(data, offsets, lower=False)
                place = np.arange(1, len(words) + 1, dtype=np.uint64)
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a >= least:
                        total = mix(words[a:b] + place[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64)
                        rows.append((row + k, int(mix(total).view(np.int64)[0]), b - a))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["id", "digest", "n_words"])

    described = kept(texts.mapInArrow(trimmed(describe), "id long, digest long, n_words long").distinct(), "described")
    whole = described.groupBy("digest", "n_words").agg(F.min("id").alias("holder"), F.count("*").alias("copies"))
    whole = kept(whole, "whole")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()  # whole copies in a batch count once here
            for row, data, offsets in text_chunks(batch, "text"):
                s = Suffixes(data, offsets, least)
                places = np.unique(s.chosen)
                rows = np.searchsorted(s.first, places, "right") - 1
                digests = np.array([s.digest(k) for k in range(len(offsets) - 1)], np.int64)
                fresh = np.array([not (d in seen or seen.add(d)) for d in digests.tolist()], bool)
                ok = fresh[rows]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys[places[ok]].view(np.int64)), pa.array(digests[rows[ok]])], ["key", "digest"])

    found = texts.mapInArrow(trimmed(suffixes), "key long, digest long")
    # Neighbours in the order of the first words: a suffix goes on if some other document's equals it there.
    equal = found.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("key")
    going = kept(found.distinct().join(equal, "key"), "suffixes")
    by_doc = going.groupBy("digest").agg(F.collect_set("key").alias("keys"))
    chosen = kept(whole.join(by_doc, "digest").select(F.col("holder").alias("id"), "digest", "keys"), "chosen")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, holders = batch.column("digest").to_pylist(), batch.column("id")
            keys = batch.column("keys")
            for row, data, offsets in text_chunks(batch, "text"):
                s = Suffixes(data, offsets, least)
                codes = np.concatenate([np.zeros(ROW, np.uint32), (s.words >> np.uint64(32)).astype(np.uint32), np.zeros(least, np.uint32)])
                for k in range(len(offsets) - 1):
                    a, b = np.searchsorted(s.start, s.first[k : k + 2])
                    if a == b or s.digest(k) != wanted[row + k]:
                        continue
                    own = np.sort(keys[row + k].values.to_numpy().view(np.uint64))
                    have = s.keys[s.chosen[a:b]]
                    at = np.minimum(np.searchsorted(own, have), len(own) - 1)
                    good = own[at] == have
                    place, most = np.unique(s.chosen[a:b][good], return_index=True)  # a place's runs begin side by side
                    if not len(place):
                        continue
                    starts = s.start[a:b][good]
                    first, last = starts[most], starts[np.append(most[1:], len(starts)) - 1]
                    left = codes[place[:, None] + np.arange(ROW)[::-1]]  # the words before the place, nearest first
                    right = codes[place[:, None] + np.arange(ROW, ROW + least)]
                    n, words = len(place), np.int64(s.first[k])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.keys[place].view(np.int64)), _fixed(left), _fixed(right), pa.array((1 << (place - first + 1)) - (1 << (place - last))), pa.array((place - words).astype(np.int64)), pa.array(np.full(n, wanted[row + k])), holders[row + k : row + k + 1].take(pa.array(np.zeros(n, np.int64))),
                        ],
                        ["key", "left", "right", "open", "place", "digest", "holder"],
                    )

    columns = "key long, left binary, right binary, open long, place long, digest long, holder long"
    suffix = kept(texts.join(chosen, "id").mapInArrow(trimmed(contexts), columns).dropDuplicates(["digest", "place"]), "contexts")
    once = kept(_sorted(suffix, "right").mapInArrow(trimmed(_compared("right", least, chunk)), RESULT), "compared")
    going = once.where("open <> 0")
    twice = kept(_sorted(going, "left").mapInArrow(trimmed(_compared("left", least, chunk)), RESULT), "compared")
    # What crosses ends in both orders: the same question, by the hashes of the runs.
    crossing = twice.where("open <> 0").select("digest", "place", "holder", F.inline("runs"))
    first = crossing.groupBy("run").agg(F.min("holder").alias("first"), F.max("holder").alias("last")).where("first <> last")
    met = crossing.join(first, "run").select("digest", "place", F.expr("shiftleft(1L, step)").alias("bit"), (F.col("holder") > F.col("first")).alias("later"))
    met = met.select("digest", "place", F.col("bit").alias("every"), F.when(F.col("later"), F.col("bit")).otherwise(F.lit(0).cast("long")).alias("later"))
    found = [x.select("digest", "place", "every", "later").where("every <> 0") for x in (once, twice, met)]
    marks = found[0].union(found[1]).union(found[2])
    by_doc = marks.groupBy("digest").agg(F.collect_list(F.struct("place", "every", "later")).alias("marks"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for marks in batch.column("marks").to_pylist():
                every, later = (_spans(sorted(m["place"] - k for m in marks for k in range(ROW) if m[which] >> k & 1), least) for which in ("every", "later"))
                rows.append((sum(b - a for a, b in every), later))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], kind)], ["digest", "n_repeated", "spans"])

    spans = kept(by_doc.mapInArrow(trimmed(joined), "digest long, n_repeated long, spans array<struct<start: long, end: long>>"), "spans")
    out = described.join(whole, ["digest", "n_words"]).join(spans, "digest", "left").where("copies > 1 OR n_repeated > 0")
    copy, later = F.col("copies") > 1, F.col("id") > F.col("holder")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    out = out.withColumn("spans", F.when(later, everything).otherwise(F.coalesce("spans", none)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return out.select(F.col("id").alias(id_col), "digest", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_repeated")).alias("n_repeated"), removed.alias("n_removed"), "spans")


RESULT = "digest long, place long, holder long, every long, later long, open long, key long, left binary, right binary, runs array<struct<step: int, run: long>>"
_PLACES = np.random.default_rng(20240612).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fixed(words: np.ndarray) -> pa.Array:
    """Rows of big-endian 32-bit words as binary values, which sort as the words do."""
    n, size = words.shape[0], words.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(words, ">u4").tobytes())])


def _words(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), ">u4").astype(np.uint64).reshape(len(t), -1)


def _sorted(suffixes: DataFrame, by: str) -> DataFrame:
    order = ["key", by, "digest", "place"]
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order)


def _prefix_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the first least, least + 1, ... words of each row."""
    h = np.zeros(len(words), np.uint64)
    out = []
    for k in range(words.shape[1] + 1):
        if k:
            h = mix(h * _STEP + words[:, k - 1] + np.uint64(1))
        if k >= least:
            out.append(h)
    return np.array(out)


def _compared(by: str, least: int, chunk: int):
    """Of suffixes sorted by the words to the right or to the left: which runs around them other documents hold (RESULT).

    Bit k of the masks stands for the run that begins k words before the place: every: another document holds it, later: one with
    a smaller id, open: neighbours beyond the end of the chunk may hold it, and of the chunk's suffixes with it this is the one
    to ask for.  Suffixes with open runs come with their words and, in the second order, the hashes of those runs.
    """

    def settled(t: pa.Table, begun: bool, goes_on: bool) -> pa.RecordBatch:
        key, holder, bits = (t.column(c).to_numpy() for c in ("key", "holder", "open"))
        left, right = _words(t, "left"), _words(t, "right")
        own = right if by == "right" else left
        differ = own[1:] != own[:-1]
        common = np.where(differ.any(1), differ.argmax(1), own.shape[1])  # with the suffix before it
        common[key[1:] != key[:-1]] = -1
        other = _prefix_hashes(left, 0) if by == "right" else _prefix_hashes(right, least - ROW + 1)[::-1]  # by step
        n = len(key)
        every, later, open_ = (np.zeros(n, np.int64) for _ in range(3))
        for k in range(ROW):
            segment = np.r_[0, np.cumsum(common < (least - k if by == "right" else k))]
            border = ((segment == 0) & begun) | ((segment == segment[-1]) & goes_on)
            at = np.flatnonzero((bits >> k & 1 == 1) & ((np.bincount(segment)[segment] > 1) | border))
            if not len(at):
                continue
            at = at[np.lexsort((other[k][at], segment[at]))]
            new = np.r_[True, (segment[at][1:] != segment[at][:-1]) | (other[k][at][1:] != other[k][at][:-1])]
            edge, number = np.flatnonzero(new), np.cumsum(new) - 1
            first, last = np.minimum.reduceat(holder[at], edge)[number], np.maximum.reduceat(holder[at], edge)[number]
            every[at[first < last]] |= 1 << k
            later[at[holder[at] > first]] |= 1 << k
            open_[at[border[at] & (holder[at] == first)]] |= 1 << k
        some = np.flatnonzero((every | open_) != 0)
        asked = pa.array(open_[some] != 0)
        runs = pa.nulls(len(some), pa.list_(pa.struct([("step", pa.int32()), ("run", pa.int64())])))
        if by == "left" and len(some):
            whole = np.concatenate([left[some, ::-1], right[some]], 1)
            hashes = np.stack([(whole[:, ROW - k : ROW - k + least] * _PLACES[:least]).sum(1) for k in range(ROW)], 1)
            row, step = np.nonzero(open_[some, None] >> np.arange(ROW) & 1)
            listed = pa.StructArray.from_arrays([pa.array(step.astype(np.int32)), pa.array(mix(hashes[row, step]).view(np.int64))], ["step", "run"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(some) + 1)), pa.int32()), listed)
        out = [t.column(c).take(pa.array(some)).combine_chunks() for c in ("digest", "place", "holder", "key", "left", "right")]
        out[4:] = [pc.if_else(asked, x, None) for x in out[4:]]
        masks = [pa.array(x[some]) for x in (every, later, open_)]
        return pa.RecordBatch.from_arrays([*out[:3], *masks, *out[3:], runs], RESULT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, begun = 0, True  # the first group of a range may have begun in the one before

        def part(last: bool) -> pa.RecordBatch:
            """What is held up to its last group, which may go on, or all of it if it is one large group."""
            nonlocal held, size, begun
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            end = len(key) if last or not len(cut) else int(cut[-1])
            out = settled(t.slice(0, end), begun, last or not len(cut))
            begun = not last and not len(cut)
            held, size = t.slice(end).to_batches(), len(key) - end
            return out

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > chunk:
                yield part(False)
        if held:
            yield part(True)

    return run


RESULT_NAMES = "digest place holder every later open key left right runs".split()


def _spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = a + length
        else:
            out.append([a, a + length])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """docs (doc_id, text and others) without the spans of repeated_passages; a text of which nothing is left goes with its row.

    What stands between words stays with the word before it.  n_chars, where there is one, is that of the new text.
    Columns of any name pass through; only texts and their spans go to Python.
    """
    found = repeated_passages(docs, least).where("n_removed > 0").select(F.col("doc_id").alias("of"), F.struct("digest", "spans").alias("cut"))
    found = kept(found.groupBy("of").agg(F.collect_list("cut").alias("cuts")), "cuts")
    names = docs.columns

    @F.arrow_udf("struct<text: string, gone: boolean>")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out, gone = [], []
        for text, own in zip(texts, cuts, strict=True):
            text, own = text.as_py(), own.as_py() or []
            spans = []
            if text and own:
                data = np.frombuffer(text.encode(), np.uint8)
                offsets = np.array([0, len(data)])
                digest = Suffixes(data, offsets, least).digest(0)
                spans = sorted((s["start"], s["end"]) for c in own if c["digest"] == digest for s in c["spans"])
            if spans:
                starts = np.append(word_bounds(data, offsets)[0], len(data)).tolist()
                parts, at = [], 0
                for a, b in spans:
                    parts.append(data[at : starts[a]])
                    at = starts[b]
                text = np.concatenate([*parts, data[at:]]).tobytes().decode()
            gone.append(bool(spans) and not text.split())
            out.append(text)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(gone, pa.bool_())], ["text", "gone"])

    cut = cut.asNondeterministic()  # else the plan computes it once for the filter and once for the text
    # A bit for each document that may have spans, in BITS places: others need not be shuffled to learn that they have none.
    spot = F.pmod(F.xxhash64("of"), F.lit(BITS))
    bits = found.groupBy(F.shiftright(spot, 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod(spot, F.lit(1 << 15))).alias("bits"))
    whole = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("of"))
    marked = whole.withColumn("spot", spot).withColumn("at", F.shiftright("spot", 15)).join(F.broadcast(bits), "at", "left")  # 128 rows of 4 KB at most
    byte = F.conv(F.hex(F.expr("substring(bits, cast(mod(spot, 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("maybe", F.coalesce(F.bit_get(byte, F.pmod("spot", F.lit(8)).cast("int")) == 1, F.lit(False)))
    same = marked.where("NOT maybe").select(*[F.col("row").getField(c).alias(c) for c in names])
    joined = marked.where("maybe").select("row", "of").join(found, "of", "left")
    cut_text = F.when(F.col("cuts").isNotNull(), F.col("row.text"))  # other texts need not go to Python
    made = joined.withColumn("new", cut(cut_text, "cuts")).where("NOT new.gone")
    text = F.when(F.col("cuts").isNotNull(), F.col("new.text")).otherwise(F.col("row.text"))
    number = F.when(F.col("cuts").isNotNull(), F.length("new.text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in names else None
    new = {"text": text, "n_chars": number}
    return same.union(made.select(*[new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in names]))
