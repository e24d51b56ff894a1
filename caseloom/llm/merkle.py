"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

A paragraph ends at a line break; its leaves are pieces of at most 64 characters up to a sentence's end.  A section ends
after a paragraph whose hash says so (one in four), so an edit moves no other section's border.  The fingerprint is the
root and the leaves' short hashes and lengths, sections set apart by ``/`` and paragraphs by ``.``; equal roots mean
equal texts, and branches that differ tell where texts differ.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded

_PIECE = re.compile(r"\n{1,64}|[^.!?\n]{1,64}[.!?]{0,64}|[.!?]{1,64}")
LEAF = 10  # characters of a leaf in a fingerprint: eight of its hash, two of its length


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text: 32 hex digits of the root, ``:``, and the tree's leaves."""
    sections: list[bytes] = []
    shown: list[str] = []
    paragraphs: list[bytes] = []
    names: list[str] = []
    leaves: list[bytes] = []
    own: list[str] = []

    def end_paragraph() -> None:
        digest = blake2b(b"".join(leaves), digest_size=16).digest()
        paragraphs.append(digest)
        names.append("".join(own))
        leaves.clear()
        own.clear()
        if digest[0] % 4 == 0:
            end_section()

    def end_section() -> None:
        sections.append(blake2b(b"".join(paragraphs), digest_size=16).digest())
        shown.append(".".join(names))
        paragraphs.clear()
        names.clear()

    for piece in _PIECE.findall(text):
        digest = blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        leaves.append(digest)
        own.append(f"{digest[:4].hex()}{len(piece):02x}")
        if piece[0] == "\n":
            end_paragraph()
    if leaves:
        end_paragraph()
    if paragraphs:
        end_section()
    return f"{blake2b(b''.join(sections), digest_size=16).hexdigest()}:{'/'.join(shown)}"


def _leaves(part: str) -> list[str]:
    flat = part.replace("/", "").replace(".", "")
    return [flat[i : i + LEAF] for i in range(0, len(flat), LEAF)]


def likeness(a: str, b: str) -> float:
    """Share of characters in leaves that both hold (Dice coefficient): 1 for equal fingerprints, 0 if nothing is shared."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = Counter(_leaves(a[33:])), Counter(_leaves(b[33:]))
    size = lambda c: sum(n * int(k[8:], 16) for k, n in c.items())
    total = size(x) + size(y)
    return 2 * size(x & y) / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) in characters of the paragraphs of a's text that are in none of b's differing sections alike."""
    if a[:32] == b[:32]:
        return []
    theirs = Counter(b[33:].split("/"))
    other = Counter(p for s, n in theirs.items() for p in s.split(".") for _ in range(n))
    out: list[tuple[int, int]] = []
    at = 0
    for section in a[33:].split("/"):
        same = theirs[section] > 0
        for paragraph in section.split("."):
            size = sum(int(k[8:], 16) for k in _leaves(paragraph))
            if not same and other[paragraph] <= 0:
                out.append((at, at + size))
            elif not same:
                other[paragraph] -= 1
            at += size
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, fingerprint) per row of docs, each for itself; a null text is empty, other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])], [id_col, "n_chars", "fingerprint"])

    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, make, columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """make((id, text), (next id, next text)) rows for every document and its next by id, null ids first, after the last the first.

    One shuffle by ranges of ids that begin at known ids; each range also gets the first document of the next range, the last
    one the first of all.  Of rows with one id the order is that of their texts.  Null texts are empty.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    shares = [i / parts for i in range(1, parts)]
    facts = rows.agg(F.percentile_approx("id", shares or [0.5], 10_000).alias("at"), F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    low = None if facts["nulls"] else facts["least"]
    bounds = sorted({x for x in facts["at"] or [] if low is None or x > low})
    edges = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    bucket = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda x: x <= F.col("id")))).cast("int")
    last = len(bounds)
    is_low = F.col("id").isNull() if low is None else F.col("id") == low
    ahead = F.when(F.col("id").isin(bounds), F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("ahead")), F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("ahead"))))
    ahead = ahead.when(is_low, F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("ahead")), F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("ahead"))))
    dealt = rows.withColumn("to", F.explode(ahead.otherwise(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("ahead")))))).select("to.bucket", "to.ahead", "id", "text")
    names = [c.split(" ")[0].strip("`") for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) if names[i] != "id" else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

        waiting, at, over = None, None, False
        for rows in batches:
            for where, sentinel, *doc in zip(*(rows.column(c).to_pylist() for c in ("bucket", "ahead", "id", "text")), strict=True):
                if where != at:
                    waiting, at, over = None, where, False
                if over:
                    continue
                if waiting is not None:
                    out.append(make(waiting, doc))
                    size += len(waiting[1])
                    if size > 2 << 20:
                        yield batch()
                        out, size = [], 0
                waiting, over = (None, True) if sentinel else (doc, False)
        if out:
            yield batch()

    ranged = dealt.repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "ahead", F.col("id").asc_nulls_first(), "text")
    return ranged.mapInArrow(run, columns)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, in ascending id (null first), after the last the first; a lone document is its own next.  Null texts
    are empty; repeated rows follow each other; an empty table gives no rows.
    """
    held: dict[str, str] = {}

    def make(doc: tuple, after: tuple) -> tuple:
        text, other = doc[1], after[1]
        mine = held.pop("text", None)
        own = held["print"] if mine == text else fingerprint(text)
        held["text"], held["print"] = other, fingerprint(other)
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        made = fingerprint(changed)
        return doc[0], len(text), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, made, likeness(own, made), likeness(own, held["print"])

    columns = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, make, columns, id_col, text_col)
