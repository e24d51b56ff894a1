import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import bytebpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "\n\n x", "\t a", "a\n b\n", "3 4a5", "don't 's", "x<|endoftext|>y", "é ü\xa0 z\xa0", "日本 語", "a \xa0b", " \n", "\x85 x", "²½ x", "ªº µ", None]


def test_ids_equal_the_library():
    library = Tokenizer.from_file(PATH)
    texts = [x for x in ODD if x is not None] + ["word " * 3000]
    for text, ids in zip(texts, bytebpe.encoder(PATH).ids(texts), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist()


CORPUS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(CORPUS), reason="the driver's tables are not here")
def test_ids_of_the_corpus_equal_the_library():
    """Every document of a table: so that no two pieces with one hash go unseen."""
    library = Tokenizer.from_file(PATH)
    texts = [x or "" for x in pq.read_table(CORPUS, columns=["text"])["text"].to_pylist()]
    for text, ids in zip(texts, bytebpe.batch_ids(pa.array(texts), PATH), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_every_id_lies_in_one_piece(spark):
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    texts = [*ODD, "a " * 9000, *[" ".join(["tree"] * int(n)) for n in rng.integers(0, 1500, 300)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, start string")
    rows = packing.pack_documents(docs.repartition(3), PATH).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {*range(len(texts)), None}
    for i, t in enumerate(texts):
        want = [*(library.encode(t, add_special_tokens=False).ids if t else []), 1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert got == want and {r.doc_tokens for r in parts} == {len(want)}
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert all(zlib.crc32(r.ids) == r.crc for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        total = sum(r.length for r in parts)
        assert total <= 2048 and total & (total - 1) == 0  # 2048 itself is one


def test_open_windows_stay_bounded():
    packer = packing.Packer(64, most_open=10)
    for i in range(200):
        packer.add(i, np.full(40, i, np.int32))
        assert packer.n_open <= 10
    packer.drain()
    assert sum(len(p[2]) for s in packer.closed for p in s) == 200 * 40


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
