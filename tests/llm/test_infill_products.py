"""Fill-in-middle, largest products and hard negatives against plain versions and DuckDB."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from caseloom.llm import infill, negatives, products, queries

DIR = "/root/testdata/sf0.01"
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain_infill(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = LINE.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def infill_texts():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "one line", "end\n", "a\nb", "<P>", "x<S>y\nz", "a<\nP>b\n<", "<P\n>", "<<S", "M>\n<P", "é\nß\r\n x\n日本\n", "\U0001f600\n" * 700, "word " * 60_000 + "\n" + "tail", "y\n" * 400_000]
    for _ in range(150):
        texts.append("".join(rng.choice("ab<PSM>\n\n\té日") for _ in range(rng.randint(0, 1500))))
    return texts


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 30)])
def test_infill_equals_plain_version(spark, rate, spm):
    rows = [(i if i % 31 else None, t, "x", 5, "f") for i, t in enumerate(infill_texts())]
    rows += rows[10:14]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int, form string").repartition(3)
    made = infill.fill_in_middle(docs, rate=rate, spm=spm)
    found = made.withColumn("back", infill.restored()).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r)[:6] for r in found) == order(plain_infill(r[0], r[1], rate, spm) for r in rows)
    assert order(r["back"] for r in found) == order(r[1] or "" for r in rows)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_infill_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 5000])
def test_rank_and_select(size):
    bits = np.random.default_rng(size).random(size) < 0.1
    have = infill.Bits(np.packbits(bits, bitorder="little"))
    at = np.arange(size + 1)
    assert have.rank(at).tolist() == np.r_[0, np.cumsum(bits)].tolist()
    ones = np.flatnonzero(bits)
    assert have.select(np.arange(1, len(ones) + 1)).tolist() == ones.tolist()


def vector_rows(seed=1, n=2600, d=12):
    """Loose vectors of many lengths, a hot vector, near copies, ties, repeated ids, unusable rows, another dimension."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.lognormal(0, 1.2, (n, 1))
    x[200:900] = x[7]
    x[1000:1150] = x[50] * (1 + rng.random((150, 1)) * 0.05) + rng.standard_normal((150, d)) * 0.002
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in rng.permutation(n)]
    rows += [rows[3], (50, rows[9][1], 2), (100, None, 1), (150, [], 1), (200, [1.0, None] + [0.0] * 10, 1), (250, [float("nan")] * d, 0), (300, [float("inf")] * d, 0)]
    rows += [(3000, [0.0] * d, 1), (3050, [0.0] * d, 2), (None, rows[0][1], 1), (3001, [1.0] * 5, 1), (3100, [2.0] * 5, 1), (3200, [-1.0] * 5, 3), (3002, [1e200] * d, 1), (4000, rows[5][1], None)]
    return rows


def usable(rows, labelled=False):
    out = []
    for i, v, label in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v) or (labelled and label is None):
            continue
        q = [int(np.floor(256 * c)) for c in v]
        if sum(c * c for c in q) < 2**62:
            out.append((i, tuple(q), label))
    return out


def product_table(queries_, rows):
    """For each query its (other row, product), best first."""
    dims = {d: [r for r in rows if len(r[1]) == d] for d in {len(r[1]) for r in rows}}
    for q in queries_:
        own = dims[len(q[1])]
        s = np.array([r[1] for r in own], np.int64) @ np.array(q[1], np.int64)
        found = [(r, int(v)) for r, v in zip(own, s, strict=True) if r[0] != q[0]]
        yield q, sorted(found, key=lambda p: (-p[1], p[0][0]))


def plain_top(rows, k):
    have = usable(rows)
    out = []
    for q, found in product_table(sorted({(r[0], r[1]) for r in have if r[0] % 50 == 0}), have):
        out += [(q[0], n + 1, r[0], s) for n, (r, s) in enumerate(found[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, id long, q int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("switch,most", [(0.9, 8 << 20), (0.3, 4000), (2.0, 8 << 20)])
def test_products_equal_brute_force(spark, monkeypatch, switch, most):
    monkeypatch.setattr(products, "HIGH_COSINE", switch)
    rows = vector_rows()
    df = frame(spark, rows)
    found = products.top_products(df, df.where("vec_id % 50 = 0"), most_bytes=most)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5)


def test_both_prunings_are_used():
    """Near copies of a query are found through coordinates, loose ones as a block, a short bucket is passed over."""
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.standard_normal(64))
    x = np.floor(256 * rng.standard_normal((500, 64)))
    x[100:110] = np.floor(q * 0.99)
    asked = products.Asked([{"id": -1, "label": 0, "dim": 64, "vec": q.astype(np.int32).tobytes()}])
    best = products.Best(1, 5)
    products._searched(asked, 64, float(np.sqrt((x * x).sum(1)).max()), np.arange(500), x[np.argsort(-(x * x).sum(1))], best)
    first = best.score.copy()
    bucket: dict = {}
    length = float(np.sqrt(q @ q))
    found = products._coordinates(x, q, length, 0.95, bucket)
    cosines = x @ q / length / np.sqrt((x * x).sum(1))
    assert set(np.flatnonzero(cosines >= 0.95)) <= set(found.tolist()) and len(found) < 60
    short = x / 100
    products._searched(asked, 64, float(np.sqrt((short * short).sum(1)).max()), np.arange(500), short, best)
    assert (best.score == first).all()


def test_products_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) * 2.0**20 for _ in range(3)], 0) for i in range(200)]
    df = frame(spark, rows)
    assert sorted(map(tuple, products.top_products(df, df.where("vec_id % 50 = 0")).collect())) == plain_top(rows, 5)


def plain_negatives(rows, every=20):
    have = usable(rows, labelled=True)
    out = []
    for a, found in product_table(sorted({r for r in have if r[0] % every == 0}), have):
        for p, ps in [(r, s) for r, s in found if r[2] == a[2]][:5]:
            inside = [(r, s) for r, s in found if r[2] != a[2] and 30 * ps <= 100 * s <= 90 * ps][:10]
            out += [(a[0], p[0], n + 1, r[0], ps, s) for n, (r, s) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("most", [8 << 20, 3000])
def test_negatives_equal_brute_force(spark, most):
    rows = vector_rows(4, 1500)
    df = frame(spark, rows)
    found = negatives.hard_negatives(df, df.where("vec_id % 20 = 0"), most_bytes=most)
    expected = plain_negatives(rows)
    assert len(expected) > 1000
    assert sorted(map(tuple, found.collect())) == expected


def test_empty_tables(spark):
    df = frame(spark, [])
    assert products.top_products(df, df).count() == 0
    assert negatives.hard_negatives(df, df).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op11_infill", "op12_products", "op13_negatives"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    expected = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    found = queries.QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(found.columns)
    rows = found.select(names).collect()
    assert rows and sorted(map(tuple, rows), key=repr) == sorted(expected.fetchall(), key=repr)
