"""Vectors, classifiers, fingerprints and archives: brute force, held-out accuracy and round trips."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import langid, merkle, toxicity, vectors, warc


def plain_links(rows, threshold=0.9):
    usable = {}
    for i, v in rows:
        if v and None not in v:
            a = np.array(v, float)
            if np.isfinite(a).all() and np.abs(a).max() > 0:
                a = a / np.abs(a).max()
                usable[i] = a / np.linalg.norm(a)
    links = {i: {j for j in usable if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= threshold} for i in usable}
    part = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            least = min([part[i], *(part[j] for j in js)])
            if least != part[i]:
                part[i], changed = least, True
    return {i: (len(links.get(i, ())), part[i]) for i, _ in rows}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 2, 9, 60):
        centre = rng.normal(size=24)
        rows += [(len(rows) + k, (centre + 0.15 * rng.normal(size=24)).tolist()) for k in range(size)]
    rows += [(100 + k, rng.normal(size=24).tolist()) for k in range(150)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23), (304, [float("inf")] * 24), (305, [None] + [1.0] * 23), (306, [1e-200] * 24), (307, [1e200] * 24), (308, [1.0, 2.0]), (309, rows[5][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(table).collect()}
    assert got == plain_links(rows)
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_link_saturated_groups(spark):
    """Groups of near copies whose links across lie between 0.9 and the similarity inside; the last two have their centres below 0.9."""
    rng = np.random.default_rng(12)
    rows = []
    for size, across in ((20, 0.93), (150, 0.925), (60, 0.895)):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for centre in (a, across * a + np.sqrt(1 - across**2) * b):
            rows += [(len(rows) + j, (centre + 0.1 / np.sqrt(32) * rng.normal(size=32)).tolist()) for j in range(size)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_links(rows)
    assert len({part for _, part in want.values()}) == 3
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(table).collect()} == want
    # Lists alone, without an audit that could ask for more: one entry a list.
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(table, k=2, goal=0.0).collect()} == want


def test_audit_sees_lost_pairs(spark):
    """A large group found whole and pairs all lost: the audit says so, and without a round that finds them all are compared."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.01 * rng.normal(size=16)).tolist()) for i in range(200)]
    for i in range(200, 240, 2):
        pair = rng.normal(size=16)
        rows += [(i + j, (pair + 0.01 * rng.normal(size=16)).tolist()) for j in range(2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = vectors.unit_vectors(table, "vec_id", "embedding").selectExpr("id AS node", "vec", "1L AS copies")
    group = spark.range(200).selectExpr("id AS node", "0L AS part")
    assert vectors.audit(nodes, group, vectors._counted(nodes, group, 0.9), 0.9) < 0.1
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(table, most_rounds=1, goal=2.0, tables=1, k=2).collect()}
    assert got == plain_links(rows)


WORDS = {"aa": ["haus", "baum", "straße", "und", "nicht", "wasser", "zeit"], "bb": ["house", "tree", "street", "and", "water", "time", "the"], "cc": ["casa", "árbol", "calle", "agua", "tiempo", "el", "niño"]}


def test_language_is_learned(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang) for k in range(600) for lang in [rng.choice(list(WORDS))]]
    docs = spark.createDataFrame([(i, t, x, 1.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs.where("doc_id < 400"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "123 !?"), (None, "house tree the"), (1003, "haus und baum " * 20_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text").union(odd), model).collect()}
    assert np.mean([found[i].lang_pred == x for i, _, x in rows if i >= 400]) > 0.97
    assert all((found[i].lang_pred, found[i].score, found[i].accepted) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert found[None].lang_pred == "bb" and found[1003].lang_pred == "aa"
    kept = langid.accepted_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(rows)
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), nothing).collect()} == {"und"}


def test_language_sample_is_filled_by_different_texts(spark):
    """One text makes up most of a language's rows."""
    rows = [("copied", "aa")] * 20_000 + [(f"text {k}", "aa") for k in range(400)] + [(f"other {k}", "bb") for k in range(400)]
    got = dict(langid.sampled(spark.createDataFrame(rows, "text string, lang string"), 200).groupBy("lang").count().collect())
    assert 60 < got["aa"] < 140 and 60 < got["bb"] < 140


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(8)
    examples = []
    for _ in range(500):
        own = rng.choice(60, 5, replace=False)
        w = rng.random(5)
        w /= np.linalg.norm(w)
        examples.append(dict(zip(own.tolist(), w.tolist(), strict=True)))
    index = toxicity.Index(examples, 60)
    for q in examples[:40]:
        score = np.array([sum(w * e.get(t, 0.0) for t, w in q.items()) for e in examples])
        want = sorted(((-s, i) for i, s in enumerate(score) if s > 0))[:16]
        got = index.nearest(q, 16)
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_toxicity_is_learned(spark):
    rng = random.Random(3)
    plain, bad = [f"plain{k}" for k in range(300)], ["vileword", "nastiness", "hatefully", "wretchedly"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=30) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id < 600").select("doc_id", "toxic"))
    odd = spark.createDataFrame([(2000, None), (2001, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score_documents(docs.select("doc_id", "text").union(odd), model).collect()}
    assert np.mean([found[i].predicted == y for i, _, y in rows if i >= 600]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values()) and found[2000].predicted == found[2001].predicted == 0
    # The whole score, by a plain k-nearest-neighbours over the model's terms; ties and evidence too.
    m = toxicity.Model(model)
    known = {t: k for k, t in enumerate(m.names)}
    texts = {i: t for i, t, _ in rows} | {2000: None, 2001: ""}
    bags = {i: {known[t]: n for t, n in toxicity.terms(t).items() if t in known} for i, t in texts.items()}
    idf = [np.log((1 + len(rows)) / (1 + sum(k in bags[i] for i, *_ in rows))) + 1 for k in range(len(known))]
    assert np.allclose(idf, m.idf) and {"vileword", "nastiness", "hatefully", "wretchedly"} <= set(known)

    def vector(i):
        v = np.zeros(len(known))
        for k, n in bags[i].items():
            v[k] = (1 + np.log(n)) * idf[k]
        return v / (np.linalg.norm(v) or 1)

    examples = np.array([vector(i) for i in m.ids.tolist()])
    for i in texts:
        cosine = examples @ vector(i)
        near = [k for k in np.lexsort((np.arange(len(cosine)), -cosine.round(12)))[:16] if cosine[k] > 0]
        raw = (sum(cosine[k] for k in near if m.toxic[k]) + 0.5 * m.prior) / (sum(cosine[k] for k in near) + 0.5)
        assert found[i].score == pytest.approx(1 / (1 + np.exp(-(m.slope * raw + m.shift))) if near else m.bare, abs=1e-6)
        assert [e.cosine for e in found[i].evidence] == pytest.approx([cosine[k] for k in near[:3]])
    clashing = docs.selectExpr("doc_id", "text", "toxic AS score", "1 AS predicted", "2 AS evidence", "3 AS key")
    again = toxicity.score_documents(clashing.union(clashing), model)
    assert again.count() == 2 * len(rows) and again.distinct().count() == len(rows)
    none = toxicity.fit(docs, docs.limit(0).select("doc_id", "toxic"))
    assert {r.predicted for r in toxicity.score_documents(docs.limit(20), none).collect()} <= {0, 1}


TEXTS = ["", None, "One sentence. Another one!\n\nA new paragraph? Yes.", "a" * 5000, "\n\n\n", "x. " * 3000, "One sentence. Another one!\n\nA new paragraph? Yes.", "é" * 99]


def test_fingerprints_and_edits(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, bucket int").repartition(3)
    found = {r.id: r for r in merkle.edited_pairs(docs).collect()}
    whole = [t or "" for t in TEXTS]
    assert set(found) == set(range(len(whole)))
    for i, text in enumerate(whole):
        other, half = whole[(i + 1) % len(whole)], len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(edited)
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found[2].fingerprint == found[6].fingerprint
    assert merkle.edited_pairs(docs.limit(0)).count() == 0


def test_branches_locate_an_edit():
    rng = random.Random(1)
    parts = [" ".join(f"w{rng.randrange(999)}" for _ in range(20)) + ".\n" for _ in range(60)]
    changed = [*parts[:30], "quite another paragraph.\n", *parts[31:]]
    spans = merkle.edits(merkle.fingerprint("".join(changed)), merkle.fingerprint("".join(parts)))
    start = len("".join(parts[:30]))
    assert any(a <= start < b for a, b in spans) and sum(b - a for a, b in spans) < 0.2 * len("".join(parts))


def pages():
    rng = random.Random(5)
    big = "".join(rng.choice("abcdef \n") for _ in range(5000))
    rows = [(i, f"http://h/{i}", "é" * rng.randint(0, 900)) for i in range(60)]
    return [*rows, (100, "u", big), (101, "u\r\nX: y", big), (102, None, big), (103, "u", "short"), (104, "u", "short"), (105, "u", None), (106, "u", ""), (107, "u", "WARC/1.1\r\n\r\n" * 200), (108, "u", "z" * 999), (109, "u", "z" * 999), (110, "u", "y" * 1000), (111, "u", "y" * 1000), (112, "u", big * 60)]


@pytest.mark.parametrize("range_bytes", [101, 4 << 20])
def test_archives_round_trip(spark, range_bytes):
    rows = pages()
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    files = warc.write_archives(table)
    found = {int(r.record_id[len(warc.PREFIX) :]): r for r in warc.read_archives(files, range_bytes).collect()}
    keeper = {}
    for i, _, html in rows:
        keeper[html] = max(i, keeper.get(html, i))
    assert set(found) == {i for i, _, _ in rows}
    for i, _, html in rows:
        payload, r = (html or "").encode(), found[i]
        revisit = len(payload) >= 1000 and keeper[html] != i
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (f"{warc.PREFIX}{keeper[html]}" if revisit else None)
        assert revisit or bytes(r.payload) == payload
    assert sum(r.records for r in files.collect()) == len(rows)


def test_foreign_archives(spark, tmp_path):
    """Junk between members, records of other types and an archive without records."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"junk" + warc.MAGIC + b"junk" + gzip.compress(info) + warc.MAGIC + gzip.compress(b"not a record") + gzip.compress(info))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in tmp_path.iterdir()], "path string, bytes long")
    rows = warc.read_archives(files, 10).collect()
    assert len(rows) == 2 and all((r.record_type, bytes(r.payload)) == ("warcinfo", b"abcd") for r in rows)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    rows = []
    for k in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choices(WORDS[lang], k=rng.randint(20, 80)))
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    rows += [(500, rows[0][1], "aa", "s0", 1), (501, None, None, None, None), (502, "9 9 9", "aa", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mix", "pack"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
    last = pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    ids = {r.doc_id for r in last.select("doc_id").distinct().collect()}
    assert not ids & {500, 501, 502} and len(ids) > 200
    whole = pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == last.agg(F.sum("length")).first()[0]
