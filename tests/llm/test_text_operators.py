"""Jaccard join, repeated passages, mixing and licence scans against plain versions and DuckDB."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import jaccard, licenses, mixing, passages, queries, textnum
from caseloom.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size int"


def fixture(spark, texts, sources=("a", "b")):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def near_texts(seed=3):
    """Groups of near copies, a chain of drifting copies, exact copies, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for size in (1, 2, 5, 12, 40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(15):
        chain[rng.randrange(len(chain))] = rng.choice(words)
        texts.append(" ".join(chain))
    texts += [texts[3].upper(), texts[3].replace(" ", "\n "), "one two", "ONE  two", "one two three", "", "   ", None, None, "a b c d e", "x " * 30_000]
    return texts


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(sets):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in ids}


def test_jaccard_equals_brute_force(spark):
    texts = near_texts()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = plain_components(sets)
    found = jaccard.near_duplicates(fixture(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets.items()}


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """With nearly every token frequent the combinations decide, and large groups go by their leaders."""
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 2)
    texts = near_texts(5)
    want = plain_components({i: shingles(t) for i, t in enumerate(texts)})
    found = jaccard.near_duplicates(fixture(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_jaccard_null_and_repeated_ids(spark):
    long = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, long), (1, long), (2, long), (2, "k l m n o p"), (5, "k l m n o p"), (7, None)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert found == [(-1, None), (1, 1), (2, 1), (2, 1), (5, 1), (7, 7)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted(r.doc_id or -1 for r in jaccard.without_near_duplicates(docs).collect())
    assert kept == [-1, 1, 7]


def plain_passages(texts, least=50):
    """{id: (repeated words, words that an earlier document holds too)} by runs of ``least`` words."""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    holders = {}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            holders.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = {}
    for i, w in words.items():
        every, later = set(), set()
        for k in range(len(w) - least + 1):
            own = holders[tuple(w[k : k + least])]
            if len(own) > 1:
                every.update(range(k, k + least))
            if min(own) < i:
                later.update(range(k, k + least))
        if every:
            out[i] = len(every), later
    return out


def passage_texts():
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    texts = []
    for k in range(40):
        own = [word() for _ in range(rng.randint(0, 120))]
        for s in rng.sample(shared, k % 3):
            at = rng.randint(0, len(own))
            own[at:at] = s
        texts.append(" ".join(own))
    return [*texts, texts[5], texts[5], None, "", " ".join(shared[3] * 3), "same " * 200, "same " * 300]


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_passages_equal_brute_force(spark, chunk):
    """With small chunks most groups are settled by the hashes of their runs, with large ones by neighbours."""
    texts = dict(enumerate(passage_texts()))
    want = plain_passages(texts)
    found = {r.doc_id: r for r in passages.repeated_passages(fixture(spark, list(texts.values())), chunk=chunk).collect()}
    assert set(found) == set(want)
    for i, (n, later) in want.items():
        assert found[i].n_repeated == n
        assert {k for s in found[i].spans for k in range(s.start, s.end)} == later
        assert found[i].n_removed == len(later)


def test_without_repeats_with_clashing_names(spark):
    texts = passage_texts()
    docs = fixture(spark, texts).selectExpr("*", "1 AS cuts", "2 AS row", "3 AS of", "4 AS digest", "5 AS new")
    kept = passages.without_repeats(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {(r.cuts, r.row, r.of, r.digest, r.new) for r in kept.collect()} == {(1, 2, 3, 4, 5)}
    mixed = mixing.mixed_documents(docs.selectExpr("*", "mod(doc_id, 7) AS part", "6 AS h", "7 AS edge"))
    assert {(r.part == r.doc_id % 7, r.h, r.edge, r.row) for r in mixed.collect()} == {(True, 6, 7, 2)}


def test_long_words_and_texts_hash_alike():
    """Hashes by spans equal those of the words alone, for a word beyond the span too."""
    text = ("some wörds here " * 40_000 + "x" * 700_000 + " and the end").encode()
    words, _ = textnum.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    alone = {}
    for k, w in enumerate(text.split()):
        if w not in alone:
            alone[w] = textnum.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]
        assert words[k] == alone[w]
    assert len(set(alone.values())) == len(alone)


def test_without_repeats_cuts_and_keeps(spark):
    texts = dict(enumerate(passage_texts()))
    want = plain_passages(texts)
    kept = {r.doc_id: r for r in passages.without_repeats(fixture(spark, list(texts.values()))).collect()}
    for i, t in texts.items():
        words = WORD.findall(t or "")
        left = [w for k, w in enumerate(words) if k not in want.get(i, (0, set()))[1]]
        if left or not words:
            assert WORD.findall(kept[i].text or "") == left and (i in want or kept[i].text == t)
        else:
            assert i not in kept
    assert passages.repeated_passages(fixture(spark, texts.values()).limit(0)).count() == 0


def mixed_rows(spark, docs):
    return {r.doc_id: r for r in mixing.mix_sources(docs).collect()}


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(3000)] + [(3000, None, "empty"), (3001, "big " * 9000, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed_rows(spark, docs)
    by_source = {}
    for r in found.values():
        assert 0 <= r.taken <= 2 * r.size
        own = by_source.setdefault(r.source, [r.source_size, r.target, 0])
        own[2] += r.taken
    for size, target, taken in by_source.values():
        assert target <= 2 * size and taken <= target and target - taken < 2
    total = sum(s for s, _, _ in by_source.values())
    assert sum(t for _, t, _ in by_source.values()) == pytest.approx(min(1.5 * total, 2 * total))
    assert mixed_rows(spark, docs.repartition(5)) == found
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs).collect())
    assert words == sum(r.taken for r in found.values())


def test_mixing_equals_sql(spark):
    docs = spark.createDataFrame([(i, "x y z " * (i % 9), ["b", "a", None, "é"][i % 4]) for i in range(200)], "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    want = con.execute(queries.ORACLE_SQL["op1_mixing"]).fetchall()
    got = [tuple(r) for r in mixing.mix_sources(docs).collect()]
    key = lambda r: r[0]
    assert [r[:3] + r[5:] for r in sorted(got, key=key)] == [r[:3] + r[5:] for r in sorted(((d, s, o, z, t, n) for d, s, o, z, t, n in want), key=key)]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_licences_equal_brute_force(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choices(["some", "other", "words", "under", "the", "license", "of", "this", "software"], k=n))
    texts = [None, "", "word", "All rights reserved.", "x\nAll  RIGHTS reserved\ny", "Copyright 2021 Jane Doe. All rights reserved.", "This package is released under the MIT License, see the file LICENSE."]
    for t in list(licenses.TEMPLATES.values()) * 2:
        words = t.split()
        for _ in range(len(words) // 20 + 1):
            words[rng.randrange(len(words))] = "other"
        wrapped = "\n * ".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        texts.append(f"{filler(80)}\n{wrapped}\n{filler(30)}")
    texts += [texts[9], licenses.TEMPLATES["MIT text"]]
    mit = licenses.TEMPLATES["MIT text"].split()
    block = [f"inserted{k}" for k in range(2 * len(mit) // 5)]
    texts.append(" ".join([filler(20), *mit[: len(mit) // 2], *block, *mit[len(mit) // 2 :], filler(20)]))  # a block of other words in the middle
    texts += [" ".join(mit[: 7 * len(mit) // 10]), f"{texts[8]} " * 3, "all rights reserved " * 200]
    docs = fixture(spark, texts)
    want = set()
    for i, text in enumerate(texts):
        words = licenses.words_of(text or "")
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, template in licenses.TEMPLATES.items():
            own = set(licenses.bigrams(template))
            scores = {}
            if len(own & set(grams)) * 2 < 0.8 * len(own):
                continue
            for k, g in enumerate(grams):
                if g in own:  # every window from here: to each end
                    seen, both, scores[k] = set(), 0, 0.0
                    for e in grams[k:]:
                        both += e in own and e not in seen
                        seen.add(e)
                        scores[k] = max(scores[k], 2 * both / (len(seen) + len(own)))
            hits = {k: s for k, s in scores.items() if s >= 0.8}
            if hits:
                best = max(hits.values())
                want.add((i, name, round(best, 9), min(k for k, s in hits.items() if s == best), len(hits)))
    found = licenses.scan_licenses(docs)
    got = {(r.doc_id, r.license, round(r.dice, 9), r.start, r.n_windows) for r in found.collect()}
    assert got == want and {n for _, n, *_ in want} == set(licenses.TEMPLATES)
    assert {n for i, n, *_ in want if i == len(texts) - 4} >= {"MIT text"}  # the one with a block inside
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    assert {(i, n, round(d, 9), a, k) for i, n, d, a, k in con.execute(queries.ORACLE_SQL["op3_licenses"]).fetchall()} == want
    assert licenses.scan_licenses(docs.where(F.lit(False))).count() == 0
    twice = licenses.scan_licenses(docs.union(docs).selectExpr("nullif(doc_id, 3) AS doc_id", "text", "1 AS id", "2 AS license", "3 AS dice"))
    assert {(r.doc_id, r.license, r.n_windows) for r in twice.collect()} == {(None if i == 3 else i, n, 2 * k) for i, n, *_, k in want}


def test_components_of_ascending_chain(spark):
    """A chain in the order of its ids, a star around its largest id, and a pair."""
    links = [(k, k + 1) for k in range(300)] + [(k, 2000) for k in range(1000, 1040)] + [(5000, 4000)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys([*range(1000, 1040), 2000], 1000), 4000: 4000, 5000: 4000}


@pytest.mark.parametrize("level", [3, 5, 12])
def test_linked_sets_share_a_signature(monkeypatch, level):
    """Across the sizes at which the number of classes grows, with rare and frequent tokens."""
    monkeypatch.setattr(jaccard, "LEVEL", level)
    monkeypatch.setattr(jaccard, "CLASSES", 2)
    rng = np.random.default_rng(level)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 160))
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        m = int(rng.integers(0, len(base) // 5 + 2))
        other = np.unique(np.r_[rng.permutation(base)[: len(base) - m], rng.integers(0, 1 << 63, int(rng.integers(0, len(base) // 5 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(base, other))
        if not both or both * 100 < 80 * (len(base) + len(other) - both):
            continue
        linked += 1
        rare = rng.choice([0, 3, 5])  # of eight
        sigs = [jaccard.signatures(t, (t & np.uint64(7)).astype(int) >= rare, 80) for t in (base, other)]
        assert set(sigs[0][0]) & set(sigs[1][0]) or set(sigs[0][1]) & set(sigs[1][1])
    assert linked > 300


def test_signatures_grow_with_the_set():
    """Of a set of frequent tokens only: about as many signatures as five times its size, however long the text."""
    for n in (8_000, 20_000, 100_000, 500_000):
        tokens = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        single, combined, *_ = jaccard.signatures(tokens, np.ones(len(tokens), bool), 80)
        assert not len(single) and len(combined) < 12 * n
