"""Noisy variant counts: exact without noise, equal to a plain version with it, of the stated scale."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.operators.private_variants import STOP, laplace, private_variants
from caseloom.schema import EventSchema, canonical


def log_of(spark, traces):
    rows = [(c, a, 1000 * c + p) for c, trace in enumerate(traces) for p, a in enumerate(trace)]
    df = spark.createDataFrame(rows, "case long, act string, s long").withColumn("t", F.timestamp_seconds("s"))
    return canonical(df, EventSchema("case", "act", "t", "s"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_noise(node, epsilon, secret):
    u = (int(sha(f"{secret}:{node}")[:13], 16) + 0.5) / 2**52 - 0.5
    return int(-math.copysign(1, u) * math.log(1 - 2 * abs(u)) / epsilon)


def plain(traces, epsilon, least, length, secret):
    counts = Counter(tuple(t[: i + 1]) for t in ([*x, STOP] for x in traces) for i in range(len(t)))
    names = [*sorted({a for t in traces for a in t}), STOP]
    left, out = [((), "")], {}
    for _ in range(length):
        nxt = []
        for prefix, node in left:
            for a in names:
                child = sha(f"{node}:{a}")
                n = counts[(*prefix, a)] + (plain_noise(child, epsilon, secret) if epsilon else 0)
                if n >= least:
                    if a == STOP:
                        out[prefix] = n
                    else:
                        nxt.append(((*prefix, a), child))
        left = nxt
    return out


@pytest.fixture(scope="module")
def traces():
    rng = random.Random(11)
    return ["".join(rng.choice("AABC") for _ in range(rng.randint(1, 4))) for _ in range(80)] + ["ABCABCABC"] * 9


def test_without_noise_variants_are_exact(spark, traces):
    log = log_of(spark, traces)
    got = {"".join(r.variant): r.n for r in private_variants(log, None, 1, 10).collect()}
    assert got == Counter(traces)
    few = {"".join(r.variant): r.n for r in private_variants(log, None, 3, 5).collect()}
    assert few == {t: n for t, n in Counter(traces).items() if n >= 3 and len(t) < 5}


def test_noise_equals_plain_version_and_its_scale(spark, traces):
    log = log_of(spark, traces)
    got = {tuple(r.variant): r.n for r in private_variants(log, 0.2, 4, 5, "s3cret").collect()}
    assert got == plain(traces, 0.2, 4, 5, "s3cret")
    assert any("".join(v) not in traces for v in got)  # no case has these
    nodes = spark.range(40_000).select(laplace(F.col("id").cast("string"), 0.1, "k").alias("x"))
    mean, size = nodes.agg(F.avg("x"), F.avg(F.abs("x"))).first()
    # Laplace numbers of scale b cut towards 0 have a mean size of 1 / (exp(1 / b) - 1), 9.508 for b = 10.
    assert abs(mean) < 0.3 and abs(size - 1 / (math.exp(0.1) - 1)) < 0.3


def test_wrong_parameters_and_an_empty_log(spark, traces):
    log = log_of(spark, traces[:2])
    for epsilon, least, secret in ((1.0, 0, "k"), (0.0, 1, "k"), (1.0, 1, "")):
        with pytest.raises(ValueError):
            private_variants(log, epsilon, least, 3, secret)
    assert private_variants(log.limit(0), None, 1, 3).count() == 0
