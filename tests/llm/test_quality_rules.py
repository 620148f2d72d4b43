"""Robust outliers against the same estimate by numpy, and against planted documents."""

import math
import random

import numpy as np

from graphweft.llm.quality_rules import CONSISTENT, CUTOFF, PART, STEPS, VECTOR, quality_rules, statistics

FLOOR = np.array(list(VECTOR.values()))


def middle(values):
    return np.sort(values, 0)[math.ceil(len(values) / 2) - 1]


def squared(x, centre, scatter):
    z = np.linalg.solve(np.linalg.cholesky(scatter), (x - centre).T)
    return (z * z).sum(0)


def estimate(x, d):
    """Centre and scatter of the nearest part, the reach rounded up to the same logarithmic bin."""
    bins = np.floor(np.log(d + 1e-6) * 32)
    reach = math.exp((np.sort(bins)[math.ceil(PART * len(x)) - 1] + 1) / 32) - 1e-6
    near = x[d <= reach]
    return near.mean(0), CONSISTENT * np.cov(near.T, bias=True) + np.diag(FLOOR**2)


def brute(x):
    centre = middle(x)
    own = np.sqrt((1.4826 * middle(np.abs(x - centre))) ** 2 + FLOOR**2)
    found = []
    for c, s in ((centre, np.diag(FLOOR**2)), (centre, np.diag(own**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(FLOOR**2))):
        for _ in range(2):
            c, s = estimate(x, squared(x, c, s))
        found.append((np.linalg.slogdet(s)[1], c, s))
    det, c, s = min(found, key=lambda f: f[0])
    for _ in range(STEPS):
        last = det
        c, s = estimate(x, squared(x, c, s))
        det = np.linalg.slogdet(s)[1]
        if det >= last - 0.01:
            break
    return squared(x, c, s)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))).title() if rng.random() < 0.1 else "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_verdicts_equal_those_of_numpy(spark):
    rng, rows, planted = random.Random(4), [], set()
    for i in range(700):
        text = "\n".join(prose(rng, rng.randint(15, 25)) for _ in range(rng.randint(3, 20)))
        if i % 10 == 0:  # one kind of flaw each, none of which the base rules see
            planted.add(i)
            lines = text.split("\n")
            text = [lambda: text.upper(), lambda: text.replace(" ", " #$ "), lambda: "\n".join(lines + ["one two"] * 3 * len(lines)), lambda: prose(rng, 500).replace(" ", "") + " a b c d e f g h i j k l m n o p q r s t u"][i // 10 % 4]()
        rows.append((i, text, "ab"[i % 2], "s" if i % 3 else None))
    rows.append((1000, prose(rng, 60), None, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    vectors = {r["doc_id"]: r for r in statistics(docs).collect()}
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for group in {(r[2], r[3]) for r in rows}:
        ids = [r[0] for r in rows if (r[2], r[3]) == group and not vectors[r[0]]["base_failed"]]
        x = np.array([[vectors[i][k] for k in VECTOR] for i in ids])
        if len(ids) > 1:
            want = brute(x)
            # rows whose distances share a bin's edge may differ by rounding; the verdicts agree
            assert np.allclose([got[i]["distance"] for i in ids], want, rtol=1e-6, atol=1e-6)
            assert [got[i]["kept"] for i in ids] == list(want <= CUTOFF)
    clean = [i for i in got if i not in planted]
    assert not [(i, got[i]["distance"]) for i in planted if got[i]["kept"]]
    assert sum(got[i]["kept"] for i in clean) >= 0.97 * len(clean) and got[1000]["kept"]
