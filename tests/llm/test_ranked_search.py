"""Ranked search against scores of all documents: ties, repeated rows, nulls, no rows, and clusters small enough for many rounds."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphweft.llm import ranked_search as rs
from graphweft.llm.ranked_search import bisected, coarse, ranked_search

DOCS = "doc_id bigint, text string, row bigint, cluster bigint, n bigint, term string, adds string"
ITEMS = "item_id bigint, text string, doc_id string, term string"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def plain(docs, items, k=50):
    bags = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = collections.Counter()
    for i, ts in wanted.items():
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out[i, rank, d, -s] += 1
    return out


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, 2, 3, "t", "a") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "d", "t") for r in items], ITEMS)
    return collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search(d, i, **options).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(300)] + ["é", "日本", "İx", "a-b", "C++", "x_y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    topics = [rng.sample(vocabulary, 12) for _ in range(9)]
    docs = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(1, 60)) + rng.choices(rng.choice(topics), k=rng.randint(0, 30))
        docs.append((1000 - i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    items = [(j, ", ".join(rng.choices(vocabulary, weights, k=6) + rng.sample(rng.choice(topics), 5))) for j in range(12)]
    return docs, items


def test_against_all_scores_in_many_rounds(spark, monkeypatch):
    docs, items = corpus(1, 260)
    docs += [docs[5]] * 3 + [(2000 + i, docs[7][1]) for i in range(70)]  # one row three times more, many ties
    docs += [(None, docs[7][1]), (3000, None), (3001, ""), (3002, " .,- "), (3003, "w1 " * 20_000)]
    items += [(3, "w250 w251"), (None, "w1 w2"), (50, None), (51, "nowhere"), (52, "")]
    monkeypatch.setattr(rs, "FIRST", 1)
    monkeypatch.setattr(rs, "FASTER", 2)
    assert searched(spark, docs, items, k=50, cluster=8, group=64) == plain(docs, items)


def test_defaults_and_few_results(spark):
    docs, items = corpus(2, 90)
    assert searched(spark, docs, items, k=7) == plain(docs, items, 7)


def test_batches_of_items(spark, monkeypatch):
    docs, items = corpus(3, 60)
    monkeypatch.setattr(rs, "ITEMS", 5)
    assert searched(spark, docs, items, k=5, cluster=16) == plain(docs, items, 5)


def test_no_rows(spark):
    docs, items = corpus(4, 20)
    for d, i in ((docs, []), ([], items), ([], []), ([(1, None)], items), (docs, [(1, "nowhere")])):
        assert not searched(spark, d, i)


def test_bisection_brings_like_documents_together(spark):
    rng = random.Random(5)
    topic = np.array([rng.randrange(8) for _ in range(512)])
    edges = np.array([[1 + t * 40 + rng.randrange(40) for _ in range(12)] for t in topic])
    clusters = bisected(edges, 64)
    sizes = collections.Counter(clusters.tolist())
    assert max(sizes.values()) <= 64 and len(sizes) == 8
    pure = sum(max(collections.Counter(topic[clusters == c].tolist()).values()) for c in sizes)
    assert pure >= 0.8 * 512  # about a quarter where documents are dealt by chance
    rows = spark.createDataFrame([(i, [int(x) for x in e]) for i, e in enumerate(edges)], "row bigint, edges array<bigint>")
    parts = coarse(rows, 256).groupBy("part").agg(F.collect_list("row").alias("rows")).collect()
    assert sorted(r for p in parts for r in p["rows"]) == list(range(512)) and all(150 < len(p["rows"]) < 370 for p in parts)
