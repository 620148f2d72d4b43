"""Merkle manifest against a plain walk through the trees: large sources, lone leaves, nulls, repeated rows, no rows."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphweft.llm.merkle_manifest import merkle_manifest, op12_merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree bigint, place bigint, n bigint, path string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(tree, at):
    """(siblings before, siblings after) at each level from leaf `at` to the root."""
    for level in tree[:-1]:
        first = at // 16 * 16
        yield level[first:at], level[at + 1 : first + 16]
        at //= 16


def lowered(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def expected(rows):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lowered(r[1]) if tampered(r[0]) else r[1]), r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, tested, doc_id) in enumerate(sorted(by_source[s])):
            path = [*steps(trees[s], i), *steps(top, k)]
            digest = tested
            for before, after in path:
                digest = h("".join(before) + digest + "".join(after))
            proof = h("".join(x for before, after in path for x in before + after))
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return collections.Counter(out)


def made(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 7, 8, 9, "x") for r in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return op12_merkle_manifest(spark, str(tmp_path))


def test_against_brute_force(spark, tmp_path):
    rows = [(i, f"Text Of {i} é" * (i % 3), "en" if i % 4 else None, "hot", i % 7) for i in range(4700)]  # four levels, two blocks
    rows += [(10_000 + i, None if i % 5 == 0 else f"B{i}", "de", "Zoo" if i % 2 else "é", None) for i in range(40)]
    rows += [(20_000, "Alone", "en", "lone", 1), (None, "No Id", None, None, 2), (None, "No Id", None, None, 2), (3, "Of null Source", "en", None, 3), (1, "again", "en", "hot", 1), (1, "again", "en", "hot", 1)]
    rows += [(30_000 + i, "T" * 100_000 if i == 3 else "", "fr", f"s{i}", 5) for i in range(30)]  # over 16 sources
    got = made(spark, rows, tmp_path).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got) == expected(rows)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_one_source(spark, tmp_path, n):
    rows = [(5 * i, f"A{i}", None, "s", i) for i in range(n)]
    got = made(spark, rows, tmp_path).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got) == expected(rows)


def test_any_change_of_a_field_is_found(spark):
    rows = [(i, f"A{i}", "en", "s", i, 7, 8, 9, "x") for i in range(20)]
    out = merkle_manifest(spark.createDataFrame(rows, SCHEMA), F.when(F.col("doc_id") == 4, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).collect()
    assert {r["doc_id"] for r in out if not r["verified"]} == {4} and {len(r["proof"]) for r in out} == {16, 4}
