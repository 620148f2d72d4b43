"""Personal data: fixed patterns by brute force, messages against sums over all labellings, and what similar tokens add."""

import itertools
import random
import re

import numpy as np
import pytest

from graphweft.llm.personal_data import KINDS, LABELS, base_spans, marginals, nodes, op11_personal_data, personal_data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id bigint, text string, kinds string, base string, starts int, labels int"


def holds(kind, s):
    digits = [int(c) for c in s if "0" <= c <= "9"]
    if kind == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "B", "7", "0", "255", "256", ".", "..", "@", "@x.", "-", " ", "+", "+1", "(", ")", "%", "_", "é", "日", "\n", "4111111111111111", "1.2.3.4", "a.b@c.de", "+1 (743) 555-3824", "x@y.z_w@v.u", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain(text), text


def test_long_texts_without_blanks_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "@" * 300_000, "1." * 300_000, "+1" + "(" * 500_000, "a@" * 300_000, "+1(" * 300_000):
        nodes(text, base_spans(text))


def exact(unary, edges, weights):
    total = np.zeros_like(unary)
    for y in itertools.product(range(LABELS), repeat=len(unary)):
        p = np.exp(sum(unary[i, v] for i, v in enumerate(y)) + sum(w[y[i], y[j]] for (i, j), w in zip(edges, weights)))
        total[np.arange(len(y)), y] += p
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("edges", "near"), [([(0, 1), (1, 2), (1, 3), (3, 4)], 1e-3), ([(0, 1), (1, 2), (2, 3), (3, 0), (1, 4)], 0.08), ([], 1e-9)])
def test_messages_against_all_labellings(edges, near):
    rng = np.random.default_rng(4)
    for _ in range(8):
        unary, weights = rng.normal(0, 1.5, (5, LABELS)), rng.normal(0, 0.7, (len(edges), LABELS, LABELS))
        got = marginals(unary, np.array(edges, int).reshape(-1, 2), weights.reshape(-1, LABELS, LABELS))
        assert np.abs(got - exact(unary, edges, weights)).max() < near


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = []
    for i in range(400):
        number, mail = phone(), f"{word()}.{rng.randint(10, 99)}@mail{i % 9}.example.com"
        again = rng.random() < 0.3
        texts.append(f"{prose(20)} +1 {number} {prose(20)} {mail} {prose(9)} version 3.1 of {rng.randint(1990, 2030)} {prose(5)} " + (f"+1 {number} {mail}" if again else ""))
    flat = re.sub(r"[^0-9]", "", "(743) 555-3824")
    texts.append(f"{prose(10)} +1 (743) 555-3824 {prose(200)} call {flat} now")  # 400: other form of a number far away
    texts.append(f"{prose(10)} number 7435553824 alone 3.1 of 2021")  # 401: the same form with nothing like it
    texts.append(f"write to thea.42@mail1.example.com {prose(50)} and thea.42 said")  # 402: a local part again
    texts.append(f"{prose(10)} thea.42 said version 3.1 of 1999")  # 403
    return texts


def test_similar_tokens_take_the_label_of_what_they_repeat(spark):
    texts = corpus()
    rows = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    found = {i: [(KINDS[s["kind"]], texts[i][s["start"] : s["end"]]) for s in rows[i]["spans"] if s not in rows[i]["base"]] for i in rows}
    assert found[400] == [("phone", "7435553824")] and found[402] == [("email", "thea.42")]
    assert not any(found[i] for i in rows if i not in (400, 402))
    for i, t in enumerate(texts):
        assert [tuple(s) for s in rows[i]["base"]] == plain(t)


def test_odd_rows(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a@b.co"), (4, "a@b.co"), (4, "1.2.3.4"), (None, "+1 (743) 555-3824"), (5, "é" * 9 + " 4111 1111 1111 1111 日 x"), (6, "a" * 200_000 + "@b.c" + " 1" * 50_000)]
    spark.createDataFrame([(*r, "x", "y", 1, 2) for r in texts], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_personal_data(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got), key=repr) == sorted([(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 1, 0, 0, 0), (4, 1, 0, 0, 0), (4, 0, 1, 0, 0), (None, 0, 0, 0, 1), (5, 0, 0, 1, 0), (6, 1, 0, 0, 0)], key=repr)
    assert next(r["spans"] for r in got if r["doc_id"] == 5) == "card:10:29"
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
