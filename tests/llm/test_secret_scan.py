"""Secret scan against brute force: every span with its place, the battery's probabilities, and what is reported."""

import math
import random
import re

from pyspark.sql import functions as F

from graphweft.llm.secret_scan import ALPHABETS, CLASSES, KINDS, random_p, secret_scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def encoding(s):
    bare = s.rstrip("=")
    if not (re.search("[0-9]", bare) and re.search("[A-Za-z]", bare)):
        return None
    for name, pattern in (("hex", "[0-9a-f]+(-[0-9a-f]+)*|[0-9A-F]+(-[0-9A-F]+)*"), ("base32", "[A-Z2-7]+|[a-z2-7]+"), ("base36", "[A-Z0-9]+|[a-z0-9]+")):
        if re.fullmatch(pattern, bare):
            return name
    both = re.search("[a-z]", bare) and re.search("[A-Z]", bare)
    return "base64" if both and re.fullmatch("[A-Za-z0-9+/]+|[A-Za-z0-9_-]+", bare) else None


def probability(s, kind):
    s = s.rstrip("=")
    s = {"hex": lambda: s.replace("-", "").lower(), "base32": s.upper, "base36": s.lower, "base64": lambda: s.replace("_", "/").replace("-", "+")}[kind]()
    signs = ALPHABETS[kind]
    x, a, n = [signs.index(c) for c in s], len(signs), len(s)
    chi = sum((sum(c in k for c in s) - n * len(k) / a) ** 2 / (n * len(k) / a) for k in CLASSES[kind])
    z = (sum((u * 2 < a) != (v * 2 < a) for u, v in zip(x, x[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((u - (a - 1) / 2) * (v - (a - 1) / 2) for u, v in zip(x, x[1:])) / ((a * a - 1) / 12 * math.sqrt(n - 1))
    rho = 0.75 * a * a / (a * a - 1)
    ps = math.exp(-chi / 2) * (1 + chi / 2), math.erfc(abs(z) / 2**0.5), math.erfc(abs((serial + rho * z) / math.sqrt(1 - rho * rho)) / 2**0.5)
    half = -sum(math.log(max(p, 1e-15)) for p in ps)
    return math.exp(-half) * (1 + half + half * half / 2)


def test_probabilities_are_uniform_for_random_strings(spark):
    rng = random.Random(3)
    rows = [(k, n, "".join(rng.choice(a) for _ in range(n))) for k, a in ALPHABETS.items() for n in (20, 40, 100) for _ in range(800)]
    got = spark.createDataFrame(rows, "kind string, n int, s string").select("kind", "n", "s", random_p(F.col("s"), F.col("kind")).alias("p")).collect()
    for r in got[::17]:
        assert abs(r["p"] - probability(r["s"], r["kind"])) < 1e-4
    for kind in ALPHABETS:
        for n in (20, 40, 100):
            p = [r["p"] for r in got if (r["kind"], r["n"]) == (kind, n)]
            for t in (0.05, 0.25, 0.5, 0.75):  # within three and a half deviations of a sample of 800
                assert abs(sum(x < t for x in p) / len(p) - t) < 3.5 * math.sqrt(t * (1 - t) / len(p)) + 0.01, (kind, n, t)


def identifier(rng, n):
    names = "get user name from table index list value account server manager request handler config update delete create order line item customer region record stream batch".split()
    out = rng.choice(names) + str(rng.randrange(10, 99))
    while len(out) < n:
        out += rng.choice(names).capitalize()
    return out


def test_random_keys_are_reported_and_names_are_not(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(600):
        kind = list(ALPHABETS)[i % 4]
        s = "".join(rng.choice(ALPHABETS[kind]) for _ in range(40 if kind != "hex" else 30))
        texts[i] = f"see {s} there" if kind != "base64" else f"see aB1{s.replace('/', 'x').replace('+', 'y')} there"
    for i in range(600, 1200):
        texts[i] = f"see {identifier(rng, 20 + i % 25)} there"
    rows = secret_scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert sum(len(spans[i]) == 1 for i in range(600)) >= 0.9 * 600
    assert sum(bool(spans[i]) for i in range(600, 1200)) <= 0.02 * 600
    reported = sum(len(s) for s in spans.values())
    assert sum(len(spans[i]) for i in range(600, 1200)) <= 0.05 * reported


def test_spans_equal_brute_force(spark):
    rng = random.Random(9)
    key = lambda n, signs=LETTERS + "0123456789": "".join(rng.choice(signs) for _ in range(n))
    make = [
        lambda: f"password = '{key(rng.randint(3, 20))}'", lambda: f"API_KEY: \"{key(12)}\"", lambda: f"AKIA{key(rng.randint(8, 20), 'ABCDEFGHIJ0123')}",
        lambda: key(rng.randint(28, 40), "0123456789abcdef"), lambda: "token=" * 3 + key(9), lambda: "é日😀 plain words", lambda: "aB3" + key(rng.randint(10, 60)),
        lambda: identifier(rng, 24), lambda: "secret secret=x token=yyyyyyyy1=passwd:zzzzzzzz", lambda: "q7" + key(30, "abcdefghijklmnopqrstuvwxyz0123456789") + "z0",
    ]
    texts = {i: " ".join(rng.choice(make)() for _ in range(rng.randint(0, 12))) for i in range(250)}
    texts[900] = " ".join(f"token={key(8)} {key(33, '0123456789abcdef')}" for _ in range(700))  # more matches than one stretch of sums
    texts[901] = texts[900]
    rows = [*texts.items(), (902, None), (903, ""), (7, texts[7])]
    for r in secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string"), rate=1.0).collect():
        text = texts.get(r["doc_id"]) or ""
        base = base_spans(text)
        want = list(base)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}(?![A-Za-z0-9+/_-])", text):
            end = m.end() + len(re.match("=*", text[m.end() :])[0])
            kind = encoding(text[m.start() : end])
            # at rate 1 all of a stratum with p above 0.02 are reported; near that the bins decide
            if end - m.start() >= 20 and kind and not any(b[0] < end and m.start() < b[2] for b in base):
                p = probability(text[m.start() : end], kind)
                if p > 0.0203:
                    want.append((m.start(), 3, end))
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base, r["doc_id"]
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == sorted(want), r["doc_id"]
    assert len(KINDS) == 4
