"""Personal data by four fixed patterns and a skip-chain conditional random field.

A text's nodes are its tokens with a digit or an @, and those that repeat an e-mail's local part; every other token is
observed to be outside. What a fixed pattern finds is observed too. Tokens beside each other share a chain potential;
tokens that are the same but for case, or end with the same seven digits, share a skip potential through one hub a group,
however far apart they are, so a group of n costs n edges and not their pairs. Loopy message passing settles the labels
of a document together. The potentials are trained piecewise on the patterns' labels: node potentials by multinomial
regression on a token's shape, edge potentials by how often labels meet, from counts of bounded size over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import table, written

#: The kinds in the order in which they are listed; a node's label is its kind's place from 1, or OUT.
KINDS = ("email", "ip", "card", "phone")
OUT, LABELS = 0, len(KINDS) + 1
#: Where an e-mail's @ stands, with what follows; what may stand before it. One @ ends one local part, so this takes what
#: the pattern as a whole takes, in time that is linear for texts without blanks as well.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Signs that make a token a node; what a token is made of; what may part two tokens that are beside each other.
SIGN, IN_TOKEN, BESIDE = re.compile(r"[0-9@]+"), re.compile(r"[\w@.%+()-]*+"), re.compile(r"[\x20\t().-]{0,3}+")
NAMED = re.compile(r"\w++(?:[._%+-]++\w++)++")
#: Digits that two different tokens must share at their ends to be similar; least digits of a span that a kind can be told by,
#: and most digits of one that is made of several tokens.
TAIL, LEAST, MOST = 7, {"email": 0, "ip": 4, "card": 12, "phone": 7}, {"email": 0, "ip": 0, "card": 19, "phone": 15}
#: A token's shape: how many digits, dots, dashes; letters, @, leading plus, brackets, Luhn, four numbers of a byte.
DIGITS = (0, 1, 2, 3, 4, 7, 8, 10, 16, 20)
SHAPE = (len(DIGITS), 5, 3, 2, 2, 2, 2, 2, 2)
#: Least marginal probability of a span; rounds of messages at most, and the change that ends them.
SURE, ROUNDS, STILL = 0.8, 100, 1e-4
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def in_byte(number: str) -> bool:
    bare = number.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of what the fixed patterns find, by kind, then start."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, last := m.end()))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(in_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def shape(token: str) -> int:
    """The token's features as one number below the product of SHAPE."""
    digits = re.sub(r"[^0-9]", "", token)
    parts = token.strip("().-").split(".")
    card = 16 <= len(digits) <= 19 and luhn(digits)
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and in_byte(p) for p in parts)
    values = (sum(len(digits) >= k for k in DIGITS) - 1, min(token.count("."), 4), min(token.count("-"), 2), bool(re.search(r"[^\W0-9_]", token)), "@" in token, token.lstrip("(")[:1] == "+", "(" in token or ")" in token, card, octets)
    code = 0
    for size, v in zip(SHAPE, values, strict=True):
        code = code * size + int(v)
    return code


@dataclass
class Nodes:
    """The nodes of one text, by start: places, the pattern's label, shape, group of like tokens (-1 if alone) and whether one is beside the one before."""

    starts: list[int]
    ends: list[int]
    labels: list[int]
    shapes: list[int]
    groups: list[int]
    joined: list[int]


def tokens(text: str, names: frozenset[str]) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, and those equal to one of names, without signs that only part them from others."""
    found, last = [], 0
    for m in SIGN.finditer(text):
        if m.start() >= last:
            start = m.start()
            while start > last and (c := text[start - 1]) and (c.isalnum() or c in "_@.%+()-"):
                start -= 1
            last = IN_TOKEN.match(text, m.end()).end()
            found.append((start, last))
    if names:
        taken = {s for s, _ in found}
        found += [(m.start(), m.end()) for m in NAMED.finditer(text) if m[0].lower() in names and m.start() not in taken]
    out, last = [], 0
    for s, e in sorted(found):
        bare = text[s:e].rstrip("._%+(-")
        start = s + len(bare) - len(bare.lstrip("._%)-"))
        if start >= last and s + len(bare) > start:
            out.append((start, last := s + len(bare)))
    return out


def nodes(text: str, base: list[Span]) -> Nodes:
    names = frozenset(n for k, s, e in base if k == 0 and len(n := text[s:e].partition("@")[0].lower()) > 4 and re.search(r"[0-9._%+-]", n))
    spans = tokens(text, names)
    labels, ordered, at = [OUT] * len(spans), sorted((s, e, k) for k, s, e in base), 0
    reach: list[tuple[int, int, int]] = []
    for i, (s, e) in enumerate(spans):
        while at < len(ordered) and ordered[at][0] < e:
            reach.append(ordered[at])
            at += 1
        reach = [b for b in reach if b[1] > s]
        if reach:
            labels[i] = min(reach, key=lambda b: (b[2], b[0]))[2] + 1
    known: dict[str, int] = {}
    seen: list[int] = []
    groups = []
    for (s, e), label in zip(spans, labels, strict=True):
        token = text[s:e].lower()
        digits = re.sub(r"[^0-9]", "", token)
        local = token.partition("@")[0]
        key = f"@{local}" if local in names else digits[-TAIL:] if len(digits) >= TAIL and not re.search(r"[^\W0-9_]", token) else token
        groups.append(known.setdefault(key, len(known)))
        seen += [0] * (len(known) - len(seen))
        seen[groups[-1]] += 1
    joined = [int(i > 0 and BESIDE.match(text, spans[i - 1][1]).end() >= s and not text[spans[i - 1][1] : s].strip(" \t().-")) for i, (s, _) in enumerate(spans)]
    return Nodes([s for s, _ in spans], [e for _, e in spans], labels, [shape(text[s:e]) for s, e in spans], [g if seen[g] > 1 else -1 for g in groups], joined)


def pairs(n: Nodes) -> tuple[list[int], list[int]]:
    """Per node the label of the one beside it before, and of the first of its group; -1 where there is none."""
    first: dict[int, int] = {}
    before = [n.labels[i - 1] if j else -1 for i, j in enumerate(n.joined)]
    like = [-1 if g < 0 or g not in first and first.setdefault(g, label) == label else first[g] for g, label in zip(n.groups, n.labels, strict=True)]
    return before, like


FOUND = "kinds array<int>, base_starts array<int>, base_ends array<int>, starts array<int>, ends array<int>, labels array<int>, shapes array<int>, groups array<int>, joined array<int>, before array<int>, alike array<int>"


def graphs(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of the fixed patterns and the nodes of every row's text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists: list[list[list[int]]] = [[] for _ in range(11)]
                for text in part.column(1).to_pylist():
                    base = base_spans(text) if text and SIGN.search(text) else []
                    n = nodes(text, base) if text and SIGN.search(text) else Nodes([], [], [], [], [], [])
                    for out, values in zip(lists, (*([s[k] for s in base] for k in range(3)), n.starts, n.ends, n.labels, n.shapes, n.groups, n.joined, *pairs(n)), strict=True):
                        out.append(values)
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {FOUND}")


def features() -> np.ndarray:
    """Per shape its indicators, one of each factor, and a constant."""
    codes = np.stack(np.unravel_index(np.arange(np.prod(SHAPE)), SHAPE), 1)
    return np.hstack([*(np.eye(size)[codes[:, k]] for k, size in enumerate(SHAPE)), np.ones((len(codes), 1))])


@dataclass(frozen=True)
class Potentials:
    """Logarithms: of a node by shape and label, of two labels beside each other, and of a label and its group's."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def regression(counts: np.ndarray, ridge: float = 0.05, steps: int = 400) -> np.ndarray:
    """Log-probabilities of the labels per shape, from counts (shape, label), by gradient steps on the penalised likelihood."""
    used = np.flatnonzero(counts.sum(1))
    x = features()
    weights, speed = np.zeros((x.shape[1], LABELS)), np.zeros((x.shape[1], LABELS))
    y, xs = np.log1p(counts[used].sum(1, keepdims=True)) * counts[used] / counts[used].sum(1, keepdims=True), x[used]
    softmax = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    rate = 1.5 / max(1.0, y.sum() * 2)
    for _ in range(steps if len(used) else 0):
        slope = xs.T @ (y - softmax(xs @ weights) * y.sum(1, keepdims=True)) - ridge * weights
        speed = 0.9 * speed + rate * slope
        weights += speed
    weights[-1, OUT] += 1.0  # a shape that no count speaks for is outside
    return np.log(softmax(x @ weights) + 1e-9)


def meeting(counts: np.ndarray) -> np.ndarray:
    """Log of how much more often two labels stand beside each other than by chance, with two pairs added to the counts."""
    share = (counts.sum(0) + counts.sum(1) + 1) / (counts.sum() * 2 + LABELS)
    joint = counts + counts.T + np.diag(share) + np.outer(share, share)
    joint /= joint.sum()
    own = joint.sum(1)
    return np.clip(np.log(joint / np.outer(own, own)), -8, 8)


def agreement(counts: np.ndarray) -> np.ndarray:
    """Log-odds that like tokens have one label, for equal labels; two pairs, 1.9 of them equal, are added to the counts.

    Only pairs that the patterns have both found teach: what they have not found may be what is sought.
    """
    found = counts[1:, 1:]
    equal = np.trace(found)
    return np.eye(LABELS) * np.log((equal + 1.9) / (found.sum() - equal + 0.1))


def fitted(found: DataFrame) -> Potentials:
    """Potentials from counts over all rows; 3 kinds of counts of at most 10,000 shapes and five labels reach the driver."""
    entry = lambda what, a: F.struct(F.lit(what).alias("what"), a.alias("a"))
    each = found.select(F.explode(F.arrays_zip("shapes", "labels", "before", "alike")).alias("n"))
    each = each.select("n.labels", F.explode(F.array(entry("node", F.col("n.shapes")), entry("chain", F.col("n.before")), entry("skip", F.col("n.alike")))).alias("e"))
    counts = {"node": np.zeros((np.prod(SHAPE), LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    for r in each.where("e.a >= 0").groupBy("e.what", "e.a", "labels").count().collect():
        counts[r["what"]][r["a"], r["labels"]] = r["count"]
    return Potentials(regression(counts["node"]), meeting(counts["chain"]), agreement(counts["skip"]))


def marginals(unary: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of every variable by loopy sum-product messages; exact where edges form no loop.

    unary: variables by labels; edges: pairs of variables; weights: per edge the log-potential of both labels.
    """
    norm = lambda m: m - np.logaddexp.reduce(m, axis=1, keepdims=True)
    there, back = np.full((len(edges), LABELS), -np.log(LABELS)), np.full((len(edges), LABELS), -np.log(LABELS))
    belief = unary.copy()
    for _ in range(ROUNDS if len(edges) else 0):
        belief = unary.copy()
        np.add.at(belief, edges[:, 1], there)
        np.add.at(belief, edges[:, 0], back)
        new_there = norm(np.logaddexp.reduce((belief[edges[:, 0]] - back)[:, :, None] + weights, axis=1))
        new_back = norm(np.logaddexp.reduce((belief[edges[:, 1]] - there)[:, None, :] + weights, axis=2))
        change = max(np.abs(new_there - there).max(), np.abs(new_back - back).max())
        there, back = 0.5 * (there + new_there), 0.5 * (back + new_back)
        if change < STILL:
            break
    if len(edges):
        belief = unary.copy()
        np.add.at(belief, edges[:, 1], there)
        np.add.at(belief, edges[:, 0], back)
    return np.exp(norm(belief))


def settled(docs: list[Nodes], p: Potentials) -> list[np.ndarray]:
    """Marginals of each document's nodes; nodes in a fixed pattern's span are observed."""
    sizes = [len(d.labels) for d in docs]
    labels = np.array([x for d in docs for x in d.labels], int)
    shapes = np.array([x for d in docs for x in d.shapes], int)
    at, hub, edges, kinds = 0, len(labels), [], []
    for d in docs:
        hubs: dict[int, int] = {}
        for i, (g, j) in enumerate(zip(d.groups, d.joined, strict=True)):
            if j:
                edges.append((at + i - 1, at + i))
                kinds.append(0)
            if g >= 0:
                if g not in hubs:
                    hubs[g] = hub + len(hubs)
                edges.append((hubs[g], at + i))
                kinds.append(1)
        at, hub = at + len(d.labels), hub + len(hubs)
    unary = np.zeros((hub, LABELS))
    unary[: len(labels)] = p.node[shapes]
    seen = np.flatnonzero(labels)
    unary[seen] = -60.0
    unary[seen, labels[seen]] = 0.0
    out = marginals(unary, np.array(edges, int).reshape(-1, 2), np.stack([p.chain, p.skip])[np.array(kinds, int)])
    return np.split(out[: len(labels)], np.cumsum(sizes)[:-1])


def added(d: Nodes, probability: np.ndarray) -> list[Span]:
    """Spans of nodes beside each other that no pattern covers and that one label is sure for."""
    out: list[tuple[int, int, int, int]] = []
    best, sure = probability.argmax(1), probability.max(1)
    last = None
    for i in range(len(d.labels)):
        new = d.labels[i] == OUT and best[i] != OUT and sure[i] >= SURE
        n = DIGITS[np.unravel_index(d.shapes[i], SHAPE)[0]]
        if new and last == best[i] and d.joined[i] and out[-1][3] + n <= MOST[KINDS[last - 1]]:
            out[-1] = (out[-1][0], out[-1][1], d.ends[i], out[-1][3] + n)
        elif new:
            out.append((int(best[i]) - 1, d.starts[i], d.ends[i], n))
        last = best[i] if new else None
    return [(k, s, e) for k, s, e, n in out if n >= LEAST[KINDS[k]]]


def labelled(found: DataFrame, p: Potentials) -> DataFrame:
    """doc_id, base and spans (all of them), arrays of (kind, start, end) by kind, then start."""
    names = ["starts", "ends", "labels", "shapes", "groups", "joined"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                docs = [Nodes(*x) for x in zip(*(part.column(n).to_pylist() for n in names), strict=True)]
                open_ = [i for i, d in enumerate(docs) if OUT in d.labels]
                spans: list[list[Span]] = [[] for _ in docs]
                for i, q in zip(open_, settled([docs[i] for i in open_], p) if open_ else [], strict=True):
                    spans[i] = added(docs[i], q)
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(c) for c in ("kinds", "base_starts", "base_ends")), *(pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in range(3))], ["doc_id", "kinds", "base_starts", "base_ends", "k", "s", "e"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    ints = ", ".join(f"{c} array<int>" for c in ("kinds", "base_starts", "base_ends", "k", "s", "e"))
    rows = found.select("doc_id", "kinds", "base_starts", "base_ends", *names).mapInArrow(run, f"doc_id {id_type}, {ints}")
    spans = lambda k, s, e: F.transform(F.arrays_zip(F.col(k).alias("a"), F.col(s).alias("b"), F.col(e).alias("c")), lambda x: F.struct(x["a"].alias("kind"), x["b"].alias("start"), x["c"].alias("end")))
    base, more = spans("kinds", "base_starts", "base_ends"), spans("k", "s", "e")
    return rows.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans for every row of docs: arrays of (kind, start, end) in code points, end exclusive.

    Null text counts as empty and has no span. Repeated rows are judged alike; columns other than doc_id and text are not
    read. Without anything that the patterns find, nothing is learned and nothing is added. Added spans touch none of the
    patterns' tokens.
    """
    found = written(graphs(docs), "personal-graphs")
    return labelled(found, fitted(found))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
