"""N-gram Jaccard join by PartEnum signatures, and its connected components.

Sets of word shingles fall in bands of size. Within two neighbouring bands a Jaccard bound is a bound k on the number of
elements that two sets do not share. The domain of shingles is dealt into k // 2 + 1 groups and some more, each of three
parts, and every subset of two parts of a group is enumerated: sets that differ in k elements at most differ in one at
most within some group, so they agree on two whole parts of it and have a signature in common. Candidates are compared
element by element.

A bucket of equal signatures is never paired with itself: its members are compared with its smallest one. Where some are
not linked with that one, links among the others are looked up by what sets them apart from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import dropped, freed, table, written
from graphweft.llm.components import components

#: Two sets link if 100 * intersection >= SHARE * union. Words in a shingle.
SHARE, WORDS = 85, 4
#: Bytes of text that are hashed at a time; rows and bytes of sets in a block of a group, two of which meet in a task.
BLOCK, SPLIT, HELD = 1 << 18, 8192, 1 << 24
U = np.uint64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashed word shingles of many texts at once. Words are hashed by a polynomial over random values of their bytes."""

    def __init__(self) -> None:
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)[lower]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.base, self.power, self.inverse = 0x9E3779B97F4A7C15, np.empty(0, U), np.empty(0, U)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            back = pow(self.base, -1, 2**64)
            for name, b in (("power", self.base), ("inverse", back)):
                out = np.full(n, U(b))
                out[0] = U(1)
                setattr(self, name, np.multiply.accumulate(out))

    def words(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and per text the index of its first one; texts lie one after the other in body."""
        n = len(body)
        if not n:
            return np.empty(0, U), np.zeros(len(offsets), np.int64)
        self.powers(n + 1)
        word = ~self.space[body]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
        run = np.concatenate([[U(0)], np.cumsum(self.value[body] * self.power[:n], dtype=U)])
        h = mixed((run[ends] - run[begins]) * self.inverse[begins] + (ends - begins).astype(U), 1)
        return h, np.searchsorted(begins, offsets)

    def sets(self, body: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per text its distinct shingles in order."""
        h, firsts = self.words(body, offsets)
        four = h[: max(0, len(h) - WORDS + 1)].copy()
        for k in range(1, WORDS):
            four = mixed(four, 2) + h[k : len(h) - WORDS + 1 + k]
        four = mixed(four, 3)
        out = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(four[a : b - WORDS + 1]))
            elif b > a:  # the whole of a shorter text
                whole = h[a : a + 1]
                for k in range(a + 1, b):
                    whole = mixed(whole, 4) + h[k : k + 1]
                out.append(mixed(whole, 5 + b - a))
            else:
                out.append(np.empty(0, U))
        return out

    def batches(self, texts: pa.Array, make=None) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Index of the first text and the sets of it and its successors, some hundred thousand bytes at a time."""
        make = make or self.sets
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
            yield first, make(body[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last


class Bands:
    """Sizes of neighbouring bands, and for each band how the domain is parted that serves it and the one below.

    A band on two levels deals the domain into groups: sets that differ in k elements at most differ in one at most in
    some group of k // 2 + 1. Each group has THREE parts, and every two of them are enumerated: one such pair is the same
    in both sets. A band of one level (small sets, whose groups would often be empty) has k + 1 parts, one of which is
    the same. Groups or parts that both sets leave empty tell nothing, so there are `empty` more of them.
    """

    THREE = 3

    def __init__(self, share: int = SHARE, most: int = 1 << 31) -> None:
        self.low, self.high, parts, empty, two = [1], [], [], [], []
        while self.low[-1] <= most:
            self.high.append(self.low[-1] * 100 // share)
            self.low.append(self.high[-1] + 1)
        for i, high in enumerate(self.high):
            k = 2 * high * (100 - share) // (100 + share)
            least = self.low[max(0, i - 1)]
            groups = k // 2 + 1
            n, spare = self.spared(groups, lambda n: 3 * n * np.exp(-2 * least / (3 * n)))
            on_two = k > 0 and spare <= groups
            if not on_two:
                n, spare = self.spared(k + 1, lambda n: n * np.exp(-least / n)) if k else (1, 0)
            parts.append(n)
            empty.append(spare)
            two.append(on_two)
        self.low, self.parts, self.empty, self.two = np.array(self.low), np.array(parts), np.array(empty), np.array(two)

    @staticmethod
    def spared(needed: int, blank) -> tuple[int, int]:
        """How many groups there are so that `needed` ones are very likely left beside the blank ones, of which blank(n) are due."""
        spare = 0
        for _ in range(30):
            due = blank(needed + spare)
            spare = int(np.ceil(due + 4 * np.sqrt(due) + 1))
        return needed + spare, spare

    def signatures(self, sets: list[np.ndarray], tries: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Index of the set and signature, over all sets. A set with more blank groups than its band allows for is dealt
        anew with another seed, beside the first: two such sets may have had nothing but blanks in common."""
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        owner, value = [], []
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, U)
        items = np.concatenate([sets[i] for i in some])
        band = np.searchsorted(self.low, sizes[some], "right") - 1
        for up in (0, 1):
            which, seed = np.arange(len(some)), 0
            while len(which):
                b = band[which] + up
                parts, spare, width = self.parts[b], self.empty[b], np.where(self.two[b], self.THREE, 1)
                size = sizes[some][which]
                first = np.cumsum(parts * width) - parts * width  # of each set among the cells of all groups
                own = items if len(which) == len(some) else np.concatenate([sets[some[i]] for i in which])
                h = mixed(own, 100 + seed)
                of = np.repeat(np.arange(len(which)), size)
                group = (((h >> U(32)) * parts[of].astype(U)) >> U(32)).astype(np.int64)
                cell = (((h & U(0xFFFFFFFF)) * width[of].astype(U)) >> U(32)).astype(np.int64)
                place = first[of] + group * width[of] + cell
                total = np.zeros(int((parts * width).sum()), U)
                np.add.at(total, place, mixed(h, 7))
                held = np.bincount(place, minlength=len(total))
                owner_of = np.repeat(np.arange(len(which)), parts * width)
                wide = width[owner_of] > 1
                at = np.flatnonzero(wide)[:: self.THREE, None] + np.arange(self.THREE) if wide.any() else np.empty((0, self.THREE), np.int64)
                # on two levels a cell stands for the two other parts of its group
                total[at], held[at] = total[at].sum(1, keepdims=True, dtype=U) - total[at], held[at].sum(1, keepdims=True) - held[at]
                index = np.arange(len(total)) - first[owner_of]
                last = seed + 1 == tries
                tag = mixed(b[owner_of].astype(U) * U(1 << 40) + index.astype(U), 200 + seed)
                keep = np.ones(len(total), bool) if last else held > 0
                value.append(mixed(total + tag, 9)[keep])
                owner.append(some[which[owner_of[keep]]])
                blank_cells = held == 0
                blank_cells[at] = blank_cells[at].any(1, keepdims=True) & (np.arange(self.THREE) == 0)  # once for a group
                blank = np.add.reduceat(blank_cells, first)
                which, seed = (which[blank > spare], seed + 1) if not last else (which[:0], seed)
        return np.concatenate(owner), np.concatenate(value)


def linked(inter, a, b, share: int = SHARE):
    return 100 * inter >= share * (a + b - inter)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set as the bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for first, sets in shingler.batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, items binary")


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def parity(items: np.ndarray) -> np.ndarray:
    """Bits that tell odd from even numbers of elements in each of some 2 to 4 cells per element.

    An element that only one of two sets has flips one bit, so as many bits differ as elements do at most.
    """
    bits = max(64, 1 << int(2 * len(items) - 1).bit_length()) if len(items) else 64
    cells = np.bincount((mixed(items, 51) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(U)


def folded(words: np.ndarray) -> np.ndarray:
    """Rows of bits for half as many cells."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def may_link(apart, a, b, share: int = SHARE):
    """Whether sets of a and b elements that differ in `apart` or more can link."""
    return apart * (100 + share) <= (100 - share) * (a + b)


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the parity bits and a 128-bit digest of the set of every row."""

    def digest(s: np.ndarray) -> bytes:
        return np.array([mixed(s, 61).sum(dtype=U), mixed(s, 62).sum(dtype=U)]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for first, sets in shingler.batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary()), pa.array([digest(s) for s in sets], pa.binary())], ["doc_id", "n_shingles", "bits", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_shingles long, bits binary, digest binary")


def signature_rows(docs: DataFrame, share: int) -> DataFrame:
    """sig and doc_id, one row per signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(), Bands(share)
        for b in batches:
            for first, sets in shingler.batches(b.column(1)):
                owner, value = bands.signatures(sets)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), b.column(0).take(pa.array(owner + first))], ["sig", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"sig long, doc_id {id_type(docs)}")


def compared(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """pairs (c, x) with column link."""
    both = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("items").alias("xs")), "x").join(sets.select(F.col("doc_id").alias("c"), F.col("items").alias("cs")), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                x, c = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                out.append(bool(linked(len(np.intersect1d(x, c, assume_unique=True)), len(x), len(c), share)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["c", "x", "link"])

    kind = pairs.schema["c"].dataType.simpleString()
    return both.select("c", "x", "xs", "cs").mapInArrow(run, f"c {kind}, x {kind}, link boolean")


def near_pairs(pairs: DataFrame, sizes: DataFrame, share: int) -> DataFrame:
    """pairs (c, x) with column near: false if their parity bits rule a link out."""
    side = lambda k: sizes.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"b_{k}")).hint("merge")
    both = pairs.join(side("x"), "x").join(side("c"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m, n, p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                u, v = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                while len(u) != len(v):
                    u, v = (folded(u), v) if len(u) > len(v) else (u, folded(v))
                out.append(bool(may_link(int(np.bitwise_count(u ^ v).sum()), m, n, share)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["c", "x", "near"])

    kind = pairs.schema["c"].dataType.simpleString()
    return both.select("c", "x", "n_c", "n_x", "b_c", "b_x").mapInArrow(run, f"c {kind}, x {kind}, near boolean")


def blocks_of(stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """c, i, j, side, x, n_shingles, bits: the members of each centre in pairs of blocks, so that every two members meet.

    A block has some SPLIT rows and HELD bytes of sets at most, so a task holds two such blocks whatever a group's size. A
    row of n comes into as many pairs as there are blocks; most groups are one block and stay as they are.
    """
    rows = stars.join(sizes.select(F.col("doc_id").alias("x"), "n_shingles", "bits").hint("merge"), "x")
    several = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")).where("n > 1")
    sized = several.select("c", F.greatest(F.ceil(F.col("n") / SPLIT), F.ceil(F.col("all") * 8 / HELD)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    def pairs(own):
        after = F.transform(F.sequence(own, F.col("blocks") - 1), lambda j: pair(own, j, 0))
        before = F.when(own > 0, F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0))), lambda i: pair(i, own, 1)))
        return F.concat(after, F.coalesce(before, F.slice(after, 1, 0)))

    spread = rows.join(sized, "c").withColumn("own", own).withColumn("p", F.explode(pairs(F.col("own"))))
    return spread.select("c", "p.i", "p.j", "p.side", "x", "n_shingles", "bits")


def possible_others(stars: DataFrame, sizes: DataFrame, share: int) -> DataFrame:
    """c, i, j, side, x: of each centre's members those that may link with another one, by their parity bits.

    Bits are compared for two blocks in a task, and rows come out, not pairs.
    """
    kind = stars.schema["c"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, side = group["n_shingles"].to_numpy(), group["side"].to_numpy()
        bits = [np.frombuffer(x, U) for x in group["bits"]]
        length = np.array([len(x) for x in bits])
        keep = np.zeros(len(n), bool)
        one = group["i"].iat[0] == group["j"].iat[0]
        theirs = np.ones(len(n), bool) if one else side == 1
        by = {k: np.flatnonzero(theirs & (length == k)) for k in np.unique(length[theirs])}
        by = {k: (at, np.stack([bits[i] for i in at])) for k, at in by.items()}
        for i in np.flatnonzero(side == 0):
            for k in {length[i], 2 * length[i], length[i] // 2} & by.keys():  # sets that differ more in size don't link
                which, them = by[k]
                us, them = (bits[i], them) if k == length[i] else (bits[i], folded(them)) if k > length[i] else (folded(bits[i]), them)
                near = may_link(np.bitwise_count(them ^ us).sum(1, dtype=np.int64), n[which], n[i], share)
                near[which == i] = False
                keep[which[near]] = True
                keep[i] |= near.any()
        return group.loc[keep, ["c", "i", "j", "side", "x"]]

    return blocks_of(stars, sizes).groupBy("c", "i", "j").applyInPandas(run, f"c {kind}, i int, j int, side int, x {kind}")


def among_others(possible: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) of rows that ask to rows of the other block of their pair, enough to join each component.

    Shared elements are counted through lists of the rows that hold an element; elements that all rows hold are counted
    once. Links between rows that are joined already are not given.
    """
    rows = possible.join(sets.select(F.col("doc_id").alias("x"), "items").hint("merge"), "x")
    kind = possible.schema["c"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, ask, side, out = group["x"].to_numpy(), group["ask"].to_numpy(), group["side"].to_numpy(), []
        items = [np.frombuffer(x, U) for x in group["items"]]
        size = np.array([len(x) for x in items])
        values, code, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = int((times == len(ids)).sum())
        holder = np.repeat(np.arange(len(ids)), size)
        some = times[code] < len(ids)
        code, holder = code[some], holder[some]
        order = np.argsort(code, kind="stable")
        holders, edges = holder[order], np.searchsorted(code[order], np.arange(len(values) + 1))
        own = np.searchsorted(holder, np.arange(len(ids) + 1))
        root = np.arange(len(ids))
        one = group["i"].iat[0] == group["j"].iat[0]
        for i in np.flatnonzero(ask):
            lists = [holders[edges[e] : edges[e + 1]] for e in code[own[i] : own[i + 1]]]
            inter = shared + (np.bincount(np.concatenate(lists), minlength=len(ids)) if lists else np.zeros(len(ids), np.int64))
            for j in np.flatnonzero(linked(inter, size[i], size, share) & (one | (side != side[i]))):
                if root[i] != root[j]:
                    root[root == root[i]] = root[j]
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.select("c", "i", "j", "side", "x", "ask", "items").groupBy("c", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def copies(sizes: DataFrame) -> DataFrame:
    """doc_id and the smallest doc_id, rep, with an equal set, of the rows that have such a one."""
    groups = written(sizes.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("digest", "rep"), "join-equal")
    return sizes.join(groups, "digest").where("doc_id > rep").select("doc_id", "rep")


def ngram_links(docs: DataFrame, sizes: DataFrame, share: int = SHARE) -> DataFrame:
    """Links (a, b) that join every component: of equal sets, of members with a bucket's smallest, and of other members."""
    some = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sizes = sizes.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    equal = written(copies(sizes), "join-copies")
    bucket = Window.partitionBy("sig")
    found = signature_rows(some, share).withColumn("c", F.min("doc_id").over(bucket)).where("c <> doc_id").select("c", F.col("doc_id").alias("x")).distinct()
    first = lambda k: equal.select(F.col("doc_id").alias(k), F.col("rep").alias(f"{k}_rep"))
    first_of = found.join(first("c"), "c", "left").join(first("x"), "x", "left").select(F.coalesce("c_rep", "c").alias("c"), F.coalesce("x_rep", "x").alias("x"))
    pairs = written(first_of.where("c <> x").distinct(), "join-pairs")
    freed(docs.sparkSession)
    judged = written(near_pairs(pairs, sizes, share), "join-near")
    near = judged.where("near").select("c", "x")
    possible = written(possible_others(pairs, sizes, share), "join-possible")
    named = near.select(F.col("c").alias("doc_id")).unionByName(near.select(F.col("x").alias("doc_id"))).unionByName(possible.select(F.col("x").alias("doc_id"))).distinct()
    sets = written(shingle_sets(some.join(named.hint("merge"), "doc_id", "left_semi")), "join-sets")
    freed(docs.sparkSession)
    stars = written(compared(near, sets, share), "join-stars")
    asked = possible.join(stars, ["c", "x"], "left").select("c", "i", "j", "side", "x", (~F.coalesce("link", F.lit(False))).alias("ask"))
    open_ = asked.groupBy("c", "i", "j").agg(F.max("ask").alias("any")).where("any").select("c", "i", "j")
    others = among_others(asked.join(open_, ["c", "i", "j"]), sets, share)
    links = stars.where("link").select(F.col("c").alias("a"), F.col("x").alias("b")).unionByName(equal.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    out = written(links.unionByName(others), "join-links")
    for used in (equal, pairs, judged, possible, sets, stars):
        dropped(used)
    return out


def ngram_join(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A document without words, or with null text, has the empty set and no link. Rows repeated under one doc_id are one
    node, linked by any of them; a row without doc_id is a component without id. Shingles are compared as 64-bit hashes.
    Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = written(set_sizes(docs), "join-sizes")
    found = components(ngram_links(docs, sizes, share)).withColumnRenamed("node", "doc_id")
    return sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
