"""Mixing sources to target weights by fixed-length blocks of tokens.

The words of a source form one stream, cut into blocks. Every output shard, of a fixed number of slots, gets multinomial
counts of slots per source, drawn so that all shards together meet the targets; the slots of a source are numbered across the shards and mapped through a pseudorandom permutation of its block numbers,
a new one each time all blocks have been used. Blocks are joined by number, so a third of all rows in one source is
spread like any other rows. Only the list of sources with their sizes, which is what the weights are given for, is
held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import table, words, written

#: Words in a block, slots in an output shard, documents in a stretch of a source's order on average.
BLOCK, SHARD, STRETCH = 64, 2048, 2048
WEIGHTS, MOST = (5, 2, 1), 3


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    docs: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, none above `most` times its size; the excess goes to the others by weight."""
    out, left = [0.0] * len(sizes), float(sum(sizes))
    open_ = set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        for i in above or open_:
            out[i] = float(most * sizes[i]) if above else weights[i] * unit
        left -= sum(out[i] for i in above)
        open_ = open_ - above if above else set()
    return out


def slots_of(size: int, target: float, block: int) -> tuple[int, int]:
    """Blocks of a source, and how many slots take its target: whole rounds over all blocks, then a part of one."""
    if size == 0:
        return 0, 0
    blocks = -(-size // block)
    rounds = int(target // size)
    return blocks, rounds * blocks + round((target - rounds * size) * blocks / size)


def sources_of(sizes: DataFrame, weights: tuple[float, ...], block: int) -> list[Source]:
    """One entry per source, in the order of their names' code points, null last."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    return [Source(r["source"], r["size"], r["docs"], t, *slots_of(r["size"], t, block)) for r, t in zip(rows, wanted, strict=True)]


def share_of_left(count: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many slots of each source fall in the first `left` of all slots: draws without putting back, source by source.

    Above a thousand million slots numpy has no such draw; there its normal form is rounded into the possible range.
    """
    out, total = np.zeros_like(count), int(count.sum())
    for s, n in enumerate(count.tolist()):
        rest = total - n
        low, high = max(0, left - rest), min(n, left)
        if low == high:
            drawn = low
        elif total < 1_000_000_000:
            drawn = int(rng.hypergeometric(n, rest, left))
        else:
            mean = left * (n / total)
            deviation = (mean * (rest / total) * ((total - left) / (total - 1))) ** 0.5
            drawn = min(max(round(rng.normal(mean, deviation)), low), high)
        out[s], left, total = drawn, left - drawn, rest
    return out


def shard_counts(totals: np.ndarray, shard: int, seed: int, wanted: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """shard, first slot and count per source, of the shards in `wanted`; a shard has `shard` slots, the last one fewer.

    A shard's counts are a multinomial draw by the sources' weights, given that all shards together meet each source's
    total. Halves of a range of shards share what the range holds, with draws seeded by the range, so a task finds the
    counts and offsets of its own shards without asking others.
    """
    slots = int(totals.sum())
    ranges = [(0, -(-slots // shard), np.zeros_like(totals), totals.copy())]
    while ranges:
        low, high, first, count = ranges.pop()
        if low >= wanted[1] or high <= wanted[0]:
            continue
        if high - low == 1:
            yield low, first, count
            continue
        middle = (low + high) // 2
        left = share_of_left(count, (middle - low) * shard, np.random.default_rng([seed, low, high]))
        ranges += [(middle, high, first + left, count - left), (low, middle, first, left)]


def permuted(index: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network, walked until it falls inside."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(6):
            mixed = (right + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64), key)
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside], key[outside])
    return out.astype(np.int64)


def slots(spark, sources: list[Source], seed: int = 11) -> DataFrame:
    """shard, slot, source index s and block of every output slot."""
    totals = np.array([s.slots for s in sources], np.int64)
    sizes = [s.blocks for s in sources]
    shards = -(-int(totals.sum()) // SHARD)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for shard, first, count in shard_counts(totals, SHARD, seed, (int(batch["id"].min()), int(batch["id"].max()) + 1)):
                which, blocks = [], []
                for s in np.flatnonzero(count):
                    j = np.arange(first[s], first[s] + count[s])
                    key = (j // sizes[s]).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(s + 1)
                    blocks.append(permuted(j % sizes[s], sizes[s], key))
                    which.append(np.full(len(j), s, np.int32))
                order = np.random.default_rng([seed, shard]).permutation(sum(map(len, which)))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(order), dtype=np.int32), "s": np.concatenate(which)[order], "block": np.concatenate(blocks)[order]})

    return spark.range(shards).mapInPandas(draw, "shard long, slot int, s int, block long")


def placed(sizes: DataFrame, sources: list[Source], also: tuple[str, ...] = ()) -> DataFrame:
    """sizes (and its columns `also`) with the source's index s, and the place `start` where the document begins in the stream of its source.

    Running sums in two levels: a source's documents are dealt by hash into stretches of some thousand, whatever its
    share of the rows; sums of stretches are added up first, then documents within each stretch.
    """
    spark = sizes.sparkSession
    dim = spark.createDataFrame([(i, s.name, -(-s.docs // STRETCH)) for i, s in enumerate(sources)], "s int, name string, stretches long")
    h = F.xxhash64("doc_id")
    dealt = sizes.join(F.broadcast(dim), F.col("source").eqNullSafe(F.col("name"))).withColumn("h", h).withColumn("stretch", F.pmod("h", "stretches")).drop("name", "stretches")
    sums = dealt.groupBy("s", "stretch").agg(F.sum("size").alias("total"))
    before = sums.select("s", "stretch", (F.sum("total").over(Window.partitionBy("s").orderBy("stretch")) - F.col("total")).alias("before"))
    inner = Window.partitionBy("s", "stretch").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("run", F.sum("size").over(inner) - F.col("size"))
    return run.join(before, ["s", "stretch"]).select("doc_id", "source", "size", *also, "s", (F.col("before") + F.col("run")).alias("start"))


def parts_of_blocks(docs: DataFrame, block: int) -> DataFrame:
    """One row for each document and block that overlap: the first word within the document and the number of words."""
    end = F.col("start") + F.col("size")
    rows = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    first = F.greatest(F.col("block") * block, F.col("start"))
    return rows.select("*", (first - F.col("start")).alias("first_word"), (F.least((F.col("block") + 1) * block, end) - first).alias("n_words"))


def source_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    Null text has size 0 and is never taken; so is every row if all sizes are 0. Null source is a source of its own.
    Rows repeated under one doc_id are documents of their own. A source's taken words differ from its target by at most
    about half a block and the slack of its last, short block. Draws depend on the seed and the sizes alone.
    """
    sizes = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    sources = sources_of(sizes, weights, block)
    spark = docs.sparkSession
    where = placed(sizes, sources)
    times = slots(spark, sources, seed).groupBy("s", "block").agg(F.count("*").alias("times"))
    parts = parts_of_blocks(where, block).join(times.hint("merge"), ["s", "block"], "left")  # the size of a range says nothing of its slots
    taken = parts.groupBy("doc_id", "source", "size", "s", "start").agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = where.where("size = 0").select("doc_id", "source", "size", "s", "start", F.lit(0).cast("long").alias("taken"))
    dim = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(sources)], "s int, source_size long, target double")
    return taken.unionByName(none).join(F.broadcast(dim), "s").select("doc_id", "source", "size", "source_size", "target", "taken")


def copies(mix: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, size and times, the whole copies of each row of source_mix() that has taken words.

    The whole part of taken / size is given; what remains of it is summed along the documents of a source in order of
    size, and a document gets one more copy where the sum passes a whole number. Neighbours are of nearly one size, so
    the words of a source differ from the taken ones by about one document, whatever the lengths; the place at which the
    sum begins is drawn per source, so each document comes taken / size times on average. Sums are whole numbers, in two
    levels as in placed(): classes of sizes that differ by one in a hundred, dealt into stretches by hash.
    """
    unit = 1 << 30
    rest = F.expr(f"(taken % size) * {unit} div size")
    some = mix.where("taken > 0").select("doc_id", "source", "size", "taken", rest.alias("rest"), F.struct("source", F.floor(F.log2("size") * 64).alias("class")).alias("g"), F.xxhash64("doc_id", "size").alias("h"))
    counts = some.groupBy("g").agg(F.ceil(F.count("*") / STRETCH).alias("stretches"))
    dealt = some.join(F.broadcast(counts), "g").withColumn("stretch", F.pmod("h", "stretches"))
    before = F.sum("total").over(Window.partitionBy("g.source").orderBy("g.class", "stretch")) - F.col("total")
    sums = dealt.groupBy("g", "stretch").agg(F.sum("rest").alias("total")).select("g", "stretch", before.alias("before"))
    inner = Window.partitionBy("g", "stretch").orderBy("h", "doc_id", "size", "taken").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("run", F.sum("rest").over(inner)).join(sums, ["g", "stretch"])
    upto = run.withColumn("upto", F.col("before") + F.col("run") + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(unit)))
    return upto.select("doc_id", "source", "size", F.expr(f"taken div size + upto div {unit} - (upto - rest) div {unit}").cast("int").alias("times"))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """The mixture itself: shard, slot, source, and the words of the block in that slot.

    Every row of docs counts by itself, whether its doc_id is null or repeated: rows are numbered in a written table.
    Null and empty texts fill no block, so a table of such rows alone gives no slot.
    """
    listed = written(docs.select("doc_id", "source", words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sizes = listed.select("doc_id", "source", "row", F.size("w").cast("long").alias("size"))
    sources = sources_of(sizes, weights, block)
    parts = parts_of_blocks(placed(sizes, sources, ("row",)), block).drop("doc_id")
    texts = listed.select("row", "w").hint("merge")
    cut = parts.join(texts, "row").select("s", "source", "block", "start", F.slice("w", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("w"))
    whole = cut.groupBy("s", "source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "w"))), lambda p: p["w"])).alias("words"))
    return slots(docs.sparkSession, sources, seed).hint("merge").join(whole.hint("merge"), ["s", "block"]).select("shard", "slot", "source", "words")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents")).drop("source")
