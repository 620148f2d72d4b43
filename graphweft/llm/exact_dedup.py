"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut where a hash of the last 16 bytes meets a condition, so equal texts are cut alike. Chunks get
identifiers, checked against the bytes: only chunk hashes that stand for two different contents need an ordinal. Texts
are then compared by their ordered lists of identifiers, some 16 bytes for a thousand of text, and no document moves.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import SPACE, once, table, written

#: A chunk has LEAST to MOST bytes and 1,024 more than LEAST on average.
LEAST, MOST, MASK, SPAN = 256, 8192, np.uint32(1023 << 20), 16
#: Bytes that are hashed at a time.
BLOCK = 1 << 20


def byte_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends of the 16-byte stretches whose hash asks for a cut, in blocks; a stretch's hash depends on its bytes alone."""
    found, gear = [], byte_table()
    for at in range(0, len(data), BLOCK):
        back = min(at, SPAN - 1)
        h = gear[data[at - back : at + BLOCK]]
        for k in (1, 2, 4, 8):  # doubling: the hash of 2k bytes from two of k
            wide = h.copy()
            wide[k:] += h[:-k] << np.uint32(k)
            h = wide
        found.append(np.flatnonzero((h[back:] & MASK) == 0) + at + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut(start: int, end: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of bytes start to end, relative to start."""
    ends, at = [], start
    while end - at > LEAST:
        k = bisect_left(wanted, at + LEAST)
        at = min(wanted[k] if k < len(wanted) else end, at + MOST, end)
        ends.append(at - start)
    if at < end:
        ends.append(end - start)
    return ends


def chunk_ends(texts: pa.Array) -> pa.Array:
    """Per text the byte places where its chunks end; none for an empty one."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    places = places - places[0] if len(places) else places
    wanted = candidates(body).tolist()
    return pa.array([cut(a, b, wanted) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.list_(pa.int32()))


def hashes(chunk: Column) -> list[Column]:
    """Two hashes with different seeds."""
    return [F.xxhash64(chunk), F.xxhash64(F.lit(1), chunk)]


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, the normalised text and its chunks as bytes, in order."""
    ends_of = F.arrow_udf(chunk_ends, "array<int>").asNondeterministic()  # evaluated once, however often it is read
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    df = docs.select("doc_id", text.alias("text")).withColumn("ends", ends_of("text"))

    def pieces(body: Column) -> Column:
        def piece(end: Column, i: Column) -> Column:
            start = F.coalesce(F.get("ends", i - 1), F.lit(0))
            return F.substring(body, start + 1, end - start)

        return F.transform("ends", piece)

    return df.select("doc_id", "text", once(F.col("text").cast("binary"), pieces).alias("chunks"))


def collided(chunks: DataFrame, ids: list[str]) -> DataFrame | None:
    """Hashes that stand for more than one content, with an ordinal for each content; None if there are none."""
    several = written(chunks.groupBy(*ids, "chunk").agg(F.lit(1).alias("one")).groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "dedup-clashes")
    if several.isEmpty():
        return None
    contents = chunks.join(several, ids, "left_semi").select(*ids, "chunk").distinct()
    return contents.withColumn("ordinal", F.row_number().over(Window.partitionBy(*ids).orderBy("chunk")))


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], list[Column]] = hashes) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. A group keeps the row with its smallest doc_id; nulls
    come last, and a group of nulls alone keeps null. Rows repeated under one doc_id count each in group_size and share
    the verdict. Columns other than doc_id and text are not read. Hashes with two contents are told apart by ordinals,
    so the result rests on compared bytes.
    """
    parts = chunked(docs)
    recipe = F.flatten(F.transform("chunks", lambda c: F.array(*hashed(c))))
    recipes = written(parts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe")), "dedup-recipes")
    # the outer form, as for the inner one the optimizer adds a filter that cuts every text a second time
    exploded = parts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer("chunks").alias("at", "chunk")).where("chunk IS NOT NULL")
    ids = [f"h{k}" for k in range(len(hashed(F.lit(""))))]
    keyed = exploded.select("doc_id", "text_sha256", "at", "chunk", *(c.alias(k) for k, c in zip(ids, hashed(F.col("chunk")), strict=True)))
    if (clashes := collided(keyed, ids)) is not None:
        told = keyed.join(clashes, [*ids, "chunk"]).groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "ordinal"))).alias("told"))
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
        recipes = written(recipes.alias("a").join(told.alias("b"), same, "left").select("a.*", F.coalesce("b.told", F.array().cast(told.schema["told"].dataType)).alias("told")), "dedup-recipes")
    keys = [c for c in recipes.columns if c not in ("doc_id", "text_sha256")]
    groups = written(recipes.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    return recipes.join(groups, keys).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
