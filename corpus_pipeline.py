"""A training corpus in five stages: rules, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Rows without doc_id pass the stages that decide by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import dropped, table, words, written
from graphweft.llm.exact_dedup import exact_dedup
from graphweft.llm.ngram_join import ngram_join
from graphweft.llm.quality_rules import quality_rules
from graphweft.llm.sentencepiece_codec import VOCABULARY, Codec, encoded
from graphweft.llm.source_mix import copies, source_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row: doc_id where that is one, else one given to rows that are written so that it stays."""
    plain = docs.select(*COLUMNS)
    if plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return plain.withColumn("row", F.col("doc_id"))
    return written(plain.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def by_row(rows: DataFrame) -> DataFrame:
    """The rows with their number as doc_id, for an operator that judges each."""
    return rows.select(F.col("row").alias("doc_id"), "text", "lang", "source", "n_chars")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in gone (row); those without doc_id stay."""
    named = gone.join(rows.where("doc_id IS NOT NULL").select("row"), "row", "left_semi")
    return rows.join(named, "row", "left_anti").select(*COLUMNS)


def but_one(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of groups (row, root) all rows but the one with the smallest doc_id, or the first of these."""
    ids = groups.join(rows.select("row", "doc_id"), "row").where("doc_id IS NOT NULL")
    stays = ids.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return ids.select("row").join(stays, "row", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (op 6) reject go."""
    rows = numbered(docs)
    return without(rows, quality_rules(by_row(rows)).where("NOT kept").select(F.col("doc_id").alias("row")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (op 2) the row with the smallest doc_id stays."""
    rows = numbered(docs)
    found = written(exact_dedup(by_row(rows)).where("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("root")), "pipeline-copies")
    return without(rows, but_one(rows, found))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram Jaccard (op 4) the one with the smallest doc_id stays."""
    rows = numbered(docs)
    found = written(ngram_join(by_row(rows)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), "pipeline-near")
    return without(rows, but_one(rows, found))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mixture (op 3) takes its words, in whole copies: not at all to three times.

    What is left of a copy is carried on to documents of like size, so each source keeps its words. Every row counts by
    itself, those without doc_id or with a repeated one too: rows and copies are matched by id, source, size and place.
    """
    key = F.struct("doc_id", "source", "size").alias("key")  # structs are equal where both have null
    place = lambda *order: F.row_number().over(Window.partitionBy("key").orderBy(*order)).alias("place")
    times = copies(source_mix(docs)).select(key, "times").select("key", "times", place("times"))
    sized = docs.select(*COLUMNS, F.size(words(F.col("text"))).cast("long").alias("size")).select(*COLUMNS, key)
    listed = sized.select(*COLUMNS, "key", place(F.xxhash64("text"), "text", "lang", "n_chars"))
    return listed.join(times.where("times > 0"), ["key", "place"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by SentencePiece (op 7)."""
    return encoded(docs.select("doc_id", "lang", "source", "text"), Codec.load(spark, VOCABULARY)).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram join", near), ("source mix", mixture), ("sentencepiece", tokens)]

#: Robust estimates and signatures have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last is not None:
            dropped(last)  # what the stage before has left is not read again
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
