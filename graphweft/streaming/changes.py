"""Change events as a stream: sessions of quiet, and batches applied to a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions.lineage import shared_folder
from graphweft.operators.normalize import apply_changes, latest


def change_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Files of change events as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def debounced(changes: DataFrame, key: str | None = None, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """path and its last kind for each run of changes that a pause of `quiet` ends, for batches and streams alike.

    changes(path, kind, at timestamp). A column `key`, which comes out as well, gives each of its values a session of its
    own, which spreads the state; without it all changes share one, as one timer would have it, so that session's changes
    meet in one task. Of changes of one path at one time the one with the larger kind counts. No session is ever empty.
    """
    # one key for all that isn't a constant: streams need a key of their own beside the session
    by = [F.col(key)] if key else [F.pmod(F.xxhash64("path"), F.lit(1)).alias("key")]
    also = [key] if key and key != "path" else []
    events = changes.withWatermark("at", late) if changes.isStreaming else changes
    grouped = events.groupBy(*by, F.session_window("at", quiet)).agg(F.array_sort(F.collect_list(F.struct("path", "at", "kind"))).alias("events"))
    last = F.filter("events", lambda e, i: ~F.coalesce(F.get("events", i + 1)["path"] == e["path"], F.lit(False)))
    return grouped.select(*also, "session_window", F.explode(last).alias("e")).select(*also, "session_window", "e.path", "e.kind")


def session_counts(events: DataFrame, quiet: str) -> DataFrame:
    """Sessions of each user_id: start, number and last kind of events (user_id, event_type, ts, at)."""
    found = events.groupBy("user_id", F.session_window("at", quiet)).agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_type"))
    return found.select("user_id", "started", "n", "last_type")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream gives for what has come so far, as a table in the shared folder; each batch replaces the last."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/graphweft/stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def applied(changes: DataFrame, rows: DataFrame, extract) -> DataFrame:
    """rows(path, …) after a stream of changes (path, kind, ts, seq), batch by batch.

    Each batch makes a new version beside the old one, so a batch that is run again after a failure gives the same rows:
    a version is named by its batch and built from the one before it. extract(paths) gives the rows of changed paths anew.
    Beside each version stands the newest (ts, seq) of every path seen so far, deleted ones too, and a change that is not
    newer is left out, so the rows don't depend on how or in which order the changes were dealt into batches.
    """
    spark = changes.sparkSession
    folder = f"{shared_folder(spark)}/graphweft/versions-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/v0")
    newest = F.max(F.struct("ts", "seq")).alias("newest")
    changes_schema = changes.select("path", F.struct("ts", "seq").alias("newest")).schema
    spark.createDataFrame([], changes_schema).write.parquet(f"{folder}/seen0")
    done = [0]

    def apply(batch: DataFrame, n: int) -> None:
        seen = spark.read.schema(changes_schema).parquet(f"{folder}/seen{n}")
        came = batch.groupBy("path").agg(newest)
        fresh = came.join(seen.withColumnRenamed("newest", "known"), "path", "left").where("known IS NULL OR newest > known").select("path")
        last = latest(batch).join(fresh, "path", "left_semi")
        seen.unionByName(came).groupBy("path").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{folder}/seen{n + 1}")
        before = spark.read.schema(rows.schema).parquet(f"{folder}/v{n}")
        apply_changes(before, last, extract(last)).write.mode("overwrite").parquet(f"{folder}/v{n + 1}")
        done[0] = n + 1

    query = changes.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/v{done[0]}")
