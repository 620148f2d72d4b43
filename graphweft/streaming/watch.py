"""Watching a tree of files: what has changed between two listings, and a timer that waits until changes stop."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphweft.functions.lineage import shared_folder

#: What is watched and what is not.
WATCHED, IGNORED = r"\.(ts|html)$", r"(^|/)(node_modules|dist|\.git)(/|$)"
#: Kinds of changes that are commands: forget what is pending, or give it at once.
CANCEL, FLUSH = "cancel", "flush"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- the source ------------------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path below root, size and time of every watched file, from any store that Spark reads; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), F.col("length").alias("size"), F.col("modificationTime").alias("at"))
    base = f"{root.rstrip('/').partition(':')[2].lstrip('/') if '://' in root or root.startswith('file:') else root.strip('/')}/"
    path = F.substring("full", F.instr("full", base) + len(base), F.length("full"))
    return found.select(path.alias("path"), "size", "at").where(F.col("path").rlike(WATCHED) & ~F.col("path").rlike(IGNORED))


def differences(old: DataFrame, new: DataFrame, settled: Column) -> tuple[DataFrame, DataFrame]:
    """Changes (path, kind) from one listing to the next, and what is known afterwards.

    A file of which `settled` doesn't hold is still being written: it counts once it has stopped to change, and until
    then stays as it was known before.
    """
    n = new.select("path", F.col("size").alias("n_size"), F.col("at").alias("n_at"), settled.alias("settled"))
    both = old.join(n, "path", "full").withColumn("known", F.col("size").isNotNull())
    differs = (F.col("size") != F.col("n_size")) | (F.col("at") != F.col("n_at"))
    kind = F.when(F.col("n_size").isNull(), "deleted").when(~F.col("settled"), None).when(~F.col("known"), "added").when(differs, "modified")
    known = both.where("n_size IS NOT NULL AND (settled OR known)").select("path", F.when(F.col("settled"), F.col("n_size")).otherwise(F.col("size")).alias("size"), F.when(F.col("settled"), F.col("n_at")).otherwise(F.col("at")).alias("at"))
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "kind"), known


class Watch:
    """Polls a root; each poll's changes are given once, in the order of the polls, also after a restart.

    A poll is a version of the listing in `state`. on_changes runs before the version is marked, so changes of a poll that
    failed come again with the next one. The first poll of all only notes down what is there.
    """

    def __init__(self, spark: SparkSession, root: str, state: str, stable: timedelta = timedelta(milliseconds=300)):
        self.spark, self.root, self.state, self.stable = spark, root, state.rstrip("/"), stable

    def version(self) -> int:
        """The last version that is whole; -1 for none."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/v*/known/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return max((int(s.getPath().getParent().getParent().getName()[1:]) for s in found or []), default=-1)

    def known(self, n: int) -> DataFrame:
        return self.spark.read.schema("path string, size long, at timestamp").parquet(f"{self.state}/v{n}/known")

    def poll(self, on_changes: Callable[[DataFrame], None], now: datetime | None = None) -> None:
        n = self.version()
        new = listing(self.spark, self.root)
        settled = F.col("at") <= F.lit((now or datetime.now()) - self.stable)
        if n < 0:
            new.where(settled).write.mode("overwrite").parquet(f"{self.state}/v0/known")
            return
        changes, known = differences(self.known(n), new, settled)
        # the listing is read once: what changed and what is known must come from the same moment
        both = changes.select("path", "kind", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("at")).unionByName(known.select("path", F.lit("").alias("kind"), "size", "at"))
        folder = f"{self.state}/v{n + 1}"
        both.write.mode("overwrite").parquet(f"{folder}/poll")
        whole = self.spark.read.schema(both.schema).parquet(f"{folder}/poll")
        on_changes(whole.where("kind <> ''").select("path", "kind"))
        whole.where("kind = ''").select("path", "size", "at").write.mode("overwrite").parquet(f"{folder}/known")


def watched(watch: Watch, on_changes: Callable[[DataFrame], None], every: str = "1 second"):
    """A streaming query that polls again and again until it is stopped."""
    ticks = watch.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    state = f"{watch.state}/ticks-{uuid.uuid4().hex}"
    return ticks.writeStream.option("checkpointLocation", state).trigger(processingTime=every).foreachBatch(lambda batch, n: watch.poll(on_changes)).start()


# --- the timer -------------------------------------------------------------------------------------------------------------


class Rolling(StatefulProcessor):
    """Keeps the last kind of every path of a key and gives them all once nothing has come for `quiet`.

    Of a batch's rows a key holds times and numbers of paths and kinds in arrays, not rows; runs are told on these.
    """

    def __init__(self, quiet: timedelta):
        self.quiet = quiet // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", "path string", "kind string")
        self.last = handle.getValueState("last", "us long")  # microseconds, which have no time zone

    def stored(self, without: set[str] = frozenset()) -> Iterator[tuple[str, str]]:
        return ((path[0], kind[0]) for path, kind in self.kinds.iterator() if path[0] not in without)

    def pending(self) -> Iterator[tuple[int, str, str]]:
        """What the state holds, and then it holds nothing."""
        if self.last.exists():
            flushed = self.last.get()[0] + self.quiet
            yield from ((flushed, p, k) for p, k in self.stored())
        self.forgotten()

    def forgotten(self) -> None:
        self.kinds.clear()
        self.last.clear()

    def given(self, rows: Iterable[Row]) -> Iterator[tuple[int, str, str]]:
        """time, path and kind of what a batch's rows bring to an end; the rest goes to the state."""
        us, path, kind, paths, kinds = numbered(rows)
        rank = np.array([sorted(kinds).index(k) for k in kinds], np.int32)
        order = np.lexsort((rank[kind], us))
        us, path, kind = us[order], path[order], kind[order]
        command = np.isin(kind, [i for i, k in enumerate(kinds) if k in (CANCEL, FLUSH)])
        held = self.last.get()[0] if self.last.exists() else None
        # a row begins a run if it comes late enough after the one before it, or behind a command, which ends its run
        begins = np.append(held is None or us[0] >= held + self.quiet, (us[1:] - us[:-1] >= self.quiet) | command[:-1])
        if begins[0] and held is not None:
            yield from self.pending()
            held = None
        for first, end, changed in runs(begins, path, command):
            by = kinds[kind[end]] if command[end] else None
            at = int(us[end - 1 if by else end]) if end - bool(by) >= first else held
            if by is None and end + 1 == len(us):
                for i in changed:
                    self.kinds.updateValue((paths[path[i]],), (kinds[kind[i]],))
                self.last.update((at,))
                break
            if by != CANCEL and at is not None:
                yield from ((at + self.quiet, paths[path[i]], kinds[kind[i]]) for i in changed)
                if held is not None:  # only the first run goes on with what the state holds
                    yield from ((at + self.quiet, p, k) for p, k in self.stored({paths[path[i]] for i in changed}))
            if held is not None:
                self.forgotten()
                held = None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for us, path, kind in self.given(rows):
            yield Row(key=key[0], us=us, path=path, kind=kind)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.last.exists():
            self.handle.registerTimer((self.last.get()[0] + self.quiet) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        for us, path, kind in self.pending():
            yield Row(key=key[0], us=us, path=path, kind=kind)

    def close(self) -> None:
        pass


def numbered(rows: Iterable[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """us, numbers of paths and of kinds of all rows, which are read one by one, and the paths and kinds."""
    us, path, kind, paths, kinds = array("q"), array("i"), array("i"), {}, {}
    for r in rows:
        us.append(r["us"])
        path.append(paths.setdefault(r["path"], len(paths)))
        kind.append(kinds.setdefault(r["kind"], len(kinds)))
    return np.frombuffer(us, np.int64), np.frombuffer(path, np.int32), np.frombuffer(kind, np.int32), list(paths), list(kinds)


def runs(begins: np.ndarray, path: np.ndarray, command: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """first and last row of each run, and the last row of each of its paths; rows are ordered, commands are no changes."""
    run = np.cumsum(begins, dtype=np.int32)
    order = np.lexsort((path, run))  # stable, so the rows of a path in a run stay in their order
    order = order[~command[order]]
    p, r = path[order], run[order]
    keep = np.append((p[1:] != p[:-1]) | (r[1:] != r[:-1]), np.ones(min(1, len(p)), bool))
    order, r = order[keep], r[keep]
    ends = np.append(np.flatnonzero(begins[1:]), len(run) - 1)
    first = start = 0
    for end, cut in zip(ends.tolist(), np.searchsorted(r, run[ends], "right").tolist()):
        yield first, end, order[start:cut]
        first, start = end + 1, cut


def rolling(changes: DataFrame, key: str = "key", quiet: timedelta = timedelta(seconds=30), late: str = "1 minute") -> DataFrame:
    """key, flushed_at, path and kind: the last kind of each path for each run of changes that a pause of `quiet` ends.

    changes: a stream of (key, path, kind, at timestamp). Every path is an entry of its own in the state, so no run is held
    as a list. Of changes of one path at one time the one with the larger kind counts. A row of kind `cancel` forgets what
    is pending for its key, one of kind `flush` gives it at once. What still waits when the stream ends stays in its state.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = f"key {changes.schema[key].dataType.simpleString()}, us long, path string, kind string"
    rows = changes.select(F.col(key).alias("key"), "path", "kind", "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    out = rows.groupBy("key").transformWithState(Rolling(quiet), schema, "append", "eventTime")
    return out.select("key", F.timestamp_micros("us").alias("flushed_at"), "path", "kind")


def gathered(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that an appending stream has given so far, over restarts with the same folder; a batch that runs again counts once."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/graphweft/stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out"]).select(*stream.columns)
