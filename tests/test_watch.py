"""Watching files by listings, and the rolling timer on batches that come one by one, with commands and a restart."""

import os
import random
import tracemalloc
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from graphweft.streaming.changes import change_stream, debounced
from graphweft.streaming.watch import Rolling, Watch, gathered, rolling

SCHEMA = "key string, path string, kind string, at timestamp"


def put(root, name, text, age):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    when = datetime.now().timestamp() - age
    os.utime(path, (when, when))


def test_watch(spark, tmp_path):
    root, state = tmp_path / "src", str(tmp_path / "state")
    for name in ("a.ts", "sub/b.html", "c.md", "node_modules/x.ts", "dist/y.ts"):
        put(root, name, "1", 60)
    got = []
    note = lambda changes: got.append({(r["path"], r["kind"]) for r in changes.collect()})
    Watch(spark, str(root), state).poll(note)
    assert not got  # what is there at first is no change
    put(root, "a.ts", "22", 50)
    put(root, "sub/new.ts", "1", 50)
    put(root, "half.ts", "1", -60)  # still being written
    (root / "sub/b.html").unlink()
    Watch(spark, str(root), state).poll(note)
    assert got.pop() == {("a.ts", "modified"), ("sub/new.ts", "added"), ("sub/b.html", "deleted")}

    def fails(changes):
        note(changes)
        raise RuntimeError

    put(root, "half.ts", "12", 40)
    watch = Watch(spark, f"file://{root}", state)  # a new process, and another name of the same root
    for _ in range(2):
        try:
            watch.poll(fails)
        except RuntimeError:
            pass
    watch.poll(note)
    assert got == [{("half.ts", "added")}] * 3  # nothing is lost, and what failed comes again
    got.clear()
    watch.poll(note)
    assert got == [set()]


def landed(spark, folder, batches, first=0):
    """One file a batch, in the order of their times."""
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(batches, first):
        made = folder.with_name(f"made{k}")
        spark.createDataFrame([(key, p, kind, datetime(2024, 1, 1) + timedelta(seconds=s)) for key, p, kind, s in rows], SCHEMA).coalesce(1).write.parquet(str(made))
        for f in made.glob("part-*"):
            os.rename(f, folder / f"{k:03}.parquet")
            os.utime(folder / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def seconds(rows):
    return {(r["key"], int((r["flushed_at"] - datetime(2024, 1, 1)).total_seconds()), r["path"], r["kind"]) for r in rows.collect()}


END = [("end", "e", "x", 100_000)]


def test_rolling(spark, tmp_path):
    batches = [
        [("a", "p", "added", 0), ("a", "q", "added", 10), ("b", "p", "added", 5)], [("a", "p", "modified", 35)],  # the timer starts anew
        [("a", "p", "deleted", 100), ("c", "z", "added", 90)], [("c", "", "cancel", 95), ("c", "y", "added", 96), ("d", "w", "added", 97), ("d", "", "flush", 98)], END,
    ]
    landing = tmp_path / "in"
    landed(spark, landing, batches)
    stream = lambda: rolling(change_stream(spark, str(landing), SCHEMA, per_trigger=1), late="1 second")
    got = seconds(gathered(stream()).where("key <> 'end'"))
    assert got == {("a", 65, "p", "modified"), ("a", 65, "q", "added"), ("b", 35, "p", "added"), ("a", 130, "p", "deleted"), ("c", 126, "y", "added"), ("d", 127, "w", "added")}


def test_rolling_equals_sessions_of_the_whole_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((rng.choice("ab"), rng.choice("pqr"), rng.choice(["added", "modified", "deleted"]), rng.randrange(2000)) for _ in range(150)), key=lambda r: r[3])
    batches = [rows[i : i + 30] for i in range(0, 150, 30)] + [END]
    landing = tmp_path / "in"
    for first, last in ((0, 3), (3, 6)):  # the query is stopped after three files and goes on later
        landed(spark, landing, batches[first:last], first)
        got = gathered(rolling(change_stream(spark, str(landing), SCHEMA, per_trigger=1), late="1 second"), str(tmp_path / "out"))
    whole = spark.createDataFrame([(k, p, kind, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, p, kind, s in rows], SCHEMA)
    want = debounced(whole, "key").select("key", F.col("session_window.end").alias("flushed_at"), "path", "kind")
    assert seconds(got.where("key <> 'end'")) == seconds(want)


class Held:
    """A state store of one key."""

    def __init__(self):
        self.kinds, self.last, self.timers = {}, [], []
        self.getMapState = lambda *a: SimpleNamespace(iterator=lambda: iter([((p,), (k,)) for p, k in self.kinds.items()]), updateValue=lambda p, k: self.kinds.update({p[0]: k[0]}), clear=self.kinds.clear)
        self.getValueState = lambda *a: SimpleNamespace(exists=lambda: bool(self.last), get=lambda: self.last[0], update=lambda v: self.last.__setitem__(slice(None), [v]), clear=self.last.clear)
        self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(self.timers), self.timers.append, self.timers.remove


def rolled(store, rows):
    timer = Rolling(timedelta(microseconds=10))
    timer.init(store)
    found = timer.handleInputRows(("k",), (Row(us=us, path=path, kind=kind) for us, path, kind in rows), None)
    return [(r["us"], r["path"], r["kind"]) for r in found]


def one_by_one(batches):
    """The timer row by row."""
    pending, last = {}, None
    for batch in batches:
        out = []
        for us, path, kind in sorted(batch, key=lambda r: (r[0], r[2])):
            late = last is not None and us >= last + 10
            if late or kind == "flush":
                out += [(last + 10, p, k) for p, k in pending.items()]
            if late or kind in ("flush", "cancel"):
                pending, last = {}, None
            if kind not in ("flush", "cancel"):
                pending[path], last = kind, us
        yield sorted(out), dict(pending), last


def test_runs_in_arrays_equal_the_timer_row_by_row():
    rng = random.Random(9)
    for case in range(300):
        kinds = ["added", "deleted", "modified"] + ["flush", "cancel"] * (case % 2)
        batches = [[(rng.randrange(40 * b, 40 * b + 60), rng.choice("pqr"), rng.choice(kinds)) for _ in range(rng.randrange(1, 25))] for b in range(4)]
        # the order of one path's changes and commands at a time is that of kinds; of equal ones any
        store = Held()
        for batch, (out, pending, last) in zip(batches, one_by_one(batches)):
            assert sorted(rolled(store, batch)) == out
            assert store.kinds == pending and store.last == ([] if last is None else [(last,)])
            assert store.timers == ([] if last is None else [(last + 10) // 1000])


def test_a_keys_rows_are_not_held_as_objects():
    n, timer = 200_000, Rolling(timedelta(microseconds=10))
    timer.init(Held())
    rows = (Row(us=i, path=f"p{i % 40}", kind="added") for i in range(n))
    tracemalloc.start()
    assert not list(timer.handleInputRows(("k",), rows, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n
