"""Substrings that an earlier document has too, by merging Burrows-Wheeler transforms of shards.

Equal strings of LENGTH bytes choose the same anchor among their 16-byte stretches, the one with the least hash. A piece is
the stretch of text whose strings share an anchor. Pieces that are equal need no sorting: they are joined to runs that a
smaller document has too, and a run goes once the SHA-256 of its bytes there and here agree. Pieces that share an anchor
but differ are dealt by the 33 bytes that two of them with a common string must share. In parts of bounded size their
shards get their transforms alone, these are merged by refining their interleaving one character at a time, and the
common prefixes that this yields bound the repeated intervals. No suffix is sorted twice, no document meets another whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import dropped, freed, table, written
from graphweft.llm.ngram_join import id_type, mixed

LENGTH, GRAM = 50, 16
#: Bytes on one side of an anchor that two pieces agree in at least if they have a string in common.
SIDE = (LENGTH - GRAM) // 2
#: Bytes hashed at a time; bytes in a shard, in a part that is merged at once, and of one key beyond which its strings are
#: compared by grouping them instead.
BLOCK, SHARD, PART, MOST = 1 << 18, 1 << 15, 1 << 17, 1 << 22
#: One document of so many is looked at for hot anchors, and the part of its pieces that makes an anchor hot: there are
#: 1,000 such anchors at most, and all pieces of any other one are a small part of a task's share.
PROBE, HOT, SALTS = 64, 0.001, 64
U = np.uint64


class Anchors:
    """Pieces of texts with the hash of their anchor and of all their bytes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(2)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = 0xD6E8FEB86659FD93
        self.power, self.inverse = np.empty(0, U), np.empty(0, U)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse for n bytes at least."""
        if len(self.power) < n:
            for name, b in (("power", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, U(b))
                steps[0] = U(1)
                setattr(self, name, np.multiply.accumulate(steps))

    def of(self, body: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the pieces of one text: anchor's hash, piece's hash, start, end and the anchor's place; an end is exclusive."""
        n = len(body)
        if n < LENGTH:
            return tuple(np.empty(0, t) for t in (U, U, np.int64, np.int64, np.int64))
        self.grow(n + 1)
        run = np.concatenate([[U(0)], np.cumsum(self.value[body] * self.power[:n], dtype=U)])
        grams = mixed((run[GRAM:] - run[:-GRAM]) * self.inverse[: n - GRAM + 1], 21)
        reach = LENGTH - GRAM + 1
        count = n - LENGTH + 1
        # the place breaks ties between equal hashes, the same way wherever the string stands
        least, at, wide = grams, np.arange(len(grams)), 1
        while wide < reach:
            step = min(wide, reach - wide)
            right = least[step:] < least[: len(least) - step]
            at = np.where(right, at[step:], at[: len(at) - step])
            least = np.where(right, least[step:], least[: len(least) - step])
            wide += step
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        lasts = np.concatenate([starts[1:] - 1, [count - 1]])
        ends = lasts + LENGTH
        whole = mixed((run[ends] - run[starts]) * self.inverse[starts] + (ends - starts).astype(U), 22)
        return least[starts], whole, starts, ends, at[starts]


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield body[a:b]


def piece_rows(docs: DataFrame, hot: tuple[int, ...] = ()) -> DataFrame:
    """anchor, piece, doc_id and place of every piece.

    place packs start, size and the anchor's place in the piece (see unpacked). The last bit of an anchor is 0; those of
    hot ones are spread over SALTS values with last bit 1.
    """
    hot = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()

        def batch(found: list[tuple], ids: list[int], source: pa.Array) -> pa.RecordBatch:
            a, p, s, e, at = (np.concatenate(x) for x in zip(*found, strict=True))
            a &= ~U(1)
            is_hot = np.isin(a.view(np.int64), hot)
            a[is_hot] = mixed(a[is_hot] + mixed(s[is_hot].astype(U), 24) % U(SALTS), 25) | U(1)
            columns = [a.view(np.int64), p.view(np.int64), source.take(pa.array(np.repeat(ids, [len(f[0]) for f in found]), pa.int64())), s << 14 | (e - s) << 7 | (at - s)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "piece", "doc_id", "place"])

        for b in batches:
            found, ids, size = [], [], 0
            for i, body in enumerate(text_bytes(b.column(1))):
                found.append(anchors.of(body))
                ids.append(i)
                size += len(body)
                if size > BLOCK:
                    yield batch(found, ids, b.column(0))
                    found, ids, size = [], [], 0
            if found:
                yield batch(found, ids, b.column(0))

    return docs.select("doc_id", "text").mapInArrow(run, f"anchor long, piece long, doc_id {id_type(docs)}, place long")


def unpacked(place: Column) -> list[Column]:
    """start, size and at of a piece."""
    return [F.shiftright(place, 14).alias("start"), (F.shiftright(place, 7) % 128).alias("size"), (place % 128).alias("at")]


def transform(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform of one shard: per suffix in order the symbol before it, its piece and its place; the end sorts first."""
    size = np.array([len(p) for p in pieces])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    n = int(start[-1])
    text = np.zeros(n, np.int64)
    of = np.repeat(np.arange(len(pieces)), size + 1)
    place = np.arange(n) - start[of]
    inside = place < size[of]
    text[inside] = np.concatenate(pieces).astype(np.int64) + 1
    left = size[of] - place  # symbols before the end
    rank, known = np.zeros(n, np.int64), 6
    for k in range(known):
        rank = rank * 512 + np.where(left > k, np.concatenate([text[k:], np.zeros(k, np.int64)]), 0)
    rank = np.unique(rank, return_inverse=True)[1]
    while known <= int(size.max()):
        after = np.where(left > known, np.concatenate([rank[known:], np.zeros(min(known, n), np.int64)])[:n] + 1, 0)
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
        known *= 2
    order = np.lexsort((of, rank))
    before = np.where(place[order] > 0, text[order - 1], 0)
    return before.astype(np.uint16), of[order], place[order]


def merge(transforms: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaving of shards' transforms, and for every place in it the common prefix of its suffix with the one before.

    ends: the number of pieces of each shard. From shards one after the other, each round sorts the interleaving by one
    more symbol: symbols before suffixes, taken in the order so far, say where these suffixes' predecessors go. A boundary
    between two places stays once it is there, so the round in which it comes up tells the common prefix: one symbol
    less. Prefixes of `depth` symbols or more count as `depth`; two ends are never equal.
    """
    symbols = np.concatenate(transforms)
    narrow = np.uint8 if symbols.max(initial=0) < 256 else np.uint16  # bytes of UTF-8 leave room for the end
    symbols = symbols.astype(narrow)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    fixed = np.repeat(np.arange(len(transforms), dtype=np.uint8), ends)
    total_ends, n = len(fixed), len(symbols)
    block, prefix = np.zeros(n, np.int32), np.full(n, depth, np.uint8)
    for known in range(depth):
        now = np.empty(n, narrow)
        now[np.argsort(source, kind="stable")] = symbols
        order = np.argsort(now, kind="stable")
        source = np.concatenate([fixed, source[order[total_ends:]]])
        symbol, old = now[order], block[order]
        parts = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])])
        parts[: total_ends + 1] = True
        prefix[parts & (prefix == depth)] = known
        block = np.cumsum(parts, dtype=np.int32)
    return source, prefix


def earlier(pieces: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and place of every string of LENGTH bytes that a piece of a smaller owner has too."""
    shards, size = [[]], 0
    for i, p in enumerate(pieces):
        if size > SHARD and len(shards) < 255:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(p) + 1
    made = [transform([pieces[i] for i in s]) for s in shards]
    source, prefix = merge([m[0] for m in made], [len(s) for s in shards], LENGTH)
    spread = np.argsort(source, kind="stable")
    of, place = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    of[spread] = np.concatenate([np.array(s)[m[1]] for s, m in zip(shards, made, strict=True)])
    place[spread] = np.concatenate([m[2] for m in made])
    begin = np.flatnonzero(prefix < LENGTH)  # each interval of suffixes that agree in LENGTH symbols
    least = np.repeat(np.minimum.reduceat(owner[of], begin), np.diff(np.concatenate([begin, [len(prefix)]])))
    found = least < owner[of]
    return of[found], place[found]


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    if not len(starts):
        return starts, ends
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ends) - 1]])]


def hot_anchors(docs: DataFrame) -> list[int]:
    """Anchors that make up HOT of the pieces of one document in PROBE, 1 / HOT of them at most.

    They only choose between two ways to the same rows, so it doesn't matter which documents are looked at.
    """
    seen = written(piece_rows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBE)) == 0)).groupBy("anchor").agg(F.count("*").alias("n")), "repeats-probe")
    least = max(100, HOT * (seen.agg(F.sum("n").alias("n")).first()["n"] or 0))
    hot = [r["anchor"] for r in seen.where(F.col("n") >= least).select("anchor").collect()]
    dropped(seen)
    return hot


def shared_pieces(docs: DataFrame, hot: list[int]) -> DataFrame:
    """anchor, doc_id, start, size, at of the pieces that an earlier document has too (with its doc_id and place, f_doc and
    f_start) or whose anchor stands in a different piece as well.

    Pieces of an anchor are sorted beside each other. Those of a hot one are dealt over SALTS tasks, each of which keeps the
    first of equal pieces that it sees; these few are compared with each other later, like different pieces.
    """
    kind = id_type(docs)
    same, equal = Window.partitionBy("anchor"), Window.partitionBy("anchor", "piece")
    marked = piece_rows(docs, tuple(hot)).select("*", F.min(F.struct("doc_id", "place")).over(equal).alias("first"), F.min("piece").over(same).alias("p1"), F.max("piece").over(same).alias("p2"))
    later = F.when(F.col("doc_id") > F.col("first.doc_id"), F.col("first"))
    out = marked.where("doc_id > first.doc_id OR p1 <> p2 OR anchor % 2 <> 0").select("anchor", "doc_id", *unpacked(F.col("place")), later["doc_id"].cast(kind).alias("f_doc"), F.shiftright(later["place"], 14).alias("f_start"))
    return written(out, "repeats-shared")


def copied_runs(shared: DataFrame) -> DataFrame:
    """doc_id, start, size, f_doc, f_start: pieces that an earlier document has too, joined where both texts go on."""
    kind = id_type(shared)
    schema = f"doc_id {kind}, start long, size long, f_doc {kind}, f_start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i in range(b.num_rows):
                rows = b.column(1)[i].values
                start, size, doc, first = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                order = np.argsort(start, kind="stable")
                start, end, doc, first = start[order], (start + size)[order], doc[order], first[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] - first[1:] != start[:-1] - first[:-1]) | (start[1:] > end[:-1])])
                at = np.flatnonzero(new)
                parts.append((i, len(at), start[at], np.maximum.reduceat(end, at) - start[at], doc[at], first[at]))
            if parts:
                which = pa.array(np.repeat([p[0] for p in parts], [p[1] for p in parts]), pa.int64())
                columns = [np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), b.column(0).type, pa.int64()), strict=True))], ["doc_id", "start", "size", "f_doc", "f_start"])

    lists = shared.where("f_doc IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "f_doc", "f_start")).alias("at"))
    return lists.mapInArrow(run, schema)


def cut(docs: DataFrame, pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, pieces (anchor, left, right, start, at, body) and ranges (start, size, sha): what is asked of each text, in one pass over it.

    left and right are hashes of the anchor with the SIDE bytes before and after it, null where the piece has fewer there.
    """
    whole = lambda df, name, *columns: df.groupBy("doc_id").agg(F.collect_set(F.struct(*columns)).alias(name))
    asked = whole(pieces, "p", "anchor", "start", "size", "at").join(whole(ranges, "r", "start", "size"), "doc_id", "full")
    part = lambda b, start, size: F.substring(b, (start + 1).cast("int"), size.cast("int"))

    def piece(b, p):
        from_, width = p["start"] + p["at"], F.lit(GRAM + SIDE)
        left = F.when(p["at"] >= SIDE, F.xxhash64(F.lit(0), part(b, from_ - SIDE, width)))
        right = F.when(p["at"] + GRAM + SIDE <= p["size"], F.xxhash64(F.lit(1), part(b, from_, width)))
        return F.struct(p["anchor"].alias("anchor"), left.alias("left"), right.alias("right"), p["start"].alias("start"), p["at"].alias("at"), part(b, p["start"], p["size"]).alias("body"))

    both = lambda b: F.struct(F.transform("p", lambda p: piece(b, p)).alias("pieces"), F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["size"].alias("size"), F.sha2(part(b, r["start"], r["size"]), 256).alias("sha"))).alias("ranges"))
    return docs.join(asked, "doc_id").select("doc_id", F.get(F.transform(F.array(F.col("text").cast("binary")), both), F.lit(0)).alias("x")).select("doc_id", "x.pieces", "x.ranges")


def told_apart(pieces: DataFrame) -> DataFrame:
    """doc_id, start, end of strings that another piece of the same anchor and a smaller doc_id has; of groups with more than
    MOST bytes the pieces themselves, with body.

    pieces: anchor, left, right, doc_id, start, at, body. They are dealt by anchor, those of hot ones by left and by right. A
    task takes whole groups in turn until a part is full. Most pieces share neither left nor right with another document;
    the others are merged.
    """
    kind = id_type(pieces)

    def several(rows: pa.Table) -> pa.Table:
        """Rows whose left or right another document has too, with what of the body strings with it can reach: low and high."""
        doc = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)[1]
        found = {side: np.zeros(rows.num_rows, bool) for side in ("left", "right")}
        for side, out in found.items():
            column = rows.column(side)
            some = np.flatnonzero(column.is_valid().to_numpy())
            key = column.drop_null().to_numpy()
            order = np.argsort(key, kind="stable")
            if len(order):
                edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                who = doc[some][order]
                apart = np.minimum.reduceat(who, edges) < np.maximum.reduceat(who, edges)
                out[some[order[np.repeat(apart, np.diff(np.append(edges, len(order))))]]] = True
        at = rows.column("at").to_numpy().astype(np.int64)
        low = np.where(found["left"], 0, np.maximum(at - SIDE, 0))
        high = np.where(found["right"], 2 * LENGTH, at + GRAM + SIDE)
        rows = rows.select(["doc_id", "start", "body"]).append_column("low", pa.array(low)).append_column("high", pa.array(high))
        return rows.filter(pa.array(found["left"] | found["right"]))

    def batch(doc, start, end, body) -> pa.RecordBatch:
        body = pa.nulls(len(doc), pa.binary()) if body is None else body.combine_chunks().cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int64()), pa.array(end, pa.int64()), body], ["doc_id", "start", "end", "body"])

    def merged(rows: pa.Table) -> pa.RecordBatch:
        """Stretches of each document; equal bodies, as of lines that a document repeats, are merged once."""
        ids, start, low, high = (rows.column(k).to_numpy() for k in ("doc_id", "start", "low", "high"))
        owner, coded = np.unique(ids, return_inverse=True)[1], rows.column("body").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.unique(code, return_index=True)[1]
        bodies = [np.frombuffer(x.as_buffer(), np.uint8)[a:b] for x, a, b in zip(coded.dictionary, low[first].tolist(), high[first].tolist(), strict=True)]
        least = np.full(len(bodies), len(ids))
        np.minimum.at(least, code, owner)
        of, place = earlier(bodies, least)
        # of each row its body's places, or all of them where a smaller document has the same body
        whole = owner > least[code]
        order = np.argsort(of, kind="stable")
        from_, n = np.searchsorted(of[order], code), np.where(whole, [len(x) - LENGTH + 1 for x in map(bodies.__getitem__, code.tolist())], np.bincount(of, minlength=len(bodies))[code])
        row = np.repeat(np.arange(len(ids)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        places = np.append(place[order], 0)  # one more, so that rows with all their places may look beyond the last
        begin = (start + low)[row] + np.where(whole[row], k, places[np.minimum(from_[row] + k, len(places) - 1)])
        order = np.lexsort((begin, ids[row]))
        doc, begin = ids[row][order], begin[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + 1)])) if len(doc) else np.empty(0, int)
        return batch(doc[first], begin[first], begin[np.append(first[1:], len(doc))[: len(first)] - 1] + LENGTH, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, rest, over = [], None, None
        for b in batches:
            rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            over = over if over == key[0] else None
            whole, rest = rows.slice(0, last), rows.slice(last)
            if over is not None and last:  # what is left of a key that was too large
                end = int(np.searchsorted(key, over, "right"))
                yield batch(*(whole.column(k).to_numpy()[:end] for k in ("doc_id", "start", "start")), whole.column("body").slice(0, end))
                whole, over = whole.slice(end), None
            if whole.num_rows:
                ready.append(several(whole))
            if over is not None or rest.nbytes > MOST:
                over = key[-1]
                yield batch(*(rest.column(k).to_numpy() for k in ("doc_id", "start", "start")), rest.column("body"))
                rest = None
            if sum(x.nbytes for x in ready) > PART:
                yield merged(pa.concat_tables(ready))
                ready = []
        if rest is not None and rest.num_rows:
            ready.append(several(rest))
        if sum(x.num_rows for x in ready):
            yield merged(pa.concat_tables(ready))

    keys = F.when(F.col("anchor") % 2 != 0, F.array("left", "right")).otherwise(F.array("anchor"))
    rows = pieces.select(F.explode(keys).alias("key"), "left", "right", "doc_id", "start", "at", "body").where("key IS NOT NULL").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, body binary")


def compared_strings(pieces: DataFrame) -> DataFrame:
    """doc_id, start, end of the strings that a piece of a smaller doc_id has too, by grouping the strings themselves."""
    at = F.explode(F.sequence(F.lit(0), F.length("body") - LENGTH))
    strings = pieces.distinct().select("doc_id", "start", "body", at.alias("at")).select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.substring("body", F.col("at") + 1, F.lit(LENGTH)).alias("s"))
    least = strings.groupBy("s").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return strings.join(least.hint("merge"), "s").where("doc_id > least").select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: stretches whose strings of LENGTH bytes a document with a smaller doc_id has too."""
    some = docs.where("doc_id IS NOT NULL")
    hot = hot_anchors(some)
    shared = shared_pieces(some, hot)
    freed(docs.sparkSession)
    runs = written(copied_runs(shared), "repeats-runs")
    first = runs.select(F.col("f_doc").alias("doc_id"), F.col("f_start").alias("start"), "size")
    texts = written(cut(some, shared.where("f_doc IS NULL"), runs.select("doc_id", "start", "size").unionByName(first)), "repeats-texts")
    freed(docs.sparkSession)
    sha = texts.select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.*")
    there = sha.select(F.col("doc_id").alias("f_doc"), F.col("start").alias("f_start"), "size", F.col("sha").alias("f_sha"))
    judged = written(runs.join(sha.hint("merge"), ["doc_id", "start", "size"]).join(there.hint("merge"), ["f_doc", "f_start", "size"]).select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("sha") == F.col("f_sha")).alias("same")), "repeats-judged")
    pieces = texts.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
    clashing = judged.where("NOT same").select("doc_id", F.col("start").alias("from"), F.col("end").alias("to"))
    if not clashing.isEmpty():  # pieces of one hash that differ: all pieces of their anchors are told apart
        anchors = shared.where("f_doc IS NOT NULL").join(clashing, "doc_id").where("start >= from AND start + size <= to").select("anchor").distinct()
        again = piece_rows(some, tuple(hot)).join(anchors, "anchor", "left_semi").select("anchor", "doc_id", *unpacked(F.col("place")))
        pieces = pieces.unionByName(cut(some, again, runs.limit(0)).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*"))
    told = written(told_apart(pieces), "repeats-told")
    ranges = judged.where("same").drop("same").unionByName(told.where("body IS NULL").drop("body"))
    large = told.where("body IS NOT NULL").select("doc_id", "start", "body")
    if not large.isEmpty():
        ranges = ranges.unionByName(compared_strings(large))
    out = written(ranges, "repeats-ranges")
    for used in (shared, runs, texts, judged, told):
        dropped(used)
    freed(docs.sparkSession)
    return out


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (start and end of maximal removed runs, in bytes), rest (bytes kept).

    Null text counts as empty. A row without doc_id is neither cut nor a reason to cut. Rows repeated under one doc_id are
    taken to be the same document. Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeated_ranges(texts).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                spans, rest, sizes = [], [], []
                for i, body in enumerate(text_bytes(part.column(1))):
                    s, e = (np.array(part.column(k)[i].as_py() or [], np.int64) for k in (2, 3))
                    s, e = runs(s, e)
                    keep = np.ones(len(body), bool)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        keep[x:y] = False
                    sizes.append(len(body))
                    spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    rest.append(body[keep].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "spans", "rest"])

    rows = texts.join(ranges, "doc_id", "left").select("doc_id", "text", "starts", "ends")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, spans array<struct<start:long,end:long>>, rest binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))
