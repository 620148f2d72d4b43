"""Ranked lexical search over documents reordered by recursive graph bisection.

Documents that share rare terms are brought together: sets of documents are halved again and again, and documents change
sides while that makes the terms' places in the two halves cheaper to write down. The first halvings move documents by
Spark aggregations over their edges; sets that fit a task are halved there down to clusters. A cluster's row of the index
holds its postings and the largest score of each term, so the sum of these over an item's terms bounds every score in it.
Clusters are visited by falling bound, in rounds, until no bound reaches the last score that an item keeps: no document
that could enter is left out. Ties go back to doc_id, clusters whose bound equals that score are visited if they hold a
smaller one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import dropped, table, written

#: What a term is made of: ASCII digits and letters, and every sign beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes in a UTF-8 text: small letters for capitals, a blank for what is in no term.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bits of the map of hashed query terms that tasks sift a text's terms with; a fixed 1 MB.
BITS = 1 << 23
#: Documents in a cluster; documents that one task may halve; terms by which a document is placed; moves between two halves.
CLUSTER, GROUP, EDGES, MOVES = 256, 65_536, 12, 2
#: Items and their terms in a batch that goes through the index together; clusters that the first round visits per item.
ITEMS, PAIRS, FIRST, FASTER = 1024, 200_000, 8, 8
#: Pairs of an item and a cluster at most, of 4 bytes each, that are sent to every task; more are joined by shuffling.
SENT = 1 << 20


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each; rows of one item_id are one item."""
    return items.select("item_id", F.explode(F.array_distinct(terms_of(F.coalesce("text", F.lit(""))))).alias("term")).distinct()


def counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, doc_id, n (terms of the text) and the counts of those terms that may be wanted; a row number for each row.

    Tasks sift by a map of fixed size, whatever the number of terms wanted; the join that follows is exact.
    """
    places = wanted.select((F.crc32(F.col("term").cast("binary")) % BITS).alias("place")).distinct().toPandas()["place"].to_numpy(np.int64)
    bits = np.zeros(BITS, bool)
    bits[places] = True
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value

        def held(term: bytes) -> int:
            at = zlib.crc32(term) % BITS
            return seen[at >> 3] & (128 >> (at & 7))

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sizes, terms, times = [], [], []
                for body in part.column(1).to_pylist():
                    all_ = (body or b"").translate(SIGNS).split()
                    counts = [(t, c) for t, c in Counter(all_).items() if held(t)]
                    sizes.append(len(all_))
                    terms.append([t for t, _ in counts])
                    times.append([c for _, c in counts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {id_type}, n bigint, terms array<string>, times array<bigint>")
    return found.where("n > 0").withColumn("row", F.monotonically_increasing_id())


def postings(found: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row that has any wanted term: terms (as numbers), what each adds to a score, and edges; and the terms' numbers."""
    n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = found.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df")).join(wanted.select("term").distinct(), "term")
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1)))
    known = written(df.select("term", "df", weight.alias("w"), F.monotonically_increasing_id().alias("number")), "search-terms")
    mean = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {max(total, 1)}L")
    adds = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    rows = each.join(known, "term").withColumn("m", mean).withColumn("adds", adds)
    rows = rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "number", "adds"))).alias("t"))
    rare = F.filter("t", lambda t: (t["df"] > 1) & (t["df"] <= max(2, n_docs // 16)))
    edges = F.slice(F.transform(rare, lambda t: t["number"]), 1, EDGES)
    return written(rows.select("row", "doc_id", F.col("t.number").alias("terms"), F.col("t.adds").alias("adds"), edges.alias("edges")), "search-postings"), known.select("term", "number")


def moved(state: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """state (row, edges, part, side) after documents have changed sides where that makes the terms cheaper; and what it reads.

    A term with l and r documents in halves of a and b costs l * log(a / (l + 1)) + r * log(b / (r + 1)). Of those that
    gain by moving as many go either way, drawn by a hash, so halves stay even.
    """
    flat = state.select("row", "part", "side", F.explode_outer("edges").alias("term"))
    halves = state.groupBy("part").agg((F.sum(1 - F.col("side")) + 1).alias("a"), (F.sum("side") + 1).alias("b"))
    held = flat.where("term IS NOT NULL").groupBy("part", "term").agg(F.sum(1 - F.col("side")).alias("l"), F.sum("side").alias("r")).join(halves, "part")
    some = lambda x: F.greatest(x, F.lit(0))
    cost = lambda x, y: some(x) * F.log(F.col("a") / (some(x) + 1)) + some(y) * F.log(F.col("b") / (some(y) + 1))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    worth = held.select("part", "term", (cost(l, r) - cost(l - 1, r + 1)).alias("to_right"), (cost(l, r) - cost(l + 1, r - 1)).alias("to_left"))
    gain = F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("to_right")).otherwise(F.col("to_left"))), F.lit(0.0))
    gained = written(flat.join(worth, ["part", "term"], "left").groupBy("row", "part", "side").agg(F.collect_list("term").alias("edges"), gain.alias("gain")), "search-gains")
    wish = gained.where("gain > 0").groupBy("part").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    own = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))
    drawn = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 20)) < F.least("a", "b") / F.greatest(own, F.lit(1)) * (1 << 20)
    return gained.join(wish, "part", "left").select("row", "edges", "part", F.when((F.col("gain") > 0) & drawn, 1 - F.col("side")).otherwise(F.col("side")).alias("side")), gained


def coarse(rows: DataFrame, group: int) -> DataFrame:
    """row, edges and part: halved by Spark until a part has about `group` rows at most."""
    n, level, last = rows.count(), 0, None
    state = rows.select("row", "edges", F.lit(0).cast("long").alias("part"))
    while n > group << level:
        state = state.withColumn("side", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(2)))
        for k in range(MOVES):
            state, gained = moved(state, 1000 + level * MOVES + k)
            if last is not None:
                dropped(last)
            last = gained
        state = written(state.select("row", "edges", (F.col("part") * 2 + F.col("side")).alias("part")), "search-parts")
        dropped(last)
        level, last = level + 1, state
    return state


def bisected(edges: np.ndarray, cluster: int, rounds: int = 8) -> np.ndarray:
    """The cluster of each document; edges: its terms as numbers from 1, filled up with 0."""
    out, todo, n_terms = np.empty(len(edges), np.int64), [np.lexsort((np.arange(len(edges)), edges[:, 0] if edges.shape[1] else np.zeros(len(edges))))], int(edges.max(initial=0)) + 1
    number = 0
    while todo:
        docs = todo.pop()
        if len(docs) <= cluster:
            out[docs] = number
            number += 1
            continue
        half = len(docs) // 2
        left, right = docs[:half], docs[half:]
        a, b = len(left) + 1, len(right) + 1
        cost = lambda x, y: x * np.log(a / (x + 1)) + y * np.log(b / (y + 1))  # noqa: B023, E731
        for _ in range(rounds):
            l, r = (np.bincount(edges[s].ravel(), minlength=n_terms).astype(float) for s in (left, right))  # noqa: E741
            now = cost(l, r)
            to_right, to_left = now - cost(np.maximum(l - 1, 0), r + 1), now - cost(l + 1, np.maximum(r - 1, 0))
            to_right[0] = to_left[0] = 0
            gl, gr = to_right[edges[left]].sum(1), to_left[edges[right]].sum(1)
            ol, or_ = np.argsort(-gl, kind="stable"), np.argsort(-gr, kind="stable")
            k = min(half, len(right))
            swap = int(((gl[ol[:k]] + gr[or_[:k]]) > 1e-9).sum())
            if not swap:
                break
            x, y = left[ol[:swap]].copy(), right[or_[:swap]].copy()
            left[ol[:swap]], right[or_[:swap]] = y, x
        todo += [right, left]
    return out


def clustered(rows: DataFrame, cluster: int, group: int) -> DataFrame:
    """row and its cluster."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row", ignore_index=True)
        lengths = p["edges"].map(len).to_numpy()
        edges = np.zeros((len(p), EDGES), np.int64)
        if lengths.sum():
            _, numbers = np.unique(np.concatenate([x for x in p["edges"] if len(x)]), return_inverse=True)
            edges[np.arange(EDGES) < lengths[:, None]] = numbers + 1
        return pd.DataFrame({"row": p["row"], "cluster": (p["part"].iloc[0] << 32) + bisected(edges, cluster)})

    return coarse(rows, group).groupBy("part").applyInPandas(run, "row bigint, cluster bigint")


#: A cluster's row: its documents by rising doc_id (null last), per term the largest score and where its postings end.
INDEX = "cluster bigint, least bigint, docs array<bigint>, terms array<bigint>, tops array<bigint>, ends array<int>, places array<int>, adds array<bigint>"
LAST = np.iinfo(np.int64).max


def indexed(rows: DataFrame, cluster: int, group: int) -> DataFrame:
    """The clustered index over rows that postings() gave."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        docs = p["doc_id"].map(lambda d: LAST if pd.isna(d) else int(d)).to_numpy(np.int64)
        p, docs = p.iloc[np.argsort(docs, kind="stable")], np.sort(docs)
        terms, adds = np.concatenate(list(p["terms"])), np.concatenate(list(p["adds"]))
        places = np.repeat(np.arange(len(p)), p["terms"].map(len).to_numpy())
        order = np.lexsort((places, terms))
        terms, adds, places = terms[order], adds[order], places[order]
        names, starts = np.unique(terms, return_index=True)
        row = {"cluster": p["cluster"].iloc[0], "least": docs[0], "docs": docs, "terms": names, "tops": np.maximum.reduceat(adds, starts), "ends": np.append(starts[1:], len(terms)), "places": places, "adds": adds}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    placed = rows.join(written(clustered(rows.select("row", "edges"), cluster, group), "search-clusters"), "row")
    doc = F.col("doc_id").cast("string").alias("doc_id")  # as text, since pandas makes whole numbers with nulls into floats
    return written(placed.select("cluster", doc, "terms", "adds").groupBy("cluster").applyInPandas(run, INDEX), "search-index")


@dataclass(frozen=True)
class Batch:
    """Items that go through the index together: per item the numbers of its terms, and the worst place it keeps so far."""

    terms: list[np.ndarray]
    floor: list[tuple[int, int]]

    def bounds(self, index: DataFrame) -> DataFrame:
        """item (its place in the batch), cluster, least doc_id and the bound of scores there, where it is above 0."""
        names, flat = np.unique(np.concatenate(self.terms), return_inverse=True)
        starts = np.cumsum([0, *map(len, self.terms)])[:-1]
        shared = index.sparkSession.sparkContext.broadcast((names, flat, starts))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, flat, starts = shared.value
            for b in batches:
                for cluster, least, terms, tops in zip(b["cluster"], b["least"], b["terms"], b["tops"], strict=True):
                    at = np.searchsorted(names, terms).clip(max=len(names) - 1)
                    top = np.zeros(len(names), np.int64)
                    top[at[names[at] == terms]] = np.asarray(tops)[names[at] == terms]
                    sums = np.add.reduceat(top[flat], starts)
                    items = np.flatnonzero(sums)
                    yield pd.DataFrame({"item": items, "cluster": cluster, "least": least, "bound": sums[items]})

        return index.select("cluster", "least", "terms", "tops").mapInPandas(run, "item int, cluster bigint, least bigint, bound bigint")

    def scored(self, index: DataFrame, visits: DataFrame, most: int, k: int) -> DataFrame:
        """item, doc_id and score: of each cluster that an item visits the k best that come before what it keeps last.

        visits: item and cluster, `most` of them at most.
        """
        shared = index.sparkSession.sparkContext.broadcast((self.terms, self.floor))

        def best(row, wanted: np.ndarray, floor: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(row.terms, wanted).clip(max=len(row.terms) - 1)
            at = at[np.asarray(row.terms)[at] == wanted]
            starts = np.append(0, row.ends)
            own = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in at] or [np.empty(0, int)])
            # sums stay below 2^53, so they are whole numbers in doubles too
            score = np.bincount(np.asarray(row.places)[own], np.asarray(row.adds)[own], len(row.docs)).astype(np.int64)
            docs = np.asarray(row.docs)
            order = np.argsort(-score, kind="stable")[:k]
            order = order[(score[order] > 0) & ((score[order] > floor[0]) | (score[order] == floor[0]) & (docs[order] < floor[1]))]
            return docs[order], score[order]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            terms, floor = shared.value
            for b in batches:
                for row in b.itertuples(index=False):
                    found = [best(row, terms[item], floor[item]) for item in row.items]
                    sizes = [len(docs) for docs, _ in found]
                    yield pd.DataFrame({"item": np.repeat(np.asarray(row.items, np.int32), sizes), "doc_id": np.concatenate([x[0] for x in found]), "score": np.concatenate([x[1] for x in found])})

        asked = visits.groupBy("cluster").agg(F.collect_list("item").alias("items"))
        return index.join(F.broadcast(asked) if most <= SENT else asked, "cluster").select("docs", "terms", "ends", "places", "adds", "items").mapInPandas(run, "item int, doc_id bigint, score bigint")


def searched(index: DataFrame, terms: list[np.ndarray], k: int) -> DataFrame:
    """item, rank, doc_id and score: the k best documents of each item of a batch.

    Every round visits, for each item, the clusters of the highest bounds that are left, more of them in each round. It
    ends when no cluster is left whose bound is above what an item keeps last, or equal with a smaller doc_id in it.
    """
    spark = index.sparkSession
    bounds = written(Batch(terms, []).bounds(index), "search-bounds")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "cluster")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best, width = spark.createDataFrame([], "item int, rank int, doc_id bigint, score bigint"), FIRST
    # per item of the batch: the bound and cluster visited last, and the score and doc_id kept last
    state = {i: (LAST, -1, 0, -1) for i in range(len(terms))}
    while True:
        now = spark.createDataFrame([(i, *s) for i, s in state.items()], "item int, cut bigint, cut_cluster bigint, floor bigint, floor_doc bigint")
        left = bounds.join(F.broadcast(now), "item").where("(bound < cut OR bound = cut AND cluster > cut_cluster) AND (bound > floor OR bound = floor AND least < floor_doc)")
        visits = written(left.select("item", "cluster", "bound", F.row_number().over(by_bound).alias("at")).where(F.col("at") <= width), "search-visits")
        ends = visits.groupBy("item").agg(F.max_by(F.struct("bound", "cluster"), "at").alias("end")).collect()  # an entry an item of the batch
        if not ends:
            return best
        floor = [state[i][2:] for i in range(len(terms))]
        more = Batch(terms, floor).scored(index, visits, len(terms) * width, k)
        last, best = best, written(best.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "search-best")
        if width > FIRST:
            dropped(last)
        full = {r["item"]: (r["score"], r["doc_id"]) for r in best.where(F.col("rank") == k).collect()}
        dropped(visits)
        state = {r["item"]: (r["end"]["bound"], r["end"]["cluster"], *full.get(r["item"], (0, -1))) for r in ends}
        state |= {i: (-1, 0, 0, -1) for i in range(len(terms)) if i not in state}  # nothing is left for it
        width *= FASTER


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, cluster: int = CLUSTER, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the k documents of the highest scores above 0.

    Equal scores go by rising doc_id, null last. Null texts have no terms; rows repeated under one doc_id are documents of
    their own; rows repeated under one item_id are one item. Items without any term that a document holds give no row, nor
    do empty tables. Other columns are not read. Items go through the index in batches of bounded size.
    """
    spark = docs.sparkSession
    wanted = written(query_terms(items), "search-wanted")
    found = written(counted(docs.select("doc_id", "text"), wanted), "search-counts")
    rows, known = postings(found, wanted)
    dropped(found)
    asked = written(wanted.join(known, "term").groupBy("item_id").agg(F.array_sort(F.collect_list("number")).alias("terms")), "search-items")
    n_items, pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    batches = max(-(-n_items // ITEMS), -(-pairs // PAIRS))
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"item int, item_id {id_type}"
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    index = indexed(rows, cluster, group) if batches else None
    dropped(rows)
    for b in range(batches):
        batch = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).collect()
        if batch:
            best = searched(index, [np.array(r["terms"], np.int64) for r in batch], k)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], schema)
            out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    doc_type = docs.schema["doc_id"].dataType
    return out.select("item_id", "rank", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).cast(doc_type).alias("doc_id"), "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     sizes AS (SELECT doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
     whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
     tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
     dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
     items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     parts AS (SELECT item_id, doc_id, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT
                 * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // total)))) AS adds
               FROM items JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id) CROSS JOIN whole),
     scores AS (SELECT item_id, doc_id, sum(adds)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(adds) > 0),
     ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
