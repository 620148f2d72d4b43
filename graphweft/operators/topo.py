"""Cycles, layers and batches of a dependency graph (edges src depends on dst), by peeling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphweft.functions.lineage import cut, dropped


def counted(df: DataFrame, tag: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """df as a written table, and counts that were taken as it was written, without a job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, *(F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items())), tag)
    return out, seen.get


def squared(pointers: DataFrame) -> DataFrame:
    """pointers (src, dst), one a node, that go twice as far; those that end before are left out."""
    return pointers.select("src", F.col("dst").alias("mid")).join(pointers.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


def spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values (id, v) with the largest v that reaches each node along edges (src, dst).

    A round takes one step. From the fourth on, nodes also have shortcuts along one edge of theirs each, of twice as many
    steps in every round, so a long way takes about as many rounds as its length has binary digits; graphs in which all
    is near never pay for them.
    """
    ways, pointers, used, rounds, going, n_edges = edges.select("src", "dst"), edges, [], 0, True, edges.count()
    while True:
        came = values.join(ways, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max("v").alias("came"))
        joined = values.join(came, "id", "left").select("id", F.greatest("v", "came").alias("v"), (F.coalesce("came", "v") > F.col("v")).alias("new"))
        after, n = counted(joined, "colours", new=F.count_if("new"))
        dropped(values)
        values, rounds = after.select("id", "v"), rounds + 1
        if not n["new"]:
            for u in used:
                dropped(u)
            return values
        if rounds >= 3 and going:
            far = pointers if used else edges.groupBy("src").agg(F.max_by("dst", F.xxhash64("dst")).alias("dst"))
            pointers, n = counted(squared(far), "pointers", left=F.count("*"))
            used.append(pointers)
            going = n["left"] > 0 and 2 << len(used) <= n_edges
            ways = ways.unionByName(pointers)


def compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with each chain of nodes that have one edge in and one out made one edge; what lay inside, and rings of such nodes.

    Inside: id, s and e, the nodes before and behind the chain. Rings: id and comp, the least node of the ring. Chains are
    followed by pointers of doubled length, so a chain of n nodes takes about log n rounds.
    """
    one = lambda end: edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    chain = cut(one("src").join(one("dst"), "id"), "chain")
    mark = chain.select(F.col("id").alias("to"), F.lit(True).alias("on"))
    step = edges.join(chain.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("to")).join(mark, "to", "left")
    on = F.coalesce("on", F.lit(False))
    jump, n = counted(step.select("id", "to", F.when(on, F.col("to")).otherwise(F.col("id")).alias("tail"), on.alias("on"), F.least("id", "to").alias("low")), "jumps", on=F.count_if("on"), all=F.count("*"))
    rounds = 0
    while n["on"] and 1 << rounds <= n["all"]:
        further = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("tail").alias("tail2"), F.col("on").alias("on2"), F.col("low").alias("low2"))
        both = jump.where("on").join(further, "to").select("id", F.col("to2").alias("to"), F.col("tail2").alias("tail"), F.col("on2").alias("on"), F.least("low", "low2").alias("low"))
        last = jump
        jump, more = counted(jump.where("NOT on").unionByName(both), "jumps", on=F.count_if("on"))
        dropped(last)
        n, rounds = n | more, rounds + 1
    rings = jump.where("on").select("id", F.col("low").alias("comp"))
    ended = jump.where("NOT on")
    heads = edges.join(chain.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("src").alias("s"), F.col("dst").alias("id"))
    spans = heads.join(ended.select("id", "tail", F.col("to").alias("e")), "id").select("tail", "s", "e")
    inside = cut(ended.select("id", "tail").join(spans, "tail").select("id", "s", "e"), "inside")
    outer = edges.join(chain.withColumnRenamed("id", "src"), "src", "left_anti").join(chain.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return outer.select("src", "dst").unionByName(inside.select(F.col("s").alias("src"), F.col("e").alias("dst"))).distinct(), inside, cut(rings, "rings")


def core(edges: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, DataFrame]]]:
    """edges (written, no loops) without nodes that no edge enters or none leaves, until every node left has both.

    Each round takes off what is outermost. While that goes on, chains are made one edge every fourth round, so trees and
    chains take about log n rounds. Also gives, for each time, what lay inside chains, rings, and nodes with a loop then.
    """
    times, rounds, n = [], 0, {"n": edges.count()}
    while n["n"]:
        before = n["n"]
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        last = edges
        edges, n = counted(kept.select("src", "dst"), "core", n=F.count("*"))
        dropped(last)
        rounds += 1
        if n["n"] == before:
            break
        if rounds % 4 == 0 and n["n"]:
            shorter, inside, rings = compressed(edges)
            all_ = cut(shorter, "core")
            times.append((inside, rings, all_.where("src = dst").select(F.col("src").alias("id"))))
            edges, n = counted(all_.where("src <> dst"), "core", n=F.count("*"))
    return edges, times


def strong_components(edges: DataFrame) -> DataFrame:
    """id and comp of every node on a cycle, self-loops included: nodes of one comp reach each other.

    Nodes that no cycle can hold are trimmed, chains compressed. Then every node takes the largest id that reaches it as its
    colour; what reaches that node again within the colour is its strong component. The components found go, and the rest
    is done over. No pair of nodes that isn't an edge or a shortcut is ever held.
    """
    own = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    rest, times = core(cut(edges.where("src <> dst").select("src", "dst").distinct(), "core"))
    found = []
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("id")).distinct()
        colour = spread(cut(nodes.select("id", F.col("id").alias("v")), "colours"), rest)
        of = lambda k: colour.select(F.col("id").alias(k), F.col("v").alias(f"{k}_colour"))
        inside = cut(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src_colour").alias("comp")), "inside")
        back = spread(cut(colour.select("id", (F.col("id") == F.col("v")).cast("int").alias("v")), "colours"), inside)
        strong = back.where("v = 1").select("id")
        # a component of one node is on no cycle: only those with an edge inside are
        pairs = inside.join(strong.withColumnRenamed("id", "src"), "src", "left_semi").join(strong.withColumnRenamed("id", "dst"), "dst", "left_semi")
        found.append(cut(pairs.select(F.col("src").alias("id"), "comp").unionByName(pairs.select(F.col("dst").alias("id"), "comp")).distinct(), "cycles"))
        left = rest.join(strong.withColumnRenamed("id", "src"), "src", "left_anti").join(strong.withColumnRenamed("id", "dst"), "dst", "left_anti")
        last = rest
        rest, more = core(cut(left.select("src", "dst"), "core"))
        times += more
        for used in (last, inside, colour, back):
            dropped(used)
    none = own.limit(0).select("id", F.col("id").alias("comp"))
    comp = reduce(DataFrame.unionByName, found, none)
    for inside, rings, loops in reversed(times):
        known = comp.unionByName(rings)
        known = cut(known.unionByName(loops.select("id", F.col("id").alias("comp")).join(known, "id", "left_anti")), "cycles")
        end = lambda k: known.select(F.col("id").alias(k), F.col("comp").alias(f"{k}_comp"))  # noqa: B023, E731
        comp = known.unionByName(inside.join(end("s"), "s").join(end("e"), "e").where("s_comp = e_comp").select("id", F.col("s_comp").alias("comp")))
    return comp.unionByName(own.select("id", F.col("id").alias("comp")).join(comp, "id", "left_anti"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """id of every node on a cycle, self-loops included."""
    return strong_components(edges).select("id")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and level: 0 without dependencies, else one more than the highest one's. Nodes that a cycle holds up have none.

    Edges are written once with the number of dependencies of their source. Each round joins them with the level before
    and adds to what has been counted of the sources that are not done; only these and the next level are written.
    """
    ids = nodes.select("id").distinct()
    deps = edges.select("src", "dst").distinct().join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    need = deps.groupBy("src").agg(F.count("*").alias("need"))
    rest = cut(deps.join(need, "src").select("src", "dst", "need").repartition("dst"), "deps")
    ready = cut(ids.join(rest.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("level")), "level")
    out, counted, level = [ready], None, 0
    while True:
        level += 1
        came = rest.join(ready.select(F.col("id").alias("dst")), "dst").groupBy("src").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        both = came if counted is None else came.unionByName(counted).groupBy("src").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        state = cut(both, "counted")
        ready = state.where("n = need").select(F.col("src").alias("id"), F.lit(level).alias("level"))
        if ready.isEmpty():
            break
        out.append(ready)
        counted = state.where("n < need")
    return reduce(DataFrame.unionByName, out)


def batches(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """id, batch, can_run_in_parallel; what cycles hold up comes in one last batch that isn't parallel."""
    placed = cut(levels(tasks, edges).withColumnRenamed("level", "batch"), "batches")
    last = placed.agg(F.coalesce(F.max("batch") + 1, F.lit(0)).alias("batch"))
    stuck = tasks.select("id").distinct().join(placed, "id", "left_anti").join(F.broadcast(last)).select("id", "batch", F.lit(False).alias("can_run_in_parallel"))
    size = placed.groupBy("batch").agg((F.count("*") > 1).alias("can_run_in_parallel"))
    return placed.join(size, "batch").select("id", "batch", "can_run_in_parallel").unionByName(stuck)
