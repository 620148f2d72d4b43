"""A Merkle manifest of a dataset, and proofs by coordinate lookup.

Rows are leaves of one tree per source, the trees' roots are leaves of one more tree. Nodes are kept as runs: one row per
coordinate (tree, level, run) with the digests of up to 16 consecutive nodes. A proof needs no walk through the tree: from
a leaf's index and the size of a run the coordinates on its way to the root are arithmetic. They are exploded, joined with
the table of runs, put in order, concatenated and folded. Leaves of one run need the same runs above them, so they ask
once together. A run that many leaves ask for stands in the table once for each block of 4,096 leaves below it, so no key
of a join has more than 256 askers, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import table, written

#: Children of a node; levels that a tree of 64-bit many leaves can have; runs of leaves in a block, as a power of ARITY.
ARITY, LEVELS, BLOCK = 16, 15, 2
#: The tree whose leaves are the roots of all others.
TOP = -1
PATH = "array<struct<position:int,digests:array<string>>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def fields_digest(values: list[Column]) -> Column:
    """SHA-256 of all fields: `-` for null, else the UTF-8 byte count, a colon and the value as text."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*(one(c) for c in values)), 256)


def digest_of(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def placed(rows: DataFrame, tree: str, order: list[str], tag: str) -> DataFrame:
    """rows with `place`, counted from 0 within a tree in the given order, nulls first.

    Rows are dealt by ranges of tree and order, so a large tree lies in many parts; a part's rows before it come from the
    counts of the parts.
    """
    dealt = written(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("part", F.spark_partition_id()), tag)
    before = F.sum("n_part").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy(tree, "part").agg(F.count("*").alias("n_part")).select(tree, "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order))
    return dealt.join(offsets, [tree, "part"]).withColumn("place", within - 1 + F.col("before")).drop("part", "before")


def grown(nodes: DataFrame, most: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """The runs above level 0 (tree, level, run, digests) and the roots (tree, digest) of trees whose runs of leaves are nodes.

    nodes: tree, place, digest, n for each run of leaves, or the lone leaf of a tree of one; n says how many of them the
    tree has, `most` how many the largest has. Each round makes one level of all trees, a sixteenth of the one below.
    """
    runs, roots, level = [], [], 1
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        if most <= 1:
            break
        members = F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"]
        run = (F.col("place") / ARITY).cast("long")
        made = written(nodes.where("n > 1").groupBy("tree", run.alias("run"), F.ceil(F.col("n") / ARITY).alias("n")).agg(members.alias("digests")), f"{tag}-runs")
        runs.append(made.select("tree", F.lit(level).alias("level"), "run", "digests"))
        nodes = made.select("tree", F.col("run").alias("place"), digest_of(F.col("digests")).alias("digest"), "n")
        most, level = -(-most // ARITY), level + 1
    empty = nodes.limit(0).select("tree", F.lit(0).alias("level"), F.col("place").alias("run"), F.array("digest").alias("digests"))
    return reduce(DataFrame.unionAll, runs, empty), reduce(DataFrame.unionAll, roots)


@dataclass(frozen=True)
class Forest:
    """Trees over leaves: `units` has one row per run of leaves (tree, run, n, members), `runs` those above, `roots` a root per tree."""

    units: DataFrame
    runs: DataFrame
    roots: DataFrame

    @staticmethod
    def over(leaves: DataFrame, tag: str) -> Forest:
        """leaves: tree, place, n (the leaves of its tree), digest; other columns travel with their leaf."""
        kept = [c for c in leaves.columns if c not in ("tree", "n")]
        run = (F.col("place") / ARITY).cast("long")
        units = written(leaves.groupBy("tree", run.alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct(*sorted(kept, key=lambda c: c != "place")))).alias("members")), f"{tag}-units")
        first = F.when(F.col("n") > 1, digest_of(F.col("members")["digest"])).otherwise(F.col("members")[0]["digest"])
        nodes = units.select("tree", F.col("run").alias("place"), first.alias("digest"), F.ceil(F.col("n") / ARITY).alias("n"))
        most = units.agg(F.max(F.ceil(F.col("n") / ARITY))).first()[0] or 0
        runs, roots = grown(nodes, most, tag)
        return Forest(units, runs, written(roots, f"{tag}-roots"))

    def looked_up(self) -> DataFrame:
        """units with `above`, an array of (position, digests): the runs that lie between each and its root."""
        power = lambda k: F.pow(F.lit(float(ARITY)), k).cast("long")
        # coordinates of a run of leaves: at each level that has more than one node, the run it lies in, and where
        levels = F.filter(F.sequence(F.lit(1), F.lit(LEVELS - 1)), lambda k: F.col("n") > power(k))
        coordinates = self.units.select("tree", F.col("run").alias("unit"), F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), (F.col("run") / power(k)).cast("long").alias("run"), ((F.col("run") / power(k - 1)).cast("long") % ARITY).cast("int").alias("position")))).alias("at")).select("tree", "unit", "at.*")
        askers = coordinates.withColumn("block", (F.col("unit") / power(F.lit(BLOCK))).cast("long"))
        first = (F.col("run") * power(F.col("level")) / power(F.lit(BLOCK))).cast("long")
        sizes = self.units.groupBy("tree").agg(((F.max("run") / power(F.lit(BLOCK))).cast("long")).alias("last_block"))
        last = F.least(F.col("last_block"), first + F.greatest(power(F.col("level") - BLOCK), F.lit(1)) - 1)
        table_ = self.runs.join(sizes, "tree").withColumn("block", F.explode(F.sequence(first, last))).select("tree", "level", "run", "block", "digests")
        found = askers.join(table_, ["tree", "level", "run", "block"]).groupBy("tree", F.col("unit").alias("run")).agg(F.array_sort(F.collect_list(F.struct("level", "position", "digests"))).alias("above"))
        above = F.coalesce(F.transform("above", lambda s: F.struct(s["position"], s["digests"])).cast(PATH), F.array().cast(PATH))
        return self.units.join(found, ["tree", "run"], "left").select("tree", "run", "n", "members", above.alias("above"))


def leaf_paths(units: DataFrame) -> DataFrame:
    """A row per leaf of units that looked_up() gave: what its unit has, its own columns and `path`, from its own run to the root."""
    leaves = units.withColumn("own", F.col("members")["digest"]).withColumn("leaf", F.explode("members")).drop("members")
    own = F.when(F.col("n") > 1, F.array(F.struct(F.col("leaf.place") % ARITY, "own")).cast(PATH)).otherwise(F.array().cast(PATH))
    return leaves.select(*(c for c in units.columns if c not in ("members", "above", "n")), "leaf.*", F.concat(own, "above").alias("path"))


def siblings(path: Column) -> Column:
    """The digests beside a leaf and its ancestors, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: F.concat(F.slice(s["digests"], F.lit(1), s["position"]), F.slice(s["digests"], s["position"] + 2, F.lit(ARITY)))))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    beside = lambda s, at, n: F.array_join(F.slice(s["digests"], at, n), "")
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(beside(s, F.lit(1), s["position"]), d, beside(s, s["position"] + 2, F.lit(ARITY))), 256))


def merkle_manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof (siblings as `path` gives them), folded_root, verified.

    Leaves cover FIELDS, null as `-`. A source's leaves ascend by doc_id, nulls first; rows of one doc_id by their digest,
    so equal rows are interchangeable. A null source is a source of its own and comes first. A lone leaf is its own
    subroot, a lone subroot the root. `altered` gives the text that a copy under test has; what a proof folds to is
    compared with the root. No row gives no row; columns besides FIELDS are not read.
    """
    text = F.col("text")
    digest = lambda t: fields_digest([F.col(c) for c in FIELDS[:-1]] + [t])
    leaves = written(docs.select("doc_id", "source", digest(text).alias("digest"), digest(text if altered is None else altered).alias("tested")), "merkle-leaves")
    sources = leaves.groupBy("source").agg(F.count("*").alias("n")).withColumn("tree", F.lit(TOP).cast("long"))
    sources = written(placed(sources, "tree", ["source"], "merkle-sources").select("source", F.col("n").alias("leaves"), "place"), "merkle-sources")
    numbered = leaves.join(sources, leaves["source"].eqNullSafe(sources["source"])).select(F.col("place").cast("long").alias("tree"), F.col("leaves").alias("n"), "doc_id", "digest", "tested")
    forest = Forest.over(placed(numbered, "tree", ["doc_id", "digest", "tested"], "merkle-places"), "merkle")

    n_trees = sources.count()
    subroots = forest.roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("place"), "digest")
    top = Forest.over(subroots, "merkle-top")
    blocks = F.sequence(F.lit(0).cast("long"), ((F.col("leaves") - 1) / ARITY ** (BLOCK + 1)).cast("long"))
    upper = leaf_paths(top.looked_up()).select("tree", F.col("place").alias("source"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    upper = upper.join(top.roots.select("tree", F.col("digest").alias("root")), "tree").drop("tree").withColumnRenamed("source", "tree")
    upper = written(upper.join(sources.select(F.col("place").cast("long").alias("tree"), "leaves"), "tree").withColumn("block", F.explode(blocks)).drop("leaves"), "merkle-upper")
    block = (F.col("run") / ARITY**BLOCK).cast("long")
    rows = leaf_paths(forest.looked_up().withColumn("block", block).join(upper, ["tree", "block"]))
    whole = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "tested", F.concat("path", "upper").alias("path"))
    proved = whole.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof"), folded(F.col("tested"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_manifest(table(spark, sf_dir, "documents"), F.when(tampered, lowered).otherwise(F.col("text")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE
crc AS (SELECT doc_id, xor(list_reduce([ord(x) FOR x IN string_split(doc_id::VARCHAR, '')],
          lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b::BIGINT)),
          4294967295::BIGINT), 4294967295) AS crc FROM documents),
head AS (SELECT doc_id, source, text, crc,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
         FROM documents JOIN crc USING (doc_id)),
leaves AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
             sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
             sha256(head || CASE WHEN text IS NULL THEN '-' WHEN crc % 5 = 0 THEN strlen(lowered) || ':' || lowered ELSE strlen(text) || ':' || text END) AS tested
           FROM head),
nodes AS (SELECT 0 AS level, tree, i, leaf AS digest FROM leaves
          UNION ALL SELECT level + 1, tree, i // 16, sha256(string_agg(digest, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS left_ FROM nodes) WHERE left_ > 1 GROUP BY level, tree, i // 16),
subroots AS (SELECT tree, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree),
tops AS (SELECT 0 AS level, tree AS i, subroot AS digest FROM subroots
         UNION ALL SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i))
         FROM (SELECT *, count(*) OVER () AS left_ FROM tops) WHERE left_ > 1 GROUP BY level, i // 16),
root AS (SELECT arg_max(digest, level) AS root FROM tops),
runs AS (SELECT level, tree, i // 16 AS run, list(digest ORDER BY i) AS digests FROM nodes GROUP BY ALL
         UNION ALL SELECT level, -1, i // 16, list(digest ORDER BY i) FROM tops GROUP BY ALL),
asked AS (SELECT doc_id, l AS step, l AS level, tree, (i >> (4 * l)) // 16 AS run, (i >> (4 * l)) % 16 AS position FROM leaves, range(14) r(l) WHERE n > 1::BIGINT << (4 * l)
          UNION ALL SELECT doc_id, 100 + l, l, -1, (tree >> (4 * l)) // 16, (tree >> (4 * l)) % 16 FROM leaves, range(14) r(l) WHERE (SELECT count(*) FROM subroots) > 1::BIGINT << (4 * l)),
steps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step, array_to_string(digests[1:position], '') AS before, array_to_string(digests[position + 2:], '') AS after
          FROM asked JOIN runs USING (level, tree, run)),
fold AS (SELECT doc_id, 0::BIGINT AS step, tested AS digest FROM leaves
         UNION ALL SELECT f.doc_id, s.step, sha256(s.before || f.digest || s.after) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) CROSS JOIN root JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""
