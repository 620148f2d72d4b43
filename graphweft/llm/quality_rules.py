"""Quality rules: fixed limits, and robust multivariate outliers among documents of one language and source.

Every document gets a vector of transformed statistics. Per (lang, source) a minimum-covariance-determinant estimate of
centre and scatter is found by concentration steps from a deterministic start, and a document far from its centre by
Mahalanobis distance is rejected. Only built-in expressions run: the statistics are one pass over the texts without a
shuffle, the estimates are sums per group over a narrow table, so a group of any size is pre-aggregated in every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import table, words, written

SYMBOLS = r"[#*$%&|<>]"
#: Words in a window that counts as repeated when the text has it twice.
WINDOW = 8
#: The transformed statistics, and for each the least standard deviation that an estimate may have. Most documents have
#: no symbol, repeated line or repeated window at all, so their own spread can be nil.
VECTOR = {"x_length": 0.05, "x_symbols": 0.06, "x_lines": 0.12, "x_repeats": 0.10, "x_capitals": 0.06}

#: Part of a group that its estimate is made from, the factor that makes up for the scatter which the nearest three
#: quarters of a normal sample in five dimensions lack, and the steps after the two that choose among the starts.
PART, CONSISTENT, STEPS = 0.75, 1.6, 6
#: The squared distance that a normal vector of five statistics passes once in ten thousand documents (chi-squared).
CUTOFF = 25.74
#: Groups whose estimates may be broadcast (some 15 MB), and tasks that a group is dealt over beyond that.
BROADCAST, SALTS = 50_000, 64


def base_statistics(text: Column) -> dict[str, Column]:
    """Counts of one text by array functions; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words(text),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, given the hash of each window by place.

    The windows are sorted by (hash, place), so the work is n log n however often one window occurs; the places of
    equal neighbours are put in order again and the union of their stretches is measured. Hashes have 64 bits: windows
    of one text are compared with each other only, so two different ones agree with odds below n * n / 2 ** 64.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        return F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))

    def stretch(places: Column) -> Column:
        parts = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  computed once
    full = bound(pairs, lambda s: bound(F.array_sort(F.transform(twice(s), lambda p: p["i"])), stretch))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(full).cast("long")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the transformed vector; `keep` names columns carried along."""
    df = docs.select("doc_id", "lang", "source", *keep, *(c.alias(k) for k, c in base_statistics(F.col("text")).items()))
    hashed = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    at = lambda i: [F.get("h", i + k) for k in range(WINDOW)]
    last = F.size("h") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(
        "doc_id", "lang", "source", *keep, "n_symbols", "n_dup_lines", "n_lines", "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        windows.alias("windows"),
    )
    counted = counted.withColumn("n_repeat_words", repeated_words(F.col("windows"))).drop("windows")
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return counted.select(
        "doc_id", "lang", "source", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.log((F.col("word_chars") + 500) / (F.col("n_words") + 100)).alias("x_length"),
        share("n_symbols", "word_chars").alias("x_symbols"),
        share("n_dup_lines", "n_lines").alias("x_lines"),
        share("n_repeat_words", "n_words").alias("x_repeats"),
        share("n_capitals", "word_chars").alias("x_capitals"),
    )


def whitening(moments: DataFrame, xs: list[str], scale: Column) -> DataFrame:
    """Per group the centre, the inverse Cholesky factor of its scatter and the logarithm of its determinant, from sums.

    The algebra is unrolled. The floors of VECTOR are added to the diagonal, so the scatter is never singular.
    """
    n = F.greatest(F.col("n"), F.lit(1))
    df = moments.select("g", *((F.col(f"s_{x}") / n).alias(f"m_{x}") for x in xs), *(F.col(f"q_{i}_{j}") for i in range(len(xs)) for j in range(i + 1)), n.alias("n"))
    for i, x in enumerate(xs):
        for j, y in enumerate(xs[: i + 1]):
            cov = F.greatest(F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}"), F.lit(0.0)) if i == j else F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}")
            value = scale * cov + (F.lit(VECTOR[x] ** 2) if i == j else F.lit(0.0))
            value = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), value)
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    det = reduce(lambda a, b: a + b, (2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(xs))))
    return df.select("g", *(f"m_{x}" for x in xs), *(f"l_{i}_{j}" for i in range(len(xs)) for j in range(i + 1)), det.alias("log_det"))


def distance(xs: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution; needs the columns of whitening() beside the vector."""
    solved: list[Column] = []
    for i, x in enumerate(xs):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * solved[k], range(i), F.col(x) - F.col(f"m_{x}"))
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, (z * z for z in solved))


def sums(rows: DataFrame, xs: list[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(xs)) for j in range(i + 1)]
    return rows.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in xs), *(F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"q_{i}_{j}") for i, j in pairs))


def nearest(placed: DataFrame, part: float) -> DataFrame:
    """Per group the distance within which at least `part` of its rows lie, from counts of narrow logarithmic bins."""
    binned = placed.groupBy("g", F.floor(F.log(F.col("d") + 1e-6) * 32).alias("bin")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("g").orderBy("bin")
    run = binned.select("g", "bin", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy("g")).alias("all"))
    return run.where(F.col("upto") >= F.ceil(part * F.col("all"))).groupBy("g").agg((F.exp((F.min("bin") + 1) / 32) - 1e-6).alias("reach"))


def beside(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows joined with the estimate of their group, of which there is one row each.

    Up to BROADCAST rows, some 300 bytes each, it is broadcast; a larger one is joined by salted keys, each group dealt
    over SALTS tasks, so a group with a third of all rows is spread either way.
    """
    if estimate.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(estimate), "g")
    salted = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), ["g", "salt"]).drop("salt")


def starts(rows: DataFrame, xs: list[str]) -> DataFrame:
    """Per group and start k a first centre and scatter: medians with the floors, medians with the statistics' own median
    deviations, and means with the classical scatter; g becomes the pair of both."""
    middle = written(rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in xs)), "quality-middle")
    spread = beside(rows, middle).groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"a_{x}") for x in xs))
    named = lambda k, df: df.withColumn("g", F.struct(F.col("g").alias("g"), F.lit(k).alias("k")))
    low = [(i, j) for i in range(len(xs)) for j in range(i + 1)]
    diagonal = lambda scale: [(scale(x) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in low for x in (xs[i],)]
    both = middle.join(spread, "g")
    floors = both.select("g", *(f"m_{x}" for x in xs), *diagonal(lambda x: F.lit(VECTOR[x])))
    own = both.select("g", *(f"m_{x}" for x in xs), *diagonal(lambda x: F.sqrt(F.pow(1.4826 * F.col(f"a_{x}"), F.lit(2.0)) + VECTOR[x] ** 2)))
    plain = whitening(sums(rows, xs), xs, F.lit(1.0)).drop("log_det")
    return named(0, floors).unionByName(named(1, own)).unionByName(named(2, plain))


def concentrated(rows: DataFrame, estimate: DataFrame, xs: list[str]) -> DataFrame:
    """The estimate from the PART of each group's rows that lie nearest by the last one; its determinant is no larger."""
    placed = beside(rows, estimate).withColumn("d", distance(xs)).select("g", *xs, "d")
    near = beside(placed, written(nearest(placed, PART), "quality-reach")).where(F.col("d") <= F.col("reach"))
    return written(whitening(sums(near, xs), xs, F.lit(CONSISTENT)), "quality-estimate")


def robust_distances(rows: DataFrame) -> DataFrame:
    """rows (g and the vector) with column d, the squared robust distance.

    From three starts two concentration steps are made for all groups at once; of each group the one with the least
    determinant goes on until no determinant falls by one part in a hundred, or for STEPS steps.
    """
    xs = list(VECTOR)
    narrow = written(rows.select("g", *xs), "quality-vectors")
    many = narrow.withColumn("g", F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.struct(F.col("g").alias("g"), k.alias("k")))))
    estimate = starts(narrow, xs)
    for _ in range(2):
        estimate = concentrated(many, estimate, xs)
    rest = [c for c in estimate.columns if c != "g"]
    least = estimate.select(F.col("g.g").alias("g"), F.struct("log_det", F.col("g.k").alias("k"), *(F.col(c).alias(c) for c in rest if c != "log_det")).alias("e"))
    estimate = written(least.groupBy("g").agg(F.min("e").alias("e")).select("g", *(F.col(f"e.{c}").alias(c) for c in rest)), "quality-least")
    for _ in range(STEPS):
        last, estimate = estimate, concentrated(narrow, estimate, xs)
        fall = last.select("g", F.col("log_det").alias("was")).join(estimate.select("g", "log_det"), "g")
        if fall.where(F.col("log_det") < F.col("was") - 0.01).isEmpty():
            break
    return beside(rows, estimate).withColumn("d", distance(xs)).select(*rows.columns, "d")


def quality_rules(docs: DataFrame, keep: tuple[str, ...] = (), cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: the counts, base_failed, distance and kept.

    `cutoff` bounds the squared distance. Rows that fail the base rules neither shape the estimates nor get a distance.
    Null lang and source form groups of their own; a group too small for an estimate is held to the floors alone. A null
    or empty text fails the base rules; repeated rows are judged alike.
    """
    stats = written(statistics(docs, keep), "quality-statistics")
    rows = stats.withColumn("g", F.struct("lang", "source"))
    judged = robust_distances(rows.where(~F.col("base_failed")))
    failed = rows.where("base_failed").withColumn("d", F.lit(None).cast("double"))
    return judged.unionByName(failed).select(
        *stats.columns[: stats.columns.index("x_length")], F.col("d").alias("distance"), (~F.col("base_failed") & (F.col("d") <= cutoff)).alias("kept")
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"), "distance")
