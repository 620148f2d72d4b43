"""Secrets in texts: three fixed patterns, and strings that pass a battery of randomness tests.

Everything is an array expression over one row, so the texts are read once and never shuffled; only the p-values of
candidate strings are counted per stratum, in bins of a fixed number. False-discovery control bounds the share of reported
strings that are not random, per encoding and length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.llm.common import once, table, written

#: The kinds in the order in which they are listed. The hex and access patterns take whole runs, so their
#: least lengths can stand in the pattern; that of assign is checked afterwards, as a short match uses up its characters.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs with the signs of padding that end them; any other = parts two runs. A candidate has `LEAST` characters with them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}+(?:=++(?![A-Za-z0-9+/_-]))?"
LEAST = 20
#: Parts of a run that no alphabet covers: without signs of plain base64, without those of its URL-safe form, without both.
URL_SAFE, PLAIN, BARE = (rf"[A-Za-z0-9{signs}]{{14,}}+=*+" for signs in ("_-", "+/", ""))
#: A folder's name in a run, which a random string has with odds of about one in a thousand.
FOLDER = r"(^|/)[A-Za-z]?[a-z]{2,}/"
FOLDERS = r"^/?([A-Za-z]?[a-z]{2,}/)+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Five classes of signs an alphabet, by how common letters are in written words, whose letters are far from
#: uniform over them. The chi-squared test has four degrees of freedom then, and its probability a closed form.
CLASSES = {
    "hex": ("0123", "456", "789", "ace", "bdf"),
    "base32": ("ETAOINSR", "HLDCUMPGF", "WYBVK", "JXQZ", "234567"),
    "base36": ("etaoinsr", "hldcumpgf", "wybvkjxqz", "01234", "56789"),
    "base64": ("etaoinsr", "hldcumpgf", "wybvkjxqz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/"),
}
#: p-values fall in bins of 1/20 on the scale of -ln p, the last one open. Bins below HALF hold p-values above about one
#: half; those from MISSED on, p-values below 0.02, are never reported, which misses one random string of fifty.
BINS, PER_UNIT, HALF, MISSED = 800, 20, 14, 78


def starts(pieces: Column, found: Column) -> Column:
    """Where each match begins: the lengths of all pieces and matches before it.

    Sums up to every 64th match are taken first, then those of the few in between, so a text with very many matches costs
    little more than one pass for each 64 of them.
    """
    lengths = F.zip_with(pieces, found, lambda p, m: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
    total = lambda part: F.aggregate(part, F.lit(0), lambda u, x: u + x)

    def placed(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 64).cast("int")), lambda k: total(F.slice(n, F.lit(1), k * 64)))
        inner = lambda u, i: F.get(u, F.floor(i / 64).cast("int")) + total(F.slice(n, F.floor(i / 64).cast("int") * 64 + 1, i % 64)) + F.length(F.get(pieces, i))
        return once(sums, lambda u: F.transform(found, lambda m, i: inner(u, i)))

    return once(lengths, placed)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as structs start, kind, end, part; code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so their lengths give the places.
    """

    def placed(s: Column) -> Column:
        one = lambda m, at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(m)).alias("end"), m.alias("part"))
        return F.zip_with(s["f"], starts(s["p"], s["f"]), one)

    some = once(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("p")), placed)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,part:string>>")
    return F.when(text.rlike(pattern), some).otherwise(none)


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda m: F.length(F.regexp_extract(m["part"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def encoding(part: Column) -> Column:
    """The narrowest encoding whose alphabet covers the string and of whose kinds of characters it has some; else null.

    Hex may be parted by dashes; hex, base32 and base36 come in capitals or small letters, but not in both.
    """
    bare = F.rtrim(part, F.lit("="))
    has = lambda p: bare.rlike(p)
    mixed = has("[0-9]") & has("[A-Za-z]")
    return (
        F.when(mixed & has("^([0-9a-f]+(-[0-9a-f]+)*|[0-9A-F]+(-[0-9A-F]+)*)$"), "hex")
        .when(mixed & has("^([A-Z2-7]+|[a-z2-7]+)$"), "base32")
        .when(mixed & has("^([A-Z0-9]+|[a-z0-9]+)$"), "base36")
        .when(mixed & has("[a-z]") & has("[A-Z]") & has("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$"), "base64")
    )


def pieces(run: Column) -> Column:
    """The candidates of one run, with their encodings: the run itself, or parts of it between signs of other alphabets.

    A run that no alphabet covers, or that has a folder's name in it, is cut at / and + into URL-safe strings and at
    - and _ into plain ones without folders before them (these first if it has a +), then at all four; a later cut adds what no earlier one has taken.
    """
    named = lambda found: F.filter(F.transform(F.filter(found, lambda m: F.length(m["part"]) >= LEAST), lambda m: m.withField("encoding", encoding(m["part"]))), lambda m: m["encoding"].isNotNull())

    def parts(pattern: str) -> Column:
        bare = lambda m: F.regexp_replace(m["part"], FOLDERS, "")
        moved = lambda m: F.struct((m["end"] - F.length(bare(m)) + run["start"]).alias("start"), m["kind"].alias("kind"), (m["end"] + run["start"]).alias("end"), bare(m).alias("part"))
        return named(F.transform(matches(run["part"], pattern, "random"), moved))

    def more(taken: Column, others: Column) -> Column:
        return once(taken, lambda t: F.concat(t, F.filter(others, lambda m: ~F.exists(t, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))))

    plus = F.contains(run["part"], F.lit("+"))
    ordered = lambda s: F.when(plus, F.struct(s["p"].alias("a"), s["u"].alias("b"))).otherwise(F.struct(s["u"].alias("a"), s["p"].alias("b")))
    split = once(once(F.struct(parts(URL_SAFE).alias("u"), parts(PLAIN).alias("p")), ordered), lambda s: more(s["a"], s["b"]))
    whole = once(encoding(run["part"]), lambda e: F.when(e.isNotNull() & ~run["part"].rlike(FOLDER), F.array(run.withField("encoding", e))).otherwise(more(split, parts(BARE))))
    return F.filter(whole, lambda m: F.length(m["part"]) >= LEAST)


def two_sided(z: Column) -> Column:
    """Probability that a normal deviate exceeds |z| in size; a polynomial of absolute error below 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = reduce(lambda a, c: (a + c) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-15))


def random_p(part: Column, kind: Column) -> Column:
    """Fisher's combination of the battery for one string: uniform on 0 to 1 if it is a uniform draw from its alphabet.

    Chi-squared over the alphabet's classes against their shares, runs above and below the alphabet's middle, and serial
    correlation of neighbours less what the runs say of it already, so the three are independent but for rounding.
    """
    bare = F.rtrim(part, F.lit("="))
    bare = F.when(kind == "hex", F.lower(F.translate(bare, "-", ""))).when(kind == "base32", F.upper(bare)).when(kind == "base36", F.lower(bare)).otherwise(F.translate(bare, "_-", "/+"))
    by_kind = lambda value: reduce(lambda a, k: a.when(kind == k, value(k)), list(ALPHABETS)[1:], F.when(kind == "hex", value("hex")))
    alphabet = by_kind(lambda k: F.lit(ALPHABETS[k]))

    def in_class(bare: Column, c: int) -> tuple[Column, Column]:
        """How many signs of the string are in class c of its alphabet, and how many would be."""
        signs = by_kind(lambda k: F.lit(CLASSES[k][c]))
        share = by_kind(lambda k: F.lit(len(CLASSES[k][c]) / len(ALPHABETS[k])))
        return F.length(bare) - F.length(F.call_function("translate", bare, signs, F.lit(""))), share * F.length(bare)

    def tests(s: Column) -> Column:
        xs, a = s["xs"], s["a"].cast("double")
        n = F.size(xs).cast("double")
        chi = reduce(lambda u, v: u + v, ((seen - due) * (seen - due) / due for seen, due in (in_class(s["bare"], c) for c in range(5))))
        p_chi = F.exp(-chi / 2) * (1 + chi / 2)
        nexts = F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))
        both = F.zip_with(F.slice(xs, F.lit(1), F.size(nexts)), nexts, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        changes = F.size(F.filter(both, lambda t: (t["x"] * 2 < a) != (t["y"] * 2 < a)))
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (a - 1) / 2
        product = F.aggregate(both, F.lit(0.0), lambda u, t: u + (t["x"] - middle) * (t["y"] - middle))
        z_serial = product / ((a * a - 1) / 12 * F.sqrt(n - 1))
        rho = 0.75 * a * a / (a * a - 1)  # how far neighbours on one side of the middle make up the correlation
        z_rest = (z_serial + rho * z_runs) / F.sqrt(1 - rho * rho)
        half = -(F.log(F.greatest(p_chi, F.lit(1e-300))) + F.log(two_sided(z_runs)) + F.log(two_sided(z_rest)))
        return F.exp(-half) * (1 + half + half * half / 2)

    def values(bare: Column) -> Column:
        chars = F.filter(F.split(bare, ""), lambda c: c != "")
        return F.struct(bare.alias("bare"), F.transform(chars, lambda c: F.instr(alphabet, c) - 1).alias("xs"), F.length(alphabet).alias("a"))

    return once(once(bare, values), tests)


def candidates(text: Column, base: Column) -> Column:
    """Strings of 20 or more characters in a recognised encoding that touch no base span, with stratum and bin."""
    known = F.filter(F.flatten(F.transform(matches(text, CANDIDATE, "random"), pieces)), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    def scored(m: Column) -> Column:
        depth = F.least(F.floor(-F.log(F.greatest(random_p(m["part"], m["encoding"]), F.lit(1e-30))) * PER_UNIT), F.lit(BINS))
        band = F.least(F.floor(F.log2(F.length(m["part"]).cast("double")) * 2), F.lit(40))
        return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.concat_ws(":", m["encoding"], band.cast("string")).alias("stratum"), F.greatest(depth, F.lit(0)).cast("int").alias("bin"))

    return F.transform(known, scored)


def cutoffs(found: DataFrame, rate: float) -> dict[str, int]:
    """Per stratum of encoding and length band the first bin that is not reported, so that about `rate` of the reported
    strings at most are no random ones.

    p-values of random strings are uniform, those of others lie near 0, so the strings above one half tell how many random
    ones each further bin holds; what it holds beyond is false. The lowest p-value is taken at which the false ones are
    `rate` of those reported, or no more than chance adds to as many random strings. Strata are narrow in length, as a
    short string is told from a random one with less power. At most 4 * 41 entries come to the driver, whatever the input.
    """
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n")).where(F.col("bin") < MISSED)
    up = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum(F.when(F.col("bin") < HALF, F.col("n")).otherwise(0)).over(Window.partitionBy("stratum"))
    upto = counts.select("stratum", "bin", F.sum("n").over(up).alias("reported"), high.alias("high"))
    random = F.col("high") * (1 - F.exp(-(F.col("bin") + 1) / PER_UNIT)) / (1 - F.exp(F.lit(-HALF / PER_UNIT)))
    held = upto.where(F.col("reported") - random <= rate * F.col("reported") + 2 * F.sqrt("reported"))
    return {r["stratum"]: r["bin"] + 1 for r in held.groupBy("stratum").agg(F.max("bin").alias("bin")).collect()}


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, base spans, and all spans with the strings that the battery takes for random, about `rate` of them falsely.

    Null text counts as empty, so it has no span. Repeated rows are scanned alike; other columns are not read. Spans are
    sorted by start, then kind. With no candidate at all, base spans alone are returned.
    """
    text = F.coalesce("text", F.lit(""))
    based = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = written(based.select("doc_id", F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"])).alias("base"), candidates(F.col("text"), F.col("base")).alias("candidates")), "secret-candidates")
    limit = cutoffs(found, rate)
    below = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in limit.items() for x in kv))[c["stratum"]] if limit else F.lit(None), F.lit(0))
    kept = F.transform(F.filter("candidates", lambda c: c["bin"] < below(c)), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", kept)).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
