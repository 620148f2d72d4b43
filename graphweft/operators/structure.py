"""Classes, their members and the calls between methods, from the nesting of brackets in source files (path, content).

A file's text is cut into words, strings, comments and brackets by one pattern, so brackets in strings, templates, comments
and regular expressions do not count. How deep a token lies is a running sum over a file's tokens; a class is the stretch
of tokens between its head and the bracket that brings the sum back, a member the stretch between two ends one level in.
A file's tokens stay in its row as an array, and go from there into the rows of members whose stretch holds them; tokens
are never rows that are sorted or shuffled. Files are dealt by path once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A quoted string; what a template's ${} holds; a template; a regular expression, told by what stands before it.
SINGLE, DOUBLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'", r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
HOLE = rf"(?:[^{{}}`'\"]++|{SINGLE}|{DOUBLE}|`[^`]*+`|\{{[^{{}}]*+\}})*+"
TEMPLATE = rf"`[^`\\$]*+(?:(?:\\[\s\S]|\$\{{{HOLE}\}}|\$)[^`\\$]*+)*+`"
REGEX = r"(?<=(?:[(,=:\[!&|?{};+*%~^<>-]|\breturn)\s{0,8})/(?![/*])[^/\\\n\[]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/[a-z]*+"
COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*+"
#: Type arguments before a parameter list, up to three levels of them.
IN_TYPE = r"(?:[^<>(){};=&|]|\|(?!\|))*+"
TYPES = rf"<{IN_TYPE}(?:<{IN_TYPE}(?:<{IN_TYPE}>{IN_TYPE})*+>{IN_TYPE})*+>(?=\s*+\()"
TOKEN = rf"\A\s++|(?:{COMMENT}|{SINGLE}|{DOUBLE}|{TEMPLATE}|{REGEX}|{TYPES}|[\w$#]++|=>|\?\.(?!\d)|\S)\s*+"
NAME = r"^[A-Za-z_$][\w$]*$"
#: Fixed value: what a line break counts where line breaks and brackets are added up in one number.
ABOVE = 1 << 32
#: What may stand between a class's decorators and its keyword, and before a member's name.
HEAD, MODIFIERS = ("export", "default", "abstract", "declare"), "public|private|protected|static|readonly|async|abstract|override|declare|accessor"
#: A member's tokens one level inside its class, parted by blanks: decorators, modifiers, name, mark, and what follows.
MEMBER = rf"^((?:@ [\w$]+(?: \. [\w$]+)* (?:(?:<\S* )?\( \) )?)*)((?:(?:{MODIFIERS}) )*)(\* )?([A-Za-z_$][\w$]*)( [?!])?(?: ([(<:=;])|$)"
#: A call in a template's ${}.
IN_HOLE = r"\bthis\s*\??\.\s*([\w$]+)(?:\s*\??\.\s*([\w$]+))?\s*(?:\?\.\s*)?\("


def symbol_id(path: Column, kind: str | Column, name: Column) -> Column:
    return F.concat_ws("::", path, F.lit(kind) if isinstance(kind, str) else kind, name)


def file_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def within(rows: Column, test) -> Column:
    """Places (from 0) of the entries of an array that pass a test of the entry and its place."""
    return F.filter(F.transform(rows, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def listed(files: DataFrame) -> DataFrame:
    """path and `tokens` of every file: an array of at (place in the file), raw (with the blanks after it), word, line and
    depth, without comments.

    depth counts the brackets of any kind around a token; a bracket lies as deep as its partner. Null content has none.
    Running sums of brackets and line breaks double their reach in each round, so a file of n tokens takes log n rounds. The
    files are dealt into as many partitions as shuffles have: how many tokens come of a file is not seen in its bytes.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = files.select("path", "content").repartition(n, "path").select("path", F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)).alias("raw"))
    words = raw.select("path", "raw", F.transform("raw", lambda x: F.rtrim(x, F.lit(" \t\n\x0b\f\r"))).alias("word"))
    # both sums go in one number: line breaks above, brackets below
    step = lambda w, i: breaks(F.get("raw", i)).cast("long") * ABOVE + F.when(w.isin("(", "[", "{"), 1).when(w.isin(")", "]", "}"), -1).otherwise(0)
    first = words.select("path", "raw", "word", F.transform("word", step).alias("step"), F.size("word").alias("n"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + F.lit(1))).cast("int"))
    reach = lambda k: F.call_function("shiftleft", F.lit(1), k)
    upto = F.aggregate(rounds, F.col("step"), lambda sums, k: F.transform(sums, lambda x, i: F.when(i < reach(k), x).otherwise(x + F.get(sums, i - reach(k)))))
    summed = first.select("path", "raw", "word", "step", upto.alias("upto"))
    lines = lambda x: F.shiftright(x + ABOVE // 2, 32)
    depth = lambda x: (x - lines(x) * ABOVE).cast("int")

    def token(x: Column, i: Column) -> Column:
        word, own = F.get("word", i), F.get("step", i)
        return F.struct(i.alias("at"), F.get("raw", i).alias("raw"), word.alias("word"), (lines(x - own) + 1).alias("line"), (depth(x) - F.when(word.isin("(", "[", "{"), 1).otherwise(0)).alias("depth"))

    code = lambda t: (t["word"] != "") & ~F.startswith(t["word"], F.lit("//")) & ~F.startswith(t["word"], F.lit("/*"))
    return summed.select("path", F.filter(F.transform("upto", token), code).alias("tokens"))


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of listed() as rows."""
    return listed(files).select("path", F.explode("tokens").alias("t")).select("path", "t.*")


def owned(files: DataFrame) -> DataFrame:
    """Rows of the classes and interfaces at the outermost level of files: path, kind, owner, owner_at, flags, part, tokens.

    A row with part -1 stands for the head, with the tokens up to the body; the others for what lies between two ends one
    level in, of classes only. A class's last bracket is outside. Type literals between a class's name and its body are not
    taken for the body. Each token is in one row, so nothing is joined or sorted.
    """
    found = listed(files)
    # only what can begin or end a stretch is looked at with its neighbours
    marks = within(F.col("tokens"), lambda x, i: (x["depth"] == 0) & x["word"].isin("class", "interface", "}"))
    near = found.select("path", "tokens", marks.alias("marks"))

    def event(i: Column) -> Column:
        word = lambda k: F.get("tokens", i + k)["word"]
        head = word(0).isin("class", "interface") & word(1).rlike(NAME) & ~word(1).isin("extends", "implements") & ~F.coalesce(word(-1).isin(".", "?."), F.lit(False))
        ends = (word(0) == "}") & ~F.coalesce(word(1).isin(">", ",", "=", "|", "&", "["), F.lit(False))
        mods = F.when(word(-1).isin(*HEAD), F.concat_ws(" ", word(-1), F.when(word(-2).isin(*HEAD), F.concat_ws(" ", word(-2), F.when(word(-3).isin(*HEAD), word(-3)))))).otherwise("")
        own = [F.initcap(word(0)).alias("kind"), word(1).alias("owner"), F.get("tokens", i)["at"].alias("owner_at"), F.contains(mods, F.lit("export")).alias("is_exported"), F.contains(mods, F.lit("abstract")).alias("is_abstract")]
        return F.struct(i.alias("i"), F.coalesce(head, F.lit(False)).alias("head"), F.coalesce(ends, F.lit(False)).alias("ends"), *own)

    events = near.select("path", "tokens", F.filter(F.transform("marks", event), lambda e: e["head"] | e["ends"]).alias("events"))
    to = lambda k: F.coalesce(F.get("events", k + 1)["i"], F.size("tokens"))
    stretch = lambda e, k: F.struct(*(e[c].alias(c) for c in ("head", "kind", "owner", "owner_at", "is_exported", "is_abstract")), F.when(e["head"], F.slice("tokens", e["i"] + 1, to(k) - e["i"])).alias("t"))
    classes = events.select("path", F.explode(F.filter(F.transform("events", stretch), lambda c: c["head"])).alias("c")).select("path", "c.*")
    body = within(F.col("t"), lambda x, i: (x["depth"] == 0) & (x["word"] == "{") & ~F.coalesce(F.get("t", i - 1)["word"].isin("extends", "<", ":", "=", ",", "|", "&"), F.lit(False)))
    own = ["path", "kind", "owner", "owner_at", "is_exported", "is_abstract"]
    bodies = classes.select(*own, "t", F.get(body, F.lit(0)).alias("body"))
    ends = F.when(F.col("kind") == "Class", within(F.col("t"), lambda x, i: (x["depth"] == 1) & (i >= F.col("body")) & x["word"].isin(";", "}")))
    ended = bodies.select(*own, "t", "body", ends.alias("ends"))
    row = lambda part, rows: F.struct(part.cast("int").alias("part"), rows.alias("tokens"))
    head = row(F.lit(-1), F.slice("t", F.lit(1), F.coalesce("body", F.size("t"))))
    part = lambda at, k: row(k, F.slice("t", at + 2, F.coalesce(F.get("ends", k), F.size("t") - 1) - at))
    parts = F.when((F.col("kind") == "Class") & F.col("body").isNotNull(), F.transform(F.concat(F.array(F.col("body") - 1), "ends"), part))
    rows = F.concat(F.array(head), F.coalesce(parts, F.filter(F.array(head), lambda x: F.lit(False))))
    return ended.select(*own, F.explode(rows).alias("p")).select(*own, "p.*")


def with_members(rows: DataFrame) -> DataFrame:
    """Rows of owned() with name, member (method or property), its flags, and the places of its type and its body; these
    are null where a row is no member."""
    plain = F.transform(F.filter("tokens", lambda x: x["depth"] == 1), lambda x: F.struct(x["at"].alias("at"), F.regexp_replace(x["word"], r"\s+", "\u0001").alias("word")))
    lists = rows.withColumn("t", F.when(F.col("part") >= 0, plain))
    texts = lists.withColumn("text", F.array_join(F.transform("t", lambda x: x["word"]), " "))
    group = lambda k: F.regexp_extract("text", MEMBER, k)
    found = texts.withColumn("m", F.when(F.col("text").rlike(MEMBER), F.struct(*(group(k).alias(c) for k, c in ((1, "marks"), (2, "mods"), (3, "star"), (4, "name"), (5, "mark"), (6, "next"))))))
    found = found.select(*rows.columns, "t", "m.*", F.size(F.split(F.concat("m.marks", "m.mods", "m.star", F.lit("x")), " ")).alias("i"))
    found = found.withColumn("member", F.when(F.col("next").isin("(", "<"), "method").when(F.col("name").isNotNull(), "property"))
    found = found.withColumn("member", F.when(~((F.col("member") == "method") & (F.col("name") == "constructor")), F.col("member")))
    word = lambda k: F.get("t", k)["word"]  # noqa: E731  from 0; i - 1 is the name's place
    # where the type's colon would be: after the mark of a property, or the parameters of a method
    mark = F.when(F.col("mark") != "", 1).otherwise(0)
    colon = F.when(F.col("member") == "property", F.col("i") + mark).otherwise(F.col("i") + mark + F.when(F.startswith(word(F.col("i") + mark), F.lit("<")), 3).otherwise(2))
    found = found.withColumn("colon", F.when(F.col("member").isNotNull(), colon))
    found = found.withColumn("after", F.slice("t", F.col("colon") + 1, F.size("t")))
    stop = F.get(F.filter("after", lambda x: x["word"].isin("{", ";") | ((F.col("member") == "property") & (x["word"] == "="))), F.lit(0))["at"]
    body = F.when(F.col("member") == "method", F.get(F.filter("after", lambda x: x["word"] == "{"), F.lit(0))["at"])
    typed = word(F.col("colon")) == ":"
    # a property of a literal type begins with its bracket
    literal = typed & (word(F.col("colon") + 1) == "{")
    return found.select(
        *rows.columns, "name", "member", (~F.col("mods").rlike("private|protected")).alias("is_public"), F.col("mods").rlike(r"\bstatic\b").alias("is_static"),
        F.col("marks").rlike(r"@ Input (<\S* )?\(").alias("is_input"), F.col("marks").rlike(r"@ Output (<\S* )?\(").alias("is_output"),
        F.when(typed, F.get("t", F.col("colon"))["at"]).alias("type_from"), F.when(literal, None).otherwise(stop).alias("type_to"), body.alias("body_at"),
    )


def type_text() -> Column:
    """A property's type or a method's return type as it is written, null without one."""
    span = lambda x: (x["at"] > F.col("type_from")) & (F.col("type_to").isNull() | (x["at"] < F.col("type_to"))) & ((x["depth"] > 1) | (x["word"] != ";"))
    raw = F.transform(F.filter("tokens", span), lambda x: x["raw"])
    return F.when(F.col("type_from").isNotNull() & (F.size(raw) > 0), F.trim(F.regexp_replace(F.array_join(raw, ""), r"\s+", " ")))


def symbols(files: DataFrame) -> DataFrame:
    """id, label (Class, Interface, Method, Property), name, class_name, source_file, flags and type of every symbol.

    Overloads and repeated names give one node. Members of interfaces are none of their own; constructors and accessors
    are no methods.
    """
    head, prop = F.col("part") == -1, F.col("member") == "property"
    label = F.when(head, F.col("kind")).otherwise(F.initcap("member"))
    of_member = lambda c, when=True: F.when(~head & when, F.col(c)).alias(c)
    rows = with_members(owned(files)).where(head | F.col("member").isNotNull()).select(
        symbol_id(F.col("path"), label, F.when(head, F.col("owner")).otherwise(F.concat_ws(".", "owner", "name"))).alias("id"), label.alias("label"), F.when(head, F.col("owner")).otherwise(F.col("name")).alias("name"), F.col("path").alias("source_file"),
        F.when(head, F.col("is_exported")).alias("is_exported"), F.when(head & (F.col("kind") == "Class"), F.col("is_abstract")).alias("is_abstract"), F.when(~head, F.col("owner")).alias("class_name"),
        of_member("is_public"), of_member("is_static"), of_member("is_input", prop), of_member("is_output", prop), type_text().alias("type"), F.struct("owner_at", "part").alias("order"),
    )
    values = [c for c in rows.columns if c not in ("id", "order")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*values), "order").alias("s")).select("id", "s.*")


def symbol_edges(files: DataFrame) -> DataFrame:
    """type, src, dst and pending_name: what files declare, what classes have, extend and implement.

    A name that a class extends or implements is resolved later, so dst is null there.
    """
    rows = with_members(owned(files))
    head, none = F.col("part") == -1, F.lit(None).cast("string")
    owner = symbol_id(F.col("path"), F.col("kind"), F.col("owner"))
    edge = lambda kind, src, dst, name: F.struct(kind.alias("type"), src.alias("src"), dst.alias("dst"), name.alias("pending_name"))
    declared = edge(F.lit("DECLARES_SYMBOL"), file_id(F.col("path")), owner, none)
    of = F.when(F.col("member") == "method", "HAS_METHOD").otherwise("HAS_PROPERTY")
    had = edge(of, owner, symbol_id(F.col("path"), F.initcap("member"), F.concat_ws(".", "owner", "name")), none)
    line = F.concat(F.array_join(F.transform(F.filter("tokens", lambda x: x["depth"] == 0), lambda x: x["word"]), " "), F.lit(" "))
    # type arguments go, level by level
    for _ in range(3):
        line = F.regexp_replace(line, r"<[^<>]*> ", "")
    rows = rows.withColumn("line", F.when(head & (F.col("kind") == "Class"), line))
    base = F.regexp_extract("line", r" extends ([\w$]+) (?![.(])", 1)
    named = F.filter(F.split(F.regexp_extract("line", r" implements (.*)$", 1), " , "), lambda x: F.trim(x).rlike(NAME))
    heritage = F.concat(F.filter(F.array(edge(F.lit("EXTENDS"), owner, none, base)), lambda e: e["pending_name"] != ""), F.transform(named, lambda x: edge(F.lit("IMPLEMENTS"), owner, none, F.trim(x))))
    edges = F.when(head & (F.col("kind") == "Class"), F.concat(F.array(declared), heritage)).when(head, F.array(declared)).when(F.col("member").isNotNull(), F.array(had))
    return rows.select(F.explode(edges).alias("e")).select("e.*").distinct()


def method_calls(files: DataFrame) -> DataFrame:
    """type, src, dst, pending_name, via and line of calls on `this` and on what it holds, in the bodies of methods.

    this.m() has the method of the same class as dst; this.dep.m() waits for m's owner to be found, with dep as via. The
    line is where the call begins. Several calls on one line are one edge.
    """
    rows = with_members(owned(files)).select("path", "owner", "name", "body_at", "tokens")
    text = F.lit(None).cast("string")
    call = lambda callee, via, line: F.struct(callee.alias("callee"), via.alias("via"), line.cast("long").alias("line"))

    def plain(i: Column) -> Column:
        word = lambda k: F.get("tokens", i + k)["word"]
        dot = lambda k: word(k).isin(".", "?.")
        called = lambda k: (word(k) == "(") | F.startswith(word(k), F.lit("<")) & (F.length(word(k)) > 1) | (word(k) == "?.") & (word(min(k + 1, 6)) == "(")
        line = F.get("tokens", i)["line"]
        own = F.when(dot(1) & word(2).rlike(NAME) & called(3), F.array(call(word(2), text, line)))
        return F.coalesce(own, F.when(dot(1) & word(2).rlike(NAME) & dot(3) & word(4).rlike(NAME) & called(5), F.array(call(word(4), word(2), line))))

    def inner(t: Column) -> Column:
        # calls in a template: matches and what lies between them, whose line breaks tell the line
        pieces, matches = F.split(t["word"], IN_HOLE, -1), F.regexp_extract_all(t["word"], F.lit(IN_HOLE), F.lit(0))
        join = lambda k: F.array_join(F.flatten(F.zip_with(F.slice(pieces, F.lit(1), k + 1), F.concat(F.slice(matches, F.lit(1), k), F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
        holes = F.transform(matches, lambda m, k: F.struct(join(k).alias("before"), F.regexp_extract(m, IN_HOLE, 1).alias("a"), F.nullif(F.regexp_extract(m, IN_HOLE, 2), F.lit("")).alias("b")))
        held = F.filter(holes, lambda h: h["before"].rlike(r"\$\{[^}]*\z"))
        return F.transform(held, lambda h: call(F.coalesce(h["b"], h["a"]), F.when(h["b"].isNotNull(), h["a"]), t["line"] + breaks(h["before"])))

    # body_at is null for all but methods; a filter would be moved below and all that it reads worked out twice
    places = within(F.col("tokens"), lambda x, i: (x["depth"] > 1) & (x["at"] > F.col("body_at")) & ((x["word"] == "this") | F.startswith(x["word"], F.lit("`"))))
    near = rows.select("path", "owner", "name", "tokens", places.alias("places"))
    found = F.transform("places", lambda i: F.when(F.get("tokens", i)["word"] == "this", plain(i)).otherwise(inner(F.get("tokens", i))))
    both = near.select("path", "owner", "name", F.explode(F.flatten(F.filter(found, lambda c: c.isNotNull()))).alias("c")).select("path", "owner", "name", "c.*")
    method = lambda n: symbol_id(F.col("path"), "Method", F.concat_ws(".", "owner", n))
    return both.select(F.lit("CALLS_METHOD").alias("type"), method("name").alias("src"), F.when(F.col("via").isNull(), method("callee")).alias("dst"), F.when(F.col("via").isNotNull(), F.col("callee")).alias("pending_name"), "via", "line").distinct()


#: Fixed value: the class whose instances declare tokens.
TOKEN_CLASS = "InjectionToken"


def injection_tokens(files: DataFrame) -> DataFrame:
    """id, name, description, source_file of tokens that a file declares at its outermost level."""
    order = Window.partitionBy("path").orderBy("at")
    found = tokens(files).where("depth = 0 OR depth = 1")
    # the statement up to `new`: everything since the last declaring word
    start = F.last(F.when((F.col("depth") == 0) & F.col("word").isin("const", "let", "var"), F.col("at")).when((F.col("depth") == 0) & (F.col("word") == ";"), F.lit(-1)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a comma parts two declarations unless it is in type arguments
    own = Window.partitionBy("path", "start").orderBy("at")
    angle = F.when(F.col("depth") == 0, F.when(F.col("word") == "<", 1).when(F.col("word") == ">", -1)).otherwise(0)
    found = found.withColumn("start", start).where("start >= 0").withColumn("angle", F.sum(F.coalesce(angle, F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    comma = F.sum(((F.col("depth") == 0) & (F.col("word") == ",") & (F.col("angle") <= 0)).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("comma", F.coalesce(comma, F.lit(0))).groupBy("path", "start", "comma").agg(F.array_sort(F.collect_list(F.struct("at", "depth", "word"))).alias("t"))
    flat = F.concat(F.array_join(F.transform(F.filter("t", lambda x: x["depth"] == 0), lambda x: F.regexp_replace(x["word"], r"\s+", "")), " "), F.lit(" "))
    shape = rf"^(?:(?:const|let|var|,) )*([A-Za-z_$][\w$]*) (?:: .*?)?= new {TOKEN_CLASS} (?:<.*?> ?)?\( \) "
    first = F.get(F.filter("t", lambda x: x["depth"] == 1), F.lit(0))["word"]
    description = F.when(first.rlike(r"^['\"]"), F.substring(first, F.lit(2), F.length(first) - 2))
    named = parts.select("path", F.regexp_extract(flat, shape, 1).alias("name"), description.alias("description")).where("name <> ''")
    return named.select(symbol_id(F.col("path"), TOKEN_CLASS, F.col("name")).alias("id"), "name", "description", F.col("path").alias("source_file"))


def token_edges(files: DataFrame) -> DataFrame:
    """type, src and dst of the tokens that files declare."""
    return injection_tokens(files).select(F.lit("DECLARES_SYMBOL").alias("type"), file_id(F.col("source_file")).alias("src"), F.col("id").alias("dst")).distinct()
