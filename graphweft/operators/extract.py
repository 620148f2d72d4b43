"""Nodes and edges from source files (path, content), by built-in text functions.

Sources are read by patterns, not parsed: comments go first, parentheses may nest once within a decorator or a parameter
list. That covers how such files are written in practice; what a pattern misses is missing from the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.expressions import folded_path, pascal_case, stable_id

#: Decorators with the label of what they mark, and lists of a module with the type of their edges.
DECORATORS = {"Component": "Component", "Injectable": "Service", "NgModule": "NgModule", "Directive": "Directive", "Pipe": "Pipe"}
MODULE_LISTS = {"declarations": "DECLARES", "imports": "IMPORTS", "exports": "EXPORTS", "bootstrap": "BOOTSTRAPS", "providers": "PROVIDES"}
#: Text in parentheses that nest once.
INNER = r"((?:[^()]++|\([^()]*+\))*+)"
MARKED = r"@(" + "|".join(DECORATORS) + r")\s*\(" + INNER + r"\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
COMMENT = r"/\*[\s\S]*?\*/|(?<![:'\"])//[^\n]*"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def code(files: DataFrame) -> DataFrame:
    """path and content without comments."""
    return files.select("path", F.regexp_replace("content", COMMENT, " ").alias("content"))


def entities(files: DataFrame) -> DataFrame:
    """id, label, name, file_path, selector, is_standalone, change_detection of every decorated class."""
    found = code(files).select("path", F.explode(every(F.col("content"), MARKED, 0)).alias("m"))
    part = lambda n: F.regexp_extract("m", MARKED, n)
    label = reduce(lambda a, d: a.when(part(1) == d, DECORATORS[d]), DECORATORS, F.when(F.lit(False), F.lit("")))
    rows = found.select("path", label.alias("label"), part(2).alias("meta"), part(3).alias("name"))
    return rows.select(
        F.substring(F.sha2(F.concat_ws(":", "path", "name"), 256), 1, 16).alias("id"), "label", "name", F.col("path").alias("file_path"),
        F.coalesce(group(F.col("meta"), r"selector\s*:\s*['\"]([^'\"]*)"), group(F.col("meta"), r"\bname\s*:\s*['\"]([^'\"]*)")).alias("selector"),
        F.col("meta").rlike(r"standalone\s*:\s*true").alias("is_standalone"),
        group(F.col("meta"), r"changeDetection\s*:\s*ChangeDetectionStrategy\.(\w+)").alias("change_detection"),
        group(F.col("meta"), r"templateUrl\s*:\s*['\"]([^'\"]*)").alias("template_path"), "meta",
    )


def styles(entities: DataFrame) -> DataFrame:
    """component, style (a stable id), file_path, format and order of the style files that components name."""
    listed = F.coalesce(group(F.col("meta"), r"\bstyleUrls\s*:\s*\[([^\]]*)\]"), group(F.col("meta"), r"\bstyleUrl\s*:\s*(['\"][^'\"]*['\"])"))
    rows = entities.where("label = 'Component'").select(F.col("id").alias("component"), F.regexp_replace("file_path", "/?[^/]*$", "").alias("folder"), F.posexplode(every(listed, r"['\"]([^'\"]+)['\"]")).alias("order", "url"))
    path = folded_path(F.concat_ws("/", "folder", "url"))
    return rows.select("component", stable_id(F.lit("style"), path).alias("style"), path.alias("file_path"), F.regexp_extract("url", r"\.(\w+)$", 1).alias("format"), "order")


def module_edges(entities: DataFrame) -> DataFrame:
    """type, src and pending_name of a module's lists; only bare names count, calls and objects do not."""
    modules = entities.where("label = 'NgModule'")
    rows = [
        modules.select(F.lit(kind).alias("type"), F.col("id").alias("src"), F.explode(F.split(group(F.col("meta"), rf"\b{name}\s*:\s*\[([^\]]*)\]"), ",")).alias("pending_name"))
        for name, kind in MODULE_LISTS.items()
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("pending_name", F.trim(F.regexp_replace("pending_name", r"\s+", ""))).where(F.col("pending_name").rlike(r"^\w+$"))


def classes(files: DataFrame) -> DataFrame:
    """path, name and body of each class; a body reaches to the next class."""
    parts = F.explode(F.slice(F.split("content", r"(?=\bclass\s+[A-Z]\w*)"), F.lit(1), F.lit(1 << 20)))
    return code(files).select("path", parts.alias("body")).select("path", group(F.col("body"), r"^class\s+(\w+)").alias("name"), "body").where("name IS NOT NULL")


def class_edges(files: DataFrame) -> DataFrame:
    """type, src, pending_name and via of what a class extends, implements and gets injected."""
    body = F.col("body")
    head = group(body, r"^class\s+\w+([^{]*)\{")
    params = group(body, r"\bconstructor\s*\(" + INNER + r"\)")
    names = lambda kind, via, found: F.transform(found, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("pending_name"), F.lit(via).alias("via")))
    none = F.array().cast("array<string>")
    listed = F.transform(F.split(group(head, r"\bimplements\s+([^{]*)"), ","), lambda x: F.regexp_extract(x, r"^\s*(\w+)", 1))
    found = F.concat(
        names("EXTENDS", "extends", F.coalesce(every(head, r"\bextends\s+(\w+)"), none)),
        names("IMPLEMENTS", "implements", F.coalesce(listed, none)),
        names("INJECTS", "constructor", F.coalesce(every(F.regexp_replace(params, r"@Inject\([^()]*\)\s*[^,]*", ""), r":\s*([A-Z]\w*)"), none)),
        names("INJECTS", "@Inject", F.coalesce(every(params, r"@Inject\(\s*(\w+)"), none)),
        names("INJECTS", "inject_fn", every(body, r"\binject\s*(?:<[^>]*>)?\(\s*(\w+)")),
    )
    src = F.substring(F.sha2(F.concat_ws(":", "path", "name"), 256), 1, 16)
    return classes(files).select(src.alias("src"), F.explode(found).alias("e")).select("e.type", "src", "e.pending_name", "e.via").distinct()


def members(files: DataFrame) -> DataFrame:
    """owner, name, kind, is_public and line text of methods, and of properties with a type or a value."""
    body = F.col("body")
    line = r"(?m)^[ \t]+((?:@(?:Input|Output)\([^)]*\)\s*)?(?:(?:public|private|protected|static|readonly|async|abstract)\s+)*)(\w+)\s*"
    method, prop = line + r"\([^)]*\)[^{};]*\{", line + r"[?!]?\s*(?::[^;={(]*)?(?:=[^=>][^;]*)?;"
    rows = lambda kind, pattern: F.transform(every(body, pattern, 0), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.regexp_extract(m, line, 2).alias("member"), F.regexp_extract(m, line, 1).alias("mods")))
    found = classes(files).select("path", F.col("name").alias("owner"), F.explode(F.concat(rows("method", method), rows("property", prop))).alias("e"))
    public = ~F.col("e.mods").rlike("private|protected")
    out = found.select("path", "owner", F.col("e.member").alias("name"), "e.kind", public.alias("is_public"), F.col("e.mods").contains("@Input").alias("is_input"), F.col("e.mods").contains("@Output").alias("is_output"))
    return out.where(~F.col("name").isin("constructor", "if", "for", "while", "switch", "catch", "return", "super", "else")).distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """type, src and dst paths of relative imports; an ending .js means the source beside it."""
    relative = F.explode(every(F.col("content"), r"\bfrom\s*['\"](\.[^'\"]*)['\"]"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = code(files).select("path", folder.alias("folder"), relative.alias("to"))
    dst = F.concat(folded_path(F.concat_ws("/", "folder", F.regexp_replace("to", r"\.(js|ts)$", ""))), F.lit(".ts"))
    lead = F.when(F.startswith("path", F.lit("/")), "/").otherwise("")
    return rows.select(F.lit("IMPORTS_FROM").alias("type"), F.col("path").alias("src"), F.concat(lead, dst).alias("dst")).distinct()


def routes(files: DataFrame) -> DataFrame:
    """file_path, path, type and pending_name of routes to a component and of lazily loaded targets."""
    item = r"\bpath\s*:\s*['\"]([^'\"]*)['\"]\s*,[^{}]*?"
    rows = lambda kind, pattern: F.transform(every(F.col("content"), pattern, 0), lambda m: F.struct(F.lit(kind).alias("type"), F.regexp_extract(m, pattern, 1).alias("route"), F.regexp_extract(m, pattern, 2).alias("pending_name")))
    eager = rows("ROUTES_TO", item + r"\bcomponent\s*:\s*(\w+)")
    lazy = rows("LAZY_LOADS", item + r"\bload(?:Children|Component)\s*:[^{}]*?=>\s*\w+\.(\w+)")
    return code(files).select(F.col("path").alias("file_path"), F.explode(F.concat(eager, lazy)).alias("e")).select("file_path", "e.route", "e.type", "e.pending_name")


def template_bindings(templates: DataFrame) -> DataFrame:
    """path, kind and name that a template (path, content) binds to: two-way, property, event, interpolation."""
    text = F.col("content")
    first = r"\s*=\s*\"\s*(?:this\.)?([A-Za-z_]\w*)"
    rows = lambda kind, found: F.transform(found, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    found = F.concat(
        rows("two_way", every(text, r"\[\([\w.-]+\)\]" + first)), rows("property", every(text, r"(?<!\()\[[\w.-]+\]" + first)),
        rows("event", every(text, r"(?<!\[)\([\w.-]+\)" + first)), rows("interpolation", every(text, r"\{\{\s*(?:this\.)?([A-Za-z_]\w*)")),
    )
    return templates.select("path", F.explode(found).alias("e")).select("path", "e.kind", "e.name").distinct()


def template_usages(templates: DataFrame, selectors: DataFrame) -> DataFrame:
    """path, type and target of elements and attributes in templates whose selector (selector, id, label) is known.

    Dashed elements that no selector names come as USES_EXTERNAL with a stable id of their own.
    """
    text = F.col("content")
    tags = templates.select("path", F.explode(every(text, r"<([a-z][a-z0-9-]*)")).alias("selector"))
    attributes = templates.select("path", F.explode(every(text, r"\s\[?([a-zA-Z][\w-]*)\]?(?=[\s=>/])")).alias("name")).select("path", F.concat(F.lit("["), "name", F.lit("]")).alias("selector"))
    pipes = templates.select("path", F.explode(every(text, r"\[[\w.-]+\]\s*=\s*\"[^\"]*\|\s*(\w+)")).alias("selector"))
    used = tags.unionByName(attributes).unionByName(pipes).distinct().join(selectors, "selector", "left")
    kind = F.when(F.col("label") == "Component", "USES_COMPONENT").when(F.col("label") == "Directive", "USES_DIRECTIVE").when(F.col("label") == "Pipe", "USES_PIPE").otherwise("USES_EXTERNAL")
    outside = F.substring(F.sha2(F.concat(F.lit("external|"), "selector"), 256), 1, 16)
    return used.where("id IS NOT NULL OR selector LIKE '%-%' AND selector NOT LIKE '[%'").select("path", kind.alias("type"), F.coalesce("id", outside).alias("dst"), "selector")


def spec_links(specs: DataFrame, suffixes: list[str]) -> DataFrame:
    """spec, pending_name and via: names imported from beside the spec, else set up for the test."""
    named = rf"\b\w+(?:{'|'.join(suffixes)})$"
    imported = F.flatten(F.transform(every(F.col("content"), r"import\s*\{([^}]*)\}\s*from\s*['\"]\."), lambda x: F.split(x, r"\s*,\s*")))
    setup = F.flatten(F.transform(every(F.col("content"), r"\b(?:declarations|providers|imports)\s*:\s*\[([^\]]*)\]"), lambda x: F.split(x, r"\s*,\s*")))
    rows = lambda via, rank, found: F.transform(found, lambda n: F.struct(F.trim(n).alias("pending_name"), F.lit(via).alias("via"), F.lit(rank).alias("rank")))
    all_ = code(specs).select(F.col("path").alias("spec"), F.explode(F.concat(rows("import", 1, imported), rows("testbed", 2, setup))).alias("e"))
    found = all_.where(F.col("e.pending_name").rlike(named)).groupBy("spec", F.col("e.pending_name").alias("pending_name")).agg(F.min_by("e.via", "e.rank").alias("via"))
    # a spec that neither names nor sets up anything is of the class that its file is named after
    file = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.spec\.ts$", "")
    alone = specs.select(F.col("path").alias("spec"), pascal_case(file).alias("pending_name"), F.lit("naming").alias("via")).where(F.col("pending_name").rlike(rf"(?:{'|'.join(suffixes)})$"))
    return found.unionByName(alone.join(found.select("spec").distinct(), "spec", "left_anti"))


def pattern_findings(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """node_id, reason_code, scope for every file that holds a pattern, as raw findings."""
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), k) for k, p in patterns.items())))
    scope = F.when(F.contains("path", F.lit(".spec.")), "test").otherwise("production")
    return code(files).select(stable_id("path").alias("node_id"), F.explode(hits).alias("reason_code"), scope.alias("scope"))
