"""Rules of a migration as plans: each takes entities, sources or templates and gives raw findings.

A raw finding has node_id, reason_code, scope and type, which overrides the one that follows from the severity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.expressions import folded_path, scope, stable_id
from graphweft.operators import extract

#: Interfaces of guards, and operators that were called on a stream before they were piped.
GUARDS = ["CanActivate", "CanDeactivate", "CanLoad", "CanMatch", "CanActivateChild"]
CHAINABLE = (
    "map filter switchMap mergeMap flatMap concatMap exhaustMap debounceTime throttleTime distinctUntilChanged take takeUntil catchError retry retryWhen delay "
    "share shareReplay combineLatest withLatestFrom zip startWith scan reduce tap do pluck mapTo pairwise skip skipUntil takeWhile bufferTime bufferCount windowTime groupBy toArray"
).split()
#: What a source is searched for by one pattern.
SCANS = {
    "RXJS_PATCH_IMPORTS": r"\bimport\b[^;]*?['\"]rxjs/add/",
    "RXJS_TO_PROMISE": r"\.\s*toPromise\s*\(",
    "RXJS_THROW_ERROR_STRING": r"\bthrowError\s*\(\s*['\"]",
    "ANG_COMPONENT_FACTORY": r"\.\s*resolveComponentFactory\s*\(|\bComponentFactoryResolver\s*\.\s*\w+\s*\(",
    "ANG_MODULE_WITH_PROVIDERS": r"\)\s*:\s*ModuleWithProviders\b",
}
CALLED = r"(\.?\s*\w+)\s*\(" + extract.INNER + r"\)(?=\s*\.\s*(?:" + "|".join(CHAINABLE) + r")\s*\()"
OLD_DIRECTIVE = r"\*ng(If|For|Switch)\b"


def raw(rows: DataFrame, code: str | Column, type: str | Column, id: str = "id", path: str = "file_path") -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(F.col(id).alias("node_id"), lit(code).alias("reason_code"), scope(F.coalesce(path, F.lit(""))).alias("scope"), lit(type).alias("type")).distinct()


def source_scans(files: DataFrame) -> DataFrame:
    """Findings on files (path, content) by what their code calls, imports and returns; comments don't count."""
    chained = F.exists(extract.every(F.col("content"), CALLED), lambda m: ~m.rlike(r"^\.\s*pipe$"))
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), k) for k, p in SCANS.items()), F.when(chained, "RXJS_NON_PIPEABLE")))
    rows = extract.code(files).select(stable_id("path").alias("id"), F.col("path").alias("file_path"), F.explode(hits).alias("code"))
    return raw(rows, F.col("code"), F.when(F.col("code") == "ANG_MODULE_WITH_PROVIDERS", "opportunity").otherwise("risk"))


def listed(meta: Column, name: str) -> Column:
    """Bare names in a list of a decorator."""
    return F.transform(F.split(F.coalesce(extract.group(meta, rf"\b{name}\s*:\s*\[([^\]]*)\]"), F.lit("")), ","), lambda x: F.trim(x))


def component_templates(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """Components with the text of their template: written inside, or the file beside the component that they name."""
    components = entities.where("label = 'Component'")
    inline = components.withColumn("content", extract.group(F.col("meta"), r"\btemplate\s*:\s*(?:`([^`]*)`)")).where("content IS NOT NULL").withColumn("is_inline", F.lit(True))
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    beside = components.where("template_path IS NOT NULL").withColumn("path", folded_path(F.concat_ws("/", folder, "template_path")))
    files = templates.select(F.regexp_replace("path", "^/", "").alias("path"), "content")
    return inline.unionByName(beside.join(files, "path").drop("path").withColumn("is_inline", F.lit(False)))


def template_rules(shown: DataFrame, templates: DataFrame, pipes: DataFrame) -> DataFrame:
    """Findings on components with their templates (from component_templates), template files and pipes (selector, name)."""
    lone = shown.where("is_standalone")
    imports = listed(F.col("meta"), "imports")
    forms = F.exists(imports, lambda x: x.isin("FormsModule", "ReactiveFormsModule"))
    model = raw(lone.where(F.col("content").rlike(r"\[?\(?\bngModel\b") & ~forms), "TMPL_NGMODEL_MISSING_IMPORT", "blocker")
    used = lone.select("id", "file_path", imports.alias("imports"), F.explode(F.array_distinct(extract.every(F.col("content"), r"(?<!\|)\|(?!\|)\s*(\w+)"))).alias("selector"))
    missing = used.join(pipes.select("selector", F.col("name").alias("pipe")), "selector").where(~F.array_contains("imports", F.col("pipe")))
    old = F.col("content").rlike(OLD_DIRECTIVE)
    html = raw(templates.where(old).select(stable_id("path").alias("id"), F.col("path").alias("file_path")), "TMPL_OLD_STRUCTURAL_DIRECTIVE", "opportunity")
    own = raw(shown.where(F.col("is_inline") & old), "TMPL_OLD_STRUCTURAL_DIRECTIVE", "opportunity")
    eager = F.coalesce(F.col("change_detection") != "OnPush", F.lit(True))
    waits = raw(shown.where(eager & F.col("content").rlike(r"(?<!\|)\|(?!\|)\s*async\b")), "TMPL_ASYNC_WITHOUT_ONPUSH", "opportunity")
    return reduce(DataFrame.unionByName, [model, raw(missing, "TMPL_PIPE_MISSING_IMPORT", "blocker"), html, own, waits])


def class_rules(entities: DataFrame, class_edges: DataFrame) -> DataFrame:
    """Guards and resolvers that are classes, and components that look for changes all the time."""
    guards = entities.join(class_edges.where((F.col("type") == "IMPLEMENTS") & F.col("pending_name").isin(GUARDS)).select(F.col("src").alias("id")).distinct(), "id")
    default = F.coalesce(F.col("change_detection") == "Default", F.lit(True))
    return (
        raw(guards, "ANG_CLASS_BASED_GUARD", "risk")
        .unionByName(raw(entities.where("label = 'Service' AND startswith(name, 'Resolve')"), "ANG_CLASS_BASED_RESOLVER", "risk"))
        .unionByName(raw(entities.where((F.col("label") == "Component") & default & ~F.col("is_standalone")), "ANG_CD_DEFAULT", "opportunity"))
    )


def standalone_rules(entities: DataFrame) -> DataFrame:
    """Components that could stand alone, that no module declares, or that a module lists as entry components."""
    modules = entities.where("label = 'NgModule'")
    named = lambda k, flag: modules.select(F.explode(listed(F.col("meta"), k)).alias("name")).distinct().withColumn(flag, F.lit(True))
    rows = entities.where("label = 'Component' AND NOT is_standalone").join(named("declarations", "declared"), "name", "left").join(named("entryComponents", "entry"), "name", "left")
    return (
        raw(rows.where("declared IS NULL"), "ANG_NGMODULE_HEAVY", "risk")
        .unionByName(raw(rows.where("entry"), "ANG_ENTRY_COMPONENTS", "blocker"))
        .unionByName(raw(rows.where("declared AND entry IS NULL"), "ANG_NGMODULE_HEAVY", "opportunity"))
    )


def module_rules(scored: DataFrame) -> DataFrame:
    """Modules (id, file_path, feasibility) that can't be migrated as they are."""
    return raw(scored.where("feasibility = 'blocked'"), "ANG_NGMODULE_HEAVY", "risk")


def cycle_rules(cyclic: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node (id) on a cycle of dependencies; nodes: id, file_path."""
    return raw(cyclic.join(nodes.select("id", "file_path"), "id"), "ARCH_CIRCULAR_DEPENDENCY", "blocker")


def analyzed(files: DataFrame, templates: DataFrame) -> DataFrame:
    """Raw findings of all rules that sources and templates (path, content) are enough for."""
    entities = extract.entities(files)
    shown = component_templates(entities, templates)
    pipes = entities.where("label = 'Pipe'").select("selector", "name")
    return reduce(DataFrame.unionByName, [source_scans(files), template_rules(shown, templates, pipes), class_rules(entities, extract.class_edges(files)), standalone_rules(entities)])
