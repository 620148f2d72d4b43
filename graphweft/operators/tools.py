"""Questions about a graph with arguments, each answered by a page of rows in a total order beside the number of all rows.

A page's size is cut to what the question allows, a cursor that can't be read starts at the first row, and a question
without the argument that it needs is an error. `detail` and `summary` choose columns, they don't change rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.expressions import half_up, priority, severity_rank, skip_of
from graphweft.operators import findings as fd
from graphweft.operators import topo
from graphweft.operators.graph import ELIGIBLE, Graph
from graphweft.operators.metrics import symbol_metrics
from graphweft.operators.traverse import impact, in_project, traverse

#: What each section of a module's structure is made of, by type of edge.
SECTIONS = {"declares": "DECLARES", "imports": "IMPORTS", "exports": "EXPORTS", "bootstrap": "BOOTSTRAPS", "providers": "PROVIDES"}
USED = {"INJECTS": "services", "USES_COMPONENT": "components", "USES_DIRECTIVE": "directives", "USES_PIPE": "pipes"}
LABELS = ["Component", "Service", "Directive", "Pipe", "NgModule", "Class", "Interface"]


def needed(**arguments) -> None:
    """An error that names the arguments if none of them is given."""
    if all(v is None or v == "" for v in arguments.values()):
        raise ValueError(f"one of {', '.join(arguments)} is needed")


def one_of(value: str | None, allowed: list[str], name: str) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def in_range(value: float | None, least: float, most: float, name: str) -> None:
    if value is not None and not least <= value <= most:
        raise ValueError(f"{name} must be between {least} and {most}")


def paged(rows: DataFrame, order: list, size: int, most: int, cursor: str | None = None) -> DataFrame:
    """A page with the column total; the one row of the total is set beside each row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(skip_of(cursor)).limit(max(1, min(size, most))).crossJoin(F.broadcast(total))


def holds(column: str, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))


def all_of(rows: DataFrame, **equal) -> DataFrame:
    """rows whose columns have the given values; those that are None don't count."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == kv[1]), equal.items(), rows)


def members_of(graph: Graph, project: str) -> DataFrame:
    return graph.typed("BELONGS_TO_PROJECT").where(F.col("dst") == project).select(F.col("src").alias("id")).distinct()


def of_project(rows: DataFrame, column: str, graph: Graph, project: str | None) -> DataFrame:
    return rows if project is None else rows.join(members_of(graph, project).withColumnRenamed("id", column), column, "left_semi")


def find_component(graph: Graph, name: str | None = None, selector: str | None = None, standalone: bool | None = None, match: str = "any", detail: bool = False, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """Components by part of their name, selector (column file_path of the nodes where they have no selector) or flag."""
    needed(name=name, selector=selector)
    at = "selector" if "selector" in graph.nodes.columns else "file_path"
    tests = [t for t in (holds("name", name) if name else None, F.col(at) == selector if selector else None, F.col("flag") == standalone if standalone is not None else None) if t is not None]
    hit = reduce((lambda a, b: a | b) if match == "any" else (lambda a, b: a & b), tests)
    columns = ["id", "name", F.col(at).alias("selector"), F.col("flag").alias("is_standalone"), *(["label", "is_test"] if detail else [])]
    return paged(graph.labelled("Component").where(hit).select(*columns), ["name", "id"], page_size, 100, cursor)


def find_symbol(graph: Graph, name: str, kinds: list[str] | None = None, file_path: str | None = None, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    needed(name=name)
    rows = graph.nodes if kinds is None else graph.labelled(*kinds)
    return paged(all_of(rows.where(holds("name", name)), file_path=file_path).select("id", "label", "name", "file_path"), ["name", "id"], page_size, 100, cursor)


def component_dependencies(graph: Graph, component: str) -> DataFrame:
    """What a component uses, by section."""
    section = F.create_map(*(F.lit(x) for kv in USED.items() for x in kv))[F.col("type")]
    out = graph.typed(*USED).where(F.col("src") == component).select(section.alias("section"), F.col("dst").alias("id"))
    return out.distinct().join(graph.nodes.select("id", "label", "name"), "id")


def service_usage(graph: Graph, name: str, kinds: tuple[str, ...] = ("INJECTS",), page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """A page of services by part of the name, with how many of each label use them."""
    needed(name=name)
    page = paged(graph.labelled("Service").where(holds("name", name)).select("id", "name"), ["name", "id"], page_size, 100, cursor)
    users = graph.typed(*kinds).select("src", F.col("dst").alias("id")).distinct().join(graph.nodes.select(F.col("id").alias("src"), "label"), "src")
    return page.join(users, "id", "left").groupBy("id", "name", "total", F.col("label").alias("user_label")).agg(F.count("src").alias("n_users"))


def beside(page: DataFrame, parts: DataFrame, graph: Graph) -> DataFrame:
    """A row for each member (id, section, member) of what is on a page, with the member's label and name; in no list."""
    parts = parts.join(F.broadcast(page.select("id")), "id", "left_semi").distinct()
    named = graph.nodes.select(F.col("id").alias("member"), F.col("label").alias("member_label"), F.col("name").alias("member_name"))
    return page.join(parts, "id").join(named, "member").select("id", "name", "section", "member", "member_label", "member_name")


def service_users(graph: Graph, name: str, kinds: tuple[str, ...] = ("INJECTS",), page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """Who uses the services of a page, by the type of edge."""
    needed(name=name)
    page = paged(graph.labelled("Service").where(holds("name", name)).select("id", "name"), ["name", "id"], page_size, 100, cursor)
    return beside(page, graph.typed(*kinds).select(F.col("dst").alias("id"), F.col("type").alias("section"), F.col("src").alias("member")), graph)


def trace_route(routes: DataFrame, path: str) -> DataFrame:
    """The route (id, path, target, parent) that is the longest prefix of a path, and its ancestors by distance."""
    needed(path=path)
    fits = routes.where(F.startswith(F.lit(path), F.col("path")))
    best = fits.orderBy(F.length("path").desc(), "id").limit(1)
    parents = routes.select(F.col("id").alias("ancestor_id"), F.col("path").alias("ancestor_path"), F.col("parent").alias("next"))
    # an ancestor's path is a prefix of its child's, so all of them are among the routes that fit
    chain = best.select("id", "path", "target", F.col("parent").alias("up"), F.lit(0).alias("distance"))
    out, step = chain.drop("up"), chain
    for _ in range(path.count("/") + 1):
        step = step.join(F.broadcast(parents.where(F.startswith(F.lit(path), F.col("ancestor_path")))), F.col("up") == F.col("ancestor_id")).select(F.col("ancestor_id").alias("id"), F.col("ancestor_path").alias("path"), F.lit(None).cast("string").alias("target"), F.col("next").alias("up"), (F.col("distance") + 1).alias("distance"))
        out = out.unionByName(step.drop("up"))
    return out


def module_structure(graph: Graph, name: str, sections: dict[str, str] | None = None, inbound: bool = False, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """A page of modules by part of the name with the number and the first few ids of each section."""
    needed(name=name)
    sections = sections or SECTIONS
    near, far = ("dst", "src") if inbound else ("src", "dst")
    page = paged(graph.labelled("NgModule").where(holds("name", name)).select("id", "name"), ["name", "id"], page_size, 100, cursor)
    kind = F.create_map(*(F.lit(x) for k, v in sections.items() for x in (v, k)))[F.col("type")]
    parts = graph.typed(*sections.values()).select(F.col(near).alias("id"), kind.alias("section"), F.col(far).alias("member")).distinct()
    return page.join(parts, "id", "left").groupBy("id", "name", "total", "section").agg(F.count("member").alias("n"), F.min("member").alias("first_member"))


def module_members(graph: Graph, name: str, sections: dict[str, str] | None = None, inbound: bool = False, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """The members of every section of the modules of a page, a row each."""
    needed(name=name)
    sections = sections or SECTIONS
    near, far = ("dst", "src") if inbound else ("src", "dst")
    page = paged(graph.labelled("NgModule").where(holds("name", name)).select("id", "name"), ["name", "id"], page_size, 100, cursor)
    kind = F.create_map(*(F.lit(x) for k, v in sections.items() for x in (v, k)))[F.col("type")]
    return beside(page, graph.typed(*sections.values()).select(F.col(near).alias("id"), kind.alias("section"), F.col(far).alias("member")).distinct(), graph)


def entity_neighbours(graph: Graph, entity: str, label: str, kinds: list[str] | None = None, page_size: int = 50, cursor: str | None = None) -> DataFrame:
    """A page of what an entity has edges with, by direction and type, each with its label, name and file."""
    one_of(label, [*LABELS, "Template", "SpecFile", "Project"], "label")
    known = graph.labelled(label).where(F.col("id") == entity).select(F.col("id").alias("entity"))
    edges = graph.typed(*kinds) if kinds else graph.edges
    end = lambda near, far, way: edges.where(F.col(near) == entity).select(F.col(near).alias("entity"), F.lit(way).alias("direction"), "type", F.col(far).alias("id"))
    around = end("src", "dst", "out").unionByName(end("dst", "src", "in")).distinct().join(known, "entity", "left_semi")
    return paged(around.join(graph.nodes, "id").select("direction", "type", "id", "label", "name", "file_path"), ["direction", "type", "name", "id"], page_size, 200, cursor)


def entity_detail(graph: Graph, entity: str, label: str) -> DataFrame:
    """One entity with its edges counted by direction and type; without edges, one row with a null type."""
    one_of(label, [*LABELS, "Template", "SpecFile", "Project"], "label")
    node = graph.labelled(label).where(F.col("id") == entity).select("id", "label", "name", "file_path")
    end = lambda near, far, way: graph.edges.where(F.col(near) == entity).select(F.col(near).alias("id"), F.lit(way).alias("direction"), "type", F.col(far).alias("other"))
    around = end("src", "dst", "out").unionByName(end("dst", "src", "in")).groupBy("id", "direction", "type").agg(F.count_distinct("other").alias("n"))
    return node.join(around, "id", "left")


def class_members(members: DataFrame, owner: str, file_path: str | None = None, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """members(owner, file_path, name, kind, …) of a class, methods and properties in one list."""
    needed(owner=owner)
    return paged(all_of(members, owner=owner, file_path=file_path), ["kind", "name"], limit, 100, cursor)


def template_bindings(bindings: DataFrame, template: str) -> DataFrame:
    """bindings(path, kind, name) of a template by member, with the kinds in order."""
    return bindings.where(F.col("path") == template).groupBy(F.col("name").alias("member")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


def di_consumers(graph: Graph, service: str, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """Who has a service of exactly this name injected."""
    target = graph.nodes.where(F.col("name") == service).select(F.col("id").alias("dst"))
    rows = graph.typed("INJECTS").join(target, "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(graph.nodes, "id").select("id", "name", F.col("label").alias("kind"), "file_path")
    return paged(rows, ["name", "id"], limit, 100, cursor)


def injections(graph: Graph, symbol: str, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    rows = graph.typed("INJECTS").where(F.col("dst") == symbol).select(F.col("src").alias("id")).distinct().join(graph.nodes, "id").select("id", "label", "name")
    return paged(rows, ["name", "id"], page_size, 100, cursor)


def template_usages(graph: Graph, symbol: str, kinds: list[str], page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """Templates that use a symbol, by id, with the kind of use."""
    used = graph.typed(*kinds).where(F.col("dst") == symbol).groupBy(F.col("src").alias("id")).agg(F.min("type").alias("binding_type"))
    return paged(used.join(graph.labelled("Template").select("id", "name"), "id"), ["id"], page_size, 100, cursor)


def test_coverage(graph: Graph, target: str, kinds: list[str], page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """Specs that test something of this name."""
    aim = graph.nodes.where(F.col("name") == target).select(F.col("id").alias("dst"))
    specs = graph.typed(*kinds).join(aim, "dst", "left_semi").select(F.col("src").alias("id"), F.col("type").alias("via")).distinct()
    return paged(specs.join(graph.labelled("SpecFile").select("id", "name"), "id"), ["id", "via"], page_size, 100, cursor)


def impact_of(graph: Graph, symbol: str | None = None, file_path: str | None = None, depth: int = 5, tests: bool = False, project: str | None = None, summary: bool = True, page_size: int = 50, cursor: str | None = None) -> DataFrame:
    """A page of what a change of a symbol or file reaches, with the counts of each class beside it.

    A symbol that no node has gives no row. `summary` leaves the chains of edges out.
    """
    needed(symbol=symbol, file_path=file_path)
    in_range(depth, 1, 20, "depth")
    seeds = graph.nodes.where(F.col("id") == symbol if symbol else F.col("file_path") == file_path).select("id")
    hits = impact(graph, seeds, depth=depth, tests=tests)
    hits = hits if project is None else in_project(hits, graph, project)
    counts = hits.agg(*(F.count_if(F.col("impact_class") == k).alias(f"n_{k.replace('-', '_')}") for k in ("direct", "indirect", "template-derived", "structural")))
    columns = ["id", "label", "name", "depth", "impact_class", "is_test", *([] if summary else ["edge_chain"])]
    return paged(hits.select(*columns), ["depth", "id"], page_size, 200, cursor).crossJoin(F.broadcast(counts))


def reached(graph: Graph, symbol: str, direction: str, depth: int = 3, kinds: list[str] | None = None, project: str | None = None, tests: bool = True, minimal: bool = True, page_size: int = 20, cursor: str | None = None) -> DataFrame:
    """Dependents (in) or dependencies (out) of a symbol, nearest first."""
    one_of(direction, ["in", "out"], "direction")
    in_range(depth, 1, 20, "depth")
    for k in kinds or []:
        one_of(k, ELIGIBLE, "kinds")
    found = traverse(graph, graph.nodes.where(F.col("id") == symbol).select("id"), direction, depth, kinds, tests)
    rows = of_project(found.join(graph.nodes, "id"), "id", graph, project)
    return paged(rows.select("id", "label", "name", "depth", *([] if minimal else ["edge_chain"])), ["depth", "id"], page_size, 100, cursor)


def project_dependencies(edges: DataFrame, project: str | int | None = None, direction: str = "both") -> DataFrame:
    """edges(src, dst, import_count) of one project in a direction, or of all."""
    one_of(direction, ["in", "out", "both"], "direction")
    if project is None:
        return edges
    out, into = F.col("src") == project, F.col("dst") == project
    return edges.where({"out": out, "in": into, "both": out | into}[direction])


def metrics_of(graph: Graph, entity: str) -> DataFrame:
    """Coupling of one entity; zeros where nothing is coupled with it."""
    near = Graph(graph.nodes, graph.edges.where((F.col("src") == entity) | (F.col("dst") == entity)))
    return symbol_metrics(near, graph.nodes.where(F.col("id") == entity))


def standalone_candidates(candidates: DataFrame, graph: Graph | None = None, project: str | None = None, candidates_only: bool = False, blockers: bool = True, page_size: int = 50, cursor: str | None = None) -> DataFrame:
    """candidates(id, name, is_candidate, blockers, …), whose summary counts all of them whatever is asked for."""
    summary = candidates.agg(F.count("*").alias("n_all"), F.count_if("is_candidate").alias("n_candidates"))
    rows = candidates if graph is None else of_project(candidates, "id", graph, project)
    rows = rows.where("is_candidate") if candidates_only else rows
    confidence = F.when(F.col("blockers") == "", 0.95).otherwise(0.90)
    return paged(rows.withColumn("confidence", confidence).drop(*([] if blockers else ["blockers"])), ["name", "id"], page_size, 200, cursor).crossJoin(F.broadcast(summary))


def migration_findings(findings: DataFrame, type: str | None = None, category: str | None = None, severity: str | None = None, scope: str | None = None, node: str | None = None, least: float = 0.0, page_size: int = 50, cursor: str | None = None) -> DataFrame:
    """Findings by any of these, the most severe first, with the number of each severity among them."""
    one_of(type, ["blocker", "risk", "opportunity"], "type")
    one_of(category, ["angular", "rxjs", "template", "architecture"], "category")
    in_range(least, 0, 1, "least")
    rows = all_of(findings, type=type, category=category, severity=severity, scope=scope, node_id=node).where(F.col("confidence") >= least)
    counts = rows.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low")))
    page = paged(rows.select("id", "type", "category", "severity", "reason_code", "confidence", "scope", "node_id"), [severity_rank(F.col("severity")), "category", "id"], page_size, 200, cursor)
    return page.crossJoin(F.broadcast(counts))


def deprecated_patterns(findings: DataFrame, category: str | None = None, severity: str | None = None, scope: str | None = None, n: int = 5) -> DataFrame:
    """The commonest reasons among findings on deprecated uses, with the number of all such findings."""
    one_of(category, ["angular", "rxjs"], "category")
    rows = all_of(findings.where("is_deprecated"), category=category, severity=severity, scope=scope)
    return fd.top_reasons(rows, n).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def migration_order(nodes: DataFrame, edges: DataFrame, page_size: int = 100, cursor: str | None = None) -> DataFrame:
    """A page of nodes in the order of migration, level by level, with the size of the level; what a cycle blocks comes last
    with a null level."""
    level = topo.levels(nodes, edges)
    size = level.groupBy("level").agg(F.count("*").alias("n_level"))
    rows = nodes.select("id").distinct().join(level.join(size, "level"), "id", "left").select("id", "level", F.coalesce("n_level", F.lit(0)).alias("n_level"), F.col("level").isNull().alias("is_blocked"))
    return paged(rows, [F.col("level").asc_nulls_last(), "id"], page_size, 500, cursor)


def migration_summary(findings: DataFrame, artifacts: DataFrame, modules: DataFrame | None = None, order: DataFrame | None = None, graph: Graph | None = None, project: str | None = None, seeds: int = 0) -> DataFrame:
    """One row on how far the graph is ready, and the ids of the first work items if asked for.

    artifacts: id, is_candidate, is_standalone of components, directives and pipes; modules: id, score, feasibility;
    order: id, level. A project leaves out what isn't in it, but for findings, which count as a whole.
    """
    kind = lambda column, k, name: F.count_if(F.col(column) == k).alias(name)
    within = lambda rows: rows if graph is None else of_project(rows, "id", graph, project)
    blocked = F.count_if(~F.col("is_candidate") & ~F.col("is_standalone"))
    parts = [
        within(artifacts).agg(F.count("*").alias("n_artifacts"), F.count_if("is_candidate").alias("n_candidates"), F.count_if("is_standalone").alias("n_standalone"), blocked.alias("n_blocked"), fd.readiness(F.count_if("is_candidate"), blocked).alias("readiness")),
        findings.agg(
            F.count("*").alias("total"), kind("type", "blocker", "blockers"), kind("type", "risk", "risks"), kind("type", "opportunity", "opportunities"), kind("scope", "production", "n_production"), kind("scope", "test", "n_test"),
            F.count_if("is_deprecated").alias("n_deprecated"), *(F.count_if(F.col("is_deprecated") & (F.col("severity") == s)).alias(f"deprecated_{s}") for s in ("critical", "high", "medium", "low")),
            F.count_distinct(F.when(F.col("reason_code") == "ARCH_CIRCULAR_DEPENDENCY", F.col("node_id"))).alias("n_on_cycles"),
        ),
        fd.top_reasons(findings.where("is_deprecated")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason_code"))), lambda x: x["reason_code"]), ",").alias("top_reasons")),
    ]
    if modules is not None:
        parts.append(within(modules).agg(F.count("*").alias("n_modules"), F.coalesce(half_up(F.avg("score"), 1), F.lit(0.0)).alias("mean_score"), *(kind("feasibility", k, f"modules_{k}") for k in ("high", "medium", "low", "blocked"))))
    if order is not None:
        parts.append(within(order.where("level IS NOT NULL")).agg(F.count("*").alias("n_ordered"), F.count_distinct("level").alias("n_waves")))
    if seeds:
        parts.append(fd.work_items(findings).orderBy("priority", "id").limit(seeds).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("seeds")))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # each part is one row


def package_compatibility(classified: DataFrame, severity: str | None = None, page_size: int = 50, cursor: str | None = None) -> DataFrame:
    """classified(name, installed, required, reason_code, severity, confidence) with the type of finding that each one is.

    Blockers come first, then the surest, then by name.
    """
    kind = F.when(F.col("severity") == "critical", "blocker").otherwise("risk")
    rows = all_of(classified, severity=severity).withColumn("kind", kind)
    return paged(rows, [F.when(F.col("kind") == "blocker", 0).otherwise(1), F.desc("confidence"), "name", "installed"], page_size, 200, cursor)


def migration_tasks(items: DataFrame, links: DataFrame, type: str | None = None, limit: int = 200) -> DataFrame:
    """The first work items (id, severity, type, …) in batches: an item comes after those that it is linked to."""
    one_of(type, ["blocker", "risk", "opportunity"], "type")
    in_range(limit, 1, 500, "limit")
    some = all_of(items, type=type).orderBy("id").limit(limit)
    among = links.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi")
    return topo.batches(some.select("id"), among).join(some.select("id", priority(F.col("severity")).alias("priority")), "id")
