"""Queries on symbols, calls, tokens and templates. Sources are made from the tables' rows, so SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.operators import structure as st
from graphweft.operators import templates as tp
from graphweft.plans.catalogue import query, table
from graphweft.plans.ingest import text

#: Fixed text of a class before its varying methods: brackets and calls in strings, templates, comments and patterns.
HEAD = """ * { */
@Component({ selector: 'a', template: '<b>{ }</b>' })
export class P#Component extends Base<{ a: 1 }> implements OnInit, Row<string> {
  private readonly url: string = '/a/{id}/class X { this.no() }';
  @Input() size?: number = ~;
  constructor(private http: HttpClient) { this.skip(); }
  get total(): number { return this.skipped(); }
  load(id: number): Observable<Part> {
    // this.gone() {
    if (id) { [1].forEach((x) => { this.check('}' + /[{]\\/}/.source); }); }
    return this.http.get<Part>(`${this.url}/${this.format(id)}`);
  }
  protected static check(x = this.noDefault()) { }
"""
TAIL = "}\nexport interface Row { id: number }\n"
#: Symbols of each such class, and its calls, with the lines where they begin.
MEMBERS = [
    ("Property", "url", False, False, False, "string"), ("Property", "size", True, False, True, "number"),
    ("Method", "load", True, False, None, "Observable<Part>"), ("Method", "check", False, True, None, None),
]
CALLS = [("load", "check", None, 11), ("load", "get", "http", 12), ("load", "format", None, 12)]
FIRST = 15


def classes(spark, d) -> DataFrame:
    """A class for each part, with p_size % 4 methods more."""
    k, n = F.col("p_partkey"), F.col("p_size") % 4
    more = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, text("  m", i, "(): void { this.load(", i, "); }\n")).otherwise("")), "")
    head = F.replace(F.replace(F.lit(HEAD), F.lit("#"), k.cast("string")), F.lit("~"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(text("src/p", k, ".ts").alias("path"), text("/* class No {\n", head, more, TAIL).alias("content"))


PATH = "'src/p' || p_partkey || '.ts'"
OWNER = "'P' || p_partkey || 'Component'"
null = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
values = lambda rows: ", ".join(f"({', '.join(map(null, r))})" for r in rows)
SYMBOLS_SQL = f"""
SELECT {PATH} || '::Class::' || {OWNER} AS id, 'Class' AS label, {OWNER} AS name, NULL AS class_name, true AS is_exported, NULL AS is_public, NULL AS is_static, NULL AS is_input, NULL AS type FROM part
UNION ALL SELECT {PATH} || '::Interface::Row', 'Interface', 'Row', NULL, true, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT {PATH} || '::' || label || '::' || {OWNER} || '.' || name, label, name, {OWNER}, NULL, is_public, is_static, is_input, type FROM part, (VALUES {values(MEMBERS)}) m(label, name, is_public, is_static, is_input, type)
UNION ALL SELECT {PATH} || '::Method::' || {OWNER} || '.m' || i, 'Method', 'm' || i, {OWNER}, NULL, true, false, NULL, 'void' FROM part, range(4) r(i) WHERE i < p_size % 4"""


@query(SYMBOLS_SQL)
def source_symbols(spark, d):
    """Classes, interfaces, methods and properties with their flags and types."""
    return st.symbols(classes(spark, d)).select("id", "label", "name", "class_name", "is_exported", "is_public", "is_static", "is_input", "type")


@query(f"""
WITH s AS ({SYMBOLS_SQL}), o AS (SELECT {PATH} AS path, {PATH} || '::Class::' || {OWNER} AS owner, {OWNER} AS name FROM part)
SELECT 'DECLARES_SYMBOL' AS type, substr(sha256(split_part(id, '::', 1)), 1, 16) AS src, id AS dst, NULL AS pending_name FROM s WHERE class_name IS NULL
UNION ALL SELECT CASE label WHEN 'Method' THEN 'HAS_METHOD' ELSE 'HAS_PROPERTY' END, owner, id, NULL FROM s JOIN o ON o.name = class_name
UNION ALL SELECT type, owner, NULL, pending_name FROM o, (VALUES ('EXTENDS', 'Base'), ('IMPLEMENTS', 'OnInit'), ('IMPLEMENTS', 'Row')) v(type, pending_name)""")
def source_symbol_edges(spark, d):
    return st.symbol_edges(classes(spark, d))


@query(f"""
WITH c AS (SELECT p_partkey, caller, callee, via, line FROM part, (VALUES {values(CALLS)}) v(caller, callee, via, line)
           UNION ALL SELECT p_partkey, 'm' || i, 'load', NULL, {FIRST} + i FROM part, range(4) r(i) WHERE i < p_size % 4)
SELECT {PATH} || '::Method::' || {OWNER} || '.' || caller AS src, CASE WHEN via IS NULL THEN {PATH} || '::Method::' || {OWNER} || '.' || callee END AS dst, CASE WHEN via IS NOT NULL THEN callee END AS pending_name, via, line FROM c""")
def source_method_calls(spark, d):
    """Calls on `this` and on what it holds, with their lines; those in comments, strings, accessors and defaults are none."""
    return st.method_calls(classes(spark, d)).drop("type")


@query("""
SELECT 'src/t' || n_nationkey || '.ts::InjectionToken::' || name AS id, name, CASE WHEN name = 'SECOND' THEN 'plain' ELSE n_name || ', of x; {' END AS description
FROM nation, (VALUES ('FIRST'), ('SECOND'), ('THIRD')) v(name) WHERE name <> 'THIRD' OR n_regionkey > 1""")
def injection_tokens(spark, d):
    """Tokens declared at the outermost level of a file, one or several in a statement."""
    third = F.when(F.col("n_regionkey") > 1, text("export const THIRD: InjectionToken<A> = new InjectionToken<Map<string, A>>('", F.col("n_name"), ", of x; {', { factory: () => new A(1) });\n")).otherwise("")
    content = text("const FIRST = new InjectionToken<string>('", F.col("n_name"), ", of x; {'), SECOND = new InjectionToken(\"plain\");\nlet no = new Other('x');\nfunction f() { const INNER = new InjectionToken('inner'); }\n", third)
    return st.injection_tokens(table(spark, d, "nation").select(text("src/t", F.col("n_nationkey"), ".ts").alias("path"), content.alias("content"))).drop("source_file")


# --- templates ---------------------------------------------------------------------------------------------------------

PAGE = """<ul #list><!-- {{ gone }} --><li *ngFor="let row of rows; index as i" [title]="row.name + heading" (click)="save(row, i, list)">{{ row.total | number }}{{ total }}<br>
<input [(ngModel)]="filter" placeholder="of {{ total }}"></li></ul><b [id]="'row' + row?.id">{{ row.name }}</b><x-~ glow [at]="total | money" />"""
#: What the template binds to in its class: kind, expression, name; `row` is the class's only outside the loop.
BOUND = [
    ("property", "row.name + heading", "heading"), ("event", "save(row, i, list)", "save"), ("interpolation", "total", "total"), ("two-way", "filter", "filter"), ("event", "filter", "filter"),
    ("property", "total", "total"), ("property", "''row'' + row?.id", "row"), ("interpolation", "row.name", "row"), ("property", "total | money", "total"),
]


def pages(spark, d) -> DataFrame:
    content = F.replace(F.lit(PAGE), F.lit("~"), F.lower("o_orderstatus"))
    return table(spark, d, "orders").select(text("o", F.col("o_orderkey"), ".html").alias("path"), content.alias("content"))


def page_owners(spark, d) -> tuple[DataFrame, DataFrame]:
    """The class of each template, and its members: those with even keys have no `filter`."""
    o = table(spark, d, "orders").select("o_orderkey", text("o", F.col("o_orderkey"), ".html").alias("path"), text("o", F.col("o_orderkey"), ".ts").alias("source_file"), text("C", F.col("o_orderkey")).alias("class_name"))
    names = [F.lit(n) for n in ("heading", "save", "total", "row", "i")]
    names = F.concat(F.array(*names), F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("filter"))).otherwise(F.array()))
    members = o.select("source_file", "class_name", F.explode(names).alias("name"))
    return o.drop("o_orderkey"), members.withColumn("id", text(F.col("source_file"), "#", F.col("name")))


@query(f"""
WITH b AS (SELECT o_orderkey, kind, expression, name FROM orders, (VALUES {', '.join(f"('{k}', '{e}', '{n}')" for k, e, n in BOUND)}) v(kind, expression, name) WHERE name <> 'filter' OR o_orderkey % 2 = 1)
SELECT DISTINCT t.type, 'o' || o_orderkey || '.html::Template::C' || o_orderkey AS src, 'o' || o_orderkey || '.ts#' || name AS dst, b.kind AS binding_type, expression
FROM b JOIN (VALUES ('interpolation', 'BINDS_TO'), ('property', 'BINDS_TO'), ('event', 'BINDS_TO'), ('two-way', 'BINDS_TO'), ('property', 'TEMPLATE_BINDS_PROPERTY'), ('two-way', 'TEMPLATE_TWO_WAY_BINDS'), ('event', 'TEMPLATE_BINDS_EVENT')) t(kind, type) USING (kind)""")
def template_member_edges(spark, d):
    """What templates bind to in their classes; names that a template has introduced itself never do."""
    return tp.template_edges(pages(spark, d), *page_owners(spark, d))[0]


@query("SELECT 'o' || o_orderkey || '.html' AS path, 'filter' AS name, 2 AS n FROM orders WHERE o_orderkey % 2 = 0")
def template_dropped_names(spark, d):
    return tp.template_edges(pages(spark, d), *page_owners(spark, d))[1]


@query("""
SELECT 'o' || o_orderkey || '.html' AS path, type, CASE WHEN type = 'USES_EXTERNAL' THEN substr(sha256('external|x-' || lower(o_orderstatus)), 1, 16) ELSE dst END AS dst
FROM orders, (VALUES ('USES_COMPONENT', 'c1'), ('USES_DIRECTIVE', 'd1'), ('USES_DIRECTIVE', 'd2'), ('USES_PIPE', 'p1'), ('USES_EXTERNAL', '')) v(type, dst)
WHERE (type <> 'USES_COMPONENT' OR o_orderstatus = 'O') AND (type <> 'USES_EXTERNAL' OR o_orderstatus <> 'O')""")
def template_uses(spark, d):
    """Elements, attributes and pipes whose selector and kind fit; a pipe's name on an element or a component's as an attribute is nothing."""
    known = [("x-o", "c1", "Component"), ("[glow]", "d1", "Directive"), ("li", "d2", "Directive"), ("money", "p1", "Pipe"), ("ul", "p2", "Pipe"), ("[at]", "d3", "Directive"), ("placeholder", "c2", "Component"), ("number", "p3", "Pipe")]
    return tp.usages(pages(spark, d), spark.createDataFrame(known, "selector string, id string, label string")).drop("selector")
