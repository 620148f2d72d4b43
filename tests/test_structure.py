"""Symbols, members, calls and tokens from sources: shapes of small applications, and random nesting whose truth is known as it is made."""

import random

from graphweft.operators import structure as st

SERVICE = """
import { Injectable } from '@angular/core';
/** class Comment { no() { this.never(); } } */
@Injectable({ providedIn: 'root', note: '}' })
export class UserService extends BaseService implements OnInit, Store<Map<string, number>> {
  private readonly url: string = '/api/{id}/class X { }';
  static count = 0;
  @Input() id!: number;
  @Output() saved = new EventEmitter<{ a: string }>();
  @HostBinding('class.on') on?: boolean;
  handler = (x: number) => { this.notCounted(); };
  #hidden = 1;
  [key: string]: unknown;
  constructor(private http: HttpClient, @Inject(TOKEN) token: string) { this.inConstructor(); }
  get total(): number { return this.inAccessor(); }
  getUser(id: number): Observable<User> {
    // this.commented()
    const s = "this.quoted()" + /this\\.regex\\({/.source;
    return this.http.get<User>(`${this.url}/${this.format(id)}`).pipe(
      map((u) => { return this.toModel(u); }),
    );
  }
  protected static async load<T>(items: T[], f = this.asDefault()): Promise<Map<string, T>> {
    if (items.length) { for (const i of items) { await this.save(i); this.store?.put(i); } }
    this.a.b.c(); other.this_(); this.list[0](); this.cb?.(1);
  }
  private overloaded(a: string): void;
  private overloaded(a: any): void {}
}
abstract class BaseService<T extends { id: number } = any> {
  protected readonly tag: string = 'base';
  abstract fetchAll(): Promise<unknown[]>;
  protected log(msg: string): void { console.log(`[${this.tag}] ${msg}`); }
}
export interface User { id: number; name(): string }
function loose() { const c = { m() { this.outside(); } }; }
export default class extends Base { lost() {} }
"""
TOKENS = """
import { InjectionToken } from '@angular/core';
export const API_URL = new InjectionToken<string>('Base URL, of the API');
const PLAIN = new InjectionToken("plain"), CONFIG: InjectionToken<Map<string, X>> = new InjectionToken<Map<string, X>>('config', { factory: () => 1 });
let other = new Other('x');
function f() { const INNER = new InjectionToken('inner'); }
"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_symbols(spark):
    got = {r["id"]: r for r in st.symbols(frame(spark, ("a.ts", SERVICE), ("empty.ts", ""), ("none.ts", None))).collect()}
    p = "a.ts::Property::UserService."
    m = "a.ts::Method::UserService."
    assert set(got) == {
        "a.ts::Class::UserService", "a.ts::Class::BaseService", "a.ts::Interface::User", p + "url", p + "count", p + "id", p + "saved", p + "on", p + "handler", m + "getUser", m + "load", m + "overloaded",
        "a.ts::Property::BaseService.tag", "a.ts::Method::BaseService.fetchAll", "a.ts::Method::BaseService.log",
    }
    assert got["a.ts::Class::UserService"]["is_exported"] and not got["a.ts::Class::UserService"]["is_abstract"]
    assert got["a.ts::Class::BaseService"]["is_abstract"] and not got["a.ts::Class::BaseService"]["is_exported"]
    assert got["a.ts::Interface::User"]["is_exported"] and got["a.ts::Interface::User"]["is_abstract"] is None
    facts = lambda k: tuple(got[k][c] for c in ("is_public", "is_static", "is_input", "is_output", "type"))
    assert facts(p + "url") == (False, False, False, False, "string") and facts(p + "count") == (True, True, False, False, None)
    assert facts(p + "id") == (True, False, True, False, "number") and facts(p + "saved") == (True, False, False, True, None)
    assert facts(p + "on") == (True, False, False, False, "boolean") and facts(m + "getUser") == (True, False, None, None, "Observable<User>")
    assert facts(m + "load") == (False, True, None, None, "Promise<Map<string, T>>") and facts("a.ts::Method::BaseService.fetchAll") == (True, False, None, None, "Promise<unknown[]>")


def test_edges(spark):
    files = frame(spark, ("a.ts", SERVICE))
    got = {(r["type"], r["src"], r["dst"], r["pending_name"]) for r in st.symbol_edges(files).collect()}
    owner = "a.ts::Class::UserService"
    assert {(t, n) for t, s, _, n in got if s == owner and n} == {("EXTENDS", "BaseService"), ("IMPLEMENTS", "OnInit"), ("IMPLEMENTS", "Store")}
    ids = {r["id"] for r in st.symbols(files).collect()}
    assert {d for t, _, d, _ in got if t in ("HAS_METHOD", "HAS_PROPERTY", "DECLARES_SYMBOL")} == ids and {s for t, s, _, _ in got if t == "HAS_METHOD"} == {owner, "a.ts::Class::BaseService"}


def test_calls(spark):
    got = {(r["src"].split("::")[2], r["dst"] and r["dst"].split("::")[2], r["pending_name"], r["via"], r["line"]) for r in st.method_calls(frame(spark, ("a.ts", SERVICE))).collect()}
    first = SERVICE.split("\n").index("    return this.http.get<User>(`${this.url}/${this.format(id)}`).pipe(") + 1
    save = next(i for i, x in enumerate(SERVICE.split("\n"), 1) if "this.save(i)" in x)
    assert got == {
        ("UserService.getUser", None, "get", "http", first), ("UserService.getUser", "UserService.format", None, None, first), ("UserService.getUser", "UserService.toModel", None, None, first + 1),
        ("UserService.load", "UserService.save", None, None, save), ("UserService.load", None, "put", "store", save), ("UserService.load", "UserService.cb", None, None, save + 1),
    }


def test_tokens(spark):
    files = frame(spark, ("t.ts", TOKENS))
    assert {(r["id"], r["description"]) for r in st.injection_tokens(files).collect()} == {("t.ts::InjectionToken::API_URL", "Base URL, of the API"), ("t.ts::InjectionToken::PLAIN", "plain"), ("t.ts::InjectionToken::CONFIG", "config")}
    assert st.token_edges(files).count() == 3


class Maker:
    """Writes a file and notes down its classes, members and calls."""

    def __init__(self, seed):
        self.rng, self.lines, self.members, self.calls = random.Random(seed), [], set(), set()

    def noise(self):
        return self.rng.choice(["'}{'", '"this.no()"', "`{ ${a} }`", "/* } this.no() { */ 1", "[1, (2)]", "{ a: { b: 1 } }", "/[{]\\/}/", "x < y ? '(' : \")\"", "'it\\'s }'", "// }\n 1"])

    def write(self, text):
        self.lines.append(text)

    def at(self):
        return "\n".join(["", *self.lines]).count("\n") + 2  # the line that the next text begins on

    def block(self, caller, depth):
        for _ in range(self.rng.randint(1, 4)):
            kind = self.rng.randrange(5)
            if kind == 0 and depth < 4:
                self.write(self.rng.choice(["if (a) {", "for (;;) {", "const f = () => {", "list.forEach((x) => {"]))
                opener = self.lines[-1]
                self.block(caller, depth + 1)
                self.write("});" if opener.startswith("list") else "}")
            elif kind == 1:
                self.calls.add((caller, f"m{(k := self.rng.randrange(9))}", None, self.at()))
                self.write(f"this.m{k}({self.rng.choice(['', '1, 2', 'x'])});")
            elif kind == 2:
                self.calls.add((caller, f"m{(k := self.rng.randrange(9))}", "dep", self.at()))
                self.write(f"const r = this.dep.m{k}{self.rng.choice(['', '<A, B<C>>'])}(x);")
            elif kind == 3:
                self.calls.add((caller, "fmt", None, self.at()))
                self.write("const s = `a ${this.fmt('}')} { b`;")
            else:
                self.write(f"const n = {self.noise()};")

    def file(self):
        for c in range(self.rng.randint(1, 3)):
            self.write(self.rng.choice(["@Component({ template: '<a>{{ b }}</a>' })", "// class No {", "const o = { class: 1 };", "function g() { return { x: '{' }; }"]))
            self.write(f"export class C{c} extends B<{{ x: 1 }}> implements I {{" if self.rng.random() < 0.2 else f"export class C{c} {{")
            for k in range(self.rng.randint(1, 5)):
                if self.rng.random() < 0.4:
                    self.members.add((f"C{c}.p{k}", "Property"))
                    self.write(f"{self.rng.choice(['', 'private ', '@Input() '])}p{k}{self.rng.choice(['', ': string', '?: A | B'])} = {self.noise()}\n;")
                else:
                    self.members.add((f"C{c}.f{k}", "Method"))
                    self.write(f"{self.rng.choice(['', 'async ', 'protected static '])}f{k}(a = {self.rng.choice(['1', '{ b: 1 }', '[2]'])}){self.rng.choice(['', ': Promise<void>'])} {{")
                    self.block(f"C{c}.f{k}", 0)
                    self.write("}")
            self.write("}")
        return "\n".join(["", *self.lines])


def test_random_nesting(spark):
    made = {f"f{i}.ts": Maker(i) for i in range(60)}
    files = frame(spark, *((p, m.file()) for p, m in made.items()))
    members = {tuple(r["id"].split("::")) for r in st.symbols(files).where("label IN ('Method', 'Property')").collect()}
    assert members == {(p, kind, name) for p, m in made.items() for name, kind in m.members}
    calls = {(*r["src"].split("::")[::2], r["pending_name"] or r["dst"].split(".")[-1], r["via"], r["line"]) for r in st.method_calls(files).collect()}
    assert calls == {(p, *c) for p, m in made.items() for c in m.calls}


def test_tokens_stay_in_their_file(spark):
    """What a file's tokens give is worked out in its row: no join, no window and no sort of tokens, and no file of theirs twice."""
    files = frame(spark, ("a.ts", SERVICE))
    for made in (st.symbols, st.symbol_edges, st.method_calls):
        plan = made(files)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(k in plan for k in ("Window", "Join", "Sort")) and plan.count("regexp_extract_all(content") == 1, made.__name__


def test_long_file_and_lines(spark):
    """Running sums over thousands of tokens, with calls on the lines where they are."""
    body = "".join(f"  f{i}() {{\n    if ([({i})]) {{ this.g{i}(); }}\n  }}\n" for i in range(500))
    got = {(r["src"].split(".")[-1], r["dst"].split(".")[-1], r["line"]) for r in st.method_calls(frame(spark, ("a.ts", f"class A {{\n{body}}}\n"))).collect()}
    assert got == {(f"f{i}", f"g{i}", 3 * i + 3) for i in range(500)}
