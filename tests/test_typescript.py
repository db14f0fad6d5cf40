import pytest

from ripplegraph.operators.graph import merge_edges, merge_nodes
from ripplegraph.operators.typescript import extract_source, index_repository, module_candidates

SOURCE = '''/** Doc. @invariant x: y */
import { a, type B, c as d } from "./m";
import type { Z } from './z';
import def, * as ns from "pkg";
export interface Foo { bar(x: number): string; }
export type T<X> = { a: X } | "s";
export const enum Color { Red, Green }
/** adds */
export async function add(x: { a: number }): Promise<{ b: number }> {
  const inner = (y: number) => { return a(y); };
  if (x) { foo(`t ${bar(1)} ${`n ${baz()}`} { `); } // gone(1)
  return d(inner(2)) / 3;
}
export default class K extends Base implements Foo {
  constructor(private q: number) { super(); init(); }
  bar(x: number): string { return this.help(x); }
  help(z: number) { return /re(g)\\//.test("x(1) {") ? a(z) : new Thing(z); }
}
const arrow = async (p: string): Promise<void> => {
  await ns.run(p);
};
const short = x => x + 1, other = 3;
let fn = function () { return 1; };
top(1);
'''


def test_symbols_imports_and_calls():
    symbols, imports, calls = extract_source(SOURCE)
    assert [(x[1], x[2], x[3], x[4], x[5]) for x in symbols] == [
        ("Foo", "interface", 5, 5, True), ("T", "type", 6, 6, True), ("Color", "enum", 7, 7, True), ("add", "function", 9, 13, True), ("inner", "function", 10, 10, False),
        ("K", "class", 14, 18, True), ("arrow", "function", 19, 21, False), ("short", "function", 22, 22, False), ("fn", "function", 23, 23, False),
    ]
    assert [x[6] for x in symbols if x[1] == "add"] == ["/** adds */"]
    assert [(s, n) for s, n, *_ in imports] == [("./m", ["a", "d"]), ("./z", []), ("pkg", ["def", "ns"])]
    assert {(c, f) for c, f, _, r in calls if r is None} == {("inner", "a"), ("add", "foo"), ("add", "bar"), ("add", "baz"), ("add", "d"), ("add", "inner"), ("K", "init"), ("K", "a"), (None, "top")}
    assert ("arrow", "run", 20, "ns") in calls


@pytest.mark.parametrize("text", ["", "}}}(((", "export function", "const = => {", "`${", "/* open", "import {", "class", "type X =", "'\\", "a" * 10_000])
def test_broken_text_does_not_raise(text):
    extract_source(text)


def test_module_candidates():
    assert module_candidates("src/a/b.ts", "../c.js")[:2] == ["src/c.js", "src/c.ts"] and module_candidates("src/a.ts", "pkg") == []


def test_repository_becomes_a_graph(spark):
    files = [
        ("src/m.ts", "/** Sums.\n * @capability Adding\n * @invariant total: never negative\n * @tag critical\n */\nexport function sum(a) { return inner(a); }\nfunction inner(a) { return a; }\n"),
        ("src/use.ts", 'import { sum } from "./m";\nimport * as m from "./m";\nexport const go = () => { m.sum(1); return sum(2); };\n'),
        ("test/m.test.ts", 'import { sum } from "../src/m";\nsum(1);\n'),
        ("docs/a.md", "---\ntype: adr\nstatus: deprecated\ncapabilities: [Adding]\ncontradicts: docs/b.md\n---\n# Why\n"),
        ("db/1.sql", "create table t (x int);\n-- @constraint total: sum >= 0\n"),
        ("readme.txt", "nothing"),
    ]
    n, e = index_repository(spark.createDataFrame(files, "rel_path string, content string"), "app")
    nodes = {r.id: r for r in merge_nodes(n).collect()}
    edges = {(r.kind, r.from_id, r.to_id): r for r in merge_edges(e).collect()}
    s = "sym:function:src/m.ts:sum:6"
    assert nodes[s].tags == ["critical"] and nodes[s].exported and nodes[s].kind == "function"
    assert nodes["inv:total"].metadata == {"statement": "never negative"} and set(nodes["inv:total"].tags) == {"from-code", "from-migration"} and len(nodes["inv:total"].evidence) == 2
    assert nodes["doc:docs/a.md"].tags == ["deprecated"] and nodes["cap:adding"].tags == ["from-code", "from-doc"] and nodes["mig:db/1.sql"].metadata == {"tables": "t"}
    want = {
        ("imports", "mod:src/use.ts", "mod:src/m.ts"), ("calls", "sym:function:src/use.ts:go:3", s), ("calls", s, "sym:function:src/m.ts:inner:7"), ("calls", "test:test/m.test.ts", s), ("tested_by", s, "test:test/m.test.ts"),
        ("covers", "test:test/m.test.ts", s), ("implements_capability", s, "cap:adding"), ("constrained_by", s, "inv:total"), ("related_to", "mig:db/1.sql", "inv:total"), ("contradicts", "doc:docs/a.md", "doc:docs/b.md"),
        ("decides", "doc:docs/a.md", "dec:docs-a-md"), ("documents", "doc:docs/a.md", "cap:adding"), ("belongs_to", "mod:src/m.ts", "repo:app"), ("declares", "mod:src/m.ts", s),
    }
    assert want <= set(edges) and len(edges[("calls", "sym:function:src/use.ts:go:3", s)].evidence) == 2


def test_calls_follow_names_renamed_on_import(spark, rows):
    files = [("src/m.ts", "export function pay() {}\nexport function charge() {}\n"), ("src/use.ts", 'import { pay as charge, type Odd as Even } from "./m";\nexport function go() { charge(); }\n'), ("test/m.test.ts", 'import { pay as p } from "../src/m";\np();\n')]
    assert [(n, o) for _, n, _, _, o in extract_source(files[1][1])[1]] == [(["charge"], ["pay"])]
    _, e = index_repository(spark.createDataFrame(files, "rel_path string, content string"), "app")
    assert rows(e.where("kind in ('calls', 'tested_by')"), "kind", "from_id", "to_id") == [("calls", "sym:function:src/use.ts:go:2", "sym:function:src/m.ts:pay:1"), ("calls", "test:test/m.test.ts", "sym:function:src/m.ts:pay:1")]
