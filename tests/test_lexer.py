"""What is code and what is text, definitions inside lines, and calls where only a scan of the whole file can tell them."""

import pytest
from pyspark.sql import functions as F

from codestrata.functions import lexer
from codestrata.operators import extract

FILES = [
    ("a.ts", "TypeScript", """\
export class Store { get(id: string) { return load(id); } put(x: Item) { save(x); } }
class Plain { one() { a(); } }  export function after(x: number) { b(); }
const pattern = /[(){}`'"]+\\/(/g, half = total / 2 / count;
export function templates(x: string) {
  return `start ${outer(`inner ${nested(x)} } {`)} never(1) {`;
}
export function generic<T>(
  x: T,
  y: Map<string, T[]>,
): T {
  return run<T>(x) || make<Map<string, T>>(y) || (i < n && j > (k));
}
const text = `
function notOne() {
  ${real(1)}
`;
export function last() { return 'it\\'s'.replace(/'/g, quote("}")); }
"""),
    ("b.tsx", "TypeScript", """\
export function Card(props: P) {
  return <p title='a "b'>don't {load(props.id)} they're at http://x.org/y {show()} <br/> </p>;
}
export const Row = (p: P) => <a href={link(p)}>{p.n / 2} of {p.m / fold(3)}</a>;
"""),
    ("c.py", "Python", '''\
def one(a,
        b=")"):
    """Docs with def fake(): and call(1)
def two():
    """
    text = r'not(a)call \\d' + real(a)  # other(x)
    return f"{x}" \'\'\'
three(
\'\'\' + four(5)


class C: x = make(1)
'''),
    ("D.java", "Java", """\
public class D { public int first(int a) { return g(a); } private void second() throws E { h('{', "}"); } }
interface Shape { double area(); String name(int n); }
enum Mark { A, B }  record Pair(int a, int b) { int sum() { return add(a, b); } }
class Late {
    String text = \"\"\"
        class Fake { void no() { never(); } }
        \"\"\";
    @Get("/x") public <T> List<T>
        spread(
            Map<String, List<T>> m,
            int n) {
        return new Box<T>(wrap(m));
    }
}
"""),
    ("e.go", "Go", """\
package e

func A(x int) int { return b(x) }; func C() { d("}") }
type T struct { n int }; type I interface { Read() error }
var raw = `
func Fake() { never() }
`
func (s *T) Long(
	a int,
	b map[string]func(int) error,
) error {
	return use('{', `(`, s.n)
}
"""),
]
EXPECTED = {
    ("a.ts", "Store", "class", 1, 1, None), ("a.ts", "get", "method", 1, 1, "Store"), ("a.ts", "put", "method", 1, 1, "Store"),
    ("a.ts", "Plain", "class", 2, 2, None), ("a.ts", "one", "method", 2, 2, "Plain"), ("a.ts", "after", "function", 2, 2, None),
    ("a.ts", "templates", "function", 4, 6, None), ("a.ts", "generic", "function", 7, 12, None), ("a.ts", "last", "function", 17, 17, None),
    ("b.tsx", "Card", "component", 1, 3, None), ("b.tsx", "Row", "component", 4, 4, None),
    ("c.py", "one", "function", 1, 9, None), ("c.py", "C", "class", 12, 12, None),
    ("D.java", "D", "class", 1, 1, None), ("D.java", "first", "method", 1, 1, "D"), ("D.java", "second", "method", 1, 1, "D"),
    ("D.java", "Shape", "interface", 2, 2, None), ("D.java", "area", "method", 2, 2, "Shape"), ("D.java", "name", "method", 2, 2, "Shape"),
    ("D.java", "Mark", "enum", 3, 3, None), ("D.java", "Pair", "class", 3, 3, None), ("D.java", "sum", "method", 3, 3, "Pair"),
    ("D.java", "Late", "class", 4, 14, None), ("D.java", "spread", "method", 8, 13, "Late"),
    ("e.go", "A", "function", 3, 3, None), ("e.go", "C", "function", 3, 3, None), ("e.go", "T", "class", 4, 4, None), ("e.go", "I", "interface", 4, 4, None),
    ("e.go", "Long", "method", 8, 13, "T"),
}
CALLS = {
    ("a.ts", "get"): ["load"], ("a.ts", "put"): ["save"], ("a.ts", "one"): ["a"], ("a.ts", "after"): ["b"], ("a.ts", "templates"): ["outer", "nested"],
    ("a.ts", "generic"): ["run", "make"], ("a.ts", "last"): ["replace", "quote"], ("b.tsx", "Card"): ["load", "show"], ("b.tsx", "Row"): ["link", "fold"],
    ("c.py", "one"): ["real", "four"], ("D.java", "first"): ["g"], ("D.java", "second"): ["h"], ("D.java", "sum"): ["add"], ("D.java", "spread"): ["wrap"],
    ("e.go", "A"): ["b"], ("e.go", "C"): ["d"], ("e.go", "Long"): ["use"],
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("r", *f) for f in FILES], "repository_id string, path string, language string, content string")
    return extract.extract_entities(files).collect()


def test_definitions(found):
    got = {(r.file_path, r.symbol_name, r.symbol_type, r.start_line, r.end_line, r.parent) for r in found}
    assert got == EXPECTED
    assert {r.symbol_name for r in found if r.exported and r.file_path == "a.ts"} == {"Store", "get", "put", "after", "templates", "generic", "last"}


def test_calls(found):
    assert {(r.file_path, r.symbol_name): r.calls for r in found if r.calls} == CALLS


def test_content_is_whole_lines(found):
    lines = {path: text.split("\n") for path, _, text in FILES}
    for r in found:
        assert r.content == "\n".join(lines[r.file_path][r.start_line - 1:r.end_line])


@pytest.mark.parametrize(("language", "text", "code"), [
    ("TypeScript", "a = b / c / d; e = /f(/; return /g{/i.test(h)", "a = b / c / d; e = /  /; return /   /.test(h)"),
    ("TypeScript", "x = (a) / 2 + '/'.length / 3 // not(a)call", "x = (a) / 2 + ' '.length / 3 " + " " * 13),
    ("JavaScript", "`a${b(`c${d}`)}e`", "`  {b(`  {d}`)} `"), ("JavaScript", "'open\nclosed'", "'open\nclosed'"),
    ("JavaScript", "`never ends ${x", "`            {x"), ("JavaScript", "return'it(s)'", "return'     '"),
    ("Python", "x = '#' # a(b", "x = ' '      "), ("Python", 'y = """a"b""" + c', 'y = "       " + c'),
    ("Java", "char c = '\\''; /* ( */ d", "char c = '  ';         d"), ("Go", "r := `\\` + \"a`\"", "r := ` ` + \"  \""),
    ("Go", "", ""), ("Java", "/* never ends", " " * 13),
])
def test_code(language, text, code):
    assert lexer.code_of(text, language)[0] == code


@pytest.mark.parametrize("language", ["TypeScript", "Python", "Java", "Go"])
def test_any_text_keeps_its_places(language):
    """Whatever is scanned: as long as before, the same line ends, and the pieces of a line make up the line."""
    import random

    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("ab({[]})'\"`\\/*$#;:\n <>=é1") for _ in range(60))
        code, _ = lexer.code_of(text, language)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        made = lexer.pieces(text, language)
        assert [p[0] for p in made] == sorted(p[0] for p in made) and {p[0] for p in made} == set(range(1, text.count("\n") + 2))
        for n, line in enumerate(text.split("\n"), 1):
            assert "".join(p[1] for p in made if p[0] == n).replace(" ", "") == line.replace(" ", "")


def test_columns(spark):
    df = spark.createDataFrame([("Go", "f(`(`)"), ("Rust", "f('"), ("Python", None)], "language string, content string")
    got = {r.language: r.code for r in df.select("language", lexer.file_code(F.col("content"), F.col("language")).alias("code")).collect()}
    assert got == {"Go": "f(` `)", "Rust": "f('", "Python": ""}
