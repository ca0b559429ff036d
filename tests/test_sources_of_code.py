from corpuslens.operators import calls, complexity, pyfacts, symbols
from tests.conftest import rows_of


def names(make_files, path, content):
    r = symbols.modules(make_files({path: content})).collect()[0]
    return {k: list(r[k]) for k in symbols.ARRAYS}


def test_js(make_files):
    text = ('import "side"\nimport { a } from "b"\nimport D from "d"\nconst x = require("r")\nexport { q, w }\n'
            "export default class K extends B {}\nasync function f(a) {}\nconst g = async (a) => 1\n"
            "if (x) {\n}\nmethod(a) {\n}\nmodule.exports = K\n")
    assert names(make_files, "a.tsx", text) == {
        "imports": ["side", "b", "d", "r", "side"], "exports": ["K", "export { q, w }", "K"],
        "classes": ["K"], "functions": ["f", "g", "method"]}
    lines = symbols.jsts_definitions(make_files({"a.tsx": text}))
    assert rows_of(lines, "kind", "name", "line") == [
        ("class", "K", 6), ("function", "f", 7), ("function", "g", 8), ("function", "method", 11)]


def test_other_languages(make_files):
    assert names(make_files, "a.rs", "use std::io;\nextern crate c;\nfn f() {}\nstruct S;\nimpl T {}\n") == {
        "imports": ["std::io", "c"], "exports": [], "classes": ["S", "T"], "functions": ["f"]}
    assert names(make_files, "a.go", 'import (\n "a"\n x "b"\n)\nimport "c"\nfunc F() {}\nfunc (r R) M() {}\ntype S struct {}\n') == {
        "imports": ["a", "b", "c"], "exports": [], "classes": ["S"], "functions": ["F"]}
    assert names(make_files, "a.cs", "using A.B;\nclass C {}\n")["classes"] == ["C"]
    assert names(make_files, "a.php", "use A\\B;\nrequire x/y;\nclass C { function m() {} }")["imports"] == ["A\\B", "x/y"]
    assert names(make_files, "a.rb", "class C; def m; end; end") == {k: [] for k in symbols.ARRAYS}
    java = symbols.java_definitions(make_files({"A.java": "import a.b;\npublic final class A extends B implements C, D {\n}\n"}))
    r = java.collect()[0]
    assert (r["name"], list(r["bases"]), list(r["interfaces"]), r["line"]) == ("A", ["B"], ["C", "D"], 2)


def test_unicode_words(make_files):
    assert names(make_files, "a.php", "function größe() {}")["functions"] == ["größe"]


PY = """import a.b
from m import x
from . import y
@dec
class K(Base, mod.Other):
    def meth(self):
        self.go(1)
        def inner():
            call()
        inner()
async def top():
    obj.a.b()
    (1).bit_length()
outside()
"""


def test_python_symbols(make_files):
    facts = pyfacts.python_facts(make_files({"a.py": PY}))
    got = symbols.symbols_python(facts).orderBy("kind", "seq").collect()
    assert [(r["kind"], r["name"]) for r in got] == [
        ("class", "K"), ("function", "top"), ("function", "meth"), ("function", "inner"),
        ("import", "a.b"), ("import", "m.x"), ("import", "y")]
    definitions = {r["name"]: r for r in symbols.python_definitions(facts).collect()}
    assert list(definitions["K"]["bases"]) == ["Base", "Other"] and list(definitions["K"]["methods"]) == ["meth"]
    assert definitions["K"]["line"] == 5 and definitions["top"]["line"] == 11


def test_python_calls_belong_to_innermost_function(make_files):
    graph = calls.call_graph(calls.python_functions(pyfacts.python_facts(make_files({"a.py": PY}))))
    assert rows_of(graph, "fn_id", "callees") == [
        ("a.py::inner", ["call"]), ("a.py::meth", ["self.go", "inner"]), ("a.py::top", ["obj.a.b", ".bit_length"])]


def test_python_complexity_constructs(make_files):
    text = """def counted(a, b, c):
    if a and b and c:
        pass
    elif a or b:
        pass
    while a:
        assert b
    for x in a:
        try:
            pass
        except E:
            pass
def free(a):
    async def nested():
        async for x in a:
            pass
    y = [i for i in a if i]
    z = 1 if a else 2
    with a:
        match a:
            case 1:
                pass
def outer():
    def inner():
        if x:
            pass
"""
    got = rows_of(pyfacts.python_function_metrics(pyfacts.python_facts(make_files({"a.py": text}))), "fn", "complexity", "length")
    assert got == [("counted", 10, 11), ("free", 1, 9), ("inner", 2, 2), ("nested", 1, 2), ("outer", 2, 3)]


def test_bad_python_is_a_fact_not_a_failure(make_files):
    df = make_files({"bad.py": "def (:\n", "nul.py": "a\0b", "ok.py": "def f():\n    return 1\n"})
    facts = pyfacts.python_facts(df)
    assert rows_of(facts, "path", "parse_error") == [("bad.py", True), ("nul.py", True), ("ok.py", False)]
    assert rows_of(complexity.complexity(df, facts), "total_files", "total_lines", "total_functions", "max_complexity_file") == [(3, 2 + 1 + 3, 1, "ok.py")]


def test_complexity_ties_take_the_smallest_path(make_files):
    body = "def f():\n    if x:\n        pass\n"
    df = make_files({"z.py": body, "a/b.py": body, "m.js": "function a() {}\nclass B {}\n"})
    row = complexity.complexity(df, pyfacts.python_facts(df)).collect()[0]
    assert row["max_complexity_file"] == "a/b.py" and row["max_complexity"] == 2.0
    assert (row["total_functions"], row["total_classes"], row["avg_function_length"]) == (3, 1, 2.0)


def edges(make_files, path, text):
    return rows_of(calls.call_graph(calls.generic_functions(make_files({path: text}))), "fn", "callees")


def test_generic_calls(make_files):
    js = "before(1)\nfunction a(x) {\n  b(x); if (x) { c (x) }\n}\nconst d = e(1)\nfunction a(y) {\n  z(y)\n}\n"
    assert edges(make_files, "a.js", js) == [("a", ["a", "z"]), ("d", ["e"])]
    assert edges(make_files, "a.js", "function a() {} function b() { x() }\n") == [("a", []), ("b", ["a", "b", "x"])]
    assert edges(make_files, "a.go", "func (s *S) M(x int) {\n  go f(x)\n}\n") == [("M", ["func", "M", "f"])]
    assert edges(make_files, "A.java", "class A {\n  public void m(int x) { n(x); }\n void p() {}\n}") == [("m", ["m", "n", "p"])]
    assert edges(make_files, "a.rb", "def m\n  puts(1)\nend\n") == [("m", ["puts"])]
    assert edges(make_files, "a.jsx", "function a() {}\n") == []
    # white space of a definition or call does not run over a line end
    assert edges(make_files, "a.rs", "fn\nf() {\n g\n(1)\n}\nfn h() {}") == [("h", ["h"])]


def test_generic_counts(make_files):
    df = make_files({"a.c": "struct s {};\nfunc f\nfn g def h\n", "b.py": "class A: pass"})
    assert rows_of(complexity.generic_counts(df), "functions", "classes") == [(3, 1)]
    assert rows_of(complexity.code_totals(df), "total_files", "total_lines") == [(2, 5)]
