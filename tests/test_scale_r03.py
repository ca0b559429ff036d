"""Findings of round 3: work that grew with the square of a file, or with the size of the plan."""

import ast
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from checks.fixtures import corpus
from corpuslens import rules
from corpuslens.operators import architecture, calls, diagrams, manifests, pyfacts, retrieval, schemas, symbols
from tests.conftest import rows_of


def _seconds(df) -> float:
    start = time.perf_counter()
    df.agg(F.count("*")).collect()
    return time.perf_counter() - start


def test_the_primary_key_of_a_wide_table_is_found_once(make_files):
    def sql(n: int) -> str:
        return "CREATE TABLE t (\n" + "".join(f"  column_{i} VARCHAR(20),\n" for i in range(n)) + "  PRIMARY KEY (column_1)\n);"

    of = lambda n: schemas.db_columns(schemas.schema_sql(make_files({"a.sql": sql(n)})))
    _seconds(of(10))
    assert _seconds(of(20_000)) < 15
    assert rows_of(of(30).where("primary_key"), "column_name") == [("column_1",)]


def test_the_flag_of_a_wide_migration_is_found_once(make_files):
    def migration(n: int) -> str:
        return "op.create_table('t',\n" + "".join(f"  sa.Column('column_{i}', sa.Integer),\n" for i in range(n)) + "  sa.Column('z', sa.Text)\n)\n)"

    of = lambda text: schemas.db_columns(schemas.schema_alembic(make_files({"migrations/v.py": text})))
    _seconds(of(migration(10)))
    assert _seconds(of(migration(20_000))) < 15
    marked = "op.create_table('t', sa.Column('id', sa.Integer), sa.Column('my_id', sa.Integer), sa.Column('d', sa.Text), # my_id.*primary x.*primary\n)\n)"
    assert rows_of(of(marked), "column_name", "primary_key") == [("d", True), ("id", True), ("my_id", True)]
    other = marked.replace("'d'", "'my'").replace("x.*primary", "id .*primary")
    assert rows_of(of(other), "column_name", "primary_key") == [("id", True), ("my", False), ("my_id", True)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_dependency_diagram_reads_its_inputs_few_times(spark):
    deps = spark.createDataFrame([("r", "npm", "a[b]"), ("r", "npm", "c"), ("s", "pypi", "d")], "repo_id string, source string, name string")
    stats = spark.createDataFrame([("r", "Go", 5), ("t", "C", 9), ("t", "Rust", 3)], "repo_id string, language string, lines int")
    got = diagrams.dependency_diagram(deps.where("name <> 'never_a_name'"), stats.where("language <> 'NoLanguage'"))
    assert _plan(got).count("never_a_name") <= 2 and _plan(got).count("NoLanguage") <= 1
    lines = [(r["repo_id"], r["line"].strip()) for r in got.orderBy("repo_id", *diagrams.DEPENDENCY_LINE_ORDER).collect()]
    start, end = ["graph LR", "subgraph Project[Project Dependencies]"], ["end"]
    assert [x for r, x in lines if r == "r"] == [
        *start, "subgraph npm[NPM - 2 deps]", "a_b_[<b>ab</b>]", "c[<b>c</b>]", "end", *end, "subgraph Lang[Languages]", "Go[<b>Go</b>]", "end"]
    assert [x for r, x in lines if r == "s"] == [*start, "subgraph pypi[PYPI - 1 deps]", "d[<b>d</b>]", "end", *end]
    assert [x for r, x in lines if r == "t"] == [*start, *end, "subgraph Lang[Languages]", "C[<b>C</b>]", "Rust[<b>Rust</b>]", "end"]


def test_a_text_is_folded_once_for_all_indicators(make_files):
    hits = architecture.arch_content_hits(make_files({"a.md": "Controllers, MESSAGE  broker, ſervice - x, front-end"}))
    assert hits._jdf.queryExecution().executedPlan().toString().count("translate(") <= 1
    assert rows_of(hits, "pattern", "rule_no") == [
        ("Client-Server", 2), ("Event-Driven Architecture", 1), ("MVC", 0), ("Microservices", 1)]


def test_every_match_of_an_indicator_holds_one_of_its_literals():
    """Spaces in the pattern are optional, so the shortest form of each alternative is tried, and a longer one."""
    for (_, bodies), literals in zip(rules.ARCHITECTURES, rules.ARCHITECTURE_LITERALS, strict=True):
        for body, found in zip(bodies, literals, strict=True):
            plain = re.sub(r"\\b|\\s\*|\(\?:ness\)\?|s\?", "", body).replace(r"\w+", "x")
            outer = [plain] if "(?:" in plain else plain.split("|")
            forms = []
            for one in outer:
                m = re.search(r"\(\?:(.*?)\)", one)
                forms += [one.replace(m[0], x) for x in m[1].split("|")] if m else [one]
            for form in forms:
                assert re.search(body, form), (body, form)
                assert any(x in form for x in found), (body, form, found)


def test_members_copy_no_class_for_each_salt(spark):
    questions = spark.createDataFrame([(1, "r", "alpha beta gamma?"), (2, "r", "delta of beta")], "q_id long, repo_id string, text string")
    texts = {"a.md": "alpha x", "b.md": "alpha y", "c.md": "beta gammas", "d.md": "nothing"}
    previews = spark.createDataFrame([("r", p, p, t) for p, t in texts.items()], "repo_id string, path string, name string, preview string")
    modules = spark.createDataFrame([("r", "e.py", "delta", [], [])], "repo_id string, path string, name string, classes array<string>, functions array<string>")
    found = retrieval.MatchClasses(retrieval.question_keywords(questions), previews, modules)
    assert rows_of(found.members, "class", "path") == [("a.md", "a.md"), ("a.md", "b.md"), ("c.md", "c.md"), ("e.py", "e.py")]
    join = next(x for x in _plan(found.members).split("\n") if "Join" in x)
    assert "_salt" not in join and "in_content" not in join
    assert rows_of(found.postings, "class", "kw", "c", "m") == [("a.md", "alpha", 1, 0), ("c.md", "beta", 1, 0), ("c.md", "gamma", 1, 0), ("e.py", "delta", 0, 1)]


def test_what_is_exploded_is_worked_out_once(make_files):
    code = make_files({"a.js": "function f() {\n g()\n}", "b.ts": "", "c.js": None, "package.json": '{"dependencies": {"a": "^1", "a": "2"}}', "x/package.json": "{"})
    functions, deps = calls.generic_functions(code), manifests.dependencies(code)
    assert _plan(functions).count("array_sort(") == 1 and _plan(deps).count("from_json(") == 1
    assert rows_of(functions, "path", "fn", "callees") == [("a.js", "f", ["f", "g"])]
    assert rows_of(deps, "source_file", "seq", "name", "version") == [("package.json", 0, "a", "2")]


def test_a_text_is_not_searched_once_a_group(make_files):
    found = symbols.jsts_definitions(make_files({"a.js": "\nclass A extends B {}\n\nclass C {}\nx = async (a,\n b) => 1; if (x) {}\nm(a) {", "b.js": None, "c.ts": ""}))
    assert _plan(found).count("regexp_extract_all(text") == 2
    assert rows_of(found, "kind", "line", "name", "bases") == [
        ("class", 2, "A", ["B"]), ("class", 4, "C", []), ("function", 5, "x", []), ("function", 7, "m", [])]
    java = symbols.java_definitions(make_files({"A.java": "\n\n public final class A extends B implements C, D {}\n class E {}"}))
    # the blanks before a class belong to its match
    assert rows_of(java, "line", "name", "bases", "interfaces") == [(3, "A", ["B"], ["C", "D"]), (3, "E", [], [])]


def test_the_walk_asks_no_node_for_fields_without_children():
    """Fields that hold names, contexts and operators are left out by type, not looked at node by node."""
    assert not {"ctx", "op", "ops", "id", "attr"} & {f for fields in pyfacts.FIELDS.values() for f in fields}
    assert ast.Name not in pyfacts.FIELDS and pyfacts.FIELDS[ast.If] == ("test", "body", "orelse")
    source = "import a\nclass A(B):\n  @d(1)\n  def f(self):\n    if x and y or z:\n      def g(): h(k())\n    g()\ndef m(): import c.d\n"
    found = pyfacts.file_facts(source)
    assert [f["name"] for f in found["functions"]] == ["m", "f", "g"] and [f["complexity"] for f in found["functions"]] == [1, 4, 1]
    assert found["imports"] == ["a", "c.d"] and [(c["caller"], c["callee"]) for c in found["calls"]] == [
        ("f", "d"), ("f", "g"), ("g", "h"), ("g", "k")]


def test_facts_become_columns_without_a_row_each():
    schema = pyfacts._arrow_schema()
    sources = ["class A(B):\n  def f(self): g(1)\n", None, "def (", "", "import x\ndef f(): pass\ndef f(): y.z()\n"]
    rows = [{"repo_id": "r", "path": str(i), "text": text} for i, text in enumerate(sources)]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("repo_id", "path", "text")]))
    got = pa.Table.from_batches(pyfacts._facts_of_batches(iter([batch]), schema))
    assert got.to_pylist() == [{"repo_id": "r", "path": r["path"], **pyfacts._facts(r["text"])} for r in rows]
    field = schema.field("classes")
    values = [f["classes"] for f in got.select(["classes"]).to_pylist()]
    assert pyfacts._column(field.type, values).equals(pa.array(values, field.type))


def test_files_are_dealt_evenly_over_tasks(spark, tmp_path):
    """As many tasks as the session shuffles into, however few bytes there are."""
    lines = [(order, 1 + n, 7 * order + n, order, float(n)) for order in range(40) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7 * o + n, f"n {n}") for o in range(40) for n in range(3)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("code", "py", "manifests"):
        rows = corpus(spark, str(tmp_path), name)
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert rows.count() == 40 and rows.select("path").distinct().count() == 40
    text = corpus(spark, str(tmp_path), "py").where("path = 'app/p3.py'").first()["content"]
    assert text == "def f21(x):\n    return x\ndef f22(x):\n    if x and y:\n        g(x)\n    return x\ndef f23(x):\n" + 2 * "    if x and y:\n        g(x)\n" + "    return x\n"
