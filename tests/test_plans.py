"""Storage round trips, invariance, and what the physical plans must and must not hold."""

import json

import pytest

from pyspark.sql import functions as F

from corpuslens.functions.ranking import salted_join, top_n
from corpuslens.operators import architecture, calls, diagrams, files, manifests, pyfacts, symbols
from corpuslens.plans import questions, report
from corpuslens.plans.analysis import Analysis, stored
from corpuslens.sources import corpus, results
from tests.conftest import rows_of

CODE = [
    (repo, path, text)
    for repo in ("one", "two")
    for path, text in {
        "README.md": "# security\n" + "words " * 200, "src/controllers/user.py": "def f(x):\n    if x:\n        g(x)\n",
        "src/models/a.js": "function a(x) {\n  b(x)\n}\n", "package.json": '{"dependencies": {"express": "^4"}}',
        "db/x.sql": "CREATE TABLE t (\n id INT,\n PRIMARY KEY (id)\n);", "tests/t.go": "func T() {\n  x(1)\n}\n",
    }.items()
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_tree_and_corpus(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "repo a" / "src").mkdir(parents=True)
    (root / "repo a" / "src" / "ä.py").write_bytes(b"x = 1\xff\xfe\n# \xef\xbf\xbd")
    (root / "b").mkdir()
    (root / "b" / "Dockerfile").write_text("FROM x")
    df = corpus.scan_tree(spark, str(root))
    assert rows_of(df, "repo_id", "path", "content") == [("b", "Dockerfile", "FROM x"), ("repo a", "src/ä.py", "x = 1\n# \ufffd")]
    corpus.write_corpus(df, str(tmp_path / "packed"))
    packed = corpus.scan_corpus(spark, str(tmp_path / "packed"))
    assert rows_of(packed, "repo_id", "path", "ext") == [("b", "Dockerfile", ""), ("repo a", "src/ä.py", ".py")]
    physical = plan(files.file_previews(packed))
    assert "PushedFilters" in physical and "In(ext" in physical
    narrow = plan(files.language_stats(files.files_classified(packed)))
    assert "commit" not in narrow


def test_results_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(40)], "repo_id string, n int")
    results.write_results(rows, path, buckets=4)
    results.write_results(spark.createDataFrame([("r3", 300), ("new", 1)], "repo_id string, n int"), path, buckets=4)
    assert rows_of(results.read_result(spark, path, "r3"), "n") == [(300,)]
    assert results.read_results(spark, path).count() == 41
    results.drop_result(spark, path, "r3")
    assert results.read_result(spark, path, "r3").count() == 0
    assert results.read_results(spark, path).count() == 40
    for part in (tmp_path / "store" / "_buckets").glob("part-*"):
        part.write_bytes(b"damaged")
    with pytest.raises(Exception):
        results.write_results(rows, path)
    only = str(tmp_path / "only")
    results.write_results(spark.createDataFrame([("x", 1)], "repo_id string, n int"), only, buckets=4)
    results.drop_result(spark, only, "x")
    assert results.read_results(spark, only).count() == 0


def test_analysis_is_invariant_and_additive(spark, make_files, make_commits, tmp_path):
    import datetime as dt
    commits = make_commits([(r, "s", "ann", "e", dt.datetime(2024, 1, 1), "m") for r in ("one", "two")])
    whole = Analysis(make_files(CODE), commits, stored(str(tmp_path / "a")))
    mixed = Analysis(make_files(CODE[::-1]).repartition(7), commits, stored(str(tmp_path / "b")))
    alone = Analysis(make_files([r for r in CODE if r[0] == "one"]), commits.where("repo_id = 'one'"), stored(str(tmp_path / "c")))
    for name in ("language_stats", "frameworks", "architecture", "complexity", "health", "directory_nodes", "arch_evidence"):
        table = whole[name].drop("scores")
        columns = sorted(table.columns)
        assert rows_of(table, *columns) == rows_of(mixed[name], *columns), name
        assert rows_of(table.where("repo_id = 'one'"), *columns) == rows_of(alone[name], *columns), name
    prompt = "\n".join(r[2] for r in rows_of(questions.prompt_lines(whole).where("repo_id = 'one'"), *questions.ORDER, "line"))
    assert prompt.startswith("You are a code analysis assistant for the repository 'one'.\n\nREADME:\n# security")
    assert "  t: id INT\n\nDependencies: express\n\n\nAnswer the user's question" in prompt
    exported = report.export_report(whole).where("repo_id = 'two'")
    bodies = {s: [json.loads(b) for _, b in rows_of(exported.where(F.col("section") == s), "item", "body")]
              for s in ("report", *report.REPORT_LISTS)}
    head = bodies["report"][0]
    assert head["database_tables"] == 1 and head["commit_count"] == 1 and head["health_score"] > 0
    assert head["architecture"]["scores"][head["architecture"]["pattern"]] > 0
    assert [m["path"] for m in bodies["modules"]] == ["src/controllers/user.py", "src/models/a.js", "tests/t.go"]
    assert bodies["dependencies"][0]["name"] == "express"
    assert rows_of(report.repo_counts(whole).where("repo_id = 'one'"), "contributors", "languages", "dependencies", "modules") == [(1, 6, 1, 3)]
    found = rows_of(report.search_entities(whole, "EXP").where("repo_id = 'one'"), "entity", "key")
    assert found == [("dependency", "express"), ("framework", "express")]
    assert report.search_entities(whole, "").count() > 10
    texts = {r["type"]: r["text"] for r in whole.diagrams.where("repo_id = 'one'").collect()}
    assert set(texts) == {"architecture", "sequence", "directory", "layer"} and texts["layer"].startswith("flowchart LR\n    L0[<b>")
    diagrams.write_lines(whole.dependency_diagram, diagrams.DEPENDENCY_LINE_ORDER, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).where("repo_id = 'one'").count() == whole.dependency_diagram.where("repo_id = 'one'").count()


def test_directory_order_and_limits(make_files):
    df = make_files({p: "" for p in ["a/b", "a-b", "a/c/d/e/f/g/h", "z"]})
    nodes = diagrams.directory_nodes(df).orderBy("node_no").collect()
    assert [r["name"] for r in nodes] == ["a", "b", "c", "d", "e", "f", "a-b", "z"]
    assert [r["parent_no"] for r in nodes] == [None, 0, 0, 2, 3, 4, None, None]
    assert nodes[5]["is_dir"] and nodes[5]["depth"] == 4
    many = make_files({f"f{i:03d}": "" for i in range(99)})
    assert diagrams.directory_nodes(many).count() == 60


def test_architecture_golden(make_files):
    df = make_files({"controllers/client.py": "server and SERVER", "controllers/views.txt": "models"})
    scores = architecture.arch_scores(df)
    # directory 1, file names client.py and views.txt 0.5 each, content "server" 0.3
    assert {r[0]: r[1] for r in rows_of(scores.where("tenths > 0"), "pattern", "score")} == {"MVC": 1.5, "Client-Server": 0.8}
    best = architecture.architecture(scores)
    assert rows_of(best, "pattern", "confidence") == [("MVC", 65.22)]
    assert [r["evidence"] for r in architecture.arch_evidence(df, best).orderBy("rank").collect()] == ["directory:controllers", "file:views.txt"]
    nothing = architecture.architecture(architecture.arch_scores(make_files({"x": ""})))
    assert rows_of(nothing, "pattern", "confidence") == [("MVC", 0.0)]
    alone = architecture.architecture(architecture.arch_scores(make_files({"views/x": ""})))
    assert rows_of(alone, "confidence") == [(99.0,)]


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("repo_id"), "id")
    ranked = top_n(df, ["repo_id"], [F.col("id")], 3)
    assert plan(ranked).count("WindowGroupLimit") == 2
    assert rows_of(ranked.where("repo_id = 'hot'"), "id", "rank") == [(0, 1), (3, 2), (6, 3)]


def test_salted_join_keeps_every_row(spark):
    big = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise("cold").alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, v int")
    assert salted_join(big, small, ["k"], "id").count() == 300
    assert salted_join(big, small, ["k"], "id", how="left_semi").count() == 300


def test_fact_extraction_needs_no_shuffle(make_files):
    df = make_files(CODE)
    for table in (manifests.dependencies(df), symbols.modules(df), files.files_classified(df), files.file_previews(df),
                  pyfacts.python_facts(df)):
        assert "Exchange" not in plan(table)
    assert "Exchange" not in plan(calls.generic_functions(df))
    assert "Exchange" not in plan(symbols.jsts_definitions(df))


def test_every_repository_has_a_result(spark, make_files, make_commits, tmp_path):
    import datetime as dt
    found = make_files([("pruned", "node_modules/x.js", "x"), ("usual", "a.py", "x = 1")])
    commits = make_commits([("empty", "s", "ann", "e", dt.datetime(2024, 1, 1), "m")])
    whole = Analysis(found, commits, stored(str(tmp_path / "a")))
    for table in (whole.health, report.analysis_summary(whole), report.repo_counts(whole)):
        assert [r[0] for r in rows_of(table, "repo_id")] == ["empty", "pruned", "usual"]
    given = Analysis(found, commits, stored(str(tmp_path / "b")), repos=spark.createDataFrame([("named",)], "repo_id string"))
    assert rows_of(given.health, "repo_id") == [("named",)]


def test_the_analysis_reads_contents_twice(spark, tmp_path):
    """Once for all facts of single texts, once for the Python leaf."""
    from corpuslens.plans.analysis import Analysis, stored
    from corpuslens.sources.corpus import COMMITS_SCHEMA, FILES_SCHEMA, write_corpus

    rows = [("r", "README.md", "# x"), ("r", "a.py", "def f():\n    g()\n"), ("r", "a.js", "function f() { g() }"),
            ("r", "package.json", '{"dependencies": {"react": "^1"}}'), ("r", "db/a.sql", "CREATE TABLE t (\n  a INT\n);")]
    write_corpus(spark.createDataFrame(rows, FILES_SCHEMA), f"{tmp_path}/files")
    plans = []

    def stage(name, df):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(f"{tmp_path}/staged")(name, df)

    whole = Analysis(spark.read.parquet(f"{tmp_path}/files"), spark.createDataFrame([], COMMITS_SCHEMA), stage)
    tables = [whole.health, whole.summary if hasattr(whole, "summary") else whole.language_stats, whole.call_graph, whole.previews,
              whole.modules, whole.database_schema, whole.diagrams, whole.dependency_diagram, whole.arch_evidence]
    plans += [("result", t._jdf.queryExecution().executedPlan().toString()) for t in tables]
    reads = [name for name, plan in plans for line in plan.split("\n") if "FileScan" in line and "content:string" in line and "/files" in line]
    assert sorted(reads) == ["file_facts", "python_facts"]
    assert whole.call_graph.count() == 2 and whole.database_schema.count() == 1 and whole.dependencies.count() == 1
    assert [r["framework"] for r in whole.frameworks.collect()] == ["react"]


def test_a_tree_with_hidden_and_underscored_names(spark, tmp_path):
    rows = [("r", "__init__.py", b"x"), ("r", ".env", b"A=1"), ("r", "_d/.x/a b%20.c#", "é".encode()), ("s", "e", b""), ("s", "n", None), ("s", "bad", b"a\xffb")]
    df = spark.createDataFrame([(r, p, bytearray(c) if c is not None else None) for r, p, c in rows], "repo_id string, path string, content binary")
    assert corpus.write_tree(df, str(tmp_path / "t")) == 6
    (tmp_path / "t" / "beside.txt").write_text("no repository")
    got = {(r["repo_id"], r["path"]): r["content"] for r in corpus.scan_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {("r", "__init__.py"): "x", ("r", ".env"): "A=1", ("r", "_d/.x/a b%20.c#"): "é", ("s", "e"): "", ("s", "n"): "", ("s", "bad"): "ab"}
