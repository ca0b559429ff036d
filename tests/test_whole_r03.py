"""Cheaper steps of the whole analysis and of generic_counts give what the plain ones give."""

import itertools

from pyspark.sql import functions as F

from checks.fixtures import corpus
from corpuslens import rules
from corpuslens.functions import paths, text
from corpuslens.operators import architecture, complexity

TEXTS = ["", "function f1(x) {\n  g(x); if (x) { h_2 (x) }\n}", "fn größe(x) {} class Ä1 struct B", "func tion a", "def\x1cf def\x0bf fn  z",
         "class\u0085x class\ty", "functionx y func a defdef b fn\nq", "export { a }\nmodule.exports = q\nimport R from 'r'\nrequire('x')", "日本(1) a١(2)", None]


def test_the_pattern_of_a_text_matches_as_the_unicode_one(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    bodies = [rules.GENERIC_FUNCTION, rules.GENERIC_CLASS, rules.CALL_LINEAR, rules.JS_FUNCTION_LINEAR, rules.JS_CLASS, *rules.JS_IMPORTS,
              *[p for p, _ in rules.JS_EXPORTS], rules.PHP_IMPORT, r"\S+\s", r"[^\w\s]+"]
    for body in bodies:
        regex = text.pattern(body)
        chosen = text.for_letters_of(F.col("text"), regex)
        found = rows.select("text", text.find_all(F.col("text"), regex, 0), F.regexp_extract_all("text", F.lit(regex), F.lit(0)), chosen).collect()
        for row in found:
            assert row[1] == row[2], (body, row[0])
            assert row[0] is None or row[3].startswith("(?d)") == row[0].isascii()


def test_literals_stand_in_every_match_and_counts_are_the_same(spark):
    words = ["def", "function", "func", "fn", "class", "struct", "x", " ", "\n", "f", "tion", "Ä"]
    rows = spark.createDataFrame([("".join(c),) for n in range(1, 4) for c in itertools.product(words, repeat=n)] + [(None,)], "text string")
    rows = rows.withColumn("ext", F.lit(".js"))
    plain = [F.regexp_count("text", F.lit(text.pattern(b))).cast("long") for b in (rules.GENERIC_FUNCTION, rules.GENERIC_CLASS)]
    for row in rows.select("text", *complexity.file_counts()[2:], *plain).collect():
        assert row[1:3] == row[3:5], row[0]
    of_js = [*zip(rules.JS_IMPORTS, rules.JS_IMPORT_LITERALS), *zip([p for p, _ in rules.JS_EXPORTS], rules.JS_EXPORT_LITERALS)]
    sources = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    for body, held in of_js:
        both = sources.select(text.find_all(F.col("text"), text.pattern(body), 0, held), text.find_all(F.col("text"), text.pattern(body), 0)).collect()
        assert all(a == b for a, b in both), body


def test_path_parts_are_those_of_the_patterns(spark):
    parts = ["", "a", ".a", "a.b", "..a.B", "a.", ".", "...", "venv", "node_modules", "ä.É", "a\n.c"]
    rows = spark.createDataFrame([("/".join(c),) for n in (1, 2, 3) for c in itertools.product(parts, repeat=n)] + [(None,)], "path string")
    holder = F.regexp_extract("path", r"(?s)^(.*/)?[^/]*\z", 1)
    walked = F.trim(F.regexp_replace(F.concat(F.lit("/"), holder), "(?s)/" + paths._pruned_regex("P2") + "/.*", "/"), F.lit("/"))
    name = paths.base_name(F.col("path"))
    for row in rows.select(
            "path", paths.directory(F.col("path")), paths.extension(name), paths.walked_directory(F.col("path"), "P2"),
            F.regexp_extract("path", r"(?s)^(.*)/[^/]*\z", 1), F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)), walked).collect():
        assert row[1:4] == row[4:7], row[0]


def test_a_filter_on_paths_reaches_the_rows_of_manifests(spark, tmp_path):
    """Files that are not counted are not put together; before, the numbering of their rows came first."""
    lines = [(o, p, 1, n, float(n)) for o in (*range(14), None) for n, p in enumerate((3, 1, 2, 1, None))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "b x"), (2, None), (3, "a"), (3, "a")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = corpus(spark, str(tmp_path), "manifests")
    plan = complexity.generic_counts(rows)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [k for k, line in enumerate(plan) if "Filter" in line and "pkg" in line]
    window = [k for k, line in enumerate(plan) if "Window [row_number" in line]
    assert at and window and at[0] > window[0]
    found = {r.path: r.content for r in rows.where("repo_id IN ('repo0', 'repo1')").collect()}
    assert found == {
        "pkg0/package.json": '{"dependencies": {, "a-3": "^0.0"\n, "b-x-1": "^3.3"}}', "pkg1/requirements.txt": "a-3==0.0\nb-x-1==3.3"}


def test_directories_of_one_and_many_parts(spark):
    rows = spark.createDataFrame([("r", p) for p in ("x.py", "a/x.py", "a/b/c/x.py", ".h/x", "a/node_modules/b/x")], "repo_id string, path string")
    assert sorted(r.dir for r in architecture.walked_directories(rows).collect()) == [".", "a", "a/b", "a/b/c"]
