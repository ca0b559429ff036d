"""Adversarial texts: time must stay near-linear in their length."""

import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import before_each, first_of_name
from corpuslens.operators import calls, manifests, pyfacts, schemas, symbols
from tests.conftest import rows_of

BLOCK = "<dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>"


def pom(blocks: int) -> str:
    versioned = "<dependency><groupId>o</groupId><artifactId>b</artifactId><version>1</version></dependency>"
    return f"<project>{versioned}{BLOCK * blocks}</project>"


CASES = {
    "versionless blocks": (lambda n: ("pom.xml", pom(n // 50)), manifests.deps_maven),
    "no version at all": (lambda n: ("pom.xml", BLOCK * (n // 50)), manifests.deps_maven),
    "hex literal, functions": (lambda n: ("a.js", "x = '" + "0a" * (n // 2) + "'"), symbols.symbols_jsts),
    "hex literal, calls": (lambda n: ("a.js", "function f() {\n'" + "0a" * (n // 2) + "'\ng() }"),
                           lambda df: calls.call_edges(calls.generic_functions(df))),
    "hex literal, definitions": (lambda n: ("a.ts", "0a" * (n // 2)), symbols.jsts_definitions),
    "blanks before no class": (lambda n: ("A.java", "public" + " " * n + "x"), symbols.java_definitions),
    "many classes": (lambda n: ("a.js", "class A extends B {}\n" * (n // 5)), symbols.jsts_definitions),
    "many functions": (lambda n: ("a.ts", "function f() {}\n" * (n // 5)), symbols.jsts_definitions),
    "many java classes": (lambda n: ("A.java", "class A extends B {}\n" * (n // 5)), symbols.java_definitions),
    "many columns": (lambda n: ("a.php", "Schema::create('t', function (Blueprint $table) {" + "".join(
        f"$table->string('c{i}');" for i in range(n // 20)) + "});"), schemas.schema_laravel),
    "python functions": (lambda n: ("a.py", "".join(f"def f{i}():\n    g{i}()\n" for i in range(n // 25))),
                         lambda df: calls.call_edges(calls.python_functions(pyfacts.python_facts(df)))),
}


@pytest.mark.parametrize("name", CASES)
def test_time_is_near_linear(make_files, name):
    text, operator = CASES[name]

    def seconds(n: int) -> float:
        df = operator(make_files(dict([text(n)])))
        start = time.perf_counter()
        df.agg(F.count("*")).collect()
        return time.perf_counter() - start

    seconds(1_000)
    small, large = seconds(100_000), seconds(400_000)
    assert large < 6 * small + 6, (small, large)


def test_lines_of_eighty_thousand_classes(make_files):
    text = "class A {}\n\n" * 80_000
    start = time.perf_counter()
    got = symbols.jsts_definitions(make_files({"a.js": text})).agg(F.count("*"), F.max("line"), F.sum("line")).first()
    assert tuple(got) == (80_000, 159_999, 80_000 * 80_000) and time.perf_counter() - start < 30


def test_sums_and_first_names(spark):
    sizes = [3, 0, 1, 2, 5, 0, 7, 1, 1, 1, 4]
    df = spark.createDataFrame([(sizes[:k], [(w,) for w in "bacabdaeb"[:k]]) for k in range(12)], "sizes array<int>, items array<struct<name:string>>")
    got = df.select(before_each(F.col("sizes")), first_of_name(F.col("items")), F.size("sizes")).collect()
    for sums, names, k in got:
        assert sums == [sum(sizes[:i]) for i in range(k)]
        assert [n.name for n in names] == list(dict.fromkeys("bacabdaeb"[:k]))


def test_versionless_blocks_take_the_next_version(make_files):
    text = f"<p>{BLOCK}<dependency><groupId>o</groupId><artifactId>b</artifactId><version>1</version></dependency>{BLOCK}</p>"
    assert rows_of(manifests.deps_maven(make_files({"pom.xml": text})), "name", "version") == [("g.a", "1")]


def test_the_last_of_a_repeated_package_counts(make_files):
    text = '{"dependencies": {"a": "^1", "b": "2", "a": "3"}}'
    assert rows_of(manifests.deps_npm(make_files({"package.json": text})), "name", "version") == [("a", "3"), ("b", "2")]


def test_null_content_is_a_fact(make_files):
    assert rows_of(pyfacts.python_facts(make_files({"a.py": None})), "path", "parse_error") == [("a.py", True)]
