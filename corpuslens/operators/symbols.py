"""M family: imports, exports, classes and functions per source file.

`module_names` holds one row per file with four name arrays and needs no shuffle at all: every
language is an array expression over the text.  `symbols` is its long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import before_each, bound, extract, find_all, for_letters_of, newline_count, pattern, strip
from corpuslens.operators.files import classify_language, with_text
from corpuslens.operators.pyfacts import python_facts

KINDS = ["import", "export", "class", "function"]


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _js_function_names(text: Column) -> Column:
    regex = pattern(rules.JS_FUNCTION_LINEAR)
    # one pass over the text; a match alone matches again in the same way, and exactly one of its
    # three alternatives captures
    names = F.transform(find_all(text, regex, 0), lambda m: F.concat(*[extract(m, regex, g) for g in (1, 2, 3)]))
    return F.filter(names, lambda n: ~n.isin(rules.JS_NOT_FUNCTIONS))


def _jsts(text: Column) -> dict[str, Column]:
    return {
        "imports": F.concat(*[find_all(text, pattern(p), 1, held) for p, held in zip(rules.JS_IMPORTS, rules.JS_IMPORT_LITERALS)]),
        "exports": F.concat(*[
            find_all(text, pattern(p), group, held) for (p, group), held in zip(rules.JS_EXPORTS, rules.JS_EXPORT_LITERALS)]),
        "classes": find_all(text, pattern(rules.JS_CLASS), 1, "class"),
        "functions": _js_function_names(text),
    }


def _java(text: Column) -> dict[str, Column]:
    return {"imports": find_all(text, pattern(rules.JAVA_IMPORT), 1, "import"), "classes": find_all(text, pattern(rules.JAVA_CLASS_LINEAR), 1, "class")}


def _go(text: Column) -> dict[str, Column]:
    blocks = find_all(text, pattern(rules.GO_IMPORT_BLOCK, dotall=True))
    grouped = F.flatten(F.transform(blocks, lambda b: find_all(b, rules.GO_IMPORT_ITEM)))
    return {
        "imports": F.concat(grouped, find_all(text, pattern(rules.GO_IMPORT))),
        "classes": find_all(text, pattern(rules.GO_STRUCT)),
        "functions": find_all(text, pattern(rules.GO_FUNCTION)),
    }


def _rust(text: Column) -> dict[str, Column]:
    return {
        "imports": find_all(text, pattern(rules.RUST_IMPORT)),
        "classes": find_all(text, pattern(rules.RUST_TYPE)),
        "functions": find_all(text, pattern(rules.RUST_FUNCTION)),
    }


def _csharp(text: Column) -> dict[str, Column]:
    return {"imports": find_all(text, pattern(rules.CSHARP_IMPORT)), "classes": find_all(text, pattern(rules.ANY_CLASS), 1, "class")}


def _php(text: Column) -> dict[str, Column]:
    return {
        "imports": find_all(text, pattern(rules.PHP_IMPORT)),
        "classes": find_all(text, pattern(rules.ANY_CLASS), 1, "class"),
        "functions": find_all(text, pattern(rules.PHP_FUNCTION)),
    }


LANGUAGES = [
    ([".js", ".jsx", ".ts", ".tsx"], _jsts),
    ([".java"], _java),
    ([".go"], _go),
    ([".rs"], _rust),
    ([".cs"], _csharp),
    ([".php"], _php),
]
ARRAYS = ["imports", "exports", "classes", "functions"]


def _sources(files: DataFrame, extensions: list[str]) -> DataFrame:
    return with_text(prune_paths(files, "P1")).where(F.col("ext").isin(extensions))


def name_arrays(languages: list) -> list[Column]:
    """The four name arrays of a file's text, by the patterns of its extension; empty where it has none."""
    found = {a: [] for a in ARRAYS}
    for listed, facts in languages:
        for array, column in facts(F.col("text")).items():
            found[array].append((listed, column))
    columns = []
    for array in ARRAYS:
        chosen = _nothing()
        for listed, column in reversed(found[array]):
            chosen = F.when(F.col("ext").isin(listed), column).otherwise(chosen)
        columns.append(chosen.alias(array))
    return columns


#: languages without patterns (`.rb`) have empty arrays
ALL_LANGUAGES = [*LANGUAGES, ([".rb"], lambda text: {})]
ALL_EXTENSIONS = [e for listed, _ in ALL_LANGUAGES for e in listed]


def _pattern_modules(files: DataFrame, languages: list) -> DataFrame:
    """Name arrays of all files whose language is read with patterns, in one narrow pass."""
    extensions = [e for listed, _ in languages for e in listed]
    return _sources(files, extensions).select("repo_id", "path", *name_arrays(languages))


def _python_modules(facts: DataFrame) -> DataFrame:
    return facts.select(
        "repo_id", "path", "imports", _nothing().alias("exports"),
        F.col("classes.name").alias("classes"), F.col("functions.name").alias("functions"))


def module_names(files: DataFrame, facts: DataFrame | None = None, by_pattern: DataFrame | None = None) -> DataFrame:
    """Name arrays of every source file; ``by_pattern`` are stored ones of the languages read with patterns."""
    facts = python_facts(files) if facts is None else facts
    by_pattern = _pattern_modules(files, ALL_LANGUAGES) if by_pattern is None else by_pattern
    return by_pattern.unionByName(_python_modules(facts))


def modules(files: DataFrame, facts: DataFrame | None = None, by_pattern: DataFrame | None = None) -> DataFrame:
    """M8: one row per source file.  Name and language come from the path, so nothing joins."""
    return classify_language(module_names(files, facts, by_pattern)).select(
        "repo_id", "path", "name", F.lit("file").alias("type"), "language", *ARRAYS)


def symbols(module_rows: DataFrame) -> DataFrame:
    """Long form: one row per import, export, class or function name, in source order per kind."""
    def of_kind(array: str, kind: str) -> Column:
        return F.transform(F.col(array), lambda n, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("seq"), n.alias("name")))

    kinds = [of_kind(array, kind) for array, kind in zip(ARRAYS, KINDS)]
    return module_rows.select("repo_id", "path", F.explode(F.concat(*kinds)).alias("s")).select(
        "repo_id", "path", "s.kind", "s.seq", "s.name")


def _language_symbols(files: DataFrame, at: int) -> DataFrame:
    return symbols(_pattern_modules(files, [LANGUAGES[at]]))


def symbols_jsts(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 0)


def symbols_java(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 1)


def symbols_go(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 2)


def symbols_rust(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 3)


def symbols_csharp(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 4)


def symbols_php(files: DataFrame) -> DataFrame:
    return _language_symbols(files, 5)


def symbols_python(facts: DataFrame) -> DataFrame:
    return symbols(_python_modules(facts))


def python_definitions(facts: DataFrame) -> DataFrame:
    """Classes with bases and methods, functions with decorators, both with their line."""
    none = _nothing()
    classes = F.transform("classes", lambda c, i: F.struct(
        F.lit("class").alias("kind"), i.alias("seq"), c["name"].alias("name"), c["line"].alias("line"),
        c["bases"].alias("bases"), c["methods"].alias("methods"), none.alias("decorators")))
    functions = F.transform("functions", lambda f, i: F.struct(
        F.lit("function").alias("kind"), i.alias("seq"), f["name"].alias("name"), f["line"].alias("line"),
        none.alias("bases"), none.alias("methods"), f["decorators"].alias("decorators")))
    return facts.select("repo_id", "path", F.explode(F.concat(classes, functions)).alias("d")).select(
        "repo_id", "path", "d.*")


def _located(text: Column, body: str, kind: str, groups: list[int]) -> Column:
    """Matches as structs with their line: newlines in everything before it, summed up inside the row.

    Two passes over the text, whatever the number of groups: the matches and the gaps before them, one for each match.  A
    match alone matches again in the same way.
    """
    regex = pattern(body)

    def located(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, for_letters_of(text, regex), -1), F.lit(1), F.size(found)), newline_count)
        ends = F.zip_with(gaps, found, lambda gap, m: gap + newline_count(m))
        return F.zip_with(found, F.zip_with(before_each(ends), gaps, lambda before, gap: before + gap + 1), lambda m, line: F.struct(
            F.lit(kind).alias("kind"), line.cast("int").alias("line"),
            *[(extract(m, regex, g) if g in groups else F.lit("")).alias(f"g{g}") for g in (1, 2, 3)]))

    return bound(find_all(text, regex, 0), located)


def jsts_definitions(files: DataFrame) -> DataFrame:
    """Classes (with base) and functions of JavaScript and TypeScript with their line."""
    text = F.col("text")
    found = F.concat(
        _located(text, rules.JS_CLASS, "class", [1, 2]),
        _located(text, rules.JS_FUNCTION_LINEAR, "function", [1, 2, 3]))
    rows = _sources(files, LANGUAGES[0][0]).select("repo_id", "path", F.explode(found).alias("m"))
    rows = rows.select("repo_id", "path", "m.*")
    is_class = F.col("kind") == "class"
    return rows.select(
        "repo_id", "path", "kind", "line",
        F.when(is_class, F.col("g1")).otherwise(F.concat("g1", "g2", "g3")).alias("name"),
        F.when(is_class & (F.col("g2") != ""), F.array("g2")).otherwise(_nothing()).alias("bases"),
    ).where(is_class | ~F.col("name").isin(rules.JS_NOT_FUNCTIONS))


def java_definitions(files: DataFrame) -> DataFrame:
    """Java classes with base, interfaces and line."""
    found = _located(F.col("text"), rules.JAVA_CLASS_LINEAR, "class", [1, 2, 3])
    rows = _sources(files, [".java"]).select("repo_id", "path", F.explode(found).alias("m"))
    rows = rows.select("repo_id", "path", "m.*")
    interfaces = F.transform(F.split("g3", ","), lambda i: strip(i))
    return rows.select(
        "repo_id", "path", "kind", "line", F.col("g1").alias("name"),
        F.when(F.col("g2") != "", F.array("g2")).otherwise(_nothing()).alias("bases"),
        F.when(F.col("g3") != "", interfaces).otherwise(_nothing()).alias("interfaces"))
