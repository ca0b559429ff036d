"""G family: who calls whom, within one file.

The text of a file is cut at every line that defines a function.  Each piece then starts with the
definition its calls belong to, so "the latest definition so far" needs neither line rows nor a
window: it is the head of the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import bound, find_all, find_fields, for_letters_of, one_line, pattern
from corpuslens.operators.files import with_text


def _pieces(text: Column, definition: str) -> Column:
    """Cut before each line that holds a definition; only the first piece may hold none."""
    return F.split(text, for_letters_of(text, pattern(r"^(?=[^\n]*?(?:" + one_line(definition) + "))", multiline=True)))


def _defined(first_line: Column, definition: str) -> Column:
    if definition.count("(\\w+)") == 1:
        return find_all(first_line, pattern(definition))
    found = find_fields(first_line, pattern(definition), a=1, b=2)
    return F.transform(found, lambda m: F.concat(m["a"], m["b"]))


def _called(piece: Column) -> Column:
    return F.filter(find_all(piece, pattern(one_line(rules.CALL_LINEAR))), lambda c: ~c.isin(rules.NOT_CALLS))


def functions_in() -> Column:
    """ARRAY<STRUCT<fn, callees>> of a file's text, last definition of a name only; NULL without patterns.

    The definitions are sorted by name and place, and one stays where the next has another name.
    """
    none = F.array().cast("array<string>")

    def by_extension(of) -> Column:
        found = F.lit(None).cast("array<string>")
        for ext, definition in reversed(rules.CALL_DEFINITIONS.items()):
            found = F.when(F.col("ext") == ext, of(definition)).otherwise(found)
        return found

    def defined_in(piece: Column, at: Column) -> Column:
        names = by_extension(lambda d: _defined(F.substring_index(piece, "\n", 1), d))
        # several definitions on one line: each restarts its list, the last one receives the calls
        return F.transform(names, lambda fn, nth: F.struct(
            fn.alias("fn"), at.alias("at"), nth.alias("nth"),
            F.when(nth == F.size(names) - 1, _called(piece)).otherwise(none).alias("callees")))

    def last_of_name(defined: Column) -> Column:
        last = F.filter(defined, lambda d, i: F.coalesce(F.get(defined, i + 1)["fn"] != d["fn"], F.lit(True)))
        return F.transform(last, lambda d: F.struct(d["fn"].alias("fn"), d["callees"].alias("callees")))

    pieces = by_extension(lambda d: _pieces(F.col("text"), d))
    return bound(F.array_sort(F.flatten(F.transform(pieces, defined_in))), last_of_name)


def generic_functions(files: DataFrame) -> DataFrame:
    """Functions of the pattern languages with their calls, last definition of a name only.

    A file is one row, so the last definition of a name is found inside it.  Nothing is shuffled.
    """
    sources = with_text(prune_paths(files, "P1")).where(F.col("ext").isin(list(rules.CALL_DEFINITIONS)))
    return as_functions(sources.select("repo_id", "path", functions_in().alias("calls")))


def as_functions(rows: DataFrame) -> DataFrame:
    """One row a function, from (repo_id, path, calls)."""
    # a plain explode is given a filter on the size of its array, which works the whole array out a second time
    rows = rows.select("repo_id", "path", F.explode_outer("calls").alias("d")).where("d IS NOT NULL")
    return rows.select("repo_id", "path", "d.fn", "d.callees")


def python_functions(facts: DataFrame) -> DataFrame:
    """Python functions with the calls whose innermost enclosing function they are."""
    return facts.select("repo_id", "path", F.explode("graph").alias("g")).select("repo_id", "path", "g.fn", "g.callees")


def call_graph(functions: DataFrame) -> DataFrame:
    """`path::fn` -> callees, functions without calls included."""
    return functions.select(
        "repo_id", F.concat_ws("::", "path", "fn").alias("fn_id"), "path", "fn", "callees")


def call_edges(functions: DataFrame) -> DataFrame:
    """One row per call, in order; repeated calls stay repeated."""
    return functions.select("repo_id", "path", "fn", F.posexplode("callees").alias("seq", "callee"))


def all_functions(files: DataFrame, facts: DataFrame) -> DataFrame:
    return generic_functions(files).unionByName(python_functions(facts))
