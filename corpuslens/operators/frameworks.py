"""F family: frameworks by root file or declared dependency, with their version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import (
    any_word, bound, first_match, literal_map, lstrip, strip, text_array,
)
from corpuslens.operators.files import with_text

FRAMEWORK_NAMES = [name for name, *_ in rules.FRAMEWORKS]
CATEGORY = {name: category for name, _, _, category in rules.FRAMEWORKS}


def framework_by_file(files: DataFrame) -> DataFrame:
    """rules whose file exists, relative to the root (a directory of that name also exists)."""
    wanted = [f for _, listed, _, _ in rules.FRAMEWORKS for f in listed]
    depths = sorted({f.count("/") + 1 for f in wanted})
    heads = F.array_distinct(F.array(*[F.substring_index("path", "/", d) for d in depths]))
    keys = files.select("repo_id", F.explode(heads).alias("entry")).where(F.col("entry").isin(wanted))
    hits = [F.when(F.col("entry").isin(listed), F.lit(name)) for name, listed, _, _ in rules.FRAMEWORKS if listed]
    return (
        keys.select("repo_id", F.explode(F.array(*hits)).alias("framework"))
        .where(F.col("framework").isNotNull())
        .distinct()
    )


MANIFESTS = ["package.json", "requirements.txt"]
PACKAGE = "dependencies map<string,string>, devDependencies map<string,string>"


def _manifests(files: DataFrame) -> DataFrame:
    return with_text(prune_paths(files, "P2")).where(F.col("name").isin(MANIFESTS))


def _exact_version(package: Column, deps: list[str]) -> Column:
    """First rule dependency that is an exact key; devDependencies win over dependencies."""
    found = [
        F.coalesce(F.try_element_at(package["devDependencies"], F.lit(d)),
                   F.try_element_at(package["dependencies"], F.lit(d)))
        for d in deps
    ]
    return lstrip(F.coalesce(*found), rules.VERSION_PREFIX_CHARS)


def _pinned_version(deps: list[str]) -> Column:
    """First line naming a dependency and holding ``==``: the text up to the next ``==``."""
    words = "|".join(rf"\Q{d}\E" for d in deps)
    regex = rf"(?md)^(?=.*(?i:{words})).*?==(.*?)(?:==.*)?$"
    return strip(first_match(F.col("text"), regex))


def rules_in() -> Column:
    """ARRAY<STRUCT<framework, fires, version>> of one manifest's text: the rules that fire or find a version."""
    is_package = F.col("name") == "package.json"

    def of_package(package: Column) -> Column:
        keys = F.concat_ws("\n", F.map_keys(package["dependencies"]), F.map_keys(package["devDependencies"]))

        def searched(hay: Column) -> Column:
            facts = []
            for name, _, deps, _ in rules.FRAMEWORKS:
                if deps:
                    # a text that names no dependency has no line with its version
                    version = F.when(is_package, _exact_version(package, deps)).otherwise(_pinned_version(deps))
                    facts.append(F.when(any_word(hay, deps), F.struct(
                        F.lit(name).alias("framework"), F.lit(True).alias("fires"), version.alias("version"))))
            return F.array_compact(F.array(*facts))

        return bound(F.when(is_package, keys).otherwise(F.lower("text")), searched)

    return bound(F.when(is_package, F.from_json("text", PACKAGE)), of_package)


def as_manifest_facts(rows: DataFrame) -> DataFrame:
    """One row a rule, from (repo_id, path, rules)."""
    # outer: see as_functions in calls
    return rows.select("repo_id", "path", F.explode_outer("rules").alias("f")).where("f IS NOT NULL").select("repo_id", "path", "f.*")


def manifest_facts(files: DataFrame) -> DataFrame:
    """One row per manifest and rule: does it fire, and which version does it give."""
    return as_manifest_facts(_manifests(files).select("repo_id", "path", rules_in().alias("rules")))


def framework_by_dep(files: DataFrame) -> DataFrame:
    """rules that a manifest fires, without those a root file already fired."""
    fired = manifest_facts(files).where("fires").select("repo_id", "framework").distinct()
    return fired.join(framework_by_file(files), ["repo_id", "framework"], "left_anti")


def framework_version(files: DataFrame) -> DataFrame:
    """version from the first manifest (by path) that yields one."""
    return (
        manifest_facts(files).where(F.col("version").isNotNull())
        .groupBy("repo_id", "framework").agg(F.min_by("version", "path").alias("version"))
    )


def frameworks(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """one aggregation over both kinds of evidence, at most one row per rule and repository.

    ``facts`` are stored manifest facts; without them the manifests are read.
    """
    by_file = framework_by_file(files).select(
        "repo_id", "framework", F.lit(True).alias("fires"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("version"))
    facts = manifest_facts(files) if facts is None else facts
    by_manifest = facts.select("repo_id", "framework", "fires", "path", "version")
    merged = by_file.unionByName(by_manifest).groupBy("repo_id", "framework").agg(
        F.bool_or("fires").alias("fires"),
        F.min(F.when(F.col("version").isNotNull(), F.struct("path", "version"))).alias("pick"))
    return merged.where("fires").select(
        "repo_id",
        F.array_position(text_array(FRAMEWORK_NAMES), F.col("framework")).cast("int").alias("rule_no"),
        "framework",
        F.col("pick.version").alias("version"),
        F.try_element_at(literal_map(CATEGORY), F.col("framework")).alias("category"),
    )
