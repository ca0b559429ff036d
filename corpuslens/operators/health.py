"""H family: ten sub-scores, the weighted score, its breakdown and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import any_word


def path_facts(files: DataFrame) -> DataFrame:
    """Flags and counts over the file paths: one partial aggregation, no file content read."""
    path = F.lower("path")
    return prune_paths(files, "P1").groupBy("repo_id").agg(
        F.bool_or(any_word(path, rules.SECURITY_WORDS)).alias("has_security_path"),
        F.count_if(any_word(path, rules.DOC_WORDS)).alias("doc_paths"),
        F.bool_or(any_word(path, rules.TEST_WORDS)).alias("has_test_path"),
        F.bool_or(any_word(path, rules.PERFORMANCE_WORDS)).alias("has_performance_path"))


def dependency_facts(deps: DataFrame) -> DataFrame:
    return deps.groupBy("repo_id").agg(
        F.count("*").alias("deps_n"),
        F.count_if(any_word(F.lower("name"), rules.OUTDATED_WORDS)).alias("outdated_n"))


def framework_facts(frameworks: DataFrame) -> DataFrame:
    return frameworks.groupBy("repo_id").agg(
        F.bool_or(F.col("category") == "testing").alias("has_testing_framework"),
        F.bool_or(F.col("category").isin("database", "cache")).alias("has_store_framework"))


def readme_facts(readme: DataFrame) -> DataFrame:
    return readme.select(
        "repo_id", F.length("readme").alias("readme_chars"),
        F.contains(F.lower("readme"), F.lit("security")).alias("readme_names_security"))


def health_inputs(
    repos: DataFrame, files: DataFrame, deps: DataFrame, frameworks: DataFrame, architecture: DataFrame,
    complexity: DataFrame, module_counts: DataFrame, contributor_counts: DataFrame, readme: DataFrame,
) -> DataFrame:
    """One row per repository.  Every side is aggregated to repository level before it is joined."""
    joined = repos.select("repo_id").distinct()
    for side in (
        path_facts(files),
        dependency_facts(deps),
        framework_facts(frameworks),
        architecture.select("repo_id", "confidence", F.size("layers").alias("layers_n")),
        complexity,
        module_counts.select("repo_id", "modules_n"),
        contributor_counts.select("repo_id", "contributors_n"),
        readme_facts(readme),
    ):
        joined = joined.join(side, "repo_id", "left")
    return joined.fillna(0).fillna(False)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def security() -> Column:
    return _clamped(
        70 + _points(_n("deps_n") < 10, 10) + _points(_flag("readme_names_security"), 10)
        + _points(_flag("has_security_path"), 10))


def maintainability() -> Column:
    length = _n("avg_function_length")
    by_length = F.when(length < 10, 15).when(length < 20, 10).when(length < 50, 5).otherwise(-10)
    return _clamped(70 + by_length + _points(_n("total_files").between(10, 100), 10))


def documentation() -> Column:
    size = _n("readme_chars")
    return _clamped(
        50 + _points(size > 0, 20) + _points(size > 500, 10) + 10 * F.least(_n("doc_paths"), F.lit(3)))


def testing() -> Column:
    return _clamped(50 + _points(_flag("has_test_path"), 20) + _points(_flag("has_testing_framework"), 20))


def architecture_score() -> Column:
    return _clamped(
        60 + _points(_n("confidence") > 50, 20) + _points(_n("modules_n") > 0, 10)
        + _points(_n("layers_n") >= 3, 10))


def performance() -> Column:
    return _clamped(
        75 + _points(_flag("has_performance_path"), 5) + _points(_flag("has_store_framework"), 5)
        - _points(_n("max_complexity") > 30, 10))


def quality() -> Column:
    files = _n("total_files")
    per_file = _n("total_functions") / F.greatest(files, F.lit(1))
    by_functions = F.when((per_file > 2) & (per_file < 10), 10).when(per_file > 20, -10).otherwise(0)
    branches = _n("avg_complexity")
    by_branches = F.when(branches < 3, 10).when(branches > 10, -10).otherwise(0)
    return _clamped(70 + F.when(files > 0, by_functions).otherwise(0) + by_branches)


def complexity_score() -> Column:
    """A repository without code files has an average size of 0."""
    files = _n("total_files")
    size = F.when(files > 0, _n("total_lines") / F.greatest(files, F.lit(1))).otherwise(0.0)
    by_size = F.when(size < 100, 10).when(size > 500, -15).when(size > 300, -5).otherwise(0)
    return _clamped(80 + by_size - _points(_n("max_complexity") > 50, 10))


def dependency_score() -> Column:
    return F.when(_n("deps_n") == 0, F.lit(100)).otherwise(_clamped(70 - 5 * _n("outdated_n"))).cast("int")


def activity() -> Column:
    people = _n("contributors_n")
    return _clamped(60 + F.when(people > 5, 15).when(people > 1, 10).otherwise(0) + _points(people > 10, 10))


SCORES = {
    "security": security,
    "maintainability": maintainability,
    "documentation": documentation,
    "testing": testing,
    "architecture": architecture_score,
    "performance": performance,
    "quality": quality,
    "complexity": complexity_score,
    "dependency": dependency_score,
    "activity": activity,
}


def health(inputs: DataFrame) -> DataFrame:
    """Ten scores and their weighted mean, half-even to one decimal."""
    scored = inputs.select("repo_id", *[score().alias(name) for name, score in SCORES.items()])
    total = F.lit(0)
    for name, weight in rules.HEALTH_WEIGHTS.items():
        total = total + F.col(name) * weight
    return scored.withColumn("overall", F.bround(total / sum(rules.HEALTH_WEIGHTS.values()), 1))


def health_breakdown(scores: DataFrame) -> DataFrame:
    """One row per metric."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("score"), F.lit(100).alias("max"),
                 F.lit(weight).alias("weight"))
        for name, weight in rules.HEALTH_WEIGHTS.items()
    ])
    return scores.select("repo_id", F.explode(cells).alias("m")).select("repo_id", "m.*")


def recommendations(scores: DataFrame) -> DataFrame:
    """Messages for scores below their threshold, in a fixed order."""
    messages = F.array(*[
        F.when(F.col(metric) < threshold, F.lit(message)) for metric, threshold, message in rules.RECOMMENDATIONS])
    return scores.select("repo_id", F.posexplode(F.array_compact(messages)).alias("seq", "message"))


def health_label(score: Column) -> Column:
    """A word for a score."""
    (first, word), *rest = rules.HEALTH_LABELS
    label = F.when(score >= first, word)
    for threshold, word in rest:
        label = label.when(score >= threshold, word)
    return label.otherwise(rules.HEALTH_LABEL_REST)
