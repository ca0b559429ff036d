"""C family: size and complexity metrics per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import any_word, for_letters_of, iterated_lines, pattern, split_lines
from corpuslens.operators.files import with_text


def _metric_files(files: DataFrame) -> DataFrame:
    return with_text(prune_paths(files, "P1")).where(F.col("ext").isin(rules.METRIC_EXTENSIONS))


def _matches(text: Column, body: str, literals: list[str]) -> Column:
    """How often the pattern matches; a text without any of its literals is not searched."""
    counted = F.regexp_count(text, for_letters_of(text, pattern(body)))
    return F.when(~any_word(text, literals), F.lit(0)).otherwise(counted)


def file_counts() -> list[Column]:
    """What is counted in one file's text: lines by both rules, functions and classes by pattern."""
    text = F.col("text")
    counted = F.col("ext").isin([e for e in rules.METRIC_EXTENSIONS if e != ".py"])
    functions = _matches(text, rules.GENERIC_FUNCTION_LINEAR, rules.GENERIC_FUNCTION_LITERALS)
    classes = _matches(text, rules.GENERIC_CLASS, rules.GENERIC_CLASS_LITERALS)
    return [
        iterated_lines(text).alias("lines"),
        split_lines(text).alias("split_lines"),
        F.when(counted, functions).otherwise(0).cast("long").alias("functions"),
        F.when(counted, classes).otherwise(0).cast("long").alias("classes"),
    ]


def _per_file(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Counts of one file; only these numbers leave the scan stage."""
    if facts is not None:
        return facts.where(F.col("ext").isin(rules.METRIC_EXTENSIONS))
    return _metric_files(files).select("repo_id", "path", *file_counts())


def code_totals(files: DataFrame) -> DataFrame:
    """Code files and their lines."""
    rows = _metric_files(files).select("repo_id", split_lines(F.col("text")).alias("lines"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"))


def generic_counts(files: DataFrame) -> DataFrame:
    """Functions and classes counted by pattern, Python excluded."""
    return _per_file(files).groupBy("repo_id").agg(
        F.sum("functions").alias("functions"), F.sum("classes").alias("classes"))


def complexity(files: DataFrame, facts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """C4: the eight metrics; only repositories with code files have a row here.

    ``facts`` are the Python facts, ``counts`` optionally the stored per-file counts.
    """
    generic = _per_file(files, counts).groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.sum("split_lines").alias("total_lines"),
        F.sum("functions").alias("functions"), F.sum("classes").alias("classes"))
    add = lambda acc, x: acc + x
    per_file = facts.select(
        "repo_id", "path", F.size("functions").cast("long").alias("n"), F.size("classes").cast("long").alias("c"),
        F.aggregate("functions.length", F.lit(0).cast("long"), add).alias("length"),
        F.aggregate("functions.complexity", F.lit(0).cast("long"), add).alias("cx"),
        F.array_max("functions.complexity").alias("max_cx"))
    # smallest struct (-complexity, path) = highest complexity, ties to the smallest path
    hardest = F.when(F.col("max_cx").isNotNull(), F.struct((-F.col("max_cx")).alias("minus"), "path"))
    python = per_file.groupBy("repo_id").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("length").alias("length"), F.sum("cx").alias("cx"),
        F.min(hardest).alias("hardest"))
    zero = F.lit(0).cast("long")
    has = F.col("n") > 0
    return generic.join(python, "repo_id", "left").select(
        "repo_id", "total_files", "total_lines",
        (F.col("functions") + F.coalesce("n", zero)).alias("total_functions"),
        (F.col("classes") + F.coalesce("c", zero)).alias("total_classes"),
        F.when(has, F.bround(F.col("length") / F.col("n"), 2)).otherwise(0.0).alias("avg_function_length"),
        F.when(has, F.bround(F.col("cx") / F.col("n"), 2)).otherwise(0.0).alias("avg_complexity"),
        F.coalesce(-F.col("hardest.minus"), F.lit(0)).cast("double").alias("max_complexity"),
        F.col("hardest.path").alias("max_complexity_file"),
    )
