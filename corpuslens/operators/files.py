"""S4-S6 and the L family: previews, README, sizes, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import text
from corpuslens.functions.paths import path_parts, prune_paths
from corpuslens.functions.text import literal_map, text_array, universal_newlines


def with_text(files: DataFrame) -> DataFrame:
    """Path parts plus ``text``: the content with universal newlines, as text readers see it."""
    return path_parts(files).withColumn("text", universal_newlines(F.col("content")))


def file_previews(files: DataFrame) -> DataFrame:
    """The first characters of source and markup files; cut before anything shuffles."""
    kept = with_text(prune_paths(files, "P1")).where(F.col("ext").isin(rules.PREVIEW_EXTENSIONS))
    return kept.select(
        "repo_id", "path", "name", F.substring("text", 1, rules.PREVIEW_CHARS).alias("preview"))


def pick_readme(files: DataFrame) -> DataFrame:
    """The first README name that exists in the repository root."""
    order = F.array_position(text_array(rules.README_NAMES), F.col("path"))
    if "readme" in files.columns:  # stored heads
        found = files.where(F.col("path").isin(rules.README_NAMES)).select("repo_id", order.alias("n"), "readme")
    else:
        found = files.where(F.col("path").isin(rules.README_NAMES)).select(
            "repo_id",
            order.alias("n"),
            F.substring(universal_newlines(F.col("content")), 1, rules.README_CHARS).alias("readme"),
        )
    return found.groupBy("repo_id").agg(F.min_by("readme", "n").alias("readme"))


def repo_size(files: DataFrame) -> DataFrame:
    """Bytes per repository."""
    kept = prune_paths(files, "P4")
    return kept.groupBy("repo_id").agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"))


def classify_language(files: DataFrame) -> DataFrame:
    """L1: extension first, then exact file name, else Unknown.  Constant maps, so no join."""
    by_name = {n: lang for lang, names in rules.FILE_NAMES_BY_LANGUAGE.items() for n in names}
    return path_parts(files).withColumn(
        "language",
        F.coalesce(
            F.try_element_at(literal_map(rules.LANGUAGE_BY_EXTENSION), F.col("ext")),
            F.try_element_at(literal_map(by_name), F.col("name")),
            F.lit("Unknown"),
        ),
    )


def count_lines(files: DataFrame) -> DataFrame:
    """L2: lines as a text iterator counts them."""
    return files.withColumn("lines", text.iterated_lines(universal_newlines(F.col("content"))))


def files_classified(files: DataFrame) -> DataFrame:
    """The narrow per-file table: language and lines, without the content."""
    return count_lines(classify_language(prune_paths(files, "P1"))).select(
        "repo_id", "path", "dir", "name", "ext", "language", "lines")


def language_stats(classified: DataFrame) -> DataFrame:
    """L3: files, lines and share per language; the share is of all lines, Unknown included.

    One shuffle of partial counts; the repository total is then a window over the few language
    rows of a repository (at most one per known language), so the files are read once.
    """
    per_language = classified.groupBy("repo_id", "language").agg(
        F.count_if(F.col("lines") > 0).alias("files"), F.sum("lines").alias("lines"))
    shares = per_language.withColumn("total", F.sum("lines").over(Window.partitionBy("repo_id")))
    return shares.where((F.col("language") != "Unknown") & (F.col("lines") > 0)).select(
        "repo_id",
        "language",
        F.bround(F.col("lines") / F.col("total") * 100, 2).alias("percentage"),
        "files",
        "lines",
    )


def primary_language(stats: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """L4: the language with the largest share (ties: first by name), else Unknown."""
    best = stats.groupBy("repo_id").agg(
        F.min_by("language", F.struct(-F.col("percentage"), F.col("language"))).alias("language"))
    if repos is None:
        return best
    return repos.select("repo_id").distinct().join(best, "repo_id", "left").select(
        "repo_id", F.coalesce("language", F.lit("Unknown")).alias("language"))
