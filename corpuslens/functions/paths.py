"""Path predicates and path parts, all as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.rules import PRUNED_DIRS


def _pruned_regex(profile: str) -> str:
    return r"(?:\.[^/]*|" + "|".join(re.escape(d) for d in PRUNED_DIRS[profile]) + ")"


def is_pruned(path: Column, profile: str = "P1") -> Column:
    """True below a pruned directory.  Only directories are tested, never the file name."""
    return F.rlike(path, F.lit("(?s)(?:^|/)" + _pruned_regex(profile) + "/"))


def prune_paths(files: DataFrame, profile: str = "P1") -> DataFrame:
    """A plain filter on ``path``, so it is applied in the scan stage before any shuffle."""
    return files.where(~is_pruned(F.col("path"), profile))


def walked_directory(path: Column, profile: str) -> Column:
    """The directory of a file, cut before its first pruned component (``''`` is the root)."""
    rooted = F.concat(F.lit("/"), F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path))))
    kept = F.regexp_replace(rooted, "(?s)/" + _pruned_regex(profile) + "/.*", "/")
    return F.trim(F.when(is_pruned(path, profile), kept).otherwise(rooted), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(base_name(path)) - 1, F.lit(0)))


def extension(name: Column) -> Column:
    """Lower-cased extension; leading dots belong to the stem (``.gitignore`` has none)."""
    stem = F.ltrim(name, F.lit("."))
    return F.when(~F.contains(stem, F.lit(".")), F.lit("")).otherwise(
        F.lower(F.concat(F.lit("."), F.substring_index(stem, ".", -1))))


def path_parts(files: DataFrame) -> DataFrame:
    """S3: add ``dir``, ``name``, ``ext``.

    A packed corpus already stores them as columns; they are then used as they are, so that
    filters on them reach the Parquet scan as pushed filters.
    """
    out = files
    if "dir" not in out.columns:
        out = out.withColumn("dir", directory(F.col("path")))
    if "name" not in out.columns:
        out = out.withColumn("name", base_name(F.col("path")))
    if "ext" not in out.columns:
        out = out.withColumn("ext", extension(F.col("name")))
    return out


def below_directory(path: Column, names: list[str]) -> Column:
    """True when one of the directories above the file has one of these names."""
    return F.rlike(path, F.lit("(?s)(?:^|/)(?:" + "|".join(names) + ")/"))
