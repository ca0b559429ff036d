"""K family: contributors and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.ranking import top_n
from corpuslens.functions.text import strip


def contributors(commits: DataFrame) -> DataFrame:
    """K1: commits per author, with the address and date of the newest one (ties: largest sha)."""
    return commits.groupBy("repo_id", F.col("author").alias("name")).agg(
        F.max_by("email", F.struct("committed_at", "sha")).alias("email"),
        F.count("*").alias("commits"),
        F.max("committed_at").alias("last_commit"))


def recent_commits(commits: DataFrame, n: int = rules.RECENT_COMMITS) -> DataFrame:
    """K2: the newest commits; each map task sends at most ``n`` per repository."""
    newest = top_n(commits, ["repo_id"], [F.col("committed_at").desc(), F.col("sha")], n)
    return newest.select(
        "repo_id", "rank",
        F.substring_index(F.coalesce("message", F.lit("")), "\n", 1).alias("message"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce("email", F.lit("")).alias("email"),
        F.col("committed_at").alias("date"),
        F.substring("sha", 1, 8).alias("sha"))


def repo_git_info(commits: DataFrame, branches: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """K3: number of commits and the newest one; branch and tag counts where those tables exist."""
    info = commits.groupBy("repo_id").agg(
        F.count("*").alias("commits"),
        F.max_by(F.struct(
            F.substring("sha", 1, 8).alias("hash"), strip(F.col("message")).alias("message"), "author",
            F.col("committed_at").alias("date")), F.struct("committed_at", "sha")).alias("last_commit"))
    for refs, column in ((branches, "branches"), (tags, "tags")):
        if refs is not None:
            counted = refs.groupBy("repo_id").agg(F.count("*").alias(column))
            info = info.join(counted, "repo_id", "left").fillna(0, [column])
    return info
