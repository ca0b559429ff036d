"""Summary, counts, search and export over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.analysis import Analysis, counted


def _one(df: DataFrame, name: str) -> DataFrame:
    """A table with one row per repository as a single struct column."""
    rest = [c for c in df.columns if c != "repo_id"]
    return df.select("repo_id", F.struct(*rest).alias(name))


def _few(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A table with a fixed maximum of rows per repository (languages, rules) as an array."""
    rest = [c for c in df.columns if c not in ("repo_id", *order)]
    return df.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def analysis_summary(t: Analysis, repos: DataFrame | None = None) -> DataFrame:
    """One row per repository; large children appear as counts only."""
    out = t["repos"] if repos is None else repos
    for side in (
        _few(t["language_stats"], "languages", ["language"]),
        _few(t["frameworks"], "frameworks", ["rule_no"]),
        _one(t["architecture"], "architecture"),
        _one(t["complexity"], "complexity"),
        t["health"].select("repo_id", F.col("overall").alias("health_score")),
        counted(t["dependencies"], "dependencies_count"),
        counted(t["modules"], "modules_count"),
        counted(t["contributors"], "contributors_count"),
    ):
        out = out.join(side, "repo_id", "left")
    return out.fillna(0, ["dependencies_count", "modules_count", "contributors_count"])


def repo_counts(t: Analysis) -> DataFrame:
    """Q3: the four counts on the front page."""
    out = t["repos"]
    for name in ("contributors", "language_stats", "dependencies", "modules"):
        out = out.join(counted(t[name], name), "repo_id", "left")
    return out.select(
        "repo_id", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (
            ("contributors", "contributors"), ("language_stats", "languages"), ("dependencies", "dependencies"),
            ("modules", "modules"))])


def calls_per_function(call_graph: DataFrame) -> DataFrame:
    """Q3: calls per function."""
    return call_graph.select("repo_id", "fn_id", F.size("callees").alias("calls"))


def search_entities(t: Analysis, term: str) -> DataFrame:
    """Q1: case-insensitive substring over names; an empty term keeps everything.

    The filter is on each branch of the union, so it runs where the branch is read.
    """
    needle = F.lower(F.lit(term))

    def branch(df: DataFrame, entity: str, key: str, *searched: str) -> DataFrame:
        found = F.lit(term == "")
        for column in searched or (key,):
            found = found | F.contains(F.lower(column), needle)
        return df.where(found).select("repo_id", F.lit(entity).alias("entity"), F.col(key).alias("key"))

    rows = [
        branch(t["language_stats"], "language", "language"),
        branch(t["frameworks"], "framework", "framework"),
        branch(t["dependencies"], "dependency", "name"),
        branch(t["call_graph"], "function", "fn_id"),
        branch(t["contributors"], "contributor", "name"),
        branch(t["recent_commits"], "commit", "message", "message", "author"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


REPORT_LISTS = {"dependencies": ["source_file", "seq"], "modules": ["path"], "contributors": ["name"]}


def export_report(t: Analysis, repos: DataFrame | None = None) -> DataFrame:
    """S8 as rows: (repo_id, section, item, body), body being JSON.

    Section `report` is one document with the bounded parts and the counts; each dependency, module
    and contributor is a row of its own section, because their number has no bound.
    """
    head = analysis_summary(t, repos)
    for name, column in (("recent_commits", "commit_count"), ("database_schema", "database_tables")):
        head = head.join(counted(t[name], column), "repo_id", "left").fillna(0, [column])
    fields = [c for c in head.columns if not c.endswith("s_count")]
    out = head.select(
        "repo_id", F.lit("report").alias("section"), F.lit("").alias("item"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
    for section, order in REPORT_LISTS.items():
        rows = t[section]
        body = F.to_json(F.struct(*[c for c in rows.columns if c != "repo_id"]), {"ignoreNullFields": "false"})
        item = F.concat_ws("#", *[F.lpad(F.col(c).cast("string"), 9, "0") if c == "seq" else F.col(c) for c in order])
        out = out.unionByName(rows.select("repo_id", F.lit(section).alias("section"), item.alias("item"), body.alias("body")))
    return out


def write_report(report: DataFrame, out: str) -> None:
    """JSON lines; the range partitioning keeps a repository's rows together and in order."""
    ordered = report.repartitionByRange("repo_id", "section", "item").sortWithinPartitions("repo_id", "section", "item")
    ordered.write.mode("overwrite").json(out)
