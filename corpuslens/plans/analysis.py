"""The whole analysis of a corpus as a set of tables.

An ``Analysis`` declares every result table over ``files`` and ``commits``.  A table is planned when
it is asked for.  ``stage`` decides what is materialised on the way: nothing by default; with
``stored(folder)`` every table that others start from is written once and read back, so the contents
are read twice (all facts of single texts in one pass, and the Python leaf), other tables start from narrow
facts, and a lost executor costs one task instead of the whole lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import is_pruned
from corpuslens.operators import (
    architecture, calls, complexity, diagrams, files as file_ops, frameworks, health, history, manifests,
    pyfacts, schemas, symbols,
)
from corpuslens.session import COMPRESSION, shuffles_freed

Stage = Callable[[str, DataFrame], DataFrame]


def lazily(name: str, df: DataFrame) -> DataFrame:
    return df


def stored(folder: str) -> Stage:
    """Write each staged table below a shared folder and continue from there.

    What was shuffled for it goes with its job, instead of when the driver happens to collect garbage.
    """

    def stage(name: str, df: DataFrame) -> DataFrame:
        target = f"{folder.rstrip('/')}/{name}"
        with shuffles_freed(df.sparkSession):
            df.write.mode("overwrite").option("compression", COMPRESSION).parquet(target)
        return df.sparkSession.read.parquet(target)

    return stage


def content_facts(files: DataFrame) -> DataFrame:
    """One pass over the contents for every fact that a single text gives: one row a file, nested facts as columns.

    Counts and pattern scores, ``preview``, ``readme``, ``names`` (modules), ``calls`` (functions with callees),
    ``packages``, ``rules`` (frameworks) and ``tables``; NULL where a file is not read for them.  Written once, each
    table reads only its columns.  Facts of Python files that need their syntax tree are apart.
    """
    rows = file_ops.classify_language(file_ops.with_text(architecture.walked(files)))
    text, ext, name = F.col("text"), F.col("ext"), F.col("name")
    walked, reads = ~is_pruned(F.col("path"), "P1"), ~is_pruned(F.col("path"), "P3")
    table_files, tables = schemas.tables_in()
    return rows.select(
        "repo_id", "path", "dir", "name", "ext", "language", walked.alias("walked"),
        *complexity.file_counts(), *architecture.file_tenths(),
        F.when(walked & ext.isin(rules.PREVIEW_EXTENSIONS), F.substring(text, 1, rules.PREVIEW_CHARS)).alias("preview"),
        F.when(F.col("path").isin(rules.README_NAMES), F.substring(text, 1, rules.README_CHARS)).alias("readme"),
        F.when(walked & ext.isin(symbols.ALL_EXTENSIONS), F.struct(*symbols.name_arrays(symbols.ALL_LANGUAGES))).alias("names"),
        F.when(walked & ext.isin(list(rules.CALL_DEFINITIONS)), calls.functions_in()).alias("calls"),
        F.when(walked & name.isin(list(manifests.FORMATS)), manifests.packages_in()).alias("packages"),
        F.when(name.isin(frameworks.MANIFESTS), frameworks.rules_in()).alias("rules"),
        F.when(reads & table_files, tables).alias("tables"))


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("repo_id").agg(F.count("*").alias(name))


class Analysis:
    """Result tables by name, as attributes or items."""

    def __init__(self, files: DataFrame, commits: DataFrame, stage: Stage = lazily, repos: DataFrame | None = None) -> None:
        self._repos = repos
        self.files = files
        self.commits = commits
        self.stage = stage

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    # --- facts per file ---------------------------------------------------------------------
    @cached_property
    def file_facts(self) -> DataFrame:
        return self.stage("file_facts", content_facts(self.files))

    def _having(self, column: str) -> DataFrame:
        return self.file_facts.where(F.col(column).isNotNull())

    @cached_property
    def repos(self) -> DataFrame:
        """Every repository has a result: given ones, or all with a file (pruned ones too) or a commit."""
        if self._repos is not None:
            return self._repos
        return self.files.select("repo_id").union(self.commits.select("repo_id")).distinct()

    @cached_property
    def files_classified(self) -> DataFrame:
        return self.file_facts.where("walked").select("repo_id", "path", "dir", "name", "ext", "language", "lines")

    @cached_property
    def python_facts(self) -> DataFrame:
        return self.stage("python_facts", pyfacts.python_facts(self.files))

    @cached_property
    def previews(self) -> DataFrame:
        return self._having("preview").select("repo_id", "path", "name", "preview")

    @cached_property
    def modules(self) -> DataFrame:
        by_pattern = self._having("names").select("repo_id", "path", "names.*")
        return symbols.modules(self.files, self.python_facts, by_pattern)

    @cached_property
    def functions(self) -> DataFrame:
        return calls.as_functions(self._having("calls")).unionByName(calls.python_functions(self.python_facts))

    @cached_property
    def call_graph(self) -> DataFrame:
        return calls.call_graph(self.functions)

    @cached_property
    def dependencies(self) -> DataFrame:
        return manifests.as_dependencies(self._having("packages"))

    # --- facts per repository -----------------------------------------------------------------
    @cached_property
    def readme(self) -> DataFrame:
        return file_ops.pick_readme(self._having("readme"))

    @cached_property
    def language_stats(self) -> DataFrame:
        return self.stage("language_stats", file_ops.language_stats(self.files_classified))

    @cached_property
    def frameworks(self) -> DataFrame:
        return self.stage("frameworks", frameworks.frameworks(
            self.files, frameworks.as_manifest_facts(self._having("rules"))))

    @cached_property
    def arch_scores(self) -> DataFrame:
        return self.stage("arch_scores", architecture.arch_scores(self.files, self.file_facts))

    @cached_property
    def architecture(self) -> DataFrame:
        return architecture.arch_profile(architecture.architecture(self.arch_scores))

    @cached_property
    def arch_evidence(self) -> DataFrame:
        return architecture.arch_evidence(self.files, self.architecture)

    @cached_property
    def complexity(self) -> DataFrame:
        return self.stage(
            "complexity", complexity.complexity(self.files, self.python_facts, self.file_facts.where("walked")))

    @cached_property
    def database_schema(self) -> DataFrame:
        return self.stage("database_schema", schemas.database_schema(schemas.as_tables(self._having("tables"))))

    @cached_property
    def contributors(self) -> DataFrame:
        return self.stage("contributors", history.contributors(self.commits))

    @cached_property
    def recent_commits(self) -> DataFrame:
        return history.recent_commits(self.commits)

    # --- scores and diagrams --------------------------------------------------------------------
    @cached_property
    def health(self) -> DataFrame:
        inputs = health.health_inputs(
            self.repos, self.files_classified, self.dependencies, self.frameworks, self.architecture, self.complexity,
            counted(self.modules, "modules_n"), counted(self.contributors, "contributors_n"), self.readme)
        return self.stage("health", health.health(inputs))

    @cached_property
    def directory_nodes(self) -> DataFrame:
        return self.stage("directory_nodes", diagrams.directory_nodes(self.files))

    @cached_property
    def diagrams(self) -> DataFrame:
        return diagrams.diagram_text(self.architecture, self.language_stats, self.directory_nodes)

    @cached_property
    def dependency_diagram(self) -> DataFrame:
        return diagrams.dependency_diagram(self.dependencies, self.language_stats)

    @cached_property
    def all_diagrams(self) -> DataFrame:
        """The five kinds of diagrams; that of the dependencies as one row a line."""
        return diagrams.diagram_text(self.architecture, self.language_stats, self.directory_nodes, self.dependency_diagram)
