"""The registered queries: one per operator, over corpora derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import corpus
from corpuslens.functions.paths import path_parts, prune_paths
from corpuslens.functions.ranking import first_n
from corpuslens.functions.text import sanitize_id, sanitize_label
from corpuslens.operators import (
    architecture, calls, complexity, diagrams, files, frameworks, health, history, manifests, pyfacts, retrieval,
    schemas, symbols,
)
from corpuslens.plans import questions, report
from corpuslens.plans.analysis import Analysis, stored
from corpuslens.session import staging_folder
from corpuslens.sources import results
from corpuslens.sources.corpus import scan_corpus, scan_tree, write_corpus, write_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def over(name: str, corpus_name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Register an operator of one input over one corpus."""
    QUERIES[name] = lambda spark, sf: operator(corpus(spark, sf, corpus_name))


def joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def whole(spark: SparkSession, sf: str) -> Analysis:
    """The full analysis, as it runs on a cluster: packed corpus, staged fact tables.

    Queries of one application share the staged tables of a scale factor.
    """
    return _analysis(spark.sparkContext.applicationId, sf)


@cache
def _analysis(application: str, sf: str) -> Analysis:
    spark = SparkSession.active()
    folder = staging_folder(spark)
    write_corpus(corpus(spark, sf, "all"), f"{folder}/files", partitions=spark.sparkContext.defaultParallelism)
    return Analysis(scan_corpus(spark, f"{folder}/files"), corpus(spark, sf, "commits"), stored(folder))


# --- scans and predicates -------------------------------------------------------------------------
@query("prune_paths")
def _(spark, sf):
    rows = corpus(spark, sf, "files")
    out = None
    for profile in ("P1", "P2", "P3", "P4"):
        kept = prune_paths(rows, profile).select(F.lit(profile).alias("profile"), "repo_id", "path")
        out = kept if out is None else out.unionByName(kept)
    return out


over("path_parts", "all", lambda df: path_parts(df).select("repo_id", "path", "dir", "name", "ext"))
over("previews", "files", lambda df: files.file_previews(df).select("repo_id", "path", "preview"))
over("readme", "files", files.pick_readme)
over("repo_size", "all", files.repo_size)

# --- languages --------------------------------------------------------------------------------------
over("classify_language", "all", lambda df: files.classify_language(df).select("repo_id", "path", "language"))
over("count_lines", "all", lambda df: files.count_lines(df).select("repo_id", "path", "lines"))
over("language_stats", "all", lambda df: files.language_stats(files.files_classified(df)))


@query("primary_language")
def _(spark, sf):
    rows = corpus(spark, sf, "all")
    return files.primary_language(files.language_stats(files.files_classified(rows)), rows)


# --- frameworks ---------------------------------------------------------------------------------------
over("framework_by_file", "all", frameworks.framework_by_file)
over("framework_by_dep", "all", frameworks.framework_by_dep)
over("framework_version", "all", frameworks.framework_version)
over("frameworks", "all", frameworks.frameworks)

# --- dependencies -------------------------------------------------------------------------------------
for _name in ("npm", "pypi", "cargo", "go", "gem", "pub", "maven"):
    over(f"deps_{_name}", "manifests", getattr(manifests, f"deps_{_name}"))
over("dependencies", "all", manifests.dependencies)
over("deps_by_source", "all", lambda df: manifests.deps_by_source(manifests.dependencies(df)))

# --- symbols ------------------------------------------------------------------------------------------
SYMBOL_CORPORA = {"jsts": "code", "java": "lang", "go": "lang", "rust": "lang", "csharp": "lang", "php": "web"}
for _name, _corpus in SYMBOL_CORPORA.items():
    over(f"symbols_{_name}", _corpus, getattr(symbols, f"symbols_{_name}"))
over("symbols_jsx", "web", symbols.symbols_jsts)
over("symbols_python", "py", lambda df: symbols.symbols_python(pyfacts.python_facts(df)))
for _name, _corpus in (("definitions_jsts", "code"), ("definitions_jsx", "web")):
    over(_name, _corpus, lambda df: symbols.jsts_definitions(df).select(
        "repo_id", "path", "kind", "line", "name", joined("bases")))
over("definitions_java", "lang", lambda df: symbols.java_definitions(df).select(
    "repo_id", "path", "kind", "line", "name", joined("bases"), joined("interfaces")))
over("definitions_python", "py", lambda df: symbols.python_definitions(pyfacts.python_facts(df)).select(
    "repo_id", "path", "kind", "seq", "name", "line", joined("bases"), joined("decorators")))
over("modules", "all", lambda df: symbols.modules(df).select(
    "repo_id", "path", "name", "type", "language", *[joined(c) for c in symbols.ARRAYS]))

# --- call graph ---------------------------------------------------------------------------------------
over("call_edges", "code", lambda df: calls.call_edges(calls.generic_functions(df)))
over("call_edges_lang", "lang", lambda df: calls.call_edges(calls.generic_functions(df)))
over("call_edges_python", "py", lambda df: calls.call_edges(calls.python_functions(pyfacts.python_facts(df))))


@query("call_graph")
def _(spark, sf):
    rows = corpus(spark, sf, "code").unionByName(corpus(spark, sf, "py")).unionByName(corpus(spark, sf, "web"))
    graph = calls.call_graph(calls.all_functions(rows, pyfacts.python_facts(rows)))
    return graph.select("repo_id", "fn_id", joined("callees"))


over("calls_per_function", "code", lambda df: report.calls_per_function(calls.call_graph(calls.generic_functions(df))))

# --- architecture -------------------------------------------------------------------------------------
over("arch_dir_hits", "files", architecture.arch_dir_hits)
over("arch_file_hits", "all", lambda df: architecture.arch_file_hits(df).select("repo_id", "pattern", "path", "name", "rule_no"))
over("arch_content_hits", "all", architecture.arch_content_hits)
over("arch_scores", "all", lambda df: architecture.arch_scores(df).select("repo_id", "pattern", "score"))
over("architecture", "all", lambda df: architecture.architecture(architecture.arch_scores(df)).drop("scores"))
over("arch_profile", "files", lambda df: architecture.arch_profile(
    architecture.architecture(architecture.arch_scores(df))).select(
    "repo_id", "pattern", "description", joined("layers")))
over("arch_evidence", "all", lambda df: architecture.arch_evidence(
    df, architecture.architecture(architecture.arch_scores(df))))
over("arch_top5", "all", lambda df: architecture.arch_top5(architecture.arch_scores(df)))

# --- complexity ---------------------------------------------------------------------------------------
over("code_totals", "all", complexity.code_totals)
over("generic_counts", "all", complexity.generic_counts)
over("python_function_metrics", "py", lambda df: pyfacts.python_function_metrics(pyfacts.python_facts(df)))
over("complexity", "all", lambda df: complexity.complexity(df, pyfacts.python_facts(df)))

# --- database schemas ---------------------------------------------------------------------------------
SCHEMA_CORPORA = {"sql": "schema", "laravel": "orm", "alembic": "orm", "py_ddl": "orm", "django": "orm",
                  "sqlalchemy": "orm", "typeorm": "orm", "prisma": "orm"}
for _name, _corpus in SCHEMA_CORPORA.items():
    over(f"schema_{_name}", _corpus, lambda df, _f=getattr(schemas, f"schema_{_name}"): schemas.db_columns(_f(df)))
over("db_foreign_keys", "schema", lambda df: schemas.db_foreign_keys(schemas.schema_sql(df)))
over("database_schema", "all", lambda df: schemas.table_counts(schemas.database_schema(schemas.db_tables(df))))
over("db_columns", "all", lambda df: schemas.db_columns(schemas.database_schema(schemas.db_tables(df))))

# --- history ------------------------------------------------------------------------------------------
over("contributors", "commits", lambda df: history.contributors(df).select(
    "repo_id", "name", "email", "commits", stamp("last_commit")))
over("recent_commits", "commits", lambda df: history.recent_commits(df).select(
    "repo_id", "rank", "message", "author", "email", stamp("date"), "sha"))
over("repo_git_info", "commits", lambda df: history.repo_git_info(df).select(
    "repo_id", "commits", F.col("last_commit.hash").alias("hash"), F.col("last_commit.message").alias("message"),
    F.col("last_commit.author").alias("author"),
    F.date_format("last_commit.date", "yyyy-MM-dd HH:mm:ss").alias("date")))

# --- health -------------------------------------------------------------------------------------------
QUERIES["health"] = lambda spark, sf: whole(spark, sf)["health"]
QUERIES["health_breakdown"] = lambda spark, sf: health.health_breakdown(whole(spark, sf)["health"])
QUERIES["recommendations"] = lambda spark, sf: health.recommendations(whole(spark, sf)["health"])
QUERIES["health_label"] = lambda spark, sf: whole(spark, sf)["health"].select(
    "repo_id", "overall", health.health_label(F.col("overall")).alias("label"))


# --- questions ----------------------------------------------------------------------------------------
over("question_keywords", "questions", retrieval.question_keywords)
QUERIES["history_window"] = lambda spark, sf: retrieval.history_window(
    spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def _retrieval(spark, sf):
    keywords = retrieval.question_keywords(corpus(spark, sf, "questions"))
    rows = corpus(spark, sf, "files")
    return keywords, files.file_previews(rows), symbols.modules(rows)


@query("score_content")
def _(spark, sf):
    keywords, previews, _m = _retrieval(spark, sf)
    return retrieval.score_content(keywords, previews, stored(staging_folder(spark)))


@query("score_modules")
def _(spark, sf):
    keywords, previews, modules = _retrieval(spark, sf)
    stage = stored(staging_folder(spark))
    hits = stage("content_hits", retrieval.content_hits(keywords, previews, stage))
    return retrieval.score_modules(keywords, modules, hits, stage)


def _matches(spark, sf):
    return retrieval.MatchClasses(*_retrieval(spark, sf), stage=stored(staging_folder(spark)))


@query("file_classes")
def _(spark, sf):
    """Files that match the same keywords, named by the first path."""
    return _matches(spark, sf).members


@query("class_keywords")
def _(spark, sf):
    return _matches(spark, sf).postings


@query("expanded_scores")
def _(spark, sf):
    """Every hundredth question against all files, from the factors."""
    return _matches(spark, sf).expand(corpus(spark, sf, "questions").where("q_id % 100 = 0"))


@query("relevant_files")
def _(spark, sf):
    return retrieval.relevant_files(*_retrieval(spark, sf), stage=stored(staging_folder(spark)))


@query("relevant_context")
def _(spark, sf):
    return retrieval.relevant_context(retrieval.relevant_files(*_retrieval(spark, sf), stage=stored(staging_folder(spark))))


@query("source_attribution")
def _(spark, sf):
    return retrieval.source_attribution(corpus(spark, sf, "answers"), files.file_previews(corpus(spark, sf, "files")))


QUERIES["prompt_context"] = lambda spark, sf: questions.prompt_lines(whole(spark, sf))


# --- diagrams -----------------------------------------------------------------------------------------
def _profile(df):
    return architecture.arch_profile(architecture.architecture(architecture.arch_scores(df)))


over("directory_nodes", "files", diagrams.directory_nodes)
over("directory_diagram", "files", lambda df: diagrams.directory_diagram(diagrams.directory_nodes(df)))


@query("dependency_diagram")
def _(spark, sf):
    """Both inputs are staged: a plan that holds the whole corpus for each of their uses fills the driver."""
    rows, stage = corpus(spark, sf, "all"), stored(staging_folder(spark))
    return diagrams.dependency_diagram(
        stage("dependencies", manifests.dependencies(rows)),
        stage("language_stats", files.language_stats(files.files_classified(rows))))


over("architecture_diagram", "files", lambda df: diagrams.architecture_diagram(
    _profile(df), files.language_stats(files.files_classified(df))))
over("sequence_diagram", "files", lambda df: diagrams.sequence_diagram(_profile(df)))
over("layer_diagram", "files", lambda df: diagrams.layer_diagram(_profile(df)))
over("sanitize", "all", lambda df: df.select(
    "repo_id", "path", sanitize_id(F.col("path")).alias("node_id"),
    sanitize_label(F.concat(F.lit("<"), "path", F.lit(">[+]"))).alias("label")))


# --- results ------------------------------------------------------------------------------------------
@query("summary")
def _(spark, sf):
    s = report.analysis_summary(whole(spark, sf))
    return s.select(
        "repo_id", F.size("languages").alias("languages"), F.size("frameworks").alias("frameworks"),
        F.col("architecture.pattern").alias("pattern"), F.col("architecture.confidence").alias("confidence"),
        F.col("complexity.total_lines").alias("total_lines"), "health_score", "dependencies_count", "modules_count",
        "contributors_count")


@query("export_report")
def _(spark, sf):
    rows = report.export_report(whole(spark, sf))
    field = lambda p: F.get_json_object("body", p)
    return rows.groupBy("repo_id", "section").agg(
        F.count("*").alias("items"), F.max(field("$.health_score").cast("double")).alias("health_score"),
        F.max(field("$.commit_count").cast("long")).alias("commit_count"),
        F.max(field("$.database_tables").cast("long")).alias("database_tables"),
        F.min(field("$.name")).alias("first_name"))


@query("export_documents")
def _(spark, sf):
    """What a reader of the exported rows finds for each repository: its head and the number of rows of each list."""
    rows = report.export_report(whole(spark, sf))
    of_head = lambda p: F.max(F.when(F.col("section") == "report", F.get_json_object("body", p)))
    return rows.groupBy("repo_id").agg(
        *[F.json_array_length(of_head(f"$.{s}")).alias(s) for s in ("languages", "frameworks")],
        *[F.count_if(F.col("section") == s).cast("int").alias(s) for s in report.REPORT_LISTS],
        of_head("$.architecture.pattern").alias("pattern"))


@query("scan_corpus")
def _(spark, sf):
    folder = staging_folder(spark)
    write_corpus(corpus(spark, sf, "all"), folder)
    return scan_corpus(spark, folder).select("repo_id", "path", "ext", F.md5("content").alias("digest"))


@query("scan_tree")
def _(spark, sf):
    """Pages written as raw files, some with malformed UTF-8 and odd names, and scanned."""
    folder = staging_folder(spark)
    write_tree(corpus(spark, sf, "pages").withColumn("content", F.concat("content", F.when(
        F.col("broken"), F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit(""))))), folder)
    return scan_tree(spark, folder).select("repo_id", "path", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@query("results_store")
def _(spark, sf):
    """Write, replace the newest commits of some repositories, drop one, read everything back."""
    folder = staging_folder(spark)
    commits = corpus(spark, sf, "commits")
    results.write_results(history.contributors(commits).select("repo_id", "name", "commits"), folder, buckets=8)
    again = history.contributors(commits.where("repo_id IN ('repo1', 'repo2')"))
    results.write_results(again.select("repo_id", "name", (F.col("commits") * 2).alias("commits")), folder)
    results.drop_result(spark, folder, "repo3")
    return results.read_results(spark, folder)


@query("result_of_one")
def _(spark, sf):
    """Write all repositories, fetch one."""
    folder = staging_folder(spark)
    results.write_results(history.contributors(corpus(spark, sf, "commits")).select("repo_id", "name", "commits"), folder, buckets=8)
    return results.read_result(spark, folder, "repo1")


QUERIES["diagram_text"] = lambda spark, sf: whole(spark, sf).all_diagrams
QUERIES["repo_counts"] = lambda spark, sf: report.repo_counts(whole(spark, sf))
QUERIES["search_entities"] = lambda spark, sf: report.search_entities(whole(spark, sf), "R1")
over("first_n", "all", lambda df: first_n(
    manifests.dependencies(df), 50, [F.col("source_file"), F.col("seq")]).select(
    "repo_id", "rank", "source_file", "seq", "name"))
