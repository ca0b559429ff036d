"""X family: diagram tables and text.

Texts with a fixed size bound (layers, languages, 60 directory nodes) are built per repository.
The dependency diagram has one line per dependency, so its result is a table of ordered lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.ranking import top_n
from corpuslens.functions.text import sanitize_id, sanitize_label, text_array


def _layer_id(layer: Column) -> Column:
    return F.translate(layer, " -()", "__")


def _language_id(language: Column) -> Column:
    return F.replace(language, F.lit(" "), F.lit("_"))


def _text(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _ranked_languages(stats: DataFrame, n: int) -> DataFrame:
    """The first languages of a repository, largest share first, as one small array."""
    ranked = top_n(stats, ["repo_id"], [F.col("lines").desc(), F.col("language")], n)
    return ranked.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "language", "percentage"))).alias("languages"))


def architecture_diagram(profile: DataFrame, stats: DataFrame) -> DataFrame:
    """The layer chain, up to five languages, and what the first layer is built with."""
    rows = profile.join(_ranked_languages(stats, 5), "repo_id", "left")
    layers, languages, pattern = F.col("layers"), F.col("languages"), F.col("pattern")
    box = lambda l: F.concat(F.lit("        "), _layer_id(l), F.lit("[<b>"), l, F.lit("</b>]"))

    def layer_lines(layer: Column, i: Column) -> Column:
        previous = F.get(layers, i - 1)
        edge = F.concat(F.lit("        "), _layer_id(previous), F.lit(" -->|communicates| "), _layer_id(layer))
        return F.when(i > 0, F.array(box(layer), edge)).otherwise(F.array(box(layer)))

    language_lines = F.transform(languages, lambda l: F.concat(
        F.lit("        "), _language_id(l["language"]), F.lit("[<b>"), l["language"], F.lit("</b>: "),
        l["percentage"].cast("string"), F.lit("%]")))
    built = F.concat(
        F.lit("    "), _layer_id(F.get(layers, F.lit(0))), F.lit(" -->|built with| "),
        _language_id(F.get(languages, F.lit(0))["language"]))
    head = F.array(F.lit("graph TD"), F.concat(
        F.lit("    subgraph "), _language_id(pattern), F.lit("["), pattern, F.lit(" Architecture]")))
    language_part = F.concat(
        F.array(F.lit("    subgraph Languages[Languages]")), language_lines, F.array(F.lit("    end"), built))
    none = F.array().cast("array<string>")
    return rows.select("repo_id", _text(
        head, F.flatten(F.transform(layers, layer_lines)), F.array(F.lit("    end")),
        F.when(languages.isNotNull(), language_part).otherwise(none)).alias("text"))


def layer_diagram(profile: DataFrame) -> DataFrame:
    """The chain of layers."""
    layers = F.when(F.size("layers") > 0, F.col("layers")).otherwise(text_array(rules.DIAGRAM_FALLBACK_LAYERS))

    def lines(layer: Column, i: Column) -> Column:
        box = F.concat(F.lit("    L"), i.cast("string"), F.lit("[<b>"), layer, F.lit("</b>]"))
        edge = F.concat(F.lit("    L"), (i - 1).cast("string"), F.lit(" --> L"), i.cast("string"))
        return F.when(i > 0, F.array(box, edge)).otherwise(F.array(box))

    return profile.select(
        "repo_id", _text(F.array(F.lit("flowchart LR")), F.flatten(F.transform(layers, lines))).alias("text"))


def sequence_diagram(profile: DataFrame) -> DataFrame:
    """Client, server and database with the middle layers between them."""
    layers = F.when(F.size("layers") > 0, F.col("layers")).otherwise(text_array(rules.DIAGRAM_FALLBACK_SEQUENCE))
    middle = F.slice(layers, F.lit(2), F.greatest(F.size(layers) - 2, F.lit(0)))
    participants = F.transform(middle, lambda l: F.concat(F.lit("    participant "), _layer_id(l), F.lit(" as "), l))
    delegations = F.flatten(F.transform(middle, lambda l: F.array(
        F.concat(F.lit("    Server->>"), _layer_id(l), F.lit(": Delegate")),
        F.concat(F.lit("    "), _layer_id(l), F.lit("-->>Server: Response")))))
    return profile.select("repo_id", _text(
        text_array(["sequenceDiagram", "    participant Client as Client", "    participant Server as Server"]),
        participants,
        F.array(F.lit("    participant DB as Database"), F.lit(""), F.lit("    Client->>Server: HTTP Request"),
                F.concat(F.lit("    Server->>Server: Process ("), "pattern", F.lit(")"))),
        delegations,
        text_array(["    Server->>DB: Query", "    DB-->>Server: Result", "    Server-->>Client: HTTP Response"]),
    ).alias("text"))


def dependency_diagram(deps: DataFrame, stats: DataFrame) -> DataFrame:
    """X2 as ordered lines: (repo_id, section, source, part, name, line).

    Section 1 opens, 2 holds the ecosystems (part 1 head, 2 dependencies, 3 end), 3 closes, 4 holds
    the first three languages.  A dependency stays one row, so no group is collected.  All other lines of a
    repository come from one small row (its ecosystems and three languages), so that the plan reads ``deps``
    twice and ``stats`` once, however many kinds of lines there are.
    """
    def line(section: int, source: Column, part: int, name: Column, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), source.alias("source"), F.lit(part).alias("part"),
            name.alias("name"), value.alias("line"))

    none = F.lit("")
    counts = deps.groupBy("repo_id", "source").agg(F.count("*").alias("n"))
    languages = top_n(stats, ["repo_id"], [F.col("lines").desc(), F.col("language")], 3)
    ecosystem, language = F.struct("source", "n").alias("ecosystem"), F.struct("rank", "language").alias("language")
    parts = counts.select("repo_id", ecosystem, F.lit(None).cast("struct<rank:int,language:string>").alias("language")).unionByName(
        languages.select("repo_id", F.lit(None).cast("struct<source:string,n:bigint>").alias("ecosystem"), language))
    repos = parts.groupBy("repo_id").agg(
        F.collect_list("ecosystem").alias("ecosystems"), F.collect_list("language").alias("languages"))

    def of_ecosystem(e: Column) -> Column:
        head = F.concat(
            F.lit("        subgraph "), sanitize_id(e["source"]), F.lit("["), F.upper(e["source"]), F.lit(" - "),
            e["n"].cast("string"), F.lit(" deps]"))
        return F.array(line(2, e["source"], 1, none, head), line(2, e["source"], 3, none, F.lit("        end")))

    def of_language(x: Column) -> Column:
        return line(4, none, 2, x["rank"].cast("string"), F.concat(
            F.lit("        "), _language_id(x["language"]), F.lit("[<b>"), x["language"], F.lit("</b>]")))

    around = F.array(
        line(1, none, 1, none, F.lit("graph LR")),
        line(1, none, 2, none, F.lit("    subgraph Project[Project Dependencies]")),
        line(3, none, 1, none, F.lit("    end")))
    around_languages = F.array(
        line(4, none, 1, none, F.lit("    subgraph Lang[Languages]")), line(4, none, 3, none, F.lit("    end")))
    lines = F.concat(
        around, F.flatten(F.transform("ecosystems", of_ecosystem)), F.transform("languages", of_language),
        F.when(F.size("languages") > 0, around_languages).otherwise(F.slice(around_languages, 1, 0)))
    of_deps = line(2, F.col("source"), 2, F.col("name"), F.concat(
        F.lit("            "), sanitize_id(F.col("name")), F.lit("[<b>"), sanitize_label(F.col("name")), F.lit("</b>]")))
    return repos.select("repo_id", F.explode(lines).alias("x")).select("repo_id", "x.*").unionByName(
        deps.select("repo_id", of_deps.alias("x")).select("repo_id", "x.*"))


DEPENDENCY_LINE_ORDER = ["section", "source", "part", "name"]


def write_lines(lines: DataFrame, order: list[str], out: str) -> None:
    """Write line tables as text, one folder per repository.  Range partitioning by the order keeps
    files and lines in sequence, and a huge repository spreads over many of them."""
    ordered = lines.repartitionByRange("repo_id", *order).sortWithinPartitions("repo_id", *order)
    ordered.select("repo_id", "line").write.mode("overwrite").partitionBy("repo_id").text(out)


def directory_nodes(
    files: DataFrame, limit: int = rules.DIRECTORY_NODES, levels: int = rules.DIRECTORY_LEVELS,
) -> DataFrame:
    """The first nodes of the path tree in pre-order, siblings by name.

    Pre-order is the order of the arrays of path parts, so the first ``limit`` nodes lie in the first as many
    distinct paths, cut to the last level (one more, as the next path may show that a file is a folder too).
    The rank limit works in the map tasks; only these paths are shuffled and cut into their prefixes.
    """
    parts = F.split("path", "/")
    kept = prune_paths(files, "P1").select(
        "repo_id", F.slice(parts, 1, levels).alias("cut"), (F.size(parts) > levels).alias("deeper"))
    in_order = Window.partitionBy("repo_id").orderBy("cut")
    cut = kept.withColumn("nth", F.dense_rank().over(in_order)).where(F.col("nth") <= limit + 1).drop("nth")
    prefixes = cut.select("repo_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("cut")),
        lambda n: F.struct(F.slice("cut", F.lit(1), n).alias("node"), ((n < F.size("cut")) | F.col("deeper")).alias("is_dir")))).alias("x"))
    nodes = prefixes.groupBy("repo_id", F.col("x.node").alias("node")).agg(F.bool_or("x.is_dir").alias("is_dir"))
    first = top_n(nodes, ["repo_id"], [F.col("node")], limit).withColumn("node_no", F.col("rank") - 1)
    # at most ``limit`` rows of a repository meet in this window
    all_nodes = F.collect_list(F.struct("node", "node_no")).over(Window.partitionBy("repo_id"))
    above = F.slice(F.col("node"), F.lit(1), F.size("node") - 1)
    found = first.withColumn("above", above).withColumn("nodes", all_nodes)
    return found.select(
        "repo_id", "node_no", F.get(F.filter("nodes", lambda x: x["node"] == F.col("above")), F.lit(0))["node_no"].alias("parent_no"),
        F.element_at("node", -1).alias("name"), (F.size("node") - 1).alias("depth"), "is_dir")


def directory_diagram(nodes: DataFrame) -> DataFrame:
    """The directory tree as text; at most 60 nodes per repository."""
    number = F.col("node_no").cast("string")
    box = F.concat(
        F.lit("    N"), number, F.lit("[<b>"), "name", F.when(F.col("is_dir"), "</b>/]").otherwise("</b>]"))
    edge = F.concat(F.lit("\n    N"), F.col("parent_no").cast("string"), F.lit(" --> N"), number)
    line = F.concat(box, F.coalesce(edge, F.lit("")))
    return nodes.select("repo_id", "node_no", line.alias("line")).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("node_no", "line"))).alias("rows")).select(
        "repo_id", F.concat(F.lit("flowchart TD\n"), F.array_join("rows.line", "\n")).alias("text"))


def diagram_text(profile: DataFrame, stats: DataFrame, nodes: DataFrame, dependency: DataFrame | None = None) -> DataFrame:
    """All diagrams of bounded size as (repo_id, type, text).

    With the lines of the dependency diagram, which has no bound, it takes part as one row a line, type `dependency`.
    Rows then have the columns of ``DEPENDENCY_LINE_ORDER`` too: lines of one diagram joined in that order are its text.
    """
    kinds = {
        "architecture": architecture_diagram(profile, stats),
        "sequence": sequence_diagram(profile),
        "directory": directory_diagram(nodes),
        "layer": layer_diagram(profile),
    }
    out = None
    for kind, texts in kinds.items():
        rows = texts.select("repo_id", F.lit(kind).alias("type"), "text")
        out = rows if out is None else out.unionByName(rows)
    if dependency is None:
        return out
    whole_text = {"section": F.lit(1), "source": F.lit(""), "part": F.lit(1), "name": F.lit("")}
    return out.withColumns(whole_text).unionByName(dependency.select(
        "repo_id", F.lit("dependency").alias("type"), F.col("line").alias("text"), *DEPENDENCY_LINE_ORDER))
