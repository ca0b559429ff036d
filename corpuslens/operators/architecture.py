"""A family: architecture pattern scores and their evidence.

Rules are constant regular expressions in the plan, compiled once per task.  Scores are wide
integer sums (tenths), so no row per hit is produced unless the hits themselves are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import is_pruned, path_parts, walked_directory
from corpuslens.functions.ranking import top_n
from corpuslens.functions.text import any_word, bound, literal_map, pattern, text_array, universal_newlines

PATTERNS = [name for name, _ in rules.ARCHITECTURES]
INDICATORS = [
    (p, r, pattern(body), rules.ARCHITECTURE_LITERALS[p][r])
    for p, (_, bodies) in enumerate(rules.ARCHITECTURES)
    for r, body in enumerate(bodies)
]


def _folded(text: Column) -> Column:
    """Text without case.  Indicators are lower case, so they need no slower case-insensitive search;
    four letters that match an ASCII letter only when case is ignored are folded to it.  A text of as many bytes
    as letters holds none of them, and is not taken apart letter by letter."""
    folded = F.lower(F.translate(text, "\u017f\u212a\u0131\u0130", "skii"))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def _found(folded: Column, regex: str, literals: list[str]) -> Column:
    """Whether the indicator is found; most texts hold none of its literals, which is cheaper to see."""
    return any_word(folded, literals) & F.rlike(folded, F.lit(regex))


def _matched(text: Column) -> Column:
    """ARRAY<STRUCT<p, r>> of the indicators found in the text, which is folded once for all of them."""
    def hits(folded: Column) -> Column:
        found = [
            F.when(_found(folded, regex, literals), F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")))
            for p, r, regex, literals in INDICATORS
        ]
        return F.array_compact(F.array(*found))

    return bound(_folded(text), hits)


def _tenths(text: Column, weight: int) -> list[Column]:
    """Per pattern: weight times the number of its indicators found in the text."""
    text = _folded(text)
    sums = []
    for p in range(len(PATTERNS)):
        hits = [_found(text, regex, literals).cast("int") for q, _, regex, literals in INDICATORS if q == p]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        sums.append(total * weight)
    return sums


def walked_directories(files: DataFrame) -> DataFrame:
    """Every directory that is entered, once per repository; the root is `.`."""
    walked = files.select("repo_id", walked_directory(F.col("path"), "P2").alias("leaf")).distinct()
    parts = F.split("leaf", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # outer: see as_functions in calls; a path without a slash is its only prefix
    prefixes = F.when(F.contains("leaf", F.lit("/")), prefixes).otherwise(F.array("leaf"))
    below = walked.where("leaf <> ''").select("repo_id", F.explode_outer(prefixes).alias("dir"))
    root = walked.select("repo_id", F.lit(".").alias("dir"))
    return below.unionByName(root).distinct()


def walked(files: DataFrame) -> DataFrame:
    return path_parts(files.where(~is_pruned(F.col("path"), "P2")))


def _content_head() -> Column:
    """The part of a content that is searched; NULL for files that are not read."""
    suffixes = "|".join(s.replace(".", r"\.") for s in rules.ARCH_CONTENT_SUFFIXES)
    searched = F.rlike("name", F.lit(rf"(?s)(?:{suffixes})\z"))
    return F.when(searched, F.substring(universal_newlines(F.col("content")), 1, rules.ARCH_CONTENT_CHARS))


def _named(hits: DataFrame) -> DataFrame:
    return hits.withColumn("pattern", F.element_at(text_array(PATTERNS), F.col("h.p") + 1)).withColumn(
        "rule_no", F.col("h.r"))


def arch_dir_hits(files: DataFrame) -> DataFrame:
    """A1: directory paths an indicator is found in."""
    hits = walked_directories(files).select("repo_id", "dir", F.explode(_matched(F.col("dir"))).alias("h"))
    return _named(hits).select("repo_id", "pattern", "dir", "rule_no")


def arch_file_hits(files: DataFrame) -> DataFrame:
    """A2: file names an indicator is found in, one row per file and indicator."""
    hits = walked(files).select(
        "repo_id", "path", "dir", "name", F.explode(_matched(F.col("name"))).alias("h"))
    return _named(hits).select("repo_id", "pattern", "path", "dir", "name", "rule_no")


def arch_content_hits(files: DataFrame) -> DataFrame:
    """A3: files whose leading text an indicator is found in."""
    heads = walked(files).select("repo_id", "path", _content_head().alias("head")).where("head is not null")
    hits = heads.select("repo_id", "path", F.explode(_matched(F.col("head"))).alias("h"))
    return _named(hits).select("repo_id", "pattern", "path", "rule_no")


def _long(totals: DataFrame) -> DataFrame:
    """Nine wide sums per repository -> nine rows, so every pattern has a score."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("pattern_no"), F.lit(n).alias("pattern"), F.col(f"t{i}").alias("tenths"))
        for i, n in enumerate(PATTERNS)
    ])
    return totals.select("repo_id", F.explode(cells).alias("c")).select("repo_id", "c.*")


def file_tenths() -> list[Column]:
    """Nine wide sums for one file: its name and, where it is read, its leading text."""
    by_name = _tenths(F.col("name"), rules.ARCH_TENTHS["file"])
    by_head = _tenths(F.coalesce(_content_head(), F.lit("")), rules.ARCH_TENTHS["content"])
    return [(n + h).cast("long").alias(f"t{i}") for i, (n, h) in enumerate(zip(by_name, by_head))]


SUMS = [f"t{i}" for i in range(len(PATTERNS))]


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id").agg(*[F.sum(t).alias(t) for t in SUMS])


def arch_scores(files: DataFrame, file_facts: DataFrame | None = None) -> DataFrame:
    """Score per repository and pattern (all nine), from directories, names and contents.

    ``file_facts`` are stored per-file sums, so that the contents are not searched again.
    """
    by_dir = walked_directories(files).select("repo_id", *[
        t.cast("long").alias(f"t{i}") for i, t in enumerate(_tenths(F.col("dir"), rules.ARCH_TENTHS["directory"]))])
    by_file = walked(files).select("repo_id", *file_tenths()) if file_facts is None else file_facts.select("repo_id", *SUMS)
    totals = _summed(by_dir.unionByName(by_file))
    return _long(totals).select(
        "repo_id", "pattern_no", "pattern", "tenths", (F.col("tenths") / 10).alias("score"))


def architecture(scores: DataFrame) -> DataFrame:
    """A4: the best pattern and its confidence; a repository has nine score rows."""
    best = scores.groupBy("repo_id").agg(
        F.min(F.struct((-F.col("tenths")).alias("minus"), "pattern_no", "pattern")).alias("best"),
        F.sum("tenths").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "score")))).alias("scores"),
    )
    share = F.bround(-F.col("best.minus") / F.col("total") * 100, 2)
    return best.select(
        "repo_id",
        F.col("best.pattern").alias("pattern"),
        F.when(F.col("total") > 0, F.least(share, F.lit(rules.MAX_CONFIDENCE))).otherwise(0.0).alias("confidence"),
        "scores",
    )


def arch_profile(chosen: DataFrame) -> DataFrame:
    """Description and layer names of the pattern, from constant maps."""
    descriptions = {n: d for n, (d, _) in rules.ARCHITECTURE_PROFILES.items()}
    layers = F.create_map(*[
        c for n, (_, names) in rules.ARCHITECTURE_PROFILES.items() for c in (F.lit(n), text_array(names))])
    return chosen.withColumn("description", F.try_element_at(literal_map(descriptions), F.col("pattern"))).withColumn(
        "layers", F.try_element_at(layers, F.col("pattern")))


def arch_evidence(files: DataFrame, chosen: DataFrame, n: int = rules.EVIDENCE_ITEMS) -> DataFrame:
    """A5: the first distinct directories and file names that speak for the chosen pattern.

    Order: directory, rule, the directory before its files, file name.
    """
    by_dir = arch_dir_hits(files).select(
        "repo_id", "pattern", F.concat(F.lit("directory:"), "dir").alias("evidence"),
        F.struct(
            F.when(F.col("dir") == ".", "").otherwise(F.col("dir")).alias("dir"),
            F.col("rule_no"), F.lit(0).alias("kind"), F.lit("").alias("name")).alias("place"))
    by_file = arch_file_hits(files).select(
        "repo_id", "pattern", F.concat(F.lit("file:"), "name").alias("evidence"),
        F.struct("dir", "rule_no", F.lit(1).alias("kind"), "name").alias("place"))
    distinct = by_dir.unionByName(by_file).groupBy("repo_id", "pattern", "evidence").agg(
        F.min("place").alias("place"))
    # ten rows per pattern are enough whichever wins, so the ranking needs no join with big groups
    ranked = top_n(distinct, ["repo_id", "pattern"], [F.col("place"), F.col("evidence")], n)
    return ranked.join(chosen.select("repo_id", "pattern"), ["repo_id", "pattern"]).select(
        "repo_id", "pattern", "rank", "evidence")


def arch_top5(scores: DataFrame) -> DataFrame:
    """The five best patterns, each as a share of the best one (nine rows per window)."""
    maxima = scores.withColumn("top", F.max("tenths").over(Window.partitionBy("repo_id")))
    ranked = top_n(maxima, ["repo_id"], [F.col("tenths").desc(), F.col("pattern_no")], 5)
    share = F.when(F.col("top") > 0, F.col("tenths") * 100 / F.col("top")).otherwise(0.0)
    return ranked.select("repo_id", "rank", "pattern", "score", share.alias("pct_of_max"))
