"""R family: rank the files of a repository for questions, and attribute answers to files.

The rules ask whether a word is a *substring* of a text.  Nothing here compares every question with
every file: an occurrence of a word lies inside one run of word characters, so words are matched
against the distinct runs of a repository by equality of equally long parts, and only matches are
joined back to files.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import extension
from corpuslens.functions.ranking import salted_join, top_n
from corpuslens.functions.text import text_array, words

# executors need no installed copy of the package for the scores of a cell
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def question_keywords(questions: DataFrame) -> DataFrame:
    """Distinct lower-case words of a question without the stop words."""
    wanted = F.array_except(words(F.lower("text")), text_array(rules.STOP_WORDS))
    return questions.select("q_id", "repo_id", F.explode(wanted).alias("kw"))


Stage = Callable[[str, DataFrame], DataFrame]


def as_is(name: str, df: DataFrame) -> DataFrame:
    return df


#: files, by the runs of their texts, and keywords of a repository that meet at a time, in one task
CELL_RUNS, CELL_KEYWORDS = 1_024, 100_000
#: distinct runs whose keywords a task remembers
KNOWN_RUNS = 100_000


def keyword_hits(keywords: DataFrame, texts: DataFrame, stage: Stage = as_is, name: str = "runs") -> DataFrame:
    """Distinct (repo_id, path, kw) where the keyword is a substring of the file's lower-case text.

    Blocks of files and of keywords meet in a task, which looks up all parts of a file's runs that are as long as some
    keyword: neither runs nor their parts, the square of a run's length, are ever rows.  ``stage`` may write the distinct
    runs of each text once, as they are needed twice, and the number of blocks, so that its size is known.
    """
    vocabulary = keywords.select("repo_id", "kw").where("repo_id IS NOT NULL AND kw IS NOT NULL").distinct()
    # runs hold no blanks: as one text they take a fraction of an array's room
    runs = stage(name, texts.where("repo_id IS NOT NULL").select(
        "repo_id", "path", F.array_join(F.array_distinct(words(F.lower("text"))), " ").alias("runs")))
    blocks = lambda rows, size, name: rows.groupBy("repo_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = stage(f"{name}_blocks", blocks(runs, CELL_RUNS, "rs").join(blocks(vocabulary, CELL_KEYWORDS, "ks"), "repo_id"))
    cell, width = ["repo_id", "r_block", "k_block"], int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = salted_join(runs.where("runs <> ''"), sizes, ["repo_id"], "path").select(
        "repo_id", block("path", "rs").alias("r_block"), every("ks").alias("k_block"), "path", "runs").repartition(width, *cell)
    right = salted_join(vocabulary, sizes, ["repo_id"], "kw").select(
        "repo_id", every("rs").alias("r_block"), block("kw", "ks").alias("k_block"), "kw").repartition(width, *cell)
    most = KNOWN_RUNS

    def found(key: tuple, files: pa.Table, keywords: pa.Table) -> pa.Table:
        known = set(keywords["kw"].to_pylist()) if files.num_rows else set()
        lengths = sorted({len(k) for k in known})
        inside: dict[str, set[str]] = {}
        # a path that stands in several rows stands in one cell, and is one file
        held: dict[str | None, set[str]] = {}
        for path, text in zip(*(files[c].to_pylist() if known else [] for c in ("path", "runs"))):
            parts = held.setdefault(path, set())
            for run in text.split(" "):
                if (got := inside.get(run)) is None:
                    if len(inside) >= most:
                        inside.clear()
                    got = inside[run] = {run[at : at + n] for n in lengths if n <= len(run) for at in range(len(run) - n + 1)} & known
                parts |= got
        paths = [path for path, parts in held.items() for _ in parts]
        repo = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(paths), np.int64)))
        return pa.table([repo, pa.array(paths, pa.string()), pa.array([kw for parts in held.values() for kw in parts], pa.string())],
                        names=["repo_id", "path", "kw"])

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(found, "repo_id string, path string, kw string")


def content_hits(keywords: DataFrame, previews: DataFrame, stage: Stage = as_is) -> DataFrame:
    return keyword_hits(keywords, previews.select("repo_id", "path", F.col("preview").alias("text")), stage, "preview_runs")


def module_hits(keywords: DataFrame, modules: DataFrame, stage: Stage = as_is) -> DataFrame:
    text = F.concat_ws(" ", "name", F.concat_ws(" ", "classes"), F.concat_ws(" ", "functions"))
    return keyword_hits(keywords, modules.select("repo_id", "path", text.alias("text")), stage, "module_runs")


#: questions and files of a cell: what is scored at a time, in one task
CELL_QUESTIONS, CELL_FILES = 2_048, 256
#: questions of a cell that are counted at a time
COUNTED = 256


def _held(hits: DataFrame, name: str) -> DataFrame:
    return hits.where("repo_id IS NOT NULL AND kw IS NOT NULL").groupBy("repo_id", "path").agg(F.collect_list("kw").alias(name))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The items of all lists, and for each the row it stands in."""
    lists = lists.combine_chunks()
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def _counted(at: np.ndarray, kws: pa.Array, held: pa.ChunkedArray, start: int, rows: int) -> np.ndarray:
    """How often a keyword of each of ``rows`` questions from ``start`` on is held by each file, as a matrix."""
    file, words_ = _flat(held)
    coded = words_.dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False)
    file, sizes = file[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(coded.dictionary))
    first = np.cumsum(sizes) - sizes
    low, high = np.searchsorted(at, [start, start + rows])
    code = pc.index_in(kws.slice(low, high - low), value_set=coded.dictionary)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    code, row = code.drop_null().to_numpy(zero_copy_only=False), at[low:high][known] - start
    many = sizes[code]
    place = np.arange(many.sum()) + np.repeat(first[code] - (np.cumsum(many) - many), many)
    return np.bincount(np.repeat(row, many) * len(held) + file[place], minlength=rows * len(held)).reshape(rows, len(held))


def _scores(
    keywords: DataFrame, hits: DataFrame, per_hit: int, seen: DataFrame | None = None, stage: Stage = as_is,
) -> DataFrame:
    """(q_id, repo_id, path, score) of every pair with a common keyword; with ``seen``, hits too, only pairs without one there.

    Questions and files meet in cells, blocks of both, and pairs are counted inside a task.  Only questions and files
    are shuffled, a copy of each for every block of the other: pairs, the square of them, never are.  ``stage`` may write
    the lists of files and questions and the number of blocks once, which frees what was shuffled for them.
    """
    held = files = _held(hits, "held")
    if seen is not None:
        # an unknown path is no known one, as in a join
        files = files.join(_held(seen, "seen").where("path IS NOT NULL"), ["repo_id", "path"], "left")
    else:
        files = files.withColumn("seen", F.lit(None).cast("array<string>"))
    files = files.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    if stage is not as_is:
        held = files = stage("held", files)
    asked = stage("wanted", keywords.where("repo_id IS NOT NULL AND kw IS NOT NULL").groupBy("q_id", "repo_id").agg(
        F.collect_list("kw").alias("wanted")))
    # counted by their lists, which none lacks: without that column the hits would be another plan, and found once more
    blocks = lambda rows, listed, size, name: rows.groupBy("repo_id").agg(
        F.ceil(F.count_if(F.size(listed) > 0) / size).cast("int").alias(name))
    sizes = stage("score_blocks", blocks(asked, "wanted", CELL_QUESTIONS, "qs").join(blocks(held, "held", CELL_FILES, "fs"), "repo_id"))
    cell, width = ["repo_id", "q_block", "f_block"], int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = salted_join(asked, sizes, ["repo_id"], "q_id").select(
        "repo_id", block("q_id", "qs").alias("q_block"), every("fs").alias("f_block"), "q_id", "wanted").repartition(width, *cell)
    files = salted_join(files, sizes, ["repo_id"], "path").select(
        "repo_id", every("qs").alias("q_block"), block("path", "fs").alias("f_block"), "path", "held", "seen").repartition(width, *cell)
    without, chunk = seen is not None, COUNTED

    def scored(key: tuple, questions: pa.Table, files: pa.Table) -> pa.Table:
        at, kws = _flat(questions["wanted"])
        found = [(np.empty(0, np.int64),) * 3]
        for start in range(0, questions.num_rows if files.num_rows else 0, chunk):
            rows = min(chunk, questions.num_rows - start)
            counts = _counted(at, kws, files["held"], start, rows)
            if without:
                counts[_counted(at, kws, files["seen"], start, rows) > 0] = 0
            q, f = np.nonzero(counts)
            found.append((q + start, f, counts[q, f]))
        q, f, n = (np.concatenate(x) for x in zip(*found))
        repo = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(q), np.int64)))
        return pa.table([questions["q_id"].take(q), repo, files["path"].take(f), pa.array(n * per_hit, pa.int64())],
                        names=["q_id", "repo_id", "path", "score"])

    return asked.groupBy(*cell).cogroup(files.groupBy(*cell)).applyInArrow(
        scored, f"q_id {keywords.schema['q_id'].dataType.simpleString()}, repo_id string, path string, score bigint")


def score_content(keywords: DataFrame, previews: DataFrame, stage: Stage = as_is) -> DataFrame:
    """R2 expanded: number of a question's keywords found in a preview; every scored pair is a row."""
    return _scores(keywords, content_hits(keywords, previews, stage), 1, stage=stage)


def score_modules(keywords: DataFrame, modules: DataFrame, by_content: DataFrame, stage: Stage = as_is) -> DataFrame:
    """R3 expanded: two per keyword found in the names of a module that R2 did not score for the question.

    ``by_content`` are the pairs that R2 scored (q_id, path), or, so that no table of pairs is shuffled, the hits they
    follow from (``content_hits``: repo_id, path, kw).
    """
    hits = module_hits(keywords, modules, stage)
    if "kw" not in by_content.columns:
        return _unscored(_scores(keywords, hits, 2), by_content)
    # a number that questions of several repositories share, or none, is compared across them: few, as pairs
    shared = keywords.groupBy("q_id").agg((F.min("repo_id") < F.max("repo_id")).alias("several")).where("several").select("q_id")
    lone = keywords.where("q_id IS NOT NULL").join(shared, "q_id", "left_anti")
    rest = keywords.join(shared, "q_id", "left_semi").unionByName(keywords.where("q_id IS NULL")).select(*lone.columns)
    named = lambda part: lambda name, df: stage(f"{part}_{name}", df)
    lone, rest = stage("lone", lone), stage("rest", rest)
    of_lone, of_rest, of_seen = (as_is if stage is as_is else named(part) for part in ("lone", "rest", "seen"))
    return _scores(lone, hits, 2, by_content, of_lone).unionByName(
        _unscored(_scores(rest, hits, 2, stage=of_rest), _scores(rest, by_content, 1, stage=of_seen)))


def _unscored(scored: DataFrame, by_content: DataFrame) -> DataFrame:
    return scored.join(by_content.select("q_id", "path"), ["q_id", "path"], "left_anti").select(
        "q_id", "repo_id", "path", "score")


class MatchClasses:
    """R2 and R3 in factors: files that match the same keywords score the same for every question.

    ``members`` (repo_id, class, path) has a row for each file that matches anything, ``classes`` (repo_id, class,
    paths, in_content, in_names) one for each class, with its first ``k`` paths, and ``keywords`` those of the
    questions.  Together they are linear in files and questions; ``expand`` gives the exact scores of the
    questions asked for.  A class is named by its first path.  With a ``stage``, keywords, runs, files and
    classes are written once, as each of them is needed more than once.
    """

    def __init__(
        self, keywords: DataFrame, previews: DataFrame, modules: DataFrame, k: int = rules.RELEVANT_FILES, stage: Stage = as_is,
    ) -> None:
        self.keywords = keywords = stage("keywords", keywords)
        empty = F.array().cast("array<string>")
        tagged = content_hits(keywords, previews, stage).withColumn("in_content", F.lit(True)).unionByName(
            module_hits(keywords, modules, stage).withColumn("in_content", F.lit(False)))
        words_where = lambda found: F.coalesce(F.array_sort(F.collect_set(F.when(found, F.col("kw")))), empty)
        matched = tagged.groupBy("repo_id", "path").agg(
            words_where(F.col("in_content")).alias("in_content"), words_where(~F.col("in_content")).alias("in_names"))
        # keywords hold word characters only, so no two pairs of lists give the same text
        lists = F.concat_ws("\n", F.array_join("in_content", " "), F.array_join("in_names", " "))
        self.matched = stage("matched", matched.withColumn("alike", F.sha2(lists, 256)))
        first = top_n(self.matched, self.alike, [F.col("path")], k).groupBy(*self.alike).agg(
            F.array_sort(F.collect_list("path")).alias("paths"),
            F.first("in_content").alias("in_content"), F.first("in_names").alias("in_names"))
        self.classes = stage("classes", first.select(
            "repo_id", F.get("paths", F.lit(0)).alias("class"), "paths", "in_content", "in_names", "alike"))

    #: the digest of both lists stands for them: lists as long as a file's keywords would cross every shuffle
    alike = ["repo_id", "alike"]

    @property
    def members(self) -> DataFrame:
        """Narrow rows on both sides, each once: with one class a file, a copy for every salt is the larger side many times."""
        named = self.classes.select(*self.alike, "class")
        return self.matched.select(*self.alike, "path").join(named, self.alike).select("repo_id", "class", "path")

    @property
    def postings(self) -> DataFrame:
        """(repo_id, class, kw, c, m): whether a keyword stands in the content and in the names of a class."""
        cells = F.concat(
            F.transform("in_content", lambda w: F.struct(w.alias("kw"), F.lit(1).alias("c"), F.lit(0).alias("m"))),
            F.transform("in_names", lambda w: F.struct(w.alias("kw"), F.lit(0).alias("c"), F.lit(1).alias("m"))))
        return self.classes.select("repo_id", "class", F.explode(cells).alias("x")).select("repo_id", "class", "x.*").groupBy(
            "repo_id", "class", "kw").agg(F.max("c").alias("c"), F.max("m").alias("m"))

    def expand(self, questions: DataFrame) -> DataFrame:
        """(q_id, repo_id, path, score, branch) of every scored pair of the questions (q_id); branch 0 is R2, 1 is R3."""
        asked = self.keywords.join(questions.select("q_id").distinct(), "q_id", "left_semi")
        scored = asked.join(self.postings, ["repo_id", "kw"]).groupBy("q_id", "repo_id", "class").agg(
            F.sum("c").alias("c"), F.sum("m").alias("m"))
        scored = scored.select("q_id", "repo_id", "class", *_score(F.col("c"), F.col("m")))
        return scored.join(self.members, ["repo_id", "class"]).select("q_id", "repo_id", "path", "score", "branch")


def _score(c: Column, m: Column) -> list[Column]:
    """Matches in the content count, with those in the names, doubled, in their place if there are none."""
    return [F.when(c > 0, c).otherwise(m * 2).alias("score"), (c == 0).cast("int").alias("branch")]


#: open questions of a repository that meet a copy of its classes
QUESTIONS_A_BLOCK = 1_000


def best_classes(
    matches: MatchClasses, k: int = rules.RELEVANT_FILES, rare: int = 32, first_chunk: int = 256, stage: Stage = as_is,
) -> DataFrame:
    """(q_id, repo_id, class, score, branch): the first ``k`` classes of every question, by a threshold algorithm.

    Classes that hold one of a question's rare keywords (in at most ``rare`` classes) are scored first: at most
    ``rare`` rows a keyword.  All others match frequent keywords only, which bounds their score.  A question whose
    ``k``-th score reaches that bound is done; the others meet the classes in the order of their paths, chunk by
    chunk, each four times the last one.  In path order a later class loses every tie, so a question stops as
    soon as its ``k``-th score reaches the bound.  A word that stands in every file is a bound of one, which the first
    chunk meets; no table of questions by classes is made.
    """
    lists = stage("lists", _lists(stage("postings", matches.postings), rare))
    known = salted_join(matches.keywords, lists, ["repo_id", "kw"], "q_id")
    frequent = F.col("n") > rare
    asked = stage("asked", known.groupBy("q_id", "repo_id").agg(
        F.collect_list("kw").alias("wanted"), F.count_if(frequent & (F.col("in_content") > 0)).alias("fc"),
        F.count_if(frequent & (F.col("in_names") > 0)).alias("fm"),
        F.array_distinct(F.flatten(F.collect_list("holders"))).alias("holders")).select(
        "q_id", "repo_id", "wanted", F.greatest("fc", F.col("fm") * 2).alias("bound"), "holders"))
    classes = matches.classes.select("repo_id", "class", "in_content", "in_names")

    def scored(pairs: DataFrame) -> DataFrame:
        size = lambda held: F.size(F.array_intersect("wanted", held))
        return pairs.select("q_id", "repo_id", "class", *_score(size("in_content"), size("in_names"))).where("score > 0")

    def first_k(rows: DataFrame) -> DataFrame:
        return top_n(rows, ["q_id"], [F.col("score").desc(), F.col("branch"), F.col("class")], k).drop("rank")

    found = stage("best_0", first_k(scored(asked.select("q_id", "repo_id", "wanted", F.explode("holders").alias("class")).join(
        classes, ["repo_id", "class"]))))
    sizes = stage("sizes", classes.groupBy("repo_id").agg(F.count("*").alias("classes")))
    done, chunk, at = 0, first_chunk, 1
    while True:
        last = found.groupBy("q_id").agg(F.count("*").alias("held"), F.max_by(F.struct("score", "branch"), F.struct(
            -F.col("score"), "branch")).alias("last"))
        reached = (F.col("held") == k) & ((F.col("last.score") > F.col("bound")) | (
            (F.col("last.score") == F.col("bound")) & (F.col("last.branch") == 0)))
        # a question with no frequent keyword has met all its classes; one whose repository has no more classes, too
        still = salted_join(asked.drop("holders"), sizes, ["repo_id"], "q_id").join(last, "q_id", "left").where(
            (F.col("bound") > 0) & (F.col("classes") > done) & ~F.coalesce(reached, F.lit(False)))
        still = stage(f"open_{at}", still.select("q_id", "repo_id", "wanted"))
        if still.isEmpty():
            return found
        # each task sends at most the first `done + chunk` classes of a repository
        # as many copies of a class as its repository has blocks of open questions, not one for every shuffle partition
        most = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = still.groupBy("repo_id").agg(F.least(F.ceil(F.count("*") / QUESTIONS_A_BLOCK), F.lit(most)).cast("int").alias("salts"))
        part = top_n(classes.join(blocks, "repo_id"), ["repo_id"], [F.col("class")],
                     done + chunk, rank="place").where(F.col("place") > done).drop("place")
        spread = still.join(blocks, "repo_id").withColumn("_salt", F.pmod(F.xxhash64("q_id"), F.col("salts")).cast("int")).drop("salts")
        copies = part.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        more = first_k(scored(spread.join(copies, ["repo_id", "_salt"])))
        found = stage(f"best_{at}", first_k(found.unionByName(more).distinct()))
        done, chunk, at = done + chunk, 4 * chunk, at + 1


def _lists(postings: DataFrame, rare: int) -> DataFrame:
    """(repo_id, kw, in_content, in_names, n, holders): in how many classes a keyword stands; which, if it is rare."""
    counts = postings.groupBy("repo_id", "kw").agg(
        F.sum("c").alias("in_content"), F.sum("m").alias("in_names"), F.count("*").alias("n"))
    few = top_n(postings, ["repo_id", "kw"], [F.col("class")], rare).groupBy("repo_id", "kw").agg(F.collect_list("class").alias("holders"))
    none = F.array().cast("array<string>")
    return counts.join(few, ["repo_id", "kw"], "left").withColumn("holders", F.when(F.col("n") <= rare, F.col("holders")).otherwise(none))


def relevant_files(
    keywords: DataFrame, previews: DataFrame, modules: DataFrame, k: int = rules.RELEVANT_FILES, stage: Stage = as_is,
    rare: int = 32, first_chunk: int = 256,
) -> DataFrame:
    """The best ``k`` files of a question, ties to content matches and then to the path.

    Of a class only the first ``k`` paths can ever be chosen; a million copies of a file are one class.
    """
    matches = MatchClasses(keywords, previews, modules, k, stage)
    chosen = best_classes(matches, k, rare, first_chunk, stage)
    paths = chosen.join(matches.classes.select("repo_id", "class", "paths"), ["repo_id", "class"]).select(
        "q_id", "repo_id", "score", "branch", F.explode("paths").alias("path"))
    picks = top_n(paths, ["q_id"], [F.col("score").desc(), F.col("branch"), F.col("path")], k)
    snippets = previews.select(
        "repo_id", "path", F.substring("preview", 1, rules.SNIPPET_CHARS).alias("snippet"))
    return picks.join(snippets, ["repo_id", "path"], "left").select(
        "q_id", "repo_id", "rank", "path", "score",
        F.coalesce("snippet", F.concat(F.lit("// "), "path")).alias("snippet"))


def relevant_context(picks: DataFrame) -> DataFrame:
    """The picked snippets of a question as one text (at most ``k`` blocks)."""
    block = F.concat(F.lit("--- "), "path", F.lit(" ---\n"), "snippet")
    return picks.groupBy("q_id", "repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b")).select(
        "q_id", "repo_id", F.array_join("b.block", "\n\n").alias("context"))


def history_window(history: DataFrame, n: int = rules.HISTORY_TURNS) -> DataFrame:
    """The last turns of a conversation."""
    return top_n(history, ["conv_id"], [F.col("turn").desc()], n).drop("rank")


def source_attribution(answers: DataFrame, previews: DataFrame, n: int = rules.SOURCE_ITEMS) -> DataFrame:
    """Previewed files whose path or base name occurs in an answer, first ``n`` by path.

    A path ends with its base name, so "path or name occurs" is "name occurs"; module paths are
    previewed paths and add none.  A name has no ``/`` and ends with one of the preview extensions,
    which leaves few places in an answer where it can end.  Before each place, the text as long as
    some name of the repository is looked up by equality.
    """
    files = previews.select("repo_id", "path", "name", extension(F.col("name")).alias("ext"))
    first_paths = top_n(files, ["repo_id", "name"], [F.col("path")], n, rank="nth").select("repo_id", "name", "path")
    lengths = (
        files.groupBy("repo_id", "ext").agg(F.collect_set(F.length("name")).alias("lengths"))
        .groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("ext", "lengths"))).alias("lengths"))
    )
    # one row per stretch of an answer without "/" that holds a dot
    stretches = answers.select("answer_id", "repo_id", F.explode(F.split("text", "/")).alias("stretch")).where(
        F.contains("stretch", F.lit(".")))
    stretches = salted_join(stretches, lengths, ["repo_id"], "answer_id")
    pieces = F.split("stretch", r"\.")
    none = F.array().cast("array<string>")

    def names_ending(ext: str, before, after):
        tail = F.left(after, F.lit(len(ext) - 1))
        known = F.try_element_at(F.col("lengths"), F.lit(ext))
        whole = F.concat(F.right(before, F.array_max(known)), F.lit("."), tail)
        fitting = F.filter(known, lambda size: size <= F.length(whole))
        found = F.transform(fitting, lambda size: F.right(whole, size))
        return F.when((F.lower(tail) == ext[1:]) & known.isNotNull(), found).otherwise(none)

    def names_at(i):
        before = F.array_join(F.slice(F.col("pieces"), 1, i), ".")
        after = F.get(F.col("pieces"), i)
        return F.flatten(F.array(*[names_ending(e, before, after) for e in rules.PREVIEW_EXTENSIONS]))

    ends = F.sequence(F.lit(1), F.size("pieces") - 1)
    names = F.array_distinct(F.flatten(F.transform(ends, names_at)))
    candidates = (
        stretches.withColumn("pieces", pieces)
        .select("answer_id", "repo_id", F.explode(names).alias("name")).distinct()
    )
    found = candidates.join(first_paths, ["repo_id", "name"]).select("answer_id", "repo_id", "path")
    return top_n(found, ["answer_id"], [F.col("path")], n)
