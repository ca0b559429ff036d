"""Scores of every pair: counted inside tasks, with the results of a plain join."""

import re

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import retrieval
from tests.conftest import rows_of
from tests.test_retrieval import brute, fixture


@pytest.fixture
def small_cells(monkeypatch):
    for name, size in (("CELL_QUESTIONS", 4), ("CELL_FILES", 16), ("COUNTED", 3), ("CELL_RUNS", 5), ("CELL_KEYWORDS", 4)):
        monkeypatch.setattr(retrieval, name, size)


def test_cells_equal_brute_force(spark, small_cells):
    previews, modules, questions, pdf, mdf, qdf = fixture(spark)
    content, names, _ = brute(previews, modules, questions)
    keywords = retrieval.question_keywords(qdf)
    assert sorted(rows_of(retrieval.score_content(keywords, pdf), "q_id", "path", "score")) == sorted(content)
    found = retrieval.score_modules(keywords, mdf, retrieval.content_hits(keywords, pdf))
    assert sorted(rows_of(found, "q_id", "path", "score")) == sorted(names)


def test_repeated_and_missing_keys(spark, small_cells):
    """A repeated keyword counts again; a number that two repositories share is compared across them."""
    keywords = spark.createDataFrame(
        [(1, "r", "ab"), (1, "r", "ab"), (1, "r", "cd"), (2, "r", "cd"), (2, "s", "ab"), (None, "r", "cd"), (3, None, "ab")],
        "q_id long, repo_id string, kw string")
    previews = spark.createDataFrame([("r", "a.py", "xaby cd"), ("s", "b.py", "ab"), ("s", "c.py", None)], "repo_id string, path string, preview string")
    modules = spark.createDataFrame([("r", p, "cd", ["ab"], []) for p in ("a.py", "b.py", "d.py")],
                                    "repo_id string, path string, name string, classes array<string>, functions array<string>")
    scored = retrieval.score_content(keywords, previews)
    want = [(1, "r", "a.py", 3), (2, "r", "a.py", 1), (2, "s", "b.py", 1), (None, "r", "a.py", 1)]
    as_text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert as_text(scored.collect()) == as_text(want)
    by_pairs = retrieval.score_modules(keywords, modules, scored)
    by_hits = retrieval.score_modules(keywords, modules, retrieval.content_hits(keywords, previews))
    want = [(1, "r", "b.py", 6), (1, "r", "d.py", 6), (2, "r", "d.py", 2), *[(None, "r", p, 2) for p in ("a.py", "b.py", "d.py")]]
    assert as_text(by_pairs.collect()) == as_text(want) == as_text(by_hits.collect())


def test_pairs_are_not_shuffled(spark):
    """After the tasks that make pairs, no row goes through another shuffle."""
    *_, pdf, _mdf, qdf = fixture(spark)
    plan = retrieval.score_content(retrieval.question_keywords(qdf), pdf)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("FlatMapCoGroups")[0]
    assert "FlatMapCoGroups" in plan and not re.search(r"Exchange|Aggregate", above)


def test_empty_tables(spark):
    *_, pdf, mdf, qdf = fixture(spark)
    keywords = retrieval.question_keywords(qdf)
    assert retrieval.score_content(keywords.where(F.lit(False)), pdf).count() == 0
    assert retrieval.score_modules(keywords, mdf.where("false"), retrieval.content_hits(keywords, pdf)).count() == 0


def test_plain_texts_are_folded_without_taking_them_apart(spark):
    """As many bytes as letters: nothing to translate; other texts are folded as before."""
    from corpuslens.operators.architecture import _folded

    rows = spark.createDataFrame([("MoDel View",), ("ſERVICE Kafka",), ("İnbound größe",), ("",), (None,)], "t string")
    df = rows.select(_folded(F.col("t")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["model view", "service kafka", "inbound größe", "", None]
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()
