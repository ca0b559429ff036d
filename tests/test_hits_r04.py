"""Findings of round 4 on disk: hits are found where files and keywords meet, no runs of words are shuffled."""

from corpuslens.operators import retrieval
from corpuslens.plans.analysis import stored


def test_runs_are_never_rows(spark, monkeypatch):
    """Hits are distinct without an aggregation; a path of several rows, or without a name, is one file of its repository."""
    for name, size in (("CELL_RUNS", 2), ("CELL_KEYWORDS", 2), ("KNOWN_RUNS", 1)):
        monkeypatch.setattr(retrieval, name, size)
    texts = [("r", "a", "Login_page login"), ("r", "a", "logout größe"), ("r", None, "login"), ("r", "b", None), ("r", "c", "--"), ("s", "a", "login"), (None, "a", "login")]
    kws = [("r", k) for k in ("login", "log", "größe", "in_p", "xyz", "g")] + [("r", "log"), (None, "log"), ("r", None), ("t", "log")]
    keywords = spark.createDataFrame(kws, "repo_id string, kw string")
    found = retrieval.keyword_hits(keywords, spark.createDataFrame(texts, "repo_id string, path string, text string"))
    want = [("r", "a", k) for k in ("login", "log", "größe", "in_p", "g")] + [("r", None, k) for k in ("login", "log", "g")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and not any(x in plan.split("FlatMapCoGroups")[0] for x in ("Exchange", "Aggregate"))
    assert "explode(array_distinct" not in plan


def test_staged_scores_equal_those_made_at_once(spark, tmp_path):
    keywords = spark.createDataFrame([(1, "r", "ab"), (1, "r", "ab"), (1, "s", "cd"), (2, "r", "cd"), (None, "r", "cd")], "q_id long, repo_id string, kw string")
    previews = spark.createDataFrame([("r", "a.py", "xaby cd"), ("s", "b.py", "ab")], "repo_id string, path string, preview string")
    modules = spark.createDataFrame([("r", p, "cd", ["ab"], []) for p in ("a.py", "b.py")], "repo_id string, path string, name string, classes array<string>, functions array<string>")
    as_text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    stage = stored(str(tmp_path))
    assert as_text(retrieval.score_content(keywords, previews, stage)) == as_text(retrieval.score_content(keywords, previews))
    hits = retrieval.content_hits(keywords, previews)
    assert as_text(retrieval.score_modules(keywords, modules, hits, stage)) == as_text(retrieval.score_modules(keywords, modules, hits))
