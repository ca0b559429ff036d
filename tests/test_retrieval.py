"""Retrieval against brute force in plain Python over a small, skewed fixture."""

import random
import re

from corpuslens import rules
from corpuslens.operators import retrieval
from corpuslens.plans.analysis import stored
from tests.conftest import rows_of

RUN = re.compile(r"\w+")


def fixture(spark):
    rng = random.Random(7)
    bag = ["token", "user", "auth", "größe", "a_b", "login", "x1", "parser", "db", "user_id", "authz"]
    previews, modules = [], []
    for i in range(120):
        repo = "hot" if i % 3 else "cold"
        text = " ".join(rng.choices(bag, k=rng.randint(0, 6))) if i % 5 else "Same COPY token"
        previews.append((repo, f"p{i:03d}/mod_{i % 7}.py", f"mod_{i % 7}.py", text))
        modules.append((repo, f"p{i:03d}/mod_{i % 7}.py", f"mod_{i % 7}.py", rng.choices(bag, k=1), rng.choices(bag, k=2)))
    questions = [(i, "hot" if i % 2 else "cold", " ".join(rng.choices(bag + ["use", "the", "thor", "mod_3", "explain"], k=3))) for i in range(30)]
    return (previews, modules, questions,
            spark.createDataFrame(previews, "repo_id string, path string, name string, preview string"),
            spark.createDataFrame(modules, "repo_id string, path string, name string, classes array<string>, functions array<string>"),
            spark.createDataFrame(questions, "q_id long, repo_id string, text string"))


def brute(previews, modules, questions):
    content, names, best = set(), set(), set()
    for q, repo, text in questions:
        kws = set(RUN.findall(text.lower())) - set(rules.STOP_WORDS)
        ranked = []
        for r, path, _n, body in previews:
            score = sum(k in body.lower() for k in kws)
            if r == repo and score:
                content.add((q, path, score))
                ranked.append((-score, 0, path))
        seen = {p for _s, _b, p in ranked}
        for r, path, name, classes, functions in modules:
            text = f"{name} {' '.join(classes)} {' '.join(functions)}".lower()
            score = sum(2 for k in kws if k in text)
            if r == repo and score and path not in seen:
                names.add((q, path, score))
                ranked.append((-score, 1, path))
        best |= {(q, n, p, -s) for n, (s, _b, p) in enumerate(sorted(ranked)[:4], 1)}
    return content, names, best


def test_ranking_equals_brute_force(spark, tmp_path):
    previews, modules, questions, pdf, mdf, qdf = fixture(spark)
    content, names, best = brute(previews, modules, questions)
    keywords = retrieval.question_keywords(qdf)
    by_content = retrieval.score_content(keywords, pdf)
    assert set(rows_of(by_content, "q_id", "path", "score")) == content
    assert set(rows_of(retrieval.score_modules(keywords, mdf, by_content), "q_id", "path", "score")) == names
    assert set(rows_of(retrieval.relevant_files(keywords, pdf, mdf, stage=stored(str(tmp_path))), "q_id", "rank", "path", "score")) == best


def test_context_text(spark):
    picks = spark.createDataFrame([(1, "r", 2, "b", "B"), (1, "r", 1, "a", "A")], "q_id long, repo_id string, rank int, path string, snippet string")
    assert rows_of(retrieval.relevant_context(picks), "context") == [("--- a ---\nA\n\n--- b ---\nB",)]


def test_attribution_equals_brute_force(spark):
    names = ["a.py", "aa.py", "x.test.ts", "test.ts", "größe.md", "with space.js", "y.json", "UP.PY", "a.py.py", "index.js"]
    rows = [(f"r{n % 2}", f"d{n}/{names[n % len(names)]}", names[n % len(names)]) for n in range(60)]
    texts = ["see d4/größe.md and aa.py", "x.test.ts!", "nothing. at all", "d1/aa.py/a.py.py", "with space.js, y.json.", "UP.PY up.py", "index.js " * 3, "a.p y test.ts.js"]
    answers = [(i, f"r{i % 2}", t) for i, t in enumerate(texts + texts[1:])]
    files = spark.createDataFrame([(r, p, n, "") for r, p, n in rows], "repo_id string, path string, name string, preview string")
    want = set()
    for i, repo, text in answers:
        hits = sorted(p for r, p, n in rows if r == repo and (p in text or n in text))
        want |= {(i, k, p) for k, p in enumerate(hits[:10], 1)}
    adf = spark.createDataFrame(answers, "answer_id long, repo_id string, text string")
    assert set(rows_of(retrieval.source_attribution(adf, files), "answer_id", "rank", "path")) == want


def test_history_window(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(13)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(retrieval.history_window(df).where("conv_id = 1"), "turn") == [(t,) for t in range(3, 13)]


def test_threshold_algorithm_equals_brute_force(spark, tmp_path):
    previews, modules, questions, pdf, mdf, qdf = fixture(spark)
    _c, _n, best = brute(previews, modules, questions)
    keywords = retrieval.question_keywords(qdf)
    for i, (rare, chunk) in enumerate([(0, 1), (1, 2), (2, 8), (500, 64)]):
        got = retrieval.relevant_files(keywords, pdf, mdf, stage=stored(f"{tmp_path}/{i}"), rare=rare, first_chunk=chunk)
        assert set(rows_of(got, "q_id", "rank", "path", "score")) == best


def test_factors_expand_to_all_scores(spark, tmp_path):
    previews, modules, questions, pdf, mdf, qdf = fixture(spark)
    content, names, _b = brute(previews, modules, questions)
    matches = retrieval.MatchClasses(retrieval.question_keywords(qdf), pdf, mdf, stage=stored(str(tmp_path)))
    got = matches.expand(qdf.where("q_id % 3 = 0"))
    assert set(rows_of(got.where("branch = 0"), "q_id", "path", "score")) == {x for x in content if x[0] % 3 == 0}
    assert set(rows_of(got.where("branch = 1"), "q_id", "path", "score")) == {x for x in names if x[0] % 3 == 0}
    assert matches.members.count() == matches.members.select("repo_id", "path").distinct().count()


def test_a_word_of_every_file_makes_no_pairs(spark, tmp_path):
    """2,000 files that all hold one word, each with words of its own, and 300 questions for that word."""
    files = spark.range(2000).selectExpr(
        "'r' AS repo_id", "concat('d', lpad(cast(id AS string), 4, '0'), '.py') AS path", "'x.py' AS name",
        "concat('common w', cast(id % 97 AS string), ' v', cast(id % 89 AS string)) AS preview")
    names = files.selectExpr("repo_id", "path", "name", "array() AS classes", "array() AS functions")
    asked = spark.range(300).selectExpr("id AS q_id", "'r' AS repo_id", "concat('common w', cast(id % 97 AS string)) AS text")
    rows = {}

    def stage(name, df):
        out = stored(str(tmp_path))(name, df)
        rows[name] = out.count()
        return out

    got = retrieval.relevant_files(retrieval.question_keywords(asked), files, names, stage=stage, first_chunk=16)
    assert got.count() == 1200
    assert rows["classes"] >= 97 and max(n for name, n in rows.items() if name.startswith("best")) <= 1200
