import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.operators import health, history
from tests.conftest import rows_of

DAY = dt.datetime(2024, 1, 1)


def test_contributors_and_commits(make_commits):
    rows = [("r", f"{i:040d}", "ann" if i % 2 else "bob", f"{i}@x", DAY + dt.timedelta(days=i // 2), f"m{i}\nbody\n") for i in range(50)]
    rows.append(("r", "f" * 40, None, None, DAY - dt.timedelta(days=9), None))
    df = make_commits(rows)
    assert rows_of(history.contributors(df).where("name is not null"), "name", "email", "commits") == [("ann", "49@x", 25), ("bob", "48@x", 25)]
    recent = history.recent_commits(df).orderBy("rank").collect()
    assert len(recent) == 20 and [r["message"] for r in recent[:3]] == ["m48", "m49", "m46"]
    assert len(recent[0]["sha"]) == 8
    assert rows_of(history.recent_commits(df, 100).where("author = 'Unknown'"), "message", "email") == [("", "")]
    info = history.repo_git_info(df).collect()[0]
    assert info["commits"] == 51 and info["last_commit"]["message"] == "m49\nbody"


BASE = {"deps_n": 0, "outdated_n": 0, "has_security_path": False, "doc_paths": 0, "has_test_path": False,
        "has_performance_path": False, "has_testing_framework": False, "has_store_framework": False, "confidence": 0.0,
        "layers_n": 0, "modules_n": 0, "contributors_n": 0, "readme_chars": 0, "readme_names_security": False,
        "total_files": 0, "total_lines": 0, "total_functions": 0, "avg_function_length": 0.0, "avg_complexity": 0.0,
        "max_complexity": 0.0}


@pytest.mark.parametrize("metric, changes, score", [
    ("security", {}, 80), ("security", {"deps_n": 10}, 70), ("security", {"readme_names_security": True, "has_security_path": True}, 100),
    ("maintainability", {"avg_function_length": 9.99}, 85), ("maintainability", {"avg_function_length": 10.0, "total_files": 10}, 90),
    ("maintainability", {"avg_function_length": 20.0, "total_files": 101}, 75), ("maintainability", {"avg_function_length": 50.0}, 60),
    ("documentation", {}, 50), ("documentation", {"readme_chars": 500, "doc_paths": 2}, 90), ("documentation", {"readme_chars": 501, "doc_paths": 9}, 100),
    ("testing", {"has_test_path": True}, 70), ("testing", {"has_test_path": True, "has_testing_framework": True}, 90),
    ("architecture", {"confidence": 50.0, "layers_n": 3}, 70), ("architecture", {"confidence": 50.01, "layers_n": 4, "modules_n": 1}, 100),
    ("performance", {"has_performance_path": True, "max_complexity": 31.0}, 70), ("performance", {"max_complexity": 30.0}, 75),
    ("quality", {"total_files": 10, "total_functions": 20}, 80), ("quality", {"total_files": 10, "total_functions": 21}, 90),
    ("quality", {"total_files": 1, "total_functions": 21, "avg_complexity": 10.5}, 50), ("quality", {"avg_complexity": 3.0}, 70),
    ("complexity", {}, 90), ("complexity", {"total_files": 1, "total_lines": 301}, 75), ("complexity", {"total_files": 1, "total_lines": 501, "max_complexity": 51.0}, 55),
    ("dependency", {}, 100), ("dependency", {"deps_n": 3, "outdated_n": 2}, 60), ("dependency", {"deps_n": 99, "outdated_n": 50}, 0),
    ("activity", {"contributors_n": 1}, 60), ("activity", {"contributors_n": 2}, 70), ("activity", {"contributors_n": 6}, 75), ("activity", {"contributors_n": 11}, 85),
])
def test_scores(spark, metric, changes, score):
    inputs = spark.createDataFrame([{"repo_id": "r", **BASE, **changes}])
    assert health.health(inputs).collect()[0][metric] == score


def test_overall_rounds_half_even(spark):
    # 0.01 * weighted sum ends in .25 for these scores
    inputs = spark.createDataFrame([{"repo_id": "r", **BASE, "deps_n": 1, "outdated_n": 1}])
    row = health.health(inputs).collect()[0]
    exact = sum(row[m] * w for m, w in rules.HEALTH_WEIGHTS.items()) / 100
    assert row["overall"] == round(exact, 1)


def test_breakdown_recommendations_label(spark):
    scores = health.health(spark.createDataFrame([{"repo_id": "r", **BASE, "deps_n": 10, "outdated_n": 9, "avg_function_length": 60.0}]))
    assert len(rows_of(health.health_breakdown(scores), "metric", "score", "max", "weight")) == 10
    messages = [r["message"][:12] for r in health.recommendations(scores).orderBy("seq").collect()]
    assert messages == ["Add comprehe", "Increase tes", "Update outda"]
    labels = spark.createDataFrame([(80.0,), (79.9,), (59.9,), (39.9,)], "s double").select(health.health_label(F.col("s")))
    assert [r[0] for r in labels.collect()] == ["Excellent", "Good", "Fair", "Needs Work"]
