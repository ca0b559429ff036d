"""Findings of round 4 on diagrams."""

from checks.oracles import ORACLES
from corpuslens.operators import diagrams
from corpuslens.plans.analysis import Analysis, stored
from tests.conftest import rows_of


def test_every_kind_of_diagram_is_there(make_files, make_commits, tmp_path):
    """The dependency diagram as its lines in order, the others as one text each."""
    found = make_files([("r", "README.md", "# x"), ("r", "a.py", "x = 1\n"), ("r", "package.json", '{"dependencies": {"b": "1", "a-c": "2"}}'), ("s", "a.go", "")])
    whole = Analysis(found, make_commits([]), stored(str(tmp_path)))
    rows = whole.all_diagrams
    texts = {r["type"]: r["text"] for r in rows.where("repo_id = 'r' AND type <> 'dependency'").collect()}
    assert set(texts) == {"architecture", "sequence", "directory", "layer"} and "a.py" in texts["directory"]
    assert rows_of(rows.where("type <> 'dependency'"), "repo_id", "type", "text") == rows_of(whole.diagrams, "repo_id", "type", "text")
    lines = rows.where("repo_id = 'r' AND type = 'dependency'").orderBy(*diagrams.DEPENDENCY_LINE_ORDER).collect()
    assert [r["text"].strip() for r in lines] == [
        "graph LR", "subgraph Project[Project Dependencies]", "subgraph npm[NPM - 2 deps]", "a_c[<b>a-c</b>]", "b[<b>b</b>]", "end", "end",
        "subgraph Lang[Languages]", *(r["text"].strip() for r in lines[8:-1]), "end"]


def test_the_query_leaves_no_kind_out():
    assert all(f"'{kind}'" in ORACLES["diagram_text"] for kind in ("architecture", "sequence", "directory", "layer", "dependency"))
