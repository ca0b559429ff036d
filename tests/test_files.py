from corpuslens.functions.paths import path_parts, prune_paths
from corpuslens.operators import files
from corpuslens.operators.architecture import walked_directories
from tests.conftest import rows_of


def test_line_rules(make_files):
    cases = {"a.c": "", "b.c": "a\n", "c.c": "a\nb", "d.c": "a\r\nb\r\n", "e.c": "a\rb"}
    assert rows_of(files.count_lines(make_files(cases)), "path", "lines") == [
        ("a.c", 0), ("b.c", 1), ("c.c", 2), ("d.c", 2), ("e.c", 2)]


def test_path_parts(make_files):
    paths = [".gitignore", "a.b.PY", "x/Dockerfile", "x/..a", "x/..a.b", "x/a.", "x/.env.local"]
    got = rows_of(path_parts(make_files({p: "" for p in paths})), "path", "dir", "name", "ext")
    assert got == sorted([
        (".gitignore", "", ".gitignore", ""), ("a.b.PY", "", "a.b.PY", ".py"),
        ("x/Dockerfile", "x", "Dockerfile", ""), ("x/..a", "x", "..a", ""), ("x/..a.b", "x", "..a.b", ".b"),
        ("x/a.", "x", "a.", "."), ("x/.env.local", "x", ".env.local", ".local")])


def test_prune_profiles(make_files):
    paths = [".env", "a/.git/x", "a/node_modules/x", "node_modules", "venv/x", "a/__pycache__/x", "dist/x", "src/build/x", "ok/x"]
    df = make_files({p: "" for p in paths})
    kept = lambda p: {r[0] for r in rows_of(prune_paths(df, p), "path")}
    assert kept("P1") == {".env", "node_modules", "dist/x", "src/build/x", "ok/x"}
    assert kept("P2") == kept("P1") | {"a/__pycache__/x"}
    assert kept("P3") == {".env", "node_modules", "ok/x"}
    assert kept("P4") == kept("P2") | {"venv/x"}


def test_language_rules(make_files):
    names = {"package.json": "JSON", "setup.py": "Python", "requirements.txt": "Python", "go.sum": "Go", "Rakefile": "Ruby",
             "a.H": "C", "x.unknown": "Unknown", "Pipfile": "Python", "composer.lock": "PHP"}
    got = rows_of(files.classify_language(make_files({n: "" for n in names})), "path", "language")
    assert got == sorted(names.items())


def test_language_share_counts_unknown_lines(make_files):
    df = make_files({"a.py": "x\n" * 3, "b.go": "", "c.zzz": "x\n"})
    stats = files.language_stats(files.files_classified(df))
    assert rows_of(stats, "language", "percentage", "files", "lines") == [("Python", 75.0, 1, 3)]
    assert rows_of(files.primary_language(stats, df), "repo_id", "language") == [("r", "Python")]
    empty = make_files({"c.zzz": "x"})
    assert rows_of(files.primary_language(files.language_stats(files.files_classified(empty)), empty), "language") == [("Unknown",)]


def test_readme_previews_size(make_files):
    df = make_files({"README": "no", "README.rst": "y" * 6000, "docs/README.md": "no", "a.py": "é" * 4000, "node_modules/b.py": "x"})
    assert rows_of(files.pick_readme(df), "readme") == [("y" * 5000,)]
    assert rows_of(files.file_previews(df), "path", "preview") == [("a.py", "é" * 3000), ("docs/README.md", "no")]
    assert rows_of(files.repo_size(df), "bytes") == [(2 + 6000 + 2 + 8000,)]


def test_directories_above_pruned_ones_are_walked(make_files):
    df = make_files({"web/node_modules/x/f.py": "", "a/b/.c/d/f": "", "top": ""})
    assert {r[0] for r in rows_of(walked_directories(df), "dir")} == {".", "web", "a", "a/b"}
