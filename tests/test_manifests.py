from corpuslens.operators import frameworks, manifests
from tests.conftest import rows_of


def deps(make_files, path, content):
    df = manifests.dependencies(make_files({path: content})).orderBy("seq")
    return [(r["name"], r["version"]) for r in df.collect()]


def test_npm(make_files):
    text = '{"dependencies": {"a": "^1.0", "b": {"x": 1}}, "peerDependencies": {"c": ">=2"}, "devDependencies": {"d": "~3"}}'
    got = manifests.deps_npm(make_files({"package.json": text})).orderBy("seq").collect()
    assert [(r["name"], r["version"], r["dep_group"]) for r in got] == [
        ("a", "1.0", "dependencies"), ("b", '{"x":1}', "dependencies"), ("d", "3", "dev"), ("c", "2", "peer")]
    assert deps(make_files, "package.json", "{not json") == []
    assert deps(make_files, "package.json", '{"dependencies": null, "devDependencies": {"z": "1"}}') == [("z", "1")]


def test_pypi(make_files):
    text = "# c\n-r x.txt\n\nflask==2.0\n  uvicorn[standard]>=0.1 ; python_version<'3'\nplain\nx~=1 # note\n"
    assert deps(make_files, "requirements.txt", text) == [
        ("flask", "=2.0"), ("uvicorn[standard]", "=0.1 ; python_version<'3'"), ("plain", "*"), ("x", "=1 # note")]


def test_cargo_sections(make_files):
    text = ('[package]\nname = "n"\n[dependencies]\na = "1"\nb = { version = "2", features = ["x"] }\n'
            "[dev-dependencies]\nd = '1'\n  [dependencies.serde]\nversion = '3'\n")
    assert deps(make_files, "Cargo.toml", text) == [
        ("a", "1"), ("b", '{ version = "2", features = ["x"] }'), ("version", "3")]


def test_go_blocks(make_files):
    text = "module m\nrequire one v1\nrequire two\nrequire (\n\tthree v3\n\tfour v4 // indirect\n\t// note\n)\nrequire five // indirect\n"
    assert deps(make_files, "go.mod", text) == [
        ("one", "v1"), ("two", "*"), ("five", "*"), ("three", "v3"), ("four", "v4")]


def test_gem_column_zero(make_files):
    assert deps(make_files, "Gemfile", "gem 'a-b', '1'\n  gem 'in'\ngem\n'c'\ngem \"d\"\n") == [("a-b", "*"), ("d", "*")]


def test_pub_section_ends_at_next_key(make_files):
    text = "name: n\ndependencies:\n  a: ^1\n  flutter:\n    sdk: flutter\n# c\n  b: 2\ndev_dependencies:\n  d: 4\n"
    assert deps(make_files, "pubspec.yaml", text) == [("a", "^1"), ("flutter", ""), ("sdk", "flutter"), ("b", "2")]


def test_maven_borrows_next_version(make_files):
    one = "<dependency><groupId>g</groupId><artifactId>{}</artifactId>{}</dependency>\n"
    text = one.format("a", "<version>1</version>") + one.format("b", "") + one.format("c", "<version>3</version>")
    assert deps(make_files, "pom.xml", text) == [("g.a", "1"), ("g.b", "3")]


def test_pruned_manifests_are_ignored(make_files):
    df = make_files({"node_modules/p/package.json": '{"dependencies": {"a": "1"}}', "x/go.mod": "require a v1"})
    assert rows_of(manifests.deps_by_source(manifests.dependencies(df)), "source", "n") == [("go", 1)]


def found(make_files, rows):
    return rows_of(frameworks.frameworks(make_files(rows)), "framework", "version", "category")


def test_framework_root_files_only(make_files):
    assert found(make_files, {"sub/urls.py": "", "Dockerfile": "", "config/routes.rb": ""}) == [
        ("docker", None, "devops"), ("rails", None, "backend")]


def test_framework_substring_and_versions(make_files):
    assert found(make_files, {"package.json": '{"dependencies": {"preact": "^9"}}'}) == [("react", None, "frontend")]
    rows = {"a/package.json": '{"dependencies": {"next": "^13", "react-dom": "~18"}}', "b/package.json": '{"dependencies": {"react": "17"}}'}
    assert found(make_files, rows) == [("react", "18", "frontend")]
    both = {"package.json": '{"dependencies": {"jest": "1"}, "devDependencies": {"jest": ">=2"}}'}
    assert found(make_files, both) == [("jest", "2", "testing")]


def test_framework_requirements(make_files):
    rows = {"requirements.txt": "Flask-Login>=1\nmy-FLASK==2.0==x ; y\nDjango==4\n"}
    assert found(make_files, rows) == [("django", "4", "backend"), ("flask", "2.0", "backend")]
    assert rows_of(frameworks.framework_by_dep(make_files({**rows, "manage.py": ""})), "framework") == [("flask",)]
