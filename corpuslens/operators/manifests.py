"""D family: dependencies declared in package manifests.

Each format is one array expression over the text of a manifest, so all seven share one scan and
one narrow stage: file-name filter, expression, explode.  Nothing shuffles until a caller groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import prune_paths
from corpuslens.functions.text import bound, find_all, find_fields, for_letters_of, lines, lstrip, pattern, strip
from corpuslens.operators.files import with_text

NPM_SCHEMA = ", ".join(f"{section} map<string,string>" for section, _ in rules.NPM_GROUPS)


def _row(name: Column, version: Column, group: Column | None = None) -> Column:
    no_group = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"), version.alias("version"), (no_group if group is None else group).alias("dep_group"))


def _piece(parts: Column, index: int) -> Column:
    return strip(F.get(parts, F.lit(index)))


def npm_packages(text: Column) -> Column:
    none = F.array().cast("array<struct<key:string,value:string>>")

    def last_of_key(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        # of a key that stands twice the last value counts, at the place of the first
        last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1))
        return F.when(F.size(names) == F.size(entries), entries).otherwise(last)

    def packages(parsed: Column, section: str, label: str) -> Column:
        entries = F.coalesce(F.map_entries(parsed[section]), none)
        return F.transform(
            bound(entries, last_of_key), lambda e: _row(e["key"], lstrip(e["value"], rules.VERSION_PREFIX_CHARS), F.lit(label)))

    return bound(F.from_json(text, NPM_SCHEMA), lambda parsed: F.concat(
        *[packages(parsed, section, label) for section, label in rules.NPM_GROUPS]))


def pypi_packages(text: Column) -> Column:
    wanted = F.filter(
        F.transform(lines(text), lambda line: strip(line)),
        lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("-"))
    split = F.transform(wanted, lambda line: F.split(line, "[=<>~!]", 2))
    return F.transform(split, lambda p: _row(_piece(p, 0), F.coalesce(_piece(p, 1), F.lit("*"))))


def _section_lines(text: Column, starts: str, header: str) -> Column:
    """Lines of every section whose first line begins with ``header``, without that line."""
    sections = F.filter(
        F.split(text, "(?m)(?d)^(?=" + starts + ")"), lambda s: lstrip(s, " \t\r\x0b\x0c").startswith(header))
    return F.flatten(F.transform(sections, lambda s: F.slice(lines(s), F.lit(2), F.size(lines(s)))))


def cargo_packages(text: Column) -> Column:
    entries = F.filter(
        _section_lines(text, r"[^\S\n]*\[", "[dependencies"), lambda line: F.contains(line, F.lit("=")))
    split = F.transform(entries, lambda line: F.split(line, "=", 2))
    return F.transform(split, lambda p: _row(_piece(p, 0), strip(strip(_piece(p, 1), '"'), "'")))


GO_BLOCK = pattern(r"^[^\S\n]*require[^\S\n]*\((.*?)(?:^[^\S\n]*\)|\z)", dotall=True, multiline=True)


def go_packages(text: Column) -> Column:
    """Single `require` lines and `require ( ... )` blocks; a trailing comment is no version."""
    single = F.filter(
        F.transform(lines(F.regexp_replace(text, GO_BLOCK, "")), lambda line: strip(line)),
        lambda line: line.startswith("require"))
    in_blocks = F.filter(
        F.transform(F.flatten(F.transform(find_all(text, GO_BLOCK), lines)), lambda line: strip(line)),
        lambda line: (line != "") & ~line.startswith("//"))

    def tokens(at: int) -> Callable[[Column], Column]:
        def entry(line: Column) -> Column:
            words = F.split(line, for_letters_of(line, r"(?U)\s+"))
            version = F.get(words, F.lit(at + 1))
            return _row(
                F.get(words, F.lit(at)),
                F.when(version.startswith("//"), "*").otherwise(F.coalesce(version, F.lit("*"))))
        return entry

    rows = F.concat(F.transform(single, tokens(1)), F.transform(in_blocks, tokens(0)))
    return F.filter(rows, lambda r: r["name"].isNotNull())


def gem_packages(text: Column) -> Column:
    names = find_all(text, pattern(r"""^gem[^\S\n]+['"]([\w-]+)['"]""", multiline=True))
    return F.transform(names, lambda n: _row(n, F.lit("*")))


def pub_packages(text: Column) -> Column:
    entries = F.filter(
        _section_lines(text, r"[^\s#]", "dependencies:"), lambda line: F.contains(line, F.lit(":")))
    split = F.transform(entries, lambda line: F.split(line, ":", 2))
    return F.transform(split, lambda p: _row(_piece(p, 0), _piece(p, 1)))


# each step goes to the next mark and is never taken back, so a block without a version costs one look ahead
MAVEN_BLOCK = (r"(?s)<dependency>(?>.*?<groupId>)(?>(.*?)</groupId>)(?>.*?<artifactId>)(?>(.*?)</artifactId>)"
               r"(?>.*?<version>)(?>(.*?)</version>)(?>.*?</dependency>)")


def maven_packages(text: Column) -> Column:
    """A block without a version takes the next one in the file; after the last version nothing can match."""
    closed = F.substring(text, 1, F.length(text) - F.length(F.substring_index(text, "</dependency>", -1)))
    rest = F.substring_index(closed, "</version>", -1)
    last = F.concat(F.substring_index(rest, "</dependency>", 1), F.lit("</dependency>"))
    cut = F.concat(F.substring(closed, 1, F.length(closed) - F.length(rest)), last)
    blocks = find_fields(cut, MAVEN_BLOCK, organisation=1, artifact=2, version=3)
    found = F.transform(
        blocks, lambda b: _row(F.concat_ws(".", b["organisation"], b["artifact"]), b["version"]))
    none = F.expr("CAST(array() AS array<struct<name:string,version:string,dep_group:string>>)")
    return F.when(F.contains(closed, F.lit("</version>")), found).otherwise(none)


FORMATS: dict[str, Callable[[Column], Column]] = {
    "package.json": npm_packages,
    "requirements.txt": pypi_packages,
    "Cargo.toml": cargo_packages,
    "go.mod": go_packages,
    "Gemfile": gem_packages,
    "pubspec.yaml": pub_packages,
    "pom.xml": maven_packages,
}


PACKAGES = "array<struct<name:string,version:string,dep_group:string>>"


def packages_in(names: list[str] | None = None) -> Column:
    """The packages that a file declares, NULL where its name is none of the manifests."""
    names = names or list(FORMATS)
    found = F.when(F.col("name") == names[0], FORMATS[names[0]](F.col("text")))
    for name in names[1:]:
        found = found.when(F.col("name") == name, FORMATS[name](F.col("text")))
    return found


def as_dependencies(rows: DataFrame) -> DataFrame:
    """One row a package, from (repo_id, path, name, packages)."""
    names = list(FORMATS)
    source = F.lit(rules.MANIFEST_SOURCES[names[0]])
    for name in names[1:]:
        source = F.when(F.col("name") == name, rules.MANIFEST_SOURCES[name]).otherwise(source)
    # a plain posexplode is given a filter on the size of its array, which works the whole array out a second time
    rows = rows.select(
        "repo_id", F.col("path").alias("source_file"), source.alias("source"),
        F.posexplode_outer("packages").alias("seq", "d")).where("seq IS NOT NULL")
    return rows.select(
        "repo_id", "source_file", "seq", F.col("d.name").alias("name"), F.col("d.version").alias("version"),
        F.lit("external").alias("type"), "source", F.col("d.dep_group").alias("dep_group"))


def _extract(files: DataFrame, names: list[str]) -> DataFrame:
    manifests = with_text(prune_paths(files, "P1")).where(F.col("name").isin(names))
    return as_dependencies(manifests.select("repo_id", "path", "name", packages_in(names).alias("packages")))


def dependencies(files: DataFrame) -> DataFrame:
    """All seven formats in one pass; duplicates are kept."""
    return _extract(files, list(FORMATS))


def deps_npm(files: DataFrame) -> DataFrame:
    return _extract(files, ["package.json"])


def deps_pypi(files: DataFrame) -> DataFrame:
    return _extract(files, ["requirements.txt"])


def deps_cargo(files: DataFrame) -> DataFrame:
    return _extract(files, ["Cargo.toml"])


def deps_go(files: DataFrame) -> DataFrame:
    return _extract(files, ["go.mod"])


def deps_gem(files: DataFrame) -> DataFrame:
    return _extract(files, ["Gemfile"])


def deps_pub(files: DataFrame) -> DataFrame:
    return _extract(files, ["pubspec.yaml"])


def deps_maven(files: DataFrame) -> DataFrame:
    return _extract(files, ["pom.xml"])


def deps_by_source(deps: DataFrame) -> DataFrame:
    """How many per ecosystem.  The names stay rows of `deps`: a group has no size bound."""
    return deps.groupBy("repo_id", "source").agg(F.count("*").alias("n"))
