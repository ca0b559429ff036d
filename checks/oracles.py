"""Oracle SQL for the registered queries, in DuckDB's dialect over the given tables only.

Two kinds: answers taken straight from the table rows that a corpus was written from (round trip),
and mirrors of a rule over the corpus text.  Constants come from the same fixed-value tables as the
operators; all logic is written independently in SQL.
"""

from __future__ import annotations

from checks.fixtures import LINE_KEY, duckdb_sql
from corpuslens import rules

ORACLES: dict[str, str] = {}
WORD = r"[\p{L}\p{N}_]"
NL = "chr(10)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def re2(body: str, flags: str = "") -> str:
    """A rule pattern as a DuckDB literal."""
    # inside a character class the word class may not bring its own brackets
    body = body.replace(r"[\w", "[" + WORD[1:-1]).replace(r"\w", WORD)
    return q((f"(?{flags})" if flags else "") + body)


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in parts) + "\n"


def fx(name: str) -> tuple[str, str]:
    return ("fx", duckdb_sql(name))


HIDDEN = {p: r"(^|/)(\.[^/]*|" + "|".join(d) + ")/" for p, d in rules.PRUNED_DIRS.items()}


def kept(profile: str, path: str = "path") -> str:
    return f"NOT regexp_matches({path}, {q(HIDDEN[profile])})"


NAME = "regexp_extract(path, '[^/]*$')"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
EXT = f"lower(regexp_extract({NAME}, '^\\.*[^.].*?(\\.[^.]*)$', 1))"
TEXT = r"regexp_replace(content, '\r\n?', chr(10), 'g')"

#: the corpus with path parts and universal newlines
PARTS = f"SELECT repo_id, path, {DIR} AS dir, {NAME} AS name, {EXT} AS ext, content, {TEXT} AS txt FROM fx"

# --- scans ------------------------------------------------------------------------------------------
ORACLES["prune_paths"] = ctes(fx("files")) + "\nUNION ALL\n".join(
    f"SELECT '{p}' AS profile, repo_id, path FROM fx WHERE {kept(p)}" for p in HIDDEN)
ORACLES["path_parts"] = ctes(fx("all"), ("f", PARTS)) + "SELECT repo_id, path, dir, name, ext FROM f"
ORACLES["previews"] = ctes(fx("files"), ("f", PARTS)) + (
    f"SELECT repo_id, path, substring(txt, 1, 3000) AS preview FROM f "
    f"WHERE {kept('P1')} AND ext IN {in_list(rules.PREVIEW_EXTENSIONS)}")
README = (
    "SELECT repo_id, arg_min(substring(txt, 1, 5000), list_position(['README.md', 'README.rst', 'README.txt', 'README'], path)) AS readme "
    "FROM f WHERE path IN ('README.md', 'README.rst', 'README.txt', 'README') GROUP BY repo_id")
ORACLES["readme"] = ctes(fx("files"), ("f", PARTS)) + README
ORACLES["repo_size"] = ctes(fx("all")) + (
    f"SELECT repo_id, cast(sum(strlen(content)) AS bigint) AS bytes FROM fx WHERE {kept('P4')} GROUP BY repo_id")

# --- languages ----------------------------------------------------------------------------------------
EXT_ROWS = ", ".join(f"({q(e)}, {q(lang)})" for e, lang in rules.LANGUAGE_BY_EXTENSION.items())
NAME_ROWS = ", ".join(f"({q(n)}, {q(lang)})" for lang, names in rules.FILE_NAMES_BY_LANGUAGE.items() for n in names)
LINES = "cast(length(txt) - length(replace(txt, chr(10), '')) + CASE WHEN txt = '' OR ends_with(txt, chr(10)) THEN 0 ELSE 1 END AS bigint)"
CLASSIFIED = (
    f"SELECT f.*, coalesce(e.lang, n.lang, 'Unknown') AS language, {LINES} AS lines FROM f "
    f"LEFT JOIN (VALUES {EXT_ROWS}) e(ext, lang) ON e.ext = f.ext LEFT JOIN (VALUES {NAME_ROWS}) n(name, lang) ON n.name = f.name")
BASE = [("f", PARTS), ("c", CLASSIFIED)]
STATS = (
    f"SELECT repo_id, language, round_even(sum(lines) / any_value(total) * 100, 2) AS percentage, count(*) AS files, cast(sum(lines) AS bigint) AS lines "
    f"FROM (SELECT *, sum(lines) OVER (PARTITION BY repo_id) AS total FROM c WHERE {kept('P1')}) x "
    f"WHERE language <> 'Unknown' AND lines > 0 GROUP BY repo_id, language")
ORACLES["classify_language"] = ctes(fx("all"), *BASE) + "SELECT repo_id, path, language FROM c"
ORACLES["count_lines"] = ctes(fx("all"), *BASE) + "SELECT repo_id, path, lines FROM c"
ORACLES["language_stats"] = ctes(fx("all"), *BASE) + STATS
ORACLES["primary_language"] = ctes(fx("all"), *BASE, ("s", STATS)) + (
    "SELECT repo_id, coalesce(language, 'Unknown') AS language FROM (SELECT DISTINCT repo_id FROM fx) r LEFT JOIN "
    "(SELECT repo_id, language FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY percentage DESC, language) = 1) b USING (repo_id)")

# --- frameworks -----------------------------------------------------------------------------------------
RULE_FILES = ", ".join(f"({i}, {q(n)}, {q(f)})" for i, (n, fs, _, _) in enumerate(rules.FRAMEWORKS, 1) for f in fs)
RULE_DEPS = ", ".join(f"({i}, {q(n)}, {q(d)}, {j})" for i, (n, _, ds, _) in enumerate(rules.FRAMEWORKS, 1) for j, d in enumerate(ds))
RULE_ROWS = ", ".join(f"({i}, {q(n)}, {q(c)})" for i, (n, _, _, c) in enumerate(rules.FRAMEWORKS, 1))
FRAMEWORK_CTES = [
    ("f", PARTS),
    ("rf", f"SELECT * FROM (VALUES {RULE_FILES}) t(rule_no, framework, file)"),
    ("rd", f"SELECT * FROM (VALUES {RULE_DEPS}) t(rule_no, framework, dep, dep_no)"),
    ("by_file", "SELECT DISTINCT repo_id, framework FROM f JOIN rf ON f.path = rf.file OR starts_with(f.path, rf.file || '/')"),
    ("m", f"SELECT repo_id, path, name, txt, CASE WHEN name = 'package.json' THEN txt ELSE '{{}}' END AS js FROM f "
          f"WHERE name IN ('package.json', 'requirements.txt') AND {kept('P2')}"),
    ("keys", "SELECT repo_id, path, unnest(list_concat(coalesce(json_keys(js, '$.dependencies'), []), coalesce(json_keys(js, '$.devDependencies'), []))) AS key FROM m"),
    ("dep_hits", "SELECT repo_id, framework FROM keys JOIN rd ON contains(key, dep) UNION "
                 "SELECT repo_id, framework FROM m JOIN rd ON name = 'requirements.txt' AND contains(lower(txt), dep)"),
    ("ver", "SELECT repo_id, framework, path, 0 AS line_no, dep_no, ltrim(coalesce(json_extract_string(js, '$.devDependencies.\"' || dep || '\"'), json_extract_string(js, '$.dependencies.\"' || dep || '\"')), '^~>=<') AS version "
            "FROM m JOIN rd ON name = 'package.json' UNION ALL "
            "SELECT repo_id, framework, path, line_no, 0, trim(split_part(line, '==', 2)) FROM (SELECT repo_id, path, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS line_no FROM m WHERE name = 'requirements.txt') l "
            "JOIN rd ON contains(lower(line), dep) AND contains(line, '==')"),
    ("version", "SELECT repo_id, framework, version FROM ver WHERE version IS NOT NULL "
                "QUALIFY row_number() OVER (PARTITION BY repo_id, framework ORDER BY path, line_no, dep_no) = 1"),
]
FRAMEWORKS = (
    f"SELECT h.repo_id, r.rule_no, h.framework, v.version, r.category FROM (SELECT * FROM by_file UNION SELECT * FROM dep_hits) h "
    f"JOIN (VALUES {RULE_ROWS}) r(rule_no, framework, category) USING (framework) LEFT JOIN version v USING (repo_id, framework)")
ORACLES["framework_by_file"] = ctes(fx("all"), *FRAMEWORK_CTES) + "SELECT * FROM by_file"
ORACLES["framework_by_dep"] = ctes(fx("all"), *FRAMEWORK_CTES) + (
    "SELECT DISTINCT repo_id, framework FROM dep_hits ANTI JOIN by_file USING (repo_id, framework)")
ORACLES["framework_version"] = ctes(fx("all"), *FRAMEWORK_CTES) + "SELECT * FROM version"
ORACLES["frameworks"] = ctes(fx("all"), *FRAMEWORK_CTES) + FRAMEWORKS

# --- dependencies: straight from the rows the manifests were written from ----------------------------------
KINDS = [("npm", "package.json", "name", "version"), ("pypi", "requirements.txt", "name", "'=' || version"),
         ("cargo", "Cargo.toml", "name", "version"), ("go", "go.mod", "name", "'v' || version"),
         ("gem", "Gemfile", "name", "'*'"), ("pub", "pubspec.yaml", "name", "version"),
         ("maven", "pom.xml", "'g.' || name", "version")]


def dep_rows(kind: int) -> str:
    short, file, name, version = KINDS[kind]
    source = rules.MANIFEST_SOURCES[file]
    group = "'dependencies'" if kind == 0 else "cast(NULL AS varchar)"
    return (f"SELECT repo_id, 'pkg' || file_no || '/{file}' AS source_file, cast(row_number() OVER (PARTITION BY file_no ORDER BY r.name) - 1 AS integer) AS seq, "
            f"{name} AS name, {version} AS version, 'external' AS type, '{source}' AS source, {group} AS dep_group FROM r WHERE kind = {kind}")


DEP_ROWS = ("r", duckdb_sql("dep_rows"))
for _i, _k in enumerate(KINDS):
    ORACLES[f"deps_{_k[0]}"] = ctes(DEP_ROWS) + dep_rows(_i)
STACK_DEPS = (
    "SELECT repo_id, path AS source_file, cast(seq AS integer) AS seq, name, version, 'external' AS type, source, dep_group FROM ("
    "SELECT 'repo' || s_suppkey % 20 AS repo_id, 'stack' || s_suppkey || '/package.json' AS path, 0 AS seq, 'preact' AS name, s_nationkey || '.0' AS version, 'npm' AS source, 'dependencies' AS dep_group FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL "
    "SELECT 'repo' || s_suppkey % 20, 'stack' || s_suppkey || '/package.json', 1, 'express', '4.' || s_nationkey, 'npm', 'dependencies' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL "
    "SELECT 'repo' || s_suppkey % 20, 'stack' || s_suppkey || '/package.json', 2, 'jest', cast(s_suppkey AS varchar), 'npm', 'dev' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL "
    "SELECT 'repo' || s_suppkey % 20, 'stack' || s_suppkey || '/requirements.txt', 0, 'Django', '=' || s_nationkey || '.' || s_suppkey, 'pypi', NULL FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL "
    "SELECT 'repo' || s_suppkey % 20, 'stack' || s_suppkey || '/requirements.txt', 1, 'flask', '=1', 'pypi', NULL FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL "
    "SELECT 'repo' || s_suppkey % 20, 'stack' || s_suppkey || '/requirements.txt', 2, 'beta-lib', '*', 'pypi', NULL FROM supplier WHERE s_suppkey % 5 = 1) t")
DEPS = "\nUNION ALL\n".join(dep_rows(i) for i in range(7)) + "\nUNION ALL\n" + STACK_DEPS
DEP_CTES = [DEP_ROWS, ("d", DEPS)]
ORACLES["dependencies"] = ctes(*DEP_CTES) + "SELECT * FROM d"
ORACLES["deps_by_source"] = ctes(*DEP_CTES) + "SELECT repo_id, source, count(*) AS n FROM d GROUP BY repo_id, source"
ORACLES["first_n"] = ctes(*DEP_CTES) + (
    "SELECT repo_id, cast(rank AS integer) AS rank, source_file, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY source_file, seq) AS rank FROM d) x WHERE rank <= 50")

# --- symbols: straight from the rows the sources were written from -----------------------------------------
CODE_ROWS = (f"SELECT *, 'repo' || l_orderkey % 20 AS repo_id, 'src/m' || l_orderkey || CASE l_orderkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '.php' END AS path, "
             f"row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_partkey) - 1 AS b FROM (SELECT *, {LINE_KEY} AS k FROM lineitem) l")
PY_ROWS = (f"SELECT *, 'repo' || l_orderkey % 20 AS repo_id, 'app/p' || l_orderkey || '.py' AS path, cast(l_quantity AS int) % 4 AS n, "
           f"row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_partkey) - 1 AS b FROM (SELECT *, {LINE_KEY} AS k FROM lineitem) l")


def symbol_rows(*rows: tuple[str, str, str, str]) -> str:
    """(kind, seq expression, name expression, from/where) -> UNION ALL of long symbol rows."""
    return "\nUNION ALL\n".join(
        f"SELECT repo_id, path, '{kind}' AS kind, cast({seq} AS integer) AS seq, {name} AS name FROM {source}"
        for kind, seq, name, source in rows)


ORACLES["symbols_jsts"] = ctes(("r", CODE_ROWS)) + symbol_rows(
    ("import", "b", "'lib' || l_suppkey", "r WHERE l_orderkey % 3 < 2"),
    ("function", "b", "'f' || l_partkey", "r WHERE l_orderkey % 3 < 2"))
ORACLES["symbols_python"] = ctes(("r", PY_ROWS)) + symbol_rows(("function", "b", "'f' || l_partkey", "r"))
LANG_ROWS = ("l", "SELECT *, 'repo' || c_custkey % 20 AS repo_id, 'lang/c' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '.cs' END AS path, c_custkey AS c, c_nationkey AS n FROM customer")
JAVA_SYMBOLS = symbol_rows(
    ("import", "0", "'com.n' || n || '.C' || c", "l WHERE c % 4 = 0"), ("class", "0", "'C' || c", "l WHERE c % 4 = 0"),
    ("class", "1", "'D' || c", "l WHERE c % 4 = 0"))
GO_SYMBOLS = symbol_rows(
    ("import", "0", "'fmt'", "l WHERE c % 4 = 1"), ("import", "1", "'lib/n' || n", "l WHERE c % 4 = 1"),
    ("import", "2", "'os'", "l WHERE c % 4 = 1"), ("class", "0", "'S' || c", "l WHERE c % 4 = 1"),
    ("function", "0", "'F' || c", "l WHERE c % 4 = 1"))
RUST_SYMBOLS = symbol_rows(
    ("import", "0", "'std::n' || n", "l WHERE c % 4 = 2"), ("import", "1", "'c' || c", "l WHERE c % 4 = 2"),
    ("class", "0", "'S' || c", "l WHERE c % 4 = 2"), ("class", "1", "'S' || c", "l WHERE c % 4 = 2"),
    ("function", "0", "'f' || c", "l WHERE c % 4 = 2"))
CSHARP_SYMBOLS = symbol_rows(
    ("import", "0", "'System.N' || n", "l WHERE c % 4 = 3"), ("class", "0", "'C' || c", "l WHERE c % 4 = 3"))
for _name, _rows in (("java", JAVA_SYMBOLS), ("go", GO_SYMBOLS), ("rust", RUST_SYMBOLS), ("csharp", CSHARP_SYMBOLS)):
    ORACLES[f"symbols_{_name}"] = ctes(LANG_ROWS) + _rows
WEB_ROWS = ("w", "SELECT 'repo' || s_suppkey % 20 AS repo_id, 'web/s' || s_suppkey || CASE s_suppkey % 2 WHEN 0 THEN '.jsx' ELSE '.php' END AS path, s_suppkey AS s, s_nationkey AS n FROM supplier")
JSX_SYMBOLS = symbol_rows(
    ("import", "0", "'style' || n", "w WHERE s % 2 = 0"), ("import", "1", "'react'", "w WHERE s % 2 = 0"),
    ("import", "2", "'q' || s", "w WHERE s % 2 = 0"), ("import", "3", "'style' || n", "w WHERE s % 2 = 0"),
    ("export", "0", "'S' || s", "w WHERE s % 2 = 0"), ("export", "1", "'f' || s", "w WHERE s % 2 = 0"),
    ("export", "2", "'export { q }'", "w WHERE s % 2 = 0"), ("export", "3", "'q' || n", "w WHERE s % 2 = 0"),
    ("class", "0", "'S' || s", "w WHERE s % 2 = 0"), ("function", "0", "'render' || s", "w WHERE s % 2 = 0"),
    ("function", "1", "'f' || s", "w WHERE s % 2 = 0"), ("function", "2", "'arrow' || s", "w WHERE s % 2 = 0"))
PHP_SYMBOLS = symbol_rows(
    ("import", "0", "'App' || chr(92) || 'N' || n", "w WHERE s % 2 = 1"), ("import", "1", "'inc/s' || s", "w WHERE s % 2 = 1"),
    ("class", "0", "'P' || s", "w WHERE s % 2 = 1"), ("function", "0", "'m' || s", "w WHERE s % 2 = 1"))
ORACLES["symbols_jsx"] = ctes(WEB_ROWS) + JSX_SYMBOLS
ORACLES["symbols_php"] = ctes(WEB_ROWS) + PHP_SYMBOLS
ORACLES["definitions_jsts"] = ctes(("r", CODE_ROWS)) + (
    "SELECT repo_id, path, 'function' AS kind, cast(4 * b + 2 AS integer) AS line, 'f' || l_partkey AS name, '' AS bases FROM r WHERE l_orderkey % 3 < 2")
ORACLES["definitions_jsx"] = ctes(WEB_ROWS) + "\nUNION ALL\n".join(
    f"SELECT repo_id, path, '{kind}' AS kind, {line} AS line, {name} AS name, {bases} AS bases FROM w WHERE s % 2 = 0"
    for kind, line, name, bases in (
        ("class", 4, "'S' || s", "'Base' || n"), ("function", 5, "'render' || s", "''"), ("function", 8, "'f' || s", "''"),
        ("function", 12, "'arrow' || s", "''")))
# leading white space belongs to a Java class match, so the second class counts from the line before
ORACLES["definitions_java"] = ctes(LANG_ROWS) + (
    "SELECT repo_id, path, 'class' AS kind, 3 AS line, 'C' || c AS name, 'Base' || n AS bases, 'Runnable|I' || c AS interfaces FROM l WHERE c % 4 = 0 UNION ALL "
    "SELECT repo_id, path, 'class', 7, 'D' || c, '', '' FROM l WHERE c % 4 = 0")
PY_LINES = "SELECT *, 1 + coalesce(sum(2 * n + 2) OVER (PARTITION BY l_orderkey ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM r"
ORACLES["definitions_python"] = ctes(("r", PY_ROWS), ("p", PY_LINES)) + (
    "SELECT repo_id, path, 'function' AS kind, cast(b AS integer) AS seq, 'f' || l_partkey AS name, cast(line AS integer) AS line, '' AS bases, '' AS decorators FROM p")


def found(pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract_all(txt, {re2(pattern, flags)}, {group})"


JS_NAMES = (
    "list_filter(list_transform(list_zip(" + ", ".join(found(rules.JS_FUNCTION, g) for g in (1, 2, 3)) + "), "
    f"lambda z: coalesce(z[1], '') || coalesce(z[2], '') || coalesce(z[3], '')), lambda n: n NOT IN {in_list(rules.JS_NOT_FUNCTIONS)})")
GO_BLOCKS = f"flatten(list_transform({found(rules.GO_IMPORT_BLOCK, 1, 's')}, lambda b: regexp_extract_all(b, {q(rules.GO_IMPORT_ITEM)}, 1)))"
_JS, _NONE = "ext IN ('.js', '.jsx', '.ts', '.tsx')", "CAST([] AS VARCHAR[])"
MODULES = (
    f"SELECT repo_id, path, name, language, txt, ext, "
    f"CASE WHEN {_JS} THEN list_concat(list_concat({found(rules.JS_IMPORTS[0])}, {found(rules.JS_IMPORTS[1])}), list_concat({found(rules.JS_IMPORTS[2])}, {found(rules.JS_IMPORTS[3])})) "
    f"WHEN ext = '.java' THEN {found(rules.JAVA_IMPORT)} WHEN ext = '.go' THEN list_concat({GO_BLOCKS}, {found(rules.GO_IMPORT)}) "
    f"WHEN ext = '.rs' THEN {found(rules.RUST_IMPORT)} WHEN ext = '.cs' THEN {found(rules.CSHARP_IMPORT)} WHEN ext = '.php' THEN {found(rules.PHP_IMPORT)} ELSE {_NONE} END AS imports, "
    f"CASE WHEN {_JS} THEN list_concat(list_concat({found(rules.JS_EXPORTS[0][0])}, {found(rules.JS_EXPORTS[1][0], 0)}), {found(rules.JS_EXPORTS[2][0])}) ELSE {_NONE} END AS exports, "
    f"CASE WHEN {_JS} THEN {found(rules.JS_CLASS)} WHEN ext = '.java' THEN {found(rules.JAVA_CLASS)} WHEN ext = '.go' THEN {found(rules.GO_STRUCT)} WHEN ext = '.rs' THEN {found(rules.RUST_TYPE)} "
    f"WHEN ext IN ('.cs', '.php') THEN {found(rules.ANY_CLASS)} WHEN ext = '.py' THEN {found(r'(?m)^class\s+(\w+)')} ELSE {_NONE} END AS classes, "
    f"CASE WHEN {_JS} THEN {JS_NAMES} WHEN ext = '.go' THEN {found(rules.GO_FUNCTION)} WHEN ext = '.rs' THEN {found(rules.RUST_FUNCTION)} WHEN ext = '.php' THEN {found(rules.PHP_FUNCTION)} "
    f"WHEN ext = '.py' THEN {found(r'(?m)^def\s+(\w+)')} ELSE {_NONE} END AS functions "
    f"FROM c WHERE {kept('P1')} AND ext IN {in_list(rules.MODULE_EXTENSIONS)}")
# in the Python files of the corpora, statements stand at column 0; only `models.py` imports something,
# and a CREATE TABLE inside a string is no code
MODULES = MODULES.replace("ELSE CAST([] AS VARCHAR[]) END AS imports", "WHEN name = 'models.py' THEN ['django.db.models'] ELSE CAST([] AS VARCHAR[]) END AS imports")
ORACLES["modules"] = ctes(fx("all"), *BASE, ("m", MODULES)) + (
    "SELECT repo_id, path, name, 'file' AS type, language, array_to_string(imports, '|') AS imports, array_to_string(exports, '|') AS exports, "
    "array_to_string(classes, '|') AS classes, array_to_string(functions, '|') AS functions FROM m")

# --- call graph --------------------------------------------------------------------------------------------
CODE_LAST = "SELECT *, row_number() OVER (PARTITION BY path, l_partkey ORDER BY b DESC) AS back FROM r"
CODE_FUNCTIONS = (
    "SELECT repo_id, path, 'f' || l_partkey AS fn, ['f' || l_partkey, 'g' || l_suppkey, 'h' || l_linenumber] AS callees FROM x WHERE back = 1")
PY_FUNCTIONS = (
    "SELECT repo_id, path, 'f' || l_partkey AS fn, list_resize(CAST([] AS VARCHAR[]), cast(sum(n) AS bigint), 'g') AS callees FROM p GROUP BY repo_id, path, l_partkey")
LANG_FUNCTIONS = (
    "SELECT repo_id, path, 'run' || c AS fn, ['run' || c, 'go' || n] AS callees FROM l WHERE c % 4 = 0 UNION ALL "
    "SELECT repo_id, path, 'F' || c, ['F' || c, 'g' || n] FROM l WHERE c % 4 = 1 UNION ALL "
    "SELECT repo_id, path, 'M' || c, ['func', 'M' || c] FROM l WHERE c % 4 = 1 UNION ALL "
    "SELECT repo_id, path, 'f' || c, ['f' || c, 'g' || n] FROM l WHERE c % 4 = 2")
WEB_FUNCTIONS = "SELECT repo_id, path, 'm' || s AS fn, ['m' || s, 'run' || n] AS callees FROM w WHERE s % 2 = 1"
EDGES = "SELECT repo_id, path, fn, cast(generate_subscripts(callees, 1) - 1 AS integer) AS seq, unnest(callees) AS callee FROM e"
ORACLES["call_edges"] = ctes(("r", CODE_ROWS), ("x", CODE_LAST), ("e", CODE_FUNCTIONS)) + EDGES
ORACLES["calls_per_function"] = ctes(("r", CODE_ROWS), ("x", CODE_LAST), ("e", CODE_FUNCTIONS)) + (
    "SELECT repo_id, path || '::' || fn AS fn_id, cast(len(callees) AS integer) AS calls FROM e")
ORACLES["call_edges_lang"] = ctes(LANG_ROWS, ("e", LANG_FUNCTIONS)) + EDGES
ORACLES["call_edges_python"] = ctes(("p", PY_ROWS), ("e", PY_FUNCTIONS)) + EDGES
ORACLES["call_graph"] = ctes(
    ("r", CODE_ROWS), ("x", CODE_LAST), ("p", PY_ROWS), WEB_ROWS,
    ("e", "\nUNION ALL\n".join((CODE_FUNCTIONS, PY_FUNCTIONS, WEB_FUNCTIONS)))) + (
    "SELECT repo_id, path || '::' || fn AS fn_id, array_to_string(callees, '|') AS callees FROM e")

# --- architecture --------------------------------------------------------------------------------------------
INDICATORS = [(p, n, r, b) for p, (n, bodies) in enumerate(rules.ARCHITECTURES) for r, b in enumerate(bodies)]


def hits(column: str) -> str:
    """A list of {p, r} of the indicators found in a column."""
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, {re2(b, 'i')}) THEN {p * 10 + r} END" for p, _, r, b in INDICATORS)
    return f"list_filter([{cases}], lambda h: h IS NOT NULL)"


PATTERN_ROWS = ", ".join(f"({p}, {q(n)})" for p, (n, _) in enumerate(rules.ARCHITECTURES))
# a directory below a pruned one is not walked, the directories above it are
WALKED = r"regexp_extract(path, '^((?:[^./][^/]*/)*)', 1)"
ARCH_CTES = [
    ("f", PARTS),
    ("pat", f"SELECT * FROM (VALUES {PATTERN_ROWS}) t(p, pattern)"),
    ("comp", "SELECT repo_id, string_split(path, '/')[:-2] AS parts FROM fx"),
    ("cut", "SELECT DISTINCT repo_id, parts[:coalesce(list_position(list_transform(parts, lambda d: starts_with(d, '.') OR d IN ('node_modules', 'venv')), true) - 1, len(parts))] AS parts FROM comp"),
    ("dirs", "SELECT DISTINCT repo_id, array_to_string(parts[:n], '/') AS dir FROM (SELECT repo_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM cut) z UNION SELECT DISTINCT repo_id, '.' FROM fx"),
    ("dh", f"SELECT repo_id, dir, h FROM (SELECT repo_id, dir, unnest({hits('dir')}) AS h FROM dirs) z"),
    ("wf", f"SELECT * FROM f WHERE {kept('P2')}"),
    ("fh", f"SELECT repo_id, path, dir, name, unnest({hits('name')}) AS h FROM wf"),
    ("ch", f"SELECT repo_id, path, unnest({hits('head')}) AS h FROM (SELECT repo_id, path, substring(txt, 1, 5000) AS head FROM wf WHERE regexp_matches(name, '\\.(py|js|ts|java|md|yaml|yml|json)$')) z"),
    ("points", "SELECT repo_id, h // 10 AS p, 10 AS t FROM dh UNION ALL SELECT repo_id, h // 10, 5 FROM fh UNION ALL SELECT repo_id, h // 10, 3 FROM ch"),
    ("scores", "SELECT r.repo_id, pat.p, pat.pattern, coalesce(s.t, 0) AS tenths FROM (SELECT DISTINCT repo_id FROM fx) r CROSS JOIN pat "
               "LEFT JOIN (SELECT repo_id, p, sum(t) AS t FROM points GROUP BY repo_id, p) s ON s.repo_id = r.repo_id AND s.p = pat.p"),
    ("arch", "SELECT repo_id, pattern, CASE WHEN total > 0 THEN least(round_even(tenths / total * 100, 2), 99.0) ELSE 0.0 END AS confidence FROM "
             "(SELECT *, sum(tenths) OVER (PARTITION BY repo_id) AS total, row_number() OVER (PARTITION BY repo_id ORDER BY tenths DESC, p) AS rn FROM scores) z WHERE rn = 1"),
]


def arch(sql: str, corpus: str = "files") -> str:
    return ctes(fx(corpus), *ARCH_CTES) + sql


ORACLES["arch_dir_hits"] = arch("SELECT repo_id, pattern, dir, h % 10 AS rule_no FROM dh JOIN pat ON p = h // 10")
ORACLES["arch_file_hits"] = arch("SELECT repo_id, pattern, path, name, h % 10 AS rule_no FROM fh JOIN pat ON p = h // 10", "all")
ORACLES["arch_content_hits"] = arch("SELECT repo_id, pattern, path, h % 10 AS rule_no FROM ch JOIN pat ON p = h // 10", "all")
ORACLES["arch_scores"] = arch("SELECT repo_id, pattern, tenths / 10 AS score FROM scores", "all")
ORACLES["architecture"] = arch("SELECT repo_id, pattern, cast(confidence AS double) AS confidence FROM arch", "all")
PROFILE_ROWS = ", ".join(
    f"({q(n)}, {q(d)}, [{', '.join(q(x) for x in names)}])" for n, (d, names) in rules.ARCHITECTURE_PROFILES.items())
PROFILE = f"SELECT repo_id, a.pattern, cast(confidence AS double) AS confidence, description, layers FROM arch a JOIN (VALUES {PROFILE_ROWS}) t(pattern, description, layers) USING (pattern)"
ORACLES["arch_profile"] = arch(f"SELECT repo_id, pattern, description, array_to_string(layers, '|') AS layers FROM ({PROFILE}) z")
ORACLES["arch_evidence"] = arch(
    "SELECT repo_id, pattern, cast(rank AS integer) AS rank, evidence FROM (SELECT e.*, row_number() OVER (PARTITION BY e.repo_id ORDER BY place, evidence) AS rank FROM ("
    "SELECT repo_id, pattern, evidence, min(place) AS place FROM ("
    "SELECT repo_id, h // 10 AS p, 'directory:' || dir AS evidence, {'a': CASE dir WHEN '.' THEN '' ELSE dir END, 'b': h % 10, 'c': 0, 'd': ''} AS place FROM dh UNION ALL "
    "SELECT repo_id, h // 10, 'file:' || name, {'a': dir, 'b': h % 10, 'c': 1, 'd': name} FROM fh) u JOIN pat USING (p) GROUP BY repo_id, pattern, evidence) e "
    "JOIN arch USING (repo_id, pattern)) z WHERE rank <= 10", "all")
ORACLES["arch_top5"] = arch(
    "SELECT repo_id, cast(rank AS integer) AS rank, pattern, tenths / 10 AS score, CASE WHEN top > 0 THEN tenths * 100 / top ELSE 0.0 END AS pct_of_max FROM "
    "(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tenths DESC, p) AS rank, max(tenths) OVER (PARTITION BY repo_id) AS top FROM scores) z WHERE rank <= 5", "all")

# --- complexity ------------------------------------------------------------------------------------------------
METRIC_FILES = f"SELECT * FROM f WHERE {kept('P1')} AND ext IN {in_list(rules.METRIC_EXTENSIONS)}"
SPLIT_LINES = "len(string_split(txt, chr(10)))"
ORACLES["code_totals"] = ctes(fx("all"), ("f", PARTS), ("m", METRIC_FILES)) + (
    f"SELECT repo_id, count(*) AS total_files, cast(sum({SPLIT_LINES}) AS bigint) AS total_lines FROM m GROUP BY repo_id")
GENERIC = (
    f"SELECT repo_id, cast(sum(CASE WHEN ext = '.py' THEN 0 ELSE len({found(rules.GENERIC_FUNCTION, 0)}) END) AS bigint) AS functions, "
    f"cast(sum(CASE WHEN ext = '.py' THEN 0 ELSE len({found(rules.GENERIC_CLASS, 0)}) END) AS bigint) AS classes FROM m GROUP BY repo_id")
ORACLES["generic_counts"] = ctes(fx("all"), ("f", PARTS), ("m", METRIC_FILES)) + GENERIC
ORACLES["python_function_metrics"] = ctes(("r", PY_ROWS), ("p", PY_LINES)) + (
    "SELECT repo_id, path, cast(b AS integer) AS seq, 'f' || l_partkey AS fn, cast(line AS integer) AS line, cast(2 * n + 1 AS integer) AS length, cast(2 * n + 1 AS integer) AS complexity FROM p")
# the mapping corpus adds two classes per size in Python: one Django model, one mapped class
COMPLEXITY_CTES = [
    ("f", PARTS), ("m", METRIC_FILES), ("g", GENERIC), ("p", PY_ROWS),
    ("pc", "SELECT repo_id, sum(2) AS classes FROM (SELECT DISTINCT 'repo' || p_size % 20 AS repo_id, p_size FROM part) z GROUP BY repo_id"),
    ("pf", "SELECT repo_id, count(*) AS n, sum(2 * n + 1) AS total, max(2 * n + 1) AS top, min({'a': -(2 * n + 1), 'path': path}).path AS top_path FROM p GROUP BY repo_id"),
    ("cx", f"SELECT t.repo_id, total_files, total_lines, cast(g.functions + coalesce(pf.n, 0) AS bigint) AS total_functions, cast(g.classes + coalesce(pc.classes, 0) AS bigint) AS total_classes, "
           f"coalesce(round_even(pf.total / pf.n, 2), 0) AS avg_function_length, coalesce(round_even(pf.total / pf.n, 2), 0) AS avg_complexity, cast(coalesce(pf.top, 0) AS double) AS max_complexity, pf.top_path AS max_complexity_file "
           f"FROM (SELECT repo_id, count(*) AS total_files, cast(sum({SPLIT_LINES}) AS bigint) AS total_lines FROM m GROUP BY repo_id) t JOIN g USING (repo_id) LEFT JOIN pf USING (repo_id) LEFT JOIN pc USING (repo_id)"),
]
ORACLES["complexity"] = ctes(fx("all"), *COMPLEXITY_CTES) + "SELECT * FROM cx"

# --- database schemas: straight from the parts -----------------------------------------------------------------
PART_ROWS = ("p", "SELECT *, 'repo' || p_size % 20 AS repo_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part")
SIZE_ROWS = ("s", "SELECT p_size, 'repo' || p_size % 20 AS repo_id, count(*) AS n FROM part GROUP BY p_size")


def columns(path: str, finder: str, table: str, *rows: tuple[str, str, str, str, str]) -> str:
    """(source, seq, name, type, key) -> long column rows of one finder."""
    return "\nUNION ALL\n".join(
        f"SELECT repo_id, {path} AS path, '{finder}' AS finder, {table} AS table_name, cast({seq} AS integer) AS seq, {name} AS column_name, {kind} AS column_type, {key} AS primary_key FROM {source}"
        for source, seq, name, kind, key in rows)


COLUMN_SQL = {
    "sql": columns(
        "'db/t' || p_size || '.sql'", "sql", "'t' || p_size", ("s", "0", "'id'", "'INT'", "true"),
        ("p", "n + 1", "replace(p_name, ' ', '_') || '_' || p_partkey", "'VARCHAR(' || p_size || ')'", "false")),
    "laravel": columns(
        "'database/migrations/m' || p_size || '.php'", "laravel", "'l' || p_size",
        ("p", "n", "'c' || p_partkey", "'string'", "false"), ("s", "n", "'id'", "'id'", "true"),
        ("s", "n + 1", "'created_at'", "'timestamps'", "false"), ("s", "n + 2", "'updated_at'", "'timestamps'", "false")),
    "alembic": columns(
        "'alembic/versions/v' || p_size || '.py'", "alembic", "'a' || p_size",
        ("p", "n", "'c' || p_partkey", "'Integer'", "true"), ("s", "n", "'z'", "'Text'", "true")),
    "py_ddl": columns(
        "'raw/r' || p_size || '.py'", "py_ddl", "'r' || p_size", ("p", "n", "'c' || p_partkey", "'VARCHAR(' || p_size || ')'", "false")),
    "django": columns(
        "'app' || p_size || '/models.py'", "django", "'D' || p_size",
        ("p", "n", "'c' || p_partkey", "'CharField'", "false"), ("s", "n", "'pk'", "'AutoField'", "true")),
    "sqlalchemy": columns(
        "'orm/s' || p_size || '.py'", "sqlalchemy", "'Q' || p_size", ("p", "n", "'c' || p_partkey", "'Column'", "false")),
    "typeorm": columns(
        "'ent/e' || p_size || '.entity.ts'", "typeorm", "CASE p_size % 2 WHEN 0 THEN 'D' ELSE 'T' END || p_size",
        ("p", "n", "'c' || p_partkey", "'string'", "false")),
    "prisma": columns(
        "'prisma/p' || p_size || '/schema.prisma'", "prisma", "'P' || p_size", ("p", "n", "'c' || p_partkey", "'String'", "false")),
}
for _name, _sql in COLUMN_SQL.items():
    ORACLES[f"schema_{_name}"] = ctes(PART_ROWS, SIZE_ROWS) + _sql
# the first finder of a name wins: an entity of an even size repeats the Django model
ALL_COLUMNS = "\nUNION ALL\n".join(f"SELECT * FROM ({sql}) z_{n}" for n, sql in COLUMN_SQL.items())
DB_CTES = [PART_ROWS, SIZE_ROWS, ("k", f"SELECT * FROM ({ALL_COLUMNS}) z WHERE NOT (finder = 'typeorm' AND table_name LIKE 'D%')")]
ORACLES["db_columns"] = ctes(*DB_CTES) + "SELECT * FROM k"
ORACLES["database_schema"] = ctes(*DB_CTES) + (
    "SELECT repo_id, table_name, cast(count(*) AS integer) AS n_columns, CASE any_value(finder) WHEN 'sql' THEN 1 ELSE 0 END AS n_foreign_keys FROM k GROUP BY repo_id, table_name")
ORACLES["db_foreign_keys"] = ctes(SIZE_ROWS) + (
    "SELECT repo_id, 'db/t' || p_size || '.sql' AS path, 'sql' AS finder, 't' || p_size AS table_name, 0 AS seq, 'id' AS column_name, 't' || ((p_size % 50) + 1) AS references_table, 'id' AS references_column FROM s")

# --- history ------------------------------------------------------------------------------------------------------
STAMP = "'%Y-%m-%d %H:%M:%S'"
CONTRIBUTORS = (
    f"SELECT repo_id, author AS name, arg_max(email, {{'a': committed_at, 'b': sha}}) AS email, count(*) AS commits, strftime(max(committed_at), {STAMP}) AS last_commit FROM fx GROUP BY repo_id, author")
ORACLES["contributors"] = ctes(fx("commits")) + CONTRIBUTORS
ORACLES["recent_commits"] = ctes(fx("commits")) + (
    f"SELECT repo_id, cast(rank AS integer) AS rank, split_part(message, chr(10), 1) AS message, author, email, strftime(committed_at, {STAMP}) AS date, substring(sha, 1, 8) AS sha FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha) AS rank FROM fx) z WHERE rank <= 20")
ORACLES["repo_git_info"] = ctes(fx("commits")) + (
    f"SELECT repo_id, commits, substring(sha, 1, 8) AS hash, message, author, strftime(committed_at, {STAMP}) AS date FROM "
    f"(SELECT *, count(*) OVER (PARTITION BY repo_id) AS commits, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha DESC) AS rn FROM fx) z WHERE rn = 1")

# --- health ---------------------------------------------------------------------------------------------------------


def any_word(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def unique(*groups: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for group in groups:
        for name, sql in group:
            out.setdefault(name, sql)
    return list(out.items())


WHOLE_CTES = unique(
    [fx("all"), ("commits_", duckdb_sql("commits"))], BASE, FRAMEWORK_CTES,
    [("fw", FRAMEWORKS), ("r", duckdb_sql("dep_rows")), ("d", DEPS)], ARCH_CTES,
    [("mf", METRIC_FILES)], [(n, s.replace("FROM m ", "FROM mf ")) for n, s in COMPLEXITY_CTES if n not in ("f", "m")],
    [("mods", MODULES), ("stats", STATS), ("prof", PROFILE), ("readme_", README)])
WORDS = "lower(path)"
HEALTH_CTES = [
    ("pathf", f"SELECT repo_id, bool_or({any_word(WORDS, rules.SECURITY_WORDS)}) AS sec, count(*) FILTER ({any_word(WORDS, rules.DOC_WORDS)}) AS docs, "
              f"bool_or({any_word(WORDS, rules.TEST_WORDS)}) AS tests, bool_or({any_word(WORDS, rules.PERFORMANCE_WORDS)}) AS perf FROM fx WHERE {kept('P1')} GROUP BY repo_id"),
    ("depf", f"SELECT repo_id, count(*) AS deps, count(*) FILTER ({any_word('lower(name)', rules.OUTDATED_WORDS)}) AS outdated FROM d GROUP BY repo_id"),
    ("fwf", "SELECT repo_id, bool_or(category = 'testing') AS testing FROM fw GROUP BY repo_id"),
    ("i", "SELECT r.repo_id, coalesce(sec, false) AS sec, coalesce(docs, 0) AS docs, coalesce(tests, false) AS tests, coalesce(perf, false) AS perf, coalesce(deps, 0) AS deps, coalesce(outdated, 0) AS outdated, "
          "coalesce(testing, false) AS testing, coalesce(confidence, 0) AS confidence, len(layers) AS layers, coalesce(total_files, 0) AS files, coalesce(total_lines, 0) AS lines, coalesce(total_functions, 0) AS functions, "
          "coalesce(avg_function_length, 0) AS afl, coalesce(avg_complexity, 0) AS acx, coalesce(max_complexity, 0) AS mcx, coalesce(mo.n, 0) AS modules, coalesce(co.n, 0) AS people, coalesce(length(readme), 0) AS chars, "
          "coalesce(contains(lower(readme), 'security'), false) AS named "
          "FROM (SELECT DISTINCT repo_id FROM fx) r LEFT JOIN pathf USING (repo_id) LEFT JOIN depf USING (repo_id) LEFT JOIN fwf USING (repo_id) LEFT JOIN prof USING (repo_id) LEFT JOIN cx USING (repo_id) LEFT JOIN readme_ USING (repo_id) "
          "LEFT JOIN (SELECT repo_id, count(*) AS n FROM mods GROUP BY repo_id) mo USING (repo_id) LEFT JOIN (SELECT repo_id, count(DISTINCT author) AS n FROM commits_ GROUP BY repo_id) co USING (repo_id)"),
    ("h", "SELECT repo_id, least(100, 70 + CASE WHEN deps < 10 THEN 10 ELSE 0 END + CASE WHEN named THEN 10 ELSE 0 END + CASE WHEN sec THEN 10 ELSE 0 END) AS security, "
          "least(100, 70 + CASE WHEN afl < 10 THEN 15 WHEN afl < 20 THEN 10 WHEN afl < 50 THEN 5 ELSE -10 END + CASE WHEN files BETWEEN 10 AND 100 THEN 10 ELSE 0 END) AS maintainability, "
          "cast(least(100, 50 + CASE WHEN chars > 0 THEN 20 ELSE 0 END + CASE WHEN chars > 500 THEN 10 ELSE 0 END + 10 * least(docs, 3)) AS integer) AS documentation, "
          "50 + CASE WHEN tests THEN 20 ELSE 0 END + CASE WHEN testing THEN 20 ELSE 0 END AS testing, "
          "60 + CASE WHEN confidence > 50 THEN 20 ELSE 0 END + CASE WHEN modules > 0 THEN 10 ELSE 0 END + CASE WHEN layers >= 3 THEN 10 ELSE 0 END AS architecture, "
          "75 + CASE WHEN perf THEN 5 ELSE 0 END - CASE WHEN mcx > 30 THEN 10 ELSE 0 END AS performance, "
          "70 + CASE WHEN files = 0 THEN 0 WHEN functions / files > 2 AND functions / files < 10 THEN 10 WHEN functions / files > 20 THEN -10 ELSE 0 END + CASE WHEN acx < 3 THEN 10 WHEN acx > 10 THEN -10 ELSE 0 END AS quality, "
          "80 + CASE WHEN files = 0 OR lines / files < 100 THEN 10 WHEN lines / files > 500 THEN -15 WHEN lines / files > 300 THEN -5 ELSE 0 END - CASE WHEN mcx > 50 THEN 10 ELSE 0 END AS complexity, "
          "cast(CASE WHEN deps = 0 THEN 100 ELSE greatest(0, 70 - 5 * outdated) END AS integer) AS dependency, "
          "60 + CASE WHEN people > 5 THEN 15 WHEN people > 1 THEN 10 ELSE 0 END + CASE WHEN people > 10 THEN 10 ELSE 0 END AS activity FROM i"),
    ("health", "SELECT *, cast(round_even((" + " + ".join(f"{m} * {w}" for m, w in rules.HEALTH_WEIGHTS.items()) + ") / 100, 1) AS double) AS overall FROM h"),
]


def whole(sql: str, *more: tuple[str, str]) -> str:
    return ctes(*unique(WHOLE_CTES, HEALTH_CTES, list(more))) + sql


ORACLES["health"] = whole("SELECT * FROM health")
ORACLES["health_breakdown"] = whole("\nUNION ALL\n".join(
    f"SELECT repo_id, '{m}' AS metric, {m} AS score, 100 AS max, {w} AS weight FROM health" for m, w in rules.HEALTH_WEIGHTS.items()))
ORACLES["health_label"] = whole(
    "SELECT repo_id, overall, CASE WHEN overall >= 80 THEN 'Excellent' WHEN overall >= 60 THEN 'Good' WHEN overall >= 40 THEN 'Fair' ELSE 'Needs Work' END AS label FROM health")
ORACLES["recommendations"] = whole(
    "SELECT repo_id, cast(row_number() OVER (PARTITION BY repo_id ORDER BY n) - 1 AS integer) AS seq, message FROM ("
    + " UNION ALL ".join(f"SELECT repo_id, {n} AS n, {q(msg)} AS message FROM health WHERE {m} < {t}" for n, (m, t, msg) in enumerate(rules.RECOMMENDATIONS))
    + ") z")

# --- questions --------------------------------------------------------------------------------------------------------
STOP = in_list(rules.STOP_WORDS)
KEYWORDS = (
    f"SELECT DISTINCT q_id, repo_id, kw FROM (SELECT q_id, repo_id, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS kw FROM qs) z WHERE kw NOT IN {STOP}")
RETRIEVAL_CTES = [
    ("qs", duckdb_sql("questions")), fx("files"), *BASE, ("m", MODULES), ("kw", KEYWORDS),
    ("pv", f"SELECT repo_id, path, name, substring(txt, 1, 3000) AS preview FROM f WHERE {kept('P1')} AND ext IN {in_list(rules.PREVIEW_EXTENSIONS)}"),
    ("r2", "SELECT q_id, repo_id, path, count(*) AS score FROM kw JOIN pv USING (repo_id) WHERE contains(lower(preview), kw) GROUP BY q_id, repo_id, path"),
    ("r3", "SELECT q_id, repo_id, path, 2 * count(*) AS score FROM kw JOIN m USING (repo_id) WHERE contains(lower(name || ' ' || array_to_string(classes, ' ') || ' ' || array_to_string(functions, ' ')), kw) "
           "AND (q_id, path) NOT IN (SELECT (q_id, path) FROM r2) GROUP BY q_id, repo_id, path"),
    ("r4", "SELECT q_id, repo_id, cast(rank AS integer) AS rank, path, score, substring(preview, 1, 500) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, branch, path) AS rank "
           "FROM (SELECT *, 0 AS branch FROM r2 UNION ALL SELECT *, 1 FROM r3) u) z LEFT JOIN pv USING (repo_id, path) WHERE rank <= 4"),
]


def asked(sql: str) -> str:
    return ctes(*RETRIEVAL_CTES) + sql


ORACLES["question_keywords"] = ctes(("qs", duckdb_sql("questions"))) + KEYWORDS
ORACLES["score_content"] = asked("SELECT * FROM r2")
ORACLES["score_modules"] = asked("SELECT q_id, repo_id, path, score FROM r3")
_HITS = (
    "SELECT repo_id, path, kw, max(c) AS c, max(m) AS m FROM ("
    "SELECT repo_id, path, kw, 1 AS c, 0 AS m FROM vocabulary JOIN pv USING (repo_id) WHERE contains(lower(preview), kw) UNION ALL "
    "SELECT repo_id, path, kw, 0, 1 FROM vocabulary JOIN m USING (repo_id) "
    "WHERE contains(lower(name || ' ' || array_to_string(classes, ' ') || ' ' || array_to_string(functions, ' ')), kw)) z GROUP BY repo_id, path, kw")
_CLASSES = ctes(*RETRIEVAL_CTES, ("vocabulary", "SELECT DISTINCT repo_id, kw FROM kw"), ("hits", _HITS), (
    "placed", "SELECT repo_id, path, min(path) OVER (PARTITION BY repo_id, held) AS class FROM ("
              "SELECT repo_id, path, string_agg(kw || ':' || c || m, ' ' ORDER BY kw) AS held FROM hits GROUP BY repo_id, path) z"))
ORACLES["file_classes"] = _CLASSES + "SELECT repo_id, class, path FROM placed"
ORACLES["class_keywords"] = _CLASSES + (
    "SELECT DISTINCT repo_id, class, kw, cast(c AS integer) AS c, cast(m AS integer) AS m FROM placed JOIN hits USING (repo_id, path)")
ORACLES["expanded_scores"] = asked(
    "SELECT q_id, repo_id, path, score, branch FROM (SELECT *, 0 AS branch FROM r2 UNION ALL SELECT *, 1 FROM r3) u WHERE q_id % 100 = 0")
ORACLES["relevant_files"] = asked("SELECT * FROM r4")
ORACLES["relevant_context"] = asked(
    "SELECT q_id, repo_id, string_agg('--- ' || path || ' ---' || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS context FROM r4 GROUP BY q_id, repo_id")
ORACLES["scan_tree"] = ctes(("p", duckdb_sql("pages"))) + (
    "SELECT repo_id, path, length(content) AS chars, md5(content) AS digest FROM p")
ORACLES["history_window"] = (
    "SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) z WHERE back <= 10")
ORACLES["source_attribution"] = ctes(("a", duckdb_sql("answers")), fx("files"), ("f", PARTS), ("pv", dict(RETRIEVAL_CTES)["pv"])) + (
    "SELECT answer_id, repo_id, path, cast(rank AS integer) AS rank FROM (SELECT answer_id, a.repo_id, path, row_number() OVER (PARTITION BY answer_id ORDER BY path) AS rank "
    "FROM a JOIN pv ON a.repo_id = pv.repo_id AND (contains(text, path) OR contains(text, name))) z WHERE rank <= 10")
_PROMPT = [
    ("mrank", "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn, count(*) OVER (PARTITION BY repo_id) AS total FROM mods"),
    ("drank", "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, source_file, seq) AS rn FROM d"),
    ("p2", PART_ROWS[1]), ("s2", SIZE_ROWS[1]),
    ("k", f"SELECT * FROM ({ALL_COLUMNS.replace('FROM p', 'FROM p2').replace('FROM s', 'FROM s2')}) z WHERE NOT (finder = 'typeorm' AND table_name LIKE 'D%')"),
    ("tab", "SELECT repo_id, table_name, '  ' || table_name || ': ' || string_agg(column_name || ' ' || column_type, ', ' ORDER BY seq) FILTER (seq < 4) AS line FROM k GROUP BY repo_id, table_name"),
    ("pl", "SELECT repo_id, 1 AS section, '' AS item, 'You are a code analysis assistant for the repository ''' || repo_id || '''.' AS line FROM (SELECT DISTINCT repo_id FROM fx) r UNION ALL "
           "SELECT repo_id, 3, '', chr(10) || 'README:' || chr(10) || substring(readme, 1, 500) FROM readme_ WHERE readme <> '' UNION ALL "
           "SELECT repo_id, 4, '', chr(10) || 'Architecture: ' || pattern || ' (' || confidence || '%)' FROM prof UNION ALL "
           "SELECT repo_id, 5, '', 'Layers: ' || array_to_string(layers, ', ') FROM prof UNION ALL "
           "SELECT DISTINCT repo_id, 6, '', chr(10) || 'Modules (' || total || '):' FROM mrank UNION ALL "
           "SELECT repo_id, 7, path, '  ' || path || ': [' || array_to_string(classes[:3], ', ') || '] [' || array_to_string(functions[:3], ', ') || ']' FROM mrank WHERE rn <= 10 UNION ALL "
           "SELECT repo_id, 8, '', chr(10) || 'Database tables (' || count(*) || '):' FROM tab GROUP BY repo_id UNION ALL "
           "SELECT repo_id, 9, table_name, line FROM tab UNION ALL "
           "SELECT repo_id, 10, '', chr(10) || 'Dependencies: ' || string_agg(name, ', ' ORDER BY rn) FROM drank WHERE rn <= 10 GROUP BY repo_id UNION ALL "
           f"SELECT repo_id, 11, '', {q(rules.PROMPT_CLOSING)} FROM (SELECT DISTINCT repo_id FROM fx) r"),
]
ORACLES["prompt_context"] = whole(
    "SELECT repo_id, section, item, line FROM pl", *_PROMPT)

# --- diagrams -----------------------------------------------------------------------------------------------------------
NODES = [
    ("pre", f"SELECT DISTINCT repo_id, parts[:n] AS node, n < len(parts) AS is_dir FROM (SELECT repo_id, string_split(path, '/') AS parts, unnest(range(1, least(5, len(string_split(path, '/'))) + 1)) AS n FROM fx WHERE {kept('P1')}) z"),
    ("node", "SELECT repo_id, node, bool_or(is_dir) AS is_dir, row_number() OVER (PARTITION BY repo_id ORDER BY node) - 1 AS node_no FROM pre GROUP BY repo_id, node"),
    ("nodes", "SELECT n.repo_id, cast(n.node_no AS integer) AS node_no, cast(p.node_no AS integer) AS parent_no, n.node[-1] AS name, cast(len(n.node) - 1 AS integer) AS depth, n.is_dir FROM node n "
              "LEFT JOIN node p ON p.repo_id = n.repo_id AND p.node = n.node[:-2] AND len(n.node) > 1 WHERE n.node_no < 60"),
]
ORACLES["directory_nodes"] = ctes(fx("files"), *NODES) + "SELECT * FROM nodes"
ORACLES["directory_diagram"] = ctes(fx("files"), *NODES) + (
    "SELECT repo_id, 'flowchart TD' || chr(10) || string_agg('    N' || node_no || '[<b>' || name || '</b>' || CASE WHEN is_dir THEN '/' ELSE '' END || ']' || "
    "CASE WHEN parent_no IS NULL THEN '' ELSE chr(10) || '    N' || parent_no || ' --> N' || node_no END, chr(10) ORDER BY node_no) AS text FROM nodes GROUP BY repo_id")
ID = "replace(translate({c}, '.-/[]() ', '________'), '+', '_plus_')"
LABEL = "translate({c}, '[](){{}}<>', '')"
ORACLES["sanitize"] = ctes(fx("all")) + (
    f"SELECT repo_id, path, {ID.format(c='path')} AS node_id, {LABEL.format(c=chr(39) + '<' + chr(39) + ' || path || ' + chr(39) + '>[+]' + chr(39))} AS label FROM fx")
LAYER_ID = "replace(replace(replace(replace({c}, ' ', '_'), '(', ''), ')', ''), '-', '_')"
RANKED_STATS = ("ls", "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, language) AS rn FROM stats")
DEP_DIAGRAM_CTES = [
    ("n", "SELECT repo_id, source, count(*) AS n FROM d GROUP BY repo_id, source"), ("rp", "SELECT repo_id FROM n UNION SELECT repo_id FROM stats")]
ORACLES["dependency_diagram"] = ctes(fx("all"), *BASE, ("stats", STATS), RANKED_STATS, *DEP_CTES, *DEP_DIAGRAM_CTES) + (
    "SELECT repo_id, 1 AS section, '' AS source, 1 AS part, '' AS name, 'graph LR' AS line FROM rp UNION ALL "
    "SELECT repo_id, 1, '', 2, '', '    subgraph Project[Project Dependencies]' FROM rp UNION ALL "
    "SELECT repo_id, 2, source, 1, '', '        subgraph ' || source || '[' || upper(source) || ' - ' || n || ' deps]' FROM n UNION ALL "
    f"SELECT repo_id, 2, source, 2, name, '            ' || {ID.format(c='name')} || '[<b>' || {LABEL.format(c='name')} || '</b>]' FROM d UNION ALL "
    "SELECT repo_id, 2, source, 3, '', '        end' FROM n UNION ALL SELECT repo_id, 3, '', 1, '', '    end' FROM rp UNION ALL "
    "SELECT DISTINCT repo_id, 4, '', 1, '', '    subgraph Lang[Languages]' FROM ls UNION ALL "
    "SELECT repo_id, 4, '', 2, cast(rn AS varchar), '        ' || replace(language, ' ', '_') || '[<b>' || language || '</b>]' FROM ls WHERE rn <= 3 UNION ALL "
    "SELECT DISTINCT repo_id, 4, '', 3, '', '    end' FROM ls")
DIAGRAM_CTES = [*ARCH_CTES, ("c", CLASSIFIED), ("stats", STATS), RANKED_STATS, ("prof", PROFILE)]


def drawn(sql: str) -> str:
    return ctes(fx("files"), *DIAGRAM_CTES) + sql


_BOX = LAYER_ID.format(c="l")
ORACLES["architecture_diagram"] = drawn(
    "SELECT repo_id, 'graph TD' || chr(10) || '    subgraph ' || replace(pattern, ' ', '_') || '[' || pattern || ' Architecture]' || chr(10) || "
    f"array_to_string(list_transform(layers, lambda l, i: '        ' || {_BOX} || '[<b>' || l || '</b>]' || CASE WHEN i > 1 THEN chr(10) || '        ' || {LAYER_ID.format(c='layers[i - 1]')} || ' -->|communicates| ' || {_BOX} ELSE '' END), chr(10)) "
    f"|| chr(10) || '    end' || CASE WHEN lang IS NULL THEN '' ELSE chr(10) || '    subgraph Languages[Languages]' || chr(10) || lang || chr(10) || '    end' || chr(10) || '    ' || {LAYER_ID.format(c='layers[1]')} || ' -->|built with| ' || first END AS text "
    "FROM prof LEFT JOIN (SELECT repo_id, string_agg('        ' || replace(language, ' ', '_') || '[<b>' || language || '</b>: ' || percentage || '%]', chr(10) ORDER BY rn) FILTER (rn <= 5) AS lang, "
    "min(replace(language, ' ', '_')) FILTER (rn = 1) AS first FROM ls GROUP BY repo_id) x USING (repo_id)")
ORACLES["layer_diagram"] = drawn(
    "SELECT repo_id, 'flowchart LR' || chr(10) || array_to_string(list_transform(layers, lambda l, i: '    L' || (i - 1) || '[<b>' || l || '</b>]' || CASE WHEN i > 1 THEN chr(10) || '    L' || (i - 2) || ' --> L' || (i - 1) ELSE '' END), chr(10)) AS text FROM prof")
ORACLES["sequence_diagram"] = drawn(
    "SELECT repo_id, array_to_string(list_concat(list_concat(['sequenceDiagram', '    participant Client as Client', '    participant Server as Server'], "
    f"list_transform(layers[2:-2], lambda l: '    participant ' || {_BOX} || ' as ' || l)), list_concat(['    participant DB as Database', '', '    Client->>Server: HTTP Request', '    Server->>Server: Process (' || pattern || ')'], "
    f"list_concat(list_transform(layers[2:-2], lambda l: '    Server->>' || {_BOX} || ': Delegate' || chr(10) || '    ' || {_BOX} || '-->>Server: Response'), "
    "['    Server->>DB: Query', '    DB-->>Server: Result', '    Server-->>Client: HTTP Response']))), chr(10)) AS text FROM prof")

# --- results ------------------------------------------------------------------------------------------------------------
_COUNTS = (
    "(SELECT repo_id, count(*) AS n FROM stats GROUP BY repo_id) la USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM fw GROUP BY repo_id) fr USING (repo_id) "
    "LEFT JOIN (SELECT repo_id, count(*) AS n FROM d GROUP BY repo_id) de USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM mods GROUP BY repo_id) mo USING (repo_id) "
    "LEFT JOIN (SELECT repo_id, count(DISTINCT author) AS n FROM commits_ GROUP BY repo_id) co USING (repo_id)")
ORACLES["summary"] = whole(
    "SELECT r.repo_id, cast(la.n AS integer) AS languages, cast(fr.n AS integer) AS frameworks, pattern, confidence, total_lines, overall AS health_score, "
    "coalesce(de.n, 0) AS dependencies_count, coalesce(mo.n, 0) AS modules_count, coalesce(co.n, 0) AS contributors_count FROM (SELECT DISTINCT repo_id FROM fx) r "
    f"LEFT JOIN {_COUNTS} LEFT JOIN prof USING (repo_id) LEFT JOIN cx USING (repo_id) LEFT JOIN health USING (repo_id)")
ORACLES["repo_counts"] = whole(
    "SELECT r.repo_id, coalesce(co.n, 0) AS contributors, coalesce(la.n, 0) AS languages, coalesce(de.n, 0) AS dependencies, coalesce(mo.n, 0) AS modules FROM (SELECT DISTINCT repo_id FROM fx) r "
    f"LEFT JOIN {_COUNTS}")
_K = [c for c in _PROMPT if c[0] in ("p2", "s2", "k", "tab")]
ORACLES["export_report"] = whole(
    "SELECT repo_id, 'report' AS section, cast(1 AS bigint) AS items, overall AS health_score, least(coalesce(co.n, 0), 20) AS commit_count, coalesce(t.n, 0) AS database_tables, cast(NULL AS varchar) AS first_name FROM health "
    "LEFT JOIN (SELECT repo_id, count(*) AS n FROM commits_ GROUP BY repo_id) co USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM tab GROUP BY repo_id) t USING (repo_id) UNION ALL "
    "SELECT repo_id, 'dependencies', count(*), NULL, NULL, NULL, min(name) FROM d GROUP BY repo_id UNION ALL "
    "SELECT repo_id, 'modules', count(*), NULL, NULL, NULL, min(name) FROM mods GROUP BY repo_id UNION ALL "
    "SELECT repo_id, 'contributors', count(DISTINCT author), NULL, NULL, NULL, min(author) FROM commits_ GROUP BY repo_id", *_K)
ORACLES["export_documents"] = whole(
    "SELECT r.repo_id, cast(la.n AS integer) AS languages, cast(fr.n AS integer) AS frameworks, cast(coalesce(de.n, 0) AS integer) AS dependencies, cast(coalesce(mo.n, 0) AS integer) AS modules, "
    "cast(coalesce(co.n, 0) AS integer) AS contributors, pattern FROM (SELECT DISTINCT repo_id FROM fx) r "
    f"LEFT JOIN {_COUNTS} LEFT JOIN prof USING (repo_id)")
ORACLES["scan_corpus"] = ctes(fx("all"), ("f", PARTS)) + "SELECT repo_id, path, ext, md5(content) AS digest FROM f"
ORACLES["results_store"] = ctes(fx("commits")) + (
    "SELECT repo_id, author AS name, count(*) * CASE WHEN repo_id IN ('repo1', 'repo2') THEN 2 ELSE 1 END AS commits FROM fx WHERE repo_id <> 'repo3' GROUP BY repo_id, author")
ORACLES["result_of_one"] = ctes(fx("commits")) + (
    "SELECT repo_id, author AS name, count(*) AS commits FROM fx WHERE repo_id = 'repo1' GROUP BY repo_id, author")
_WHOLE_TEXT = "1 AS section, '' AS source, 1 AS part, '' AS name"
ORACLES["diagram_text"] = ctes(*unique(
    [fx("all")], ARCH_CTES, [("prof", PROFILE)], NODES, BASE, [("stats", STATS), RANKED_STATS], DEP_CTES, DEP_DIAGRAM_CTES)) + " UNION ALL ".join([
        *(f"SELECT repo_id, '{k}' AS type, text, {_WHOLE_TEXT} FROM (" + ORACLES[f"{k}_diagram"].split("\n)\n")[-1] + f") z_{k}"
          for k in ("architecture", "sequence", "directory", "layer")),
        "SELECT repo_id, 'dependency', line, section, source, part, name FROM (" + ORACLES["dependency_diagram"].split("\n)\n")[-1] + ") z_dependency"])
_TERM = "contains(lower({c}), 'r1')"
# the generated sources of the whole corpus hold these functions; prose has none
_CALLS = [
    ("cr", CODE_ROWS), ("pr", PY_ROWS), LANG_ROWS, WEB_ROWS,
    ("fns", "SELECT repo_id, path || '::f' || l_partkey AS fn FROM cr UNION SELECT repo_id, path || '::f' || l_partkey FROM pr UNION "
            "SELECT repo_id, path || '::' || fn FROM (" + LANG_FUNCTIONS + ") z1 UNION SELECT repo_id, path || '::' || fn FROM (" + WEB_FUNCTIONS + ") z2"),
    ("recent", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha) AS rk FROM commits_) z WHERE rk <= 20"),
]
ORACLES["search_entities"] = whole(
    f"SELECT repo_id, 'language' AS entity, language AS key FROM stats WHERE {_TERM.format(c='language')} UNION ALL "
    f"SELECT repo_id, 'framework', framework FROM fw WHERE {_TERM.format(c='framework')} UNION ALL "
    f"SELECT repo_id, 'dependency', name FROM d WHERE {_TERM.format(c='name')} UNION ALL "
    f"SELECT repo_id, 'function', fn FROM fns WHERE {_TERM.format(c='fn')} UNION ALL "
    f"SELECT DISTINCT repo_id, 'contributor', author FROM commits_ WHERE {_TERM.format(c='author')} UNION ALL "
    f"SELECT repo_id, 'commit', split_part(message, chr(10), 1) FROM recent WHERE {_TERM.format(c='split_part(message, chr(10), 1)')} OR {_TERM.format(c='author')}", *_CALLS)
