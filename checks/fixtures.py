"""Corpora derived from the given tables, as SQL that Spark and DuckDB both run.

The tables hold no source code, so each corpus writes files from table rows.  The two dialects
differ only in ordered string aggregation (``{agg:expr|separator|order}`` below).  Every corpus
shares the repositories ``repo0`` .. ``repo19``, and paths are unique across all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LINE_KEY = """concat(lpad(cast(l_linenumber AS string), 2, '0'), '/', lpad(cast(l_partkey AS string), 9, '0'), '/',
      lpad(cast(l_suppkey AS string), 9, '0'), '/', lpad(cast(cast(l_quantity AS int) AS string), 3, '0'))"""

FX_FILES = """
SELECT replace(source, 'src', 'repo') AS repo_id,
  CASE WHEN doc_id < 20 THEN 'README.md' ELSE concat(
    CASE cast(floor(doc_id / 20) AS bigint) % 12
      WHEN 0 THEN 'src/controllers' WHEN 1 THEN 'src/models' WHEN 2 THEN 'src/views' WHEN 3 THEN 'routes'
      WHEN 4 THEN 'docs/guide' WHEN 5 THEN 'tests' WHEN 6 THEN 'infrastructure/cache' WHEN 7 THEN 'domain/entities'
      WHEN 8 THEN 'frontend' WHEN 9 THEN 'backend/auth' WHEN 10 THEN '.hidden' ELSE 'web/node_modules/x' END,
    '/file_', cast(doc_id AS string),
    CASE doc_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.go'
      WHEN 5 THEN '.RS' WHEN 6 THEN '.sql' WHEN 7 THEN '.yaml' WHEN 8 THEN '.txt' WHEN 9 THEN '.json' ELSE '' END) END AS path,
  text AS content
FROM documents
"""

FX_COMMITS = """
SELECT concat('repo', cast(o_orderkey % 20 AS string)) AS repo_id, md5(cast(o_orderkey AS string)) AS sha,
  concat('author', cast(o_custkey % 37 AS string)) AS author, concat('a', cast(o_custkey AS string), '@example.com') AS email,
  o_orderdate AS committed_at, concat(o_orderpriority, chr(10), o_orderstatus) AS message
FROM orders
"""

FX_DEP_ROWS = """
SELECT concat('repo', cast(l_orderkey % 20 AS string)) AS repo_id, l_orderkey AS file_no, l_orderkey % 7 AS kind,
  concat(replace(p_name, ' ', '-'), '-', cast(l_partkey AS string)) AS name,
  concat(cast(cast(max(l_quantity) AS int) AS string), '.', cast(max(l_linenumber) AS string)) AS version
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_name
"""

FX_MANIFESTS = f"""
SELECT repo_id, concat('pkg', cast(file_no AS string), '/', CASE kind WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt'
    WHEN 2 THEN 'Cargo.toml' WHEN 3 THEN 'go.mod' WHEN 4 THEN 'Gemfile' WHEN 5 THEN 'pubspec.yaml' ELSE 'pom.xml' END) AS path,
  concat(
    CASE kind WHEN 0 THEN '{{"dependencies": {{' WHEN 2 THEN concat('[package]', chr(10), '[dependencies]', chr(10))
      WHEN 5 THEN concat('dependencies:', chr(10)) ELSE '' END,
    <<agg line | chr(10) | name>>,
    CASE kind WHEN 0 THEN '}}}}' ELSE '' END) AS content
FROM (
  SELECT repo_id, file_no, kind, name, CASE kind
      WHEN 0 THEN concat(CASE WHEN row_number() OVER (PARTITION BY file_no ORDER BY name) = 1 THEN '' ELSE ', ' END, '"', name, '": "^', version, '"')
      WHEN 1 THEN concat(name, '==', version)
      WHEN 2 THEN concat(name, ' = "', version, '"')
      WHEN 3 THEN concat('require ', name, ' v', version)
      WHEN 4 THEN concat('gem "', name, '"')
      WHEN 5 THEN concat('  ', name, ': ', version)
      ELSE concat('<dependency><groupId>g</groupId><artifactId>', name, '</artifactId><version>', version, '</version></dependency>') END AS line
  FROM ({FX_DEP_ROWS}) rows_) d
GROUP BY repo_id, file_no, kind
"""

FX_CODE = f"""
SELECT concat('repo', cast(l_orderkey % 20 AS string)) AS repo_id,
  concat('src/m', cast(l_orderkey AS string), CASE l_orderkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '.php' END) AS path,
  <<agg body | chr(10) | k>> AS content
FROM (
  SELECT l_orderkey, {LINE_KEY} AS k,
    concat('import {{ a }} from "lib', cast(l_suppkey AS string), '"', chr(10), 'function f', cast(l_partkey AS string), '(x) {{', chr(10),
      '  g', cast(l_suppkey AS string), '(x); if (x) {{ h', cast(l_linenumber AS string), '(x) }}', chr(10), '}}') AS body
  FROM lineitem) l
GROUP BY l_orderkey
"""

FX_PY = f"""
SELECT concat('repo', cast(l_orderkey % 20 AS string)) AS repo_id, concat('app/p', cast(l_orderkey AS string), '.py') AS path,
  <<agg body | '' | k>> AS content
FROM (
  SELECT l_orderkey, {LINE_KEY} AS k,
    concat('def f', cast(l_partkey AS string), '(x):', chr(10),
      repeat(concat('    if x and y:', chr(10), '        g(x)', chr(10)), cast(l_quantity AS int) % 4), '    return x', chr(10)) AS body
  FROM lineitem) l
GROUP BY l_orderkey
"""

FX_SCHEMA = """
SELECT concat('repo', cast(p_size % 20 AS string)) AS repo_id, concat('db/t', cast(p_size AS string), '.sql') AS path,
  concat('CREATE TABLE t', cast(p_size AS string), ' (', chr(10), '  id INT,', chr(10),
    <<agg col | '' | p_partkey>>,
    '  PRIMARY KEY (id),', chr(10), '  FOREIGN KEY (id) REFERENCES t', cast((p_size % 50) + 1 AS string), ' (id)', chr(10), ');', chr(10)) AS content
FROM (
  SELECT p_size, p_partkey, concat('  ', replace(p_name, ' ', '_'), '_', cast(p_partkey AS string), ' VARCHAR(', cast(p_size AS string), '),', chr(10)) AS col
  FROM part) p
GROUP BY p_size
"""

# One file per customer in Java, Go, Rust or C#, one web-style class per supplier.
FX_LANG = """
SELECT concat('repo', cast(c_custkey % 20 AS string)) AS repo_id,
  concat('lang/c', cast(c_custkey AS string), CASE c_custkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '.cs' END) AS path,
  CASE c_custkey % 4
    WHEN 0 THEN concat('import com.n', cast(c_nationkey AS string), '.C', cast(c_custkey AS string), ';', chr(10), 'import static a.B;', chr(10),
      'public class C', cast(c_custkey AS string), ' extends Base', cast(c_nationkey AS string), ' implements Runnable, I', cast(c_custkey AS string), ' {', chr(10),
      '  public void run', cast(c_custkey AS string), '() {', chr(10), '    go', cast(c_nationkey AS string), '(1);', chr(10), '  }', chr(10), '}', chr(10),
      'class D', cast(c_custkey AS string), ' {}', chr(10))
    WHEN 1 THEN concat('package main', chr(10), 'import (', chr(10), '  "fmt"', chr(10), '  "lib/n', cast(c_nationkey AS string), '"', chr(10), ')', chr(10), 'import "os"', chr(10),
      'func F', cast(c_custkey AS string), '() {', chr(10), '  g', cast(c_nationkey AS string), '(1)', chr(10), '}', chr(10),
      'func (r *R) M', cast(c_custkey AS string), '() {}', chr(10), 'type S', cast(c_custkey AS string), ' struct {', chr(10), '}', chr(10))
    WHEN 2 THEN concat('use std::n', cast(c_nationkey AS string), ';', chr(10), 'extern crate c', cast(c_custkey AS string), ';', chr(10),
      'fn f', cast(c_custkey AS string), '() {', chr(10), '  g', cast(c_nationkey AS string), '(1);', chr(10), '}', chr(10),
      'struct S', cast(c_custkey AS string), ';', chr(10), 'impl S', cast(c_custkey AS string), ' {', chr(10), '}', chr(10))
    ELSE concat('using System.N', cast(c_nationkey AS string), ';', chr(10), 'class C', cast(c_custkey AS string), ' {', chr(10), '}', chr(10)) END AS content
FROM customer
"""

FX_WEB = """
SELECT concat('repo', cast(s_suppkey % 20 AS string)) AS repo_id,
  concat('web/s', cast(s_suppkey AS string), CASE s_suppkey % 2 WHEN 0 THEN '.jsx' ELSE '.php' END) AS path,
  CASE s_suppkey % 2
    WHEN 0 THEN concat('import "style', cast(s_nationkey AS string), '"', chr(10), 'import R from "react"', chr(10), 'const q = require("q', cast(s_suppkey AS string), '")', chr(10),
      'export class S', cast(s_suppkey AS string), ' extends Base', cast(s_nationkey AS string), ' {', chr(10), '  render', cast(s_suppkey AS string), '() {', chr(10), '  }', chr(10), '}', chr(10),
      'export default function f', cast(s_suppkey AS string), '(x) {', chr(10), '  while (x) {', chr(10), '  }', chr(10), '}', chr(10),
      'arrow', cast(s_suppkey AS string), ' = async (a) => a', chr(10), 'export { q }', chr(10), 'module.exports = q', cast(s_nationkey AS string), chr(10))
    ELSE concat('<?php', chr(10), 'use App', chr(92), 'N', cast(s_nationkey AS string), ';', chr(10), 'require inc/s', cast(s_suppkey AS string), ';', chr(10),
      'class P', cast(s_suppkey AS string), ' {', chr(10), '  function m', cast(s_suppkey AS string), '($a) {', chr(10), '    run', cast(s_nationkey AS string), '($a);', chr(10), '  }', chr(10), '}', chr(10)) END AS content
FROM supplier
"""

# One table per p_size in each of six mapping styles and one CREATE TABLE inside Python; the parts
# of that size are its columns.  The TypeORM entity of an even size repeats the Django name.
_SIZE = "cast(p_size AS string)"
_KEY = "cast(p_partkey AS string)"
_STYLES = " UNION ALL ".join(f"SELECT p_size, p_partkey, {style} AS style FROM part" for style in range(7))
FX_ORM = f"""
SELECT concat('repo', cast(p_size % 20 AS string)) AS repo_id,
  CASE style WHEN 0 THEN concat('database/migrations/m', {_SIZE}, '.php') WHEN 1 THEN concat('alembic/versions/v', {_SIZE}, '.py')
    WHEN 2 THEN concat('raw/r', {_SIZE}, '.py') WHEN 3 THEN concat('app', {_SIZE}, '/models.py') WHEN 4 THEN concat('orm/s', {_SIZE}, '.py')
    WHEN 5 THEN concat('ent/e', {_SIZE}, '.entity.ts') ELSE concat('prisma/p', {_SIZE}, '/schema.prisma') END AS path,
  concat(
    CASE style WHEN 0 THEN concat('<?php', chr(10), 'Schema::create(''l', {_SIZE}, ''', function (Blueprint $table) {{', chr(10), '  $table->id();', chr(10))
      WHEN 1 THEN concat('op.create_table(''a', {_SIZE}, ''',', chr(10))
      WHEN 2 THEN concat('DDL = "CREATE TABLE IF NOT EXISTS r', {_SIZE}, ' (', chr(10))
      WHEN 3 THEN concat('from django.db import models', chr(10), chr(10), 'class D', {_SIZE}, '(models.Model):', chr(10))
      WHEN 4 THEN concat('Base = declarative_base()', chr(10), chr(10), 'class Q', {_SIZE}, '(Base):', chr(10))
      WHEN 5 THEN concat('@Entity()', chr(10), 'class ', CASE p_size % 2 WHEN 0 THEN 'D' ELSE 'T' END, {_SIZE}, ' {{', chr(10))
      ELSE concat('model P', {_SIZE}, ' {{', chr(10)) END,
    <<agg col | chr(10) | p_partkey>>,
    CASE style WHEN 0 THEN concat(chr(10), '  $table->timestamps();', chr(10), '}});', chr(10))
      WHEN 1 THEN concat(chr(10), '  sa.Column(''z'', sa.Text)', chr(10), ')', chr(10))
      WHEN 2 THEN concat(chr(10), ');"', chr(10))
      WHEN 3 THEN concat(chr(10), '    pk = models.AutoField()', chr(10))
      WHEN 4 THEN chr(10)
      ELSE concat(chr(10), '}}', chr(10)) END) AS content
FROM (
  SELECT p_size, p_partkey, style, CASE style
      WHEN 0 THEN concat('  $table->string(''c', {_KEY}, ''');')
      WHEN 1 THEN concat('  sa.Column(''c', {_KEY}, ''', sa.Integer, primary_key=True),')
      WHEN 2 THEN concat('  c', {_KEY}, ' VARCHAR(', {_SIZE}, '),')
      WHEN 3 THEN concat('    c', {_KEY}, ' = models.CharField(max_length=9)')
      WHEN 4 THEN concat('    c', {_KEY}, ' = Column(Integer)')
      WHEN 5 THEN concat('  c', {_KEY}, ': string;')
      ELSE concat('  c', {_KEY}, ' String') END AS col
  FROM ({_STYLES}) s) p
GROUP BY p_size, style
"""

# Manifests that name frameworks: one root or nested manifest per supplier.
FX_STACK = """
SELECT concat('repo', cast(s_suppkey % 20 AS string)) AS repo_id,
  CASE s_suppkey % 5 WHEN 0 THEN concat('stack', cast(s_suppkey AS string), '/package.json') WHEN 1 THEN concat('stack', cast(s_suppkey AS string), '/requirements.txt')
    WHEN 2 THEN concat(own, 'Dockerfile') WHEN 3 THEN concat(own, 'config/routes.rb') ELSE concat('stack', cast(s_suppkey AS string), '/urls.py') END AS path,
  CASE s_suppkey % 5
    WHEN 0 THEN concat('{"dependencies": {"preact": "^', cast(s_nationkey AS string), '.0", "express": "~4.', cast(s_nationkey AS string), '"}, "devDependencies": {"jest": ">=', cast(s_suppkey AS string), '"}}')
    WHEN 1 THEN concat('# pins', chr(10), 'Django==', cast(s_nationkey AS string), '.', cast(s_suppkey AS string), chr(10), 'flask>=1', chr(10), 'beta-lib', chr(10))
    ELSE 'x' END AS content
FROM (SELECT s_suppkey, s_nationkey, CASE WHEN row_number() OVER (PARTITION BY s_suppkey % 20, s_suppkey % 5 ORDER BY s_suppkey) = 1 THEN ''
    ELSE concat('stack', cast(s_suppkey AS string), '/') END AS own FROM supplier) s
"""

FX_QUESTIONS = """
SELECT conv_id * 1000 + turn AS q_id, concat('repo', cast(conv_id % 20 AS string)) AS repo_id,
  concat(text, ' Where is file_', cast((conv_id % 20) + 20 * (turn + 1) AS string), '.py?') AS text
FROM conversations WHERE role = 'user'
"""

# Answers naming files: an assistant turn is followed by the path or name of a file of its repository.
FX_ANSWERS = """
SELECT conv_id * 1000 + turn AS answer_id, concat('repo', cast(conv_id % 20 AS string)) AS repo_id,
  concat(text, ' see file_', cast((conv_id % 20) + 20 * (turn + 1) AS string), '.json, src/models/file_', cast((conv_id % 20) + 240 AS string), '.py and README.md.') AS text
FROM conversations WHERE role = 'assistant'
"""

# Raw files: names with blanks, signs, other scripts, hidden folders and no extension; `broken` gets a byte that is no UTF-8.
FX_PAGES = """
SELECT concat('site', cast(page_id % 7 AS string)) AS repo_id,
  concat(CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'a b/' WHEN 2 THEN 'x=1/50%25/' WHEN 3 THEN '.git/#1/' WHEN 4 THEN 'größe/日本/' ELSE 'n+1/c&d/' END,
    'page ', cast(page_id AS string), CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '' ELSE '.Tar.GZ' END) AS path,
  concat(coalesce(html, ''), CASE WHEN page_id % 5 = 0 THEN chr(13) ELSE '' END) AS content, page_id % 4 = 1 AS broken
FROM pages
"""

FILE_CORPORA = {
    "files": FX_FILES, "manifests": FX_MANIFESTS, "code": FX_CODE, "py": FX_PY, "schema": FX_SCHEMA,
    "lang": FX_LANG, "web": FX_WEB, "orm": FX_ORM, "stack": FX_STACK,
}
EVERYTHING = "\nUNION ALL\n".join(f"SELECT repo_id, path, content FROM ({sql}) c_{name}" for name, sql in FILE_CORPORA.items())
CORPORA = {
    "pages": FX_PAGES,
    **FILE_CORPORA, "all": EVERYTHING, "commits": FX_COMMITS, "dep_rows": FX_DEP_ROWS, "questions": FX_QUESTIONS,
    "answers": FX_ANSWERS,
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
_AGG = re.compile(r"<<agg (.*?) \| (.*?) \| (.*?)>>", re.S)


def duckdb_sql(name: str) -> str:
    return _AGG.sub(r"string_agg(\1, \2 ORDER BY \3)", CORPORA[name]).strip()


#: Where many rows become one file, and the column that names the file.
_DECLARED = "lineitem JOIN part ON l_partkey = p_partkey"
GROUPED = [("lineitem", ") l\n", "l_orderkey"), (_DECLARED, " GROUP BY l_orderkey, l_partkey, p_name\n) rows_", "l_orderkey")]
#: A file has one kind, so its rows are numbered alike within both; a filter on paths, which hold both, then passes.
_NUMBERED, _NUMBERED_ALIKE = "PARTITION BY file_no ORDER BY name", "PARTITION BY file_no, kind ORDER BY name"


def spark_sql(name: str, sf_dir: str, spread: int | None = None) -> str:
    """With ``spread``, files are dealt over that many tasks before their rows are put together.

    The tasks of a grouping are otherwise sized by the bytes that were shuffled, about one a core and some more, and what
    operators do with a file's text costs far more than its bytes tell: the last few tasks took as long as all before.
    """
    def ordered(m: re.Match) -> str:
        return f"array_join(sort_array(collect_list(struct({m[3]} AS k, {m[1]} AS v))).v, {m[2]})"

    sql = CORPORA[name]
    if spread is not None:
        for rows, end, file in GROUPED:
            dealt = f"(SELECT /*+ REPARTITION({spread}, {file}) */ * FROM {rows})"
            sql = sql.replace(f"FROM {rows}{end}", f"FROM {dealt}{end}")
        sql = sql.replace(_NUMBERED, _NUMBERED_ALIKE)
    sql = _AGG.sub(ordered, sql)
    return re.sub(
        rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus as a DataFrame; nothing but Spark SQL over the given tables."""
    return spark.sql(spark_sql(name, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions"))))
