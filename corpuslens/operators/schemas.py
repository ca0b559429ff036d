"""B family: database tables declared in SQL, migrations and object mappings.

Every finder is an array expression over one file's text.  `db_tables` runs all of them in a
single pass; `database_schema` keeps the first table of a name per repository with one
aggregation, whose partial step already collapses copies inside a map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions.paths import below_directory, prune_paths
from corpuslens.functions.text import bound, find_all, find_fields, first_match, first_of_name, pattern, strip
from corpuslens.operators.files import with_text

COLUMN_TYPE = "struct<name:string,type:string,primary_key:boolean>"
KEY_TYPE = "struct<column:string,references_table:string,references_column:string>"


def _column(name: Column, kind: Column, primary_key: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), primary_key.alias("primary_key"))


def _table(name: Column, columns: Column, keys: Column | None = None) -> Column:
    none = F.array().cast(f"array<{KEY_TYPE}>")
    return F.struct(name.alias("name"), columns.alias("columns"), (none if keys is None else keys).alias("foreign_keys"))


def sql_tables(text: Column) -> Column:
    """CREATE TABLE statements; one column per line, single-column keys.

    The key is found once a statement: a search of the body for each of its columns grows with their square.
    """
    found = find_fields(
        text, pattern(rules.SQL_CREATE_TABLE, ignore_case=True, dotall=True), name=1, body=2)
    # the word has no letter that another one than its capital matches without case
    none = F.array().cast("array<struct<name:string,body:string>>")
    statements = F.when(~F.contains(F.lower(text), F.lit("create")), none).otherwise(found)

    def columns(body: Column) -> Column:
        key = first_match(body, pattern(rules.SQL_PRIMARY_KEY, ignore_case=True))
        found = find_fields(body, pattern(rules.SQL_COLUMN, multiline=True), name=1, type=2)
        kept = F.filter(found, lambda c: ~F.upper(c["name"]).isin(rules.SQL_NOT_COLUMNS))
        return bound(key, lambda found_key: F.transform(kept, lambda c: _column(
            c["name"], strip(c["type"]), F.coalesce(c["name"] == found_key, F.lit(False)))))

    def keys(body: Column) -> Column:
        return find_fields(
            body, pattern(rules.SQL_FOREIGN_KEY, ignore_case=True),
            column=1, references_table=2, references_column=3)

    return F.transform(statements, lambda s: _table(s["name"], columns(s["body"]), keys(s["body"])))


def laravel_tables(text: Column) -> Column:
    """B2: named columns first, then the defaults of argument-less helpers; first name wins."""
    tables = find_fields(text, pattern(rules.LARAVEL_TABLE, dotall=True), "Schema::create(", name=1, body=2)

    def columns(body: Column) -> Column:
        named = F.transform(
            find_fields(body, pattern(rules.LARAVEL_COLUMN), type=1, name=2),
            lambda c: _column(c["name"], c["type"], c["type"].isin(rules.LARAVEL_KEYS)))
        none = F.array().cast(f"array<{COLUMN_TYPE}>")
        defaults = []
        for helper, names in rules.LARAVEL_DEFAULTS:
            used = F.rlike(body, F.lit(pattern(rf"\$table->{helper}\s*\(\)")))
            added = F.array(*[
                _column(F.lit(n), F.lit(helper), F.lit(helper in rules.LARAVEL_KEYS)) for n in names])
            defaults.append(F.when(used, added).otherwise(none))
        return first_of_name(F.concat(named, *defaults))

    return F.transform(tables, lambda t: _table(t["name"], columns(t["body"])))


def alembic_tables(text: Column) -> Column:
    """The key flag holds for the whole table; so does the literal text ``.*primary`` after a name.

    Both are looked for once a table: the second as the runs of word characters right before it, one of which
    ends with the name.
    """
    tables = find_fields(text, pattern(rules.ALEMBIC_TABLE, dotall=True), "op.create_table(", name=1, body=2)

    def columns(body: Column) -> Column:
        found = find_fields(body, pattern(rules.ALEMBIC_COLUMN), name=1, type=2)
        flagged = F.contains(body, F.lit("primary_key=True"))
        before = F.array_distinct(find_all(body, pattern(r"(?<!\w)\w++(?=\.\*primary)"), 0))
        marks = F.struct(flagged.alias("all"), before.alias("runs"))
        return bound(marks, lambda m: F.transform(found, lambda c: _column(
            c["name"], c["type"], m["all"] | F.exists(m["runs"], lambda run: F.endswith(run, c["name"])))))

    return F.transform(tables, lambda t: _table(t["name"], columns(t["body"])))


def django_tables(text: Column) -> Column:
    """Model classes and their fields."""
    models = find_fields(text, pattern(rules.DJANGO_MODEL, dotall=True), "models.", name=1, body=2)

    def columns(body: Column) -> Column:
        found = find_fields(body, pattern(rules.DJANGO_FIELD_LINEAR), name=1, type=2)
        return F.transform(found, lambda c: _column(c["name"], c["type"], c["type"] == "AutoField"))

    return F.transform(models, lambda m: _table(m["name"], columns(m["body"])))


def sqlalchemy_tables(text: Column) -> Column:
    """Mapped classes; the type is the literal word Column."""
    models = find_fields(text, pattern(rules.SQLALCHEMY_MODEL, dotall=True), "Base", name=1, body=2)

    def columns(body: Column) -> Column:
        names = find_all(body, pattern(rules.SQLALCHEMY_COLUMN_LINEAR))
        return F.transform(names, lambda n: _column(n, F.lit("Column"), F.lit(False)))

    return F.transform(models, lambda m: _table(m["name"], columns(m["body"])))


def typeorm_tables(text: Column) -> Column:
    """Entity classes and their properties."""
    entities = find_fields(text, pattern(rules.TYPEORM_ENTITY, dotall=True), "@Entity", name=1, body=2)

    def columns(body: Column) -> Column:
        found = find_fields(body, pattern(rules.TYPEORM_PROPERTY_LINEAR), name=1, type=2)
        kept = F.filter(found, lambda c: ~c["name"].isin(rules.TYPEORM_NOT_PROPERTIES))
        return F.transform(kept, lambda c: _column(c["name"], c["type"], F.lit(False)))

    return F.transform(entities, lambda e: _table(e["name"], columns(e["body"])))


def prisma_tables(text: Column) -> Column:
    """Models whose field lines hold a name, a type and at most a relation."""
    models = find_fields(text, pattern(rules.PRISMA_MODEL, dotall=True), "model", name=1, body=2)

    def columns(body: Column) -> Column:
        found = find_fields(body, pattern(rules.PRISMA_FIELD, multiline=True), name=1, type=2, relation=3)
        kept = F.filter(found, lambda c: ~c["type"].isin(rules.PRISMA_NOT_TYPES))
        return F.transform(kept, lambda c: _column(c["name"], c["type"], F.contains(c["relation"], F.lit("@id"))))

    return F.transform(models, lambda m: _table(m["name"], columns(m["body"])))


def _finders() -> list[tuple[str, Column, Column]]:
    """(finder, which files it reads, its tables), in priority order."""
    name, path, text = F.col("name"), F.col("path"), F.col("text")
    python = name.endswith(".py")
    django_file = (name == "models.py") | (python & below_directory(path, ["models"]))
    django_text = F.contains(text, F.lit("models.Model")) | F.contains(text, F.lit("models.ForeignKey"))
    mapped_text = F.rlike(text, F.lit(r"declarative_base|Column\(|Table\("))
    return [
        ("sql", name.endswith(".sql"), sql_tables(text)),
        ("laravel", name.endswith(".php"), laravel_tables(text)),
        ("alembic", python & (name != "__init__.py") & below_directory(path, ["alembic", "migrations"]),
         alembic_tables(text)),
        ("py_ddl", python, sql_tables(text)),
        ("django", django_file & django_text, django_tables(text)),
        ("sqlalchemy", python & mapped_text, sqlalchemy_tables(text)),
        ("typeorm", name.endswith(".entity.ts") | name.endswith(".entity.js"), typeorm_tables(text)),
        ("prisma", name == "schema.prisma", prisma_tables(text)),
    ]


def _tagged(tables: Column, number: int, finder: str) -> Column:
    return F.transform(tables, lambda t, i: F.struct(
        F.lit(number).alias("finder_no"), F.lit(finder).alias("finder"), i.alias("pos"),
        t["name"].alias("name"), t["columns"].alias("columns"), t["foreign_keys"].alias("foreign_keys")))


FINDERS = ["sql", "laravel", "alembic", "py_ddl", "django", "sqlalchemy", "typeorm", "prisma"]


def tables_in(finders: list[str] | None = None) -> tuple[Column, Column]:
    """Which files are read at all, and their tables by all finders."""
    wanted = [(n, f) for n, f in enumerate(_finders(), start=1) if finders is None or f[0] in finders]
    none = F.array().cast(
        f"array<struct<finder_no:int,finder:string,pos:int,name:string,"
        f"columns:array<{COLUMN_TYPE}>,foreign_keys:array<{KEY_TYPE}>>>")
    reads = None
    arrays = []
    for number, (finder, applies, tables) in wanted:
        reads = applies if reads is None else reads | applies
        arrays.append(F.when(applies, _tagged(tables, number, finder)).otherwise(none))
    return reads, F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def as_tables(rows: DataFrame) -> DataFrame:
    """One row a table, from (repo_id, path, tables)."""
    # outer: see as_functions in calls
    return rows.select("repo_id", "path", F.explode_outer("tables").alias("t")).where("t IS NOT NULL").select("repo_id", "path", "t.*")


def db_tables(files: DataFrame, finders: list[str] | None = None) -> DataFrame:
    """All tables of all finders, before names are made unique; one scan, no shuffle."""
    reads, found = tables_in(finders)
    return as_tables(with_text(prune_paths(files, "P3")).where(reads).select("repo_id", "path", found.alias("tables")))


def schema_sql(files: DataFrame) -> DataFrame:
    return db_tables(files, ["sql"])


def schema_laravel(files: DataFrame) -> DataFrame:
    return db_tables(files, ["laravel"])


def schema_alembic(files: DataFrame) -> DataFrame:
    return db_tables(files, ["alembic"])


def schema_py_ddl(files: DataFrame) -> DataFrame:
    return db_tables(files, ["py_ddl"])


def schema_django(files: DataFrame) -> DataFrame:
    return db_tables(files, ["django"])


def schema_sqlalchemy(files: DataFrame) -> DataFrame:
    return db_tables(files, ["sqlalchemy"])


def schema_typeorm(files: DataFrame) -> DataFrame:
    return db_tables(files, ["typeorm"])


def schema_prisma(files: DataFrame) -> DataFrame:
    return db_tables(files, ["prisma"])


def database_schema(tables: DataFrame) -> DataFrame:
    """The first table of a name per repository, by finder, path and position."""
    first = tables.groupBy("repo_id", "name").agg(
        F.min_by(F.struct("finder", "path", "columns", "foreign_keys"), F.struct("finder_no", "path", "pos")).alias("t"))
    return first.select("repo_id", "name", "t.*")


def db_columns(tables: DataFrame) -> DataFrame:
    """Long form: one row per column."""
    return tables.select("repo_id", "path", "finder", F.col("name").alias("table_name"), F.posexplode("columns").alias("seq", "c")).select(
        "repo_id", "path", "finder", "table_name", "seq", F.col("c.name").alias("column_name"),
        F.col("c.type").alias("column_type"), F.col("c.primary_key").alias("primary_key"))


def db_foreign_keys(tables: DataFrame) -> DataFrame:
    """Long form: one row per foreign key."""
    return tables.select("repo_id", "path", "finder", F.col("name").alias("table_name"), F.posexplode("foreign_keys").alias("seq", "k")).select(
        "repo_id", "path", "finder", "table_name", "seq", F.col("k.column").alias("column_name"),
        "k.references_table", "k.references_column")


def table_counts(schema: DataFrame) -> DataFrame:
    """Q3: columns and foreign keys per table."""
    return schema.select(
        "repo_id", F.col("name").alias("table_name"), F.size("columns").alias("n_columns"),
        F.size("foreign_keys").alias("n_foreign_keys"))
