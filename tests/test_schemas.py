from corpuslens.operators import schemas
from tests.conftest import rows_of


def tables(make_files, rows, finder):
    got = schemas.db_tables(make_files(rows), [finder]).orderBy("path", "pos").collect()
    return {r["name"]: [tuple(c) for c in r["columns"]] for r in got}


def test_sql(make_files):
    text = """create table if not exists `users` (
  `id` INT,
  name VARCHAR (20) NOT NULL,
  price DECIMAL(10,2),
  inline INT PRIMARY KEY,
  PRIMARY KEY (`id`),
  KEY x (name),
  FOREIGN KEY (`team`) REFERENCES teams(id)
);
CREATE TABLE s.t (a INT);"""
    df = make_files({"a.sql": text, "dist/b.sql": text})
    assert tables(make_files, {"a.sql": text}, "sql") == {"users": [
        ("id", "INT", True), ("name", "VARCHAR (20)", False), ("price", "DECIMAL(10,2)", False), ("inline", "INT", False)]}
    keys = schemas.db_foreign_keys(schemas.schema_sql(df))
    assert rows_of(keys, "table_name", "column_name", "references_table", "references_column") == [("users", "team", "teams", "id")]
    assert tables(make_files, {"x.py": "q = '''CREATE TABLE p (\n a INT\n);'''"}, "py_ddl") == {"p": [("a", "INT", False)]}


def test_laravel(make_files):
    text = """Schema::create('posts', function (Blueprint $table) {
  $table->bigIncrements('pid'); $table->string("title"); $table->text('title');
  $table->id(); $table->timestamps(); $table->softDeletes();
});"""
    assert tables(make_files, {"m.php": text}, "laravel") == {"posts": [
        ("pid", "bigIncrements", True), ("title", "string", False), ("id", "id", True),
        ("created_at", "timestamps", False), ("updated_at", "timestamps", False), ("deleted_at", "softDeletes", False)]}


def test_alembic(make_files):
    text = "op.create_table('t',\n  sa.Column('id', sa.Integer, primary_key=True),\n  sa.Column('n', sa.String)\n)\n"
    assert tables(make_files, {"alembic/versions/v.py": text}, "alembic") == {"t": [("id", "Integer", True), ("n", "String", True)]}
    assert tables(make_files, {"other/v.py": text, "migrations/__init__.py": text}, "alembic") == {}
    # the body ends where two parentheses close
    cut = "op.create_table('t', sa.Column('id', sa.Integer()), sa.Column('n', sa.String()))\n"
    assert tables(make_files, {"migrations/v.py": cut}, "alembic") == {"t": [("id", "Integer", False)]}


def test_django(make_files):
    text = ("from django.db import models\n\nclass A(models.Model):\n    key = models.AutoField(primary_key=True)\n"
            "    name = models.CharField(max_length=3)\n\nclass B(models.Model):\n    a = models.ForeignKey(A)\n")
    want = {"A": [("key", "AutoField", True), ("name", "CharField", False)], "B": [("a", "ForeignKey", False)]}
    assert tables(make_files, {"app/models.py": text}, "django") == want
    assert tables(make_files, {"app/models/a.py": text}, "django") == want
    assert tables(make_files, {"app/other.py": text}, "django") == {}


def test_sqlalchemy_typeorm_prisma(make_files):
    text = "Base = declarative_base()\n\nclass U(Base):\n    id = Column(Integer)\n    n = Column(String)\n\nclass V(Other):\n    x = Column(Integer)\n"
    assert tables(make_files, {"o.py": text}, "sqlalchemy") == {"U": [("id", "Column", False), ("n", "Column", False)]}
    entity = "@Entity()\nclass T {\n  @Column()\n  name: string;\n  default: x\n}\n"
    assert tables(make_files, {"t.entity.ts": entity, "t.ts": entity}, "typeorm") == {"T": [("name", "string", False)]}
    assert tables(make_files, {"t.entity.ts": entity.replace("class", "export class")}, "typeorm") == {}
    prisma = "model P {\n  id Int @id\n  name String\n  opt String?\n  posts Post[]\n  owner User @relation(fields: [a])\n}\n"
    assert tables(make_files, {"schema.prisma": prisma}, "prisma") == {"P": [
        ("name", "String", False), ("posts", "Post[]", False), ("owner", "User", False)]}


def test_first_finder_wins(make_files):
    df = make_files({"z.sql": "CREATE TABLE same (\n a INT\n);", "b.sql": "CREATE TABLE same (\n b INT\n);",
                     "a.py": "CREATE TABLE same (\n c INT\n);"})
    schema = schemas.database_schema(schemas.db_tables(df))
    assert rows_of(schema, "name", "finder", "path") == [("same", "sql", "b.sql")]
    assert rows_of(schemas.table_counts(schema), "n_columns", "n_foreign_keys") == [(1, 0)]
