"""`python_facts`: the one leaf that needs a Python syntax tree.

Only the path and text of `.py` files cross into the Python workers, in Arrow batches; one row per
file comes back with nested facts.  Grouping, joining and counting stay native.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.paths import prune_paths
from corpuslens.operators.files import with_text

# executors need no installed copy of the package for this one function
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTS_SCHEMA = """
    repo_id string, path string, parse_error boolean,
    imports array<string>,
    classes array<struct<name: string, bases: array<string>, methods: array<string>, line: int>>,
    functions array<struct<name: string, decorators: array<string>, line: int, length: int, complexity: int>>,
    graph array<struct<fn: string, callees: array<string>>>
"""


def _short(node: ast.AST) -> str:
    for field in ("id", "attr", "value"):
        found = getattr(node, field, None)
        if isinstance(found, str):
            return found
    return ast.unparse(node)


def _dotted(node: ast.AST) -> str:
    """Names of an attribute chain; a chain that starts with anything but a name has an empty first part."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.Assert)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# nodes without children of interest are never put on the stack
LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias)
NEVER_CHILDREN = ("ctx", "op", "ops", "id", "attr", "name", "arg", "type_comment")
#: The fields of each type that may hold children; leaves, and what is no node, are not entered.
FIELDS = {kind: tuple(f for f in kind._fields if f not in NEVER_CHILDREN) for kind in vars(ast).values()
          if isinstance(kind, type) and issubclass(kind, ast.AST) and not issubclass(kind, LEAVES)}
#: Types at which a fact is taken; all others are only passed through.
NOTED = {*BRANCHES, *FUNCTIONS, ast.BoolOp, ast.Call, ast.ClassDef, ast.Import, ast.ImportFrom}


def file_facts(source: str) -> dict:
    """Facts of one file, outer levels before inner ones and source order within a level.

    A function's complexity includes what is nested in it; a call belongs to the innermost function
    around it.
    """
    found: dict[str, list] = {"imports": [], "classes": [], "functions": [], "calls": []}
    # level by level, as (enclosing functions, children of one node): deep trees cannot exhaust the interpreter
    level: list[tuple[tuple, list]] = [((), [ast.parse(source)])]
    while level:
        below: list[tuple[tuple, list]] = []
        for around, nodes in level:
            for node in nodes:
                kind = node.__class__
                fields = FIELDS.get(kind)
                if not fields:
                    continue
                inside = around
                if kind in NOTED:
                    if kind is ast.Call:
                        target = node.func
                        if inside and isinstance(target, (ast.Name, ast.Attribute)):
                            callee = target.id if isinstance(target, ast.Name) else f"{_dotted(target.value)}.{target.attr}"
                            found["calls"].append({"caller": inside[-1]["name"], "callee": callee})
                    elif kind in FUNCTIONS:
                        fact = {"name": node.name, "decorators": [_short(d) for d in node.decorator_list],
                                "line": node.lineno, "length": node.end_lineno - node.lineno, "complexity": 1}
                        found["functions"].append(fact)
                        inside = (*inside, fact)
                    elif kind is ast.ClassDef:
                        methods = [m.name for m in node.body if isinstance(m, FUNCTIONS)]
                        found["classes"].append({
                            "name": node.name, "bases": [_short(b) for b in node.bases], "methods": methods, "line": node.lineno})
                    elif kind is ast.Import or kind is ast.ImportFrom:
                        module = getattr(node, "module", None)
                        found["imports"] += [f"{module}.{a.name}" if module else a.name for a in node.names]
                        continue
                    else:
                        more = len(node.values) - 1 if kind is ast.BoolOp else 1
                        for fact in inside:
                            fact["complexity"] += more
                children: list = []
                for field in fields:
                    value = getattr(node, field, None)
                    if value.__class__ is list:
                        children += value
                    elif value is not None:
                        children.append(value)
                if children:
                    below.append((inside, children))
        level = below
    return found


#: rows of a batch that are Python objects at a time, whatever the session's batch size
SLICE = 64
NO_FACTS = {"parse_error": True, "imports": [], "classes": [], "functions": [], "graph": []}


def _facts(source: str | None) -> dict:
    """One file that does not parse, or has no content, must not lose its repository."""
    try:
        if source is None:
            return NO_FACTS
        found = file_facts(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return NO_FACTS
    callees: dict[str, list[str]] = {f["name"]: [] for f in found["functions"]}
    for call in found.pop("calls"):
        callees[call["caller"]].append(call["callee"])
    return {"parse_error": False, **found, "graph": [{"fn": f, "callees": c} for f, c in callees.items()]}


def _column(kind: pa.DataType, values: list) -> pa.Array:
    """An Arrow array of values that are lists and dicts as deep as the type, built field by field."""
    if pa.types.is_list(kind):
        ends = [0, *accumulate(len(v) for v in values)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(kind.value_type, [x for v in values for x in v]), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column(f.type, [v[f.name] for v in values]) for f in kind], fields=list(kind))
    return pa.array(values, kind)


def _facts_of_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            facts = [_facts(text) for text in part.column("text").to_pylist()]
            of_texts = [_column(field.type, [f[field.name] for f in facts]) for field in list(schema)[2:]]
            yield pa.RecordBatch.from_arrays([part.column(c).cast(pa.string()) for c in ("repo_id", "path")] + of_texts, schema=schema)


def _arrow_schema() -> pa.Schema:
    texts = pa.list_(pa.string())
    return pa.schema([
        ("repo_id", pa.string()), ("path", pa.string()), ("parse_error", pa.bool_()), ("imports", texts),
        ("classes", pa.list_(pa.struct(
            [("name", pa.string()), ("bases", texts), ("methods", texts), ("line", pa.int32())]))),
        ("functions", pa.list_(pa.struct(
            [("name", pa.string()), ("decorators", texts), ("line", pa.int32()), ("length", pa.int32()),
             ("complexity", pa.int32())]))),
        ("graph", pa.list_(pa.struct([("fn", pa.string()), ("callees", texts)]))),
    ])


def python_facts(files: DataFrame) -> DataFrame:
    """One row per `.py` file: imports, classes, functions, calls, or `parse_error`."""
    sources = with_text(prune_paths(files, "P1")).where(F.col("ext") == ".py").select("repo_id", "path", "text")
    schema = _arrow_schema()
    return sources.mapInArrow(lambda batches: _facts_of_batches(batches, schema), FACTS_SCHEMA)


def python_function_metrics(facts: DataFrame) -> DataFrame:
    """Length and complexity per function."""
    return facts.select("repo_id", "path", F.posexplode("functions").alias("seq", "f")).select(
        "repo_id", "path", "seq", F.col("f.name").alias("fn"), F.col("f.line").alias("line"),
        F.col("f.length").alias("length"), F.col("f.complexity").alias("complexity"))
