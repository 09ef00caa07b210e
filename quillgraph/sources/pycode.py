"""Python sources as tables of symbols, imports and calls."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import schemas
from .files import parsed, relative_to, whole_texts


def module_of(path: str, packages: set[str] = frozenset()) -> str:
    """Dotted module of a file; ``packages`` are the folders that have an ``__init__.py``."""
    parts = path.removesuffix(".py").split("/")
    first = len(parts) - 1
    while first and "/".join(parts[:first]) in packages:
        first -= 1
    named = parts[first:] if packages else parts
    return ".".join(named[:-1] if named[-1] == "__init__" and len(named) > 1 else named)


def _module(path: str) -> str:
    return module_of(path)


def symbols(path: str, body: str) -> Iterator[tuple]:
    """Classes, functions and methods with signature, first paragraph of the docstring and lines; functions within functions aren't listed."""
    module = _module(path)

    def walk(nodes: list[ast.stmt], owner: str, in_class: bool) -> Iterator[tuple]:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if in_class else "async_function" if isinstance(n, ast.AsyncFunctionDef) else "function"
                back = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                sign = f"{'async ' * isinstance(n, ast.AsyncFunctionDef)}def {n.name}({ast.unparse(n.args)}){back}"
            elif isinstance(n, ast.ClassDef):
                kind, sign = "class", f"class {n.name}" + (f"({', '.join(map(ast.unparse, n.bases))})" if n.bases else "")
            else:
                continue
            name = f"{owner}.{n.name}"
            doc = (ast.get_docstring(n) or "").split("\n\n")[0].strip() or None
            yield path, module, name, n.name, kind, sign, doc, n.lineno, n.end_lineno, owner
            if isinstance(n, ast.ClassDef):
                yield from walk(n.body, name, True)

    yield from walk(ast.parse(body).body, module, False)


def _base(module: str, path: str, level: int) -> str:
    parts = module.split(".")
    up = level - 1 if path.endswith("__init__.py") else level
    return ".".join(parts[: len(parts) - up])


def imports(path: str, body: str) -> Iterator[tuple]:
    """(path, module, target, alias, line) of imports, relative ones resolved; star imports are left out."""
    module = _module(path)
    for n in ast.walk(ast.parse(body)):
        if isinstance(n, ast.Import):
            yield from ((path, module, a.name, a.asname or a.name.split(".")[0], n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            base = ".".join(x for x in ((_base(module, path, n.level) if n.level else ""), n.module or "") if x)
            yield from ((path, module, f"{base}.{a.name}" if base else a.name, a.asname or a.name, n.lineno) for a in n.names if a.name != "*")


def calls(path: str, body: str) -> Iterator[tuple]:
    """(path, module, caller, dotted target, line) of every call whose target is a dotted name."""
    module = _module(path)

    def dotted(n: ast.expr) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            head = dotted(n.value)
            return f"{head}.{n.attr}" if head else None
        return None

    def walk(n: ast.AST, scope: str) -> Iterator[tuple]:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            scope = f"{scope}.{n.name}"
        if isinstance(n, ast.Call) and (target := dotted(n.func)):
            yield path, module, scope, target, n.lineno
        for child in ast.iter_child_nodes(n):
            yield from walk(child, scope)

    yield from walk(ast.parse(body), module)


def read_code(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``files, symbols, imports, calls, containment`` of the Python files under ``path``; a file that can't be parsed is an error."""
    return code_tables(whole_texts(spark, path, "*.py").withColumn("path", relative_to(F.col("path"), path)))


def code_tables(files: DataFrame) -> dict[str, DataFrame]:
    """As read_code(), of files (path, text)."""
    s = parsed(files, symbols, schemas.SYMBOL)
    lines = files.select("path", text.line_count("text").cast("long").alias("lines"))
    containment = s.select(F.col("parent").alias("source"), F.col("qualified_name").alias("target")).dropDuplicates()
    return {"files": lines, "symbols": s, "imports": parsed(files, imports, schemas.IMPORT).dropDuplicates(), "calls": parsed(files, calls, schemas.CALL).dropDuplicates(), "containment": containment}


def _unique(symbols_: DataFrame, key: Column) -> DataFrame:
    """Names that stand for one symbol."""
    return symbols_.groupBy(key.alias("key")).agg(F.min("qualified_name").alias("hit"), F.max("qualified_name").alias("other")).where("hit = other").select("key", "hit")


def resolve_calls(calls_: DataFrame, imports_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Calls with ``resolved``: a member of the own class, an imported name, an absolute name, a name of the module, a name that only one symbol has; else null."""
    names = symbols_.select(F.col("qualified_name").alias("key"), F.col("qualified_name").alias("hit")).distinct()
    short = _unique(symbols_, F.col("name"))
    c = calls_.withColumn("head", F.substring_index("target", ".", 1)).withColumn("tail", F.when(F.contains("target", F.lit(".")), F.regexp_replace("target", r"^[^.]+", "")).otherwise(""))
    alias = imports_.groupBy("path", F.col("alias").alias("head")).agg(F.min("target").alias("imported"))
    c = c.join(alias, ["path", "head"], "left")
    owner = F.regexp_replace("caller", r"\.[^.]+$", "")
    tries = {
        "own": F.when(F.col("head").isin("self", "cls"), F.concat(owner, "tail")),
        "imported": F.concat("imported", "tail"),
        "absolute": F.col("target"),
        "local": F.concat("module", F.lit("."), "target"),
    }
    for n, key in tries.items():
        c = c.withColumn("key", key).join(names.withColumnRenamed("hit", f"by_{n}"), "key", "left").drop("key")
    c = c.join(short.withColumnRenamed("key", "last").withColumnRenamed("hit", "by_name"), F.element_at(F.split("target", "[.]"), -1) == F.col("last"), "left").drop("last")
    return c.withColumn("resolved", F.coalesce("by_own", "by_imported", "by_absolute", "by_local", "by_name")).select(*calls_.columns, "resolved")


def resolve_imports(imports_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Imports with ``resolved``: the symbol or the module of that name, else the one symbol whose last name it is."""
    names = symbols_.select(F.col("qualified_name").alias("target"), F.col("qualified_name").alias("by_symbol")).distinct()
    modules = symbols_.select(F.col("module").alias("target"), F.col("module").alias("by_module")).distinct()
    short = _unique(symbols_, F.col("name"))
    i = imports_.join(names, "target", "left").join(modules, "target", "left")
    i = i.join(short.withColumnRenamed("key", "last").withColumnRenamed("hit", "by_name"), F.element_at(F.split("target", "[.]"), -1) == F.col("last"), "left")
    return i.withColumn("resolved", F.coalesce("by_symbol", "by_module", "by_name")).select(*imports_.columns, "resolved")
