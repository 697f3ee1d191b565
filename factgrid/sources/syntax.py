"""Syntax facts of Python programs: one row a program from an Arrow-batched parser, then plain tables.

Catalyst can't look into a parser, so `facts` is to be written or cached once; all tables below are projections of it.
A program that doesn't parse gives a row with `error`, and no facts: a corpus job doesn't die of one file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FUNCTION = "struct<ord:long,name:string,lineno:int,args:array<string>,returns:string,calls:array<string>,variables:array<string>,docstring:string>"
_CLASS = "struct<ord:long,name:string,lineno:int,bases:array<string>,methods:array<string>,attributes:array<string>,docstring:string>"
_VARIABLE = "struct<ord:long,name:string,lineno:int,scope:string,assigned_value:string,dependencies:array<string>>"
_IMPORT = "struct<ord:long,module:string,names:array<string>,alias:string,lineno:int>"
FACTS = f"file_id string, functions array<{_FUNCTION}>, classes array<{_CLASS}>, variables array<{_VARIABLE}>, imports array<{_IMPORT}>, module_calls array<string>, error string"


def _called(roots: list[ast.AST]) -> list[str]:
    """Sorted distinct names called anywhere under the roots: plain names and the last attribute."""
    found = set()
    for root in roots:
        for node in ast.walk(root):
            if isinstance(node, ast.Call):
                if isinstance(node.func, ast.Name):
                    found.add(node.func.id)
                elif isinstance(node.func, ast.Attribute):
                    found.add(node.func.attr)
    return sorted(found)


def _assigned(statements: Iterator[ast.AST]) -> list[tuple[str, ast.AST]]:
    """(name, statement) of each plain name that an assignment among the statements binds, in order."""
    out = []
    for s in statements:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
        out += [(t.id, s) for t in targets if isinstance(t, ast.Name)]
    return out


def _names(node: ast.AST | None) -> list[str]:
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)}) if node else []


def parse(code: str) -> dict[str, Any]:
    """All facts of a program, each definition with its place in a breadth-first walk; methods come again with their class."""
    tree = ast.parse(code)
    out: dict[str, Any] = {"functions": [], "classes": [], "variables": [], "imports": [], "module_calls": []}

    def function(node) -> None:
        a = node.args
        extra = [f"{star}{x.arg}" for star, x in (("*", a.vararg), ("**", a.kwarg)) if x]
        inner = [n for s in node.body for n in ast.walk(s)]
        out["functions"].append({
            "ord": len(out["functions"]), "name": node.name, "lineno": node.lineno, "args": [x.arg for x in a.args] + extra,
            "returns": ast.unparse(node.returns) if node.returns else None, "calls": _called(node.body),
            "variables": sorted({name for name, _ in _assigned(inner)}), "docstring": ast.get_docstring(node),
        })

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node)
        elif isinstance(node, ast.ClassDef):
            own = [x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            for x in own:
                function(x)
            bases = [b.id if isinstance(b, ast.Name) else ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            out["classes"].append({
                "ord": len(out["classes"]), "name": node.name, "lineno": node.lineno, "bases": bases, "methods": [x.name for x in own],
                "attributes": [name for name, _ in _assigned(node.body)], "docstring": ast.get_docstring(node),
            })
        elif isinstance(node, ast.Import):
            out["imports"] += [{"ord": len(out["imports"]) + k, "module": x.name, "names": [x.name], "alias": x.asname, "lineno": node.lineno} for k, x in enumerate(node.names)]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"ord": len(out["imports"]), "module": node.module or "", "names": [x.name for x in node.names], "alias": None, "lineno": node.lineno})
    for k, (name, s) in enumerate(_assigned(tree.body)):
        out["variables"].append({"ord": k, "name": name, "lineno": s.lineno, "scope": "global", "assigned_value": ast.unparse(s.value) if s.value else None, "dependencies": _names(s.value)})
    out["module_calls"] = _called([s for s in tree.body if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))])
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, code in zip(batch["file_id"], batch["code"], strict=True):
            try:
                rows.append({"file_id": file_id, **parse(code or ""), "error": None})
            except (SyntaxError, ValueError, RecursionError) as e:
                rows.append({"file_id": file_id, "functions": [], "classes": [], "variables": [], "imports": [], "module_calls": [], "error": f"Python syntax error: {e}"})
        yield pd.DataFrame(rows, columns=["file_id", "functions", "classes", "variables", "imports", "module_calls", "error"])


def facts(sources: DataFrame) -> DataFrame:
    """sources: file_id, code. A row for each program."""
    return sources.select("file_id", "code").mapInPandas(_parsed, FACTS)


def _last(table: DataFrame, key_mode: str) -> DataFrame:
    """Of the definitions of a name in a file the last one stands; key_mode "each" keeps all."""
    if key_mode == "each":
        return table
    others = [c for c in table.columns if c not in ("file_id", "name")]
    best = table.groupBy("file_id", "name").agg(F.max_by(F.struct(*others), "ord").alias("b"))
    return best.select("file_id", "name", *(F.col(f"b.{c}").alias(c) for c in others))


def functions(parsed: DataFrame, key_mode: str = "bare") -> DataFrame:
    return _last(parsed.select("file_id", F.inline("functions")), key_mode)


def classes(parsed: DataFrame, key_mode: str = "bare") -> DataFrame:
    return _last(parsed.select("file_id", F.inline("classes")), key_mode)


def variables(parsed: DataFrame, key_mode: str = "bare") -> DataFrame:
    return _last(parsed.select("file_id", F.inline("variables")), key_mode)


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.inline("imports"))


def call_rel(parsed: DataFrame) -> DataFrame:
    """file_id, caller, callee: of a name's definitions the last one that calls anything."""
    own = parsed.select("file_id", F.inline("functions")).where(F.size("calls") > 0)
    last = own.groupBy("file_id", F.col("name").alias("caller")).agg(F.max_by("calls", "ord").alias("calls"))
    return last.select("file_id", "caller", F.explode("calls").alias("callee"))


def module_calls(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("module_calls").alias("callee"))


def all_entities(parsed: DataFrame) -> DataFrame:
    """A row for each file with the names of its functions, classes, methods, variables and imported modules."""
    names = lambda t, alias: t.groupBy("file_id").agg(F.array_sort(F.collect_list("name")).alias(alias))
    methods = classes(parsed).groupBy("file_id").agg(F.array_sort(F.flatten(F.collect_list("methods"))).alias("methods"))
    modules = imports(parsed).groupBy("file_id").agg(F.array_sort(F.collect_list("module")).alias("imports"))
    out = parsed.select("file_id")
    for t in (names(functions(parsed), "functions"), names(classes(parsed), "classes"), methods, names(variables(parsed), "variables"), modules):
        out = out.join(t, "file_id", "left")
    return out.select("file_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("functions", "classes", "methods", "variables", "imports")))
