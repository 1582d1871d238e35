"""Python source text to a call graph: definitions and calls of each file, then resolution by joins.

A file that cannot be parsed has no definitions and no calls. Files are independent, so extraction is
one pass over them; only names are shuffled.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from codeloom.operators.graph import Graph, merge_edges
from codeloom.operators.iterate import _cut

DEFS = "file string, ord int, name string, qualified_name string, module_path string, kind string, start_line int, end_line int, is_pub boolean, is_async boolean, is_test boolean, decision_points int, parameters int, lines_of_code int, max_nesting int, awaits int, returns int"
CALLS = "file string, caller string, module_path string, short string, kind string, in_loop boolean, line int"
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTS = (ast.If, *_LOOPS, ast.With, ast.AsyncWith, ast.Try, ast.Match)


def module_of(path: str) -> str:
    """The dotted place of a file with ``::`` between its parts; the start file of a package is the package."""
    parts = path.removesuffix(".py").strip("/").split("/")
    if "src" in parts[:-1]:
        parts = parts[parts.index("src") + 1 :]
    return "::".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.defs, self.calls = path, [], []
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        self.scope(tree, module_of(path), False)

    def scope(self, node: ast.AST, inside: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                self.scope(child, f"{inside}::{child.name}", True)
            elif isinstance(child, _SCOPES):
                self.function(child, inside, in_class)
            else:
                self.scope(child, inside, in_class)

    def function(self, node, inside: str, in_class: bool) -> None:
        own = f"{inside}::{node.name}"
        stats = {"decision_points": 0, "max_nesting": 0, "awaits": 0, "returns": 0}
        for part in node.body:
            self.body(part, own, inside, stats, 0, False)
        a = node.args
        params = len(a.posonlyargs + a.args + a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        self.defs.append((self.path, len(self.defs), node.name, own, inside, "method" if in_class else "function", node.lineno, node.end_lineno, not node.name.startswith("_"), isinstance(node, ast.AsyncFunctionDef), node.name.startswith("test"), stats["decision_points"], params, node.end_lineno - node.lineno + 1, stats["max_nesting"], stats["awaits"], stats["returns"]))
        for part in node.body:
            self.scope_of(part, own)

    def scope_of(self, node: ast.AST, own: str) -> None:
        """Functions and classes inside a function."""
        if isinstance(node, ast.ClassDef):
            self.scope(node, f"{own}::{node.name}", True)
        elif isinstance(node, _SCOPES):
            self.function(node, own, False)
        else:
            for child in ast.iter_child_nodes(node):
                self.scope_of(child, own)

    def body(self, node: ast.AST, own: str, inside: str, stats: dict, depth: int, loop: bool) -> None:
        if isinstance(node, _SCOPES):
            return
        stats["decision_points"] += isinstance(node, (ast.If, ast.IfExp, ast.ExceptHandler, ast.comprehension, ast.match_case, *_LOOPS)) + (len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0)
        stats["awaits"] += isinstance(node, ast.Await)
        stats["returns"] += isinstance(node, ast.Return)
        if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            bare = isinstance(node.func, ast.Name)
            self.calls.append((self.path, own, inside, node.func.id if bare else node.func.attr, "direct_call" if bare else "method_call", loop, node.lineno))
        deeper = depth + isinstance(node, _NESTS)
        stats["max_nesting"] = max(stats["max_nesting"], deeper)
        for child in ast.iter_child_nodes(node):
            self.body(child, own, inside, stats, deeper, loop or isinstance(node, _LOOPS))


#: Rows of files that a task gathers before it hands them on.
GATHERED = 10_000


def _extract(parse: Callable, schemas: dict[str, str]) -> tuple[Callable, StructType]:
    """(function of Arrow batches of (path, text), its schema): the rows of each part that ``parse`` finds in a file.

    A row has the number of its part and that part's columns; many files share a batch.
    """
    kind = StructType.fromDDL(", ".join(["part int", *(f"{part}_{x}" for part, schema in schemas.items() for x in schema.split(", "))]))
    to = to_arrow_schema(kind)
    widths = [len(schema.split(", ")) for schema in schemas.values()]
    blank = [((None,) * sum(widths[:k]), (None,) * sum(widths[k + 1 :])) for k in range(len(widths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), to, strict=True)], schema=to)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = parse(path, text)
                found += [(k, *before, *row, *after) for (k, part), (before, after) in zip(enumerate(schemas), blank, strict=True) for row in getattr(file, part)]
                if len(found) >= GATHERED:
                    yield pack()
                    found.clear()
        if found:
            yield pack()

    return run, kind


def extract(sources: DataFrame, parse: Callable, schemas: dict[str, str], keep: bool = False) -> list[DataFrame]:
    """The parts (``defs``, ``calls``) of each (path, text); with ``keep`` each file is read once for all of them."""
    run, kind = _extract(parse, schemas)
    rows = sources.select("path", "text").where("path is not null").mapInArrow(run, kind)
    rows = _cut(rows) if keep else rows
    return [rows.where(F.col("part") == k).select(*(F.col(f"{part}_{c}").alias(c) for c in _names(schema))) for k, (part, schema) in enumerate(schemas.items())]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def definitions(sources: DataFrame) -> DataFrame:
    """Definitions of each (path, text)."""
    return extract(sources, _File, {"defs": DEFS})[0]


def raw_calls(sources: DataFrame) -> DataFrame:
    """Calls by the name that is called, with the function around them."""
    return extract(sources, _File, {"calls": CALLS})[0]


def graph(sources: DataFrame) -> Graph:
    return resolve(*extract(sources, _File, {"defs": DEFS, "calls": CALLS}, keep=True))


def resolve(defs: DataFrame, calls: DataFrame) -> Graph:
    """Names to functions: a bare call never names a method; of several candidates one in the caller's
    module wins, else the first; a name without candidates is an external function."""
    first = Window.partitionBy("qualified_name").orderBy("file", "ord")
    defs = defs.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    inner = _cut(defs.withColumn("node_id", F.xxhash64("qualified_name")))
    # One row for each name and module, and one for each name: joins on names then stay linear.
    best = lambda *keys, on="true": inner.where(on).groupBy(*keys).agg(F.min_by("node_id", F.struct("file", "ord")).alias("hit"))
    sides = []
    for kind, on in (("direct_call", "kind <> 'method'"), ("method_call", "true"), ("associated_call", "true")):
        near = best("name", "module_path", on=on).withColumnRenamed("hit", "near")
        far = best("name", on=on).withColumnRenamed("hit", "far")
        rows = calls.where(F.col("kind") == kind).withColumnRenamed("short", "name")
        sides.append(rows.join(near, ["name", "module_path"], "left").join(far, "name", "left"))
    hits = sides[0].unionByName(sides[1]).unionByName(sides[2]).join(inner.select(F.col("qualified_name").alias("caller"), F.col("node_id").alias("src")), "caller")
    hits = _cut(hits.withColumn("inner", F.coalesce("near", "far")).withColumn("dst", F.coalesce("inner", F.xxhash64(F.concat(F.lit("external "), "name")))))
    outer = hits.where("inner is null").select(F.col("dst").alias("node_id"), "name").distinct().select("node_id", "name", F.col("name").alias("qualified_name"), F.lit("").alias("module_path"), F.lit("external").alias("kind"))
    nodes = inner.drop("ord").unionByName(outer, allowMissingColumns=True)
    edges = hits.select("src", "dst", F.when(F.col("inner").isNull(), "unresolved").otherwise(F.col("kind")).alias("kind"), F.lit(1).alias("count"), "in_loop", "line")
    return Graph(nodes, _cut(merge_edges(edges)))
