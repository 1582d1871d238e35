"""The graph as text for other tools, and as a store of tables.

Texts come as (part, ord, line) rows that ``write_text`` writes in order without collecting them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph, cyclomatic

VERSION = 1


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _numbered(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind", F.concat_ws(" ", F.lpad(F.col("src").cast("string"), 20, "0"), F.lpad(F.col("dst").cast("string"), 20, "0"), "kind").alias("ord"))


def dot(g: Graph) -> DataFrame:
    """Graphviz: external functions dashed, complex ones red."""
    quoted = lambda c: _replaced(F.col(c), ("\\", "\\\\"), ('"', '\\"'), ("\n", " "))
    look = F.when(F.col("kind") == "external", ", style=dashed, color=gray").when(cyclomatic() > 10, ", color=red").otherwise("")
    nodes = g.nodes.select(F.lit(1).alias("part"), F.lpad(F.col("node_id").cast("string"), 20, "0").alias("ord"), F.concat(F.lit("  "), F.col("node_id").cast("string"), F.lit(' [label="'), quoted("name"), F.lit('", tooltip="'), quoted("qualified_name"), F.lit('"'), look, F.lit("];")).alias("line"))
    edges = _numbered(g.edges).select(F.lit(2).alias("part"), "ord", F.format_string('  %s -> %s [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), "kind").alias("line"))
    frame = g.nodes.sparkSession.createDataFrame([(0, "", 'digraph codeloom {\n  rankdir=LR;\n  node [shape=box, fontname="monospace"];'), (3, "", "}")], "part int, ord string, line string")
    return frame.unionByName(nodes).unionByName(edges)


def graphml(g: Graph) -> DataFrame:
    """GraphML with names, kinds and complexity; edges have their ends and kind as id."""
    safe = lambda c: _replaced(F.col(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    data = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), value, F.lit("</data>"))
    node = F.concat(F.lit('    <node id="'), F.col("node_id").cast("string"), F.lit('">'), data("name", safe("name")), data("qname", safe("qualified_name")), data("kind", F.col("kind")), data("cc", F.coalesce(cyclomatic(), F.lit(1)).cast("string")), F.lit("</node>"))
    nodes = g.nodes.select(F.lit(1).alias("part"), F.lpad(F.col("node_id").cast("string"), 20, "0").alias("ord"), node.alias("line"))
    edge = F.concat(F.format_string('    <edge id="e%s-%s-%s" source="%s" target="%s">', *(F.col(c).cast("string") for c in ("src", "dst", "kind", "src", "dst"))), data("ekind", F.col("kind")), F.lit("</edge>"))
    edges = _numbered(g.edges).select(F.lit(2).alias("part"), "ord", edge.alias("line"))
    keys = [("name", "node", "name", "string"), ("qname", "node", "qualified_name", "string"), ("kind", "node", "kind", "string"), ("cc", "node", "cyclomatic", "int"), ("ekind", "edge", "kind", "string")]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'  <key id="{a}" for="{b}" attr.name="{c}" attr.type="{d}"/>\n' for a, b, c, d in keys) + '  <graph id="G" edgedefault="directed">'
    frame = g.nodes.sparkSession.createDataFrame([(0, "", head), (3, "", "  </graph>\n</graphml>")], "part int, ord string, line string")
    return frame.unionByName(nodes).unionByName(edges)


def write_text(lines: DataFrame, path: str) -> None:
    """Part files that, one after another, are the text."""
    lines.orderBy("part", "ord").select("line").write.mode("overwrite").text(path)


def json_rows(g: Graph) -> DataFrame:
    """(part, row): nodes and edges as JSON."""
    return g.nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("*")).alias("row")).unionByName(g.edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("*")).alias("row")))


def _paths(spark: SparkSession, *paths: str):
    jvm = spark._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found


def save_store(g: Graph, path: str, meta: dict[str, str] | None = None) -> None:
    """Nodes and edges in a folder beside the store, last the meta rows, then in its place.

    A graph that was loaded from the store may be saved there again. A store without meta rows is not complete.
    """
    spark = g.nodes.sparkSession
    new = f"{path.rstrip('/')}.new"
    fs, (at, staged) = _paths(spark, path, new)
    fs.delete(staged, True)
    g.nodes.write.parquet(f"{new}/nodes")
    g.edges.write.parquet(f"{new}/edges")
    rows = {"version": str(VERSION)} | (meta or {}) | {"version": str(VERSION), "schema": json.dumps([g.nodes.columns, g.edges.columns])}
    spark.createDataFrame(list(rows.items()), "key string, value string").coalesce(1).write.parquet(f"{new}/meta")
    fs.delete(at, True)
    fs.rename(staged, at)


def store_meta(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The meta rows of a complete store."""
    fs, (at,) = _paths(spark, f"{path}/meta/_SUCCESS")
    return {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()} if fs.exists(at) else None


def load_store(spark: SparkSession, path: str) -> Graph | None:
    """The stored graph; None if it is not there, not complete or of another version."""
    meta = store_meta(spark, path)
    if meta is None or meta.get("version") != str(VERSION):
        return None
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def store_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """One row: how many nodes and edges are stored."""
    g = load_store(spark, path)
    return None if g is None else g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))  # one row each


def save_fragments(rows: DataFrame, path: str) -> None:
    """What extraction gave for each file, by file name in as many folders as its hash has first digits."""
    rows.withColumn("shard", F.substring(F.sha2("file", 256), 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(path)


def load_fragments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows; none if there is no such store."""
    fs, (at,) = _paths(spark, f"{path}/_SUCCESS")
    return spark.read.schema(schema).parquet(path).drop("shard") if fs.exists(at) else spark.createDataFrame([], schema)


def report_rows(g: Graph, metrics: DataFrame, diagnostics: DataFrame, suggestions: DataFrame, vertical: str) -> DataFrame:
    """(part, row): the whole report as JSON rows: vertical, nodes, edges, metrics, diagnostics and suggestions."""
    spark = g.nodes.sparkSession
    head = spark.createDataFrame([("vertical", json.dumps(vertical))], "part string, row string")
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
    return head.unionByName(json_rows(g)).unionByName(part(metrics, "metric")).unionByName(part(diagnostics, "diagnostic")).unionByName(part(suggestions, "suggestion"))
