"""A call graph derived from the part, supplier and lineitem tables, in SQL that other engines run too.

Parts are functions, suppliers external functions, and each line of an order calls the next one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph, merge_edges
from codeloom.operators.iterate import _cut

NODES = """
base AS (
  SELECT p_partkey AS node_id, CASE WHEN p_partkey IN (0, 1) THEN 'main' ELSE replace(p_name, ' ', '_') END AS name,
    concat(lower(p_type), '::m', cast(p_size % 8 AS string), CASE WHEN p_partkey % 3 = 0 THEN concat('::', replace(p_brand, '#', '')) ELSE '' END) AS module_path,
    CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind, concat(lower(p_type), '/m', cast(p_size % 8 AS string), '.rs') AS file,
    p_partkey % 2 = 0 AS is_pub, p_partkey % 11 = 0 AS is_async, p_partkey % 13 = 0 AS is_test, p_partkey % 17 = 0 AS is_unsafe, p_partkey % 19 = 0 AS is_exported, p_partkey % 23 = 0 AS is_example,
    p_size % 25 AS decision_points, p_size % 9 AS parameters, 2 * p_size AS lines_of_code, p_size % 7 AS max_nesting, p_size % 23 AS allocations, p_size % 4 AS awaits,
    CASE WHEN p_partkey % 17 = 0 THEN p_size % 5 ELSE 0 END AS unsafe_blocks
  FROM part),
ranked AS (
  SELECT base.*, row_number() OVER (PARTITION BY module_path, name ORDER BY node_id) AS k, row_number() OVER (PARTITION BY file ORDER BY node_id) AS place FROM base),
nodes AS (
  SELECT node_id, name, concat(module_path, '::', name, CASE WHEN k > 1 THEN concat('#', cast(k AS string)) ELSE '' END) AS qualified_name, module_path, kind, file,
    cast(1 + 100 * (place - 1) AS int) AS start_line, cast(100 * (place - 1) + lines_of_code AS int) AS end_line,
    is_pub, is_async, is_test, is_unsafe, is_exported, is_example, decision_points, parameters, lines_of_code, max_nesting, allocations, awaits, unsafe_blocks
  FROM ranked
  UNION ALL
  SELECT s_suppkey + (SELECT count(*) FROM part), x.name, x.name, '', 'external', CAST(NULL AS string), 0, 0, false, false, false, false, false, false, 0, 0, 0, 0, 0, 0, 0
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN concat('std::fs::f', cast(s_suppkey AS string)) WHEN s_suppkey % 10 = 1 THEN concat('pkg', cast(s_suppkey AS string), '::Vec::clone') WHEN s_suppkey % 10 = 2 THEN concat('pkg', cast(s_suppkey AS string), '::reqwest::Client::new')
    WHEN s_suppkey % 10 = 3 THEN concat('pkg', cast(s_suppkey AS string), '::TcpListener::bind') WHEN s_suppkey % 10 = 4 THEN concat('pkg', cast(s_suppkey AS string), '::unbounded_channel') ELSE concat('ext::f', cast(s_suppkey AS string)) END AS name FROM supplier) x)
"""

CALLS = """
steps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus, l_linenumber,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) AS callee
  FROM lineitem),
calls AS (
  SELECT l_partkey AS src, callee AS dst, CASE WHEN l_discount >= 0.095 THEN 'spawn' WHEN l_returnflag = 'A' THEN 'direct_call' WHEN l_returnflag = 'N' THEN 'method_call' ELSE 'associated_call' END AS kind, l_linestatus = 'F' AS in_loop,
    l_orderkey AS line, l_linenumber AS col, l_orderkey % 9 = 0 AS blocking_ok, l_orderkey % 4 = 0 AS awaited
  FROM steps WHERE l_quantity >= 47 AND callee IS NOT NULL
  UNION ALL
  SELECT l_partkey, l_suppkey + (SELECT count(*) FROM part), 'unresolved', l_linestatus = 'F', l_orderkey, l_linenumber, l_orderkey % 9 = 0, l_orderkey % 4 = 0 FROM steps WHERE l_quantity >= 47)
"""

EDGES = CALLS.rstrip() + """,
edges AS (SELECT src, dst, kind, count(*) AS count, bool_or(in_loop) AS in_loop, min(line) AS line, min(CASE WHEN in_loop THEN line END) AS loop_line, bool_and(blocking_ok) AS blocking_ok, bool_and(awaited) AS awaited FROM calls GROUP BY src, dst, kind)
"""

WITH = f"WITH RECURSIVE {NODES.strip()},\n{EDGES.strip()}"


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("part", "supplier", "lineitem")}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw calls: a row for each call site."""
    return spark.sql(f"WITH {_bound(CALLS)} SELECT * FROM calls", **_views(spark, sf_dir))


class _Fixture(Graph):
    """The graph with its edges written once, when first asked for; with ``keep`` its nodes, too."""

    def __init__(self, nodes: DataFrame, calls: DataFrame, keep: bool):
        self._nodes, self._calls, self._keep = nodes, calls, keep

    @cached_property
    def nodes(self) -> DataFrame:
        return _cut(self._nodes) if self._keep else self._nodes

    @cached_property
    def edges(self) -> DataFrame:
        return _cut(merge_edges(self._calls))


def graph(spark: SparkSession, sf_dir: str, keep: bool = False) -> Graph:
    """``keep``: for queries that read what windows tell of the nodes more than once."""
    nodes = spark.sql(f"WITH {_bound(NODES)} SELECT * FROM nodes", **_views(spark, sf_dir))
    return _Fixture(nodes, calls(spark, sf_dir).withColumn("count", F.lit(1)), keep)


def _bound(sql: str) -> str:
    for name in ("part", "supplier", "lineitem"):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return sql


#: The packages of the fixture: the types of parts by name, each depending on two before it.
CRATES = """
cr AS (SELECT idx, name, name AS dir, true AS member, idx % 5 <> 0 AS default_member, idx % 7 = 1 AS is_root, idx % 4 = 0 AS has_tests
  FROM (SELECT name, cast(row_number() OVER (ORDER BY name) - 1 AS int) AS idx FROM (SELECT DISTINCT lower(p_type) AS name FROM part) x) y)
"""


def crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {_bound(CRATES)} SELECT * FROM cr", **_views(spark, sf_dir))
    deps = F.when(F.col("idx") > 0, F.array_distinct(F.array(F.floor(F.col("idx") / 2).cast("int"), F.floor(F.col("idx") / 3).cast("int")))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("deps", deps).withColumn("dev_deps", F.when(F.col("idx") % 6 == 5, F.array((F.col("idx") - 4).cast("int"))).otherwise(F.array().cast("array<int>")))


def file_lines(g: Graph) -> DataFrame:
    return g.defs.groupBy("file").agg(F.max("end_line").cast("long").alias("lines"))
