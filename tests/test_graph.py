"""Graph operators on a small hand-built graph and against their SQL."""

import duckdb
import pytest

from codeloom.operators import graph as ops
from codeloom.operators import iterate, lenses
from codeloom.operators.graph import Graph
from codeloom.plans import catalog, more

SF = "/root/testdata/sf0.001"
NODE = "node_id long, name string, qualified_name string, module_path string, kind string, file string, start_line int, end_line int, is_pub boolean, is_async boolean, is_test boolean, is_unsafe boolean, is_exported boolean, is_example boolean, decision_points int, parameters int, lines_of_code int, max_nesting int, allocations int, awaits int, unsafe_blocks int"


def node(k, name, kind="function", **more):
    row = {"node_id": k, "name": name, "qualified_name": f"app::{name}", "module_path": "app::core", "kind": kind, "file": "a.rs", "start_line": 10 * k + 1, "end_line": 10 * k + 5}
    row |= dict.fromkeys(["is_pub", "is_async", "is_test", "is_unsafe", "is_exported", "is_example"], False)
    row |= dict.fromkeys(["decision_points", "parameters", "lines_of_code", "max_nesting", "allocations", "awaits", "unsafe_blocks"], 0)
    return row | more


@pytest.fixture(scope="module")
def app(spark):
    nodes = [node(0, "main"), node(1, "run"), node(2, "parse", decision_points=25), node(3, "check", is_test=True), node(4, "loner"), node(5, "std::fs::read", "external")]
    edges = [(0, 1), (1, 2), (2, 1), (3, 2), (3, 5), (2, 2)]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(a, b, "direct_call", 1, False, 3) for a, b in edges], "src long, dst long, kind string, count long, in_loop boolean, line long"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_entries(app):
    assert {(r["node_id"], r["entry"]) for r in ops.entry_kinds(app).collect()} == {(0, "main"), (3, "test"), (4, "root")}


def test_reachable_and_paths(app):
    assert rows(iterate.reachable(app, [0])) == [(0, 0), (1, 1), (2, 2)]
    assert iterate.shortest_path(app, 0, 2) == [0, 1, 2]
    assert iterate.shortest_path(app, 4, 2) == []
    assert rows(iterate.impact(app, 2)) == [(1, 2), (2, 1)]


def test_cycles(app, spark):
    assert {r["node_id"] for r in iterate.cycles(app).collect()} == {1, 2}
    ring = [(k, k % 5 + (k // 5) * 5 + 1 if k % 5 < 4 else (k // 5) * 5) for k in range(10)] + [(4, 5)]
    g = Graph(app.nodes, spark.createDataFrame([(a, b, "direct_call", 1, False, 1) for a, b in ring], app.edges.schema))
    assert rows(iterate.cycles(g).select("component", "node_id")) == [(0, k) for k in range(5)] + [(5, k) for k in range(5, 10)]


def test_exclude_drops_tests_and_their_externals(app):
    kept = ops.exclude(app)
    assert {r["node_id"] for r in kept.nodes.collect()} == {0, 1, 2, 4}
    assert kept.edges.count() == 4


def test_places(app, spark):
    places = spark.createDataFrame([("a.rs", 12), ("a.rs", 17), ("a.rs", 18)], "file string, line int")
    assert rows(ops.node_at(app, places)) == [("a.rs", 12, 1)]
    assert [(r["line"], r["node_id"]) for r in ops.nearest_at(app, places).orderBy("line").collect()] == [(12, 1), (17, 1), (18, 2)]


def test_rules(app):
    assert rows(lenses.complexity(app)) == [("high_complexity", "high", 2, 26.0)]
    assert rows(lenses.self_recursion(app)) == [("self_recursion", "low", 2, 1.0)]


def test_empty_graph(app):
    g = Graph(app.nodes.limit(0), app.edges.limit(0))
    assert ops.degrees(g).count() == 0
    assert iterate.reachable(g, [0]).count() == 0
    assert iterate.cycles(g).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def whole(spark):
    """The fixture graph, read once."""
    g = catalog.graph(spark, SF)
    return Graph(g.nodes.cache(), g.edges.cache())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, whole, name):
    on_graph = catalog.GRAPH | more.GRAPH
    got = on_graph[name][0](whole) if name in on_graph else catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(str([plain(x) for x in r]) for r in cur.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in got.select(*names).collect()) == want
