"""Flows, extraction, exports, stores and incremental work on small inputs."""

import pytest

from codeloom.functions import text
from codeloom.operators import flows, lenses
from codeloom.operators.graph import Graph
from codeloom.sources import export, python_source
from codeloom.streaming import incremental

SOURCE = '''
import os

class Box:
    async def get(self, key):
        if key and key.ok or not key:
            return await self.load(key)

    def load(self, key):
        for x in key:
            helper(x)

def helper(x):
    return os.stat(x)

def main():
    def inner():
        helper(1)
    Box().load([])
    get()
'''


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("src/app/box.py", SOURCE), ("broken.py", "def ("), ("empty.py", ""), ("none.py", None)], "path string, text string")
    return python_source.resolve(python_source.definitions(files), python_source.raw_calls(files))


def test_python_extraction(graph):
    rows = {r["qualified_name"]: r for r in graph.nodes.collect()}
    assert {k for k, r in rows.items() if r["kind"] != "external"} == {f"app::box::{x}" for x in ("Box::get", "Box::load", "helper", "main", "main::inner")}
    get = rows["app::box::Box::get"]
    assert (get["kind"], get["is_async"], get["awaits"], get["decision_points"], get["parameters"]) == ("method", True, 1, 3, 2)
    # A bare call never names a method, so get() and Box() are external.
    assert {k for k, r in rows.items() if r["kind"] == "external"} == {"stat", "get", "Box"}
    names = {r["node_id"]: r["name"] for r in rows.values()}
    found = {(names[r["src"]], names[r["dst"]], r["kind"], r["in_loop"]) for r in graph.edges.collect()}
    assert found == {("get", "load", "method_call", False), ("load", "helper", "direct_call", True), ("helper", "stat", "unresolved", False), ("inner", "helper", "direct_call", False), ("main", "load", "method_call", False), ("main", "get", "unresolved", False), ("main", "Box", "unresolved", False)}


def small(spark, pairs, **flags):
    n = max(max(p) for p in pairs) + 1
    rows = [(k, f"f{k}", f"app::f{k}", "app", "function", False, k in flags.get("is_async", ()), False, False) for k in range(n)]
    nodes = spark.createDataFrame(rows, "node_id long, name string, qualified_name string, module_path string, kind string, is_pub boolean, is_async boolean, is_test boolean, is_exported boolean")
    return Graph(nodes, spark.createDataFrame([(a, b, "direct_call", 1, False, 10 * b) for a, b in pairs], "src long, dst long, kind string, count long, in_loop boolean, line long"))


def test_all_shortest_paths(spark):
    g = small(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (0, 5), (5, 6), (6, 4)])
    paths = lambda **k: [r["path"] for r in flows.shortest_paths(g, [0], 4, **k).collect()]
    assert paths() == [[0, 1, 3, 4], [0, 2, 3, 4], [0, 5, 6, 4]]
    assert paths(max_paths=2) == [[0, 1, 3, 4], [0, 2, 3, 4]]
    assert flows.shortest_paths(g, [4], 0).collect() == []
    assert [flows.connection(g, *p) for p in ((0, 0), (0, 4), (4, 0), (1, 2))] == ["same", "downstream", "upstream", "unconnected"]


def test_call_tree_expands_once(spark):
    g = small(spark, [(0, 1), (0, 2), (1, 2), (2, 3)])
    rows = [(r["depth"], r["node_id"], r["repeat"]) for r in flows.call_tree(g, 0).orderBy("ord").collect()]
    assert rows == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, False), (1, 2, True)]
    assert [r["node_id"] for r in flows.call_tree(g, 0, width=1).where("truncated").collect()] == [0]


def test_suggestions(spark):
    assert [text.osa_distance(*p) for p in (("gird", "grid"), ("", "ab"), ("abc", "abc"), ("ca", "abc"))] == [1, 2, 0, 3]
    defs = spark.createDataFrame([(1, "grid", "app::grid"), (2, "run", "app::gather::include::round"), (3, "other", "app::other")], "node_id long, name string, qualified_name string")
    assert [r["node_id"] for r in text.suggest(defs, "gird").collect()] == [1, 2]


def test_verticals_and_layers(spark, graph):
    assert lenses.detect_vertical(graph) == "unknown"
    df = spark.createDataFrame([("app::domain::x",), ("app::db",), ("x::y",), ("domain::web",)], "p string").select(lenses.layer(lenses.F.col("p"), lenses.LAYERS).alias("k"))
    assert [r["k"] for r in df.collect()] == [0, 3, None, 3]


def test_store_and_text(spark, graph, tmp_path):
    at = str(tmp_path / "store")
    assert export.load_store(spark, at) is None
    export.save_store(graph, at)
    again = export.load_store(spark, at)
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, graph.edges.collect()))
    export.write_text(export.dot(graph), str(tmp_path / "dot"))
    lines = [x for f in sorted((tmp_path / "dot").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and len(lines) == 4 + graph.nodes.count() + graph.edges.count()


def test_incremental_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "path string, text string")
    _, same = incremental.split(files, files.limit(0).withColumn("hash", lenses.F.lit("")))
    assert same.count() == 0
    old = spark.createDataFrame([("a", "x"), ("b", "old"), ("gone", "z")], "path string, text string").select("path", lenses.F.sha2("text", 256).alias("hash"))
    assert incremental.stats(files, old).first().asDict() == {"total": 3, "reused": 1, "reparsed": 2}
    files.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    incremental.follow(stream, lambda df: df.where("text is not null"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_every_definition_has_its_places(spark):
    from codeloom.plans import catalog
    from codeloom.plans.fixture import graph as fixture

    sf = "/root/testdata/sf0.001"
    defs = {r["node_id"] for r in fixture(spark, sf).defs.where("start_line + 3 <= end_line").collect()}  # its place is inside
    assert {r["node_id"] for r in catalog.queries()["node_at"](spark, sf).collect()} == defs


def test_registered_whole_reach(spark):
    from codeloom.plans import catalog
    from codeloom.plans.fixture import graph as fixture

    sf = "/root/testdata/sf0.001"
    into, front, depth = {}, {7}, {7: 0}
    for r in fixture(spark, sf).edges.collect():
        into.setdefault(r["dst"], set()).add(r["src"])
    while front:
        front = {y for x in front for y in into.get(x, ())} - set(depth)
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    assert max(depth.values()) > 6
    tiers = {r["node_id"] for r in flows.entry_tiers(fixture(spark, sf)).collect()}
    got = {r["node_id"]: r["hops"] for r in catalog.queries()["flows_from_entries"](spark, sf).collect()}
    assert got == {k: d for k, d in depth.items() if k in tiers}
