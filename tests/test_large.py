"""Ways that larger tables take, on small ones: bounded tasks and loops, places, names, components, cells."""

import numpy as np
import pyarrow as pa
import pytest

from codeloom.operators import crates, flows, iterate, layout, navigate
from codeloom.operators import graph as ops
from codeloom.operators.graph import Graph
from codeloom.operators.nearest import beside
from codeloom.plans import catalog, more
from codeloom.sources import brace_source, python_source, rust_source

from .test_graph import NODE, node, rows


@pytest.mark.parametrize("parse, schema, text", [(python_source._File, python_source.DEFS, "def f():\n    g()\n"), (brace_source.BraceFile, python_source.DEFS, "func f() { g() }"), (rust_source.RustFile, rust_source.DEFS, "fn f() { g(); }")])
def test_files_share_a_batch(spark, parse, schema, text):
    run, kind = python_source._extract(parse, {"defs": schema})
    files = pa.RecordBatch.from_pydict({"path": [f"a/{k}.go" for k in range(500)], "text": [text] * 500})
    out = list(run(iter([files])))
    assert len(out) == 1 and out[0].num_rows == 500 and out[0].schema.names == kind.names


def test_both_parts_are_those_of_each(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    g(h())\n"), ("b.py", "def g():\n    pass\n"), ("c.py", None)], "path string, text string")
    defs, calls = python_source.extract(files, python_source._File, {"defs": python_source.DEFS, "calls": python_source.CALLS}, keep=True)
    assert rows(defs) == rows(python_source.definitions(files)) and rows(calls) == rows(python_source.raw_calls(files)) and calls.count() == 2


def test_cells_push_as_all_pairs():
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(2000, 2)) * 800
    for at in (spread, np.concatenate([spread, np.full((900, 2), 7.0)]), np.concatenate([spread, rng.normal(size=(900, 2)) * 3])):
        d = at[:, None] - at[None]
        want = (d * (1600 / np.maximum((d**2).sum(2), layout.EPS))[..., None]).sum(1)
        got = layout.Cells(len(at)).push(at, 40.0)
        off, size = np.sqrt(((got - want) ** 2).sum(1)), np.sqrt((want**2).sum(1))
        assert (off <= 0.05 * size + 0.01 * np.median(size)).all()
    none = np.zeros(0, np.int64)
    assert np.isfinite(layout.force(1500, none, none, 3)).all()
    assert np.abs(layout.force(1500, none, none, 1, exact=100) - layout.force(1500, none, none, 1, exact=2000)).max() < 1


def test_layout_query_places_every_node(spark):
    from codeloom.plans.fixture import graph

    sf = "/root/testdata/sf0.001"
    placed = catalog.queries()["layout_by_crate"](spark, sf)
    assert {r["node_id"] for r in placed.collect()} == {r["node_id"] for r in graph(spark, sf).nodes.collect()}


def random_defs(rng, n, files=2, names=3):
    out = []
    for k in range(n):
        start, length = int(rng.integers(1, 400)), int(rng.choice([0, 1, 5, 30, 200, -2]))
        module = "::".join(rng.choice(["a", "b", "c"], int(rng.integers(1, 4))))
        name = f"n{int(rng.integers(names))}"
        out.append(node(k, name, file=f"f{int(rng.integers(files))}", start_line=start, end_line=start + length, qualified_name=f"{module}::{name}", module_path=module))
    return out


def test_places_as_by_all_pairs(spark):
    rng = np.random.default_rng(2)
    defs = random_defs(rng, 120)
    g = Graph(spark.createDataFrame(defs, NODE), None)
    asked = sorted({(f"f{int(rng.integers(3))}", int(rng.integers(0, 700))) for _ in range(200)})
    places = spark.createDataFrame(asked, "file string, line int")
    at, nearest = [], []
    for file, line in asked:
        here = [d for d in defs if d["file"] == file]
        inside = [d for d in here if d["start_line"] <= line <= d["end_line"]]
        if inside:
            at.append((file, line, min(inside, key=lambda d: (d["end_line"] - d["start_line"], -d["start_line"], d["node_id"]))["node_id"]))
        gap = lambda d: max(0, d["start_line"] - line, line - d["end_line"])  # noqa: B023, E731
        if here:
            best = min(here, key=lambda d: (gap(d), -d["start_line"], d["node_id"]))
            nearest.append((file, line, best["node_id"], gap(best)))
    assert rows(ops.node_at(g, places)) == at and rows(ops.nearest_at(g, places)) == nearest


def test_places_meet_few_definitions(spark):
    defs = [node(k, "f", start_line=10 * k + 1, end_line=10 * k + 5) for k in range(2000)]
    places = spark.createDataFrame([("a.rs", 10 * k + 2) for k in range(2000)], "file string, line int")
    met = ops._around(spark.createDataFrame(defs, NODE), places)
    # One file: the join is by blocks of its lines, too, so no place is paired with all definitions of the file.
    assert met.count() == 2000 and "block" in met._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("after", [True, False])
@pytest.mark.parametrize("run", [1, 7, 4096])
def test_beside(spark, after, run):
    rng = np.random.default_rng(3)
    marks = [(int(rng.integers(2)), int(rng.integers(60)), k) for k in range(25)]
    asked = sorted({(int(rng.integers(3)), int(rng.integers(-5, 70))) for _ in range(60)})
    got = beside(spark.createDataFrame(asked, "k int, at int"), spark.createDataFrame(marks, "k int, at int, id int"), ["k"], ops.F.col("id"), after, run)
    want = []
    for k, at in asked:
        some = [(abs(m[1] - at), m[2], m[1]) for m in marks if m[0] == k and (m[1] > at if after else m[1] < at)]
        if some:
            want.append((k, at, min(some)[2], min(some)[1]))
    assert rows(got.select("k", "at", "mark.at", "mark.pay")) == want


def test_names_as_by_all_pairs(spark):
    rng = np.random.default_rng(4)
    defs = random_defs(rng, 80)
    g = Graph(spark.createDataFrame(defs, NODE), None)
    words = ["a::n0", "b::a::n1", "n2", "x::n0", "c::c::n1", "a::b::gone", "n1::a::n1"]
    asked = sorted({(f"f{int(rng.integers(3))}", int(rng.integers(0, 500)), str(rng.choice(words))) for _ in range(80)})
    want = []
    for file, line, word in asked:
        some = [d for d in defs if d["name"] == word.split("::")[-1]]
        if some:
            best = min(some, key=lambda d: (-len(set(word.split("::")) & set(d["qualified_name"].split("::"))), d["file"] != file, abs(d["start_line"] - line), d["node_id"]))  # noqa: B023
            want.append((file, line, word, best["node_id"]))
    assert rows(navigate.node_named(g, spark.createDataFrame(asked, "file string, line int, word string"))) == want
    old = [(k, str(rng.choice(["a::n0", "b::n1", "old::n2", "gone::n0"])), f"f{int(rng.integers(3))}", int(rng.integers(0, 500))) for k in range(60)]
    found = []
    for k, q, file, line in old:
        same = [d["node_id"] for d in defs if d["qualified_name"] == q]
        near = [(abs(d["start_line"] - line), d["node_id"]) for d in defs if (d["name"], d["file"]) == (q.split("::")[-1], file)]
        if same or near:
            found.append((k, min(same) if same else min(near)[1]))
    assert rows(navigate.relocate(g, spark.createDataFrame(old, "old_id int, qualified_name string, file string, start_line int"))) == found


def random_graph(spark, rng, n, m):
    pairs = sorted({(int(rng.integers(n)), int(rng.integers(n))) for _ in range(m)} | {(k, k + 1) for k in range(0, 12)} | {(12, 0)})
    defs = [node(k, f"f{k}", "external" if k % 9 == 8 else "function") for k in range(n)]
    return pairs, Graph(spark.createDataFrame(defs, NODE), spark.createDataFrame([(a, b, "direct_call", 1, False, 1) for a, b in pairs], "src long, dst long, kind string, count long, in_loop boolean, line long"))


def reached(pairs, start):
    depth, front = {start: 0}, [start]
    while front:
        front = sorted({b for a, b in pairs if a in front} - set(depth))
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    return depth


def test_large_and_small_ways_agree(spark):
    pairs, g = random_graph(spark, np.random.default_rng(5), 60, 70)
    all_ = {k: reached(pairs, k) for k in range(60)}
    for local in (0, 10**6):
        assert dict(rows(iterate.reachable(g, [3], local=local).select("node_id", "depth"))) == all_[3]
        want = sorted((k, min(x for x in all_[k] if k in all_[x])) for k in all_ if any(x != k and k in all_[x] for x in all_[k]))
        assert rows(iterate.cycles(g, local=local).select("node_id", "component")) == want
    roots = g.nodes.select("node_id")
    counts = [(k, sum(1 for x in all_[k] if x != k and x % 9 != 8)) for k in range(60)]
    for few, hub in ((100, 64), (0, 2), (0, 5), (0, 1000)):
        assert rows(flows.reach_counts(g, roots, few=few, hub=hub)) == counts
    for local in (0, 10**6):
        paths = flows.shortest_paths(g, [3, 5], 11, local=local).select("path")
        hops = min(all_[s].get(11, 99) for s in (3, 5))
        grow = [[s] for s in (3, 5)]
        for _ in range(hops):
            grow = [[*p, b] for p in grow for a, b in pairs if a == p[-1]]
        assert [r["path"] for r in paths.collect()] == sorted(p for p in grow if p[-1] == 11)[:6]


def test_edges_are_written_once(spark):
    from codeloom.plans.fixture import graph

    g = graph(spark, "/root/testdata/sf0.001", True)
    assert g.edges is g.edges and g.edges.rows == g.edges.count() and g.nodes.rows == g.nodes.count()
    assert "Window" not in g.edges._jdf.queryExecution().optimizedPlan().toString()


def test_groups_hold_every_node(spark):
    g = catalog.graph(spark, "/root/testdata/sf0.001")
    assert crates.group_of(g).count() == g.nodes.count() and more.GRAPH["layout_by_crate"][1] is None
