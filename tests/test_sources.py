"""Scanning, stores, staleness, incremental work, JSON and texts, layout, crates and groups."""

import json
import os
import time

import numpy as np
import pytest

from codeloom.operators import advice, crates, flows, layout, lenses, navigate
from codeloom.operators.graph import Graph
from codeloom.sources import contract, export, rust_source, scan
from codeloom.streaming import incremental

from .test_graph import NODE, node


def write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    write(root, {
        "Cargo.toml": '[workspace]\nmembers = ["libs/*"]\nexclude = ["libs/old"]\ndefault-members = ["libs/app"]\n[workspace.dependencies]\ncore = { path = "libs/core" }\n',
        "libs/app/Cargo.toml": '[package]\nname = "app"\n[dependencies]\ncore = { workspace = true }\nserde = "1"\n[dev-dependencies]\nkit = { path = "../../kit" }\ncore = { workspace = true }\n',
        "libs/app/src/main.rs": "fn main() { core::run(); }\n",
        "libs/core/Cargo.toml": '[package]\nname = "core"\n[target."cfg(unix)".dependencies]\nutil = { path = "../util" }\n',
        "libs/core/src/lib.rs": "pub fn run() { help() }\nfn help() {}\n",
        "libs/util/Cargo.toml": '[package]\nname = "util"\n',
        "libs/util/src/lib.rs": "pub fn unused() {}\n",
        "libs/old/Cargo.toml": '[package]\nname = "old"\n',
        "kit/Cargo.toml": '[package]\nname = "kit"\n',
        "kit/src/lib.rs": "pub fn kit() {}\n",
        ".gitignore": "*.gen.rs\n/private/\n!keep.gen.rs\n",
        "a.gen.rs": "", "keep.gen.rs": "", "private/x.rs": "", "libs/private/y.rs": "", "target/z.rs": "", "web/a.ts": "", "skip/b.rs": "",
    })
    return root


def test_files_languages_and_crates(repo):
    names = [x.relative_to(repo).as_posix() for x in scan.scan_files(repo, ["rs"], ["skip"])]
    assert names == sorted(["keep.gen.rs", "kit/src/lib.rs", "libs/app/src/main.rs", "libs/core/src/lib.rs", "libs/private/y.rs", "libs/util/src/lib.rs"])
    assert scan.scan_languages(repo) == ["rust", "typescript"]
    found = {c.name: c for c in scan.scan_crates(repo)}
    assert set(found) == {"app", "core", "util", "kit"}
    by = {c.idx: c.name for c in found.values()}
    assert [by[x] for x in found["app"].deps] == ["core"] and [by[x] for x in found["app"].dev_deps] == ["kit"] and [by[x] for x in found["core"].deps] == ["util"]
    assert found["app"].is_root and found["app"].default_member and not found["core"].default_member and found["core"].member and not found["kit"].member
    assert scan.scan_crates(repo / "web") == []


def test_config(repo):
    assert scan.scan_config(repo).blocking_depth == 4
    at = scan.init_config(repo)
    with pytest.raises(FileExistsError):
        scan.init_config(repo)
    assert scan.scan_config(repo / "libs/app") == scan.Config()
    at.write_text("blocking_depth = 2\n[weights]\nlatency = 2.0\n")
    assert scan.scan_config(repo / "libs").weights == {"latency": 2.0}
    for bad in ("depth = 1\n", 'architecture = ["onions"]\n', "heap_sensitivity = -1\n"):
        at.write_text(bad)
        with pytest.raises(ValueError):
            scan.scan_config(repo)


def test_analysis_store_and_staleness(spark, repo, tmp_path):
    store, config, stages = str(tmp_path / "stores" / "one"), scan.Config(), []
    assert scan.staleness(spark, repo, store) == "missing"
    (repo / "bad.rs").write_bytes(b"\xff\xfe fn x() {}")
    counters = scan.Counter()
    g = scan.analyze(spark, repo, config, store, stages.append, counters)
    assert counters == {"files_discovered": 9 - 1, "files_skipped": 1} and stages[0] == "discovering" and stages[-1] == "done"
    assert {"app::main", "core::run", "core::help"} <= {r["qualified_name"] for r in g.nodes.collect()}
    assert scan.staleness(spark, repo, store) is None and scan.load_or_analyze(spark, repo, store)[1] is None
    assert export.store_summary(spark, store).first()["nodes"] == g.nodes.count()
    export.save_store(export.load_store(spark, store), store, export.store_meta(spark, store))  # onto itself
    assert scan.staleness(spark, repo, store) is None
    assert scan.staleness(spark, str(repo) + "/.", store) == "root_changed"
    assert scan.staleness(spark, repo, store, scan.Config(language="go")) == "extractor_changed"
    assert scan.staleness(spark, repo, store, scan.Config(store_enabled=False)) == "disabled"
    later = time.time() + 60
    os.utime(repo / "libs/core/src/lib.rs", (later, later))
    assert scan.staleness(spark, repo, store) == "files_modified 1"
    (repo / "new.rs").write_text("")
    assert scan.staleness(spark, repo, store).startswith("file_set_changed")
    (repo / "libs/util/Cargo.toml").write_text('[package]\nname = "utils"\n')
    assert scan.load_or_analyze(spark, repo, store)[1] == "crates_changed"
    with pytest.raises(FileNotFoundError):
        scan.analyze(spark, repo, scan.Config(language="go"))
    assert scan.list_stores(tmp_path / "stores") == [("one", 0)]
    assert scan.clean_stores(tmp_path / "stores", keep=("one",)) == [] and scan.clean_stores(tmp_path / "stores") == ["one"] and scan.clean_stores(tmp_path / "stores", yes=True) == ["one"]
    assert scan.list_stores(tmp_path / "stores") == []


def test_incremental_extraction_is_the_whole_one(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    old = files([("a.rs", "fn a() {}"), ("b.rs", "fn b() {}"), ("c.rs", "fn c() {}")])
    schema = rust_source.DEFS + ", hash string"
    first = incremental.update(old, export.load_fragments(spark, str(tmp_path / "f"), schema), rust_source.definitions)
    export.save_fragments(first, str(tmp_path / "f"))
    cached = export.load_fragments(spark, str(tmp_path / "f"), schema)
    new = files([("a.rs", "fn a() {}"), ("b.rs", "fn b2() {}"), ("d.rs", "fn d() {}")])
    read = []

    def extract(sources):
        read.extend(r["path"] for r in sources.collect())
        return rust_source.definitions(sources)

    got = incremental.update(new, cached, extract).drop("hash")
    assert sorted(read) == ["b.rs", "d.rs"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rust_source.definitions(new).select(got.columns).collect()))


EDGE = "src long, dst long, kind string, count long, in_loop boolean, line long, loop_line long, blocking_ok boolean, awaited boolean"


@pytest.fixture(scope="module")
def app(spark):
    names = ["a::main", "a::step", "b::C::go", "b::C::stop", "c::low", "std::fs::read", "x::Vec::clone", "Client::builder"]
    nodes = [node(k, n.split("::")[-1], "external" if k > 4 else "method" if "::C" in n else "function", qualified_name=n, module_path="" if k > 4 else n.rsplit("::", 1)[0], is_async=k == 1, is_pub=True) for k, n in enumerate(names)]
    e = lambda a, b, kind="direct_call", **m: (a, b, kind, m.get("n", 1), "loop" in m, m.get("line", 10 * a + b), m.get("loop"), m.get("ok", False), m.get("waits", False))
    edges = [e(0, 1), e(1, 2), e(2, 3), e(3, 2), e(2, 5, "unresolved", loop=7), e(1, 5, "unresolved", ok=True), e(4, 5, "unresolved", waits=True), e(3, 6, "unresolved", loop=8), e(0, 4, "spawn"), e(0, 7, "unresolved"), e(2, 4), e(4, 3, "method_call")]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocking(app):
    assert rows(flows.blocking_levels(app, 4).select("node_id", "level")) == [(2, 1), (3, 2), (4, 3), (5, 0)]
    assert rows(flows.async_calls(app).select("node_id", "depth", "calls", "target")) == [(1, 2, 1, 2)]
    assert rows(flows.loop_calls(app).select("code", "src", "dst", "line")) == [("clone_in_loop", 3, 6, 8), ("n_plus_one", 2, 5, 7)]
    assert flows.patterns(("mine",), ("fs::*",))[-1] == "mine" and "fs::*" not in flows.patterns(("mine",), ("fs::*",))
    levels = flows.blocking_levels(app, 4)
    assert rows(flows.sinks(levels)) == [(2, 5), (3, 5), (4, 5), (5, 5)]


def test_findings_and_suggestions(app):
    kinds = {r["kind"]: r for r in advice.findings(app).collect()}
    assert set(kinds) == {"async_blocking", "n_plus_one", "clone_in_loop", "no_http_timeout", "cycle"} and kinds["async_blocking"]["weight"] == 101
    found = lenses.diagnostics(app)
    told = advice.suggestions(found, lenses.cyclicity(app), "backend", {"latency": 2.0}).collect()
    assert told[0]["priority"] == 100 and {"cycles", "vertical", "async_blocking"} <= {r["rule"] for r in told}
    assert [r["priority"] for r in told] == sorted((r["priority"] for r in told), reverse=True)
    assert rows(advice.extended_suggestions(lenses.extended(app)).select("rule", "priority")) == [("recursion", 60 + 2 * 3)]


def test_groups_and_layers(app):
    assert rows(crates.group_layers(app)) == [("<external>", 3, 3), ("a", 0, 2), ("b", 1, 2), ("c", 2, 1)]
    one = Graph(app.nodes.where("module_path like 'b%' or kind = 'external'"), app.edges)
    assert {r["grp"] for r in crates.group_of(one).collect()} == {"<external>", "b::C"}


def test_crate_chains(spark):
    table = scan.crates_table(spark, [scan.Crate(0, "a", "a", True, True, True, False, [1, 2], []), scan.Crate(1, "b", "b", True, False, False, True, [2], [3]), scan.Crate(2, "c", "c"), scan.Crate(3, "d", "d"), scan.Crate(4, "e", "a/e")])
    assert [r["idx"] for r in crates.critical_path(table).orderBy("place").collect()] == [0, 1, 2]
    assert rows(crates.usage(table)) == [(0, "shipped"), (1, "shipped"), (2, "shipped"), (3, "dev_only"), (4, "unused")]
    files = spark.createDataFrame([("a/x.rs",), ("a/e/x.rs",), ("ab/x.rs",)], "file string")
    assert rows(crates.crate_of(files, table)) == [("a/e/x.rs", 4), ("a/x.rs", 0)]
    loop = scan.crates_table(spark, [scan.Crate(0, "a", "a", deps=[1]), scan.Crate(1, "b", "b", deps=[0])])
    assert crates.heights(loop).count() == 2 and rows(crates.rebuild_sets(loop)) == [(0, 1), (1, 0)]


def test_lookup(app):
    assert rows(navigate.lookup(app, "b::C::go").select("outcome", "node_id")) == [("found", 2)]
    assert {r["outcome"] for r in navigate.lookup(app, "o").collect()} == {"ambiguous"}
    assert ("not_found", 1, 3) in rows(navigate.lookup(app, "sotp").select("outcome", "place", "node_id"))
    found = [r.asDict() for r in navigate.lookup(app, "sotp").collect()]
    assert contract.lookup_error("sotp", found)["error"] == "not_found" and contract.lookup_error("x", [{"outcome": "found"}]) is None


def test_contract(app):
    out = contract.listing("search", navigate.search(app, "o", 20), 2, "matches", query="o")
    assert len(out["matches"]) == 2 and out["matches_more"] == navigate.search(app, "o", 20).count() - 2 and "fuzzy" not in out["matches"][0]
    make = lambda limit: {"items": list(range(500))[:limit]}
    assert len(json.loads(contract.fit_json(make, 20))["items"]) == 16 and len(json.loads(contract.fit_json(make, None))["items"]) == 500
    assert contract.fit_text(lambda n: "x" * n, 4, 100) == "x" * 12
    card = navigate.node_cards(app).where("node_id = 2").first().asDict()
    calls = [r.asDict() for r in navigate.card_calls(app, 2).collect()]
    text = contract.card_text(card, calls)
    assert "b::C::go" in text and "std::fs::read (unresolved x1)" in text and text in contract.explain_prompt(card, calls)
    tree = [r.asDict() for r in flows.call_tree(app, 0).collect()]
    names = {r["node_id"]: r["qualified_name"] for r in app.nodes.collect()}
    assert contract.tree_text(tree, names).startswith("a::main") and layout.mermaid(tree, names).count("-->") == len(tree) - 1
    outline = contract.outline_text([r.asDict() for r in navigate.outline_tree(app).collect()])
    assert outline.splitlines()[:3] == ["a (2)", "  main", "  step"]
    places = layout.tree_positions(tree)
    assert len(places) == len(tree) and not any(np.isnan(x) for x, _ in places.values())


def test_layout(app):
    at = layout.force(6, np.array([0, 1, 2, 5]), np.array([1, 2, 0, 5]), 60)
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + np.eye(6) * 99
    assert np.isfinite(at).all() and gap.min() > 1 and (at == layout.force(6, np.array([0, 1, 2, 5]), np.array([1, 2, 0, 5]), 60)).all()
    assert gap[0, 1] < gap[0, 3]  # linked nodes are nearer
    groups, layers = crates.group_of(app), crates.group_layers(app)
    boxes = [r.asDict() for r in layout.group_boxes(layout.layout_groups(app, groups, 20), layers).collect()]
    for a in boxes:
        for b in boxes:
            apart = a["left"] + a["width"] <= b["left"] or b["left"] + b["width"] <= a["left"] or a["top"] + a["height"] <= b["top"] or b["top"] + b["height"] <= a["top"]
            assert a["grp"] == b["grp"] or apart
    placed = layout.layout_by_crate(app, groups, layers, 20)
    assert placed.count() == app.nodes.count() and layout.module_centroids(app, placed).count() == 3
