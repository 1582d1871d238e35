"""Rust extraction and resolution on small sources of our own."""

import pytest

from codeloom.sources import rust_source as rs

LIB = '''
//! Shop.
pub mod till {
    /// Adds up.
    #[inline]
    pub fn total(items: &[u32], tax: u32) -> u32 {
        let mut sum = 0;
        for x in items.iter() {
            if *x > 3 && tax > 0 { sum += round(*x); } else if *x == 0 { continue; }
        }
        match sum { 0 => 1, n => n + tax }
    }
    fn round(x: u32) -> u32 { x }
    pub struct Drawer { lock: Bolt }
    impl Drawer {
        pub fn new() -> Self { Drawer { lock: Bolt::new() } }
        pub async fn pull(&mut self, n: u32) -> Result<u32, String> {
            self.lock.slide(n)?;
            let text = format!("{} // not a comment", n);
            std::fs::write("a", &text).await;
            Ok(Self::coin(n))
        }
        fn coin(n: u32) -> u32 { super::super::till::round(n) }
    }
    impl Clone for Drawer { fn clone(&self) -> Self { Drawer::new() } }
    pub struct Bolt;
    impl Bolt {
        pub fn new() -> Bolt { Bolt }
        pub fn slide(&self, n: u32) -> Result<u32, String> { Ok(n) }
    }
}
#[no_mangle]
pub extern "C" fn entry() { unsafe { work() } }
fn work() {
    let d = till::Drawer::new();
    let kept: Vec<u32> = Vec::new();
    std::thread::spawn(move || { tick(); });
    std::thread::spawn(tick);
    let mut names = vec![1];
    names.retain(|n| keep(*n));
    Some(3).map(|n| keep(n));
    tokio::task::block_in_place(|| std::fs::read("b"));
    for _ in 0..3 { let c = kept.clone(); d.clone(); }
}
fn tick() {}
fn keep(n: u32) -> bool { n > 1 }
#[cfg(test)]
mod tests {
    #[test]
    fn adds() { assert_eq!(super::till::total(&[], 1), 1); }
}
'''


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("shop/src/lib.rs", LIB), ("other/src/deep/mod.rs", "pub fn tick() { tick2() }\nfn tick2() { fn inner() {} inner(); unknown(); x.slide(1); }"), ("bad.rs", "fn broken( {{{ "), ("none.rs", None)], "path string, text string")
    return rs.rust_graph(files)


def test_definitions(graph):
    nodes = {r["qualified_name"]: r for r in graph.nodes.where("kind <> 'external'").collect()}
    total = nodes["shop::till::total"]
    assert (total["kind"], total["is_pub"], total["parameters"], total["start_line"], total["lines_of_code"]) == ("function", True, 2, 4, 7)
    assert (total["decision_points"], total["max_nesting"]) == (6, 3)
    pull = nodes["shop::till::Drawer::pull"]
    assert pull["kind"] == "method" and pull["is_async"] and pull["parameters"] == 1 and pull["awaits"] == 1 and pull["decision_points"] == 1 and pull["allocations"] == 1
    assert nodes["shop::till::Drawer::clone"]["is_trait_impl"] and not nodes["shop::till::Drawer::new"]["is_method"]
    entry = nodes["shop::entry"]
    assert entry["is_exported"] and entry["unsafe_blocks"] == 1 and not nodes["shop::work"]["is_exported"]
    assert nodes["shop::tests::adds"]["is_test"] and not nodes["shop::work"]["is_test"]
    assert any(r["kind"] == "closure" for r in nodes.values()) and "other::deep::tick2::inner" in nodes


def test_calls(graph):
    names = {r["node_id"]: (r["qualified_name"], r["kind"]) for r in graph.nodes.collect()}
    edges = {(names[r["src"]][0], names[r["dst"]][0], r["kind"]): r for r in graph.edges.collect()}
    has = lambda a, b, kind: (f"shop::{a}", b, kind) in edges
    assert has("till::total", "shop::till::round", "direct_call") and edges["shop::till::total", "shop::till::round", "direct_call"]["in_loop"]
    assert has("till::Drawer::pull", "shop::till::Bolt::slide", "method_call")  # the field's type
    assert has("till::Drawer::pull", "shop::till::Drawer::coin", "associated_call") and has("till::Drawer::pull", "format", "unresolved")
    assert edges["shop::till::Drawer::pull", "std::fs::write", "unresolved"]["awaited"]
    assert has("work", "shop::till::Drawer::new", "associated_call") and has("work", "Vec::new", "unresolved")
    assert has("work", "shop::tick", "spawn") and has("entry", "shop::work", "direct_call")
    spawned = [a for a, b, kind in edges if b == "shop::tick" and kind == "direct_call"]
    assert spawned == [next(n for n, k in names.values() if k == "closure")]
    keep = edges["shop::work", "shop::keep", "direct_call"]
    assert keep["count"] == 2 and keep["in_loop"]
    assert edges["shop::work", "std::fs::read", "unresolved"]["blocking_ok"]
    assert edges["shop::work", "Vec::clone", "unresolved"]["in_loop"] and has("work", "shop::till::Drawer::clone", "method_call")
    assert ("other::deep::tick2", "other::deep::tick2::inner", "direct_call") in edges and ("other::deep::tick2", "unknown", "unresolved") in edges
    assert ("other::deep::tick2", "shop::till::Bolt::slide", "method_call") in edges  # the only method of that name
    assert ("other::deep::tick", "other::deep::tick2", "direct_call") in edges


def test_crates_that_may_not_be_named(spark):
    files = spark.createDataFrame([("a/src/lib.rs", "fn go() { help() }"), ("b/src/lib.rs", "pub fn help() {}")], "path string, text string")
    defs, calls = rs.definitions(files), rs.raw_calls(files)
    kinds = lambda sees: {r["kind"] for r in rs.resolve(defs, calls, sees=sees).edges.collect()}
    assert kinds(None) == {"direct_call"}
    assert kinds(spark.createDataFrame([("a", "a"), ("b", "b")], "crate string, other string")) == {"unresolved"}


def test_module_paths_and_attributes():
    assert rs.module_path("crates/my-lib/src/a/b.rs") == "my_lib::a::b" and rs.module_path("src/main.rs") == "crate" and rs.module_path("x.rs") == "x"
    assert rs.is_test_attribute("tokio::test") and rs.is_test_attribute("cfg(all(test,unix))") and not rs.is_test_attribute("cfg(not(test))") and not rs.is_test_attribute("derive(Debug)")
