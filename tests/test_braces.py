"""TypeScript, Go and C++ extraction on small sources of our own."""

from codeloom.sources import brace_source as bs

TS = """
import { x } from "y"; // call(1)
export class Cart extends Base<Item> {
  private total = 0;
  constructor(n: number) { super(n); }
  async add(item: Item, n?: number): Promise<void> {
    for (const i of items) { if (i && n) { await this.store(i); } }
    const note = `made ${n} { `;
  }
  store = (i: Item): void => { write(i); };
}
export function write(i: Item) { return new Cart(i.size()); }
const local = async (a, b) => { function inner() { write(a); } inner(); };
"""
GO = """
package shop
import "fmt"
type Till struct { n int }
func (t *Till) Add(n int, more ...int) error {
	for _, x := range more { if x > 0 && n > 0 { t.put(x) } }
	return nil
}
func (t Till) put(n int) { fmt.Println("put {", n) }
func TestAdd(t *testing.T) { helper() }
func helper() { Open[int](3) }
"""
CPP = """
#include <x>
namespace shop {
class Till : public Base {
 public:
  int add(int a, int b) const { while (a) { put(a); a--; } return a ? b : 0; }
  void put(int a);
};
void Till::put(int a) { std::move(a); auto t = new Till(); t->add(a, 1); }
}
static int free_one(int n) { return shop::helper<int>(n); }
"""


def names(path, text):
    f = bs.BraceFile(path, text)
    return {d[3]: d for d in f.defs}, {(c[1].split("::")[-1], c[3], c[4], c[5]) for c in f.calls}


def test_typescript():
    defs, calls = names("web/src/cart.ts", TS)
    assert set(defs) == {"cart::Cart::constructor", "cart::Cart::add", "cart::Cart::store", "cart::write", "cart::local", "cart::local::inner"}
    add = defs["cart::Cart::add"]
    assert add[5] == "method" and add[9] and add[12] == 2 and add[11] == 3
    assert ("add", "store", "method_call", True) in calls and ("write", "Cart", "associated_call", False) in calls and ("store", "write", "direct_call", False) in calls
    assert not any(c[1] == "call" for c in calls)


def test_go():
    defs, calls = names("till.go", GO)
    assert set(defs) == {"shop::Till::Add", "shop::Till::put", "shop::TestAdd", "shop::helper"}
    assert defs["shop::Till::Add"][8] and not defs["shop::Till::put"][8] and defs["shop::TestAdd"][10] and defs["shop::Till::Add"][12] == 2
    assert ("Add", "put", "method_call", True) in calls and ("TestAdd", "helper", "direct_call", False) in calls


def test_cpp():
    defs, calls = names("till.cpp", CPP)
    assert set(defs) == {"till::shop::Till::add", "till::shop::Till::put", "till::free_one"}
    assert ("add", "put", "direct_call", True) in calls and ("put", "add", "method_call", False) in calls and ("put", "Till", "associated_call", False) in calls


def test_graph_of_each_language(spark):
    files = spark.createDataFrame([("web/src/cart.ts", TS), ("till.go", GO), ("till.cpp", CPP), ("x.txt", "f(1)"), ("bad.go", "func ((({"), ("none.ts", None)], "path string, text string")
    g = bs.graph(files)
    ids = {r["node_id"]: r["qualified_name"] for r in g.nodes.collect()}
    edges = {(ids[r["src"]], ids[r["dst"]]) for r in g.edges.collect()}
    assert ("cart::Cart::store", "cart::write") in edges and ("shop::Till::Add", "shop::Till::put") in edges and ("till::shop::Till::put", "till::shop::Till::add") in edges
