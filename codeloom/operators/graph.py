"""The call graph and the operators that read it in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import beside

TAGS = [("is_pub", "pub"), ("is_async", "async"), ("is_unsafe", "unsafe"), ("is_test", "test"), ("is_exported", "export")]


@dataclass
class Graph:
    """``nodes`` and ``edges``; at most one edge for each (src, dst, kind)."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def defs(self) -> DataFrame:
        return self.nodes.where("kind <> 'external'")


def cyclomatic() -> Column:
    return F.col("decision_points") + 1


def purity() -> Column:
    """One, less what allocation, unsafe code and suspension cost."""
    impure = lambda on, cost: F.when(on, cost).otherwise(0.0)
    return 1.0 - impure(F.col("allocations") > 0, 0.35) - impure(F.col("is_unsafe") | (F.col("unsafe_blocks") > 0), 0.3) - impure(F.col("is_async") | (F.col("awaits") > 0), 0.2)


def merge_edges(calls: DataFrame) -> DataFrame:
    """Raw calls as edges: counts add up, the first line and first line in a loop stay, and an edge is
    exempt from blocking or awaited only if each of its calls is."""
    both = [F.bool_and(c).alias(c) for c in ("blocking_ok", "awaited") if c in calls.columns]
    return calls.groupBy("src", "dst", "kind").agg(F.sum("count").alias("count"), F.bool_or("in_loop").alias("in_loop"), F.min("line").alias("line"), F.min(F.when(F.col("in_loop"), F.col("line"))).alias("loop_line"), *both)


def edge_flag(edges: DataFrame, name: str) -> Column:
    """A flag of the edges; false where the source of the graph does not tell it."""
    return F.coalesce(F.col(name), F.lit(False)) if name in edges.columns else F.lit(False)


def degrees(g: Graph) -> DataFrame:
    """Edges in and out of each node; parallel edges of other kinds count."""
    into = g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("fan_in"))
    out = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return g.nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left").select("node_id", zero("fan_in"), zero("fan_out"))


def with_degrees(g: Graph) -> DataFrame:
    return g.defs.join(degrees(g), "node_id")


def entry_kinds(g: Graph) -> DataFrame:
    """Definitions that start a run: main by name, else uncalled ones by what they are."""
    kind = F.when(F.col("name") == "main", "main").when(F.col("fan_in") > 0, None).when(F.col("is_test"), "test").when(F.col("is_exported"), "exported").when(F.col("is_pub"), "public").otherwise("root")
    return with_degrees(g).withColumn("entry", kind).where("entry is not null").select("node_id", "qualified_name", "entry")


def neighbors(g: Graph, node_id: int) -> DataFrame:
    out = g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("side"), F.col("dst").alias("other"), "kind", "count")
    into = g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("side"), F.col("src").alias("other"), "kind", "count")
    return out.unionByName(into).join(g.nodes.select(F.col("node_id").alias("other"), "qualified_name"), "other").select("side", "other", "qualified_name", "kind", "count")


def branches(g: Graph) -> DataFrame:
    """The callees of each node, merged over kinds."""
    child = g.edges.groupBy("src", "dst").agg(F.min("line").alias("line"), F.sum("count").alias("count"), F.max((F.col("kind") == "spawn").cast("int")).alias("spawned"))
    callers = g.edges.select(F.col("src").alias("dst"), F.lit(1).alias("has")).distinct()
    return child.join(callers, "dst", "left").select("src", "dst", "line", "count", "spawned", F.coalesce("has", F.lit(0)).alias("has_branches"))


def tags(g: Graph) -> DataFrame:
    shown = F.array(*(F.when(F.col(c), name) for c, name in TAGS))
    return g.defs.select("node_id", F.array_join(F.filter(shown, lambda x: x.isNotNull()), ",").alias("tags"))


def spans(g: Graph) -> DataFrame:
    return g.defs.where("start_line > 0").select("node_id", F.format_string("%s:%d-%d", "file", "start_line", F.greatest("start_line", "end_line")).alias("span"))


def file_symbols(g: Graph, file: str) -> DataFrame:
    return with_degrees(g).where(F.col("file") == file).select("node_id", "name", "start_line", "end_line", "fan_in", "fan_out")


def _around(defs: DataFrame, places: DataFrame) -> DataFrame:
    """(file, line, node_id, start_line, end_line): definitions around each place; of those with equal lines the first id.

    A definition lies in the few blocks of lines of about its own length, and a place in one block of each length,
    so the two meet by equality.
    """
    spans = defs.where("end_line >= start_line").groupBy("file", "start_line", "end_line").agg(F.min("node_id").alias("node_id"))
    wide = F.ceil(F.log2(F.col("end_line") - F.col("start_line") + 1)).cast("int")
    spans = spans.withColumn("level", wide).withColumn("width", F.expr("shiftleft(1L, level)"))
    levels = spans.select("level", "width").distinct()  # 32 at most
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / F.col("width")), F.floor(F.col("end_line") / F.col("width"))))).drop("width")
    asked = places.select("file", "line").distinct().join(F.broadcast(levels), F.lit(True)).withColumn("block", F.floor(F.col("line") / F.col("width"))).drop("width")
    return asked.join(blocks, ["file", "level", "block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("file", "line", "node_id", "start_line", "end_line")


def node_at(g: Graph, places: DataFrame) -> DataFrame:
    """The innermost definition around each (file, line); of equals the later start."""
    best = F.min(F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("node_id").alias("node_id"))).alias("b")
    found = _around(g.defs.select("file", "node_id", "start_line", "end_line"), places)
    return found.groupBy("file", "line").agg(best).select("file", "line", F.col("b.node_id").alias("node_id"))


def nearest_at(g: Graph, places: DataFrame) -> DataFrame:
    """The definition around or nearest to each (file, line); of equal gaps the one below."""
    defs = g.defs.select("file", "node_id", "start_line", "end_line")
    asked = places.select("file", "line").distinct()
    kind = asked.schema["line"].dataType
    pick = lambda gap: F.struct(gap.cast("int").alias("gap"), (-F.col("start_line")).alias("up"), F.col("node_id").alias("node_id")).alias("b")
    found = [_around(defs, places).select("file", "line", pick(F.lit(0)))]
    for after, edge in ((True, "start_line"), (False, "end_line")):
        mark = beside(asked.withColumnRenamed("line", "at"), defs.where("end_line >= start_line").withColumn("at", F.col(edge)), ["file"], F.struct((-F.col("start_line")).alias("up"), F.col("node_id").alias("node_id")), after)
        gap = F.abs(F.col("mark.at") - F.col("at"))
        found.append(mark.select("file", F.col("at").cast(kind).alias("line"), F.struct(gap.cast("int").alias("gap"), F.col("mark.pay.up").alias("up"), F.col("mark.pay.node_id").alias("node_id")).alias("b")))
    # Definitions that end before they start have a gap to every place; there should be none.
    odd = asked.join(defs.where("end_line < start_line"), "file")
    found.append(odd.select("file", "line", pick(F.greatest(F.lit(0), F.col("start_line") - F.col("line"), F.col("line") - F.col("end_line")))))
    best = reduce(DataFrame.unionByName, found).groupBy("file", "line").agg(F.min("b").alias("b"))
    return best.select("file", "line", F.col("b.node_id").alias("node_id"), F.col("b.gap").alias("gap"))


def resolve(g: Graph, pattern: str) -> DataFrame:
    """Definitions that match a pattern: the whole path, the name, the end of the path, then any part."""
    q, n, p = F.lower("qualified_name"), F.lower("name"), pattern.lower()
    rank = F.when(q == p, 0).when(n == p, 1).when(q.endswith("::" + p), 2).when(q.contains(p), 3)
    return g.defs.withColumn("rank", rank).where("rank is not null").select("node_id", "qualified_name", "rank", F.octet_length("qualified_name").alias("bytes"))


def outline(g: Graph) -> DataFrame:
    """Each scope of the module tree with the definitions below it."""
    parts = F.split("module_path", "::")
    scopes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "::"))
    return g.defs.select(F.explode(scopes).alias("scope")).groupBy("scope").agg(F.count("*").alias("functions"))


def module_functions(g: Graph) -> DataFrame:
    return g.defs.groupBy("module_path").agg(F.count("*").alias("functions"))


def _both_ends(g: Graph, column: Column, name: str) -> DataFrame:
    ends = g.defs.select("node_id", column.alias(name))
    a = ends.select(F.col("node_id").alias("src"), F.col(name).alias("a"))
    b = ends.select(F.col("node_id").alias("dst"), F.col(name).alias("b"))
    return g.edges.join(a, "src").join(b, "dst")


def module_edges(g: Graph) -> DataFrame:
    """Distinct edges between each two modules."""
    return _both_ends(g, F.col("module_path"), "m").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("edges"))


def cross_crate_calls(g: Graph) -> DataFrame:
    crate = F.element_at(F.split("module_path", "::"), 1)
    return _both_ends(g, crate, "c").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("pairs"), F.sum("count").alias("calls"))


def group_weights(g: Graph) -> DataFrame:
    """Calls between groups that order them, less those that the other direction outweighs."""
    crate = F.element_at(F.split("module_path", "::"), 1)
    w = _both_ends(g, crate, "c").where("a <> b and kind in ('direct_call', 'associated_call', 'spawn')").groupBy("a", "b").agg(F.sum(F.greatest("count", F.lit(1))).alias("weight"))
    back = w.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("weight").alias("back"))
    return w.join(back, ["a", "b"], "left").where("weight >= coalesce(back, 0)").select("a", "b", "weight")


def exclude(g: Graph, tests: bool = True, examples: bool = True) -> Graph:
    """The graph without tests or examples, their edges, and externals that only they called."""
    gone = (F.col("is_test") & F.lit(tests)) | (F.col("is_example") & F.lit(examples))
    inner = g.defs.where(~gone)
    ids = inner.select("node_id")
    edges = g.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    outer = g.nodes.where("kind = 'external'")
    orphans = outer.join(g.edges.select(F.col("dst").alias("node_id")), "node_id", "left_semi").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    outer = outer.join(orphans, "node_id", "left_anti")
    nodes = inner.unionByName(outer)
    return Graph(nodes, edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi"))


def call_volume(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("count").alias("volume"))


def crate_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Lines of each text: line ends, and one more if the last line has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    ends = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return files.withColumn("lines", F.when(t == "", 0).otherwise(ends + F.when(t.endswith("\n"), 0).otherwise(1)))
