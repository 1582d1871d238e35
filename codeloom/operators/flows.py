"""Paths between functions: roots of execution, flows, call trees, callers with their way, blocking calls.

Walks over the whole graph are frontier loops over written tables; only bounded results (a call tree,
the first few paths) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Graph, edge_flag, entry_kinds
from .iterate import FEW, LOCAL, WALKED, _columns, _cut, _local_walks, _small, _union, cycles, reachable, rounds

#: Calls that block, as prefixes (``p::*``) or as whole paths or their last segments.
BLOCKING = [
    "std::fs::*", "fs::*", "File::open", "File::create", "OpenOptions::open", "std::net::*", "TcpStream::connect", "UdpSocket::bind",
    "std::thread::sleep", "thread::sleep", "std::process::Command::*", "Database::create", "Database::open", "Database::builder",
    "begin_write", "begin_read", "open_table", "Connection::open", "Connection::open_in_memory", "execute_batch", "query_row", "sled::*",
    "open_tree", "rocksdb::*", "reqwest::blocking::*", "ureq::*", "argon2::*", "Argon2::*", "hash_password", "verify_password", "bcrypt::*",
    "scrypt::*", "pbkdf2::*",
]
#: Where a flow may start, best first.
TIERS = ["program", "exported", "spawned", "root", "test"]


#: Nodes of a component that is walked once for all.
HUB = 64


def reach_counts(g: Graph, roots: DataFrame, max_depth: int | None = None, few: int = FEW, hub: int = HUB) -> DataFrame:
    """(node_id, reach): how many definitions each root in ``roots`` (node_id) reaches, itself not counted.

    One loop for all roots; its state has a row for each pair of a root and a node that it reaches. Without a bound on
    hops, and with more than ``few`` roots, a walk ends where it enters a cycle component of ``hub`` nodes or more: what
    such a component reaches is walked once, and added to what the root saw on its way.
    """
    steps = _cut(g.edges.select(F.col("src").alias("at"), F.col("dst").alias("node_id")).distinct())
    first = _cut(roots.select(F.col("node_id").alias("root"), "node_id").distinct())
    defs = g.defs.select("node_id")
    if max_depth is not None or first.rows <= few:
        inner = _walk(steps, first, max_depth).where("root <> node_id").join(defs, "node_id", "left_semi")
        counts = inner.groupBy("root").agg(F.count("*").alias("reach"))
    else:
        member = cycles(g)
        member = _cut(member.join(member.groupBy("component").count().where(F.col("count") >= hub), "component").select("node_id", F.col("component").alias("hub")))
        below = _cut(_walk(steps, _cut(member.select(F.col("hub").alias("root"), F.col("hub").alias("node_id")).distinct())).join(defs, "node_id", "left_semi").select(F.col("root").alias("hub"), "node_id"))
        outside = _cut(steps.join(_small(member, F.col("node_id").alias("at")), "at", "left_anti"))
        seen = _walk(outside, first)
        entered = _cut(seen.join(member, "node_id").select("root", "hub").distinct())
        # Roots that enter the same components have one set of what those reach.
        sets = _cut(entered.groupBy("root").agg(F.array_join(F.sort_array(F.collect_list("hub")), ",").alias("set"), F.min("hub").alias("hub"), F.count("*").alias("n")))
        several = sets.where("n > 1").select("set", F.explode(F.split("set", ",")).alias("hub")).distinct().withColumn("hub", F.col("hub").cast(dict(member.dtypes)["hub"]))
        one = sets.where("n = 1").select("set", "hub").distinct()
        sums = below.groupBy("hub").agg(F.count("*").alias("base"))
        base = one.join(sums, "hub").select("set", "base").unionByName(several.join(below, "hub").select("set", "node_id").distinct().groupBy("set").agg(F.count("*").alias("base")))
        own = seen.join(entered, "root").join(below.withColumn("in", F.lit(1)), ["hub", "node_id"], "left").groupBy("root", "node_id").agg(F.max("in").alias("in"))
        free = seen.join(entered.select("root").distinct(), "root", "left_anti").select("root", "node_id").unionByName(own.where("in is null").select("root", "node_id"))
        extra = free.where("root <> node_id").join(defs, "node_id", "left_semi").groupBy("root").agg(F.count("*").alias("extra"))
        inside = own.where("in = 1 and root = node_id").select("root", F.lit(1).alias("self"))
        counts = first.select("root").join(sets.join(base, "set").select("root", "base"), "root", "left").join(inside, "root", "left").join(extra, "root", "left")
        counts = counts.select("root", (F.coalesce("base", F.lit(0)) - F.coalesce("self", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("reach"))
    return first.select("node_id").join(counts.withColumnRenamed("root", "node_id"), "node_id", "left").select("node_id", F.coalesce("reach", F.lit(0)).alias("reach"))


def _walk(steps: DataFrame, first: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node_id): what each root of ``first`` (root, node_id) reaches over ``steps`` (at, node_id), itself too."""
    if steps.rows <= WALKED and first.rows <= FEW and first.where("root <> node_id").isEmpty():
        return _local_walks(steps, [[r["root"]] for r in first.collect()], max_depth).select("root", "node_id")
    fronts = [first]
    for _ in rounds(max_depth):
        step = steps.join(_small(fronts[-1], "root", F.col("node_id").alias("at")), "at").select("root", "node_id").distinct()
        new = _cut(step.join(_small(_union(fronts)), ["root", "node_id"], "left_anti"))
        if not new.rows:
            break
        fronts.append(new)
    return _union(fronts)


def run_roots(g: Graph) -> DataFrame:
    """(node_id, kind, spawners, test_only): programs, exports and what is started on a thread or task."""
    entries = entry_kinds(g).where("entry in ('main', 'exported')")
    named = entries.select("node_id", F.when(F.col("entry") == "main", "program").otherwise("exported").alias("kind"), F.lit(0).cast("long").alias("spawners"), F.lit(False).alias("test_only"))
    callers = g.nodes.select(F.col("node_id").alias("src"), "is_test")
    spawned = g.edges.where("kind = 'spawn'").join(callers, "src").groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("spawners"), F.bool_and("is_test").alias("test_only"))
    return named.unionByName(spawned.select("node_id", F.lit("spawned").alias("kind"), "spawners", "test_only"))


def ranked_roots(g: Graph) -> DataFrame:
    """``run_roots`` with reach and rank: the program or export that reaches most, then by kind and reach."""
    roots = run_roots(g)
    rows = roots.join(reach_counts(g, roots), "node_id").withColumn("named", F.col("kind") != "spawned")
    first = rows.where("named").agg(F.max(F.struct("reach", -F.col("node_id"))).alias("best"))
    rows = rows.crossJoin(first)  # one row
    primary = F.col("named") & (-F.col("node_id") == F.col("best").getField("col2"))
    order = Window.orderBy(F.desc("primary"), F.expr("array_position(array('program', 'exported', 'spawned'), kind)"), "test_only", F.desc("reach"), "node_id")
    return rows.withColumn("primary", F.coalesce(primary, F.lit(False))).withColumn("rank", F.row_number().over(order)).select("node_id", "kind", "spawners", "test_only", "reach", "primary", "rank")


def entry_tiers(g: Graph) -> DataFrame:
    """(node_id, tier, tier_rank): the best tier of every place where a flow may start."""
    rank = lambda name: F.lit(TIERS.index(name))
    roots = run_roots(g).select("node_id", F.when(F.col("kind") == "program", rank("program")).when(F.col("kind") == "exported", rank("exported")).when(F.col("test_only"), rank("test")).otherwise(rank("spawned")).alias("t"), F.lit(0).alias("late"))
    rest = entry_kinds(g).where("entry in ('public', 'root', 'test')").select("node_id", F.when(F.col("entry") == "test", rank("test")).otherwise(rank("root")).alias("t"), F.lit(1).alias("late"))
    best = roots.unionByName(rest).groupBy("node_id").agg(F.min(F.struct("late", "t")).alias("b"))
    return best.select("node_id", F.element_at(F.array(*map(F.lit, TIERS)), F.col("b.t") + 1).alias("tier"), F.col("b.t").alias("tier_rank"))


def flows_from_entries(g: Graph, target: int, max_depth: int | None = 24) -> DataFrame:
    """Entries that reach ``target``, by tier, hops and name."""
    rows = entry_tiers(g).join(reachable(g, [target], max_depth, up=True), "node_id").join(g.nodes.select("node_id", "qualified_name"), "node_id")
    order = Window.orderBy("tier_rank", "depth", "qualified_name")
    return rows.select("node_id", "tier", F.col("depth").alias("hops"), F.row_number().over(order).alias("rank"))


def shortest_paths(g: Graph, sources: list[int], target: int, max_paths: int = 6, max_depth: int = 24, local: int = LOCAL) -> DataFrame:
    """(path): the first ``max_paths`` of all shortest paths from any source, by their ids in order.

    Paths grow only over nodes that lie on some shortest path, so every start of a path can be
    finished and keeping the first ``max_paths`` starts of each length loses none of the result.
    """
    g = Graph(g.nodes.select("node_id"), _cut(g.edges.select("src", "dst").distinct()))
    down, up = reachable(g, sources, max_depth), reachable(g, [target], max_depth, up=True)
    hit = down.where(F.col("node_id") == target).first()
    hops = hit["depth"] if hit else 0
    on = _cut(down.join(up.withColumnRenamed("depth", "left"), "node_id").where(F.col("depth") + F.col("left") == hops).where(F.lit(hit is not None)).select("node_id", "depth"))
    ends = on.select(F.col("node_id").alias("dst"), (F.col("depth") - 1).alias("depth"))
    steps = _cut(g.edges.join(_small(on, F.col("node_id").alias("src"), "depth"), "src").join(ends, ["dst", "depth"]).select(F.col("src").alias("at"), F.col("dst").alias("node_id"), "depth"))
    starts = on.where("depth = 0").select("node_id")
    if on.rows and steps.rows <= local:
        return _local_paths(steps, [r["node_id"] for r in starts.orderBy("node_id").limit(max_paths).collect()], hops, max_paths)
    paths = starts.select(F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    for depth in range(hops):
        grown = paths.join(steps.where(F.col("depth") == depth).select("at", "node_id"), "at")
        paths = _cut(grown.select(F.array_append("path", F.col("node_id")).alias("path"), F.col("node_id").alias("at")).orderBy("path").limit(max_paths))
    return paths.select("path").orderBy("path").limit(max_paths)


def _local_paths(steps: DataFrame, starts: list[int], hops: int, most: int) -> DataFrame:
    """The first ``most`` paths over a bounded number of ``steps`` (at, node_id, depth), each of which lies on one; by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: dict[int, list[int]] = {}
        for a, b in sorted(zip(*(x.tolist() for x in _columns(batches, "at", "node_id")), strict=True)):
            after.setdefault(a, []).append(b)
        paths = [[x] for x in starts]
        for _ in range(hops):
            paths = list(islice(([*p, x] for p in paths for x in after[p[-1]]), most))
        yield pd.DataFrame({"path": paths[:most]})

    return steps.select("at", "node_id").coalesce(1).mapInPandas(run, f"path array<{dict(steps.dtypes)['node_id']}>")


def connection(g: Graph, a: int, b: int, max_depth: int = 64) -> str:
    """How ``b`` lies to ``a``: same, downstream, upstream or unconnected."""
    if a == b:
        return "same"
    hit = lambda x, y: not reachable(g, [x], max_depth).where(F.col("node_id") == y).isEmpty()
    return "downstream" if hit(a, b) else "upstream" if hit(b, a) else "unconnected"


def call_tree(g: Graph, root: int, depth: int = 3, width: int = 12, up: bool = False) -> DataFrame:
    """(ord, depth, node_id, parent, repeat, truncated) in preorder; each node is expanded once.

    Children come in order of call line and name, definitions first. At most ``width`` children for
    each of at most ``width ** (depth - 1)`` nodes of a level are collected.
    """
    a, b = ("dst", "src") if up else ("src", "dst")
    spark = g.edges.sparkSession
    order = Window.partitionBy("at").orderBy("external", "line", "qualified_name")
    ends = g.nodes.select(F.col("node_id").alias("child"), "qualified_name", (F.col("kind") == "external").cast("int").alias("external"))
    kind = dict(g.nodes.dtypes)["node_id"]
    children: dict[int, list[int]] = {}
    more: set[int] = set()
    front = [root]
    for _ in range(depth):
        at = spark.createDataFrame([(x,) for x in front], f"at {kind}")
        found = g.edges.select(F.col(a).alias("at"), F.col(b).alias("child"), "line").groupBy("at", "child").agg(F.min("line").alias("line")).join(F.broadcast(at), "at").join(ends, "child")
        rows = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= width + 1).orderBy("at", "r").collect()
        children |= {x: [] for x in front}
        for r in rows:
            more.add(r["at"]) if r["r"] > width else children[r["at"]].append(r["child"])
        front = sorted({c for x in front for c in children[x]} - set(children))
        if not front:
            break
    out, done, stack = [], set(), [(root, None, 0)]
    while stack:
        node, parent, level = stack.pop()
        again = node in done and bool(children.get(node))
        cut = not again and (node in more and level < depth)
        out.append((len(out), level, node, parent, again, cut))
        if node not in done and level < depth:
            done.add(node)
            stack += [(c, node, level + 1) for c in reversed(children.get(node, []))]
    return spark.createDataFrame(out, f"ord int, depth int, node_id {kind}, parent {kind}, repeat boolean, truncated boolean")


def impact_callers(g: Graph, node_id: int, max_depth: int = 3) -> DataFrame:
    """(node_id, depth, via, entry): callers by level; ``via`` is the parent with the smallest name."""
    depths = _cut(reachable(g, [node_id], max_depth, up=True))
    parent = depths.join(g.nodes.select("node_id", "qualified_name"), "node_id").select(F.col("node_id").alias("dst"), F.col("depth").alias("below"), "qualified_name")
    via = g.edges.join(parent, "dst").join(depths.withColumnRenamed("node_id", "src"), "src").where("depth = below + 1").groupBy(F.col("src").alias("node_id"), "depth").agg(F.min_by("dst", "qualified_name").alias("via"))
    return via.join(entry_kinds(g).select("node_id", "entry"), "node_id", "left")


def patterns(extra: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> list[str]:
    """The blocking patterns with those of a configuration and without those that it allows."""
    return [p for p in dict.fromkeys([*BLOCKING, *extra]) if p not in allow]


def is_blocking(name: Column, found: list[str] | None = None) -> Column:
    """Whether a called path matches a blocking pattern."""
    found = patterns() if found is None else found
    whole = [p for p in found if not p.endswith("::*")]
    hit = name.isin(whole) if whole else F.lit(False)
    for p in found:
        hit = hit | (name.startswith(p[:-1]) if p.endswith("::*") else name.endswith("::" + p))
    return hit


def blocking_steps(g: Graph) -> DataFrame:
    """The edges over which a callee may block its caller: not spawned, not exempt, and no awaited library call."""
    outer = g.nodes.select(F.col("node_id").alias("dst"), (F.col("kind") == "external").alias("library"))
    rows = g.edges.where("kind <> 'spawn'").withColumn("ok", edge_flag(g.edges, "blocking_ok")).withColumn("waits", edge_flag(g.edges, "awaited"))
    return rows.join(outer, "dst").where("not ok and not (waits and library)").drop("ok", "waits", "library")


def blocking_levels(g: Graph, max_depth: int = 4, through_async: bool = False, found: list[str] | None = None) -> DataFrame:
    """(node_id, level, next): least hops to a blocking external call, and the callee with the smallest path on that way.

    Async functions have no level unless ``through_async``: they are told apart on their own.
    """
    names = g.nodes.select(F.col("node_id").alias("dst"), "qualified_name")
    inner = g.defs if through_async else g.defs.where("not is_async")
    steps = _cut(blocking_steps(g).select("src", "dst").distinct().join(inner.select(F.col("node_id").alias("src")), "src", "left_semi").join(names, "dst"))
    none = F.lit(None).cast(g.nodes.schema["node_id"].dataType)
    fronts = [_cut(g.nodes.where((F.col("kind") == "external") & is_blocking(F.col("qualified_name"), found)).select("node_id", F.lit(0).alias("level"), none.alias("next")))]
    for level in range(1, max_depth + 1):
        step = steps.join(_small(fronts[-1], F.col("node_id").alias("dst")), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min_by("dst", "qualified_name").alias("next"))
        new = _cut(step.join(_small(_union(fronts), "node_id"), "node_id", "left_anti").select("node_id", F.lit(level).alias("level"), "next"))
        if not new.rows:
            break
        fronts.append(new)
    return _union(fronts)


def sinks(levels: DataFrame) -> DataFrame:
    """(node_id, sink): the blocking call at the end of each node's way; as many joins as levels."""
    out = levels.where("level = 0").select("node_id", F.col("node_id").alias("sink"))
    parts = [out]
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        out = levels.where(F.col("level") == level).select("node_id", F.col("next").alias("at")).join(out.select(F.col("node_id").alias("at"), "sink"), "at").select("node_id", "sink")
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def async_calls(g: Graph, max_depth: int = 4, found: list[str] | None = None) -> DataFrame:
    """(node_id, depth, calls, line, target): async functions that run blocking calls, with the nearest one."""
    levels = blocking_levels(g, max(max_depth, 1) - 1, False, found)
    waits = g.nodes.select("node_id", "is_async", "kind")
    callers = waits.where("is_async and kind <> 'external'").select(F.col("node_id").alias("src"))
    sync = waits.where("not is_async").select(F.col("node_id").alias("dst"))
    hits = blocking_steps(g).join(callers, "src", "left_semi").join(sync, "dst", "left_semi").join(levels.select(F.col("node_id").alias("dst"), "level"), "dst")
    best = F.min(F.struct("level", "line", "dst")).alias("b")
    return hits.groupBy(F.col("src").alias("node_id")).agg(best, F.sum("count").alias("calls")).select("node_id", (F.col("b.level") + 1).alias("depth"), "calls", F.col("b.line").alias("line"), F.col("b.dst").alias("target"))


def async_blocking(g: Graph, max_depth: int = 4) -> DataFrame:
    """Diagnostics: async functions that reach a blocking call through sync ones."""
    level = F.when(F.col("depth") == 1, "high").otherwise("medium")
    return async_calls(g, max_depth).select(F.lit("async_blocking").alias("code"), level.alias("severity"), "node_id", F.col("depth").cast("double").alias("value"))


#: Types whose clone copies all that they hold, and the calls that do it.
HEAVY_TYPES = ["Vec", "VecDeque", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "String"]
COPIES = ["clone", "to_vec", "to_owned"]


def loop_calls(g: Graph, max_depth: int = 4, found: list[str] | None = None) -> DataFrame:
    """(code, src, dst, depth, line): calls in loops that do I/O, else copies of heavy or own types in loops."""
    levels = blocking_levels(g, max(max_depth, 1), True, found).select(F.col("node_id").alias("dst"), F.col("level").alias("depth"))
    inner = g.edges.where("in_loop and src <> dst").join(g.defs.select(F.col("node_id").alias("src")), "src", "left_semi")
    line = F.col("loop_line") if "loop_line" in g.edges.columns else F.col("line")
    io = blocking_steps(Graph(g.nodes, inner)).join(levels, "dst").select(F.lit("n_plus_one").alias("code"), "src", "dst", "kind", "depth", line.alias("line"))
    own = g.nodes.where("kind = 'method'").select(F.element_at(F.split("module_path", "::"), -1).alias("owner")).distinct()
    names = g.nodes.where("kind = 'external'").select(F.col("node_id").alias("dst"), F.split("qualified_name", "::").alias("parts")).where(F.size("parts") > 1)
    copies = names.where(F.element_at("parts", -1).isin(COPIES)).select("dst", F.element_at("parts", -2).alias("owner"))
    heavy = copies.where(F.col("owner").isin(HEAVY_TYPES)).unionByName(copies.where(~F.col("owner").isin(HEAVY_TYPES)).join(own, "owner", "left_semi"))
    clones = inner.join(heavy.select("dst"), "dst", "left_semi").join(io.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    return io.unionByName(clones.select(F.lit("clone_in_loop").alias("code"), "src", "dst", "kind", F.lit(0).alias("depth"), line.alias("line"))).drop("kind")


def loop_diagnostics(g: Graph, max_depth: int = 4) -> DataFrame:
    """Diagnostics: one for each call in a loop that does I/O or copies much."""
    level = F.when(F.col("code") == "n_plus_one", "medium").otherwise("low")
    return loop_calls(g, max_depth).select("code", level.alias("severity"), F.col("src").alias("node_id"), F.col("depth").cast("double").alias("value"))


def hot_io(g: Graph, callers: int = 8, top: int = 5) -> DataFrame:
    """The ``top`` definitions that may block and have at least ``callers`` other callers."""
    n = g.edges.where("src <> dst").groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("callers")).where(F.col("callers") >= callers)
    levels = blocking_levels(g, through_async=True)
    return n.join(levels, "node_id").join(g.defs.select("node_id"), "node_id", "left_semi").select("node_id", "callers", "level").orderBy(F.desc("callers"), "node_id").limit(top)
