"""Crates (packages): who owns a file, what may be named, what rebuilds, and the groups of a graph.

``crates`` has idx, name, dir, member, default_member, deps, dev_deps, is_root, has_tests. It is a table of
packages, small beside the code; closures over it are still frontier loops over written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Graph
from .iterate import _cut, _union, cycles

#: Directories and file names that tell tests and examples, by language.
STOP_DIRS = ["src", "lib"]
TEST_DIRS = ["tests", "test", "__tests__", "testdata"]
EXAMPLE_DIRS = ["examples", "benches"]
TEST_FILES = r"^(.*_test\.go|test_.*\.py|.*_test\.py|conftest\.py|.*\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs))$"


def crate_of(files: DataFrame, crates: DataFrame) -> DataFrame:
    """(file, idx): the crate whose directory is the longest that holds the file; its directories join by equality."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    found = files.select("file").distinct().select("file", F.explode(above).alias("dir")).join(crates.select("dir", "idx"), "dir")
    return found.groupBy("file").agg(F.max_by("idx", F.struct(F.octet_length("dir"), -F.col("idx"))).alias("idx"))


def path_role(path: Column) -> Column:
    """normal, test or example, by the directories outside a source directory and the file's name."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    stops = F.filter(F.transform(F.array(*map(F.lit, STOP_DIRS)), lambda x: F.array_position(dirs, x)), lambda k: k > 0)
    outer = F.when(F.size(stops) > 0, F.slice(dirs, 1, (F.array_min(stops) - 1).cast("int"))).otherwise(dirs)
    told = F.filter(outer, lambda d: d.isin(TEST_DIRS + EXAMPLE_DIRS))
    first = F.try_element_at(told, F.lit(1))
    named = F.array_contains(dirs, "__tests__") | F.element_at(parts, -1).rlike(TEST_FILES)
    return F.when(first.isin(TEST_DIRS), "test").when(first.isin(EXAMPLE_DIRS), "example").when(named, "test").otherwise("normal")


def mark_path_roles(g: Graph) -> Graph:
    """Nodes of test and example files are marked as such."""
    role = path_role(F.coalesce("file", F.lit("")))
    return Graph(g.nodes.withColumn("is_test", F.col("is_test") | (role == "test")).withColumn("is_example", F.col("is_example") | (role == "example")), g.edges)


def dependencies(crates: DataFrame, dev: bool = False) -> DataFrame:
    """(idx, dep): normal dependencies, with ``dev`` also those of tests, known crates only."""
    deps = F.array_union("deps", "dev_deps") if dev else F.col("deps")
    rows = crates.select("idx", F.explode(deps).alias("dep")).distinct()
    return rows.join(crates.select(F.col("idx").alias("dep")), "dep", "left_semi").select("idx", "dep")


def closure(crates: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(idx, dep): every crate that each crate reaches over normal dependencies, itself too; ``starts`` (idx, dep) in its place."""
    steps = _cut(dependencies(crates).select(F.col("idx").alias("at"), F.col("dep").alias("next")))
    first = crates.select("idx", F.col("idx").alias("dep")) if starts is None else starts
    fronts = [_cut(first.distinct())]
    while fronts[-1].rows:
        step = fronts[-1].select(F.col("idx").alias("start"), F.col("dep").alias("at")).join(steps, "at").select(F.col("start").alias("idx"), F.col("next").alias("dep")).distinct()
        seen = _union(fronts).select(F.col("idx").alias("seen_idx"), F.col("dep").alias("seen_dep"))
        fronts.append(_cut(step.join(seen, (F.col("idx") == F.col("seen_idx")) & (F.col("dep") == F.col("seen_dep")), "left_anti")))
    return _union(fronts)


def visibility(crates: DataFrame) -> DataFrame:
    """(idx, other, normal, dev): the crates that each may name in its code and, with dev dependencies, in its tests."""
    normal = closure(crates).select("idx", F.col("dep").alias("other"), F.lit(True).alias("normal"))
    starts = crates.select("idx", (F.col("idx") + 0).alias("dep")).unionByName(dependencies(crates, dev=True))
    dev = closure(crates, starts).select("idx", F.col("dep").alias("other"))
    return dev.join(normal, ["idx", "other"], "left").select("idx", "other", F.coalesce("normal", F.lit(False)).alias("normal"), F.lit(True).alias("dev"))


def rebuild_sets(crates: DataFrame) -> DataFrame:
    """(idx, other): the crates that a change of ``idx`` builds again."""
    return closure(crates).where("idx <> dep").select(F.col("dep").alias("idx"), F.col("idx").alias("other"))


def heights(crates: DataFrame) -> DataFrame:
    """(idx, depth): the longest chain of dependencies below each crate; those on or above a cycle stop at as many rounds as crates."""
    steps = _cut(dependencies(crates))
    level = _cut(crates.select("idx", F.lit(0).alias("depth")))
    for _ in range(crates.count()):
        told = steps.join(level.select(F.col("idx").alias("dep"), "depth"), "dep").groupBy("idx").agg((F.max("depth") + 1).alias("told"))
        new = _cut(level.join(told, "idx", "left").select("idx", F.greatest("depth", F.coalesce("told", F.lit(0))).alias("depth")))
        same = new.join(level, ["idx", "depth"], "left_anti").isEmpty()
        level = new
        if same:
            break
    return level


def critical_path(crates: DataFrame) -> DataFrame:
    """(place, idx): one longest chain of dependencies; of equals the smallest idx."""
    level = _cut(heights(crates))
    steps = dependencies(crates)
    out = [r["idx"] for r in level.orderBy(F.desc("depth"), "idx").limit(1).collect()]
    depth = level.agg(F.max("depth")).first()[0] or 0
    while depth:
        depth -= 1
        below = steps.where(F.col("idx") == out[-1]).select(F.col("dep").alias("idx")).join(level.where(F.col("depth") == depth), "idx", "left_semi").agg(F.min("idx")).first()[0]
        if below is None:
            break
        out.append(below)
    return crates.sparkSession.createDataFrame(list(enumerate(out)), "place int, idx int")


def usage(crates: DataFrame) -> DataFrame:
    """(idx, usage): shipped by a default member, reached by tests only, or unused.

    Where no default member is a root (has a binary), every default member ships.
    """
    members = crates.where("default_member")
    roots = members.where("is_root")
    any_root = roots.agg((F.count("*") > 0).alias("any"))
    first = members.join(F.broadcast(any_root), F.lit(True)).where("is_root or not any").select("idx")  # one row
    reach = _cut(closure(crates))
    shipped = reach.join(first, "idx", "left_semi").select(F.col("dep").alias("idx")).distinct().withColumn("shipped", F.lit(True))
    tested = crates.where("has_tests").select("idx", (F.col("idx") + 0).alias("dep")).unionByName(dependencies(crates, dev=True).join(crates.where("has_tests").select("idx"), "idx", "left_semi"))
    starts = tested.unionByName(crates.select("idx", F.explode("dev_deps").alias("dep"))).select("dep").distinct()
    dev = reach.join(starts.select(F.col("dep").alias("idx")), "idx", "left_semi").select(F.col("dep").alias("idx")).distinct().withColumn("dev", F.lit(True))
    rows = crates.select("idx").join(shipped, "idx", "left").join(dev, "idx", "left")
    return rows.select("idx", F.when(F.col("shipped"), "shipped").when(F.col("dev"), "dev_only").otherwise("unused").alias("usage"))


def crate_view(g: Graph, crates: DataFrame, file_crate: DataFrame, file_lines: DataFrame) -> DataFrame:
    """A row for each crate: files, lines, functions, tests, dependents, rebuilds, depth, calls and usage.

    ``file_crate``: (file, idx); ``file_lines``: (file, lines).
    """
    files = file_crate.join(file_lines, "file", "left").groupBy("idx").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    owned = g.defs.join(file_crate, "file").select("node_id", "idx", (F.col("is_test") | F.col("is_example")).alias("tested"))
    functions = owned.groupBy("idx").agg(F.count("*").alias("functions"), F.count_if("tested").alias("test_functions"))
    ends = lambda a, b: owned.select(F.col("node_id").alias(a), F.col("idx").alias(b))
    across = g.edges.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").where("a <> b")
    sides = across.select(F.explode(F.array(F.struct(F.col("a").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("idx"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("s"))
    calls = sides.groupBy("s.idx").agg(F.sum("s.o").alias("calls_out"), F.sum("s.i").alias("calls_in"))
    dependents = dependencies(crates).groupBy(F.col("dep").alias("idx")).agg(F.count("*").alias("dependents"))
    rebuild = rebuild_sets(crates).groupBy("idx").agg(F.count("*").alias("rebuild"))
    rows = crates.select("idx", "name")
    numbers = ["files", "lines", "functions", "test_functions", "dependents", "rebuild", "calls_out", "calls_in"]
    for part in (files, functions, dependents, rebuild, calls):
        rows = rows.join(part, "idx", "left")
    rows = rows.join(heights(crates), "idx").join(usage(crates), "idx")
    return rows.select("idx", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "depth", "usage")


def display_order(view: DataFrame) -> DataFrame:
    """Crates as shown: shipped first, then by lines and name."""
    return view.orderBy(F.col("usage") != "shipped", F.desc("lines"), "name")


# Groups


def group_of(g: Graph) -> DataFrame:
    """(node_id, grp): the crate of each definition, or the module below it where there is one crate only; externals are one group."""
    parts = F.filter(F.split("module_path", "::"), lambda x: x != "")
    # The module path of a closure ends with the function that it is in, and closures around it.
    home = F.expr("CASE WHEN kind = 'closure' THEN regexp_replace(regexp_replace(module_path, '(::<[^:]*)+$', ''), '(^|::)[^:]+$', '') ELSE module_path END")
    rows = g.nodes.withColumn("parts", F.filter(F.split(home, "::"), lambda x: x != ""))
    crates = g.defs.select(F.try_element_at(parts, F.lit(1)).alias("c")).agg(F.count_distinct("c").alias("n"))
    deep = F.concat_ws("::", F.element_at("parts", 1), F.element_at("parts", 2))
    name = F.when(F.col("kind") == "external", "<external>").when(F.size("parts") == 0, "<top level>").when((F.col("n") <= 1) & (F.size("parts") > 1), deep).otherwise(F.try_element_at("parts", F.lit(1)))
    return rows.join(F.broadcast(crates), F.lit(True)).select("node_id", name.alias("grp"))  # one row


def group_edges(g: Graph, groups: DataFrame) -> DataFrame:
    """(a, b): the directions between groups that order them: named calls, the heavier way of two."""
    inner = groups.where("grp <> '<external>'")
    a = inner.select(F.col("node_id").alias("src"), F.col("grp").alias("a"))
    b = inner.select(F.col("node_id").alias("dst"), F.col("grp").alias("b"))
    named = g.edges.where("kind in ('direct_call', 'associated_call', 'spawn')")
    w = named.join(a, "src").join(b, "dst").where("a <> b").groupBy("a", "b").agg(F.sum(F.greatest("count", F.lit(1))).alias("w"))
    back = w.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("w").alias("back"))
    return w.join(back, ["a", "b"], "left").where("w >= coalesce(back, 0)").select("a", "b")


def group_layers(g: Graph) -> DataFrame:
    """(grp, layer, members): the longest way of calls from the top to each group; groups on a cycle share
    a layer and externals lie below all. Ordered by layer, members and name when shown."""
    groups = _cut(group_of(g))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"))
    edges = _cut(group_edges(g, groups))
    ids = _cut(sizes.select("grp", F.xxhash64("grp").alias("node_id")))
    numbered = edges.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))
    found = cycles(Graph(ids.select("node_id"), numbered))
    comp = _cut(ids.join(found, "node_id", "left").select("grp", F.coalesce("component", "node_id").alias("comp")))
    of = lambda end: comp.select(F.col("grp").alias(end), F.col("comp").alias(f"c{end}"))
    steps = _cut(edges.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb").distinct())
    level = _cut(comp.select("comp").distinct().withColumn("layer", F.lit(0)))
    while True:  # as many rounds as the longest way
        told = steps.join(level.select(F.col("comp").alias("ca"), "layer"), "ca").groupBy(F.col("cb").alias("comp")).agg((F.max("layer") + 1).alias("told"))
        new = _cut(level.join(told, "comp", "left").select("comp", F.coalesce("told", F.lit(0)).alias("layer")))
        if new.join(level, ["comp", "layer"], "left_anti").isEmpty():
            break
        level = new
    rows = sizes.join(comp, "grp").join(level, "comp")
    deepest = rows.where("grp <> '<external>'").agg(F.max("layer").alias("deepest"))
    layer = F.when(F.col("grp") == "<external>", F.coalesce(F.col("deepest") + 1, F.lit(0))).otherwise(F.col("layer"))
    return rows.join(F.broadcast(deepest), F.lit(True)).select("grp", layer.cast("int").alias("layer"), "members")  # one row


def group_order(layers: DataFrame) -> DataFrame:
    """``group_layers`` with the index of each group: by layer, most members, name. A row a group."""
    order = Window.orderBy("layer", F.desc("members"), "grp")
    return layers.withColumn("idx", F.row_number().over(order) - 1)
