"""Navigation: strict lookup, search, node cards, call sites, the outline tree, ranked entries, editor places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text

from .graph import Graph, cyclomatic, entry_kinds, resolve, tags, with_degrees
from .iterate import _cut
from .nearest import beside

#: How edge kinds are shown.
KIND_NAMES = {"direct_call": "direct", "method_call": "method", "associated_call": "assoc", "macro_call": "macro", "trait_dispatch": "trait", "unresolved": "unresolved", "spawn": "spawn"}
CANDIDATES = 8


def kind_name(kind: Column) -> Column:
    return reduce(lambda c, x: c.when(kind == x[0], x[1]), KIND_NAMES.items(), F).otherwise(kind)


def short(name: Column) -> Column:
    """The last two segments of a path."""
    return F.substring_index(name, "::", -2)


def location(file: Column, line: Column) -> Column:
    """``file:line``, or a mark for what has no file."""
    return F.when(file.isNull(), "<external>").otherwise(F.concat_ws(":", file, line.cast("string")))


def best_matches(g: Graph, pattern: str, most: int) -> DataFrame:
    """The first ``most`` matches in order; a top-k, so no task sorts all of them."""
    return resolve(g, pattern).orderBy("rank", "bytes", "qualified_name", "node_id").limit(most)


def lookup(g: Graph, pattern: str, most: int = CANDIDATES) -> DataFrame:
    """(outcome, place, node_id, qualified_name): one found symbol, or candidates of an ambiguous or unknown one.

    A match of the whole path, or a best rank that no other has, is found. The result has ``most`` rows at most.
    """
    top = best_matches(g, pattern, most)
    tied = resolve(g, pattern).groupBy("rank").agg(F.count("*").alias("tied"))
    best = tied.agg(F.min_by("tied", "rank").alias("tied"), F.min("rank").alias("best"))
    rows = top.join(F.broadcast(best), F.lit(True))  # one row
    sure = (F.col("best") == 0) | (F.col("tied") == 1)
    place = F.row_number().over(Window.orderBy("rank", "bytes", "qualified_name", "node_id"))  # of ``most`` rows
    rows = rows.withColumn("place", place).where(~sure | (F.col("place") == 1))
    found = rows.select(F.when(sure, "found").otherwise("ambiguous").alias("outcome"), "place", "node_id", "qualified_name")
    if not found.isEmpty():
        return found
    near = text.suggest(g.defs, pattern, most)
    order = Window.orderBy("score", F.octet_length("qualified_name"), "qualified_name")  # of ``most`` rows
    return near.select(F.lit("not_found").alias("outcome"), F.row_number().over(order).alias("place"), "node_id", "qualified_name")


def search(g: Graph, pattern: str, limit: int = 20) -> DataFrame:
    """(node_id, qualified_name, fuzzy): matches, or names that may have been meant if there is none."""
    hits = best_matches(g, pattern, limit).select("node_id", "qualified_name", F.lit(False).alias("fuzzy"))
    if not hits.isEmpty():
        return hits
    return text.suggest(g.defs, pattern, min(limit, 4 * CANDIDATES)).select("node_id", "qualified_name", F.lit(True).alias("fuzzy"))


def text_filter(g: Graph, words: str) -> DataFrame:
    """Nodes whose name or path holds the text, in any case; the empty text keeps all."""
    t = words.lower()
    return g.nodes.where(F.lower("name").contains(t) | F.lower("qualified_name").contains(t)).select("node_id", "qualified_name")


def call_sites(calls: DataFrame) -> DataFrame:
    """(src, dst, kind, sites): ``line:col`` of each distinct known place of the raw calls, in order."""
    at = F.struct("line", "col")
    sites = F.array_sort(F.collect_set(F.when(F.col("line") > 0, at)))
    return calls.groupBy("src", "dst", "kind").agg(F.array_join(F.transform(sites, lambda s: F.concat_ws(":", s["line"].cast("string"), s["col"].cast("string"))), ",").alias("sites"))


def node_cards(g: Graph) -> DataFrame:
    """A row for each definition: place, flags, metrics, entry kind and degrees."""
    rows = with_degrees(g).join(tags(g), "node_id").join(entry_kinds(g).select("node_id", "entry"), "node_id", "left")
    stats = ["parameters", "lines_of_code", "max_nesting", "decision_points", "allocations", "unsafe_blocks", "awaits"]
    return rows.select("node_id", "name", "qualified_name", "module_path", "kind", location(F.col("file"), F.col("start_line")).alias("at"), "end_line", "tags", cyclomatic().alias("cyclomatic"), *stats, "entry", "fan_in", "fan_out")


def card_calls(g: Graph, node_id: int) -> DataFrame:
    """(side, place, other, kind, count, line, external): inputs and outputs of a node, definitions first, by name and kind."""
    into = g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("side"), F.col("src").alias("other"), "kind", "count", "line")
    out = g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("side"), F.col("dst").alias("other"), "kind", "count", "line")
    ends = g.nodes.select(F.col("node_id").alias("other"), "qualified_name", (F.col("kind") == "external").alias("external"))
    rows = into.unionByName(out).join(ends, "other").withColumn("kind", kind_name(F.col("kind")))
    order = Window.partitionBy("side").orderBy("external", "qualified_name", "kind")  # the calls of one node
    return rows.withColumn("place", F.row_number().over(order)).select("side", "place", "other", "qualified_name", "kind", "count", "line", "external")


def all_file_symbols(g: Graph) -> DataFrame:
    """(file, place, node_id, name, start_line, fan_in, fan_out): the definitions of every file by line."""
    order = Window.partitionBy("file").orderBy("start_line", "node_id")
    return with_degrees(g).where("file is not null").select("file", F.row_number().over(order).alias("place"), "node_id", "name", "start_line", "fan_in", "fan_out")


def outline_tree(g: Graph, keep: str = "") -> DataFrame:
    """(sort_key, depth, name, path, node_id, functions): scopes and functions in the order of the tree.

    Sorting by ``sort_key`` gives the preorder: within a scope its scopes by name, then its functions by
    file, line, name and id; functions without a module come last. With ``keep`` only functions whose name or
    path holds that text stay, with their scopes, counted again. Rows are not gathered in one task.
    """
    defs = g.defs
    if keep:
        t = keep.lower()
        defs = defs.where(F.lower("name").contains(t) | F.lower("qualified_name").contains(t))
    parts = F.filter(F.split("module_path", "::"), lambda x: x != "")
    scope_key = lambda x: F.concat(F.lit("0"), x, F.lit("\t"))
    rows = defs.withColumn("parts", parts)
    scopes = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda k: F.slice("parts", 1, k))).alias("at")).where(F.size("at") > 0)
    counted = scopes.groupBy("at").agg(F.count("*").alias("functions"))
    told = counted.select(F.array_join(F.transform("at", scope_key), "").alias("sort_key"), (F.size("at") - 1).alias("depth"), F.element_at("at", -1).alias("name"), F.array_join("at", "::").alias("path"), F.lit(None).cast(g.nodes.schema["node_id"].dataType).alias("node_id"), "functions")
    own = F.concat(F.array_join(F.transform("parts", scope_key), ""), F.lit("1"), F.coalesce("file", F.lit("")), F.lit("\t"), F.lpad(F.col("start_line").cast("string"), 10, "0"), F.lit("\t"), F.col("name"), F.lit("\t"), F.lpad(F.col("node_id").cast("string"), 20, "0"))
    leaves = rows.select(own.alias("sort_key"), F.size("parts").alias("depth"), "name", F.col("qualified_name").alias("path"), "node_id", F.lit(1).cast("long").alias("functions"))
    return told.unionByName(leaves)


def rank_entries(g: Graph, reach: DataFrame, limit: int = 40) -> DataFrame:
    """(entry, place, node_id, reach): entries of each kind by reach (``reach``: node_id, reach), unknown last, ``limit`` a kind."""
    order = Window.partitionBy("entry").orderBy(F.col("reach").desc_nulls_last(), "qualified_name")
    rows = entry_kinds(g).join(reach, "node_id", "left").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= limit).select("entry", "place", "node_id", "reach")


def tier_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("tier").agg(F.count("*").alias("flows"))


def node_named(g: Graph, places: DataFrame) -> DataFrame:
    """(file, line, word, node_id): of the definitions with the last segment of ``word`` as name, the one
    whose path shares most segments with the word, then in the same file, then nearest by line."""
    segments = F.split("word", "::")
    asked = places.select("file", "line", "word").distinct().withColumn("name", F.element_at(segments, -1))
    words = _cut(asked.select("name", "word").distinct().withColumn("set", F.array_distinct(segments)))
    defs = g.defs.select("name", "node_id", F.col("file").alias("def_file"), "start_line", F.split("qualified_name", "::").alias("parts"))
    # Of a path only the segments count that some word with its name has; paths alike in them are one group.
    known = words.select("name", F.explode("set").alias("part")).distinct().withColumn("known", F.lit(True))
    parts = defs.join(words.select("name").distinct(), "name", "left_semi").select("name", "node_id", "def_file", "start_line", F.explode_outer(F.array_distinct("parts")).alias("part"))
    told = parts.join(known, ["name", "part"], "left").groupBy("name", "node_id", "def_file", "start_line").agg(F.sort_array(F.collect_list(F.when(F.col("known"), F.col("part")))).alias("has"))
    told = _cut(told.select("name", "node_id", "def_file", "start_line", F.to_json("has").alias("has")))
    groups = told.select("name", "has").distinct().withColumn("list", F.from_json("has", "array<string>"))
    pairs = words.join(groups, "name").select("word", "name", "has", F.size(F.array_intersect("set", "list")).alias("shared"))
    top = pairs.groupBy("word", "name").agg(F.max("shared").alias("shared"))
    best = _cut(pairs.join(top, ["word", "name", "shared"]).select("word", "name", "has"))
    at_group = _cut(asked.join(best, ["word", "name"]))
    # A definition in the same file wins over any other; then the nearest by line.
    own = ["name", "has", "file"]
    near = _nearest(at_group, told.withColumnRenamed("def_file", "file"), own).withColumn("other", F.lit(0))
    rest = at_group.join(near.select("file", "line", "word").distinct(), ["file", "line", "word"], "left_anti")
    far = _nearest(rest, told, ["name", "has"]).withColumn("other", F.lit(1))
    rows = near.unionByName(far).groupBy("file", "line", "word").agg(F.min(F.struct("other", "gap", "node_id")).alias("b"))
    return rows.select("file", "line", "word", F.col("b.node_id").alias("node_id"))


def _nearest(places: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` (file, line, word, keys) with the nearest of ``defs`` (keys, start_line, node_id) on either side: gap, node_id."""
    marks = defs.select(*keys, F.col("start_line").alias("at"), "node_id")
    line = places.select("file", "line", "word", *(k for k in keys if k != "file"))
    sides = []
    for after, shift in ((True, -1), (False, 1)):  # a start at the line itself counts on both
        found = beside(line.withColumn("at", F.col("line") + shift), marks, keys, F.col("node_id"), after)
        sides.append(found.select("file", "line", "word", F.abs(F.col("mark.at") - F.col("line")).alias("gap"), F.col("mark.pay").alias("node_id")))
    return sides[0].unionByName(sides[1])


def relocate(g: Graph, before: DataFrame) -> DataFrame:
    """(old_id, node_id): where each symbol of an older graph (old_id, qualified_name, file, start_line) is now: by
    its path, else by name in the same file at the nearest line."""
    paths = g.defs.groupBy("qualified_name").agg(F.min("node_id").alias("node_id"))
    exact = before.join(paths, "qualified_name", "left").withColumn("name", F.element_at(F.split("qualified_name", "::"), -1))
    exact = _cut(exact.select("old_id", "node_id", "name", "file", F.col("start_line").alias("line")))
    lost = exact.where("node_id is null").select("name", "file", "line", F.col("old_id").alias("word"))
    near = _nearest(lost, g.defs.select("name", "file", "start_line", "node_id"), ["name", "file"])
    told = near.groupBy(F.col("word").alias("old_id")).agg(F.min(F.struct("gap", "node_id")).alias("b")).select("old_id", F.col("b.node_id").alias("node_id"))
    return exact.where("node_id is not null").groupBy("old_id").agg(F.min("node_id").alias("node_id")).unionByName(told.join(exact.where("node_id is not null").select("old_id"), "old_id", "left_anti"))


def top_lists(g: Graph, k: int = 10) -> DataFrame:
    """(list, place, node_id, value): most complex definitions and, of those with callers, the most called."""
    rows = with_degrees(g)
    complex_ = rows.select(F.lit("cyclomatic").alias("list"), "node_id", cyclomatic().cast("long").alias("value")).orderBy(F.desc("value"), "node_id").limit(k)
    called = rows.where("fan_in > 0").select(F.lit("fan_in").alias("list"), "node_id", F.col("fan_in").cast("long").alias("value")).orderBy(F.desc("value"), "node_id").limit(k)
    return complex_.unionByName(called).withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("value"), "node_id")))  # 2 k rows


def graph_info(g: Graph) -> DataFrame:
    """One row: files, nodes by kind, edges and calls."""
    n = g.nodes.agg(F.count_distinct("file").alias("files"), F.count("*").alias("nodes"), F.count_if(F.col("kind") == "external").alias("externals"))
    return n.crossJoin(g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("count"), F.lit(0)).alias("calls")))  # one row each

