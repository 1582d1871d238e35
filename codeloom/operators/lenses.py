"""Metrics and the rules that turn them into diagnostics: (code, severity, node_id, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph, call_volume, cyclomatic, degrees, purity, with_degrees

#: Fixed values of the rules.
LIMITS = {"cc": 10, "cc_high": 20, "params": 5, "loc": 60, "nesting": 4, "heap": 8, "heap_high": 20, "purity": 0.4, "callers": 3}
SEVERITIES = ["info", "low", "medium", "high"]


def metrics(g: Graph) -> DataFrame:
    """Five metrics a definition in long form."""
    wide = with_degrees(g).select("node_id", cyclomatic().cast("double").alias("cyclomatic"), F.col("fan_in").cast("double").alias("fan_in"), F.col("fan_out").cast("double").alias("fan_out"), F.col("allocations").cast("double").alias("heap"), F.round(purity(), 6).alias("purity"))
    return wide.unpivot("node_id", ["cyclomatic", "fan_in", "fan_out", "heap", "purity"], "kind", "value")


def _rule(rows: DataFrame, code: str, when: Column, severity: Column | str, value: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.where(when).select(F.lit(code).alias("code"), level.alias("severity"), "node_id", value.cast("double").alias("value"))


def _all(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def complexity(g: Graph) -> DataFrame:
    cc, n = cyclomatic(), LIMITS
    return _all([
        _rule(g.defs, "high_complexity", cc > n["cc"], F.when(cc >= n["cc_high"], "high").otherwise("medium"), cc),
        _rule(g.defs, "too_many_parameters", F.col("parameters") > n["params"], "low", F.col("parameters")),
        _rule(g.defs, "long_function", F.col("lines_of_code") > n["loc"], "low", F.col("lines_of_code")),
        _rule(g.defs, "deep_nesting", F.col("max_nesting") > n["nesting"], "low", F.col("max_nesting")),
    ])


def hazards(g: Graph) -> DataFrame:
    heap, n = F.col("allocations"), LIMITS
    return _all([
        _rule(g.defs, "unsafe_usage", F.col("is_unsafe") | (F.col("unsafe_blocks") > 0), "medium", F.col("unsafe_blocks")),
        _rule(g.defs, "heap_pressure", heap >= n["heap"], F.when(heap >= n["heap_high"], "medium").otherwise("low"), heap),
    ])


def impure_hotspots(g: Graph) -> DataFrame:
    return _rule(with_degrees(g), "impure_hotspot", (F.round(purity(), 6) < LIMITS["purity"]) & (F.col("fan_in") >= LIMITS["callers"]), "low", F.round(purity(), 6))


def dead_code(g: Graph) -> DataFrame:
    return _rule(with_degrees(g), "dead_code", (F.col("fan_in") == 0) & ~F.col("is_test") & ~F.col("is_pub") & (F.col("name") != "main"), "low", F.col("lines_of_code"))


def god_functions(g: Graph) -> DataFrame:
    least = F.least("fan_in", "fan_out")
    return _rule(with_degrees(g), "god_function", least >= 8, F.when(least >= 16, "high").otherwise("medium"), least)


def hotspots(g: Graph) -> DataFrame:
    rows = with_degrees(g).join(call_volume(g), "node_id", "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    busy = (F.col("fan_in") >= 2) & ((F.col("fan_in") >= 6) | (F.col("volume") >= 16))
    return _rule(rows, "hotspot", busy, F.when((F.col("fan_in") >= 12) | (F.col("volume") >= 32), "high").otherwise("medium"), F.col("volume"))


def unstable_dependencies(g: Graph) -> DataFrame:
    callee = g.defs.join(degrees(g), "node_id").select(F.col("node_id").alias("dst"), ((cyclomatic() > 10) | (F.col("fan_in") >= 10)).cast("double").alias("volatile"))
    ratio = g.edges.join(callee, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.round(F.avg("volatile"), 6).alias("ratio"))
    return _rule(ratio, "unstable_dependency", (F.col("n") >= 5) & (F.col("ratio") >= 0.5), F.when(F.col("ratio") >= 0.75, "medium").otherwise("low"), F.col("ratio"))


def self_recursion(g: Graph) -> DataFrame:
    return g.edges.where("src = dst").select(F.lit("self_recursion").alias("code"), F.lit("low").alias("severity"), F.col("src").alias("node_id"), F.col("count").cast("double").alias("value"))


def paradigm(g: Graph) -> DataFrame:
    """One row: the share of methods, the mean purity and the style that they show."""
    row = g.defs.agg(F.round(F.avg((F.col("kind") == "method").cast("double")), 6).alias("methods"), F.round(F.avg(purity()), 6).alias("purity"))
    style = F.when(F.col("methods") >= 0.6, "object_oriented").when((F.col("methods") <= 0.35) & (F.col("purity") >= 0.6), "functional").otherwise("mixed")
    return row.withColumn("style", style)


def paradigm_note(g: Graph) -> DataFrame:
    """The diagnostic of ``paradigm``; it belongs to no node."""
    none = F.lit(None).cast(g.nodes.schema["node_id"].dataType)
    return paradigm(g).select(F.lit("paradigm_profile").alias("code"), F.lit("info").alias("severity"), none.alias("node_id"), F.col("methods").alias("value"))


def diagnostics(g: Graph, cycles: bool = True) -> DataFrame:
    """All diagnostics of the default rules. ``cycles`` may leave out the rule that walks the whole graph."""
    from .flows import async_blocking, loop_diagnostics

    found = [complexity(g), hazards(g), impure_hotspots(g), layering(g), paradigm_note(g), async_blocking(g), loop_diagnostics(g)]
    return _all([*found, cycle_diagnostics(g)] if cycles else found)


def extended(g: Graph) -> DataFrame:
    """The diagnostics of the rules that are off by default."""
    return _all([recursion_cycles(g), self_recursion(g), dead_code(g), god_functions(g), hotspots(g), unstable_dependencies(g)])


def sort_diagnostics(found: DataFrame) -> DataFrame:
    """Diagnostics as reported: worst first, those of no node before others, then by code."""
    return found.orderBy(F.desc(severity_rank()), F.asc_nulls_first("node_id"), "code", "value")


def severity_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


#: The layer that a module segment names, innermost first; the last match of a path counts.
LAYERS = [
    "domain entities entity model models core",
    "application app usecase use_case usecases service services logic",
    "interface interfaces adapter adapters api presentation handler handlers controller controllers",
    "infrastructure infra framework frameworks db database persistence repository repositories repo io net http web fs",
]
MVC = ["model models entity entities domain", "view views template templates component components", "controller controllers handler handlers route routes"]
#: Words that speak for a kind of project.
VERTICALS = {
    "embedded": "embedded hal cortex gpio peripheral interrupt isr firmware rtic rtos microcontroller stm32 riscv nostd register mmio",
    "game_engine": "bevy wgpu winit glam sprite ecs shader mesh texture frame vertex renderer physics collider entity gameloop",
    "backend": "axum actix tokio hyper tonic sqlx diesel rocket warp router handler service repository grpc endpoint middleware database server",
    "full_stack": "leptos yew dioxus sycamore seed dom html wasm component hydrate jsx props signal reactive viewmodel",
}


def layer(module_path: Column, layers: list[str]) -> Column:
    """The index of the layer that the last matching segment names, else null."""
    of = lambda x: reduce(lambda c, k: c.when(x.isin(layers[k].split()), k), range(1, len(layers)), F.when(x.isin(layers[0].split()), 0))
    return F.try_element_at(F.filter(F.transform(F.split(module_path, "::"), of), lambda k: k.isNotNull()), F.lit(-1))


def _across(g: Graph, layers: list[str]) -> DataFrame:
    end = lambda name, new: g.defs.select(F.col("node_id").alias(name), layer(F.col("module_path"), layers).alias(new)).where(F.col(new).isNotNull())
    return g.edges.where("src <> dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst")


def layering(g: Graph, style: str = "clean") -> DataFrame:
    """One diagnostic for each edge from an inner layer outward; in mvc from a model to the others."""
    code, layers, on = ("mvc_violation", MVC, "a = 0 and b > 0") if style == "mvc" else ("layering_violation", LAYERS, "a < b")
    return _across(g, layers).where(on).select(F.lit(code).alias("code"), F.lit("medium").alias("severity"), F.col("src").alias("node_id"), F.col("dst").cast("double").alias("value"))


def vertical_scores(g: Graph) -> DataFrame:
    """(vertical, score): hits of each vertical's words in qualified names and module paths."""
    words = g.nodes.sparkSession.createDataFrame([(v, w) for v, text in VERTICALS.items() for w in text.split()], "vertical string, word string")
    tokens = g.nodes.select(F.explode(F.split(F.lower(F.concat_ws(" ", "qualified_name", "module_path")), "[^a-z0-9]+")).alias("word"))
    hits = tokens.groupBy("word").count().join(F.broadcast(words), "word").groupBy("vertical").agg(F.sum("count").alias("score"))
    return words.select("vertical").distinct().join(hits, "vertical", "left").select("vertical", F.coalesce("score", F.lit(0)).alias("score"))


def detect_vertical(g: Graph) -> str:
    """The vertical with the highest score, if that is 3 or more and no other has it."""
    top = vertical_scores(g).orderBy(F.desc("score")).limit(2).collect()
    return top[0]["vertical"] if top[0]["score"] >= 3 and top[0]["score"] > top[1]["score"] else "unknown"


def _members(g: Graph) -> DataFrame:
    """(node_id, component, size) of each cycle; a function that only calls itself is one of size 1."""
    from .iterate import cycles

    found = cycles(g)
    loops = g.edges.where("src = dst").select(F.col("src").alias("node_id")).distinct().join(found, "node_id", "left_anti").withColumn("component", F.col("node_id"))
    rows = found.unionByName(loops)
    return rows.join(rows.groupBy("component").agg(F.count("*").alias("size")), "component")


def cycle_diagnostics(g: Graph) -> DataFrame:
    """One diagnostic a cycle: its head has most callers; small or one-scope cycles weigh little."""
    rows = _members(g).join(g.nodes.select("node_id", "qualified_name", "module_path"), "node_id").join(degrees(g).select("node_id", "fan_in"), "node_id")
    best = F.min_by("node_id", F.struct(-F.col("fan_in"), "qualified_name"))
    one = rows.groupBy("component").agg(best.alias("node_id"), F.count("*").alias("n"), F.countDistinct("module_path").alias("scopes"))
    level = F.when((F.col("n") == 1) | (F.col("scopes") == 1), "low").when((F.col("n") >= 6) | (F.col("scopes") >= 3), "high").otherwise("medium")
    return _rule(one, "cycle", F.lit(True), level, F.col("n"))


def recursion_cycles(g: Graph) -> DataFrame:
    """One diagnostic for each member of a cycle of two or more."""
    return _rule(_members(g), "recursion_cycle", F.col("size") >= 2, F.when(F.col("size") >= 4, "high").otherwise("medium"), F.col("size"))


def cyclicity(g: Graph) -> DataFrame:
    """One row: the share of all nodes that are on a cycle."""
    return _members(g).agg(F.count("*").alias("n")).crossJoin(g.nodes.agg(F.count("*").alias("total"))).select(F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("cyclicity"))  # one row each

