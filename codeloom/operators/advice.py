"""Advisors and findings: what to do about the diagnostics, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import flows, lenses
from .graph import Graph
from .navigate import location, short

PER_CODE = 8
MAX_SUGGESTIONS = 50
#: Fixed values of the advisors: rule, code, base, step and cap of the priority, targets.
RULES = [
    ("complexity", "high_complexity", 60, 3, 90, "maintainability,robustness"),
    ("hazards", "unsafe_usage", 65, 2, 88, "robustness"),
    ("allocations", "heap_pressure", 60, 2, 85, "performance,latency"),
    ("layering", "layering_violation", 62, 2, 88, "maintainability,scalability"),
    ("layering", "mvc_violation", 62, 2, 88, "maintainability,scalability"),
    ("purity", "impure_hotspot", 55, 2, 80, "robustness,maintainability"),
    ("async_blocking", "async_blocking", 70, 1, 95, "latency,scalability"),
    ("n_plus_one", "n_plus_one", 65, 2, 88, "performance,latency"),
    ("clone_in_loop", "clone_in_loop", 50, 2, 88, "performance,latency"),
]
#: Fixed values of the extended advisors: one suggestion a rule; plain recursion adds one a diagnostic.
EXTENDED = [
    ("dead_code", "dead_code", 55, 2, 85, "robustness,maintainability"),
    ("god_function", "god_function", 60, 3, 90, "maintainability,scalability"),
    ("hotspot", "hotspot", 60, 2, 90, "performance,latency"),
    ("unstable_dependency", "unstable_dependency", 55, 2, 82, "maintainability,robustness"),
    ("recursion", "recursion_cycle", 60, 2, 90, "maintainability,robustness"),
    ("recursion", "self_recursion", 60, 1, 90, "maintainability,robustness"),
]
#: How much more a hotspot weighs in some kinds of projects.
HOTSPOT_BUMP = {"game_engine": 8, "embedded": 6, "backend": 4}
#: What a kind of project asks for: priority, targets and the codes to start at.
VERTICAL_ADVICE = {
    "embedded": (70, "performance,robustness", ["heap_pressure", "unsafe_usage"]),
    "game_engine": (70, "performance,latency", ["clone_in_loop", "heap_pressure", "n_plus_one"]),
    "backend": (68, "scalability,robustness", ["async_blocking", "n_plus_one", "impure_hotspot"]),
    "full_stack": (60, "performance,maintainability", ["high_complexity", "heap_pressure"]),
}
TARGETS = ["scalability", "maintainability", "robustness", "latency", "performance"]
COLUMNS = ["rule", "code", "node_id", "more", "priority", "targets"]


def _rules(found: DataFrame, rules: list[tuple]) -> DataFrame:
    return F.broadcast(found.sparkSession.createDataFrame(rules, "rule string, code string, base int, step int, cap int, targets string"))


def node_suggestions(found: DataFrame) -> DataFrame:
    """For each rule its first ``PER_CODE`` diagnostics in report order, and one row for the rest of them.

    The priority grows with the number of the rule's diagnostics up to a cap; the row for the rest is 5 below.
    """
    rows = found.join(_rules(found, RULES), "code")
    counts = rows.groupBy("rule").agg(F.count("*").alias("n"))
    order = Window.partitionBy("rule").orderBy(F.col("code"), F.desc(lenses.severity_rank()), "node_id", "value")
    first = _top(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_CODE)).join(F.broadcast(counts), "rule")
    priority = F.least(F.col("base") + F.col("step") * F.col("n"), F.col("cap")).cast("int")
    each = first.select("rule", "code", "node_id", F.lit(0).cast("long").alias("more"), priority.alias("priority"), "targets")
    rest = counts.where(F.col("n") > PER_CODE).join(_rules(found, RULES).groupBy("rule", "base", "step", "cap", "targets").agg(F.min("code").alias("code")), "rule")
    none = F.lit(None).cast(found.schema["node_id"].dataType)
    return each.unionByName(rest.select("rule", "code", none.alias("node_id"), (F.col("n") - PER_CODE).alias("more"), (priority - 5).alias("priority"), "targets"))


def _top(rows: DataFrame) -> DataFrame:
    return rows.select("rule", "code", "node_id", "base", "step", "cap", "targets")


def cycle_suggestion(found: DataFrame, cyclicity: DataFrame) -> DataFrame:
    """At most one row: the worst cycle, weighing as much as the share of entangled functions; plain recursion weighs little."""
    cycles = found.where("code = 'cycle'")
    worst = cycles.agg(F.max_by(F.struct("node_id", "severity"), F.struct(lenses.severity_rank(), "value", -F.col("node_id"))).alias("w"), F.count("*").alias("n"))
    pct = F.round(F.col("cyclicity") * 100).cast("int")
    plain = F.coalesce(F.col("w.severity") == "low", F.lit(False))
    priority = F.when(plain, F.least(30 + F.col("n"), F.lit(45))).otherwise(F.least(60 + pct, F.lit(90))).cast("int")
    rows = worst.crossJoin(cyclicity).where("cyclicity > 0")  # one row each
    return rows.select(F.lit("cycles").alias("rule"), F.lit("cycle").alias("code"), F.col("w.node_id").alias("node_id"), F.lit(0).cast("long").alias("more"), priority.alias("priority"), F.lit("maintainability,scalability").alias("targets"))


def vertical_suggestion(found: DataFrame, vertical: str) -> DataFrame:
    """One row for a known vertical, at the worst diagnostic of the first of its codes that has any."""
    none = F.lit(None).cast(found.schema["node_id"].dataType)
    if vertical not in VERTICAL_ADVICE:
        return found.limit(0).select(F.lit("vertical").alias("rule"), "code", "node_id", F.lit(0).cast("long").alias("more"), F.lit(0).alias("priority"), F.lit("").alias("targets"))
    priority, targets, codes = VERTICAL_ADVICE[vertical]
    rank = F.array_position(F.array(*map(F.lit, codes)), F.col("code"))
    at = found.where(F.col("code").isin(codes) & F.col("node_id").isNotNull()).agg(F.min_by("node_id", F.struct(rank, -lenses.severity_rank(), "node_id")).alias("node_id"))
    return at.select(F.lit("vertical").alias("rule"), F.lit(vertical).alias("code"), F.coalesce("node_id", none).alias("node_id"), F.lit(0).cast("long").alias("more"), F.lit(priority).alias("priority"), F.lit(targets).alias("targets"))


def extended_suggestions(found: DataFrame, vertical: str = "unknown") -> DataFrame:
    """One row for each extended rule that has diagnostics."""
    rows = found.join(_rules(found, EXTENDED), "code")
    sums = rows.groupBy("rule", "base", "cap", "targets").agg(F.sum("step").alias("more_weight"), F.min("code").alias("code"))
    bump = F.when(F.col("rule") == "hotspot", HOTSPOT_BUMP.get(vertical, 0)).otherwise(0)
    none = F.lit(None).cast(found.schema["node_id"].dataType)
    return sums.select("rule", "code", none.alias("node_id"), F.lit(0).cast("long").alias("more"), F.least(F.col("base") + F.col("more_weight") + bump, F.col("cap")).cast("int").alias("priority"), "targets")


def rescale(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Priorities times the largest weight of their targets, rounded, from 0 to 100."""
    weights = {t: 1.0 for t in TARGETS} | (weights or {})
    table = F.create_map(*(x for t, w in weights.items() for x in (F.lit(t), F.lit(float(w)))))
    weight = F.coalesce(F.array_max(F.transform(F.filter(F.split("targets", ","), lambda t: t != ""), lambda t: F.element_at(table, t))), F.lit(1.0))
    return rows.withColumn("priority", F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.col("priority") * weight).cast("int"))))


def suggestions(found: DataFrame, cyclicity: DataFrame | None = None, vertical: str = "unknown", weights: dict[str, float] | None = None, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """The ``most`` suggestions of highest priority, ties by rule and node."""
    parts = [node_suggestions(found), vertical_suggestion(found, vertical)]
    if cyclicity is not None:
        parts.append(cycle_suggestion(found, cyclicity))
    rows = rescale(reduce(DataFrame.unionByName, [p.select(COLUMNS) for p in parts]), weights)
    return rows.orderBy(F.desc("priority"), "rule", "code", F.asc_nulls_last("node_id")).limit(most)


# Findings: priority (0 is worst), dimension, kind, title, at, symbol, evidence, weight

FINDING = ["priority", "dimension", "kind", "title", "at", "symbol", "evidence", "weight"]


def _finding(rows: DataFrame, priority: Column | int, dimension: str, kind: str, title: Column, at: Column, symbol: Column, evidence: Column, weight: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    values = [lit(priority).cast("int"), F.lit(dimension), F.lit(kind), title, at.cast("string"), symbol.cast("string"), evidence, weight.cast("long")]
    return rows.select(*(v.alias(c) for v, c in zip(values, FINDING, strict=True)))


def _evidence(*pairs: tuple[str, Column | str]) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k} "), (F.col(c) if isinstance(c, str) else c).cast("string")) for k, c in pairs))


def _named(g: Graph, key: str) -> DataFrame:
    return g.nodes.select(F.col("node_id").alias(key), F.col("qualified_name").alias(f"{key}_name"), F.col("file").alias(f"{key}_file"), F.col("start_line").alias(f"{key}_line"))


def async_findings(g: Graph, max_depth: int = 4) -> DataFrame:
    """One finding a crate whose async functions block, with their three most frequent blocking calls."""
    levels = flows.blocking_levels(g, max(max_depth, 1) - 1)
    calls = flows.async_calls(g, max_depth).join(flows.sinks(levels).withColumnRenamed("node_id", "target"), "target").join(_named(g, "node_id"), "node_id")
    calls = calls.withColumn("crate", F.substring_index("node_id_name", "::", 1)).join(g.nodes.select(F.col("node_id").alias("sink"), short(F.col("qualified_name")).alias("sink_name")), "sink")
    top = Window.partitionBy("crate").orderBy(F.desc("n"), "sink_name")
    names = calls.groupBy("crate", "sink_name").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(top)).where("r <= 3").groupBy("crate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" x", "sink_name", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("sinks"))
    first = F.min_by(F.struct("node_id_name", "node_id_file", "line"), F.struct(-F.col("calls"), "node_id"))
    rows = calls.groupBy("crate").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), first.alias("f")).join(names, "crate")
    title = F.concat(F.col("crate"), F.lit(": "), F.col("n").cast("string"), F.lit(" async functions run blocking calls ("), F.col("sinks"), F.lit(")"))
    return _finding(rows, 0, "perf", "async_blocking", title, location(F.col("f.node_id_file"), F.col("f.line")), F.col("f.node_id_name"), _evidence(("async_fns", "n"), ("blocking_call_sites", "calls")), F.col("n") * 100 + F.col("calls"))


def loop_findings(g: Graph, max_depth: int = 4) -> DataFrame:
    """One finding for each caller that does I/O in a loop, and one for each heavy copy in a loop."""
    calls = flows.loop_calls(g, max_depth).join(_named(g, "src"), "src").join(g.nodes.select(F.col("node_id").alias("dst"), "qualified_name"), "dst")
    one = calls.where("code = 'n_plus_one'").groupBy("src", "src_name", "src_file").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_set(short(F.col("qualified_name")))), ", ").alias("callees"))
    io = _finding(one, 1, "perf", "n_plus_one", F.concat(short(F.col("src_name")), F.lit(" does I/O in a loop: "), F.col("callees")), location(F.col("src_file"), F.col("line")), F.col("src_name"), _evidence(("io_calls_in_loop", "n")), F.col("n") + 50)
    copies = calls.where("code = 'clone_in_loop'")
    return io.unionByName(_finding(copies, 2, "perf", "clone_in_loop", F.concat(F.col("src_name"), F.lit(" copies in a loop: "), short(F.col("qualified_name"))), location(F.col("src_file"), F.col("line")), F.col("src_name"), F.lit(""), F.lit(1)))


def cycle_findings(g: Graph) -> DataFrame:
    """One finding for each cycle that is more than plain recursion."""
    rows = lenses.cycle_diagnostics(g).where("severity <> 'low'").join(_named(g, "node_id"), "node_id")
    return _finding(rows, F.when(F.col("severity") == "high", 1).otherwise(2), "composability", "cycle", F.concat(F.lit("call cycle at "), F.col("node_id_name")), location(F.col("node_id_file"), F.col("node_id_line")), F.col("node_id_name"), _evidence(("size", F.col("value").cast("long"))), F.col("value"))


def hot_findings(g: Graph, callers: int = 8, top: int = 5) -> DataFrame:
    rows = flows.hot_io(g, callers, top).join(_named(g, "node_id"), "node_id").join(g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("count").alias("sites")), "node_id")
    return _finding(rows, 1, "perf", "hot_io_path", F.concat(short(F.col("node_id_name")), F.lit(" has "), F.col("callers").cast("string"), F.lit(" callers and may block")), location(F.col("node_id_file"), F.col("node_id_line")), F.col("node_id_name"), _evidence(("callers", "callers"), ("call_sites", "sites")), F.col("callers"))


def god_types(g: Graph, methods: int = 40, lines: int = 1500) -> DataFrame:
    """(module_path, methods, lines, file, outside_callers, anchor): types with many or long methods, tests and examples left out."""
    own = g.nodes.where("kind = 'method' and not is_test and not is_example")
    sums = own.groupBy("module_path").agg(F.count("*").alias("methods"), F.sum("lines_of_code").alias("lines"), F.min_by("node_id", F.struct("start_line", "node_id")).alias("anchor"))
    big = sums.where((F.col("methods") >= methods) | (F.col("lines") >= lines))
    files = own.groupBy("module_path", "file").agg(F.count("*").alias("n")).groupBy("module_path").agg(F.max_by("file", F.struct("n", "file")).alias("file"))
    inside = own.select("node_id", "module_path").join(big.select("module_path"), "module_path", "left_semi")
    callers = g.edges.join(inside.select(F.col("node_id").alias("dst"), "module_path"), "dst").select("src", "module_path").distinct()
    outside = callers.join(inside.select(F.col("node_id").alias("src"), "module_path"), ["src", "module_path"], "left_anti").groupBy("module_path").agg(F.count("*").alias("outside_callers"))
    return big.join(files, "module_path").join(outside, "module_path", "left").select("module_path", "methods", "lines", "file", F.coalesce("outside_callers", F.lit(0)).alias("outside_callers"), "anchor")


def god_findings(g: Graph, methods: int = 40, lines: int = 1500) -> DataFrame:
    rows = god_types(g, methods, lines).join(_named(g, "anchor"), "anchor")
    return _finding(rows, 1, "composability", "god_type", F.concat(short(F.col("module_path")), F.lit(": "), F.col("methods").cast("string"), F.lit(" methods")), location(F.col("anchor_file"), F.col("anchor_line")), F.col("module_path"), _evidence(("methods", "methods"), ("method_lines", "lines"), ("outside_callers", "outside_callers")), F.col("methods"))


def file_function_counts(g: Graph) -> DataFrame:
    return g.defs.groupBy("file").agg(F.count("*").alias("functions"))


def file_findings(g: Graph, file_lines: DataFrame, lines: int = 2000) -> DataFrame:
    """``file_lines``: (file, lines)."""
    rows = file_lines.where(F.col("lines") >= lines).join(file_function_counts(g), "file", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))
    return _finding(rows, 2, "incrementality", "big_file", F.concat(F.col("file"), F.lit(" has "), F.col("lines").cast("string"), F.lit(" lines")), F.concat("file", F.lit(":1")), F.lit(None), _evidence(("lines", "lines"), ("functions", "functions")), F.col("lines"))


def crate_findings(view: DataFrame, rebuilds: DataFrame) -> DataFrame:
    """``view``: ``crate_view``; ``rebuilds``: ``rebuild_sets``. Crates whose change rebuilds much, and those that nothing ships."""
    lines = rebuilds.join(view.select(F.col("idx").alias("other"), F.col("lines").alias("more")), "other").groupBy("idx").agg(F.sum("more").alias("rebuild_lines"))
    wide = view.where("rebuild >= 2 and lines >= 2000").join(lines, "idx", "left")
    blast = _finding(wide, F.when(F.col("lines") >= 4000, 1).otherwise(2), "incrementality", "crate_blast_radius", F.concat(F.col("name"), F.lit(": a change builds "), F.col("rebuild").cast("string"), F.lit(" crates again")), F.lit(None), F.col("name"), _evidence(("lines", "lines"), ("rebuild_crates", "rebuild"), ("rebuild_lines", "rebuild_lines"), ("calls_in", "calls_in")), F.col("lines") * (F.col("rebuild") + 1))
    idle = view.where("usage <> 'shipped'")
    return blast.unionByName(_finding(idle, 2, "incrementality", "crate_not_shipped", F.concat(F.col("name"), F.lit(" is "), F.col("usage")), F.lit(None), F.col("name"), _evidence(("lines", "lines"), ("functions", "functions")), F.col("lines")))


#: Called paths that speak for or against limits.
TIMEOUTS = ["timeout", "timeout_read", "connect_timeout"]
CLIENTS = r"(reqwest::Client::(new|builder)$|^Client::builder$|^ureq::)"
SERVERS = r"(axum::serve|TcpListener::bind|HttpServer::new|Server::bind)$"
LIMITS = [("request timeout", "TimeoutLayer|timeout"), ("body size limit", "DefaultBodyLimit|RequestBodyLimitLayer|body_limit|limit"), ("concurrency / rate limit", "ConcurrencyLimit|RateLimit|load_shed|GovernorLayer|Semaphore")]
UNBOUNDED = r"((^|::)unbounded_channel|mpsc::unbounded)$"


def limit_findings(g: Graph) -> DataFrame:
    """HTTP clients without a timeout, servers without limits, unbounded channels, by the library paths that are called."""
    outer = g.nodes.where("kind = 'external'").select(F.col("node_id").alias("dst"), "qualified_name")
    q = F.col("qualified_name")
    checks = [("client", q.rlike(CLIENTS)), ("timed", F.element_at(F.split(q, "::"), -1).isin(TIMEOUTS)), ("server", q.rlike(SERVERS)), ("unbounded", q.rlike(UNBOUNDED)), *((f"has{k}", q.rlike(words)) for k, (_, words) in enumerate(LIMITS))]
    told = outer.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in checks))  # one row
    sites = g.edges.join(outer.withColumn("client", checks[0][1]).withColumn("server", checks[2][1]).withColumn("unbounded", checks[3][1]).where("client or server or unbounded"), "dst").join(_named(g, "src"), "src")
    first = sites.agg(*(F.min_by(location(F.col("src_file"), F.col("line")), F.when(F.col(c), F.struct("src", "line"))).alias(f"{c}_at") for c in ("client", "server", "unbounded")))
    row = told.crossJoin(first)  # one row each
    missing = F.filter(F.array(*(F.when(~F.col(f"has{k}"), name) for k, (name, _) in enumerate(LIMITS))), lambda x: x.isNotNull())
    none = F.lit(None)
    return reduce(DataFrame.unionByName, [
        _finding(row.where("client and not timed"), 2, "scalability", "no_http_timeout", F.lit("HTTP client without a timeout"), F.col("client_at"), none, F.lit(""), F.lit(3)),
        _finding(row.where(F.col("server") & (F.size(missing) > 0)), 2, "scalability", "server_limits", F.concat(F.lit("server without "), F.array_join(missing, ", ")), F.col("server_at"), none, _evidence(("missing", F.size(missing))), F.lit(2)),
        _finding(row.where("unbounded"), 2, "scalability", "unbounded_channel", F.lit("unbounded channel"), F.col("unbounded_at"), none, F.lit(""), F.lit(1)),
    ])


def findings(g: Graph, file_lines: DataFrame | None = None, view: DataFrame | None = None, rebuilds: DataFrame | None = None, dimension: str | None = None, cycles: bool = True) -> DataFrame:
    """All findings, of one dimension if that is given."""
    parts = [async_findings(g), loop_findings(g), hot_findings(g), god_findings(g), limit_findings(g)]
    parts += [cycle_findings(g)] if cycles else []
    parts += [file_findings(g, file_lines)] if file_lines is not None else []
    parts += [crate_findings(view, rebuilds)] if view is not None and rebuilds is not None else []
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(F.col("dimension") == dimension) if dimension else rows


def sort_findings(rows: DataFrame) -> DataFrame:
    return rows.orderBy("priority", F.desc("weight"), "title")


def finding_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("priority").agg(F.count("*").alias("findings"))
