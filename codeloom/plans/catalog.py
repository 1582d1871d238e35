"""The registered graph queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import flows, iterate, lenses
from codeloom.operators import graph as ops
from codeloom.operators.graph import Graph
from codeloom.sources import export
from codeloom.streaming import incremental

from .fixture import WITH, graph

PURITY = "round(1.0 - (CASE WHEN allocations > 0 THEN 0.35 ELSE 0.0 END) - (CASE WHEN is_unsafe OR unsafe_blocks > 0 THEN 0.3 ELSE 0.0 END) - (CASE WHEN is_async OR awaits > 0 THEN 0.2 ELSE 0.0 END), 6)::DOUBLE"
DEGREES = f"""{WITH},
fi AS (SELECT dst AS node_id, count(*) AS n FROM edges GROUP BY 1), fo AS (SELECT src AS node_id, count(*) AS n FROM edges GROUP BY 1),
deg AS (SELECT nodes.node_id, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out FROM nodes LEFT JOIN fi USING (node_id) LEFT JOIN fo USING (node_id)),
defs AS (SELECT * FROM nodes JOIN deg USING (node_id) WHERE kind <> 'external')
"""
ENDS = f"""{WITH},
ends AS (SELECT e.*, a.module_path AS am, b.module_path AS bm, split_part(a.module_path, '::', 1) AS ac, split_part(b.module_path, '::', 1) AS bc
  FROM edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.kind <> 'external' AND b.kind <> 'external')
"""


def _lens(*rules: tuple[str, str, str, str]) -> str:
    return DEGREES + " UNION ALL ".join(f"SELECT '{code}' AS code, {severity} AS severity, node_id, ({value})::DOUBLE AS value FROM defs WHERE {when}" for code, when, severity, value in rules)


CC = "(decision_points + 1)"
COMPLEXITY = [("high_complexity", f"{CC} > 10", f"CASE WHEN {CC} >= 20 THEN 'high' ELSE 'medium' END", CC), ("too_many_parameters", "parameters > 5", "'low'", "parameters"), ("long_function", "lines_of_code > 60", "'low'", "lines_of_code"), ("deep_nesting", "max_nesting > 4", "'low'", "max_nesting")]
HAZARDS = [("unsafe_usage", "is_unsafe OR unsafe_blocks > 0", "'medium'", "unsafe_blocks"), ("heap_pressure", "allocations >= 8", "CASE WHEN allocations >= 20 THEN 'medium' ELSE 'low' END", "allocations")]
IMPURE = ("impure_hotspot", f"{PURITY} < 0.4 AND fan_in >= 3", "'low'", PURITY)


def _levels(depth: int, through_async: bool, name: str) -> str:
    """SQL of blocking levels: ``name`` (node_id, level)."""
    wait = "" if through_async else " AND NOT s.is_async"
    return f"""{name}_walk(node_id, level) AS (SELECT node_id, 0 FROM nodes WHERE kind = 'external' AND starts_with(qualified_name, 'std::fs::') UNION
  SELECT src, level + 1 FROM {name}_walk w JOIN steps_in ON dst = w.node_id JOIN nodes s ON s.node_id = src WHERE level < {depth} AND s.kind <> 'external'{wait}),
{name} AS (SELECT node_id, min(level) AS level FROM {name}_walk GROUP BY 1)"""


STEPS_IN = "steps_in AS (SELECT e.* FROM edges e JOIN nodes t ON t.node_id = e.dst WHERE e.kind <> 'spawn' AND NOT e.blocking_ok AND NOT (e.awaited AND t.kind = 'external'))"
ASYNC = f"""{STEPS_IN}, {_levels(3, False, 'la')},
ac AS (SELECT e.src AS node_id, min(la.level) + 1 AS depth, sum(e.count)::BIGINT AS calls FROM steps_in e JOIN nodes t ON t.node_id = e.dst JOIN nodes s ON s.node_id = e.src JOIN la ON la.node_id = e.dst WHERE NOT t.is_async AND s.is_async AND s.kind <> 'external' GROUP BY 1)"""
LOOPS = f"""{_levels(4, True, 'll')},
lc AS (SELECT 'n_plus_one' AS code, e.src, e.dst, ll.level AS depth, e.loop_line AS line FROM steps_in e JOIN nodes s ON s.node_id = e.src JOIN ll ON ll.node_id = e.dst WHERE e.in_loop AND e.src <> e.dst AND s.kind <> 'external'
  UNION ALL SELECT 'clone_in_loop', e.src, e.dst, 0, e.loop_line FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes t ON t.node_id = e.dst WHERE e.in_loop AND s.kind <> 'external' AND t.kind = 'external' AND t.qualified_name LIKE '%::Vec::clone')"""
BLOCKED = f"{ASYNC}, {LOOPS}"
ASYNC_ROWS = "SELECT 'async_blocking' AS code, CASE WHEN depth = 1 THEN 'high' ELSE 'medium' END AS severity, node_id, depth::DOUBLE AS value FROM ac"
LOOP_ROWS = "SELECT code, CASE WHEN code = 'n_plus_one' THEN 'medium' ELSE 'low' END AS severity, src AS node_id, depth::DOUBLE AS value FROM lc"


def _every_place(g: Graph) -> DataFrame:
    """A place in the middle of, and one after, every definition."""
    return g.defs.select("file", F.explode(F.array(F.col("start_line") + 3, F.col("end_line") + 30)).alias("line")).distinct()


EVERY_PLACE = "places AS (SELECT DISTINCT file, unnest([start_line + 3, end_line + 30]) AS line FROM nodes WHERE kind <> 'external')"
SEARCH = "plate"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crate_lines(_table(spark, sf_dir, "documents")).select("doc_id", F.col("lines").cast("long").alias("lines"))


def _excluded(g: Graph) -> DataFrame:
    kept = ops.exclude(g)
    out = kept.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edges"))
    return kept.nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("edges", F.lit(0)).alias("edges"))


def _summary(g: Graph) -> DataFrame:
    """Six counts; cycles are left out of the diagnostics, as in the SQL."""
    n = g.nodes.agg(F.count_if(F.col("kind") != "external").alias("functions"), F.count_if(F.col("kind") == "external").alias("externals"))
    e = g.edges.agg(F.count("*").alias("edges"), F.sum("count").alias("calls"))
    d = lenses.diagnostics(g, cycles=False).agg(F.count("*").alias("diagnostics"))
    return n.crossJoin(e).crossJoin(d)  # one row each


def _tested_layers(g: Graph) -> DataFrame:
    """Layering of the graph with the segments m0 to m3 renamed to one of each layer."""
    path = F.col("module_path")
    for k, words in enumerate(lenses.LAYERS):
        path = F.regexp_replace(path, f"::m{k}(?=::|$)", "::" + words.split()[0])
    return lenses.layering(Graph(g.nodes.withColumn("module_path", path), g.edges))


TESTED_LAYERS = "l AS (SELECT node_id, CASE split_part(module_path, '::', 2) WHEN 'm0' THEN 0 WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 WHEN 'm3' THEN 3 END AS k FROM nodes WHERE kind <> 'external')"
RUN_ROOTS = """, rr AS (SELECT node_id, CASE WHEN name = 'main' THEN 'program' ELSE 'exported' END AS kind, 0::BIGINT AS spawners, false AS test_only FROM defs WHERE name = 'main' OR (fan_in = 0 AND NOT is_test AND is_exported)
  UNION ALL SELECT dst, 'spawned', count(DISTINCT src), bool_and(is_test) FROM edges JOIN nodes ON node_id = src WHERE edges.kind = 'spawn' GROUP BY 1) """
TIERS = """, tiers AS (SELECT node_id, t AS tier_rank, ['program', 'exported', 'spawned', 'root', 'test'][t + 1] AS tier FROM (
  SELECT node_id, t, row_number() OVER (PARTITION BY node_id ORDER BY late, t) AS r FROM (
    SELECT node_id, CASE WHEN kind = 'program' THEN 0 WHEN kind = 'exported' THEN 1 WHEN test_only THEN 4 ELSE 2 END AS t, 0 AS late FROM rr
    UNION ALL SELECT node_id, CASE WHEN is_test THEN 4 ELSE 3 END, 1 FROM defs WHERE name <> 'main' AND fan_in = 0 AND (is_test OR NOT is_exported))) WHERE r = 1) """
PARADIGM = f"p AS (SELECT round(avg((kind = 'method')::INT), 6)::DOUBLE AS methods, round(avg(({PURITY})), 6)::DOUBLE AS purity FROM nodes WHERE kind <> 'external')"
#: All diagnostics but cycles: the CTEs, and the rows.
FOUND = f"{DEGREES}, {BLOCKED}, {PARADIGM}, found AS ({_lens(*COMPLEXITY, *HAZARDS, IMPURE).removeprefix(DEGREES)} UNION ALL SELECT 'paradigm_profile', 'info', NULL, methods FROM p UNION ALL {ASYNC_ROWS} UNION ALL {LOOP_ROWS}) "
CLOSURE = f"""{DEGREES}, cl(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM cl JOIN edges ON src = b),
scc AS (SELECT x.a AS node_id, min(x.b) AS component, count(DISTINCT x.b) AS size FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""

#: name: (operator on the graph, SQL or None)
GRAPH: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {
    "nodes": (lambda g: g.nodes, WITH + "SELECT * FROM nodes"),
    "merge_edges": (lambda g: g.edges, WITH + "SELECT * FROM edges"),
    "degrees": (ops.degrees, DEGREES + "SELECT * FROM deg"),
    "entry_points": (ops.entry_kinds, DEGREES + "SELECT node_id, qualified_name, CASE WHEN name = 'main' THEN 'main' WHEN is_test THEN 'test' WHEN is_exported THEN 'exported' WHEN is_pub THEN 'public' ELSE 'root' END AS entry FROM defs WHERE name = 'main' OR fan_in = 0"),
    "neighbors": (lambda g: ops.neighbors(g, 5), WITH + "SELECT 'out' AS side, dst AS other, qualified_name, e.kind, count FROM edges e JOIN nodes ON node_id = dst WHERE src = 5 UNION ALL SELECT 'in', src, qualified_name, e.kind, count FROM edges e JOIN nodes ON node_id = src WHERE dst = 5"),
    "branches": (ops.branches, WITH + "SELECT src, dst, min(line) AS line, sum(count)::BIGINT AS count, max((kind = 'spawn')::INT) AS spawned, max((dst IN (SELECT src FROM edges))::INT) AS has_branches FROM edges GROUP BY src, dst"),
    "flags_of": (ops.tags, WITH + "SELECT node_id, concat_ws(',', CASE WHEN is_pub THEN 'pub' END, CASE WHEN is_async THEN 'async' END, CASE WHEN is_unsafe THEN 'unsafe' END, CASE WHEN is_test THEN 'test' END, CASE WHEN is_exported THEN 'export' END) AS tags FROM nodes WHERE kind <> 'external'"),
    "span": (ops.spans, WITH + "SELECT node_id, concat(file, ':', start_line, '-', greatest(start_line, end_line)) AS span FROM nodes WHERE kind <> 'external' AND start_line > 0"),
    "node_at": (lambda g: ops.node_at(g, _every_place(g)), f"{WITH}, {EVERY_PLACE} SELECT file, line, node_id FROM (SELECT p.file, p.line, node_id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY end_line - start_line, start_line DESC, node_id) AS r FROM places p JOIN nodes n ON n.file = p.file AND p.line BETWEEN start_line AND end_line) WHERE r = 1"),
    "nearest_at": (lambda g: ops.nearest_at(g, _every_place(g)), f"{WITH}, {EVERY_PLACE} SELECT file, line, node_id, gap FROM (SELECT p.file, p.line, node_id, greatest(0, start_line - p.line, p.line - end_line) AS gap, row_number() OVER (PARTITION BY p.file, p.line ORDER BY greatest(0, start_line - p.line, p.line - end_line), start_line DESC, node_id) AS r FROM places p JOIN nodes n ON n.file = p.file) WHERE r = 1"),
    "resolve": (lambda g: ops.resolve(g, SEARCH), WITH + f"SELECT node_id, qualified_name, CASE WHEN lower(qualified_name) = '{SEARCH}' THEN 0 WHEN lower(name) = '{SEARCH}' THEN 1 WHEN lower(qualified_name) LIKE '%::{SEARCH}' THEN 2 ELSE 3 END AS rank, strlen(qualified_name)::INT AS bytes FROM nodes WHERE kind <> 'external' AND contains(lower(qualified_name), '{SEARCH}')"),
    "outline": (ops.outline, WITH + "SELECT scope, count(*) AS functions FROM (SELECT unnest(list_distinct([split_part(module_path, '::', 1), concat(split_part(module_path, '::', 1), '::', split_part(module_path, '::', 2)), module_path])) AS scope FROM nodes WHERE kind <> 'external') GROUP BY scope"),
    "module_functions": (ops.module_functions, WITH + "SELECT module_path, count(*) AS functions FROM nodes WHERE kind <> 'external' GROUP BY 1"),
    "module_edges": (ops.module_edges, ENDS + "SELECT am AS a, bm AS b, count(*) AS edges FROM ends WHERE am <> bm GROUP BY 1, 2"),
    "cross_crate_calls": (ops.cross_crate_calls, ENDS + "SELECT ac AS a, bc AS b, count(*) AS pairs, sum(count)::BIGINT AS calls FROM ends WHERE ac <> bc GROUP BY 1, 2"),
    "group_weights": (ops.group_weights, ENDS + ", w AS (SELECT ac AS a, bc AS b, sum(greatest(count, 1))::BIGINT AS weight FROM ends WHERE ac <> bc AND kind IN ('direct_call', 'associated_call', 'spawn') GROUP BY 1, 2) SELECT w.a, w.b, w.weight FROM w LEFT JOIN w x ON x.a = w.b AND x.b = w.a WHERE w.weight >= coalesce(x.weight, 0)"),
    "call_volume": (ops.call_volume, WITH + "SELECT dst AS node_id, sum(count)::BIGINT AS volume FROM edges GROUP BY 1"),
    "exclude": (_excluded, WITH + """, i AS (SELECT node_id FROM nodes WHERE kind <> 'external' AND NOT is_test AND NOT is_example), e AS (SELECT * FROM edges WHERE src IN (SELECT node_id FROM i)),
o AS (SELECT node_id FROM nodes WHERE kind = 'external' AND (node_id IN (SELECT dst FROM e) OR node_id NOT IN (SELECT dst FROM edges))), a AS (SELECT * FROM i UNION ALL SELECT * FROM o)
SELECT a.node_id, count(src) AS edges FROM a LEFT JOIN (SELECT * FROM e WHERE dst IN (SELECT node_id FROM a)) x ON x.src = a.node_id GROUP BY 1"""),
    "metrics_compute": (lenses.metrics, DEGREES + f"SELECT node_id, unnest(['cyclomatic', 'fan_in', 'fan_out', 'heap', 'purity']) AS kind, unnest([{CC}::DOUBLE, fan_in::DOUBLE, fan_out::DOUBLE, allocations::DOUBLE, {PURITY}]) AS value FROM defs"),
    "lens_complexity": (lenses.complexity, _lens(*COMPLEXITY)),
    "lens_hazards": (lenses.hazards, _lens(*HAZARDS)),
    "lens_purity": (lenses.impure_hotspots, _lens(IMPURE)),
    "lens_dead_code": (lenses.dead_code, _lens(("dead_code", "fan_in = 0 AND NOT is_test AND NOT is_pub AND name <> 'main'", "'low'", "lines_of_code"))),
    "lens_god_function": (lenses.god_functions, _lens(("god_function", "least(fan_in, fan_out) >= 8", "CASE WHEN least(fan_in, fan_out) >= 16 THEN 'high' ELSE 'medium' END", "least(fan_in, fan_out)"))),
    "lens_hotspot": (lenses.hotspots, DEGREES + ", v AS (SELECT dst AS node_id, sum(count) AS volume FROM edges GROUP BY 1) SELECT 'hotspot' AS code, CASE WHEN fan_in >= 12 OR volume >= 32 THEN 'high' ELSE 'medium' END AS severity, node_id, volume::DOUBLE AS value FROM defs JOIN v USING (node_id) WHERE fan_in >= 2 AND (fan_in >= 6 OR volume >= 16)"),
    "lens_unstable_dependency": (lenses.unstable_dependencies, DEGREES + f", r AS (SELECT src AS node_id, count(*) AS n, round(avg(({CC} > 10 OR fan_in >= 10)::INT), 6) AS ratio FROM edges JOIN defs ON defs.node_id = dst GROUP BY 1) SELECT 'unstable_dependency' AS code, CASE WHEN ratio >= 0.75 THEN 'medium' ELSE 'low' END AS severity, node_id, ratio::DOUBLE AS value FROM r WHERE n >= 5 AND ratio >= 0.5"),
    "lens_self_recursion": (lenses.self_recursion, WITH + "SELECT 'self_recursion' AS code, 'low' AS severity, src AS node_id, count::DOUBLE AS value FROM edges WHERE src = dst"),
    "reachable": (lambda g: iterate.reachable(g, [0, 1]), WITH + ", r(node_id, depth) AS (SELECT node_id, 0 FROM nodes WHERE node_id IN (0, 1) UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = r.node_id WHERE depth < 64) SELECT node_id, min(depth) AS depth FROM r GROUP BY 1"),
    "impact": (lambda g: iterate.impact(g, 7, 6), WITH + ", r(node_id, depth) AS (SELECT node_id, 0 FROM nodes WHERE node_id = 7 UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = r.node_id WHERE depth < 6) SELECT depth, count(*) AS callers FROM (SELECT node_id, min(depth) AS depth FROM r GROUP BY 1) WHERE depth > 0 GROUP BY 1"),
    "lens_layering": (_tested_layers, f"{WITH}, {TESTED_LAYERS} SELECT 'layering_violation' AS code, 'medium' AS severity, src AS node_id, dst::DOUBLE AS value FROM edges JOIN l a ON a.node_id = src JOIN l b ON b.node_id = dst WHERE src <> dst AND a.k < b.k"),
    "vertical_scores": (lenses.vertical_scores, WITH + f", v AS (SELECT * FROM (VALUES {', '.join(str((v, w)) for v, words in lenses.VERTICALS.items() for w in words.split())}) t(vertical, word)), t AS (SELECT unnest(regexp_split_to_array(lower(concat(qualified_name, ' ', module_path)), '[^a-z0-9]+')) AS word FROM nodes) SELECT v.vertical, count(t.word)::BIGINT AS score FROM v LEFT JOIN t USING (word) GROUP BY 1"),
    "run_roots": (flows.run_roots, DEGREES + RUN_ROOTS + "SELECT node_id, kind, spawners, test_only FROM rr"),
    "entry_tiers": (flows.entry_tiers, DEGREES + RUN_ROOTS + TIERS + "SELECT node_id, tier, tier_rank FROM tiers"),
    "flows_from_entries": (lambda g: flows.flows_from_entries(g, 7, None), DEGREES + RUN_ROOTS + TIERS.rstrip(", \n") + ", u(node_id, depth) AS (SELECT node_id, 0 FROM nodes WHERE node_id = 7 UNION SELECT src, depth + 1 FROM u JOIN edges ON dst = u.node_id WHERE depth < 64), d AS (SELECT node_id, min(depth) AS hops FROM u GROUP BY 1) SELECT node_id, tier, hops, row_number() OVER (ORDER BY tier_rank, hops, qualified_name)::INT AS rank FROM tiers JOIN d USING (node_id) JOIN nodes USING (node_id)"),
    "reach_counts": (lambda g: flows.reach_counts(g, g.nodes.where("name = 'main'")), WITH + ", r(root, node_id) AS (SELECT node_id, node_id FROM nodes WHERE name = 'main' UNION SELECT root, dst FROM r JOIN edges ON src = r.node_id) SELECT root AS node_id, count(CASE WHEN nodes.kind <> 'external' AND root <> r.node_id THEN 1 END) AS reach FROM r JOIN nodes ON nodes.node_id = r.node_id GROUP BY 1"),
    "impact_callers": (lambda g: flows.impact_callers(g, 7, 4), DEGREES + ", u(node_id, depth) AS (SELECT node_id, 0 FROM nodes WHERE node_id = 7 UNION SELECT src, depth + 1 FROM u JOIN edges ON dst = u.node_id WHERE depth < 4), d AS (SELECT node_id, min(depth) AS depth FROM u GROUP BY 1) SELECT d.node_id, d.depth, arg_min(p.node_id, n.qualified_name) AS via, any_value(CASE WHEN x.name = 'main' THEN 'main' WHEN x.fan_in > 0 THEN NULL WHEN x.is_test THEN 'test' WHEN x.is_exported THEN 'exported' WHEN x.is_pub THEN 'public' ELSE 'root' END) AS entry FROM d JOIN edges e ON e.src = d.node_id JOIN d p ON p.node_id = e.dst AND p.depth = d.depth - 1 JOIN nodes n ON n.node_id = p.node_id JOIN defs x ON x.node_id = d.node_id GROUP BY 1, 2"),
    "shortest_paths": (lambda g: flows.shortest_paths(g, [0, 1], 7).select(F.array_join("path", ">").alias("path")), None),
    "call_tree": (lambda g: flows.call_tree(g, 5), None),
    "suggest": (lambda g: text.suggest(g.defs, "palte"), None),
    "export_json": (export.json_rows, None),
    "lens_paradigm": (lenses.paradigm, f"{WITH}, {PARADIGM} SELECT methods, purity, CASE WHEN methods >= 0.6 THEN 'object_oriented' WHEN methods <= 0.35 AND purity >= 0.6 THEN 'functional' ELSE 'mixed' END AS style FROM p"),
    "blocking_levels": (lambda g: flows.blocking_levels(g, 4), f"{WITH}, {STEPS_IN}, {_levels(4, False, 'l')} SELECT l.node_id, any_value(l.level) AS level, arg_min(p.node_id, n.qualified_name) AS next FROM l LEFT JOIN steps_in ON src = l.node_id LEFT JOIN l p ON p.node_id = dst AND p.level = l.level - 1 LEFT JOIN nodes n ON n.node_id = p.node_id GROUP BY 1"),
    "lens_async_blocking": (flows.async_blocking, f"{WITH}, {ASYNC} {ASYNC_ROWS}"),
    "async_calls": (lambda g: flows.async_calls(g).select("node_id", "depth", "calls"), f"{WITH}, {ASYNC} SELECT * FROM ac"),
    "lens_loops": (flows.loop_diagnostics, f"{WITH}, {STEPS_IN}, {LOOPS} {LOOP_ROWS}"),
    "loop_calls": (flows.loop_calls, f"{WITH}, {STEPS_IN}, {LOOPS} SELECT * FROM lc"),
    "diag_counts": (lambda g: lenses.diagnostics(g, cycles=False).groupBy("code", "severity").agg(F.count("*").alias("n")), FOUND + "SELECT code, severity, count(*) AS n FROM found GROUP BY 1, 2"),
    "summary": (_summary, FOUND + "SELECT (SELECT count(*) FROM nodes WHERE kind <> 'external') AS functions, (SELECT count(*) FROM nodes WHERE kind = 'external') AS externals, (SELECT count(*) FROM edges) AS edges, (SELECT sum(count)::BIGINT FROM edges) AS calls, (SELECT count(*) FROM found) AS diagnostics"),
    "cycles": (iterate.cycles, CLOSURE + " SELECT node_id, component FROM scc WHERE size > 1"),
    "lens_cycles": (lenses.cycle_diagnostics, CLOSURE + ", m AS (SELECT * FROM scc JOIN defs USING (node_id)), o AS (SELECT component, arg_min(node_id, lpad((1000000 - fan_in)::VARCHAR, 8, '0') || qualified_name) AS node_id, count(*) AS n, count(DISTINCT module_path) AS scopes FROM m GROUP BY 1) SELECT 'cycle' AS code, CASE WHEN n = 1 OR scopes = 1 THEN 'low' WHEN n >= 6 OR scopes >= 3 THEN 'high' ELSE 'medium' END AS severity, node_id, n::DOUBLE AS value FROM o"),
    "lens_recursion": (lenses.recursion_cycles, CLOSURE + " SELECT 'recursion_cycle' AS code, CASE WHEN size >= 4 THEN 'high' ELSE 'medium' END AS severity, node_id, size::DOUBLE AS value FROM scc WHERE size >= 2"),
    "cyclicity": (lenses.cyclicity, CLOSURE + " SELECT (SELECT count(*) FROM scc) / (SELECT count(*) FROM nodes)::DOUBLE AS cyclicity"),
    "hot_io": (flows.hot_io, f"{WITH}, {STEPS_IN}, {_levels(4, True, 'l')} SELECT node_id, callers, level FROM (SELECT dst AS node_id, count(DISTINCT src) AS callers FROM edges WHERE src <> dst GROUP BY 1) JOIN l USING (node_id) JOIN nodes USING (node_id) WHERE callers >= 8 AND kind <> 'external' ORDER BY callers DESC, node_id LIMIT 5"),
    "ranked_roots": (flows.ranked_roots, DEGREES + RUN_ROOTS + """, rs AS (SELECT DISTINCT node_id FROM rr), r(root, node_id) AS (SELECT node_id, node_id FROM rs UNION SELECT root, dst FROM r JOIN edges ON src = r.node_id),
c AS (SELECT root AS node_id, count(CASE WHEN nodes.kind <> 'external' AND root <> r.node_id THEN 1 END) AS reach FROM r JOIN nodes ON nodes.node_id = r.node_id GROUP BY 1),
x AS (SELECT rr.*, reach, kind <> 'spawned' AND node_id = (SELECT node_id FROM rr JOIN c USING (node_id) WHERE kind <> 'spawned' ORDER BY reach DESC, node_id LIMIT 1) AS "primary" FROM rr JOIN c USING (node_id))
SELECT *, row_number() OVER (ORDER BY "primary" DESC, CASE kind WHEN 'program' THEN 0 WHEN 'exported' THEN 1 ELSE 2 END, test_only, reach DESC, node_id)::INT AS rank FROM x"""),
    "export_dot": (lambda g: export.dot(g).select("part", "line"), WITH + """SELECT 0 AS part, concat('digraph codeloom {', chr(10), '  rankdir=LR;', chr(10), '  node [shape=box, fontname="monospace"];') AS line UNION ALL
SELECT 1, concat('  ', node_id, ' [label="', name, '", tooltip="', qualified_name, '"', CASE WHEN kind = 'external' THEN ', style=dashed, color=gray' WHEN decision_points + 1 > 10 THEN ', color=red' ELSE '' END, '];') FROM nodes UNION ALL
SELECT 2, concat('  ', src, ' -> ', dst, ' [label="', kind, '"];') FROM edges UNION ALL SELECT 3, '}'"""),
    "export_graphml": (lambda g: export.graphml(g).where("part > 0 and part < 3").select("part", "line"), WITH + """SELECT 1 AS part, concat('    <node id="', node_id, '"><data key="name">', name, '</data><data key="qname">', qualified_name, '</data><data key="kind">', kind, '</data><data key="cc">', decision_points + 1, '</data></node>') AS line FROM nodes UNION ALL
SELECT 2, concat('    <edge id="e', src, '-', dst, '-', kind, '" source="', src, '" target="', dst, '"><data key="ekind">', kind, '</data></edge>') FROM edges"""),
}


#: Queries that read names and places of the nodes several times.
KEPT = {"diag_counts", "summary", "findings", "finding_counts", "suggestions", "node_suggestions", "layout_by_crate", "lens_cycles", "lens_async_blocking", "lens_loops", "async_calls", "loop_calls", "hot_io", "blocking_levels", "relocate", "node_named", "node_at", "nearest_at"}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 20 lines at most, of others the first two lines with one around."""
    sources = _sources(spark, sf_dir)
    return text.snippets(sources.select("path", F.lit(1).alias("start"), F.lit(2).alias("stop")), sources, 1, 20)


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a cache in which every third has another text."""
    sources = _sources(spark, sf_dir)
    cached = sources.select("path", F.when(F.col("path").cast("long") % 3 == 0, "old").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"))
    return incremental.stats(sources, cached)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry points of the fixture graph."""
    return ops.entry_kinds(graph(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more

    found = {name: (lambda spark, sf_dir, f=f, keep=name in KEPT: f(graph(spark, sf_dir, keep))) for name, (f, _) in (GRAPH | more.GRAPH).items()}
    return found | {"crate_lines": _line_counts, "snippets": _snippets, "incremental_stats": _incremental} | {name: f for name, (f, _) in more.TABLES.items()}


def oracle_sql() -> dict[str, str]:
    from . import more

    found = {name: sql for name, (_, sql) in (GRAPH | more.GRAPH | more.TABLES).items() if sql}
    return found | {"crate_lines": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS lines FROM documents",
        "snippets": "WITH x AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS parts FROM documents), y AS (SELECT path, len(parts) AS n, unnest(range(1, len(parts) + 1))::INT AS number, unnest(parts) AS line FROM x) SELECT path, 1 AS start, number, line FROM y WHERE n <= 20 OR number BETWEEN 0 AND 3",
        "incremental_stats": "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 <> 0) AS reused, count(*) FILTER (doc_id % 3 = 0) AS reparsed FROM documents",
    }
