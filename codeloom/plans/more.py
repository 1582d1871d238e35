"""The registered queries of navigation, crates, groups, advice and findings, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import advice, crates, flows, layout, lenses, navigate
from codeloom.operators.graph import Graph
from codeloom.sources import scan

from . import fixture
from .catalog import BLOCKED, CC, DEGREES, FOUND, LOOPS, RUN_ROOTS, SEARCH, STEPS_IN, TIERS, _levels
from .fixture import CRATES, WITH

ENTRY = "CASE WHEN name = 'main' THEN 'main' WHEN fan_in > 0 THEN NULL WHEN is_test THEN 'test' WHEN is_exported THEN 'exported' WHEN is_pub THEN 'public' ELSE 'root' END"
KIND = "CASE e.kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in navigate.KIND_NAMES.items()) + " ELSE e.kind END"
HITS = f"""h AS (SELECT node_id, qualified_name, CASE WHEN lower(qualified_name) = '{SEARCH}' THEN 0 WHEN lower(name) = '{SEARCH}' THEN 1 WHEN lower(qualified_name) LIKE '%::{SEARCH}' THEN 2 ELSE 3 END AS rank, strlen(qualified_name) AS bytes FROM nodes WHERE kind <> 'external' AND contains(lower(qualified_name), '{SEARCH}')),
o AS (SELECT *, row_number() OVER (ORDER BY rank, bytes, qualified_name, node_id)::INT AS place FROM h)"""
SCOPE_KEY = "list_aggregate(list_transform(string_split({}, '::'), lambda x: concat('0', x, chr(9))), 'string_agg', '')"


def _tree(where: str) -> str:
    scope, module = SCOPE_KEY.format("scope"), SCOPE_KEY.format("module_path")
    return WITH + f""", d AS (SELECT * FROM nodes WHERE kind <> 'external'{where}),
s AS (SELECT scope, count(*) AS functions FROM (SELECT unnest(list_distinct([split_part(module_path, '::', 1), concat(split_part(module_path, '::', 1), '::', split_part(module_path, '::', 2)), module_path])) AS scope FROM d) GROUP BY scope)
SELECT {scope} AS sort_key, len(string_split(scope, '::')) - 1 AS depth, string_split(scope, '::')[-1] AS name, scope AS path, NULL AS node_id, functions FROM s
UNION ALL SELECT concat({module}, '1', file, chr(9), lpad(start_line::VARCHAR, 10, '0'), chr(9), name, chr(9), lpad(node_id::VARCHAR, 20, '0')), len(string_split(module_path, '::')), name, qualified_name, node_id, 1 FROM d"""


def _rules(rules: list[tuple]) -> str:
    return f"rules AS (SELECT * FROM (VALUES {', '.join(map(str, rules))}) t(rule, code, base, step, cap, targets))"


SEVERITY = "CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
WHERE_TEXT = f" AND (contains(lower(name), '{SEARCH}') OR contains(lower(qualified_name), '{SEARCH}'))"


def _named_places(g: Graph) -> DataFrame:
    return g.defs.select("file", (F.col("start_line") + 1).alias("line"), F.col("qualified_name").alias("word"))


def _before(g: Graph) -> DataFrame:
    """An older graph: some paths differ, and all lines."""
    name = F.when(F.col("node_id") % 3 == 0, F.concat(F.lit("old::"), "name")).otherwise(F.col("qualified_name"))
    return g.defs.select(F.col("node_id").alias("old_id"), name.alias("qualified_name"), "file", (F.col("start_line") + 7).alias("start_line"))


def _roles(g: Graph) -> DataFrame:
    at = F.array(*map(F.lit, ["tests/", "src/tests/", "examples/", "lib/", "a/__tests__/"]))
    path = F.concat(F.lit("crates/x/"), F.element_at(at, (F.col("node_id") % 5 + 1).cast("int")), "file")
    return g.defs.select("node_id", crates.path_role(path).alias("role"))


def _finding_rows(g: Graph) -> DataFrame:
    return advice.findings(g, fixture.file_lines(g), cycles=False).select("priority", "dimension", "kind", "symbol", "weight")


FINDINGS = f"""{DEGREES}, {BLOCKED}, f AS (
  SELECT 0 AS priority, 'perf' AS dimension, 'async_blocking' AS kind, arg_min(qualified_name, lpad((1000000 - calls)::VARCHAR, 8, '0') || lpad(node_id::VARCHAR, 12, '0')) AS symbol, count(*) * 100 + sum(calls) AS weight FROM ac JOIN nodes USING (node_id) GROUP BY split_part(qualified_name, '::', 1)
  UNION ALL SELECT 1, 'perf', 'n_plus_one', qualified_name, 50 + count(*) FROM lc JOIN nodes ON node_id = src WHERE code = 'n_plus_one' GROUP BY qualified_name
  UNION ALL SELECT 2, 'perf', 'clone_in_loop', qualified_name, 1 FROM lc JOIN nodes ON node_id = src WHERE code = 'clone_in_loop'
  UNION ALL SELECT * FROM (SELECT 1, 'perf', 'hot_io_path', qualified_name, callers FROM (SELECT dst AS node_id, count(DISTINCT src) AS callers FROM edges WHERE src <> dst GROUP BY 1) JOIN ll USING (node_id) JOIN nodes USING (node_id) WHERE callers >= 8 AND kind <> 'external' ORDER BY callers DESC, node_id LIMIT 5)
  UNION ALL SELECT 1, 'composability', 'god_type', module_path, count(*) FROM nodes WHERE kind = 'method' AND NOT is_test AND NOT is_example GROUP BY module_path HAVING count(*) >= 40 OR sum(lines_of_code) >= 1500
  UNION ALL SELECT 2, 'incrementality', 'big_file', NULL, max(end_line) FROM nodes WHERE kind <> 'external' GROUP BY file HAVING max(end_line) >= 2000
  UNION ALL SELECT 2, 'scalability', 'no_http_timeout', NULL, 3 FROM (SELECT 1 FROM nodes WHERE kind = 'external' AND qualified_name LIKE '%reqwest::Client::new' LIMIT 1)
  UNION ALL SELECT 2, 'scalability', 'server_limits', NULL, 2 FROM (SELECT 1 FROM nodes WHERE kind = 'external' AND qualified_name LIKE '%TcpListener::bind' LIMIT 1)
  UNION ALL SELECT 2, 'scalability', 'unbounded_channel', NULL, 1 FROM (SELECT 1 FROM nodes WHERE kind = 'external' AND qualified_name LIKE '%::unbounded_channel' LIMIT 1)) """

GRAPH: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {
    "lookup": (lambda g: navigate.lookup(g, SEARCH), f"{WITH}, {HITS}, b AS (SELECT min(rank) AS best, count(*) FILTER (rank = (SELECT min(rank) FROM h)) AS tied FROM h) SELECT CASE WHEN best = 0 OR tied = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, place, node_id, qualified_name FROM o, b WHERE place <= 8 AND (place = 1 OR NOT (best = 0 OR tied = 1))"),
    "search": (lambda g: navigate.search(g, SEARCH), f"{WITH}, {HITS} SELECT node_id, qualified_name, false AS fuzzy FROM o WHERE place <= 20"),
    "text_filter": (lambda g: navigate.text_filter(g, SEARCH.upper()), WITH + f"SELECT node_id, qualified_name FROM nodes WHERE true{WHERE_TEXT}"),
    "file_symbols": (navigate.all_file_symbols, DEGREES + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY start_line, node_id)::INT AS place, node_id, name, start_line, fan_in, fan_out FROM defs"),
    "node_cards": (navigate.node_cards, DEGREES + f"SELECT node_id, name, qualified_name, module_path, kind, concat(file, ':', start_line) AS at, end_line, concat_ws(',', CASE WHEN is_pub THEN 'pub' END, CASE WHEN is_async THEN 'async' END, CASE WHEN is_unsafe THEN 'unsafe' END, CASE WHEN is_test THEN 'test' END, CASE WHEN is_exported THEN 'export' END) AS tags, {CC} AS cyclomatic, parameters, lines_of_code, max_nesting, decision_points, allocations, unsafe_blocks, awaits, {ENTRY} AS entry, fan_in, fan_out FROM defs"),
    "card_calls": (lambda g: navigate.card_calls(g, 5), WITH + f", x AS (SELECT 'in' AS side, src AS other, {KIND} AS kind, count, line FROM edges e WHERE dst = 5 UNION ALL SELECT 'out', dst, {KIND}, count, line FROM edges e WHERE src = 5) SELECT side, row_number() OVER (PARTITION BY side ORDER BY n.kind = 'external', qualified_name, x.kind)::INT AS place, other, qualified_name, x.kind, count, line, n.kind = 'external' AS external FROM x JOIN nodes n ON node_id = other"),
    "outline_tree": (navigate.outline_tree, _tree("")),
    "outline_prune": (lambda g: navigate.outline_tree(g, SEARCH), _tree(WHERE_TEXT)),
    "rank_entries": (lambda g: navigate.rank_entries(g, flows.reach_counts(g, g.nodes.where("name = 'main'")), 5), DEGREES + f", r(root, node_id) AS (SELECT node_id, node_id FROM nodes WHERE name = 'main' UNION SELECT root, dst FROM r JOIN edges ON src = r.node_id), c AS (SELECT root AS node_id, count(CASE WHEN nodes.kind <> 'external' AND root <> r.node_id THEN 1 END) AS reach FROM r JOIN nodes ON nodes.node_id = r.node_id GROUP BY 1), x AS (SELECT {ENTRY} AS entry, node_id, reach, qualified_name FROM defs LEFT JOIN c USING (node_id)) SELECT entry, place, node_id, reach FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY reach DESC NULLS LAST, qualified_name)::INT AS place FROM x WHERE entry IS NOT NULL) WHERE place <= 5"),
    "tier_counts": (lambda g: navigate.tier_counts(flows.entry_tiers(g)), DEGREES + RUN_ROOTS + TIERS + "SELECT tier, count(*) AS flows FROM tiers GROUP BY 1"),
    "node_named": (lambda g: navigate.node_named(g, _named_places(g)), WITH + ", p AS (SELECT file, start_line + 1 AS line, qualified_name AS word, string_split(qualified_name, '::')[-1] AS last FROM nodes WHERE kind <> 'external'), x AS (SELECT p.*, n.node_id, len(list_intersect(list_distinct(string_split(word, '::')), string_split(n.qualified_name, '::'))) AS shared, n.file = p.file AS same, abs(n.start_line - line) AS gap FROM p JOIN nodes n ON n.name = last AND n.kind <> 'external') SELECT file, line, word, node_id FROM (SELECT *, row_number() OVER (PARTITION BY file, line, word ORDER BY shared DESC, same DESC, gap, node_id) AS r FROM x) WHERE r = 1"),
    "relocate": (lambda g: navigate.relocate(g, _before(g)), WITH + ", d AS (SELECT * FROM nodes WHERE kind <> 'external'), b AS (SELECT node_id AS old_id, CASE WHEN node_id % 3 = 0 THEN concat('old::', name) ELSE qualified_name END AS q, file, start_line + 7 AS old_line FROM d), x AS (SELECT old_id, node_id, 0 AS way, 0 AS gap FROM b JOIN d ON q = qualified_name UNION ALL SELECT old_id, node_id, 1, abs(start_line - old_line) FROM b JOIN d ON d.file = b.file AND d.name = string_split(q, '::')[-1]) SELECT old_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY way, gap, node_id) AS r FROM x) WHERE r = 1"),
    "top_lists": (navigate.top_lists, DEGREES + f"SELECT 'cyclomatic' AS list, place, node_id, value FROM (SELECT node_id, {CC} AS value, row_number() OVER (ORDER BY {CC} DESC, node_id)::INT AS place FROM defs) WHERE place <= 10 UNION ALL SELECT 'fan_in', place, node_id, fan_in FROM (SELECT node_id, fan_in, row_number() OVER (ORDER BY fan_in DESC, node_id)::INT AS place FROM defs WHERE fan_in > 0) WHERE place <= 10"),
    "graph_info": (navigate.graph_info, WITH + "SELECT (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'external') AS externals, (SELECT count(*) FROM edges) AS edges, (SELECT sum(count)::BIGINT FROM edges) AS calls"),
    "path_role": (_roles, WITH + "SELECT node_id, ['test', 'normal', 'example', 'normal', 'test'][node_id % 5 + 1] AS role FROM nodes WHERE kind <> 'external'"),
    "group_of": (crates.group_of, WITH + "SELECT node_id, CASE WHEN kind = 'external' THEN '<external>' ELSE split_part(module_path, '::', 1) END AS grp FROM nodes"),
    "group_layers": (crates.group_layers, None),
    "file_function_counts": (advice.file_function_counts, WITH + "SELECT file, count(*) AS functions FROM nodes WHERE kind <> 'external' GROUP BY 1"),
    "god_types": (lambda g: advice.god_types(g, 3, 150), WITH + ", o AS (SELECT * FROM nodes WHERE kind = 'method' AND NOT is_test AND NOT is_example), b AS (SELECT module_path, count(*) AS methods, sum(lines_of_code)::BIGINT AS lines, any_value(file) AS file, arg_min(node_id, start_line) AS anchor FROM o GROUP BY 1 HAVING count(*) >= 3 OR sum(lines_of_code) >= 150), c AS (SELECT t.module_path, count(DISTINCT src) AS n FROM edges JOIN o t ON t.node_id = dst LEFT JOIN o s ON s.node_id = src AND s.module_path = t.module_path WHERE s.node_id IS NULL GROUP BY 1) SELECT b.module_path, methods, lines, file, coalesce(n, 0) AS outside_callers, anchor FROM b LEFT JOIN c USING (module_path)"),
    "node_suggestions": (lambda g: advice.node_suggestions(lenses.diagnostics(g, cycles=False)).drop("targets"), FOUND + f", {_rules(advice.RULES)}, r AS (SELECT rule, found.code, node_id, base, step, cap, row_number() OVER (PARTITION BY rule ORDER BY found.code, {SEVERITY} DESC, node_id, value) AS r, count(*) OVER (PARTITION BY rule) AS n FROM found JOIN rules USING (code)) SELECT rule, code, node_id, 0 AS more, least(base + step * n, cap)::INT AS priority FROM r WHERE r <= 8 UNION ALL SELECT rule, (SELECT min(code) FROM rules q WHERE q.rule = r.rule), NULL, any_value(n) - 8, any_value(least(base + step * n, cap) - 5)::INT FROM r WHERE n > 8 GROUP BY rule"),
    "suggestions": (lambda g: advice.suggestions(lenses.diagnostics(g, cycles=False), None, "backend", {"latency": 1.3, "robustness": 0.5}), None),
    "extended_counts": (lambda g: advice.extended_suggestions(lenses.extended(g), "backend").select("rule", "priority"), None),
    "findings": (_finding_rows, FINDINGS + "SELECT * FROM f"),
    "scene": (layout.scene, DEGREES + f"SELECT node_id, 4.0 + 2.0 * sqrt(fan_in) AS radius, least(1.0, {CC} / 20.0)::DOUBLE AS heat FROM defs"),
    "layout_by_crate": (lambda g: layout.layout_by_crate(g, crates.group_of(g), crates.group_layers(g), 20), None),
    "finding_counts": (lambda g: advice.finding_counts(_finding_rows(g)), FINDINGS + "SELECT priority, count(*) AS findings FROM f GROUP BY 1"),
}

DEPS = f"{CRATES.strip()}, dep AS (SELECT idx, unnest(list_distinct([idx // 2, idx // 3])) AS dep FROM cr WHERE idx > 0), dev AS (SELECT idx, idx - 4 AS dep FROM cr WHERE idx % 6 = 5), clo(idx, dep) AS (SELECT idx, idx FROM cr UNION SELECT clo.idx, dep.dep FROM clo JOIN dep ON dep.idx = clo.dep)"
HEIGHTS = "hw(idx, cur, d) AS (SELECT idx, idx, 0 FROM cr UNION SELECT hw.idx, dep.dep, d + 1 FROM hw JOIN dep ON dep.idx = cur), hs AS (SELECT idx, max(d) AS depth FROM hw GROUP BY 1)"
USAGE = "sh AS (SELECT DISTINCT clo.dep AS idx FROM clo JOIN cr USING (idx) WHERE default_member AND is_root), dv AS (SELECT DISTINCT clo.dep AS idx FROM clo WHERE clo.idx IN (SELECT idx FROM cr WHERE has_tests) OR clo.idx IN (SELECT dep FROM dev)), us AS (SELECT idx, CASE WHEN idx IN (SELECT idx FROM sh) THEN 'shipped' WHEN idx IN (SELECT idx FROM dv) THEN 'dev_only' ELSE 'unused' END AS usage FROM cr)"


def _file_crate(g: Graph, found: DataFrame) -> DataFrame:
    return crates.crate_of(g.defs.select("file"), found)


def _crate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, found = fixture.graph(spark, sf_dir), fixture.crates(spark, sf_dir)
    return crates.crate_view(g, found, _file_crate(g, found), fixture.file_lines(g))


def _crate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixture.crates(spark, sf_dir)
    return advice.crate_findings(_crate_view(spark, sf_dir), crates.rebuild_sets(found)).select("priority", "kind", "symbol", "weight")


VIEW = f"""{WITH}, {DEPS}, {HEIGHTS}, {USAGE},
fl AS (SELECT idx, file, max(end_line)::BIGINT AS lines FROM nodes JOIN cr ON cr.name = split_part(file, '/', 1) WHERE kind <> 'external' GROUP BY 1, 2),
fs AS (SELECT idx, count(*) AS files, sum(lines)::BIGINT AS lines FROM fl GROUP BY 1),
ow AS (SELECT node_id, idx, is_test OR is_example AS tested FROM nodes JOIN cr ON cr.name = split_part(file, '/', 1) WHERE kind <> 'external'),
fn AS (SELECT idx, count(*) AS functions, count(*) FILTER (tested) AS test_functions FROM ow GROUP BY 1),
ac AS (SELECT a.idx AS a, b.idx AS b FROM edges JOIN ow a ON a.node_id = src JOIN ow b ON b.node_id = dst WHERE a.idx <> b.idx),
cv AS (SELECT idx, name, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines, coalesce(functions, 0) AS functions, coalesce(test_functions, 0) AS test_functions, (SELECT count(*) FROM dep WHERE dep.dep = cr.idx) AS dependents, (SELECT count(*) FROM clo WHERE clo.dep = cr.idx AND clo.idx <> cr.idx) AS rebuild,
  (SELECT count(*) FROM ac WHERE a = cr.idx) AS calls_out, (SELECT count(*) FROM ac WHERE b = cr.idx) AS calls_in, depth, usage FROM cr LEFT JOIN fs USING (idx) LEFT JOIN fn USING (idx) JOIN hs USING (idx) JOIN us USING (idx))
"""

#: A file for each part in each language: its function calls that of the part whose key is the size.
SOURCES = {
    "rust": ("part/src/p{k}.rs", "// a call: f0();\npub fn f{k}() {{ if true {{ f{s}(); }} }}\n", "part::p"),
    "python": ("part/p{k}.py", "# f0()\ndef f{k}():\n    if True:\n        f{s}()\n", "part::p"),
    "go": ("part/p{k}.go", "package part\n// f0()\nfunc f{k}() {{ if true {{ f{s}() }} }}\n", None),
    "typescript": ("part/p{k}.ts", "// f0()\nexport function f{k}() {{ if (true) {{ f{s}(); }} }}\n", "part::p"),
    "cpp": ("part/p{k}.cpp", "// f0()\nint f{k}() {{ if (true) {{ return f{s}(); }} }}\n", "part::p"),
}


def _extracted(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fill = lambda text: F.regexp_replace(F.regexp_replace(F.lit(text.replace("{{", "<<").replace("}}", ">>")), r"\{k\}", F.col("p_partkey").cast("string")), r"\{s\}", F.col("p_size").cast("string"))
        path, text, _ = SOURCES[language]
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(tasks)  # a small table, but a file for each row
        rows = parts.select(fill(path).alias("path"), F.regexp_replace(F.regexp_replace(fill(text), "<<", "{"), ">>", "}").alias("text"))
        g = scan.ADAPTERS[language](rows)
        names = lambda end: g.nodes.select(F.col("node_id").alias(end), F.col("qualified_name").alias(f"{end}_name"))
        stats = g.defs.select(F.col("node_id").alias("src"), "decision_points", "max_nesting")
        return g.edges.join(names("src"), "src").join(names("dst"), "dst").join(stats, "src").select(F.col("src_name").alias("caller"), F.col("dst_name").alias("callee"), "kind", "count", "line", "decision_points", "max_nesting")

    return run


def _extracted_sql(language: str) -> str:
    scope = SOURCES[language][2]
    name = (lambda key: f"concat('part::f', {key})") if scope is None else (lambda key: f"concat('{scope}', {key}, '::f', {key})")
    line = {"rust": 2, "python": 4, "go": 3, "typescript": 2, "cpp": 2}[language]
    return f"SELECT {name('p.p_partkey')} AS caller, CASE WHEN q.p_partkey IS NULL THEN concat('f', p.p_size) ELSE {name('q.p_partkey')} END AS callee, CASE WHEN q.p_partkey IS NULL THEN 'unresolved' ELSE 'direct_call' END AS kind, 1 AS count, {line} AS line, 1 AS decision_points, 1 AS max_nesting FROM part p LEFT JOIN part q ON q.p_partkey = p.p_size"


TABLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "call_sites": (lambda spark, sf: navigate.call_sites(fixture.calls(spark, sf)), WITH + "SELECT src, dst, kind, coalesce(string_agg(concat(line, ':', col), ',' ORDER BY line, col) FILTER (line > 0), '') AS sites FROM (SELECT DISTINCT src, dst, kind, line, col FROM calls) GROUP BY 1, 2, 3"),
    "crate_of": (lambda spark, sf: _file_crate(fixture.graph(spark, sf), fixture.crates(spark, sf)), f"{WITH}, {DEPS} SELECT DISTINCT file, idx FROM nodes JOIN cr ON cr.name = split_part(file, '/', 1)"),
    "crate_closure": (lambda spark, sf: crates.closure(fixture.crates(spark, sf)), f"WITH RECURSIVE {DEPS} SELECT * FROM clo"),
    "crate_visibility": (lambda spark, sf: crates.visibility(fixture.crates(spark, sf)), f"WITH RECURSIVE {DEPS} SELECT v.idx, v.dep AS other, EXISTS (SELECT 1 FROM clo c WHERE c.idx = v.idx AND c.dep = v.dep) AS normal, true AS dev FROM (SELECT * FROM clo UNION SELECT dev.idx, clo.dep FROM dev JOIN clo ON clo.idx = dev.dep) v"),
    "rebuild_set": (lambda spark, sf: crates.rebuild_sets(fixture.crates(spark, sf)), f"WITH RECURSIVE {DEPS} SELECT dep AS idx, idx AS other FROM clo WHERE dep <> idx"),
    "crate_heights": (lambda spark, sf: crates.heights(fixture.crates(spark, sf)), f"WITH RECURSIVE {DEPS}, {HEIGHTS} SELECT * FROM hs"),
    "critical_path": (lambda spark, sf: crates.critical_path(fixture.crates(spark, sf)), None),
    "crate_usage": (lambda spark, sf: crates.usage(fixture.crates(spark, sf)), f"WITH RECURSIVE {DEPS}, {USAGE} SELECT * FROM us"),
    "crate_view": (_crate_view, VIEW + "SELECT * FROM cv"),
    "crate_findings": (_crate_findings, VIEW + "SELECT CASE WHEN lines >= 4000 THEN 1 ELSE 2 END AS priority, 'crate_blast_radius' AS kind, name AS symbol, lines * (rebuild + 1) AS weight FROM cv WHERE rebuild >= 2 AND lines >= 2000 UNION ALL SELECT 2, 'crate_not_shipped', name, lines FROM cv WHERE usage <> 'shipped'"),
    **{f"extract_{name}": (_extracted(name), _extracted_sql(name)) for name in SOURCES},
}
