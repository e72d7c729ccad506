"""Graph and refactoring queries over all repositories."""

from __future__ import annotations

from codelode.operators import edges as E
from codelode.operators import refactoring as R
from codelode.operators import tracing as T
from codelode.plans.views import sql
from codelode.sources.tables import Index

QUERIES, ORACLE = {}, {}
PREFIX, SEED = "src/", "services/"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, root: f(Index(spark, root))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


_NAMED = "r JOIN f sf ON sf.id = r.source_file_id JOIN s ON s.name_lc = r.name_lc JOIN f tf ON tf.id = s.file_id AND tf.repo = sf.repo"
_GRAPH = f""",
g AS (SELECT repo, source, target, kind, count(*) AS weight FROM (
  SELECT sf.repo, sf.path AS source, coalesce(tf.path, d.external_module) AS target, d.kind FROM d JOIN f sf ON sf.id = d.source_file_id LEFT JOIN f tf ON tf.id = d.target_file_id
  WHERE (tf.id IS NULL OR tf.repo = sf.repo) AND coalesce(tf.path, d.external_module) IS NOT NULL
  UNION ALL SELECT sf.repo, sf.path, tf.path, r.reference_kind FROM {_NAMED}) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, source, target, kind) AS place FROM g) WHERE place <= 300),
node AS (SELECT repo, node, sum(weight)::BIGINT AS degree FROM (SELECT repo, source AS node, weight FROM top UNION ALL SELECT repo, target, weight FROM top) GROUP BY ALL)
"""
query("q_repo_graph_edges", sql(_GRAPH + "SELECT * FROM top"))(E.repository_graph)
query("q_repo_graph_nodes", sql(_GRAPH + "SELECT * FROM node"))(lambda ix: E.graph_nodes(E.repository_graph(ix)))
query("q_ui_subgraph", sql(_GRAPH + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, node) AS n FROM node) WHERE n <= 80)
SELECT repo, source, target, kind, weight FROM (SELECT top.*, row_number() OVER (PARTITION BY top.repo ORDER BY place) AS k FROM top
  WHERE (repo, source) IN (SELECT (repo, node) FROM best) AND (repo, target) IN (SELECT (repo, node) FROM best)) WHERE k <= 180"""))(lambda ix: E.induced_subgraph(E.repository_graph(ix)))

_UNIFIED = f""",
late AS (SELECT * FROM (SELECT f.repo, s.name_lc, s.file_id, s.name, row_number() OVER (PARTITION BY f.repo, s.name_lc ORDER BY CASE WHEN is_primary_declaration THEN 0 ELSE 1 END, CASE WHEN declared_in_extension THEN 1 ELSE 0 END, CASE WHEN is_exported THEN 0 ELSE 1 END, coalesce(start_line, 2147483647), s.id) AS n
  FROM s JOIN f ON s.file_id = f.id) WHERE n = 1),
e AS (
  SELECT sf.repo, d.source_file_id AS source_id, coalesce(df.id, tsf.id, late.file_id) AS target_id, d.kind, ss.name AS source_symbol, coalesce(ts.name, late.name) AS target_symbol, d.external_module
  FROM d JOIN f sf ON sf.id = d.source_file_id LEFT JOIN f df ON df.id = d.target_file_id AND df.repo = sf.repo LEFT JOIN s ss ON ss.id = d.source_symbol_id LEFT JOIN s ts ON ts.id = d.target_symbol_id
  LEFT JOIN f tsf ON tsf.id = ts.file_id AND tsf.repo = sf.repo LEFT JOIN late ON d.target_symbol_id IS NULL AND late.name_lc = lower(d.external_module) AND late.repo = sf.repo
  UNION ALL SELECT sf.repo, r.source_file_id, tf.id, r.reference_kind, r.source_symbol_name, s.name, NULL FROM {_NAMED})
"""
query("q_edges_unified", sql(_UNIFIED + "SELECT *, count(*) AS edges FROM e GROUP BY ALL"))(E.unified_edges)

_ORDER = "CASE dep_kind WHEN 'service_usage' THEN 0 WHEN 'injection' THEN 1 WHEN 'member_call' THEN 2 WHEN 'call' THEN 3 WHEN 'type_reference' THEN 4 WHEN 'import' THEN 9 ELSE 5 END"
_TRACE = _UNIFIED + f""",
u AS (SELECT DISTINCT e.*, sf.path AS source_path, tf.path AS target_path FROM e JOIN f sf ON sf.id = e.source_id LEFT JOIN f tf ON tf.id = e.target_id),
seed AS (SELECT repo, id FROM f WHERE path LIKE '%{SEED}%'),
names AS (SELECT DISTINCT seed.repo, s.name FROM s JOIN seed ON seed.id = s.file_id),
tree AS (
  SELECT u.*, 1 AS depth FROM u WHERE source_id IN (SELECT id FROM seed) OR target_id IN (SELECT id FROM seed) OR (target_id IS NOT NULL AND (u.repo, target_symbol) IN (SELECT (repo, name) FROM names))
  UNION SELECT u.*, tree.depth + 1 FROM tree JOIN u ON u.source_id = tree.target_id AND u.repo = tree.repo WHERE tree.depth < 3),
rows_ AS (SELECT DISTINCT repo, source_path, coalesce(target_path, external_module) AS target_path_out, kind AS dep_kind, source_symbol, target_symbol, external_module, depth FROM tree),
kept AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY depth, {_ORDER}, source_path NULLS FIRST, target_path_out NULLS FIRST, dep_kind NULLS FIRST, source_symbol NULLS FIRST, target_symbol NULLS FIRST, external_module NULLS FIRST) AS n FROM rows_) WHERE n <= 200)
"""
query("q_trace_dependencies", sql(_TRACE + "SELECT * FROM kept", True))(lambda ix: T.trace_dependencies(ix, SEED))
query("q_trace_summary", sql(_TRACE + f"""
SELECT repo, CASE WHEN contains(source_path, '{SEED}') THEN 'outbound' ELSE 'inbound' END AS direction,
  CASE WHEN contains(source_path, '{SEED}') THEN coalesce(target_path_out, external_module, 'unknown') ELSE source_path END AS file, dep_kind AS kind, count(*) AS edges, min(depth) AS min_depth FROM kept GROUP BY ALL""", True))(
    lambda ix: T.trace_summary(T.trace_dependencies(ix, SEED), SEED))
query("q_trace_fn", sql(f""",
u AS (SELECT DISTINCT sf.path AS source_path, coalesce(tf.path, d.external_module) AS target_path_out, tf.path AS target_path, d.kind AS dep_kind, ss.name AS source_symbol, ts.name AS target_symbol, d.external_module
  FROM d JOIN f sf ON sf.id = d.source_file_id LEFT JOIN f tf ON tf.id = d.target_file_id LEFT JOIN s ss ON ss.id = d.source_symbol_id LEFT JOIN s ts ON ts.id = d.target_symbol_id),
tree AS (SELECT u.*, 1 AS depth FROM u WHERE source_path LIKE '%{SEED}%' OR target_path LIKE '%{SEED}%'
  UNION SELECT u.*, tree.depth + 1 FROM tree JOIN u ON u.source_path = tree.target_path_out WHERE tree.depth < 3)
SELECT DISTINCT source_path, target_path_out, dep_kind, source_symbol, target_symbol, external_module, depth FROM tree""", True))(lambda ix: T.trace_stored(ix, SEED))

_CYCLE = f""",
ce AS (SELECT DISTINCT * FROM (
  SELECT sf.repo, sf.path AS source, tf.path AS target FROM d JOIN f sf ON sf.id = d.source_file_id JOIN f tf ON tf.id = d.target_file_id AND tf.repo = sf.repo
  UNION ALL SELECT sf.repo, sf.path, tf.path FROM {_NAMED}) WHERE source <> target)
"""
query("q_cycle_edges", sql(_CYCLE + "SELECT * FROM ce"))(T.cycle_edges)
_CYCLES = _CYCLE + """,
walk AS (SELECT repo, [source, target] AS path FROM ce WHERE target > source
  UNION ALL SELECT walk.repo, list_append(walk.path, ce.target) FROM walk JOIN ce ON ce.repo = walk.repo AND ce.source = walk.path[-1] WHERE len(walk.path) < 6 AND ce.target > walk.path[1] AND NOT list_contains(walk.path, ce.target)),
cyc AS (SELECT walk.repo, min(walk.path) AS path FROM walk JOIN ce ON ce.repo = walk.repo AND ce.source = walk.path[-1] AND ce.target = walk.path[1] GROUP BY walk.repo, list_sort(walk.path))
"""
query("q_find_cycles", sql(_CYCLES + "SELECT repo, len(path) AS length, array_to_string(path, ' > ') AS cycle FROM cyc", True))(lambda ix: T.find_cycles(T.cycle_edges(ix), paths=False))
query("q_cycle_rank", sql(_CYCLES + "SELECT repo, node, count(*) AS cycles FROM (SELECT repo, unnest(path) AS node FROM cyc) GROUP BY ALL", True))(lambda ix: T.rank_cycle_files(T.cycle_edges(ix)))

_IN, _OUT = f"LIKE '{PREFIX}%'", f"NOT LIKE '{PREFIX}%'"
_LEGS = {
    "outbound": f"SELECT sf.repo, 'outbound' AS direction, sf.path AS internal_path, coalesce(tf.path, d.external_module, '(external)') AS external_path, d.kind, count(*) AS edge_count FROM d JOIN f sf ON sf.id = d.source_file_id LEFT JOIN f tf ON tf.id = d.target_file_id AND tf.repo = sf.repo WHERE sf.path {_IN} AND (tf.id IS NULL OR tf.path {_OUT}) GROUP BY ALL",
    "inbound": f"SELECT tf.repo, 'inbound' AS direction, tf.path AS internal_path, sf.path AS external_path, d.kind, count(*) AS edge_count FROM d JOIN f tf ON tf.id = d.target_file_id JOIN f sf ON sf.id = d.source_file_id AND sf.repo = tf.repo WHERE tf.path {_IN} AND sf.path {_OUT} GROUP BY ALL",
    "ref_out": f"SELECT sf.repo, 'ref_outbound' AS direction, sf.path AS internal_path, tf.path AS external_path, r.reference_kind AS kind, count(*) AS edge_count FROM {_NAMED} WHERE sf.path {_IN} AND tf.path {_OUT} GROUP BY ALL",
    "ref_in": f"SELECT sf.repo, 'ref_inbound' AS direction, tf.path AS internal_path, sf.path AS external_path, r.reference_kind AS kind, count(*) AS edge_count FROM {_NAMED} WHERE tf.path {_IN} AND sf.path {_OUT} GROUP BY ALL",
}
for _leg, _f in (("outbound", R.coupling_outbound), ("inbound", R.coupling_inbound), ("ref_out", R.coupling_ref_out), ("ref_in", R.coupling_ref_in)):
    query(f"q_coupling_{_leg}", sql(" " + _LEGS[_leg]))(lambda ix, g=_f: g(ix, PREFIX))
_ALL = " UNION ALL ".join(f"({x})" for x in _LEGS.values())
query("q_analyze_coupling", sql(" " + _ALL))(lambda ix: R.analyze_coupling(ix, PREFIX))
query("q_coupling_metrics", sql(f""",
x AS ({_ALL}), n AS (SELECT repo, count(*) AS internal_files FROM f WHERE path {_IN} GROUP BY repo),
m AS (SELECT repo, count(DISTINCT external_path) FILTER (direction IN ('outbound', 'ref_outbound')) AS ce, count(DISTINCT external_path) FILTER (direction NOT IN ('outbound', 'ref_outbound')) AS ca, sum(edge_count)::BIGINT AS edges,
  coalesce(sum(edge_count) FILTER (direction IN ('outbound', 'ref_outbound')), 0)::BIGINT AS edges_out FROM x GROUP BY repo),
k AS (SELECT m.*, internal_files, round(coalesce(ce::DOUBLE / nullif(ca + ce, 0), 0), 6) AS instability, round(edges::DOUBLE / internal_files, 6) AS edges_per_file FROM m JOIN n USING (repo))
SELECT *, CASE WHEN instability > 0.7 THEN 'volatile' WHEN instability < 0.3 THEN 'stable' ELSE 'moderate' END AS label FROM k"""))(lambda ix: R.coupling_metrics(ix, PREFIX))

_OWN = f"own AS (SELECT f.repo, s.id AS symbol_id, s.name, s.name_lc, s.qualified_name, s.kind, s.signature, s.visibility, s.start_line, s.end_line, s.container_symbol, s.is_exported, f.path AS file_path FROM s JOIN f ON s.file_id = f.id WHERE f.path {_IN})"
_XREF = f"xref AS (SELECT f.repo, r.name_lc, f.path AS consumer, r.reference_kind AS kind FROM r JOIN f ON r.source_file_id = f.id WHERE f.path {_OUT})"
_XDEP = f"xdep AS (SELECT sf.repo, own.name_lc, sf.path AS consumer, d.kind FROM d JOIN own ON own.symbol_id = d.target_symbol_id JOIN f sf ON sf.id = d.source_file_id WHERE sf.path {_OUT})"
_USED = "SELECT repo, name_lc, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS consumer_files, count(*) AS total_refs, string_agg(DISTINCT kind, ',' ORDER BY kind) AS ref_kinds FROM {t} GROUP BY ALL"
_PICK = "own.repo, symbol_id, name, qualified_name, kind, signature, visibility, start_line, end_line, container_symbol, file_path, consumer_files, total_refs, ref_kinds"
for _name, _join, _unused in (("q_module_interface", "JOIN", False), ("q_module_interface_all", "LEFT JOIN", True)):
    # dependencies of other repositories count for the repository they come from, as the consumer's scope does
    query(_name, sql(f""", {_OWN}, {_XREF}, {_XDEP}, pub AS (SELECT * FROM own WHERE is_exported OR visibility = 'public'),
used AS ({_USED.format(t="(SELECT * FROM xref WHERE (repo, name_lc) IN (SELECT (repo, name_lc) FROM pub) UNION ALL SELECT * FROM xdep)")})
SELECT {_PICK.replace("own.repo", "pub.repo")} FROM pub {_join} used ON used.repo = pub.repo AND used.name_lc = pub.name_lc"""))(lambda ix, u=_unused: R.module_interface(ix, PREFIX, u))
_IFACE = f", {_OWN}, {_XREF}, used AS ({_USED.format(t='xref')}), iface AS (SELECT {_PICK} FROM own JOIN used ON used.repo = own.repo AND used.name_lc = own.name_lc)"
query("q_seam_interfaces", sql(_IFACE + " SELECT * FROM iface"))(lambda ix: R.seam_interfaces(ix, PREFIX))


def _seam(direction: str) -> str:
    inner, outer = ("sf", "tf") if direction == "outbound" else ("tf", "sf")
    return f"SELECT sf.repo, '{direction}' AS direction, {inner}.path AS internal_file, {outer}.path AS external_file, r.target_name AS symbol_name, s.kind AS symbol_kind, s.signature, r.reference_kind, count(*) AS usage_count FROM {_NAMED} WHERE {inner}.path {_IN} AND {outer}.path {_OUT} GROUP BY ALL"


query("q_seam_deps", sql(" " + _seam("outbound")))(lambda ix: R.seam_dependencies(ix, PREFIX))
query("q_seam_edges", sql(f" ({_seam('inbound')}) UNION ALL ({_seam('outbound')})"))(lambda ix: R.seam_edges(ix, PREFIX))
query("q_seam_plan", sql(_IFACE + f""", sd AS ({_seam("outbound")}), se AS (({_seam("inbound")}) UNION ALL ({_seam("outbound")})),
p AS (SELECT n.repo, internal_files, coalesce(interfaces, 0) AS interfaces, coalesce(dependencies, 0) AS dependencies, coalesce(dependency_usage, 0) AS dependency_usage, coalesce(seams, 0) AS seams
  FROM (SELECT repo, count(*) AS internal_files FROM f WHERE path {_IN} GROUP BY repo) n
  LEFT JOIN (SELECT repo, count(*) AS interfaces FROM iface GROUP BY repo) a USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS dependencies, sum(most)::BIGINT AS dependency_usage FROM (SELECT repo, symbol_name, max(usage_count) AS most FROM sd GROUP BY ALL) GROUP BY repo) b USING (repo)
  LEFT JOIN (SELECT repo, sum(usage_count)::BIGINT AS seams FROM se GROUP BY repo) k USING (repo))
SELECT *, CASE WHEN interfaces > 10 OR dependencies > 10 OR seams > 50 THEN 'HIGH' WHEN interfaces > 5 OR dependencies > 5 OR seams > 20 THEN 'MODERATE' ELSE 'LOW' END AS difficulty FROM p"""))(lambda ix: R.seam_plan(ix, PREFIX))
