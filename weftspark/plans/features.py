"""Queries of netlist, layout and run features."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import netlist, reports, runs
from weftspark.plans.base import listed, literal, query, quoted, values
from weftspark.util import table

NETLISTS = [
    ("adder", "module adder (a, b, y);\n  /* NAND2X1 not_here (.A(a), .Y(b)); */\n  INVx1 u1 (.A(a), .Y(n1));\n  NAND2X1 u2 (.A(n1), .B(b), .Y(n2));\n  DFFRX1 u3 (.D(n2), .CK(clk_a), .Q(n3));\n  BUFx4 u4 (.A(n3), .Y(clk_b));\n  XNOR2X1 u5 (.A(clk_b), .B(n1), .Y(y));\n  AOI21 u6 (.A(n1), .B(n1), .ZN(n9));\nendmodule"),
    ("loop", "INVx1 a1 (.A(x2), .Y(x1));\nINVx1 a2 (.A(x1), .Y(x2));\nFAx1 a3 (.A(x2), .B(p), .CO(q));\nHA s0 (.A(z), .S(p));"),
    ("twice", "BUF d1 (.A(i), .Y(w));\nBUF d2 (.A(j), .Y(w));\nLATCH l1 (.D(w), .Q(o));"),
    ("none", "module empty (a);\nendmodule"), ("null", None),
]
AREAS = [("u1", 2.5), ("NAND2", 9.0), ("AND2", 3.5), ("BUF", 1.5), ("DFFR", 7.0)]
_KIND = "CASE " + " ".join(f"WHEN contains(upper(cell), '{t}') THEN '{t}'" for t in netlist.CELL_TYPES[:-1]) + " ELSE 'UNKNOWN' END"
_NETS = f"""t AS (SELECT id, regexp_replace(text, '/\\*.*?\\*/', '', 'gs') AS text FROM {values(NETLISTS, "id, text")} WHERE text IS NOT NULL),
i AS (SELECT id, k AS seq, regexp_extract_all(text, {quoted(reports._INSTANCE)}, 1)[k] AS cell, regexp_extract_all(text, {quoted(reports._INSTANCE)}, 2)[k] AS inst, regexp_extract_all(text, {quoted(reports._INSTANCE)}, 3)[k] AS ports FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, {quoted(reports._INSTANCE)}, 1)) + 1)) AS k FROM t)),
c AS (SELECT id, seq, cell, inst, regexp_extract_all(ports, {quoted(reports._PIN)}, 1)[k] AS pin, regexp_extract_all(ports, {quoted(reports._PIN)}, 2)[k] AS net FROM (SELECT *, unnest(range(1, len(regexp_extract_all(ports, {quoted(reports._PIN)}, 1)) + 1)) AS k FROM i WHERE lower(cell) NOT IN {listed(reports.KEYWORDS)})),
p AS (SELECT *, upper(pin) IN {listed(reports.OUTPUT_PINS)} AS is_output, contains(lower(net), 'clk') OR contains(lower(net), 'clock') AS is_clock FROM c WHERE net <> ''),
e AS (SELECT d.id, d.src, l.inst AS dst, d.net, l.is_clock, count(*) AS n FROM (SELECT id, net, arg_max(inst, seq) AS src FROM p WHERE is_output GROUP BY id, net) d JOIN p l ON l.id = d.id AND l.net = d.net AND NOT l.is_output GROUP BY ALL)"""


@query(f"WITH {_NETS} SELECT * FROM e")
def netlist_graph(s, d):
    return netlist.edges(netlist.connections(literal(s, NETLISTS, "id string, text string"), "id", "text"))


@query(f"""WITH RECURSIVE {_NETS}, q AS (SELECT DISTINCT id, src, dst FROM e), bad AS (SELECT 'loop' AS id, unnest(['a1', 'a2', 'a3']) AS inst),
r AS (SELECT id, inst, 0 AS depth FROM (SELECT DISTINCT id, inst FROM p) UNION SELECT q.id, q.dst, r.depth + 1 FROM r JOIN q ON q.id = r.id AND q.src = r.inst WHERE q.id <> 'loop'), dd AS (SELECT id, inst, max(depth) AS depth FROM r GROUP BY id, inst),
dp AS (SELECT id, inst, CASE WHEN id = 'loop' AND inst = 'a3' THEN 1 ELSE depth END AS depth FROM dd), m AS (SELECT id, greatest(max(depth), 1) AS most FROM dp GROUP BY id), k AS (SELECT DISTINCT id, inst, {_KIND} AS kind FROM p),
fi AS (SELECT id, dst AS inst, sum(n) AS n FROM e GROUP BY ALL), fo AS (SELECT id, src AS inst, sum(n) AS n FROM e GROUP BY ALL), a AS (SELECT * FROM {values(AREAS, "name, area")})
SELECT k.id, k.inst, k.kind, CAST(coalesce(fi.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(fo.n, 0) AS BIGINT) AS fan_out, CAST(list_position({list(netlist.CELL_TYPES)}, k.kind) AS INTEGER) AS hot_at, coalesce(a1.area, a2.area, 1.0) AS area, CAST(dp.depth AS DOUBLE) / m.most AS depth
FROM k JOIN dp USING (id, inst) JOIN m USING (id) LEFT JOIN fi USING (id, inst) LEFT JOIN fo USING (id, inst) LEFT JOIN a a1 ON a1.name = k.inst LEFT JOIN a a2 ON a2.name = k.kind""")
def netlist_features(s, d):
    f = netlist.features(literal(s, NETLISTS, "id string, text string"), "id", "text", literal(s, AREAS, "name string, area double"))
    return f.select("id", "inst", "kind", "fan_in", "fan_out", F.array_position("one_hot", F.lit(1.0)).cast("int").alias("hot_at"), "area", "depth")


@query("SELECT kind, count(*) AS n FROM (SELECT chunk_id, inst, " + _KIND + f" AS kind FROM (SELECT DISTINCT chunk_id, inst, cell FROM (SELECT chunk_id, unnest(regexp_extract_all(text, {quoted(reports._INSTANCE)}, 2)) AS inst, unnest(regexp_extract_all(text, {quoted(reports._INSTANCE)}, 1)) AS cell FROM chunks WHERE text IS NOT NULL) WHERE lower(cell) NOT IN {listed(reports.KEYWORDS)})) GROUP BY kind")
def cell_types(s, d):
    c = netlist.connections(table(s, d, "chunks"), "chunk_id", "text").select("id", "inst", "cell").distinct()
    return c.groupBy(netlist.cell_type(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


_COMPS = [(f"u{k}", (k * 7919) % 1200 - 100, (k * 104729) % 900) for k in range(400)]
DEFS = [
    ("top", "DESIGN top ;\nDIEAREA ( 0 0 ) ( 1000 800 ) ;\nCOMPONENTS 400 ;\n" + "\n".join(f"- {n} INVx1 + {'FIXED' if x % 3 else 'PLACED'} ( {x} {y} ) N ;" for n, x, y in _COMPS) + "\nEND COMPONENTS"),
    ("one", "DIEAREA ( -10 -10 ) ( 10 10 ) ;\n- a BUF + PLACED ( 0 0 ) N ;\n- b BUF + SOURCE NETLIST + PLACED ( 9 9 ) S ;"), ("flat", "DIEAREA ( 5 0 ) ( 5 9 ) ;\n- a BUF + PLACED ( 0 0 ) N ;"), ("bare", "DIEAREA ( 0 0 ) ( 9 9 ) ;"), ("none", "DESIGN x ;"),
]
_COMP = r"(?m)^\s*-\s+(\S+)\s+(\S+)\s[^;]*?\+\s+(?:PLACED|FIXED)\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)"
_DIE = r"DIEAREA\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)"
_GRID = f"""t AS (SELECT *, {', '.join(f"TRY_CAST(regexp_extract(text, {quoted(_DIE)}, {i}) AS DOUBLE) AS d{i}" for i in range(1, 5))} FROM {values(DEFS, "id, text")}), v AS (SELECT * FROM t WHERE d3 > d1 AND d4 > d2),
c AS (SELECT id, d1, d2, d3, d4, unnest(regexp_extract_all(text, {quoted(_COMP)}, 3))::DOUBLE AS x, unnest(regexp_extract_all(text, {quoted(_COMP)}, 4))::DOUBLE AS y FROM v),
g AS (SELECT id, CAST(least(greatest(floor((x - d1) / (d3 - d1) * 20), 0), 19) AS INTEGER) AS bx, CAST(least(greatest(floor((y - d2) / (d4 - d2) * 20), 0), 19) AS INTEGER) AS by, count(*) AS n FROM c GROUP BY ALL), dn AS (SELECT *, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY id) AS density FROM g)"""


@query(f"WITH {_GRID} SELECT * FROM dn")
def layout_density(s, d):
    return netlist.layout_density(literal(s, DEFS, "id string, text string"), "id", "text", 20)


@query(f"""WITH {_GRID}, a AS (SELECT id, CAST(sum(n) AS BIGINT) AS placed_cells, round(sum(density) / 400, 9) AS mean_density, round(sqrt(greatest(sum(density * density) / 400 - pow(sum(density) / 400, 2), 0)), 9) AS std_density, max(density) AS peak_density, quantile_cont(density, 0.9) AS p90, count(*) / 400 AS utilization_estimate FROM dn GROUP BY id),
h AS (SELECT dn.id, count(*) AS hot FROM dn JOIN a ON a.id = dn.id AND density >= p90 GROUP BY dn.id) SELECT t.id, placed_cells, CASE WHEN d3 > d1 AND d4 > d2 THEN (d3 - d1) * (d4 - d2) END AS die_area, mean_density, std_density, peak_density, hot AS hotspot_tile_count, utilization_estimate,
CASE WHEN NOT contains(text, 'DIEAREA') THEN 'no die area' WHEN NOT (d3 > d1 AND d4 > d2) THEN 'invalid die area' WHEN placed_cells IS NULL THEN 'no placed components' END AS error FROM t LEFT JOIN a USING (id) LEFT JOIN h USING (id)""")
def layout_stats(s, d):
    x = netlist.layout_stats(literal(s, DEFS, "id string, text string"), "id", "text", 20)
    return x.withColumn("mean_density", F.round("mean_density", 9)).withColumn("std_density", F.round("std_density", 9))


# --- reports of runs ---------------------------------------------------------------------------------------------------

REPORTS = [
    ("a", "clock core (rise) 2.5\nslack (VIOLATED) -0.5\nslack (MET) 0.25\nslack (VIOLATED)  -1.5\nslack (MET) 3"), ("b", "Period: 4.0\nslack -0.125\nslack 0.5"), ("c", "clock period = 2.0\nwns -0.1\ntns -0.5\nslack = -0.25\nslack = 0.5"),
    ("d", "nothing to see"), ("e", None), ("f", "Total 1.0e-03 2.0e-03 3.0e-06 3.003e-03 100%\nTotal power is 5.5 uW"), ("g", "Total power: 2.5 W\nDesign area 123.5 u^2"), ("h", "Chip area for module top: 77.25\ntotal power 9.5 mW"), ("i", "cell_area = 12.5\nwns 0\nslack (MET) 1.5\ntns 0"),
]


def _first(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(text, {quoted(p)}, 1), '') AS DOUBLE)" for p in patterns) + ") + 0.0"


def _list(*patterns: str) -> str:
    one = lambda p: f"list_sort(list_transform(regexp_extract_all(text, {quoted(p)}, 1), lambda x: CAST(x AS DOUBLE) + 0.0))"
    return "CASE " + " ".join(f"WHEN len({one(p)}) > 0 THEN {one(p)}" for p in patterns) + " ELSE [] END"


_STATS = f"""SELECT id, round(CASE WHEN len(s) > 0 THEN s[1] END, 6) AS wns, round(CASE WHEN len(s) > 0 THEN coalesce(list_sum(list_filter(s, lambda x: x < 0)), 0.0) END, 6) AS tns, coalesce(len(list_filter(s, lambda x: x < 0)), 0) AS violation_count, {', '.join(f"round(list_aggregate(s, 'quantile_cont', {n / 100}), 6) AS slack_p{n}" for n in (0, 10, 50, 90))}, p AS clock_period, CASE WHEN p > 0 THEN round(1000.0 / p, 6) END AS freq_mhz
FROM (SELECT id, {_list(runs.SLACK_OF_PATH, r"slack\s+([+-]?[0-9]+\.[0-9]+)")} AS s, {_first(r"(?:clock)\s+\w+\s+\((?:rise|fall)\)\s+([0-9]+\.?[0-9]*)", r"[Pp]eriod\s*[:=]\s*([0-9]+\.?[0-9]*)")} AS p FROM {{src}})"""


def _rounded(cols):
    return [(F.round(v, 6) if k not in ("violation_count", "clock_period") else v).alias(k) for k, v in cols.items()]


@query(_STATS.format(src=values(REPORTS, "id, text")))
def timing_stats(s, d):
    return literal(s, REPORTS, "id string, text string").select("id", *_rounded(runs.timing_stats(F.col("text"))))


@query(_STATS.format(src="(SELECT DISTINCT artifact_id AS id, report_text AS text FROM orfs_runs WHERE report_text IS NOT NULL)"))
def run_timing_stats(s, d):
    r = table(s, d, "orfs_runs").where("report_text is not null").select(F.col("artifact_id").alias("id"), F.col("report_text").alias("text")).distinct()
    return r.select("id", *_rounded(runs.timing_stats(F.col("text"))))


@query(f"""WITH x AS (SELECT id, {_list("(?i)slack" + chr(92) + "s+" + chr(92) + "((?:VIOLATED|MET)" + chr(92) + ")" + chr(92) + "s+([+-]?[0-9.]+)", "slack" + chr(92) + "s*=" + chr(92) + "s*([+-]?[0-9.]+)")} AS s, {_first("(?i)clock period" + chr(92) + "s*[=:]" + chr(92) + "s*([0-9.]+)", "(?i)Period" + chr(92) + "s*:" + chr(92) + "s*([0-9.]+)")} AS p, {_first("(?i)wns" + chr(92) + "s+([+-]?[0-9.]+)")} AS w, {_first("(?i)tns" + chr(92) + "s+([+-]?[0-9.]+)")} AS t FROM {values(REPORTS, "id, text")}),
y AS (SELECT *, coalesce(CASE WHEN w <> 0 THEN w END, s[1], 0.0) AS wns, coalesce(CASE WHEN t <> 0 THEN t END, list_sum(list_filter(s, lambda v: v < 0)), 0.0) AS tns FROM x)
SELECT id, wns, tns, coalesce(len(list_filter(s, lambda v: v < 0)), 0) AS violation_count, coalesce(round(list_aggregate(s, 'quantile_cont', 0.5), 6), 0.0) AS slack_p50, p AS clock_period, CASE WHEN p IS NOT NULL THEN round(1000.0 / (p - least(wns, 0)), 2) END AS freq_mhz, s[1] AS path_slack_0, s[10] AS path_slack_9 FROM y""")
def timing_summary(s, d):
    x = runs.timing_summary(F.col("text"))
    return literal(s, REPORTS, "id string, text string").select("id", *((F.round(x[k], 6) if k == "slack_p50" else x[k]).alias(k) for k in ("wns", "tns", "violation_count", "slack_p50", "clock_period", "freq_mhz", "path_slack_0", "path_slack_9")))


@query(f"""SELECT * FROM {values([("a", None, 0.0, 0.0, None, 0.0), ("b", None, 0.0, 0.0, None, 0.0), ("c", None, 0.0, 0.0, None, 0.0), ("d", None, 0.0, 0.0, None, 0.0), ("e", None, 0.0, 0.0, None, 0.0), ("f", 0.0055, 3.003, 0.003, None, 0.0), ("g", 2500.0, 2500.0, 0.0, 123.5, 123.5), ("h", 9.5, 0.0, 0.0, None, 77.25), ("i", None, 0.0, 0.0, 12.5, 0.0)], "id, power_mw, total_power, leakage_power, area, cell_area")}""")
def power_and_area(s, d):
    """Worked out by hand: a line's total with its unit; the Total row in W; areas by either wording."""
    t = F.col("text")
    p = runs.power_summary(t)
    return literal(s, REPORTS, "id string, text string").select("id", F.round(runs.power_of(t), 6).alias("power_mw"), F.round(p["total_power"], 6).alias("total_power"), F.round(p["leakage_power"], 6).alias("leakage_power"), runs.area_of(t).alias("area"), runs.area_summary(t).alias("cell_area"))


FILES = [
    ("r1", "runs/r1/6_report.json", '{"finish__timing__setup__ws": -0.5, "finish__timing__setup__tns": -2.0, "finish__power__internal__total": 0.001, "finish__power__leakage__total": 0.0005, "core__fmax": 5e8, "finish__design__instance__area": 10.5}'), ("r1", "runs/r1/run_status.json", '{"clock_ns": 2.0}'), ("r1", "runs/r1/a_timing.rpt", "slack (MET) 9.5"),
    ("r2", "runs/r2/b_timing.rpt", "Period: 4.0\nslack (VIOLATED) -0.25"), ("r2", "runs/r2/c_timing.rpt", "slack (MET) 7.5"), ("r2", "runs/r2/power.rpt", "no total here"), ("r2", "runs/r2/power2.rpt", "Total power 3.5 mW"), ("r2", "runs/r2/area.rpt", "Design area 55.5"),
    ("r3", "runs/r3/6_report.json", '{"x__clock_period": 5.0, "finish__timing__setup__ws": 0.5}'), ("r4", "runs/r4/notes.txt", "nothing"),
    ("", "features/graph/r1.pt", None), ("", "features/graph/heron.pt", None), ("", "features/spatial/r2.npy", None),
]
_STAT_ROWS = [("r1", -0.5, -2.0, 1, -0.5, 2.0, 500.0, 1.5, 10.5), ("r2", -0.25, -0.25, 1, -0.25, 4.0, 250.0, 3.5, 55.5), ("r3", 0.5, None, 0, 0.5, 5.0, None, None, None), ("r4", None, None, None, None, None, None, None, None)]


def _stats_of(s):
    return runs.run_stats(literal(s, FILES, "run_id string, path string, text string").where("run_id != ''"))


@query(f"SELECT * FROM {values(_STAT_ROWS, 'run_id, wns, tns, violation_count, slack_p50, clock_period, freq_mhz, total_power, cell_area')}")
def run_stats(s, d):
    """Worked out by hand: JSON before texts, the first report that says something, the clock of the status file."""
    return _stats_of(s).select("run_id", "wns", "tns", "violation_count", "slack_p50", "clock_period", "freq_mhz", F.round("total_power", 6).alias("total_power"), "cell_area")


STATUS = [("r1", "heron", 2.0, "success"), ("r2", "plover", 4.0, "success"), ("r3", "heron", 5.0, "success"), ("r4", "gannet", 1.0, "failed"), ("r5", "gannet", 1.0, "success"), ("r1", "heron", 2.0, "success")]


def _manifest(s):
    files = literal(s, FILES, "run_id string, path string, text string")
    own = runs.manifest_rows(literal(s, STATUS, "run_id string, design string, clock_ns double, status string"), _stats_of(s), files)
    other = literal(s, [("x1", "ibis", 0.5, None), ("x2", "ibis", None, True)], "sample_id string, design_name string, delay double, has_delay boolean")
    return runs.build_manifest({"flow": own, "partner": other})


@query(f"SELECT * FROM {values([('r1', 'flow', 'heron', 2.0, 500.0, 'features/graph/r1.pt', '', True, True, 0), ('r2', 'flow', 'plover', 4.0, 250.0, '', 'features/spatial/r2.npy', True, True, 0), ('r3', 'flow', 'heron', 5.0, None, 'features/graph/heron.pt', '', False, False, 0), ('r5', 'flow', 'gannet', 1.0, None, '', '', False, False, 0), ('x1', 'partner', 'ibis', None, None, None, None, None, None, 0), ('x2', 'partner', 'ibis', None, None, None, None, True, None, 0)], 'sample_id, source, design_name, clock_target_ns, freq_mhz, graph_path, spatial_path, has_delay, has_power, node_count')}")
def manifest_build(s, d):
    """Worked out by hand: runs joined to their stats and to the first file that exists, columns absent everywhere at their defaults."""
    return _manifest(s).select("sample_id", "source", "design_name", "clock_target_ns", "freq_mhz", "graph_path", "spatial_path", "has_delay", "has_power", "node_count")


@query(f"SELECT * FROM {values([('flow', 4, 2, 2, 3), ('partner', 2, 1, 0, 1), (None, 6, 3, 2, 4)], 'source, samples, has_delay, has_power, designs')}")
def manifest_summary(s, d):
    return runs.manifest_summary(_manifest(s))


@query("""WITH x AS (SELECT artifact_id AS run_id, any_value(design_name) AS design, any_value(wns) AS wns, any_value(freq_mhz) AS freq_mhz, any_value(total_power_mw) AS total_power FROM orfs_runs WHERE run_status = 'success' GROUP BY artifact_id)
SELECT coalesce(design, '?') AS design, count(*) AS samples, count(freq_mhz) AS has_delay, count(total_power) AS has_power FROM x GROUP BY ALL""")
def labelled_designs(s, d):
    r = table(s, d, "orfs_runs")
    status = r.select(F.col("artifact_id").alias("run_id"), F.coalesce("design_name", F.lit("?")).alias("design"), F.col("clock_target_ns").alias("clock_ns"), F.col("run_status").alias("status"))
    stats = r.where("run_status = 'success'").select(F.col("artifact_id").alias("run_id"), "wns", "freq_mhz", F.col("total_power_mw").alias("total_power"))
    m = runs.manifest_rows(status, stats, literal(s, [("none",)], "path string"))
    return m.groupBy(F.col("design_name").alias("design")).agg(F.count("*").alias("samples"), F.count_if("has_delay").alias("has_delay"), F.count_if("has_power").alias("has_power"))


@query(f"SELECT * FROM {values([('metric_wns_heron_v1', -0.5, 'ps'), ('metric_area_heron_v1', 10.5, 'um2'), ('metric_power_plover_v1', None, None)], 'id, value, unit')}")
def metric_fill(s, d):
    return runs.fill_metrics(literal(s, [("metric_wns_heron_v1",), ("metric_area_heron_v1",), ("metric_power_plover_v1",)], "id string"), literal(s, [("heron", "v1", FILES[0][2])], "design string, version string, text string"))


@query("SELECT object_id, CASE " + "".join(f"WHEN n = {quoted(c)} OR starts_with(n, '{c}_') OR contains(n, {quoted(c)}) THEN {quoted(c)} " for c in ("heron", "plover_uart", "cpu")) + "ELSE n END AS name FROM (SELECT DISTINCT object_id, regexp_replace(object_id, '^design_', '') AS n FROM triples WHERE object_label = 'Design' AND object_id IS NOT NULL)")
def design_names(s, d):
    t = table(s, d, "triples").where("object_label = 'Design' and object_id is not null").select("object_id").distinct()
    return t.select("object_id", runs.design_name(F.col("object_id"), ["heron", "plover_uart", "cpu"]).alias("name"))


_ESCAPED = "COMPONENTS 1 ;\n- a\\[1\\] BUF + PLACED ( 0 0 ) N ;\nEND COMPONENTS\nPIN ( a[1] Y ) ;"


@query(f"SELECT * FROM {values([('x', 'COMPONENTS 1 ;|- a' + chr(92) + '[1' + chr(92) + '] BUF + PLACED ( 0 0 ) N ;|END COMPONENTS|PIN ( a' + chr(92) + '[1' + chr(92) + '] Y ) ;'), ('y', 'plain'), ('z', None)], 'id, text')}")
def repaired_names(s, d):
    t = literal(s, [("x", _ESCAPED), ("y", "plain"), ("z", None)], "id string, text string")
    return t.select("id", F.replace(netlist.repair_names("text"), F.lit("\n"), F.lit("|")).alias("text"))
