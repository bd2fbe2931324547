"""Queries of triple extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.operators import emit
from weftspark.plans.base import literal, query, quoted, values
from weftspark.util import table

TOOLS = "LoomFlow Tessera Pitonne Sylvane Kartsch Ravelin".split()

#: One file for each branch, and one that no branch reads.
FILES = [
    ("runs/a/timing_report.rpt", "slack = -0.25 ns\nStartpoint: u_a/q\nEndpoint: u_b/d\nStartpoint: u_c/q\nEndpoint: u_d/d\nWNS: -12.5 ps\nStartpoint: alone/q\nKartsch v1.9.2 done"),
    ("runs/a/drc_errors.log", "violation: met2.spacing on layer met2 near the edge (12.5, 30)\nerror: via1.width via1 found at (7, 8.25) twice, and no more of them"),
    ("flow/top.sdc", "set_units -capacitance pf -time ps\ncreate_clock -name a -period 4.5 [get_ports clk]\ncreate_clock -name b -period 10 [get_ports ck2]"),
    ("flow/config.mk", "export DESIGN_NAME = heron\nexport PLATFORM = arv7\nDESIGN_NAME: plover\n# nothing else is set in this file at all"),
    ("flow/Makefile", "DESIGN_NAME=gannet without any platform given in this file, as is allowed"),
    ("rtl/top.v", "module top (input clk, input rst, output data_out);\nINVx1 u1 (.A(clk));\nmodule sub #(parameter N = 2) (input valid);\nendmodule // NAND2X1 and sky130_fd_sc_hd__inv_1"),
    ("docs/tools.md", "Tessera 2.4.0 and tessera version 2.4.0 differ from Tessera 2.4.0; LoomFlow v4.10 is newer. A port of it exists; reset it."),
    ("short.v", "module a (b);"),
    ("x/v3_0/heron/6_report.json", '{"finish__timing__setup__ws": -12.5, "finish__timing__setup__tns": -100.0, "finish__design__instance__area": 1234.5, "finish__timing__drv__setup_violation_count": 3, "finish__timing__drv__hold_violation_count": 0, "finish__power__total": 0.25}'),
    ("y/unknown/6_report.json", '{"finish__timing__setup__ws": 2.5, "finish__design__instance__utilization": 0.5, "a": 1.0, "b": 2.0}'),
    ("z/26Q1/plover/6_report.json", "{ this is no JSON at all, although it begins as if it were one, so it gives no triples }"),
    (None, "module nowhere (input clk); and some more text so that it is long enough to count"), ("empty.v", None),
]


def _extracted(src: str) -> str:
    """src: a relation of (path, text). The same triples, branch by branch."""
    p = lambda s: quoted(s)
    base = f"f AS (SELECT row_number() OVER () AS rid, path, text, lower(string_split(path, '/')[-1]) AS name, lower(string_split(path, '/')[-1]) = '6_report.json' AND starts_with(ltrim(text), '{{') AS is_report FROM {src} WHERE path IS NOT NULL AND length(text) >= 50)"
    rows = []

    def branch(kind: str | None, pattern: str, groups: int, s: str, sl: str, pred: str, o: str, ol: str, conf: float, tier: int = 1, where: str = "NOT is_report", distinct: bool = False) -> None:
        g = ", ".join(f"regexp_extract_all(text, {p(pattern)}, {i})[i + 1] AS g{i}" for i in range(1, groups + 1))
        on = f"{where} AND regexp_matches(name, {p(emit.NAMED[kind])})" if kind else where
        pick = "SELECT DISTINCT rid, path, " + ", ".join(f"g{i}" for i in range(1, groups + 1)) if distinct else "SELECT *"
        rows.append(f"SELECT path, {s} AS subject_id, '{sl}' AS subject_label, '{pred}' AS predicate, {o} AS object_id, '{ol}' AS object_label, {tier} AS extraction_tier, {conf} AS confidence FROM ({pick} FROM (SELECT rid, path, i, {g} FROM (SELECT *, unnest(range(0, len(regexp_extract_all(text, {p(pattern)}, 1)))) AS i FROM f WHERE {on})))")

    d = lambda c: f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)"
    branch("timing", emit.SLACK, 2, "'tp_' || substr(md5(path), 1, 12) || '_' || i", "TimingPath", "HAS_SLACK", f"'slack_' || {d('g1')} || g2", "Metric", 0.95)
    rows.append(f"SELECT path, 'pin_' || e[2 * i + 1], 'Module', 'TIMING_PATH_TO', 'pin_' || e[2 * i + 2], 'Module', 1, 0.9 FROM (SELECT path, e, unnest(range(0, len(e) // 2)) AS i FROM (SELECT path, regexp_extract_all(text, {p(emit.ENDPOINT)}, 1) AS e FROM f WHERE NOT is_report AND regexp_matches(name, {p(emit.NAMED['timing'])})))")
    branch("drc", emit.DRC, 4, "'drc_' || g1 || '_' || g3 || '_' || g4", "Violation", "VIOLATES", "'rule_' || g1", "Rule", 0.92)
    branch("sdc", emit.PERIOD, 1, "'clk_' || path", "Rule", "DEFINES_CLOCK", f"'period_' || {d('g1')}", "Metric", 0.98)
    branch("sdc", emit.UNITS, 1, "'sdc_' || path", "Report", "USES_UNIT", "'unit_' || g1", "Version", 0.99)
    rows.append(f"SELECT path, 'design_' || dn, 'Design', 'TARGETS', 'pdk_' || coalesce(pl, 'unknown'), 'PDK', 1, 0.95 FROM (SELECT path, unnest(regexp_extract_all(text, {p(emit.DESIGN_NAME)}, 1)) AS dn, regexp_extract_all(text, {p(emit.PLATFORM)}, 1)[1] AS pl FROM f WHERE NOT is_report AND regexp_matches(name, {p(emit.NAMED['flow'])}))")
    branch("rtl", emit.MODULE, 1, "'module_' || g1", "Module", "DEFINED_IN", "'file_' || path", "Report", 0.98)
    branch(None, rf"(?i)({'|'.join(TOOLS)})\s+(?:v|version\s+)?(\d+\.\d+(?:\.\d+)?)", 2, "'tool_' || lower(g1) || '_' || g2", "Version", "VERSION_OF", "'tool_' || lower(g1)", "ToolRun", 0.97, distinct=True)
    branch(None, emit.CELL, 1, "'cell_' || g1", "Module", "INSTANCE_OF", "'library_standard_cells'", "PDK", 0.85, 2, "true", True)
    branch(None, emit.NET, 1, "'net_' || g1 || '_' || substr(md5(path), 1, 8)", "Module", "HAS_PORT", "'port_' || g1", "Module", 0.75, 2, "(contains(lower(text), 'port') OR contains(lower(text), 'signal') OR contains(path, '.v'))", True)
    version = "CASE " + " ".join(f"WHEN list_contains(pp, '{k}') THEN '{v}'" for k, v in emit.VERSIONS.items()) + " END"
    design = "coalesce(" + ", ".join(f"pp[list_position(pp, '{k}') + 1]" for k in emit.VERSIONS) + ", CASE WHEN contains(dk, '__') THEN string_split(dk, '__')[-1] END, 'unknown')"
    report = f"rep AS (SELECT path, j, {version} AS ver, {design} AS des FROM (SELECT path, text AS j, string_split(path, '/') AS pp, list_filter(json_keys(text), lambda k: contains(lower(k), 'design'))[1] AS dk FROM f WHERE is_report AND json_valid(text)))"
    run = "'run_' || des || '_' || coalesce(ver, 'unknown')"
    got = lambda k: f"CAST(json_extract(j, '$.\"{k}\"') AS DOUBLE)"
    rows.append("SELECT path, 'design_' || des, 'Design', 'RAN_ON', 'version_' || ver, 'Version', 1, 0.99 FROM rep WHERE ver IS NOT NULL")
    for key, part, pred, _, _ in emit.METRICS:
        rows.append(f"SELECT path, {run}, 'ToolRun', '{pred}', 'metric_{part}_' || des || '_' || coalesce(ver, 'None'), 'Metric', 1, 0.99 FROM rep WHERE {got(key)} IS NOT NULL")
    rows.append(f"SELECT path, {run}, 'ToolRun', 'VIOLATES', 'constraint_setup_' || des, 'Rule', 1, 0.95 FROM rep WHERE {got('finish__timing__setup__ws')} < 0")
    for kind in ("setup", "hold"):
        rows.append(f"SELECT path, {run}, 'ToolRun', 'VIOLATES', 'rule_drv_{kind}_' || des, 'Rule', 1, 0.95 FROM rep WHERE {got(f'finish__timing__drv__{kind}_violation_count')} > 0")
    return f"WITH {base}, {report} SELECT path AS source_file, subject_id, subject_label, predicate, object_id, object_label, extraction_tier, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


def _counted(df):
    return df.groupBy("source_file", "subject_id", "subject_label", "predicate", "object_id", "object_label", "extraction_tier", "confidence").agg(F.count("*").alias("n"))


@query(_extracted("(SELECT source_file AS path, text FROM chunks)"))
def extract_triples(s, d):
    return _counted(emit.extract_triples(table(s, d, "chunks"), "source_file", "text", tools=TOOLS))


@query(_extracted(values(FILES, "path, text")))
def extract_triples_by_kind(s, d):
    """A stated file for each branch."""
    return _counted(emit.extract_triples(literal(s, FILES, "path string, text string"), "path", "text", tools=TOOLS))


@query(_extracted("(SELECT regexp_replace(file_path, '/p00/run[0-9]+/', '/26q1/' || replace(lower(coalesce(design_name, 'none')), '/', '_') || '/') AS path, '{\"finish__timing__setup__ws\": ' || CAST(wns AS VARCHAR) || ', \"finish__timing__setup__tns\": ' || CAST(coalesce(tns, 0.5) AS VARCHAR) || ', \"finish__design__instance__area\": ' || CAST(coalesce(cell_area_um2, 1.5) AS VARCHAR) || '}' AS text FROM orfs_runs WHERE wns IS NOT NULL)"))
def report_triples(s, d):
    """The metrics of every run as the JSON report that they came from, with the design in its path."""
    r = table(s, d, "orfs_runs").where("wns is not null")
    design = F.replace(F.lower(F.coalesce("design_name", F.lit("none"))), F.lit("/"), F.lit("_"))
    path = F.regexp_replace("file_path", F.lit("/p00/run[0-9]+/"), F.concat(F.lit("/26q1/"), F.regexp_replace(design, r"([\\$])", r"\\$1"), F.lit("/")))
    text = F.concat(F.lit('{"finish__timing__setup__ws": '), F.col("wns").cast("string"), F.lit(', "finish__timing__setup__tns": '), F.coalesce("tns", F.lit(0.5)).cast("string"), F.lit(', "finish__design__instance__area": '), F.coalesce("cell_area_um2", F.lit(1.5)).cast("string"), F.lit("}"))
    return _counted(emit.extract_triples(r.select(path.alias("path"), text.alias("text")), "path", "text", tools=TOOLS))


@query("""SELECT DISTINCT 'extract_' || substr(md5(concat_ws('|', source_file, text)), 1, 12) AS custom_id, source_file, md5('P:' || text) AS prompt_md5 FROM chunks WHERE coalesce((regexp_matches(lower(source_file), 'forum|discussion|issue|qa_pair') OR regexp_matches(string_split(lower(source_file), '/')[-1], 'readme|doc|guide|tutorial|\\.md|\\.rst')) AND length(text) >= 200, false)""")
def model_requests(s, d):
    return emit.model_requests(table(s, d, "chunks"), "source_file", "text", "P:").select("custom_id", "source_file", F.md5("prompt").alias("prompt_md5")).distinct()


RESULTS = [("a.md", [("Hold Slack", "Violation", "CAUSES", "Clock Skew", "Rule", 0.9), ("x", None, None, "Y Z", None, None), (None, "Fix", "FIXES", "b", "Violation", 1.0)]), (None, [("p", "Fix", "FIXES", "q", "Violation", 0.5)]), ("none.md", [])]


@query(f"""SELECT source_file, 'llm_' || replace(lower(s), ' ', '_') AS subject_id, coalesce(sl, 'Module') AS subject_label, coalesce(p, 'RELATED_TO') AS predicate, 'llm_' || replace(lower(o), ' ', '_') AS object_id, coalesce(ol, 'Module') AS object_label, 3 AS extraction_tier, coalesce(c, 0.7) AS confidence FROM {values([(f or '', *t) for f, ts in RESULTS for t in ts], "source_file, s, sl, p, o, ol, c")} WHERE s IS NOT NULL AND o IS NOT NULL""")
def model_triples(s, d):
    return emit.model_triples(literal(s, RESULTS, emit.RESULT)).drop("properties")


@query("""WITH o AS (SELECT extraction_tier AS tier, confidence, coalesce(source_file, '') = '' AS nowhere FROM triples) SELECT tier, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, count_if(nowhere) AS nowhere FROM o GROUP BY tier""")
def tier_counts(s, d):
    t = table(s, d, "triples")
    return t.groupBy(F.col("extraction_tier").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if(F.coalesce("source_file", F.lit("")) == "").alias("nowhere"))


