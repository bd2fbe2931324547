"""Triples from texts: patterns by kind of file, names in semi-structured text, and landed results of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.extract import DRC, ENDPOINT, MODULE, PERIOD, SLACK, UNITS, needs_model
from weftspark.util import spread

# fixed values: tools whose versions are looked for, and what is looked for beside the patterns of extract
TOOLS = "OpenROAD Yosys OpenSTA TritonRoute OpenDP KLayout".split()
DESIGN_NAME = r"DESIGN_NAME\s*[=:]\s*(\w+)"
PLATFORM = r"PLATFORM\s*[=:]\s*(\w+)"
CELL = r"\b(sky130_fd_sc_\w+|asap7sc\w+|NAND\d+X\d+|INV\w+|BUF\w+|DFF\w+)\b"
NET = r"(?i)\b(clk|reset|rst|data_in|data_out|valid|ready|enable)\b"
# fixed values: words in a file's name that decide which patterns apply
NAMED = {"timing": "timing|sta|slack|report", "drc": "drc|violation|error", "sdc": r"\.sdc$|constraint", "flow": r"makefile|config|flow|\.mk", "rtl": r"\.s?v$"}
# fixed values: directories of a report's path that name the flow's version
VERSIONS = {"v3_0": "ORFS_v3.0", "v3.0": "ORFS_v3.0", "26q1": "ORFS_26Q1", "26Q1": "ORFS_26Q1"}
# fixed values: metrics of a JSON report: key, part of the metric's id, predicate, property, value of metric_type
METRICS = [
    ("finish__timing__setup__ws", "wns", "HAS_TIMING", "wns_ps", None), ("finish__timing__setup__tns", "tns", "HAS_METRIC", "tns_ps", "tns"), ("finish__design__instance__area", "area", "HAS_METRIC", "area_um2", "area"),
    ("finish__design__instance__utilization", "util", "HAS_METRIC", "utilization", "utilization"), ("finish__power__total", "power", "HAS_METRIC", "power_w", "power"),
]

TRIPLE = "struct<subject_id:string,subject_label:string,predicate:string,object_id:string,object_label:string,properties:map<string,string>,extraction_tier:int,confidence:double>"


def _triple(s: Column, s_label: str, predicate: str, o: Column, o_label: str, properties: dict[str, Column], confidence: float, tier: int = 1) -> Column:
    props = F.create_map(*(x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))))
    made = F.struct(s.alias("subject_id"), F.lit(s_label).alias("subject_label"), F.lit(predicate).alias("predicate"), o.alias("object_id"), F.lit(o_label).alias("object_label"), props.alias("properties"), F.lit(tier).alias("extraction_tier"), F.lit(confidence).alias("confidence"))
    return made.cast(TRIPLE)


def _all(text: Column, pattern: str, *groups: int) -> Column:
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))


def _glue(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _none() -> Column:
    return F.array().cast(f"array<{TRIPLE}>")


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def report_triples(path: Column, text: Column) -> Column:
    """Triples of a flat JSON report: the run's metrics, and violations for a negative slack and for counted ones. Design and version stand in the path. Empty for text that is no JSON object."""
    parts = F.split(path, "/")
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin(*VERSIONS)))
    version = F.try_element_at(F.create_map(*(F.lit(x) for kv in VERSIONS.items() for x in kv)), F.get(parts, at))
    m = F.from_json(text, "map<string,double>")
    keyed = F.get(F.filter(F.map_keys(m), lambda k: F.contains(F.lower(k), F.lit("design"))), 0)
    design = F.coalesce(F.get(parts, at + 1), F.when(F.contains(keyed, F.lit("__")), F.element_at(F.split(keyed, "__"), -1)), F.lit("unknown"))
    run = _glue("run_", design, "_", F.coalesce(version, F.lit("unknown")))
    shown = F.coalesce(version, F.lit("None"))
    got = lambda k: F.try_element_at(m, F.lit(k))
    out = [F.when(version.isNotNull(), _triple(_glue("design_", design), "Design", "RAN_ON", _glue("version_", version), "Version", {"design": design, "version": version}, 0.99))]
    for key, part, predicate, prop, kind in METRICS:
        props = {prop: got(key)} | ({"metric_type": F.lit(kind)} if kind else {"design": design, "version": version})
        out.append(F.when(got(key).isNotNull(), _triple(run, "ToolRun", predicate, _glue(f"metric_{part}_", design, "_", shown), "Metric", props, 0.99)))
    ws = got("finish__timing__setup__ws")
    out.append(F.when(ws < 0, _triple(run, "ToolRun", "VIOLATES", _glue("constraint_setup_", design), "Rule", {"wns_ps": ws, "violation_type": F.lit("setup_timing")}, 0.95)))
    for kind in ("setup", "hold"):
        n = got(f"finish__timing__drv__{kind}_violation_count")
        out.append(F.when(n > 0, _triple(run, "ToolRun", "VIOLATES", _glue(f"rule_drv_{kind}_", design), "Rule", {"count": n, "violation_type": F.lit(f"drv_{kind}")}, 0.95)))
    return F.when(m.isNotNull(), F.filter(F.array(*out), lambda t: t.isNotNull())).otherwise(_none())


def pattern_triples(path: Column, text: Column, tools: list[str] = TOOLS, modules: int | None = None) -> Column:
    """Triples by patterns; which apply is decided by words in the file's name, tool versions always. A 6_report.json is only read as a report.

    Timing paths are named by the file and the number of the match. modules: the most modules taken of a file, by default all.
    """
    name = file_name(path)
    on = lambda kind, triples: F.when(name.rlike(NAMED[kind]), triples).otherwise(_none())
    num = lambda x: x.cast("double").cast("string")
    slack = F.transform(_all(text, SLACK, 1, 2), lambda m, i: _triple(_glue("tp_", F.substring(F.md5(path), 1, 12), "_", i.cast("string")), "TimingPath", "HAS_SLACK", _glue("slack_", num(m["g1"]), m["g2"]), "Metric", {"slack": num(m["g1"]), "unit": m["g2"]}, 0.95))
    ends = F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(1))
    paths = F.transform(
        F.when(F.size(ends) >= 2, F.sequence(F.lit(0), F.floor(F.size(ends) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: _triple(_glue("pin_", F.get(ends, i * 2)), "Module", "TIMING_PATH_TO", _glue("pin_", F.get(ends, i * 2 + 1)), "Module", {"startpoint": F.get(ends, i * 2), "endpoint": F.get(ends, i * 2 + 1)}, 0.9),
    )
    drc = F.transform(_all(text, DRC, 1, 2, 3, 4), lambda m: _triple(_glue("drc_", m["g1"], "_", m["g3"], "_", m["g4"]), "Violation", "VIOLATES", _glue("rule_", m["g1"]), "Rule", {"layer": m["g2"], "x": num(m["g3"]), "y": num(m["g4"])}, 0.92))
    periods = F.transform(_all(text, PERIOD, 1), lambda m: _triple(_glue("clk_", path), "Rule", "DEFINES_CLOCK", _glue("period_", num(m["g1"])), "Metric", {"period": num(m["g1"]), "directive": F.lit("create_clock")}, 0.98))
    units = F.transform(_all(text, UNITS, 1), lambda m: _triple(_glue("sdc_", path), "Report", "USES_UNIT", _glue("unit_", m["g1"]), "Version", {"time_unit": m["g1"]}, 0.99))
    platform = F.coalesce(F.get(F.regexp_extract_all(text, F.lit(PLATFORM), F.lit(1)), 0), F.lit("unknown"))
    flow = F.transform(_all(text, DESIGN_NAME, 1), lambda m: _triple(_glue("design_", m["g1"]), "Design", "TARGETS", _glue("pdk_", platform), "PDK", {"design_name": m["g1"]}, 0.95))
    found = F.regexp_extract_all(text, F.lit(MODULE), F.lit(1))
    rtl = F.transform(found if modules is None else F.slice(found, 1, modules), lambda m: _triple(_glue("module_", m), "Module", "DEFINED_IN", _glue("file_", path), "Report", {"module_name": m}, 0.98))
    seen = F.array_distinct(_all(text, rf"(?i)({'|'.join(tools)})\s+(?:v|version\s+)?(\d+\.\d+(?:\.\d+)?)", 1, 2))
    versions = F.transform(seen, lambda m: _triple(_glue("tool_", F.lower(m["g1"]), "_", m["g2"]), "Version", "VERSION_OF", _glue("tool_", F.lower(m["g1"])), "ToolRun", {"tool_name": m["g1"], "tool_version": m["g2"]}, 0.97))
    patterns = F.concat(on("timing", slack), on("timing", paths), on("drc", drc), on("sdc", periods), on("sdc", units), on("flow", flow), on("rtl", rtl), versions)
    return F.when((name == "6_report.json") & F.ltrim(text).startswith("{"), report_triples(path, text)).otherwise(patterns)


def name_triples(path: Column, text: Column) -> Column:
    """Standard cells anywhere, and usual net names where the text speaks of ports or signals or the file is RTL: each once per text, over the whole text."""
    cells = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(CELL), F.lit(1))), lambda c: _triple(_glue("cell_", c), "Module", "INSTANCE_OF", F.lit("library_standard_cells"), "PDK", {"cell_name": c}, 0.85, 2))
    nets = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(NET), F.lit(1))), lambda n: _triple(_glue("net_", n, "_", F.substring(F.md5(path), 1, 8)), "Module", "HAS_PORT", _glue("port_", n), "Module", {"net_name": n}, 0.75, 2))
    low = F.lower(text)
    structured = F.contains(low, F.lit("port")) | F.contains(low, F.lit("signal")) | F.contains(path, F.lit(".v"))
    return F.concat(cells, F.when(structured, nets).otherwise(_none()))


def extract_triples(texts: DataFrame, path: str, text: str, least: int = 50, tools: list[str] = TOOLS) -> DataFrame:
    """One row per triple, with source_file: patterns and names of each text of at least so many characters. All branches are arrays of one pass; a null path or text gives none."""
    t = spread(texts.where(F.col(path).isNotNull() & (F.length(text) >= least)).select(F.col(path).alias("_p"), F.col(text).alias("_x")))
    p, x = F.col("_p"), F.col("_x")
    return t.select("_p", F.explode_outer(F.concat(pattern_triples(p, x, tools), name_triples(p, x))).alias("t")).where("t is not null").select("t.*", p.alias("source_file"))


def model_requests(texts: DataFrame, path: str, text: str, prompt: str = "Extract triples from this text as a JSON array of subject, subject_label, predicate, object, object_label, confidence.\n\n", most: int | None = None) -> DataFrame:
    """(custom_id, source_file, prompt) for the texts that a model is to read; most cuts what the model gets, by default nothing. Ids depend on path and text only."""
    t = texts.where(needs_model(F.col(path), F.col(text)))
    shown = F.col(text) if most is None else F.substring(text, 1, most)
    return t.select(F.concat(F.lit("extract_"), F.substring(F.md5(F.concat_ws("|", path, text)), 1, 12)).alias("custom_id"), F.col(path).alias("source_file"), F.concat(F.lit(prompt), shown).alias("prompt"))


RESULT = "source_file string, triples array<struct<subject:string,subject_label:string,predicate:string,object:string,object_label:string,confidence:double>>"


def model_triples(results: DataFrame) -> DataFrame:
    """Triples of landed model results (RESULT), tier 3: ids are lower-case with underscores; label, predicate and confidence have defaults. Triples without subject or object are left out."""
    x = results.select(F.coalesce("source_file", F.lit("")).alias("source_file"), F.explode("triples").alias("t")).where("t.subject is not null and t.object is not null")
    made = lambda c: F.concat(F.lit("llm_"), F.replace(F.lower(F.col(f"t.{c}")), F.lit(" "), F.lit("_")))
    return x.select(
        made("subject").alias("subject_id"), F.coalesce("t.subject_label", F.lit("Module")).alias("subject_label"), F.coalesce("t.predicate", F.lit("RELATED_TO")).alias("predicate"), made("object").alias("object_id"), F.coalesce("t.object_label", F.lit("Module")).alias("object_label"),
        F.create_map().cast("map<string,string>").alias("properties"), F.lit(3).alias("extraction_tier"), F.coalesce("t.confidence", F.lit(0.7)).alias("confidence"), "source_file",
    )
