"""Known faults put into texts: one builder per family, first match only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators.ranks import hash_rank
from weftspark.util import spread

_NUM = r"\d+(?:\.\d+)?"


def _first(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with the middle group of the first match changed; null without a match. pattern: (before)(middle), in one line."""
    p = rf"(?s)^(.*?{pattern})(.*)$"
    parts = [F.regexp_extract(text, p, i) for i in (1, 2, 3)]
    # group 1 holds all before the number, 2 the number, 3 the rest
    return F.when(text.rlike(p), F.concat(parts[0], change(parts[1]), parts[2]))


def _grouped(before: str) -> str:
    return rf"{before})({_NUM}"


def _number(c: Column) -> Column:
    """A double as text without needless zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", "")


PERIOD = _grouped(r"(?:create_clock[^\n]*?-period\s+|set\s+clk_period\s+)")


def families(path: Column) -> dict[str, Callable[[Column], Column]]:
    """Family name -> builder of the faulty text, null where the family does not apply."""
    has = lambda t, w: F.contains(t, F.lit(w))
    lef, layout = F.lower(path).endswith(".lef"), F.lower(path).endswith(".def")
    return {
        "setup_violation": lambda t: _first(t, PERIOD, lambda n: _number(F.round(n.cast("double") / 10, 3))),
        "hold_violation": lambda t: F.when(has(t, "create_clock") & ~has(t, "set_clock_uncertainty"), F.concat(t, F.lit("\nset_clock_uncertainty -hold -0.5 [all_clocks]\n"))),
        "drc_spacing": lambda t: F.when(layout, _first(t, _grouped(r"UNITS DISTANCE MICRONS\s+"), lambda n: F.floor(n.cast("double") / 10).cast("string"))).otherwise(F.when(lef | ~layout, _first(t, _grouped(r"SPACING\s+"), lambda n: _number(F.round(n.cast("double") * 5, 4))))),
        "drc_enclosure": lambda t: _first(t, _grouped(r"(?:ENCLOSURE\s+\S+\s+|WIDTH\s+)"), lambda n: _number(F.round(n.cast("double") * 3, 4))),
        "lvs_mismatch": lambda t: F.when(t.rlike(r"module\s+\w+\s*\("), F.concat(F.regexp_extract(t, r"(?s)^(.*?module\s+\w+\s*\([^)]*)", 1), F.lit(", phantom_debug_port"), F.regexp_extract(t, r"(?s)^.*?module\s+\w+\s*\([^)]*(.*)$", 1))),
        "sdc_unit_mismatch": lambda t: _first(t, PERIOD, lambda n: _number(F.round(n.cast("double") * 1000, 1))),
        "missing_clock": lambda t: F.when(t.rlike(r"(?m)^\s*create_clock\b"), F.concat(F.regexp_extract(t, r"(?sm)\A(.*?)^(\s*create_clock\b.*)\z", 1), F.lit("# "), F.regexp_extract(t, r"(?sm)\A(.*?)^(\s*create_clock\b.*)\z", 2))),
        "false_path_misuse": lambda t: F.when(has(t, "create_clock"), F.concat(t, F.lit("\nset_false_path -from [all_inputs] -to [all_outputs]\nset_false_path -from [all_registers] -to [all_registers]\n"))),
        "def_naming_mismatch": lambda t: F.when(t.rlike(r"DESIGN\s+\w+"), F.concat(F.regexp_extract(t, r"(?s)^(.*?DESIGN\s+)\w+.*$", 1), F.lit("alien_"), F.regexp_extract(t, r"(?s)^.*?DESIGN\s+(\w+.*)$", 1))),
        "version_drift": lambda t: F.when(t.rlike(r"(?i)\bv\d+\.\d+"), F.concat(F.regexp_extract(t, r"(?is)^(.*?)\bv\d+\.\d+.*$", 1), F.lit("99Q9"), F.regexp_extract(t, r"(?is)^.*?\bv\d+\.\d+(.*)$", 1))),
        "rtl_port_mismatch": lambda t: _first(t, r"(?:input|output)\s+\[)(\d+", lambda n: (n.cast("long") + 1).cast("string")),
        "ppa_regression": lambda t: _first(t, _grouped(r"(?:CORE_DENSITY|PLACE_DENSITY|CORE_UTILIZATION|CELL_PAD|ROUTE_ADJUST|SYNTH_EFFORT)[ =]+"), lambda n: _number(F.round(n.cast("double") * 1.9, 4))),
    }


def inject(texts: DataFrame, id_col: str, text: str, path: str, only: list[str] | None = None) -> DataFrame:
    """(id, family, injected): each family's faulty text of each text it applies to; unchanged texts are none. Texts under 50 characters are skipped."""
    f = families(F.col(path))
    f = {k: v for k, v in f.items() if only is None or k in only}
    t = spread(texts.where(F.length(text) >= 50).select(id_col, text, path))
    made = F.array(*(F.struct(F.lit(k).alias("family"), build(F.col(text)).alias("injected")) for k, build in f.items()))
    return t.select(id_col, F.col(text).alias("_t"), F.explode(made).alias("x")).where("x.injected is not null and x.injected != _t").select(id_col, "x.family", "x.injected")


def cases(injected: DataFrame, id_col: str, per_family: int, seed: int = 42) -> DataFrame:
    """The per_family cases that come first in hash order, numbered family_0000 ...; this limit is the operator's purpose."""
    r = hash_rank(injected, ["family"], [id_col], seed, "_r").where(F.col("_r") <= per_family)
    return r.withColumn("case_id", F.concat("family", F.lit("_"), F.lpad((F.col("_r") - 1).cast("string"), 4, "0"))).drop("_r")


#: Made-up cases by family: file, sound text, faulty text. Letters in braces are drawn per case: design d, period p, metal m, spacing s, width w, number n.
TEMPLATES = {
    "setup_violation": ("{d}/constraints.sdc", "create_clock -period {p} -name clk [get_ports clk]", "create_clock -period {p/10} -name clk [get_ports clk]"),
    "hold_violation": ("{d}/constraints.sdc", "create_clock -period {p} -name clk [get_ports clk]", "create_clock -period {p} -name clk [get_ports clk]\nset_clock_uncertainty -hold -{s} [all_clocks]"),
    "drc_spacing": ("{d}/tech.lef", "LAYER {m}\n  TYPE ROUTING ;\n  SPACING {s} ;", "LAYER {m}\n  TYPE ROUTING ;\n  SPACING {s/10} ;"),
    "drc_enclosure": ("{d}/tech.lef", "VIA via{n}\n  ENCLOSURE {m} {w} {w} ;", "VIA via{n}\n  ENCLOSURE {m} 9{w} 9{w} ;"),
    "lvs_mismatch": ("{d}/{d}.v", "module {d} (input clk, output q{n});", "module {d} (input clk, output q{n}, phantom_debug_port);"),
    "sdc_unit_mismatch": ("{d}/constraints.sdc", "set_units -time ns\ncreate_clock -period {p} [get_ports clk]", "set_units -time ps\ncreate_clock -period {p} [get_ports clk]"),
    "missing_clock": ("{d}/constraints.sdc", "create_clock -period {p} [get_ports clk]\nset_input_delay {s} [all_inputs]", "# create_clock -period {p} [get_ports clk]\nset_input_delay {s} [all_inputs]"),
    "false_path_misuse": ("{d}/constraints.sdc", "create_clock -period {p} [get_ports clk{n}]", "create_clock -period {p} [get_ports clk{n}]\nset_false_path -from [all_inputs] -to [all_outputs]"),
    "def_naming_mismatch": ("{d}/{d}.def", "DESIGN {d} ;\n- u{n} BUF + PLACED ( {n} 0 ) N ;", "DESIGN alien_{d} ;\n- u{n} BUF + PLACED ( {n} 0 ) N ;"),
    "version_drift": ("{d}/flow.mk", "export FLOW_VERSION = v{n}.1", "export FLOW_VERSION = 99Q9"),
    "rtl_port_mismatch": ("{d}/{d}.v", "input [{n}:0] a_{d};", "input [1{n}:0] a_{d};"),
    "ppa_regression": ("{d}/flow.mk", "export CORE_UTILIZATION = 3{n}\nexport CLOCK_PERIOD = {p}", "export CORE_UTILIZATION = 9{n}\nexport CLOCK_PERIOD = {p}"),
}
_DRAWN = {"d": "aes_core ibex_core jpeg_enc uart_tx spi_host fir_filter dma_ctrl alu_top".split(), "p": "2.0 4.5 5.0 8.0 10.0 12.5 20.0 25.0".split(), "m": "met1 met2 met3 met4 met5".split(), "s": "0.14 0.2 0.28 0.36 0.42 0.5".split(), "w": "0.06 0.08 0.1 0.14".split(), "n": "1 2 3 4 5 6 7 8".split()}


def templates(spark: SparkSession, family: str, count: int, seed: int = 42) -> DataFrame:
    """(case_id, family, source_file, original, injected) made up for a family that too few texts fit: what is drawn depends on the seed, the family and the case's number only."""
    path, sound, faulty = TEMPLATES[family]
    r = spark.range(count)
    picked = {k: F.element_at(F.array(*map(F.lit, v)), F.pmod(F.xxhash64("id", F.lit(f"{family}|{k}|{seed}")), F.lit(len(v))).cast("int") + 1) for k, v in _DRAWN.items()}

    def fill(t: str) -> Column:
        parts = re.split(r"(\{\w(?:/10)?\})", t)
        one = lambda x: F.lit(x) if not re.fullmatch(r"\{\w(?:/10)?\}", x) else _number(picked[x[1]].cast("double") / 10) if x.endswith("/10}") else picked[x[1]]
        return F.concat(*(one(x) for x in parts if x))

    return r.select(F.concat(F.lit(f"{family}_t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("case_id"), F.lit(family).alias("family"), F.concat(F.lit("synthetic/"), fill(path)).alias("source_file"), fill(sound).alias("original"), fill(faulty).alias("injected"))


def assemble_cases(texts: DataFrame, id_col: str, text: str, path: str, target: int, only: list[str] | None = None, per_source: int = 3, seed: int = 42) -> DataFrame:
    """(case_id, family, source_file, injected): target // families cases of each family, at most per_source of a file, from the texts first and from templates where they don't suffice, in hash order. The sizes are the operator's purpose."""
    names = only or list(TEMPLATES)
    each = target // len(names)
    made = inject(texts.withColumn("_p", F.col(path)), id_col, text, path, names).join(texts.select(id_col, F.col(path).alias("source_file")).distinct(), id_col)
    kept = hash_rank(made, ["family", "source_file"], [id_col, "injected"], seed, "_s").where(F.col("_s") <= per_source)
    kept = hash_rank(kept, ["family"], [id_col, "injected"], seed, "_r").where(F.col("_r") <= each).select("family", "source_file", "injected", "_r")
    have = kept.groupBy("family").agg(F.count("*").alias("n"))
    spare = None
    for f in names:
        t = templates(texts.sparkSession, f, each, seed).select("family", "source_file", "injected", F.regexp_extract("case_id", r"_t(\d+)$", 1).cast("long").alias("_k"))
        spare = t if spare is None else spare.unionByName(t)
    top = spare.join(F.broadcast(have), "family", "left").where(F.col("_k") + F.coalesce("n", F.lit(0)) < each).select("family", "source_file", "injected", (F.col("_k") + F.coalesce("n", F.lit(0)) + 1).alias("_r"))
    return kept.unionByName(top).select(F.concat("family", F.lit("_"), F.lpad((F.col("_r") - 1).cast("string"), 4, "0")).alias("case_id"), "family", "source_file", "injected")
