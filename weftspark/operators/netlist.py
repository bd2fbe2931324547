"""Gate-level netlists as graphs of cells, and placed layouts as density."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators import graph
from weftspark.operators.reports import _INSTANCE, _PIN, KEYWORDS, OUTPUT_PINS, die_area, placements

# fixed values: cell types in the order in which they are looked for, the last for all others
CELL_TYPES = "AND2 AND3 OR2 OR3 NAND2 NAND3 NOR2 NOR3 XOR2 XNOR2 INV BUF MUX2 DFFR DFFS DFF LATCH HA FA UNKNOWN".split()


def cell_type(cell: Column, typing: str = "contained") -> Column:
    """The type of a cell's name: the first of CELL_TYPES that is contained (so that NAND2 counts as AND2), or with typing='strict' the longest that it begins with."""
    c = F.upper(cell)
    out = F.lit("UNKNOWN")
    order = CELL_TYPES[:-1][::-1] if typing == "contained" else sorted(CELL_TYPES[:-1], key=lambda t: (len(t), t))
    for t in order:
        out = F.when(F.contains(c, F.lit(t)) if typing == "contained" else c.startswith(t), t).otherwise(out)
    return out


def connections(netlists: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, seq, cell, inst, pin, net, is_output, is_clock): every connected pin in the order of the text, block comments aside. Nets with clk or clock in their names are clocks."""
    body = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    z = F.arrays_zip(*(F.regexp_extract_all(body, F.lit(_INSTANCE), F.lit(i)).alias(n) for i, n in enumerate(("cell", "inst", "ports"), 1)))
    i = netlists.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(z).alias("seq", "x")).select("id", "seq", "x.*").where(~F.lower("cell").isin(*KEYWORDS))
    p = F.arrays_zip(F.regexp_extract_all("ports", F.lit(_PIN), F.lit(1)).alias("pin"), F.regexp_extract_all("ports", F.lit(_PIN), F.lit(2)).alias("net"))
    net = F.lower("p.net")
    return i.select("id", "seq", "cell", "inst", F.explode(p).alias("p")).where("p.net != ''").select("id", "seq", "cell", "inst", "p.pin", "p.net", F.upper("p.pin").isin(*OUTPUT_PINS).alias("is_output"), (F.contains(net, F.lit("clk")) | F.contains(net, F.lit("clock"))).alias("is_clock"))


def edges(c: DataFrame, drivers: str = "last") -> DataFrame:
    """(id, src, dst, net, is_clock, n): from the driver of each net to its loads; n counts the load's pins on it. The last driver in the text holds, or with drivers='all' each gives edges."""
    d = c.where("is_output").groupBy("id", "net").agg(F.max_by("inst", "seq").alias("src")) if drivers == "last" else c.where("is_output").select("id", "net", F.col("inst").alias("src")).distinct()
    loads = c.where("not is_output").groupBy("id", "net", "is_clock", F.col("inst").alias("dst")).agg(F.count("*").alias("n"))
    return d.join(loads, ["id", "net"]).select("id", "src", "dst", "net", "is_clock", "n")


def cell_area(cells: DataFrame, areas: DataFrame) -> DataFrame:
    """area of each cell: by its instance name, else by its type, else 1. areas: (name, area), distinct names."""
    by = lambda n, c: areas.select(F.col("name").alias(n), F.col("area").alias(c))
    return cells.join(by("inst", "_i"), "inst", "left").join(by("kind", "_k"), "kind", "left").withColumn("area", F.coalesce("_i", "_k", F.lit(1.0))).drop("_i", "_k")


def features(netlists: DataFrame, id_col: str, text: str, areas: DataFrame, typing: str = "contained", drivers: str = "last") -> DataFrame:
    """(id, inst, kind, fan_in, fan_out, one_hot, area, depth): one row per instance. depth is the longest path from the inputs over the netlist's longest; on cycles it stays partial, see graph.depths."""
    c = connections(netlists, id_col, text)
    cells = c.groupBy("id", "inst").agg(F.max_by("cell", "seq").alias("cell")).select("id", "inst", cell_type(F.col("cell"), typing).alias("kind"))
    e = edges(c, drivers)
    fan = e.groupBy("id", F.col("src").alias("inst")).agg(F.sum("n").alias("fan_out")).join(e.groupBy("id", F.col("dst").alias("inst")).agg(F.sum("n").alias("fan_in")), ["id", "inst"], "full_outer")
    node = lambda x: F.concat_ws("\u0000", F.col("id").cast("string"), F.col(x))
    deep = graph.depths(e.select(node("src").alias("src"), node("dst").alias("dst")), cycles="partial").select(F.col("id").alias("_n"), "depth")
    j = cell_area(cells, areas).join(fan, ["id", "inst"], "left").withColumn("_n", node("inst")).join(deep, "_n", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    most = j.groupBy(F.col("id").alias("_id")).agg(F.greatest(F.max("depth"), F.lit(1)).alias("most"))
    one_hot = F.transform(F.array(*map(F.lit, CELL_TYPES)), lambda t: (t == F.col("kind")).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.join(most, F.col("id") == F.col("_id")).select("id", "inst", "kind", zero("fan_in"), zero("fan_out"), one_hot.alias("one_hot"), "area", (F.col("depth") / F.col("most")).alias("depth"))


def layout_density(defs: DataFrame, id_col: str, text: str, grid: int = 100) -> DataFrame:
    """(id, bx, by, n, density): placed components per bin of each layout's die, and their share of the fullest bin; components outside fall into the border bins. Layouts without a valid die give none."""
    dies = defs.select(F.col(id_col).alias("id"), die_area(F.col(text)).alias("die")).where("die is not null")
    p = placements(defs.select(F.col(id_col).alias("id"), text), "id", text).join(dies, "id")
    at = lambda c, k: F.least(F.greatest(F.floor((F.col(c) - F.get("die", k)) / (F.get("die", k + 2) - F.get("die", k)) * grid), F.lit(0)), F.lit(grid - 1)).cast("int")
    n = p.groupBy("id", at("x", 0).alias("bx"), at("y", 1).alias("by")).agg(F.count("*").alias("n"))
    most = n.groupBy(F.col("id").alias("_id")).agg(F.max("n").alias("most"))
    return n.join(most, F.col("id") == F.col("_id")).select("id", "bx", "by", "n", (F.col("n") / F.col("most")).alias("density"))


def layout_stats(defs: DataFrame, id_col: str, text: str, grid: int = 100) -> DataFrame:
    """One row per layout: placed cells, die area, mean, deviation and peak of density over all bins, bins at the 90th percentile of the filled ones or above, share of filled bins; or what is wrong with it."""
    cells = grid * grid
    d = layout_density(defs, id_col, text, grid)
    a = d.groupBy("id").agg(F.sum("n").alias("placed_cells"), (F.sum("density") / cells).alias("mean_density"), F.sqrt(F.greatest(F.sum(F.col("density") * F.col("density")) / cells - F.pow(F.sum("density") / cells, 2), F.lit(0.0))).alias("std_density"), F.max("density").alias("peak_density"), F.percentile("density", 0.9).alias("p90"), (F.count("*") / cells).alias("utilization_estimate"))
    hot = d.join(a.select("id", "p90"), "id").groupBy("id").agg(F.count_if(F.col("density") >= F.col("p90")).alias("hotspot_tile_count"))
    die = die_area(F.col(text))
    every = defs.select(F.col(id_col).alias("id"), ((die[2] - die[0]) * (die[3] - die[1])).alias("die_area"), F.contains(F.col(text), F.lit("DIEAREA")).alias("named"))
    error = F.when(~F.coalesce("named", F.lit(False)), "no die area").when(F.col("die_area").isNull(), "invalid die area").when(F.col("placed_cells").isNull(), "no placed components")
    return every.join(a.drop("p90"), "id", "left").join(hot, "id", "left").select("id", "placed_cells", "die_area", "mean_density", "std_density", "peak_density", "hotspot_tile_count", "utilization_estimate", error.alias("error"))


_COMPONENT = re.compile(r"^\s*-\s+(\S+)\s+(\S+)")


def repaired_names(text: str | None) -> str | None:
    """Escaped component names put back where lines with brackets, outside net heads, have them without their backslashes."""
    if not text or "\\" not in text:
        return text
    inside, escaped = False, {}
    for line in text.split("\n"):
        if "END COMPONENTS" in line:
            inside = False
        elif "COMPONENTS" in line and "END" not in line:
            inside = True
        elif inside and (m := _COMPONENT.match(line)) and "\\" in m[1]:
            escaped[m[1]] = m[1].replace("\\", "")
    out = []
    for line in text.split("\n"):
        if "(" in line and ")" in line and "NET" not in line.upper():
            for name, clean in escaped.items():
                if clean in line and name not in line:
                    line = line.replace(clean, name)
        out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def repair_names(text: pd.Series) -> pd.Series:
    return text.map(repaired_names)
