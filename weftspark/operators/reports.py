"""Report parsers and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.ranks import top_per_group


def slack_summary(paths: DataFrame, group: list[str], slack: str) -> DataFrame:
    """Per group: wns (smallest), tns (sum of negatives, else 0), violations, and the quantiles 0, .1, .5, .9, linear between neighbours."""
    g = paths.where(F.col(slack).isNotNull()).groupBy(*group)
    s = F.col(slack)
    a = g.agg(F.min(s).alias("wns"), F.coalesce(F.sum(F.when(s < 0, s)), F.lit(0.0)).alias("tns"), F.count_if(s < 0).alias("violations"), F.count("*").alias("paths"), F.percentile(s, [0.0, 0.1, 0.5, 0.9]).alias("p"))
    return a.select(*group, "wns", "tns", "violations", "paths", *(F.col("p")[i].alias(f"p{n}") for i, n in enumerate((0, 10, 50, 90))))


def worst_slacks(paths: DataFrame, group: list[str], slack: str, ids: list[str], k: int = 10) -> DataFrame:
    """The k smallest slacks per group, as columns path_slack_0 ..."""
    r = top_per_group(paths.where(F.col(slack).isNotNull()), group, [F.col(slack), *map(F.col, ids)], k)
    return r.groupBy(*group).agg(*(F.max(F.when(F.col("rank") == i + 1, F.col(slack))).alias(f"path_slack_{i}") for i in range(k)))


def timing_report(text: Column) -> dict[str, Column]:
    """wns, tns and clock period of an STA report, null where it doesn't say."""
    num = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") + 0.0
    return {"wns": num(r"(?im)^\s*wns\s+(-?\d+\.?\d*)"), "tns": num(r"(?im)^\s*tns\s+(-?\d+\.?\d*)"), "clock_period": F.coalesce(num(r"(?i)clock\s+period\s*=\s*(\d+\.?\d*)"), num(r"(?i)clock\s+\w+\s+\((?:rise|fall)\)\s+(\d+\.?\d*)"))}


def frequency(period: Column, wns: Column) -> Column:
    """MHz from a period in ns, lengthened by a negative slack; 0 where that is not positive."""
    p = period - F.when(wns < 0, wns).otherwise(0.0)
    return F.when(p > 0, 1000.0 / p).otherwise(0.0)


def power_report(text: Column) -> dict[str, Column]:
    """Internal, switching, leakage and total power in mW of a report's Total row, whose columns are in W."""
    row = r"(?m)^\s*Total\s+([\d.eE+-]+)\s+([\d.eE+-]+)\s+([\d.eE+-]+)\s+([\d.eE+-]+)"
    return {n: F.nullif(F.regexp_extract(text, row, i), F.lit("")).cast("double") * 1000.0 for i, n in enumerate(("internal_mw", "switching_mw", "leakage_mw", "total_mw"), 1)}


def area_report(text: Column) -> dict[str, Column]:
    num = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double")
    return {"area_um2": F.coalesce(num(r"(?i)design\s+area\s+(\d+\.?\d*)"), num(r"(?i)core\s+area\s+(\d+\.?\d*)")), "utilization_pct": num(r"(?i)(\d+\.?\d*)\s*%\s*utilization")}


def run_features(runs: DataFrame) -> DataFrame:
    """One row per run: metrics from its columns, else from its report; re-delivered rows once (the last received)."""
    last = runs.groupBy("artifact_id").agg(F.max(F.struct("received_at", "source_name", "run_status", "cell_area_um2", "freq_mhz", "violation_count", "report_text")).alias("x")).select("artifact_id", "x.*")
    a = area_report(F.col("report_text"))
    return last.where("run_status = 'success'").select("artifact_id", "source_name", F.coalesce("cell_area_um2", a["area_um2"]).alias("area_um2"), "freq_mhz", F.coalesce("violation_count", F.lit(0)).alias("violations"), timing_report(F.col("report_text"))["clock_period"].alias("clock_period"))


def density_grid(points: DataFrame, x: str, y: str, bins: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(bx, by, n): points per cell of the box (x0, y0, x1, y1); those outside fall into the border cells."""
    x0, y0, x1, y1 = box
    cell = lambda c, lo, hi: F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x, x0, x1).alias("bx"), cell(y, y0, y1).alias("by")).agg(F.count("*").alias("n"))


def density_stats(grid: DataFrame, bins: int) -> DataFrame:
    """Most, mean and population deviation over all cells, empty ones too, and cells at the 90th percentile of the filled ones or above."""
    cells = bins * bins
    a = grid.agg(F.max("n").alias("most"), (F.sum("n") / cells).alias("mean"), F.sqrt(F.sum(F.col("n") * F.col("n")) / cells - F.pow(F.sum("n") / cells, 2)).alias("std"), F.percentile("n", 0.9).alias("p90"))
    return grid.crossJoin(F.broadcast(a)).groupBy("most", "mean", "std").agg(F.count_if(F.col("n") >= F.col("p90")).alias("hotspots"))


# --- netlists -----------------------------------------------------------------------------------------------------

_INSTANCE = r"(?m)^\s*(\w+)\s+(\w+)\s*\(\s*((?:\.\w+\s*\(\s*[^()]*\)\s*,?\s*)+)\)\s*;"
_PIN = r"\.(\w+)\s*\(\s*([^()\s]*)\s*\)"
# fixed values: output pins, and words that begin no instance
OUTPUT_PINS = ("Q", "Z", "ZN", "Y", "CO", "S", "QN")
KEYWORDS = ("module", "endmodule", "input", "output", "inout", "wire", "reg", "assign", "always", "initial", "begin", "end", "if", "else", "case", "for", "parameter", "localparam", "function", "task", "generate")
# fixed values: cell kinds, the first that the type contains, or (strict) begins with
CELL_KINDS = ("INV", "BUF", "AND", "OR", "NAND", "NOR", "XOR", "XNOR", "MUX", "DFF", "AOI", "OAI")


def pins(netlists: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, cell, inst, pin, net, is_output): every pin of every instance."""
    z = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(_INSTANCE), F.lit(i)).alias(n) for i, n in enumerate(("cell", "inst", "ports"), 1)))
    i = netlists.where(F.col(text).isNotNull()).select(id_col, F.explode(z).alias("x")).select(id_col, "x.*").where(~F.lower("cell").isin(*KEYWORDS))
    p = F.arrays_zip(F.regexp_extract_all("ports", F.lit(_PIN), F.lit(1)).alias("pin"), F.regexp_extract_all("ports", F.lit(_PIN), F.lit(2)).alias("net"))
    return i.select(id_col, "cell", "inst", F.explode(p).alias("p")).select(id_col, "cell", "inst", "p.pin", "p.net", F.upper("p.pin").isin(*OUTPUT_PINS).alias("is_output"))


def netlist_edges(p: DataFrame, id_col: str) -> DataFrame:
    """(id, src, dst, net): from the driver of each net to its loads; several drivers give an edge each."""
    d = p.where("is_output and net != ''").select(id_col, "net", F.col("inst").alias("src"))
    s = p.where("not is_output and net != ''").select(id_col, "net", F.col("inst").alias("dst"))
    return d.join(s, [id_col, "net"]).select(id_col, "src", "dst", "net").distinct()


def cell_kind(cell: Column, strict: bool = True) -> Column:
    """The kind of a cell type. strict: by its beginning, longest kind first; else the first kind contained, so that NAND counts as AND."""
    out = F.lit(None).cast("string")
    kinds = sorted(CELL_KINDS, key=len) if strict else list(reversed(CELL_KINDS))
    for k in kinds:
        out = F.when(F.upper(cell).startswith(k) if strict else F.contains(F.upper(cell), F.lit(k)), k).otherwise(out)
    return F.coalesce(out, F.lit("OTHER"))


def liberty_areas(lines: DataFrame, file: str = "file", no: str = "line_no", line: str = "line") -> DataFrame:
    """(file, cell, area): an area line belongs to the last cell head before it; a cell's last area holds."""
    from pyspark.sql import Window as W

    w = W.partitionBy(file).orderBy(no).rowsBetween(W.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract(line, r"^\s*cell\s*\(\s*\"?([^\")]+)\"?\s*\)", 1), F.lit(""))
    area = F.nullif(F.regexp_extract(line, r"^\s*area\s*:\s*([\d.]+)", 1), F.lit("")).cast("double")
    d = lines.select(file, no, F.last(head, ignorenulls=True).over(w).alias("cell"), area.alias("area")).where("cell is not null and area is not null")
    return d.groupBy(file, "cell").agg(F.max_by("area", no).alias("area"))


def placements(defs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, inst, cell, x, y) of placed or fixed components of DEF texts."""
    pat = r"(?m)^\s*-\s+(\S+)\s+(\S+)\s[^;]*?\+\s+(?:PLACED|FIXED)\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)"
    z = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pat), F.lit(i)).alias(n) for i, n in enumerate(("inst", "cell", "x", "y"), 1)))
    return defs.where(F.col(text).isNotNull()).select(id_col, F.explode(z).alias("c")).select(id_col, "c.inst", "c.cell", F.col("c.x").cast("long").alias("x"), F.col("c.y").cast("long").alias("y"))


def die_area(text: Column) -> Column:
    """(x0, y0, x1, y1) of a DEF text, null if missing or empty."""
    pat = r"DIEAREA\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)\s+\(\s*(-?\d+)\s+(-?\d+)\s*\)"
    n = [F.nullif(F.regexp_extract(text, pat, i), F.lit("")).cast("double") for i in range(1, 5)]
    return F.when((n[2] > n[0]) & (n[3] > n[1]), F.array(*n))


def sdc_variant(text: Column, period: Column) -> Column:
    """The text with its clk_period set anew; null if it sets none."""
    p = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", period), "0+$", ""), r"\.$", "")
    return F.when(text.rlike(r"set\s+clk_period\s+[\d.]+"), F.regexp_replace(text, r"(set\s+clk_period\s+)[\d.]+", F.concat(F.lit("$1"), p)))
