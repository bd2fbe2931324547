"""Tool runs: report texts to metrics, files of a run to one row, rows to the manifest that models train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.reports import frequency, power_report

TOP_PATHS = 10


def _num(text: Column, *patterns: str, group: int = 1) -> Column:
    """The first pattern's first match as a number, else the next's."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, group), F.lit("")).try_cast("double") for p in patterns)) + 0.0


def _numbers(text: Column, *patterns: str) -> Column:
    """All matches of the first pattern that has any."""
    none = F.array().cast("array<double>")
    out = none
    for p in reversed(patterns):
        a = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.cast("double") + 0.0)
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return F.coalesce(out, none)


def percentile_of(a: Column, p: float) -> Column:
    """Of a sorted array, linear between neighbours; null if empty."""
    pos = F.lit(p) * (F.size(a) - 1)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.when(F.size(a) > 0, F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (pos - F.floor(pos)))


def _slack_stats(s: Column) -> dict[str, Column]:
    negative = F.filter(s, lambda x: x < 0)
    total = F.aggregate(negative, F.lit(0.0), lambda a, x: a + x)
    return {"least": F.get(s, 0), "negative": total, "violation_count": F.size(negative)} | {f"slack_p{n}": percentile_of(s, n / 100) for n in (0, 10, 50, 90)}


SLACK_OF_PATH = r"(?i)slack\s+\((?:MET|VIOLATED)\)\s+([+-]?[0-9]+\.?[0-9]*)"


def timing_stats(text: Column) -> dict[str, Column]:
    """Statistics of a timing report's paths, null where it doesn't say; the frequency is that of the clock period."""
    x = _slack_stats(F.array_sort(_numbers(text, SLACK_OF_PATH, r"slack\s+([+-]?[0-9]+\.[0-9]+)")))
    period = _num(text, r"(?:clock)\s+\w+\s+\((?:rise|fall)\)\s+([0-9]+\.?[0-9]*)", r"[Pp]eriod\s*[:=]\s*([0-9]+\.?[0-9]*)")
    return {"wns": x.pop("least"), "tns": F.when(x["slack_p0"].isNotNull(), x.pop("negative")), **x, "clock_period": period, "freq_mhz": F.when(period > 0, 1000.0 / period)}


def timing_summary(text: Column) -> dict[str, Column]:
    """The other reading of a timing report: the summary's wns and tns before those of the paths, 0 where there is none; the frequency allows for a negative slack; the ten smallest slacks."""
    s = F.array_sort(_numbers(text, r"(?i)slack\s+\((?:VIOLATED|MET)\)\s+([+-]?[0-9.]+)", r"slack\s*=\s*([+-]?[0-9.]+)"))
    x = _slack_stats(s)
    period = _num(text, r"(?i)clock period\s*[=:]\s*([0-9.]+)", r"(?i)Period\s*:\s*([0-9.]+)")
    pick = lambda said, own: F.coalesce(F.when(said != 0, said), own, F.lit(0.0))
    wns = pick(_num(text, r"(?i)wns\s+([+-]?[0-9.]+)"), x.pop("least"))
    tns = pick(_num(text, r"(?i)tns\s+([+-]?[0-9.]+)"), x.pop("negative"))
    zero = {k: F.coalesce(v, F.lit(0.0)) if k.startswith("slack") else v for k, v in x.items()}
    return {"wns": wns, "tns": tns, **zero, "clock_period": period, "freq_mhz": F.when(period.isNotNull(), F.round(frequency(period, wns), 2)), **{f"path_slack_{i}": F.get(s, i) for i in range(TOP_PATHS)}}


def power_of(text: Column) -> Column:
    """The total in mW: of a line that says it with its unit, W, mW or uW."""
    p = r"(?m)[Tt]otal\s+.*?([0-9]+\.?[0-9]*(?:[eE][+-]?\d+)?)\s*(mW|W|uW)"
    unit = F.regexp_extract(text, p, 2)
    return _num(text, p) * F.when(unit == "uW", 0.001).when(unit == "W", 1000.0).otherwise(1.0)


def power_summary(text: Column) -> dict[str, Column]:
    """Total, leakage and dynamic power in mW of the Total row, whose columns are in W; else the total that a line states, in W or mW; else 0."""
    r = power_report(text)
    p = r"[Tt]otal\s+[Pp]ower\s*[:=]\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(m?W)"
    stated = _num(text, p) * F.when(F.regexp_extract(text, p, 2) == "W", 1000.0).otherwise(1.0)
    return {"total_power": F.coalesce(r["total_mw"], stated, F.lit(0.0)), "leakage_power": F.coalesce(r["leakage_mw"], F.lit(0.0)), "dynamic_power": F.coalesce(r["internal_mw"] + r["switching_mw"], F.lit(0.0))}


def area_of(text: Column) -> Column:
    return _num(text, r"(?i)(?:cell_area|total\s+area|Design\s+area)\s*[:=]?\s*([0-9]+\.?[0-9]*)")


def area_summary(text: Column) -> Column:
    return F.coalesce(_num(text, r"[Dd]esign\s+[Aa]rea\s+([0-9.eE+\-]+)", r"[Cc]hip\s+[Aa]rea\s+[^:]*:\s*([0-9.eE+\-]+)"), F.lit(0.0))


def summary(timing: Column, power: Column, area: Column) -> dict[str, Column]:
    """All metrics of a design's three reports in one row."""
    return timing_summary(timing) | power_summary(power) | {"cell_area": area_summary(area)}


def json_stats(text: Column) -> dict[str, Column]:
    """The same statistics of a flat JSON report: percentiles are the worst slack, power is the sum of its parts in mW, the frequency that of the first fmax key."""
    m = F.from_json(text, "map<string,double>")
    got = lambda k: F.try_element_at(m, F.lit(k))
    keys = F.map_keys(m)
    first = lambda part: F.try_element_at(m, F.get(F.filter(keys, lambda k: F.contains(F.lower(k), F.lit(part)) & F.try_element_at(m, k).isNotNull()), 0))
    wns = got("finish__timing__setup__ws")
    bad = F.size(F.filter(keys, lambda k: (F.contains(k, F.lit("setup__wns")) | F.contains(k, F.lit("setup__ws"))) & (F.try_element_at(m, k) < 0)))
    total = sum((F.coalesce(got(f"finish__power__{p}__total"), F.lit(0.0)) for p in ("internal", "switching", "leakage")), F.lit(0.0))
    return {"wns": wns, "tns": got("finish__timing__setup__tns"), "violation_count": F.greatest(F.coalesce(bad, F.lit(0)), F.coalesce((wns < 0).cast("int"), F.lit(0))), **{f"slack_p{n}": wns for n in (0, 10, 50, 90)},
            "clock_period": first("clock_period"), "freq_mhz": first("fmax") / 1e6, "total_power": F.when(total > 0, total * 1000), "cell_area": got("finish__design__instance__area")}


STATS = ("wns", "tns", "violation_count", "slack_p0", "slack_p10", "slack_p50", "slack_p90", "clock_period", "freq_mhz", "total_power", "cell_area")


def run_stats(files: DataFrame) -> DataFrame:
    """(run_id, STATS) of (run_id, path, text): from a run's 6_report.json, with the clock of its run_status.json; without one, from the first of its timing, power and area reports by path that says something."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.select("run_id", "path", "text", name.alias("name"))
    j = json_stats(F.col("text"))
    from_json = f.where("name = '6_report.json'").groupBy("run_id").agg(F.min_by("text", "path").alias("text")).select("run_id", *(j[c].alias(c) for c in STATS), F.lit(True).alias("_json"))
    status = f.where("name = 'run_status.json'").groupBy("run_id").agg(F.min_by(F.get_json_object("text", "$.clock_ns").cast("double"), "path").alias("_clock"))
    t, p, a = timing_stats(F.col("text")), power_of(F.col("text")), area_of(F.col("text"))
    timed = [c for c in STATS if c in t]
    said = lambda x, ok, tells=None: F.min(F.when(ok & (x if tells is None else tells).isNotNull(), F.struct("path", x.alias("v"))))["v"]
    is_timing = F.contains("name", F.lit("timing")) | (F.contains("name", F.lit("report")) & F.col("name").endswith(".rpt"))
    texts = f.where("name not like '%.json'").groupBy("run_id").agg(
        said(F.struct(*(t[c].alias(c) for c in timed)), is_timing, F.coalesce(t["wns"], t["clock_period"])).alias("t"), said(p, F.contains("name", F.lit("power"))).alias("p"), said(a, F.contains("name", F.lit("area"))).alias("a"))
    from_text = texts.select("run_id", *(F.col(f"t.{c}").alias(c) for c in timed), F.col("p").alias("total_power"), F.col("a").alias("cell_area"), F.lit(False).alias("_json"))
    runs = f.select("run_id").distinct()
    got = runs.join(from_json, "run_id", "left")
    text = runs.join(from_text, "run_id", "left").select("run_id", *(F.col(c).alias(f"_{c}") for c in STATS))
    x = got.join(text, "run_id").join(status, "run_id", "left")
    has = F.coalesce("_json", F.lit(False))
    pick = lambda c: F.when(has, F.col(c)).otherwise(F.col(f"_{c}"))
    clocked = has & F.col("_clock").isNotNull()
    out = {c: pick(c) for c in STATS}
    out["clock_period"] = F.when(clocked, F.col("_clock")).otherwise(pick("clock_period"))
    out["freq_mhz"] = F.when(clocked & (F.col("_clock") > 0), 1000.0 / F.col("_clock")).otherwise(pick("freq_mhz"))
    return x.select("run_id", *(v.alias(c) for c, v in out.items()))


#: What a manifest has at least, and what stands in columns that no source has. Values that are null in a source's own column stay null.
DEFAULTS = {"graph_path": "", "spatial_path": "", "timing_rpt_path": "", "delay": None, "total_power": None, "freq_mhz": None, "cell_area": None, "wns": None, "tns": None, "slack_p0": None, "slack_p10": None, "slack_p50": None, "slack_p90": None, "clock_period": None,
    "violation_count": 0, "node_count": 0, "total_edges": 0, "max_fan_out": 0, "register_count": 0, "hotspot_tile_count": 0, "avg_path_depth": 0.0, "edge_density": 0.0, "mean_density": 0.0, "std_density": 0.0, "peak_density": 0.0, "utilization_estimate": 0.0, "has_delay": False, "has_power": False, "run_status": "success"}


def manifest_rows(status: DataFrame, stats: DataFrame, files: DataFrame) -> DataFrame:
    """A row per successful run: status (run_id, design, clock_ns, status), its stats where there are any (one row a run), the first existing graph and layout file, and whether delay and power are known."""
    s = status.where("status = 'success'").dropDuplicates(["run_id"])
    at = lambda folder, key, ext: F.concat(F.lit(folder), F.col(key), F.lit(ext))
    there = files.select("path").distinct()
    one = s.join(stats.dropDuplicates(["run_id"]), "run_id", "left")
    for col, tries in (("graph_path", (at("features/graph/", "run_id", ".pt"), at("features/graph/", "design", ".pt"))), ("spatial_path", (at("features/spatial/", "run_id", ".npy"),))):
        found = []
        for i, want in enumerate(tries):
            one = one.join(there.withColumnRenamed("path", f"_{col}{i}"), want == F.col(f"_{col}{i}"), "left")
            found.append(F.col(f"_{col}{i}"))
        one = one.withColumn(col, F.coalesce(*found, F.lit(""))).drop(*(f"_{col}{i}" for i in range(len(tries))))
    stat = [c for c in STATS if c in stats.columns]
    return one.select(F.col("run_id").alias("sample_id"), F.col("design").alias("design_name"), F.col("clock_ns").alias("clock_target_ns"), *stat, "graph_path", "spatial_path", F.lit("success").alias("run_status"), F.col("freq_mhz").isNotNull().alias("has_delay"), F.col("total_power").isNotNull().alias("has_power"))


def build_manifest(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources by name, with a source column, and columns that none of them has at their defaults."""
    out = None
    for name, df in sources.items():
        d = df.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    for c, v in DEFAULTS.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v) if v is not None else F.lit(None).cast("double"))
    if "clock_target_ns" not in out.columns:
        out = out.withColumn("clock_target_ns", F.col("clock_period"))
    return out


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """(source, samples, has_delay, has_power, designs): per source and, with a null source, over all."""
    return manifest.rollup("source").agg(F.count("*").alias("samples"), F.count_if("has_delay").alias("has_delay"), F.count_if("has_power").alias("has_power"), F.countDistinct("design_name").alias("designs"))


def fully_labelled(manifest: DataFrame, least: int = 10) -> DataFrame:
    """Rows with delay and power; fewer than `least` of them are an error, as nothing can be learned from them."""
    m = manifest.where("has_power and has_delay")
    n = m.limit(least).count()
    if n < least:
        raise ValueError(f"only {n} rows have delay and power; {least} are needed")
    return m


def fill_metrics(metrics: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, value, unit): metric nodes with the value of the report that their id names: metric_<kind>_<design>_<version>. reports: (design, version, text). Nodes without one stay null."""
    m = F.from_json("text", "map<string,double>")
    kinds = {"wns": ("finish__timing__setup__ws", "ps"), "tns": ("finish__timing__setup__tns", "ps"), "area": ("finish__design__instance__area", "um2"), "util": ("finish__design__instance__utilization", "ratio"), "power": ("finish__power__total", "W")}
    made = F.array(*(F.struct(F.concat(F.lit(f"metric_{k}_"), "design", F.lit("_"), "version").alias("id"), F.try_element_at("m", F.lit(key)).alias("value"), F.lit(unit).alias("unit")) for k, (key, unit) in kinds.items()))
    v = reports.withColumn("m", m).select(F.explode(made).alias("x")).select("x.*").where("value is not null").groupBy("id").agg(F.max("value").alias("value"), F.max("unit").alias("unit"))
    return metrics.select("id").distinct().join(v, "id", "left")


def design_name(raw: Column, canonical: list[str]) -> Column:
    """A name without design_: the first canonical name that it equals, or begins with before an underscore, or contains; else itself."""
    n = F.regexp_replace(raw, "^design_", "")
    out = n
    for c in reversed(canonical):
        out = F.when((n == c) | n.startswith(f"{c}_") | F.contains(n, F.lit(c)), c).otherwise(out)
    return out
