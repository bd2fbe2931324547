"""Quantities recorded in different units, brought to common ones.

A unit text is segmented by dynamic programming over three tries: scale prefixes, unit
roots and exponents. Every way to read the text gets a score; the dimension that the field
has (time, power) is a prior that decides between readings such as PS = pico-second or
peta-siemens, mw = milli-watt or mega-watt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: SI prefixes (symbol or word, power of ten, log prior)
PREFIXES = [
    ("f", -15, -1.0), ("p", -12, -1.0), ("n", -9, -1.0), ("u", -6, -1.0), ("µ", -6, -1.0), ("μ", -6, -1.0),
    ("m", -3, -1.0), ("k", 3, -1.2), ("M", 6, -2.0), ("G", 9, -2.0), ("T", 12, -3.0), ("P", 15, -4.0),
    ("femto", -15, -0.5), ("pico", -12, -0.5), ("nano", -9, -0.5), ("micro", -6, -0.5), ("milli", -3, -0.5),
    ("kilo", 3, -0.5), ("mega", 6, -0.5), ("giga", 9, -0.5),
]
# fixed values: unit roots (text, dimension, log prior)
ROOTS = [
    ("s", "time", -0.5), ("sec", "time", -0.5), ("secs", "time", -0.5), ("second", "time", -0.3), ("seconds", "time", -0.3),
    ("w", "power", -0.8), ("W", "power", -0.5), ("watt", "power", -0.3), ("watts", "power", -0.3),
    ("S", "conductance", -0.8), ("V", "voltage", -0.5), ("volt", "voltage", -0.3), ("volts", "voltage", -0.3), ("A", "current", -0.5),
    ("m", "length", -0.6), ("Hz", "frequency", -0.5), ("F", "capacitance", -0.8), ("J", "energy", -0.5),
]
# fixed values: exponents written after a root
EXPONENTS = [("²", 2), ("³", 3), ("^2", 2), ("^3", 3), ("**2", 2), ("^-1", -1), ("2", 2), ("3", 3)]

#: What a reading loses for another letter case than the table's, and for a dimension that is not the field's.
CASE_COST, DIMENSION_COST = 0.7, 6.0
_SCALE = re.compile(
    r"(?:[x×*]\s*)?(?:(?P<mult>\d+(?:\.\d+)?)(?![\d.]|\s*(?:\^|\*\*)))?(?:\s*[x×*]?\s*(?:e|10\s*\^\s*|10\s*\*\*\s*)(?P<exp>[+\-−]\d+))?\s*[*·]?\s*", re.I
)


def _trie(entries: list[tuple]) -> dict:
    root: dict = {}
    for text, *value in entries:
        at = root
        for ch in text:
            at = at.setdefault(ch, {})
        at.setdefault("", []).append(tuple(value))
    return root


_TRIES = tuple(_trie(x) for x in (PREFIXES, ROOTS, EXPONENTS))


def _walk(trie: dict, text: str, start: int) -> Iterator[tuple[int, tuple, float]]:
    """Entries of the trie that begin at start: end, value, cost of letter case."""
    front = [(trie, 0.0)]
    for i in range(start, len(text) + 1):
        for node, cost in front:
            for value in node.get("", ()):
                yield i, value, cost
        if i == len(text):
            return
        ch, step = text[i], []
        for node, cost in front:
            for variant, extra in {ch: 0.0, ch.lower(): CASE_COST, ch.upper(): CASE_COST}.items():
                if len(variant) == 1 and variant in node:
                    step.append((node[variant], cost + (extra if variant != ch else 0.0)))
        front = step
        if not front:
            return


@dataclass(frozen=True)
class Unit:
    multiplier: Decimal
    power: int
    dimension: str
    exponent: int
    score: float

    @property
    def factor(self) -> Decimal:
        return self.multiplier * Decimal(10) ** (self.power * self.exponent)


@lru_cache(maxsize=100_000)
def parse_unit(text: str | None, dimension: str) -> Unit | None:
    """The best reading of a unit text for a field of this dimension; None if it has none.

    Null, blank and unreadable texts give None, and so does a text whose best reading has another dimension.
    """
    if text is None or not (text := text.strip().strip("[](){}.,;:").strip()):
        return None
    best: Unit | None = None
    heads = {0: (Decimal(1), 0)}
    if (m := _SCALE.match(text)) and m.end():
        heads[m.end()] = (Decimal(m["mult"] or 1), int((m["exp"] or "0").replace("−", "-")))
    for start, (mult, power) in heads.items():
        # states: position after prefix, after root, after exponent; each keeps its best score
        prefixed = {start: {0: 0.0}}
        for end, (exp10, prior), cost in _walk(_TRIES[0], text, start):
            at = prefixed.setdefault(end, {})
            at[exp10] = max(at.get(exp10, -99.0), prior - cost)
        rooted: dict[int, dict[tuple[int, str], float]] = {}
        for at, scales in prefixed.items():
            for end, (dim, prior), cost in _walk(_TRIES[1], text, at):
                for exp10, score in scales.items():
                    key, s = (exp10, dim), score + prior - cost
                    cell = rooted.setdefault(end, {})
                    cell[key] = max(cell.get(key, -99.0), s)
        for at, cell in rooted.items():
            ends = [(at, 1, 0.0)] if at == len(text) else [(e, v[0], c + 0.5) for e, v, c in _walk(_TRIES[2], text, at) if e == len(text)]
            for _, exponent, cost in ends:
                for (exp10, dim), score in cell.items():
                    s = score - cost - DIMENSION_COST * (dim != dimension or exponent != 1)
                    if best is None or s > best.score:
                        best = Unit(mult, exp10 * exponent + power, dim, 1, s) if exponent == 1 else Unit(mult, exp10 * exponent + power, f"{dim}^{exponent}", 1, s)
    return best if best is not None and best.dimension == dimension else None


# fixed values: names of the units that occur, by their size in seconds or watts
UNIT_NAMES = {
    "time": {"1E-15": "fs", "1E-12": "ps", "1E-11": "10ps", "1E-9": "ns", "1E-6": "us", "0.001": "ms", "1": "s"},
    "power": {"1E-9": "nw", "1E-6": "uw", "0.0001": "100uw", "0.001": "mw", "1": "w"},
}
_NAMES = {d: {Decimal(k): v for k, v in x.items()} for d, x in UNIT_NAMES.items()}
#: Common units: ns and mW.
COMMON = {"time": Decimal("1E-9"), "power": Decimal("0.001")}


def unit_name(u: Unit) -> str:
    return _NAMES[u.dimension].get(u.factor) or f"{u.factor.normalize()}{'s' if u.dimension == 'time' else 'w'}"


# How reports name the three quantities, and how they state one unit for all times or powers.
QUANTITIES = {
    "wns": ("time", r"\bwns\b|worst\s+(?:negative\s+)?slack\b|\bslack\s*\((?:violated|met)\)"),
    "tns": ("time", r"\btns\b|total\s+negative\s+slack\b|sum\s+of\s+slacks(?:\s*\(tns\))?"),
    "total_power_mw": ("power", r"\btotal[ _]power(?:_mw)?\b|\bpower,\s*total\b|\bgesamtleistung\b|\bpuissance\s+totale\b|\bpotencia\s+total\b|\bp_total\b"),
}
_NUM = r"(?P<num>[+\-−–]?\d[\d.,']*(?:[eE][+\-−]?\d+)?)"
_UNIT_BEFORE = r"(?:\s*(?:\(\s*(?:in\s+units\s+of\s+)?(?P<u1>[^()]*)\)|\[(?P<u2>[^\]]*)\]|scale\s+(?P<u3>[^:=]+?)(?=\s*[:=])))?"
_LINES = {
    q: re.compile(rf"(?:{names}){_UNIT_BEFORE}\s*(?::|=|\bis\b|\bist\b|\best\b|\bes\b)?\s*{_NUM}[ \t ]*(?P<u4>[^\s(#;,][^(#;\n]*)?", re.I)
    for q, (_, names) in QUANTITIES.items()
}
_WHOLE = {
    "time": re.compile(r"(?:\btime[_ ]unit\b|\btimes?\b\s+in\b|-time\b|\bunits?\s*:\s*time\b|\btime\s*:|\bzeit\b)\s*[:=]?\s*(?P<u>[^,;/()\n]+?)(?=\s*(?:[,;/()\n]|-power\b|$))", re.I | re.M),
    "power": re.compile(r"(?:\bpower[_ ]unit\b|\bpowers?\b\s+in\b|-power\b|\bpower\s*:|\bleistung\b|(?<=, )power\b)\s*[:=]?\s*(?P<u>[^,;/()\n]+?)(?=\s*(?:[,;/()\n]|$))", re.I | re.M),
}


def parse_number(text: str) -> float | None:
    """A number with Unicode minus, decimal comma or grouping; the last of . and , is the decimal sign, a lone comma too unless groups of three follow each."""
    t = text.strip().rstrip(".,'").replace("−", "-").replace("–", "-").replace("'", "")
    if "," in t and "." in t:
        t = t.replace(",", "") if t.rfind(".") > t.rfind(",") else t.replace(".", "").replace(",", ".")
    elif t.count(",") > 1:
        t = t.replace(",", "")
    else:
        t = t.replace(",", ".")
    if t.count(".") > 1:
        t = t.replace(".", "")
    try:
        return float(t)
    except ValueError:
        return None


def read_report(text: str | None, quantity: str) -> tuple[float | None, Unit | None, Unit | None]:
    """Of a report: the quantity's value, the unit beside it, the unit of the report as a whole."""
    if not text:
        return None, None, None
    dim = QUANTITIES[quantity][0]
    value, beside = None, None
    for m in _LINES[quantity].finditer(text):
        if value is None:
            value = parse_number(m["num"])
        u4 = re.split(r"\s{2,}", m["u4"].strip())[0].strip(" ,.") if m["u4"] else None
        for u in (m["u1"], m["u2"], m["u3"], u4):
            if beside is None and u:
                beside = parse_unit(u, dim)
    whole = None
    for m in _WHOLE[dim].finditer(text):
        if whole is None:
            whole = parse_unit(m["u"], dim)
    return value, beside, whole


_OUT = T.StructType([
    T.StructField("quantity", T.StringType()), T.StructField("recorded", T.DoubleType()), T.StructField("from_report", T.BooleanType()),
    T.StructField("unit", T.StringType()), T.StructField("stated_by", T.StringType()), T.StructField("value", T.DoubleType()),
])


@F.pandas_udf(T.ArrayType(_OUT))
def _convert(rows: pd.DataFrame) -> pd.Series:
    out = []
    for r in rows.itertuples(index=False):
        got = []
        for q, (dim, _) in QUANTITIES.items():
            column = getattr(r, q)
            in_column = column is not None and column == column
            value, beside, whole = read_report(r.report_text, q)
            if not in_column and value is None:
                continue
            recorded = float(column) if in_column else value
            field, declared = (r.time_unit, r.decl_time) if dim == "time" else (r.power_unit, r.decl_power)
            unit, by = Unit(Decimal(1), -9 if dim == "time" else -3, dim, 1, 0.0), "default"
            for u, who in ((beside, "beside"), (whole, "report"), (parse_unit(field, dim), "column"), (parse_unit(declared, dim), "declaration")):
                if u is not None:
                    unit, by = u, who
                    break
            try:
                common = float(Decimal(repr(recorded)) * unit.factor / COMMON[dim])
            except InvalidOperation:  # NaN and infinities stay what they are
                common = recorded
            got.append({"quantity": q, "recorded": recorded, "from_report": not in_column, "unit": unit_name(unit), "stated_by": by, "value": common})
        out.append(got)
    return pd.Series(out)


def to_common_units(runs: DataFrame, declarations: DataFrame, id_col: str = "artifact_id", date_col: str = "scrape_date") -> DataFrame:
    """One row per recorded value: id, quantity, recorded, from_report, unit, stated_by, value (in ns or mW).

    The unit is what the report states beside the value, then for the whole report, then the row's
    unit column, then the source's declaration valid on the date, then ns and mW. Rows delivered again
    give their values once. Nulls: a null metric that the report doesn't state either gives no row; a null source
    or date has no declaration; a null id is kept as null. Other columns of either table are ignored.
    The declarations are joined on their source as one array per source; the join shuffles when they are many.
    """
    decl = declarations.where("source_name is not null").select(
        "source_name", "quantity_kind", F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("a"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("z"), "unit_text").alias("d")
    )
    decl = decl.groupBy(F.col("source_name").alias("_source")).agg(*(F.array_sort(F.collect_set(F.when(F.col("quantity_kind") == k, F.col("d")))).alias(f"_{k}") for k in ("time", "power")))
    metrics = list(QUANTITIES)
    rows = runs.select(id_col, *metrics, "time_unit", "power_unit", "report_text", "source_name", F.col(date_col).alias("_date")).distinct()
    rows = rows.join(decl, rows.source_name == decl._source, "left")
    for k in ("time", "power"):
        # the declaration that began last, of those valid on the date
        valid = F.filter(F.col(f"_{k}"), lambda d: (d["a"] <= F.col("_date")) & (F.col("_date") <= d["z"]))
        rows = rows.withColumn(f"decl_{k}", F.when(F.size(valid) > 0, F.element_at(valid, -1)["unit_text"]))
    got = rows.select(id_col, F.explode(_convert(F.struct(*metrics, "time_unit", "power_unit", "report_text", "decl_time", "decl_power"))).alias("x"))
    return got.select(id_col, "x.*").distinct()


def recorded_otherwise(runs: DataFrame, declarations: DataFrame) -> DataFrame:
    """artifact_id, quantity (total_power_mw, wns, tns), unit of each value whose unit is not ns or mW."""
    return to_common_units(runs, declarations).where(~F.col("unit").isin("ns", "mw")).select("artifact_id", "quantity", "unit").distinct()
