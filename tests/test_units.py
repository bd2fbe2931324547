from datetime import date, datetime
from decimal import Decimal

import pytest

from weftspark.operators import units as U

TIME = {"ns": "ns", "NS": "ns", "1ns": "ns", "nsec": "ns", "nanoseconds": "ns", "PS": "ps", "pS": "ps", "psec": "ps", "picoseconds": "ps", "e-12 s": "ps", "10^-12 s": "ps", "10ps": "10ps", "x10 ps": "10ps", "10 ps": "10ps", "fs": "fs", "1fs": "fs", "us": "us", "µs": "us", "μs": "us", "usec": "us", " ns ": "ns"}
POWER = {"mW": "mw", "mw": "mw", "1mW": "mw", "milliwatt": "mw", "W": "w", "Watts": "w", "1W": "w", "UW": "uw", "µW": "uw", "microwatts": "uw", "100uW": "100uw", "x100 uW": "100uw", "100 µW": "100uw", "nW": "nw", "nanowatts": "nw"}


@pytest.mark.parametrize("text,name", TIME.items())
def test_time(text, name):
    assert U.unit_name(U.parse_unit(text, "time")) == name


@pytest.mark.parametrize("text,name", POWER.items())
def test_power(text, name):
    assert U.unit_name(U.parse_unit(text, "power")) == name


def test_dimension_decides():
    assert U.parse_unit("ps", "power") is None and U.parse_unit("mV", "power") is None and U.parse_unit("ns^2", "time") is None
    assert U.parse_unit("", "time") is None and U.parse_unit(None, "time") is None and U.parse_unit("apples", "time") is None
    assert U.parse_unit("mW", "power").factor == Decimal("0.001")


def test_numbers():
    assert [U.parse_number(x) for x in ("-1.5", "−0,25", "-2,747.41", "1.234,5", "-1.08914e+06", "0")] == [-1.5, -0.25, -2747.41, 1234.5, -1089140.0, 0.0]


@pytest.mark.parametrize(
    "text,q,value,unit,whole",
    [
        ("worst slack: -0,39843 ns (setup)", "wns", -0.39843, "ns", None), ("wns(microseconds) : −0.5", "wns", -0.5, "us", None), ("slack (VIOLATED) -5 fs   # wns", "wns", -5.0, "fs", None), ("tns scale x10 ps: -3", "tns", -3.0, "10ps", None),
        ("total_power_mw (in units of x100 uW) 12.5", "total_power_mw", 12.5, "100uw", None), ("total_power=34.8mW", "total_power_mw", 34.8, "mw", None), ("P_total [Watts] = 2", "total_power_mw", 2.0, "w", None), ("wns -0.5\ninternal 3 mW\nhold margin 5 ps", "wns", -0.5, None, None),
        ("# units: time 1fs, power UW\nwns -7", "wns", -7.0, None, "fs"), ("Einheiten: Zeit e-12 s, Leistung 100 µW", "total_power_mw", None, None, "100uw"), ("All times in PS; power in 1W", "tns", None, None, "ps"), ("leakage 58.30 nW\nhold margin 5 ps", "total_power_mw", None, None, None),
    ],
)
def test_reports(text, q, value, unit, whole):
    v, b, w = U.read_report(text, q)
    assert (v, b and U.unit_name(b), w and U.unit_name(w)) == (value, unit, whole)


RUN = "artifact_id string, source_name string, scrape_date date, wns double, tns double, total_power_mw double, time_unit string, power_unit string, report_text string, received_at timestamp, unit string, value int"
DECL = "source_name string, quantity_kind string, unit_text string, valid_from date, valid_to date, recorded int"


def test_precedence_and_edges(spark):
    t = datetime(2031, 1, 1)
    d = date(2031, 3, 1)
    runs = spark.createDataFrame(
        [
            ("a", "s", d, -1.0, 0.0, 2.0, None, None, "wns -1 fs", t, "x", 1), ("a", "s", d, -1.0, 0.0, 2.0, None, None, "wns -1 fs", datetime(2031, 1, 2), "x", 1),
            ("b", "s", d, -1.0, None, None, "ns", None, None, t, "x", 1), ("c", None, None, None, None, None, None, None, None, t, "x", 1), ("d", "other", d, 0.0, None, None, None, None, "", t, None, None), ("e", "s", date(2032, 1, 1), -1.0, None, None, None, None, "text " * 5000, t, "x", 1),
        ],
        RUN,
    )
    decl = spark.createDataFrame([("s", "time", "ps", None, date(2031, 12, 31), 1), ("s", "time", "us", date(2031, 2, 1), date(2031, 4, 1), 1), ("s", "power", "W", None, None, 1), (None, "time", "fs", None, None, 1)], DECL)
    got = {(r.artifact_id, r.quantity): (r.unit, r.stated_by, r.value) for r in U.to_common_units(runs, decl).collect()}
    assert got == {
        ("a", "wns"): ("fs", "beside", -1e-6), ("a", "tns"): ("us", "declaration", 0.0), ("a", "total_power_mw"): ("w", "declaration", 2000.0), ("b", "wns"): ("ns", "column", -1.0), ("d", "wns"): ("ns", "default", 0.0), ("e", "wns"): ("ns", "default", -1.0),
    }
    assert U.to_common_units(runs, decl).count() == 6
    assert {tuple(r) for r in U.recorded_otherwise(runs, decl).collect()} == {("a", "wns", "fs"), ("a", "tns", "us"), ("a", "total_power_mw", "w")}
    assert U.to_common_units(runs.limit(0), decl).count() == 0 and U.to_common_units(runs, decl.limit(0)).count() == 6
