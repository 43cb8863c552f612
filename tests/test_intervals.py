"""Interval texts: the plain parser, and the native expression against it."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.functions.intervals import UNITS, IntervalError, interval_micros, parse_interval

GOOD = {
    "interval '3 hours'": 10800, 'interval "20 minutes"': 1200, "'2 days'::interval": 172800, "make_interval(weeks => 1, hours => 2, secs => 2.5)": 7 * 86400 + 7202.5, "make_interval(years => 2, months => 1)": 2 * 31536000 + 2592000,
    "make_interval(days => 5, mins => 6)": 432360, "PT9M": 540, "'P2DT1H'::interval": 176400, "-2 days 3 hours": -183600, "2 days -3 hours": 162000, "0.25 hours": 900, "7 milliseconds": 0.007, "P1Y1DT0.5S": 31536000 + 86400.5,
}
BAD = ["", "make_interval", "make_interval()", "make_interval(moons => 1)", "12", "days", "4 fortnightly", "P", "PT", "interval 3", "'soon'::interval"]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert parse_interval(text) == round(GOOD[text] * 1e6)


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(IntervalError):
        parse_interval(text)


@given(st.lists(st.tuples(st.integers(0, 99), st.sampled_from(sorted(UNITS))), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_sum_of_parts(parts):
    text = " ".join(f"{n} {u}" for n, u in parts)
    assert parse_interval(text) == sum(n * UNITS[u] for n, u in parts) == parse_interval(f"'{text}'::interval")


def test_native_expression_agrees(spark):
    texts = [*GOOD, *BAD, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", interval_micros(df["t"]).alias("v")).collect()}
    for t in texts:
        try:
            want = parse_interval(t) if t is not None else None
        except IntervalError:
            want = None
        assert got[t] == want, t
