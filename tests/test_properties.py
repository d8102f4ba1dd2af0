"""Property checks: ranks vs brute force, disjoint windows, shares."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from upswell.config import EmergenceConfig
from upswell.functions.dates import Windows
from upswell.functions.growth import value_range, with_global_rank
from upswell.operators.report import region_top


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=6), min_size=1, max_size=12))
def test_rank_min_method_matches_brute_force(spark, volumes):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(volumes)], "k int, current_volume long")
    for method in ("window", "histogram", "ranges"):
        got = {r.k: r.rank_current for r in with_global_rank(df, "current_volume", "rank_current",
                                                             method=method).collect()}
        want = {i: 1 + sum(1 for w in volumes if w > v) for i, v in enumerate(volumes)}
        assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2**40) | st.integers(min_value=1020, max_value=1030) | st.sampled_from([2047, 2048, 2049, 2**62]),
                min_size=1, max_size=40))
def test_ranks_by_ranges_match_brute_force(spark, volumes):
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(volumes)], "k int, g int, current_volume long")
    got = {r.k: r.r for r in with_global_rank(df, "current_volume", "r", ["g"], "ranges").collect()}
    assert got == {i: 1 + sum(1 for j, w in enumerate(volumes) if w > v and j % 2 == i % 2) for i, v in enumerate(volumes)}


def test_value_ranges_keep_the_order(spark):
    values = sorted({2**k + d for k in range(62) for d in (-1, 0, 1, 2**k // 3)} - {-1})
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", value_range(F.col("v")).alias("r")).orderBy("v").collect()
    ranges = [r.r for r in got]
    assert ranges == sorted(ranges) and max(ranges) < 2**18
    assert all(b.r > a.r or b.v - a.v <= max(a.v >> 9, 0) for a, b in zip(got, got[1:]))


def test_windows_are_disjoint_and_contiguous(spark):
    w = Windows.from_config(dt.datetime(2024, 6, 1), EmergenceConfig())
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i) for i in range(4 * 200)]
    df = spark.createDataFrame([(d,) for d in days], "date_received timestamp")
    c, p, b = w.flags(F.col("date_received"))
    r = df.select((c.cast("int") + p.cast("int") + b.cast("int")).alias("n"),
                  w.span(F.col("date_received")).cast("int").alias("s")).collect()
    assert all(x.n <= 1 for x in r) and all(x.n == x.s for x in r)


def test_region_share_is_over_rows_shown(spark):
    rows = [(f"S{i:02d}",) for i in range(25) for _ in range(25 - i)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "state string")
    top = region_top(df, 20).collect()
    assert len(top) == 20 and top[0].state == "S00" and top[0].complaints == 25
    shown = sum(r.complaints for r in top)
    assert abs(sum(r.share_of_shown for r in top) - 100) < 0.5
    assert top[0].share_of_shown == round(25 / shown * 100, 1)
    assert all(r.state != "Unknown" or r.complaints == 3 for r in top)
