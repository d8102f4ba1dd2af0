"""Types found from the texts of a CSV, and daily sketches that merge."""

import datetime as dt

from pyspark.sql import functions as F

from upswell.config import EmergenceConfig
from upswell.functions.dates import Windows
from upswell.operators.emerging import emerging_summary
from upswell.operators.windows import daily_sketches, volumes_from_sketches
from upswell.sources.files import infer_types, read_complaints_csv

COLUMNS = {
    "flag": (["true", "FALSE", None], "boolean"),
    "n": (["1", "-20", "9223372036854775807"], "bigint"),
    "big": (["1", "9223372036854775808", "3"], "double"),
    "x": (["1", "2.5", "-1e-3"], "double"),
    "zip": (["01234", "56789", "1"], "string"),
    "day": (["2024-01-05", None, "2023-12-31"], "date"),
    "no_day": (["2024-01-05", "2024-02-30", None], "string"),
    "at": (["2024-01-05 10:00:00", "2024-01-05", "2024-01-05T10:00:00.123Z"], "timestamp"),
    "mixed": (["1", "true", "2024-01-05"], "string"),
    "none": ([None, None, None], "string"),
    "a.b": (["1", "2", "3"], "bigint"),
}


def test_types_of_all_texts(spark):
    rows = list(zip(*[v for v, _ in COLUMNS.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLUMNS))
    assert infer_types(df) == {c: kind for c, (_, kind) in COLUMNS.items()}
    assert set(infer_types(df.limit(0)).values()) == {"string"} and infer_types(df.select(F.lit(1).alias("k"))) == {}


def test_one_odd_text_among_many_rows_decides(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 19_999, "x").otherwise(F.col("id").cast("string")).alias("n"))
    assert infer_types(df) == {"n": "string"} and infer_types(df.where("n <> 'x'")) == {"n": "bigint"}


def test_csv_comes_back_typed(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("Complaint ID,Date received,Amount,Consumer complaint narrative\n"
                '1,2024-01-05,2.50,"two\nlines, ""quoted"""\n2,2024-01-06,NA,\n')
    df = read_complaints_csv(spark, path, types=True)
    assert dict(df.dtypes) == {"complaint_id": "bigint", "date_received": "date", "amount": "double", "consumer_complaint_narrative": "string"}
    assert [tuple(r) for r in df.orderBy("complaint_id").collect()] == [
        (1, dt.date(2024, 1, 5), 2.5, 'two\nlines, "quoted"'), (2, dt.date(2024, 1, 6), None, None)]


def test_sketches_of_days_merge_into_windows(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.range(60_000).select(
        (F.lit(start).cast("timestamp") + F.make_interval(days=(F.col("id") % 30).cast("int"))).alias("date_received"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.floor(F.col("id") / 30) % 2).cast("string")).alias("k"), (F.col("id") % 9001).alias("user"))
    w = Windows.ending_at(start + dt.timedelta(days=30), 10, 10, 10)
    daily = daily_sketches(df, ["k"], "user")
    assert daily.count() == 90
    like = df.schema["date_received"].dataType
    for r in volumes_from_sketches(daily, ["k"], w).collect():
        for name, flag in zip(("current", "prior", "baseline"), w.flags(F.col("date_received"), like)):
            rows = df.where(flag & F.col("k").eqNullSafe(F.lit(r.k)))
            exact = rows.select("user").distinct().count()
            assert r[f"{name}_volume"] == rows.count() and abs(r[f"{name}_distinct"] - exact) <= 0.03 * exact


def test_sketches_without_items_or_days(spark):
    rows = [(dt.datetime(2024, 1, 20), "a", None), (dt.datetime(2024, 1, 5), "b", "x"), (None, "c", "x")]
    df = spark.createDataFrame(rows, "date_received timestamp, k string, user string")
    w = Windows.ending_at(dt.datetime(2024, 1, 31), 15, 30)
    got = {r.k: (r.current_volume, r.current_distinct, r.prior_volume, r.prior_distinct) for r in volumes_from_sketches(daily_sketches(df, ["k"], "user"), ["k"], w).collect()}
    assert got == {"a": (1, 0, 0, 0), "b": (0, 0, 1, 1)}
    assert volumes_from_sketches(daily_sketches(df.limit(0), ["k"], "user"), ["k"], w).count() == 0


def test_states_may_be_estimated(spark):
    rows = [(dt.datetime(2024, 1, 1 + i % 28), "P", "I", f"S{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "date_received timestamp, product string, issue string, state string")
    exact, near = (emerging_summary(df, EmergenceConfig(distinct_states_rsd=r)).first() for r in (None, 0.01))
    assert exact.distinct_states == 40 and abs(near.distinct_states - 40) <= 1
