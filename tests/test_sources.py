"""File sources: flight CSV coercion, schedule file rules, missing paths."""

import csv
import os

import pytest
from pyspark.errors import AnalysisException

from tarmac.operators.events import event_dimension
from tarmac.schema import SCHEDULE_COLUMNS
from tarmac.sources import read_flights_csv, read_schedule_csv
from tarmac.sources.flights import column_profile, read_flights_parquet

SCHEDULE_HEADER = SCHEDULE_COLUMNS


def schedule_row(**cells):
    return [cells.get(c.replace(" ", "_").lower(), "0") for c in SCHEDULE_HEADER]


def test_schedule_fixes_and_dates(spark, tmp_dir):
    """Border airports are moved to the city's own, and labels start with the date."""
    path = os.path.join(tmp_dir, "schedule.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(SCHEDULE_HEADER)
        w.writerow(schedule_row(league="MLS", team_name="Rovers", primary_airport="PBG", date="Sat,2023-07-15"))
        w.writerow(schedule_row(league="CFL", team_name="Harbour", primary_airport="IAG", date="Thu,2023-10-05"))
    dim = {(str(r["event_date"]), r["airport"]): r["event_name"]
           for r in event_dimension(read_schedule_csv(spark, path)).collect()}
    assert {k: v[:10] for k, v in dim.items()} == {
        ("2023-07-15", "YUL"): "2023-07-15", ("2023-10-05", "YYZ"): "2023-10-05"}


def test_schedule_missing_file_or_columns(spark, tmp_dir):
    assert read_schedule_csv(spark, os.path.join(tmp_dir, "nope.csv")).count() == 0
    path = os.path.join(tmp_dir, "nodate.csv")
    with open(path, "w") as f:
        f.write("League,Primary Airport\nNFL,ATL\n")
    assert read_schedule_csv(spark, path).count() == 0


def test_schedule_ragged_row_goes_to_rejects(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ragged.csv")
    with open(path, "w") as f:
        f.write(",".join(SCHEDULE_HEADER) + "\n")
        f.write("NFL,Team A,Stadium A,0,0,AAA,0,0,1.0,Mon,2024-01-01,Team A,Team B\n")
        f.write('NFL,Team A,Stadium A,0,0,BBB,0,0,1.0,"Mon,2024-01-01",Team A,Team B\n')
    good = read_schedule_csv(spark, path)
    assert [r["Primary Airport"] for r in good.collect()] == ["BBB"]
    assert read_schedule_csv(spark, path, keep_rejects=True).count() == 1


def test_flight_csv_coercion(spark, tmp_dir):
    path = os.path.join(tmp_dir, "flights.csv")
    with open(path, "w") as f:
        f.write("fl_date,origin,dest,crs_dep_time,arr_delay,cancelled,diverted,weather_delay\n")
        f.write("2024-01-01,AAA,BBB,1252,20,0,0,NA\n")
        f.write("2024-01-02,AAA,BBB,1252.0,NaN,0,0,\n")
        f.write("2024-01-03,AAA,BBB,abc,abc,0,0,5\n")
    cols = ["fl_date", "origin", "crs_dep_time", "arr_delay", "weather_delay"]
    rows = read_flights_csv(spark, path, columns=cols).orderBy("fl_date").collect()
    assert [(r["crs_dep_time"], r["arr_delay"], r["weather_delay"]) for r in rows] == [
        (1252, 20.0, None), (1252, None, None), (None, None, 5.0)]
    assert read_flights_csv(spark, path, columns=cols, limit=2).count() == 2


def test_flight_csv_overflow_and_headers(spark, tmp_dir):
    one, two = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")
    with open(one, "w") as f:
        f.write("origin,dest,crs_dep_time\nAAA,BBB,99999999999\nAAA,BBB,Infinity\n")
    with open(two, "w") as f:
        f.write("dest,origin,crs_dep_time\nBBB,AAA,700\n")
    got = read_flights_csv(spark, one, columns=["origin", "crs_dep_time"]).collect()
    assert [(r["origin"], r["crs_dep_time"]) for r in got] == [("AAA", None), ("AAA", None)]
    both = read_flights_csv(spark, [one, two], columns=["origin", "dest", "distance"]).collect()
    assert [tuple(r) for r in both] == [("AAA", "BBB", None)] * 3


def test_parquet_nan_is_null(spark, tmp_dir):
    path = os.path.join(tmp_dir, "nan.parquet")
    spark.createDataFrame([("AAA", float("nan")), ("AAA", 20.0)], "origin string, arr_delay double").write.parquet(path)
    assert read_flights_parquet(spark, path).filter("arr_delay IS NULL").count() == 1


def test_missing_flight_file_raises(spark, tmp_dir):
    with pytest.raises(AnalysisException):
        read_flights_csv(spark, os.path.join(tmp_dir, "missing.csv")).count()


def test_column_profile(spark):
    df = spark.createDataFrame([(1, None), (3, "x")], "a int, b string")
    prof = {r["column_name"]: r for r in column_profile(df).collect()}
    assert prof["a"]["null_pct"] == 0.0 and prof["a"]["min_value"] == "1" and prof["a"]["max_value"] == "3"
    assert prof["b"]["null_cells"] == 1 and prof["b"]["null_pct"] == 50.0 and prof["b"]["dtype"] == "string"


def _write(path, heading, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(heading)
        w.writerows(rows)


def test_first_rows_in_file_order(spark, tmp_dir):
    """The cap takes the first n rows over files, splits and headings."""
    os.makedirs(os.path.join(tmp_dir, "b"))
    _write(os.path.join(tmp_dir, "b", "2.csv"), ["distance", "origin"], [(1000 + i, "C") for i in range(300)])
    _write(os.path.join(tmp_dir, "b", "1 x.csv"), ["origin", "distance", "junk"], [("B", i, "j") for i in range(400)])
    open(os.path.join(tmp_dir, "b", "0.csv"), "w").close()  # no heading: no rows
    _write(os.path.join(tmp_dir, "a.csv"), ["origin", "distance"], [("A", -i) for i in range(500)])
    want = [("B", i) for i in range(400)] + [("C", 1000 + i) for i in range(300)] + [("A", -i) for i in range(500)]
    paths = [os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "a.csv")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits
    try:
        for n in (0, 1, 399, 401, 700, 950, 5000):
            got = read_flights_csv(spark, paths, ["origin", "distance"], limit=n, with_position=True).repartition(3)
            rows = [(r["origin"], r["distance"]) for r in got.orderBy("_position").collect()]
            assert rows == want[:n], n
        whole = read_flights_csv(spark, paths, ["origin", "distance", "dest"], with_position=True)
        assert whole.rdd.getNumPartitions() > 5
        assert [(r["origin"], r["distance"]) for r in whole.orderBy("_position").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read_flights_csv(spark, os.path.join(tmp_dir, "b", "0.csv"), ["origin"]).count() == 0


def test_repeated_heading_is_an_error(spark, tmp_dir):
    path = os.path.join(tmp_dir, "twice.csv")
    _write(path, ["origin", "origin"], [("A", "B")])
    with pytest.raises(ValueError, match="repeated"):
        read_flights_csv(spark, path)


def test_compressed_file_heading(spark, tmp_dir):
    import gzip

    with gzip.open(os.path.join(tmp_dir, "z.csv.gz"), "wt") as f:
        f.write("dest,origin\nBBB,AAA\n")
    assert [tuple(r) for r in read_flights_csv(spark, tmp_dir, ["origin", "dest"]).collect()] == [("AAA", "BBB")]


def test_last_schedule_row_wins_across_files(spark, tmp_dir):
    head = ["Date", "Primary Airport", "League", "Team Name"]
    turned = ["Team Name", "League", "Primary Airport", "Date"]
    first = [("Sat,2024-01-06", f"A{i % 40}", "ONE", str(i)) for i in range(600)]
    second = [(f"later {i}", "TWO", f"A{i % 7}", "Sat,2024-01-06") for i in range(70)]
    _write(os.path.join(tmp_dir, "s2.csv"), turned, second)
    _write(os.path.join(tmp_dir, "s1.csv"), head, first)
    with open(os.path.join(tmp_dir, "s1.csv"), "a") as f:
        f.write("Sun,2024-01-07,A1,ONE,unquoted comma\n")
    last = {r[1]: r[3] for r in first} | {r[2]: r[0] for r in second}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = event_dimension(read_schedule_csv(spark, tmp_dir)).collect()
        back = event_dimension(read_schedule_csv(spark, [os.path.join(tmp_dir, x) for x in ("s2.csv", "s1.csv")])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 40 and all(f"@ {last[r['airport']]} (" in r["event_name"] for r in got)
    assert all("ONE" in r["event_name"] for r in back)  # the other order of paths
    assert read_schedule_csv(spark, tmp_dir, keep_rejects=True).count() == 1
