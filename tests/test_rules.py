"""Hand-made rows for the rules the reference leaves untested (FIXTURES A4)."""

from pyspark.sql import functions as F

from helpers import flights
from tarmac.operators import reports as R
from tarmac.operators.clean import clean_flights
from tarmac.operators.events import enrich_events, event_dimension


def test_clean_filter_and_threshold(spark):
    df = flights(spark, [
        {"arr_delay": 30, "cancelled": 1},
        {"arr_delay": 30, "diverted": 1},
        {"arr_delay": None},
        {"arr_delay": 14},
        {"arr_delay": 15},
    ])
    rows = clean_flights(df).select("arr_delay", "is_delayed").orderBy("arr_delay").collect()
    assert [(r["arr_delay"], r["is_delayed"]) for r in rows] == [(14.0, False), (15.0, True)]


def test_reason_priority(spark):
    df = flights(spark, [
        {"arr_delay": 40, "weather_delay": 10, "nas_delay": 20},          # two causes: column order
        {"arr_delay": 40, "carrier_delay": 0, "late_aircraft_delay": 5},
        {"arr_delay": 40},                                               # none
        {"arr_delay": 40, "carrier_delay": None, "security_delay": 3},   # null cause ignored
    ])
    got = [r["reason"] for r in clean_flights(df).collect()]
    assert got == ["weather_delay", "late_aircraft_delay", "unknown", "security_delay"]


def test_weather_counts_regardless_of_delay(spark):
    df = flights(spark, [
        {"origin": "AAA", "arr_delay": 5, "weather_delay": 3},
        {"origin": "AAA", "arr_delay": 30, "weather_delay": None},
        {"origin": "AAA", "arr_delay": 30, "weather_delay": 12},
    ])
    w = R.weather_by_airport(clean_flights(df), "origin").first()
    assert (w["flights_total"], w["weather_delayed"], w["weather_minutes"]) == (3, 2, 15.0)
    ov = R.overview(df).first()
    assert ov["weather_delayed"] == 2 and ov["weather_share_pct"] == 100.0


def test_hours_and_null_rates(spark):
    df = flights(spark, [
        {"crs_dep_time": None, "arr_delay": 20, "month": 1},
        {"crs_dep_time": 5, "arr_delay": 0, "month": 1},
        {"crs_dep_time": 2400, "arr_delay": 0, "month": 2},
    ])
    clean = clean_flights(df)
    assert sorted(r["dep_hour"] for r in R.hour_rate(clean).collect()) == [0, 24]
    with_unknown = {r["dep_hour"]: r["delay_rate_pct"] for r in
                    R.hour_rate(clean_flights(df, null_hour=-1), with_unknown=True).collect()}
    assert with_unknown == {-1: 100.0, 0: None, 24: None}
    months = {r["month"]: r["delay_rate_pct"] for r in R.month_rate(clean).collect()}
    assert months == {1: 50.0, 2: None}
    # Tables that fill missing counts with 0 give a 0 rate instead.
    route = R.route_delay(clean_flights(flights(spark, [{"origin": "A", "dest": "B", "arr_delay": 1}]))).first()
    assert route["delay_rate_pct"] == 0.0 and route["avg_delay_minutes_delayed"] is None


def test_airport_rate_null_sorts_last(spark):
    df = flights(spark, [{"origin": "AAA", "arr_delay": 0}] * 3 + [{"origin": "BBB", "arr_delay": 20}] * 3
                 + [{"origin": "CCC", "arr_delay": 20}, {"origin": "CCC", "arr_delay": 0}, {"origin": "CCC"}])
    rows = R.airport_rate(clean_flights(df), "origin", min_flights=2, top_n=10).collect()
    assert [r["origin"] for r in rows] == ["BBB", "CCC", "AAA"]
    assert rows[-1]["delayed"] is None and rows[-1]["delay_rate_pct"] is None


def _schedule(spark, rows):
    cols = ["seq", "League", "Team Name", "Stadium Name", "Primary Airport", "Date", "Away Team"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'seq' else 'string'}" for c in cols))


def test_event_dimension_rules(spark):
    sched = _schedule(spark, [
        (1, "NFL", "Team A", "S1", " pbg ", "Sat,2024-01-06", "Team B"),
        (2, "NHL", "Team C", "S2", "IAG", "2024-01-07", "Team D"),
        (3, "NBA", "Team E", "S3", "ATL", "bad date", "Team F"),
        (4, "MLB", "Team G", "S4", "ATL", "Mon,2024-01-08", "Team H"),
        (5, "MLB", "Team I", "S5", "ATL", "Mon,2024-01-08", "Team J"),
    ])
    dim = {(str(r["event_date"]), r["airport"]): r["event_name"] for r in event_dimension(sched).collect()}
    assert set(dim) == {("2024-01-06", "YUL"), ("2024-01-07", "YYZ"), ("2024-01-08", "ATL")}
    assert dim[("2024-01-06", "YUL")] == "2024-01-06 | NFL: Team B @ Team A (S1 / YUL)"
    assert "Team J" in dim[("2024-01-08", "ATL")]  # last row wins


def test_event_origin_before_dest(spark):
    sched = _schedule(spark, [
        (1, "NFL", "H1", "S", "AAA", "Mon,2024-01-01", "A1"),
        (2, "NFL", "H2", "S", "BBB", "Mon,2024-01-01", "A2"),
    ])
    df = flights(spark, [
        {"fl_date": "2024-01-01", "origin": "AAA", "dest": "BBB", "arr_delay": 1},
        {"fl_date": "2024-01-01", "origin": "CCC", "dest": "BBB", "arr_delay": 1},
        {"fl_date": "2024-01-02", "origin": "AAA", "dest": "BBB", "arr_delay": 1},
    ])
    out = enrich_events(clean_flights(df), event_dimension(sched)).select("origin", "fl_date", "event_name").collect()
    names = sorted((r["origin"], str(r["fl_date"]), r["event_name"][-4:]) for r in out)
    assert names == [("AAA", "2024-01-01", "AAA)"), ("AAA", "2024-01-02", "none"), ("CCC", "2024-01-01", "BBB)")]


def test_report_tables_by_hand(spark):
    """Four flights whose tables are worked out by hand."""
    df = flights(spark, [
        {"fl_date": "2023-05-06", "origin": "DDD", "dest": "EEE", "op_unique_carrier": "PP", "crs_dep_time": 615,
         "arr_delay": 45, "month": 5, "day_of_week": 6, "weather_delay": 12},
        {"fl_date": "2023-05-06", "origin": "EEE", "dest": "FFF", "op_unique_carrier": "QQ", "crs_dep_time": 1740,
         "arr_delay": 3, "month": 5, "day_of_week": 6},
        {"fl_date": "2023-09-12", "origin": "DDD", "dest": "FFF", "op_unique_carrier": "PP", "crs_dep_time": 640,
         "arr_delay": 14, "month": 9, "day_of_week": 2},
        {"fl_date": "2023-09-12", "origin": "DDD", "dest": "EEE", "op_unique_carrier": "QQ", "crs_dep_time": 2200,
         "arr_delay": 90, "month": 9, "day_of_week": 2, "weather_delay": 60},
    ])
    clean = clean_flights(df, null_hour=-1)
    assert {r["month"]: r["delay_rate_pct"] for r in R.month_rate(clean).collect()} == {5: 50.0, 9: 50.0}
    assert {r["day_of_week"]: r["delay_rate_pct"] for r in R.weekday_rate(clean).collect()} == {6: 50.0, 2: 50.0}
    w = R.weather_top(clean, "origin").collect()
    assert [(r["origin"], r["weather_delayed"], r["weather_minutes"]) for r in w] == [("DDD", 2, 72.0)]
    sched = _schedule(spark, [(1, "MLS", "Rovers", "Field", "EEE", "Sat,2023-05-06", "Harbour")])
    ev = {r["event_name"]: r["flights"] for r in
          R.event_delay(enrich_events(clean, event_dimension(sched))).collect()}
    assert sorted(ev.values()) == [2, 2] and ev["none"] == 2
    rates = {r["op_unique_carrier"]: (r["delay_rate_pct"], r["total_flights"]) for r in R.carrier_rate(clean).collect()}
    assert rates == {"PP": (50.0, 4), "QQ": (50.0, 4)}


def test_month_extremes_first_on_ties(spark):
    df = flights(spark, [{"month": m, "arr_delay": d} for m, d in
                         [(1, 20), (1, 0), (2, 20), (2, 0), (3, 0), (4, 20)]])
    rows = {r["month"]: (r["is_max_rate"], r["is_min_rate"]) for r in
            R.month_extremes(clean_flights(df)).collect()}
    assert rows == {1: (False, True), 2: (False, False), 3: (False, False), 4: (True, False)}
