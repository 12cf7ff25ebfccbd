"""The event enrichment gives the same rows whether the dimension is
broadcast or joined by shuffle (size check failed), also when one
(date, airport) key carries a third of all flights."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import flights
from oracle_util import _rows
from tarmac.operators.clean import clean_flights
from tarmac.operators.events import enrich_events, event_dimension
from tarmac.operators.joins import broadcast_if_small, stored
from tarmac.plans.catalog import load_clean, load_event_dim


def _same(a, b):
    return _rows(a.columns, [tuple(r) for r in a.collect()]) == _rows(b.columns, [tuple(r) for r in b.collect()])


def test_broadcast_by_written_bytes(spark):
    df = spark.range(10)
    table, size = stored(df, "dimension")
    assert size > 0 and sorted(r["id"] for r in table.collect()) == list(range(10))
    assert not broadcast_if_small(df, size - 1)[1] and broadcast_if_small(df, size * 2)[1]


def test_fallback_equals_broadcast(spark):
    clean = load_clean(spark, SF_SMALL)
    dim = load_event_dim(spark, SF_SMALL)
    assert _same(enrich_events(clean, dim), enrich_events(clean, dim, max_broadcast_bytes=0))


def test_hot_key_shuffle_join(spark):
    hot = [{"fl_date": "2024-01-01", "origin": "HOT", "dest": "X", "arr_delay": 20}] * 400
    rest = [{"fl_date": "2024-01-0%d" % (1 + i % 9), "origin": "A%d" % (i % 7), "dest": "HOT", "arr_delay": i % 30}
            for i in range(800)]
    df = clean_flights(flights(spark, hot + rest))
    sched = spark.createDataFrame(
        [(1, "NFL", "H", "S", "HOT", "Mon,2024-01-01", "A"), (2, "NFL", "H2", "S", "HOT", "Tue,2024-01-02", "B")],
        "seq long, `League` string, `Team Name` string, `Stadium Name` string, `Primary Airport` string, "
        "`Date` string, `Away Team` string")
    dim = event_dimension(sched)
    a = enrich_events(df, dim)
    b = enrich_events(df, dim, max_broadcast_bytes=0)
    assert _same(a, b)
    counts = {r["event_name"][:10]: r["n"] for r in b.groupBy("event_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    # 400 hot-origin flights + flights arriving at HOT on the two event days.
    assert counts["2024-01-01"] == 400 + sum(1 for i in range(800) if i % 9 == 0)
    assert counts["2024-01-02"] == sum(1 for i in range(800) if i % 9 == 1)


def test_event_cells_equal_row_level_with_nulls(spark):
    """Rolling up (date, origin, dest) cells gives the same event tables as
    tagging every flight, also with NULL dates and airports."""
    from tarmac.operators import reports as R

    rows = [
        {"fl_date": "2024-01-01", "origin": "HOT", "dest": "X", "arr_delay": 20, "weather_delay": 4},
        {"fl_date": "2024-01-01", "origin": None, "dest": "HOT", "arr_delay": 30},
        {"fl_date": "2024-01-01", "origin": "A", "dest": None, "arr_delay": 1},
        {"fl_date": None, "origin": "HOT", "dest": "HOT", "arr_delay": 50},
        {"fl_date": "2024-01-02", "origin": "A", "dest": "HOT", "arr_delay": 16},
        {"fl_date": "2024-01-02", "origin": "A", "dest": "HOT", "arr_delay": 2},
    ]
    df = clean_flights(flights(spark, rows))
    sched = spark.createDataFrame(
        [(1, "NFL", "H", "S", "HOT", "Mon,2024-01-01", "A"), (2, "NFL", "H2", "S", "HOT", "Tue,2024-01-02", "B")],
        "seq long, `League` string, `Team Name` string, `Stadium Name` string, `Primary Airport` string, "
        "`Date` string, `Away Team` string")
    dim = event_dimension(sched)
    cells = R.event_cells(df, dim)
    rowlevel = enrich_events(df, dim)
    for fn in (R.event_delay, R.event_origin_delay, R.event_top):
        assert _same(fn(cells), fn(rowlevel)), fn.__name__


def test_null_keys_are_spread_in_the_shuffle_join(spark):
    """Flights without a date or an airport match nothing and do not meet in
    one partition."""
    rows = [{"fl_date": None, "origin": "HOT", "dest": "HOT", "arr_delay": i} for i in range(200)]
    rows += [{"fl_date": "2024-01-01", "origin": None, "dest": "HOT", "arr_delay": 500 + i} for i in range(200)]
    df = clean_flights(flights(spark, rows))
    dim = spark.sql("SELECT DATE'2024-01-01' AS event_date, 'HOT' AS airport, 'game' AS event_name "
                    "UNION ALL SELECT DATE'2024-01-01', NULL, 'lost'")
    out = enrich_events(df, dim, max_broadcast_bytes=0)
    assert _same(enrich_events(df, dim), out)
    assert {r[0]: r[1] for r in out.groupBy("event_name").count().collect()} == {"none": 200, "game": 200}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") >= 2
