"""The one-pass report (GROUPING SETS cube) equals the per-table queries."""

import pytest

from conftest import SF_SMALL
from oracle_util import _rows
from tarmac.plans.analysis import delay_report
from tarmac.plans.catalog import report_queries
from tarmac.sources.testview import flights_view, schedule_view


@pytest.fixture(scope="module")
def report(spark):
    return delay_report(flights_view(spark, SF_SMALL), schedule_view(spark, SF_SMALL), min_airport_flights=1000)


def test_report_has_all_report_keys(report):
    expected = set(report_queries()) - {"clean_flights", "event_dim", "event_enriched", "class_balance",
                                        "column_profile"}
    assert expected <= set(report)


@pytest.mark.parametrize("name", sorted(set(report_queries()) - {"clean_flights", "event_dim", "event_enriched",
                                                                  "class_balance", "column_profile"}))
def test_cube_table_equals_query(spark, report, name):
    direct = report_queries()[name](spark, SF_SMALL)
    cubed = report[name]
    assert sorted(direct.columns) == sorted(cubed.columns)
    a = _rows(direct.columns, [tuple(r) for r in direct.collect()])
    b = _rows(cubed.columns, [tuple(r) for r in cubed.collect()])
    assert a == b


def test_group_sums_equal_clean_rows(report):
    clean = report["overview"].first()["processed_rows"]
    for name, key in [("month_rate", "month"), ("weekday_rate", "day_of_week"), ("origin_delay", "origin"),
                      ("hour_rate_with_unknown", "dep_hour"), ("route_delay", "route")]:
        total = sum(r["flights"] for r in report[name].collect())
        assert total == clean, name
        assert all(r["delayed"] <= r["flights"] for r in report[name].collect())
