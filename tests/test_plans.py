"""Physical plan shape: pushdown, pruning, one shuffle for the report cube,
and the broadcast/shuffle choice of the event join."""

import io
import re
from contextlib import redirect_stdout

from conftest import SF_SMALL
from tarmac.operators import reports as R
from tarmac.operators.events import enrich_events
from tarmac.plans.analysis import fine_cube
from tarmac.plans.catalog import load_clean, load_enriched, load_event_dim
from tarmac.sources.testview import flights_view


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_clean_filter_pushed_and_columns_pruned(spark):
    text = plan(R.airport_delay(load_clean(spark, SF_SMALL), "origin"))
    scan = [line for line in text.splitlines() if "FileScan parquet" in line and "l_orderkey" in line][0]
    assert "DataFilters" in scan and "% 50" in scan        # cancelled rule reaches the lineitem scan
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    for unused in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"):
        assert unused not in read


def test_fine_cube_is_one_scan_and_one_aggregate_shuffle(spark):
    text = plan(fine_cube(flights_view(spark, SF_SMALL)).table)
    expand = [line for line in text.splitlines() if "Expand [" in line]
    assert len(expand) == 1 and expand[0].count("[", expand[0].index("Expand [") + 8) <= 4  # each flight twice
    assert len(re.findall(r"partial_count", text)) >= 1
    grouping_exchanges = [line for line in text.splitlines()
                          if "Exchange hashpartitioning" in line and "spark_grouping_id" in line]
    assert len(grouping_exchanges) == 1
    assert sum("FileScan" in line and "l_orderkey" in line for line in text.splitlines()) == 1


def test_event_join_broadcast_then_shuffle(spark):
    clean = load_clean(spark, SF_SMALL)
    dim = load_event_dim(spark, SF_SMALL)
    small = plan(enrich_events(clean, dim))
    assert small.count("BroadcastHashJoin") >= 4              # 3 fixture joins + 2 event lookups
    assert "LeftOuter" in small
    # Without the hint the optimizer may still broadcast from its own size
    # statistics; switch that off to see the shuffle-join fallback.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        forced = plan(enrich_events(clean, dim, max_broadcast_bytes=0))
        hinted = plan(enrich_events(clean, dim))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lookups = [line for line in forced.splitlines() if "LeftOuter" in line]
    assert len(lookups) == 2 and all("SortMergeJoin" in line or "ShuffledHashJoin" in line for line in lookups)
    assert all("BroadcastHashJoin" in line for line in hinted.splitlines() if "LeftOuter" in line)


def test_no_python_udf_in_report_plans(spark):
    for df in (R.route_delay(load_enriched(spark, SF_SMALL)), R.origin_hour_heatmap(load_clean(spark, SF_SMALL))):
        text = plan(df)
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
