"""Streaming totals over a folder of flight files equal the batch tables."""

import os

from conftest import SF_SMALL
from oracle_util import _rows
from tarmac.operators.aggregates import delay_totals
from tarmac.plans.catalog import load_clean, load_event_dim
from tarmac.sources.testview import flights_view
from tarmac.streaming import read_flight_stream, read_totals, start_totals, streaming_totals


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    flights = flights_view(spark, SF_SMALL)
    flights.repartition(3).write.parquet(src)
    stream = read_flight_stream(spark, src, schema=flights.schema)
    for keys in (["origin"], ["month"]):
        sink = os.path.join(tmp_dir, "out_" + keys[0])
        q = start_totals(streaming_totals(stream, keys), sink, os.path.join(tmp_dir, "ck_" + keys[0]))
        q.awaitTermination(300)
        got = read_totals(spark, sink).select(*keys, "flights", "delayed")
        want = delay_totals(load_clean(spark, SF_SMALL), *keys).select(*keys, "flights", "delayed")
        assert _rows(got.columns, [tuple(r) for r in got.collect()]) == \
            _rows(want.columns, [tuple(r) for r in want.collect()])


def test_stream_static_event_join(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in2")
    flights = flights_view(spark, "/root/testdata/sf0.01")
    flights.repartition(2).write.parquet(src)
    stream = read_flight_stream(spark, src, schema=flights.schema)
    dim = load_event_dim(spark, "/root/testdata/sf0.01")
    sink = os.path.join(tmp_dir, "ev")
    q = start_totals(streaming_totals(stream, ["event_name"], dimension=dim), sink, os.path.join(tmp_dir, "ck_ev"))
    q.awaitTermination(300)
    got = {r["event_name"]: r["flights"] for r in read_totals(spark, sink).collect()}
    assert sum(v for k, v in got.items() if k != "none") == 20866


def test_restart_reads_only_new_files(spark, tmp_dir):
    """A second availableNow run resumes from the checkpoint: totals then
    cover both files, and the first file is not counted twice."""
    from pyspark.sql import functions as F

    src = os.path.join(tmp_dir, "inc")
    flights = flights_view(spark, SF_SMALL)
    first = flights.where(F.col("month") <= 6)
    second = flights.where(F.col("month") > 6)
    first.write.parquet(os.path.join(src, "part1"))
    sink, ck = os.path.join(tmp_dir, "inc_out"), os.path.join(tmp_dir, "inc_ck")

    def run():
        stream = read_flight_stream(spark, os.path.join(src, "*"), schema=flights.schema)
        start_totals(streaming_totals(stream, ["month"]), sink, ck).awaitTermination(300)
        return {r["month"]: r["flights"] for r in read_totals(spark, sink).collect()}

    after_first = run()
    assert set(after_first) <= set(range(1, 7))
    second.write.parquet(os.path.join(src, "part2"))
    after_second = run()
    want = {r["month"]: r["flights"] for r in delay_totals(load_clean(spark, SF_SMALL), "month").collect()}
    assert after_second == want
