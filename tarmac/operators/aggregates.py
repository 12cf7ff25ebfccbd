"""Grouped delay measures.

Every measure is algebraic (count, sum, max), so Spark aggregates partially
on the map side before the shuffle: a key holding a third of all flights
still ships one partial row per input partition, never the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import weather_flag

MEASURES = ("flights", "delayed", "delay_minutes", "weather_flights", "weather_minutes", "arr_delay_sum",
            "arr_delay_max")


def delay_measures() -> list[Column]:
    """flights, delayed flights, arrival minutes of delayed flights (NULL when
    the group has none), weather-attributed flights and their weather minutes,
    and the sum and maximum of all arrival delays."""
    delayed = F.col("is_delayed")
    weather = weather_flag()
    return [
        F.count(F.lit(1)).alias("flights"),
        F.count_if(delayed).alias("delayed"),
        F.sum(F.when(delayed, F.col("arr_delay"))).alias("delay_minutes"),
        F.count_if(weather).alias("weather_flights"),
        F.sum(F.when(weather, F.col("weather_delay"))).alias("weather_minutes"),
        F.sum("arr_delay").alias("arr_delay_sum"),
        F.max("arr_delay").alias("arr_delay_max"),
    ]


def delay_totals(clean: DataFrame, *keys: str | Column, keep_null_keys: bool = False) -> DataFrame:
    """One row per key combination with all :data:`MEASURES`.

    Rows with a NULL key are left out, as a group-by over pandas frames does,
    unless ``keep_null_keys``. The NULL filter is a plain predicate, so it is
    pushed into the scan.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    src = clean
    if not keep_null_keys:
        for c in cols:
            src = src.where(c.isNotNull())
    return src.groupBy(*cols).agg(*delay_measures())


def grouping_id_for(all_keys: list[str], group: list[str]) -> int:
    """Value of ``grouping_id()`` for ``group`` when the cube groups by
    ``all_keys``: bit set (most significant first) for each key rolled up."""
    gid = 0
    for k in all_keys:
        gid = (gid << 1) | (0 if k in group else 1)
    return gid


class DelayCube:
    """All grouped tables of the report from one scan and one shuffle.

    ``GROUPING SETS`` expands each clean row once per set inside the map
    stage, partial-aggregates, and shuffles only partial rows. A slice of the
    result for one set is a filter on ``grouping_id``.
    """

    def __init__(self, clean: DataFrame, sets: list[list[str]]):
        keys: list[str] = []
        for s in sets:
            for k in s:
                if k not in keys:
                    keys.append(k)
        self.keys = keys
        self.sets = sets
        self.table = clean.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
            *delay_measures(), F.grouping_id().alias("gid")
        )

    def slice(self, group: list[str], keep_null_keys: bool = False) -> DataFrame:
        gid = grouping_id_for(self.keys, group)
        out = self.table.where(F.col("gid") == gid)
        if not keep_null_keys:
            for k in group:
                out = out.where(F.col(k).isNotNull())
        return out.select(*group, *MEASURES)


def reaggregate(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Roll pre-aggregated measure rows up to ``keys`` (counts and sums add,
    the maximum takes the maximum)."""
    return cells.groupBy(*keys).agg(*[
        (F.max(m) if m == "arr_delay_max" else F.sum(m)).alias(m) for m in MEASURES
    ])


class CellTotals:
    """Measures held at a fine grain (for example per date, origin and
    destination, tagged with an event) and rolled up to any coarser key on
    demand; a drop-in source for the report tables like :class:`DelayCube`."""

    def __init__(self, cells: DataFrame):
        self.table = cells

    def slice(self, group: list[str], keep_null_keys: bool = False) -> DataFrame:
        src = self.table
        if not keep_null_keys:
            for k in group:
                src = src.where(F.col(k).isNotNull())
        return reaggregate(src, group).select(*group, *MEASURES)


class RolledCube:
    """Coarse sets of several fine tables of measures, each set rolled up from
    the table it belongs to; a source for the report tables like
    :class:`DelayCube`. ``parts`` lists fine tables with their coarse sets."""

    def __init__(self, parts: list[tuple[DataFrame, list[list[str]]]]):
        self.cubes = []
        for cells, sets in parts:
            keys = list(dict.fromkeys(k for s in sets for k in s))
            table = cells.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
                *[(F.max(m) if m == "arr_delay_max" else F.sum(m)).alias(m) for m in MEASURES], F.grouping_id().alias("gid"))
            self.cubes.append((keys, sets, table))

    def checkpoint(self) -> "RolledCube":
        """Write every rolled-up table to the shared checkpoint folder."""
        self.cubes = [(keys, sets, table.checkpoint(eager=True)) for keys, sets, table in self.cubes]
        return self

    @property
    def table(self) -> DataFrame:
        return self.cubes[0][2]

    def slice(self, group: list[str], keep_null_keys: bool = False) -> DataFrame:
        keys, table = next((keys, table) for keys, sets, table in self.cubes if group in sets)
        out = table.where(F.col("gid") == grouping_id_for(keys, group))
        if not keep_null_keys:
            for k in group:
                out = out.where(F.col(k).isNotNull())
        return out.select(*group, *MEASURES)
