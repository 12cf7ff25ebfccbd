"""Result sink: each named table to its own parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> list[str]:
    """Write every table to ``out_dir/<name>``; returns the written paths.

    Tables keep their partitioning (AQE already coalesces small shuffle
    outputs), so row-level tables are written in parallel.
    """
    written = []
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(path)
        written.append(path)
    return written
