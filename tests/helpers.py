"""Small hand-made flight tables for rule tests."""

import datetime as dt

from tarmac.schema import FLIGHT_SCHEMA


def flights(spark, rows):
    """Rows given as dicts; unspecified columns are NULL, cancelled/diverted 0."""
    names = [f.name for f in FLIGHT_SCHEMA.fields]
    full = []
    for r in rows:
        r = {"cancelled": 0, "diverted": 0, **r}
        if isinstance(r.get("fl_date"), str):
            r["fl_date"] = dt.date.fromisoformat(r["fl_date"])
        for k in ("arr_delay", "distance", "carrier_delay", "weather_delay", "nas_delay", "security_delay",
                  "late_aircraft_delay", "op_carrier_fl_num", "crs_elapsed_time"):
            if r.get(k) is not None:
                r[k] = float(r[k])
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, FLIGHT_SCHEMA)
