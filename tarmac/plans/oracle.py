"""DuckDB SQL that computes each catalog table independently of Spark.

Every statement starts from the driver's raw tables (``lineitem orders
customer supplier``) through the fixture CTEs of FIXTURES.md part B, so the
oracle shares no code path with the Spark plans.
"""

from __future__ import annotations

from tarmac.schema import (
    AIRPORT_NAMES,
    CARRIER_NAMES,
    CARRIER_SHORT_NAMES,
    DELAY_REASON_NAMES,
    WEEKDAY_NAMES,
)
from tarmac.sources.testview import AIRPORT_CODES, CARRIER_CODES, LEAGUES


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def name_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {col} {whens} END, {col})"


def weekday_case(col: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in WEEKDAY_NAMES.items())
    return f"CASE {col} {whens} END"


CODES = _list(AIRPORT_CODES)

FLIGHTS_CTE = f"""
fx_base AS (
 SELECT l.*, CAST(l_shipdate AS DATE) fl_date, s_nationkey sn, c_nationkey cn,
  CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 2400
       ELSE ((l_partkey*5 + l_linenumber) % 24)*100 + CAST(l_quantity AS INT) END crs_dep_time,
  (((l_orderkey*7 + l_partkey) % 61) * ((l_suppkey*17 + l_orderkey) % 61)) // 36 - 32 raw
 FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
  JOIN supplier s ON l_suppkey = s_suppkey),
fx_d AS (
 SELECT *, CASE WHEN l_partkey % 61 = 0 THEN NULL WHEN crs_dep_time = 2400 THEN -5
  WHEN sn = 24 THEN least(raw, 10) ELSE raw + coalesce(crs_dep_time // 100, 0) END ad FROM fx_base),
flights AS (
 SELECT CAST(year(fl_date) AS INT) AS year, CAST(month(fl_date) AS INT) AS month,
  CAST(day(fl_date) AS INT) day_of_month, CAST(isodow(fl_date) AS INT) day_of_week, fl_date,
  ({_list(CARRIER_CODES)})[CAST(l_suppkey % 17 AS INT) + 1] op_unique_carrier,
  CAST(l_partkey AS DOUBLE) op_carrier_fl_num,
  ({CODES})[CAST(sn AS INT) + 1] origin,
  CASE WHEN l_partkey % 59 = 0 THEN NULL ELSE concat('State ', CAST(sn AS VARCHAR)) END origin_state_nm,
  ({CODES})[CAST(cn AS INT) + 1] dest, concat('State ', CAST(cn AS VARCHAR)) dest_state_nm,
  CAST(crs_dep_time AS INT) crs_dep_time, CAST((coalesce(crs_dep_time, 0) + 200) % 2400 AS INT) crs_arr_time,
  CAST(ad AS DOUBLE) arr_delay,
  CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END cancelled,
  CASE WHEN l_partkey % 75 = 0 THEN 1 ELSE 0 END diverted,
  CAST(30 + (100 + (sn*25 + cn)*4) // 8 AS DOUBLE) crs_elapsed_time,
  CAST(100 + (sn*25 + cn)*4 AS DOUBLE) distance,
  CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 0 THEN ad WHEN ad >= 15 AND l_partkey % 7 = 5 THEN ad - 5
       ELSE 0 END AS DOUBLE) carrier_delay,
  CAST(CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN ad >= 15 AND l_partkey % 7 = 1 THEN ad
       WHEN ad >= 15 AND l_partkey % 7 = 5 THEN 5 WHEN ad < 15 AND l_partkey % 41 = 0 THEN 3
       ELSE 0 END AS DOUBLE) weather_delay,
  CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 2 THEN ad ELSE 0 END AS DOUBLE) nas_delay,
  CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 3 THEN ad ELSE 0 END AS DOUBLE) security_delay,
  CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 4 THEN ad ELSE 0 END AS DOUBLE) late_aircraft_delay
 FROM fx_d)"""

SCHEDULE_CTE = f"""
schedule AS (
 SELECT o_orderkey seq, ({_list(LEAGUES)})[CAST(o_orderkey % 4 AS INT) + 1] AS "League",
  concat('Team ', CAST(o_custkey % 30 AS VARCHAR)) AS "Team Name",
  concat('Stadium ', CAST(c_nationkey AS VARCHAR)) AS "Stadium Name",
  CASE WHEN c_nationkey = 0 THEN 'PBG' WHEN c_nationkey = 1 THEN ' iag '
       ELSE ({CODES})[CAST(c_nationkey AS INT) + 1] END AS "Primary Airport",
  CASE WHEN o_orderkey % 35 = 0 THEN 'bad date' ELSE strftime(o_orderdate, '%a,%Y-%m-%d') END AS "Date",
  concat('Team ', CAST(o_custkey % 29 AS VARCHAR)) AS "Away Team"
 FROM orders JOIN customer ON o_custkey = c_custkey),
event_dim AS (
 SELECT event_date, airport, max_by(event_name, seq) event_name FROM (
  SELECT seq, event_date, airport,
   concat(CAST(event_date AS VARCHAR), ' | ', "League", ': ', "Away Team", ' @ ', "Team Name", ' (',
          "Stadium Name", ' / ', airport, ')') event_name
  FROM (SELECT *, try_cast(CASE WHEN contains("Date", ',') THEN substr("Date", strpos("Date", ',') + 1)
                                ELSE "Date" END AS DATE) event_date,
               CASE upper(trim("Primary Airport")) WHEN 'PBG' THEN 'YUL' WHEN 'IAG' THEN 'YYZ'
                    ELSE upper(trim("Primary Airport")) END airport FROM schedule)
  WHERE event_date IS NOT NULL) GROUP BY event_date, airport)"""

REASON_CASE = """CASE WHEN carrier_delay > 0 THEN 'carrier_delay' WHEN weather_delay > 0 THEN 'weather_delay'
  WHEN nas_delay > 0 THEN 'nas_delay' WHEN security_delay > 0 THEN 'security_delay'
  WHEN late_aircraft_delay > 0 THEN 'late_aircraft_delay' ELSE 'unknown' END"""

CLEAN_CTE = f"""
clean AS (
 SELECT *, CAST(crs_dep_time // 100 AS INT) AS dep_hour, arr_delay >= 15 AS is_delayed, {REASON_CASE} AS reason
 FROM flights WHERE cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL)"""

ENRICHED_CTE = """
enriched AS (
 SELECT c.*, coalesce(eo.event_name, ed.event_name, 'none') AS event_name FROM clean c
  LEFT JOIN event_dim eo ON c.fl_date = eo.event_date AND c.origin = eo.airport
  LEFT JOIN event_dim ed ON c.fl_date = ed.event_date AND c.dest = ed.airport)"""


def with_ctes(body: str, events: bool = False, extra: str = "") -> str:
    ctes = [FLIGHTS_CTE, CLEAN_CTE]
    if events:
        ctes += [SCHEDULE_CTE, ENRICHED_CTE]
    if extra:
        ctes.append(extra)
    return "WITH " + ",".join(ctes) + "\n" + body


def pct(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) * 100 / {den}, 6)"


def pct_nullzero(num: str, den: str) -> str:
    return f"round(CAST(nullif({num}, 0) AS DOUBLE) * 100 / {den}, 6)"


AGG3 = ("count(*) AS flights, count_if(is_delayed) AS delayed, "
        "sum(CASE WHEN is_delayed THEN arr_delay END) AS delay_minutes")
WEATHER = "coalesce(weather_delay, 0) > 0"

AIRPORT = lambda c: name_case(c, AIRPORT_NAMES)


def _airport_rate(side: str, min_flights: int, top_n: int) -> str:
    return with_ctes(f"""
SELECT {side}, {AIRPORT(side)} AS airport_name, flights, nullif(delayed, 0) AS delayed,
  CASE WHEN delayed > 0 THEN delay_minutes END AS delay_minutes, {pct_nullzero('delayed', 'flights')} AS delay_rate_pct
FROM (SELECT {side}, {AGG3} FROM clean WHERE {side} IS NOT NULL GROUP BY {side})
WHERE flights >= {min_flights}
ORDER BY delay_rate_pct DESC NULLS LAST, {side} LIMIT {top_n}""")


def _airport_avg(side: str, top_n: int) -> str:
    return with_ctes(f"""
SELECT {side}, {AIRPORT(side)} AS airport_name, flights, delayed, {pct('delayed', 'flights')} AS delay_rate_pct,
  round(coalesce(delay_minutes, 0) / nullif(delayed, 0), 6) AS avg_delay_minutes_delayed
FROM (SELECT {side}, {AGG3} FROM clean WHERE {side} IS NOT NULL GROUP BY {side})
ORDER BY delayed DESC, {side} LIMIT {top_n}""")


def _weather(side: str) -> str:
    return f"""
SELECT {side}, {AIRPORT(side)} AS airport_name, count(*) AS flights_total, count_if({WEATHER}) AS weather_delayed,
  {pct(f'count_if({WEATHER})', 'count(*)')} AS weather_rate_pct,
  coalesce(sum(CASE WHEN {WEATHER} THEN weather_delay END), 0) AS weather_minutes
FROM clean WHERE {side} IS NOT NULL GROUP BY {side}"""


def _rate(key: str, where: str = "") -> str:
    cond = f"WHERE {key} IS NOT NULL" if not where else where
    return f"""
SELECT {key}, count(*) AS flights, count_if(is_delayed) AS delayed,
  {pct_nullzero('count_if(is_delayed)', 'count(*)')} AS delay_rate_pct
FROM clean {cond} GROUP BY {key}"""


ROUTE_TABLE = f"""
SELECT route, flights, delayed, coalesce(delay_minutes, 0) AS delay_minutes, {pct('delayed', 'flights')} AS delay_rate_pct,
  round(coalesce(delay_minutes, 0) / nullif(delayed, 0), 6) AS avg_delay_minutes_delayed
FROM (SELECT origin || '-' || dest AS route, {AGG3} FROM clean WHERE origin IS NOT NULL AND dest IS NOT NULL
      GROUP BY origin || '-' || dest)"""

GRID = f"""
top5 AS (SELECT origin FROM clean WHERE origin IS NOT NULL GROUP BY origin ORDER BY count_if(is_delayed) DESC, origin LIMIT 5),
cells AS (SELECT origin, dep_hour, count(*) AS flights, count_if(is_delayed) AS delayed FROM clean
          WHERE origin IS NOT NULL AND dep_hour IS NOT NULL GROUP BY origin, dep_hour),
grid AS (
 SELECT t.origin, {AIRPORT('t.origin')} AS origin_name, CAST(h.h AS INT) AS dep_hour,
   coalesce(c.flights, 0) AS flights, coalesce(c.delayed, 0) AS delayed,
   round(CAST(coalesce(c.delayed, 0) AS DOUBLE) * 100 / c.flights, 6) AS delay_rate_pct
 FROM top5 t CROSS JOIN range(0, 24) h(h) LEFT JOIN cells c ON c.origin = t.origin AND c.dep_hour = h.h)"""

SAMPLE_COLS = ["fl_date", "op_unique_carrier", "op_carrier_fl_num", "origin", "dest", "arr_delay", "reason"]


# Column types of the fixture flight view, as Spark prints them.
PROFILE_COLUMNS = [
    ("year", "int"), ("month", "int"), ("day_of_month", "int"), ("day_of_week", "int"), ("fl_date", "date"),
    ("op_unique_carrier", "string"), ("op_carrier_fl_num", "double"), ("origin", "string"),
    ("origin_state_nm", "string"), ("dest", "string"), ("dest_state_nm", "string"), ("crs_dep_time", "int"),
    ("crs_arr_time", "int"), ("arr_delay", "double"), ("cancelled", "int"), ("diverted", "int"),
    ("crs_elapsed_time", "double"), ("distance", "double"), ("carrier_delay", "double"),
    ("weather_delay", "double"), ("nas_delay", "double"), ("security_delay", "double"),
    ("late_aircraft_delay", "double"),
]


def profile_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count_if({c} IS NULL) AS null_cells, "
        f"round(CAST(count_if({c} IS NULL) AS DOUBLE) * 100 / count(*), 4) AS null_pct, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM flights"
        for c, t in PROFILE_COLUMNS
    ]
    return with_ctes("\nUNION ALL\n".join(parts))


#: The flights' columns, in the order in which the files are sorted.
FILE_ORDER = ["year", "month", "day_of_month", "day_of_week", "fl_date", "op_unique_carrier", "op_carrier_fl_num", "origin",
              "origin_state_nm", "dest", "dest_state_nm", "crs_dep_time", "crs_arr_time", "arr_delay", "cancelled", "diverted",
              "crs_elapsed_time", "distance", "carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]


def report_sql(min_airport_flights: int = 1000, top_n: int = 10, event_top: int = 20) -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_flights"] = with_ctes("SELECT * FROM clean")
    q["delay_reason"] = with_ctes(
        "SELECT reason, count(*) AS flights, count_if(is_delayed) AS delayed FROM clean GROUP BY reason")
    q["overview"] = with_ctes(f"""
SELECT count(*) AS total_rows, count_if(c) AS processed_rows, count_if(c AND d) AS delayed_rows,
  coalesce(round(CAST(count_if(c AND d) AS DOUBLE) * 100 / nullif(count_if(c), 0), 6), 0.0) AS delay_rate_pct,
  coalesce(round(avg(CASE WHEN c THEN arr_delay END), 6), 0.0) AS arr_delay_mean_all,
  coalesce(round(avg(CASE WHEN c AND d THEN arr_delay END), 6), 0.0) AS arr_delay_mean_delayed,
  max(CASE WHEN c THEN arr_delay END) AS max_arr_delay,
  count_if(c AND w) AS weather_delayed,
  coalesce(sum(CASE WHEN c AND w THEN weather_delay END), 0.0) AS weather_delay_minutes_total,
  coalesce(round(CAST(count_if(c AND w) AS DOUBLE) * 100 / nullif(count_if(c AND d), 0), 6), 0.0) AS weather_share_pct
FROM (SELECT *, (cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL) AS c,
             coalesce(arr_delay >= 15, false) AS d, {WEATHER} AS w FROM flights)""")
    q["reason_summary"] = with_ctes(f"""
SELECT reason, {name_case('reason', DELAY_REASON_NAMES)} AS reason_name, count(*) AS delayed,
  coalesce(sum(arr_delay), 0) AS delay_minutes
FROM clean WHERE is_delayed GROUP BY reason""")
    q["carrier_delayed"] = with_ctes("""
SELECT op_unique_carrier, count(*) AS delayed FROM clean WHERE is_delayed AND op_unique_carrier IS NOT NULL
GROUP BY op_unique_carrier""")
    q["carrier_delayed_named"] = with_ctes(f"""
SELECT op_unique_carrier, {name_case('op_unique_carrier', CARRIER_NAMES)} AS carrier_name, count(*) AS delayed
FROM clean WHERE is_delayed AND op_unique_carrier IS NOT NULL GROUP BY op_unique_carrier
ORDER BY delayed DESC, op_unique_carrier LIMIT {top_n}""")
    for side in ("origin", "dest"):
        q[f"{side}_delay"] = with_ctes(f"""
SELECT {side}, count(*) AS flights, count_if(is_delayed) AS delayed,
  coalesce(sum(CASE WHEN is_delayed THEN arr_delay END), 0) AS delay_minutes
FROM clean WHERE {side} IS NOT NULL GROUP BY {side}""")
        q[f"airport_rate_{side}"] = _airport_rate(side, min_airport_flights, top_n)
        q[f"airport_avg_{side}"] = _airport_avg(side, top_n)
        q[f"weather_{side}"] = with_ctes(_weather(side))
        q[f"weather_report_{side}"] = with_ctes(
            f"SELECT * FROM ({_weather(side)}) ORDER BY weather_delayed DESC, {side} LIMIT {top_n}")
    q["weather_top_origins"] = with_ctes(f"""
SELECT origin, airport_name, weather_delayed, weather_minutes FROM ({_weather('origin')})
WHERE weather_delayed > 0 ORDER BY weather_delayed DESC, origin LIMIT {top_n}""")
    q["route_delay"] = with_ctes(ROUTE_TABLE)
    q["route_top"] = with_ctes(f"SELECT * FROM ({ROUTE_TABLE}) ORDER BY delayed DESC, route LIMIT {top_n}")
    q["month_rate"] = with_ctes(_rate("month"))
    q["weekday_rate"] = with_ctes(f"""
SELECT day_of_week, {weekday_case('day_of_week')} AS weekday, flights, delayed, delay_rate_pct
FROM ({_rate('day_of_week')})""")
    q["hour_rate"] = with_ctes(_rate("dep_hour"))
    q["hour_rate_with_unknown"] = with_ctes(f"""
SELECT coalesce(dep_hour, -1) AS dep_hour, count(*) AS flights, count_if(is_delayed) AS delayed,
  {pct_nullzero('count_if(is_delayed)', 'count(*)')} AS delay_rate_pct
FROM clean GROUP BY coalesce(dep_hour, -1)""")
    q["origin_hour"] = with_ctes("""
SELECT origin, dep_hour, count(*) AS flights, count_if(is_delayed) AS delayed FROM clean
WHERE origin IS NOT NULL AND dep_hour IS NOT NULL GROUP BY origin, dep_hour""")
    q["month_extremes"] = with_ctes(f"""
SELECT month, flights, delayed, delay_rate_pct,
  (row_number() OVER (ORDER BY delay_rate_pct DESC NULLS LAST, month) = 1 AND delay_rate_pct IS NOT NULL) AS is_max_rate,
  (row_number() OVER (ORDER BY delay_rate_pct ASC NULLS LAST, month) = 1 AND delay_rate_pct IS NOT NULL) AS is_min_rate
FROM ({_rate('month')})""")
    q["largest_airports"] = with_ctes(f"""
SELECT origin, {AIRPORT('origin')} AS airport_name, flights, delayed,
  round(CAST(delayed AS DOUBLE) * 100 / flights, 6) AS delay_rate_pct,
  round(CAST(delayed AS DOUBLE) * 100 / flights - (SELECT CAST(count_if(is_delayed) AS DOUBLE) * 100 / count(*) FROM clean), 6)
    AS delta_vs_overall
FROM (SELECT origin, count(*) AS flights, count_if(is_delayed) AS delayed FROM clean WHERE origin IS NOT NULL GROUP BY origin)
ORDER BY flights DESC, origin LIMIT 5""")
    q["origin_hour_grid"] = with_ctes("SELECT * FROM grid", extra=GRID)
    cols = ", ".join(f"max(CASE WHEN dep_hour = {h} THEN delay_rate_pct END) AS h{h}" for h in range(24))
    q["origin_hour_heatmap"] = with_ctes(f"SELECT origin_name, {cols} FROM grid GROUP BY origin_name", extra=GRID)
    q["event_dim"] = with_ctes("SELECT * FROM event_dim", events=True)
    q["event_enriched"] = with_ctes("SELECT * FROM enriched", events=True)
    q["event_delay"] = with_ctes(f"""
SELECT event_name, flights, delayed, {pct('delayed', 'flights')} AS delay_rate_pct, coalesce(delay_minutes, 0) AS delay_minutes
FROM (SELECT event_name, {AGG3} FROM enriched WHERE event_name IS NOT NULL GROUP BY event_name)
ORDER BY (event_name = 'none') DESC, delayed DESC, event_name LIMIT {event_top}""", events=True)
    q["event_origin_delay"] = with_ctes(f"""
SELECT event_name, origin, flights, delayed, coalesce(delay_minutes, 0) AS delay_minutes
FROM (SELECT event_name, origin, {AGG3} FROM enriched WHERE event_name IS NOT NULL AND origin IS NOT NULL
      GROUP BY event_name, origin)""", events=True)
    q["event_top"] = with_ctes(f"""
SELECT event_name, flights, delayed, {pct('delayed', 'flights')} AS delay_rate_pct
FROM (SELECT event_name, count(*) AS flights, count_if(is_delayed) AS delayed FROM enriched
      WHERE event_name IS NOT NULL AND event_name <> 'none' GROUP BY event_name)
ORDER BY delayed DESC, event_name LIMIT {top_n}""", events=True)
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in SAMPLE_COLS)
    q["sample_delays"] = with_ctes(
        f"SELECT {', '.join(SAMPLE_COLS)} FROM clean WHERE is_delayed ORDER BY {order} LIMIT 10")
    q["carrier_rate"] = with_ctes(f"""
SELECT op_unique_carrier, {name_case('op_unique_carrier', CARRIER_SHORT_NAMES)} AS carrier_name, flights, delayed,
  {pct('delayed', 'flights')} AS delay_rate_pct, CAST(sum(flights) OVER () AS BIGINT) AS total_flights, CAST(sum(delayed) OVER () AS BIGINT) AS total_delayed
FROM (SELECT op_unique_carrier, count(*) AS flights, count_if(is_delayed) AS delayed FROM clean
      WHERE op_unique_carrier IS NOT NULL GROUP BY op_unique_carrier)
ORDER BY delay_rate_pct DESC, op_unique_carrier LIMIT {top_n}""")
    q["class_balance"] = with_ctes("""
SELECT count(*) AS rows, count_if(is_delayed) AS positives,
  coalesce(round(CAST(count_if(is_delayed) AS DOUBLE) / nullif(count(*), 0), 6), 0.0) AS positive_rate,
  coalesce(round(1.0 - CAST(count_if(is_delayed) AS DOUBLE) / nullif(count(*), 0), 6), 0.0) AS always_on_time_accuracy
FROM clean""")
    q["column_profile"] = profile_sql()
    q["stream_origin_totals"] = q["origin_delay"]
    q["stream_event_totals"] = with_ctes(f"""
SELECT event_name, count(*) AS flights, count_if(is_delayed) AS delayed,
  coalesce(sum(CASE WHEN is_delayed THEN arr_delay END), 0) AS delay_minutes
FROM enriched WHERE event_name IS NOT NULL GROUP BY event_name""", events=True)
    q["stream_event_enriched"] = q["event_enriched"]
    every = lambda n: f"CAST(op_carrier_fl_num AS BIGINT) % {n} = 0"
    whole = ", ".join(f"{c} ASC NULLS FIRST" for c in FILE_ORDER)
    q["scan_first_rows"] = with_ctes(f"SELECT * FROM flights ORDER BY (month > 6), {whole} LIMIT 40000")
    q["first_delays"] = with_ctes(
        f"SELECT {', '.join(SAMPLE_COLS)} FROM clean WHERE is_delayed ORDER BY (month > 6), {whole} LIMIT 10")
    q["event_dim_files"] = with_ctes("SELECT * FROM event_dim", events=True).replace(
        "max_by(event_name, seq)", "max_by(event_name, seq + (seq % 2) * 1000000000000)")
    q["scan_flights"] = with_ctes(f"""
SELECT * REPLACE (CASE WHEN {every(83)} THEN NULL ELSE crs_dep_time END AS crs_dep_time,
  CASE WHEN {every(79)} THEN NULL ELSE arr_delay END AS arr_delay,
  CASE WHEN {every(73)} THEN NULL ELSE distance END AS distance,
  CASE WHEN {every(71)} THEN NULL ELSE fl_date END AS fl_date) FROM flights""")
    return q


def all_sql() -> dict[str, str]:
    from tarmac.plans.oracle_eval import eval_sql, feature_sql, model_rows_sql, sampling_sql

    q = report_sql()
    q.update(eval_sql())
    q.update(feature_sql())
    q.update(model_rows_sql())
    q.update(sampling_sql())
    return q
