"""DuckDB SQL for the evaluation tables (scored rows of FIXTURES.md B5)."""

from __future__ import annotations

from tarmac.plans.oracle import with_ctes

SCORED_CTE = """
scored AS (
 SELECT label, p_pct, CAST(p_pct AS DOUBLE) / 100 AS p, CASE WHEN p_pct >= 50 THEN 1 ELSE 0 END AS prediction, y, yhat
 FROM (SELECT CAST(is_delayed AS INT) AS label,
              (coalesce(dep_hour, 0) * 3 + day_of_week * 2 + CAST(is_delayed AS INT) * 15) % 101 AS p_pct,
              arr_delay AS y, CAST(coalesce(dep_hour, 0) + 5 AS DOUBLE) AS yhat FROM clean))"""

COUNTS = ("count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp, "
          "count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp")


def d0(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif({den}, 0), 0.0)"


def metrics(tn="tn", fp="fp", fn="fn", tp="tp") -> str:
    return (f"round({d0(f'{tp} + {tn}', f'{tn} + {fp} + {fn} + {tp}')}, 6) AS accuracy, "
            f"round({d0(tp, f'{tp} + {fp}')}, 6) AS precision, round({d0(tp, f'{tp} + {fn}')}, 6) AS recall, "
            f"round({d0(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1")


def _s(body: str, extra: str = "") -> str:
    return with_ctes(body, extra=SCORED_CTE + ("," + extra if extra else ""))


VALUE = "CAST(tp AS DOUBLE) * 100 + CAST(fp AS DOUBLE) * -10 + CAST(fn AS DOUBLE) * -200 + CAST(tn AS DOUBLE) * 0"

CURVE = f"""
curve AS (
 SELECT round(CAST(i AS DOUBLE) / 100, 6) AS threshold, tp, fp, fn, tn, round({VALUE}, 6) AS total_value,
   round({d0(VALUE, 'tp + fp + fn + tn')}, 6) AS expected_value
 FROM (SELECT t.i, count_if(label = 1 AND p_pct >= t.i) AS tp, count_if(label = 0 AND p_pct >= t.i) AS fp,
              count_if(label = 1 AND p_pct < t.i) AS fn, count_if(label = 0 AND p_pct < t.i) AS tn
       FROM range(0, 101) t(i), scored GROUP BY t.i))"""

HIST = """
hist AS (SELECT CAST(p_pct AS DOUBLE) / 100 AS score, count_if(label = 1) AS pos, count_if(label = 0) AS neg
         FROM scored GROUP BY p_pct)"""


def eval_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["confusion_matrix"] = _s(f"SELECT {COUNTS} FROM scored")
    q["binary_metrics"] = _s(f"SELECT tn, fp, fn, tp, {metrics()} FROM (SELECT {COUNTS} FROM scored)")
    q["classification_report"] = _s(f"""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
 SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
 UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
 UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m
 UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
 UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM m)""",
        extra=f"""
cm AS (SELECT {COUNTS} FROM scored),
m AS (SELECT {d0('tn', 'tn + fn')} AS p0, {d0('tn', 'tn + fp')} AS r0, {d0('2 * tn', '2 * tn + fn + fp')} AS f0, tn + fp AS s0,
             {d0('tp', 'tp + fp')} AS p1, {d0('tp', 'tp + fn')} AS r1, {d0('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1,
             {d0('tp + tn', 'tn + fp + fn + tp')} AS acc, tn + fp + fn + tp AS n FROM cm)""")
    q["expected_value"] = _s(f"""
SELECT tn, fp, fn, tp, round({VALUE}, 6) AS total_value, round({d0(VALUE, 'tn + fp + fn + tp')}, 6) AS expected_value
FROM (SELECT {COUNTS} FROM scored)""")
    sweep = " UNION ALL ".join(
        f"SELECT CAST({t / 100} AS DOUBLE) AS threshold, count_if(label = 0 AND p_pct < {t}) AS tn, "
        f"count_if(label = 0 AND p_pct >= {t}) AS fp, count_if(label = 1 AND p_pct < {t}) AS fn, "
        f"count_if(label = 1 AND p_pct >= {t}) AS tp FROM scored"
        for t in (30, 50, 70))
    q["threshold_sweep"] = _s(f"""
SELECT threshold, tn, fp, fn, tp, {metrics()}, round({d0(VALUE, 'tn + fp + fn + tp')}, 6) AS expected_value
FROM ({sweep})""")
    q["profit_curve"] = _s("SELECT * FROM curve", extra=CURVE)
    q["best_threshold"] = _s("SELECT * FROM curve ORDER BY total_value DESC, threshold LIMIT 1", extra=CURVE)
    q["roc_points"] = _s("""
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(P, 0), 0.0), 6) AS tpr, round(coalesce(CAST(fp AS DOUBLE) / nullif(N, 0), 0.0), 6) AS fpr
FROM (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM hist)
UNION ALL SELECT NULL, 0, 0, 0.0, 0.0""", extra=HIST)
    q["roc_auc"] = _s("""
SELECT round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 10) AS auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM hist)""", extra=HIST)
    q["regression_metrics"] = _s("""
SELECT count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae
FROM scored""")
    q["mean_baseline"] = _s("""
SELECT count(*) AS n, round(sqrt(avg((y - m) * (y - m))), 6) AS rmse, round(avg(abs(y - m)), 6) AS mae,
  round(max(m), 6) AS train_mean
FROM scored, (SELECT avg(y) AS m FROM scored WHERE prediction = 0) WHERE prediction = 1""")
    q["residual_histogram"] = _s("""
SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 60), 6) AS bin_start, round(lo + b.bin * ((hi - lo) / 60), 6) AS bin_end,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(i AS INT) AS bin FROM range(1, 61) t(i)) b CROSS JOIN bounds
LEFT JOIN (SELECT least(CAST(floor((r - lo) / (hi - lo) * 60) AS INT) + 1, 60) AS bin, count(*) AS cnt
           FROM res, bounds GROUP BY 1) c ON c.bin = b.bin""",
        extra="""
res AS (SELECT y - yhat AS r FROM scored WHERE y - yhat IS NOT NULL),
bounds AS (SELECT CASE WHEN min(r) = max(r) THEN min(r) - 0.5 ELSE min(r) END AS lo,
                  CASE WHEN min(r) = max(r) THEN max(r) + 0.5 ELSE max(r) END AS hi FROM res)""")
    q["class_weights"] = _s("""
SELECT label, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (2 * count(*)), 6) AS weight
FROM scored GROUP BY label""")
    return q


def feature_sql() -> dict[str, str]:
    from tarmac.schema import MODEL_CATEGORICAL, MODEL_NUMERIC, MODEL_RAW_NUMERIC

    raw = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_RAW_NUMERIC)
    cats = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in MODEL_CATEGORICAL)
    base = f"""
feat_base AS (
 SELECT {raw}, CAST(crs_dep_time // 100 AS DOUBLE) AS dep_hour, CAST(dayofyear(fl_date) AS DOUBLE) AS day_of_year,
   CASE WHEN day_of_week IN (6, 7) THEN 1.0 ELSE 0.0 END AS is_weekend,
   sin(2 * pi() * CAST(crs_dep_time // 100 AS DOUBLE) / 24.0) AS dep_hour_sin,
   cos(2 * pi() * CAST(crs_dep_time // 100 AS DOUBLE) / 24.0) AS dep_hour_cos,
   {cats}, CAST(arr_delay AS DOUBLE) AS arr_delay FROM flights),
med AS (SELECT {", ".join(f"median({c}) AS {c}" for c in MODEL_NUMERIC)} FROM feat_base),
feat AS (
 SELECT {", ".join(
        f"round(coalesce(f.{c}, m.{c}), 6) + 0.0 AS {c}" if c in ("dep_hour_sin", "dep_hour_cos")
        else f"CAST(coalesce(f.{c}, m.{c}) AS DOUBLE) AS {c}" for c in MODEL_NUMERIC)},
   {", ".join(f"f.{c}" for c in MODEL_CATEGORICAL)}, f.arr_delay
 FROM feat_base f, med m WHERE f.arr_delay IS NOT NULL)"""
    q = {"feature_frame": with_ctes("SELECT * FROM feat", extra=base)}
    stats = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in MODEL_NUMERIC)
    z = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in MODEL_NUMERIC)
    q["scaled_features"] = with_ctes(f"SELECT {z} FROM feat, (SELECT {stats} FROM feat)", extra=base)
    return q


CLEAN_TEXT = ["year", "month", "day_of_month", "day_of_week", "fl_date", "op_unique_carrier", "+op_carrier_fl_num", "origin",
              "origin_state_nm", "dest", "dest_state_nm", "crs_dep_time", "crs_arr_time", "+arr_delay", "cancelled", "diverted",
              "+crs_elapsed_time", "+distance", "+carrier_delay", "+weather_delay", "+nas_delay", "+security_delay",
              "+late_aircraft_delay", "dep_hour", "is_delayed", "reason"]
BASELINE_TEXT = ["month", "day_of_week", "dep_hour", "+distance", "op_unique_carrier", "origin", "dest", "is_delayed", "label"]


def _hex(md5: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({md5}), 1, {digits}) AS BIGINT)"


def keyed_cte(source: str, cols: list[str], seed: int = 42) -> str:
    """Rows with the portable row key ``rk`` and hash unit ``u``; columns with a
    plus sign are fractional."""
    plain = [c.lstrip("+") for c in cols]
    texts = [f"coalesce(CAST(TRY_CAST({c[1:]} AS DECIMAL(38,6)) AS VARCHAR), '~')" if c[0] == "+"
             else f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols]
    copy = f"CAST(row_number() OVER (PARTITION BY {', '.join(plain)}) - 1 AS VARCHAR)"
    row = "concat_ws('|', " + ", ".join(texts) + ", copy_no)"
    again = f"concat_ws('|', CAST(rk AS VARCHAR), '{seed}')"
    return f"""
keyed AS (
 SELECT *, CAST({_hex(again, 13)} AS DOUBLE) / 4503599627370496.0 AS u FROM (
  SELECT *, {_hex(row, 15)} AS rk FROM (SELECT *, {copy} AS copy_no FROM {source})))"""


def split_cte(label: str) -> str:
    return f"""
hist AS (SELECT {label} AS g, CAST(floor(u * 65536) AS INT) AS b, count(*) AS n FROM keyed GROUP BY ALL),
cum AS (SELECT g, b, sum(n) OVER (PARTITION BY g ORDER BY b) AS c, sum(n) OVER (PARTITION BY g) AS tot FROM hist),
cuts AS (SELECT g, min(b) AS cut FROM cum WHERE c >= CAST(0.8 AS DOUBLE) * tot GROUP BY g),
split AS (SELECT k.*, CAST(floor(u * 65536) AS INT) > cut AS is_test FROM keyed k JOIN cuts ON {label} = g)"""


ROUTE_TEXT = ["month", "day_of_week", "dep_hour", "+distance", "event_flag", "origin", "dest", "op_unique_carrier", "event_name",
              "is_delayed", "label"]


def onehot_sql(rows: str, text: list[str], cats: list[str]) -> str:
    """Slots and active counts of the test rows from the training rows' values."""
    body = model_rows_sql()[rows]
    base = body[body.rindex("SELECT month"):].replace("is_delayed\n", "is_delayed ").replace(
        "is_delayed FROM", "is_delayed, CAST(is_delayed AS INT) AS label FROM").replace(
        "is_delayed  ", "is_delayed, CAST(is_delayed AS INT) AS label ")
    slots = [f"s_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS slot "
             f"FROM (SELECT DISTINCT {c} FROM split WHERE NOT is_test AND {c} IS NOT NULL))" for c in cats]
    out = ", ".join(f"CAST(s_{c}.slot IS NOT NULL AS INT) AS {c}_active, s_{c}.slot AS {c}_slot" for c in cats)
    joins = " ".join(f"LEFT JOIN s_{c} ON split.{c} = s_{c}.v" for c in cats)
    return with_ctes(f"SELECT {', '.join('split.' + c for c in cats)}, {out} FROM split {joins} WHERE is_test", events=True,
                     extra=",".join([f"base AS ({base})", keyed_cte("base", text), split_cte("label"), *slots]))


def sampling_sql() -> dict[str, str]:
    keyed = keyed_cte("clean", CLEAN_TEXT)
    return {
        "stratified_split": with_ctes("SELECT is_delayed, is_test, count(*) AS rows FROM split GROUP BY ALL",
                                      extra=keyed + "," + split_cte("is_delayed")),
        "stratified_folds": with_ctes("""
SELECT is_delayed, fold, count(*) AS rows, sum(arr_delay) AS minutes FROM (
 SELECT is_delayed, arr_delay, CAST((row_number() OVER (PARTITION BY is_delayed ORDER BY u, rk) - 1) % 3 AS INT) AS fold FROM keyed)
GROUP BY ALL""", extra=keyed),
        "subsample": with_ctes("SELECT * EXCLUDE (copy_no, rk, u) FROM keyed ORDER BY u, rk LIMIT 1000", extra=keyed),
        "onehot_slots": onehot_sql("baseline_rows", BASELINE_TEXT, ["op_unique_carrier", "origin", "dest"]),
        "onehot_event_slots": onehot_sql("route_model_rows", ROUTE_TEXT, ["origin", "dest", "op_unique_carrier", "event_name"]),
    }


def model_rows_sql() -> dict[str, str]:
    base_cols = "month, day_of_week, coalesce(dep_hour, -1) AS dep_hour, distance, op_unique_carrier, origin, dest"
    not_null = ("month IS NOT NULL AND day_of_week IS NOT NULL AND distance IS NOT NULL AND "
                "op_unique_carrier IS NOT NULL AND origin IS NOT NULL AND dest IS NOT NULL")
    return {
        "baseline_rows": with_ctes(f"SELECT {base_cols}, is_delayed FROM clean WHERE {not_null}"),
        "route_model_rows": with_ctes(
            f"""SELECT month, day_of_week, coalesce(dep_hour, -1) AS dep_hour, distance,
                  CAST(event_name <> 'none' AS INT) AS event_flag, origin, dest, op_unique_carrier, event_name, is_delayed
                FROM enriched WHERE {not_null}""", events=True),
    }
