"""Feature preparation for the models.

All transformations are column expressions; the only values brought to the
driver are fixed-size statistics (13 medians, one split bucket per class,
means and deviations), which go back into the plan as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import ROUND_DIGITS
from tarmac.operators.joins import stored
from tarmac.schema import MODEL_CATEGORICAL, MODEL_NUMERIC, MODEL_RAW_NUMERIC

UNKNOWN = "Unknown"
_TWO_PI = 2 * math.pi
# Equal rows numbered in one go, and hash buckets of the subsample's histogram.
COPIES = 10_000
SAMPLE_BUCKETS = 1 << 16
# Different values of a column that a median's last step may count.
MEDIAN_VALUES = 4096


def engineered_columns(flights: DataFrame) -> DataFrame:
    """Raw numerics as doubles plus calendar and cyclic hour features;
    categoricals with missing values as ``'Unknown'``."""
    hour = F.expr("CAST(crs_dep_time DIV 100 AS DOUBLE)")
    angle = F.lit(_TWO_PI) * F.col("dep_hour") / F.lit(24.0)
    base = flights.select(
        *[F.col(c).cast("double").alias(c) for c in MODEL_RAW_NUMERIC],
        hour.alias("dep_hour"),
        F.dayofyear("fl_date").cast("double").alias("day_of_year"),
        F.coalesce(F.col("day_of_week").isin(6, 7), F.lit(False)).cast("double").alias("is_weekend"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in MODEL_CATEGORICAL],
        F.col("arr_delay").cast("double").alias("arr_delay"),
    )
    return base.withColumns({"dep_hour_sin": F.sin(angle), "dep_hour_cos": F.cos(angle)})


def column_medians(df: DataFrame, cols: list[str], exact: bool = True, most: int = MEDIAN_VALUES) -> dict[str, float | None]:
    """Median of each column (NULL and NaN left out; the mean of the middle two
    of an even number; None without values), for all columns at once.

    ``exact`` is a selection: every column has a bracket of values that holds its
    middle ranks. While a bracket has more than ``most`` different values, a
    sketch of fixed size proposes a narrower one and exact counts confirm it (or
    the sketch looks less closely). What is left is one count for each value in
    the brackets, at most about ``most`` a column, wherever the values lie.
    Otherwise one pass of ``percentile_approx`` sketches.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    if not exact:
        row = df.agg(*[F.percentile_approx(value[c], 0.5, 10_000).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}

    def inside(c: str, bounds: tuple[float, float] | None) -> Column:
        return value[c] if bounds is None else F.when(value[c].between(*bounds), value[c])

    def counted(brackets: dict) -> dict[str, tuple[int, int, int]]:
        aggs = []
        for i, (c, bounds) in enumerate(brackets.items()):
            below = F.count_if(value[c] < bounds[0]) if bounds else F.lit(0).cast("long")
            aggs += [F.max(below).alias(f"b{i}") if not bounds else below.alias(f"b{i}"), F.count(inside(c, bounds)).alias(f"n{i}"),
                     F.approx_count_distinct(inside(c, bounds)).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        return {c: (row[f"b{i}"] or 0, row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(brackets)}

    bracket: dict[str, tuple[float, float] | None] = {c: None for c in cols}
    found = counted(bracket)
    rows = {c: found[c][1] for c in cols}
    near = {c: 1e-3 for c in cols}
    while wide := [c for c in cols if found[c][2] > most]:
        aggs = []
        for c in wide:
            middle = (rows[c] / 2 - found[c][0]) / found[c][1]
            ends = [F.lit(min(max(middle + e, 0.0), 1.0)) for e in (-near[c], near[c])]
            aggs.append(F.percentile_approx(inside(c, bracket[c]), F.array(*ends), 10_000).alias(c))
        row = df.agg(*aggs).first()
        tried = {c: (row[c][0], row[c][1]) for c in wide}
        for c, (below, n, d) in counted(tried).items():
            holds = below <= (rows[c] - 1) // 2 and below + n > rows[c] // 2
            if holds and (n < found[c][1] or d <= most):
                bracket[c], found[c] = tried[c], (below, n, d)
            else:  # missed the middle: look less closely
                near[c] *= 4
                if near[c] > 1:
                    raise ArithmeticError(f"no narrower bracket around the median of {c}")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), inside(c, bracket[c]).alias("v")) for c in cols]))
    counts: dict[str, list] = {c: [] for c in cols}
    for r in df.select(pairs.alias("p")).where("p.v IS NOT NULL").groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["c"]].append((r["v"], r["n"]))  # bounded by the brackets

    def at(c: str, rank: int) -> float:
        upto = found[c][0]
        for v, n in sorted(counts[c]):
            upto += n
            if upto > rank:
                return v
        raise AssertionError(c)

    return {c: (at(c, (rows[c] - 1) // 2) + at(c, rows[c] // 2)) / 2 if rows[c] else None for c in cols}


def model_features(flights: DataFrame, exact_median: bool = True) -> DataFrame:
    """Feature frame of the modeling plan: 13 numerics with NULLs replaced
    by the column median (taken over all rows, before rows without an
    arrival delay are dropped), 5 categoricals, and ``arr_delay``.

    Unlike the report tables this keeps cancelled and diverted flights that
    have an arrival delay, as the modeling plan of the reference does.
    """
    return filled_features(engineered_columns(flights), exact_median)


def filled_features(base: DataFrame, exact_median: bool = True) -> DataFrame:
    """:func:`model_features` of already engineered columns. They are read
    twice (medians, rows), so plans materialise them before."""
    medians = column_medians(base, MODEL_NUMERIC, exact_median)
    fills = {c: v for c, v in medians.items() if v is not None}
    filled = base.fillna(fills) if fills else base
    cyclic = {c: F.round(F.col(c), ROUND_DIGITS) for c in ("dep_hour_sin", "dep_hour_cos")}
    return filled.withColumns(cyclic).where(F.col("arr_delay").isNotNull()).select(
        *MODEL_NUMERIC, *MODEL_CATEGORICAL, "arr_delay"
    )


def fit_standardizer(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (one pass).
    A zero deviation is replaced by 1 so the column is only centred."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m = row[f"m_{c}"] or 0.0
        s = row[f"s_{c}"]
        out[c] = (float(m), float(s) if s not in (None, 0.0) else 1.0)
    return out


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], digits: int | None = ROUND_DIGITS) -> DataFrame:
    """Replace each column by ``(x - mean) / sd`` using fitted statistics."""
    cols = {}
    for c, (m, s) in stats.items():
        z = (F.col(c) - F.lit(m)) / F.lit(s)
        cols[c] = F.round(z, digits) if digits is not None else z
    return df.withColumns(cols)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights ``rows / (classes * rows_in_class)``. The
    window runs over the per-class counts: one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.select(
        label,
        "n",
        F.round(F.sum("n").over(whole).cast("double") / (F.count(F.lit(1)).over(whole) * F.col("n")), ROUND_DIGITS)
        .alias("weight"),
    )


def class_weight_column(df: DataFrame, label: str = "label") -> Column:
    """Balanced weight of a row's class, as a CASE over the classes of ``df``;
    one number per class reaches the driver."""
    out = F.lit(None).cast("double")
    for r in class_weights(df, label).collect():
        out = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(float(r["weight"]))).otherwise(out)
    return out


# ---------------------------------------------------------------------------
# Seeded, partition-independent sampling
# ---------------------------------------------------------------------------

def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``_row_key``, a hash of the row and of its number among equal rows:
    repeated rows are then split and sampled one by one.

    Equal rows are counted (combined before the shuffle) and numbered from the
    count, in chunks of ``COPIES`` that are dealt out over the tasks: a row that
    makes up a third of the table is neither gathered nor expanded in one task.
    The keyed rows are written to the shared folder: splits, folds and samples
    read them several times, and hash the key rather than the row's text.
    """
    cols = df.columns
    step = F.lit(COPIES).cast("long")
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, step)))
    copies = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("_n")) - 1))
    numbered = chunks.repartition(*cols, "_from").withColumn("_copy", copies)
    return stored(numbered.select(*cols, _digits(_portable(df, cols, F.col("_copy")), 15).alias("_row_key")), "keyed")[0]


def _portable(df: DataFrame, cols: list[str], *more: Column) -> Column:
    """MD5 (hex) of the columns' texts. The texts are the same in any engine:
    fractional numbers have six decimals, a missing value is ``~``."""
    fractions = (T.DoubleType, T.FloatType, T.DecimalType)

    def text(c: str) -> Column:
        value = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, fractions):
            value = value.try_cast("decimal(38,6)")
        return F.coalesce(value.cast("string"), F.lit("~"))

    return F.md5(F.concat_ws("|", *[text(c) for c in cols], *[m.cast("string") for m in more]))


def _digits(md5: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits as a number."""
    return F.conv(F.substring(md5, 1, n), 16, 10).cast("long")


def hash_unit(df: DataFrame, cols: list[str], seed: int) -> Column:
    """A value in [0, 1) from the first 52 bits of an MD5 of the row's columns
    and the seed. Depends only on the row, never on partitioning, task order or
    engine. Rows that are identical in ``cols`` get the same value."""
    return _digits(_portable(df, cols, F.lit(seed)), 13).cast("double") / F.lit(float(1 << 52))


def stratified_split(
    df: DataFrame,
    label: str,
    test_fraction: float = 0.2,
    seed: int = 42,
    key_cols: list[str] | None = None,
    stratify: bool = True,
    buckets: int = 1 << 16,
) -> DataFrame:
    """Add boolean ``is_test``: ``test_fraction`` of the rows of every class
    (``stratify``) or of all rows, to within one bucket's share (1/65 536).

    Each row gets a hash unit ``u`` and a bucket ``floor(u * buckets)``. An
    exact integer histogram per (class, bucket) - at most ``buckets`` rows per
    class - gives, through a running sum over that fixed-size table, the
    first bucket where the class's training share is reached; rows above it
    are test rows. Counts are exact, so the choice depends only on the rows,
    never on partitioning or retries. One number per class reaches the driver.
    """
    keys = key_cols or df.columns
    bucket = F.floor(hash_unit(df, keys, seed) * buckets).cast("int")
    with_b = df.withColumn("_b", bucket)
    group = F.col(label) if stratify else F.lit(0)
    hist = with_b.groupBy(group.alias("_g"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g")
    cum = hist.select("_g", "_b", F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(whole).alias("_tot"))
    cuts = (
        cum.where(F.col("_cum") >= F.lit(1.0 - test_fraction) * F.col("_tot"))
        .groupBy("_g").agg(F.min("_b").alias("cut"))
        .collect()
    )
    cut = None
    for r in cuts:
        cond = group.isNull() if r["_g"] is None else (group == F.lit(r["_g"]))
        cut = F.when(cond, F.lit(int(r["cut"]))) if cut is None else cut.when(cond, F.lit(int(r["cut"])))
    cut_col = cut if cut is not None else F.lit(buckets)
    return with_b.withColumn("is_test", F.col("_b") > cut_col).drop("_b")


def stratified_folds(df: DataFrame, label: str, folds: int = 3, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """Add ``fold`` (0 to ``folds - 1``): the rows of every class are numbered
    in hash order and dealt out in turn, so a class's folds differ by at most one
    row. Equal rows need a key to be told apart; they are dealt out all the same.

    A histogram per (class, hash bucket) gives every bucket its first number;
    rows are numbered inside their bucket, never over a whole class.
    """
    keys = key_cols or df.columns
    rows = df.withColumn("_u", hash_unit(df, keys, seed)).withColumn("_b", F.floor(F.col("_u") * SAMPLE_BUCKETS).cast("int"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets
    first = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(label).alias("_g"), F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(label, "_b").orderBy("_u", *[F.asc_nulls_first(c) for c in keys])
    numbered = rows.withColumn("_r", F.row_number().over(inside))
    joined = numbered.join(first, F.col(label).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")))
    return joined.withColumn("fold", F.pmod(F.col("_first") + F.col("_r") - 1, F.lit(folds)).cast("int")).select(*df.columns, "fold")


def subsample(df: DataFrame, max_rows: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """At most ``max_rows`` rows, uniformly without replacement, seeded and
    independent of partitioning: the rows with the smallest hash units.

    The hash is made once: rows of twice the buckets that should do (more, if a
    histogram of these finds too few rows) are written, and what follows reads
    those. The histogram gives the bucket in which row ``max_rows`` falls. Rows of
    lower buckets are kept by a filter, and only rows of that one bucket go through
    a top-n selection. An input of at most ``max_rows`` rows is returned whole.
    """
    n = df.count()
    if n <= max_rows:
        return df
    keys = key_cols or df.columns
    unit = df.withColumn("_u", hash_unit(df, keys, seed))
    with_b = unit.withColumn("_b", F.floor(F.col("_u") * SAMPLE_BUCKETS).cast("int"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # over the buckets, not the rows
    last, top = None, 2 * max_rows * SAMPLE_BUCKETS // n
    while last is None:
        near = stored(with_b.where(F.col("_b") <= top), "sample")[0]
        hist = near.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(upto))
        last, top = hist.where(F.col("_cum") > max_rows).orderBy("_b").first(), 2 * top + 1
    lower = near.where(F.col("_b") < last["_b"])
    rest = max_rows - (last["_cum"] - last["_n"])
    edge = near.where(F.col("_b") == last["_b"]).orderBy("_u", *[F.asc_nulls_first(c) for c in keys]).limit(rest)
    return lower.unionByName(edge).drop("_u", "_b")
