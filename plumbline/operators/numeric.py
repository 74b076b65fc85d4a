"""Numeric statistics: one aggregation for all columns, reshaped to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.schema import feature_columns, numeric_columns, quoted, string_columns
from plumbline.functions.text import is_null, percent

from .duplicates import exact_duplicates
from .frequency import distinct_counts, frequencies, top_values
from .gram import correlations_of
from .quantiles import exact_quantiles, number, quantiles_with

def _by_column(df: DataFrame, columns: list[str], measures: dict, quantiles: dict[str, float] | None = None) -> DataFrame:
    """One row for each column with the given measures (name: function of a Column), by one aggregation, and exact
    ``quantiles`` (name: probability), all in the order of ``measures`` and then of ``quantiles``."""
    if not columns:
        raise ValueError("no numeric column")
    aggs = [f(number(df, c)).alias(f"{name}__{k}") for k, c in enumerate(columns) for name, f in measures.items()] or [F.count("*").alias("rows")]
    if not quantiles:
        row = df.agg(*aggs)
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{name}__{k}").alias(name) for name in measures]) for k, c in enumerate(columns)])))
    found, told = quantiles_with(df, columns, list(quantiles.values()), aggs)
    rows = [(c, *[told[f"{name}__{k}"] for name in measures], *[found[c, p] for p in quantiles.values()]) for k, c in enumerate(columns)]
    whole = {name for name in measures if any(isinstance(told[f"{name}__{k}"], int) for k in range(len(columns)))}
    kinds = [f"`{name}` {'bigint' if name in whole else 'double'}" for name in [*measures, *quantiles]]
    return df.sparkSession.createDataFrame(rows, ", ".join(["`column` string", *kinds]))


MOMENTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
DESCRIBED = ("count", "mean", "std", "min", *QUARTILES, "max")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max of each numeric column."""
    return _by_column(df, columns or numeric_columns(df), MOMENTS, QUARTILES).select("column", *DESCRIBED)


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """column, probability, value; ``exact=False`` takes the sketch."""
    named = {f"p{k}": q for k, q in enumerate(probabilities)}
    wide = _by_column(df, columns, {}, named) if exact else _by_column(df, columns, {name: (lambda c, q=q: F.percentile_approx(c, q, accuracy)) for name, q in named.items()})
    return wide.select("column", F.inline(F.array(*[F.struct(F.lit(q).alias("probability"), F.col(name).alias("value")) for name, q in named.items()])))


def quick_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, median, std (population), min, max."""
    wide = _by_column(df, columns or numeric_columns(df), {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}, {"median": 0.5})
    return wide.select("column", "mean", "median", "std", "min", "max")


def k_squared(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino and Pearson's statistic from the count, the skewness and the excess kurtosis (both biased)."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.ln(y / alpha + F.sqrt(F.pow(y / alpha, F.lit(2)) + 1))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """describe's measures with iqr, skewness and kurtosis (biased, over 2 values) and the normality
    statistic (over 8 values); NULL where a column doesn't vary or has too few values."""
    wide = _by_column(df, columns or numeric_columns(df), {**MOMENTS, "g1": F.skewness, "g2": F.kurtosis}, QUARTILES)
    varies = F.col("max") > F.col("min")
    n = F.col("count")
    return wide.select(
        *[F.col(c) for c in ("column", *DESCRIBED)], (F.col("q75") - F.col("q25")).alias("iqr"),
        F.when(varies & (n > 2), F.col("g1")).alias("skewness"), F.when(varies & (n > 2), F.col("g2")).alias("kurtosis"),
        F.when(varies & (n > 8), k_squared(n, F.col("g1"), F.col("g2"))).alias("normality"),
    )


def categorical_distribution(freq: DataFrame, k: int = 20) -> DataFrame:
    """unique values, the most common one with count and percentage, and the entropy (nats) of the k most
    frequent values' counts."""
    top = top_values(freq, k, with_nulls=False)
    total = Window.partitionBy("column")
    shares = top.withColumn("p", F.col("cnt") / F.sum("cnt").over(total))
    sums = shares.groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("most_common"), F.max("cnt").alias("most_common_count"), F.sum(-F.col("p") * F.ln("p")).alias("entropy"),
    )
    out = sums.join(distinct_counts(freq), "column")
    return out.select("column", F.col("n_unique").alias("unique_values"), "most_common", "most_common_count", percent(F.col("most_common_count"), F.col("non_null")).alias("most_common_pct"), "entropy")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, lower, upper, cnt, density over equal bins from the least to the greatest value."""
    v = number(df, column)
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    rows = df.select(v.alias("v")).filter("v IS NOT NULL").crossJoin(F.broadcast(bounds))  # one row of bounds
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted = rows.groupBy(place.alias("bin"), "lo", "hi", "n").agg(F.count("*").alias("cnt"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "cnt", F.when(width > 0, F.col("cnt") / (F.col("n") * width)).alias("density"))


def density(df: DataFrame, column: str, points: int = 1000, *, bins_per_bandwidth: int = 512) -> DataFrame:
    """Gaussian density (Scott's bandwidth) on an even grid. Values are first counted in bins of a small part of the
    bandwidth, each represented by its mean, so that the work on the grid grows with the range
    in bandwidths and not with the rows; against the exact sum the density's error is below
    1 / (8 * bins_per_bandwidth ** 2) of a kernel's height."""
    v = number(df, column)
    row = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("s")).first()
    if not row.n or not row.s:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h, span = row.s * row.n ** (-0.2), row.hi - row.lo
    key = F.floor((v - row.lo) / (h / bins_per_bandwidth))
    weights = df.select(v.alias("v"), key.alias("key")).filter("v IS NOT NULL").groupBy("key").agg(F.avg("v").alias("at"), F.count("*").alias("w"))
    grid = df.sparkSession.range(points).select((F.lit(row.lo) + F.col("id") * (span / (points - 1))).alias("x"), F.floor(F.col("id") * (span / (points - 1)) / (h / bins_per_bandwidth)).alias("home"))
    # a kernel reaches 9 bandwidths; bins and grid points meet in stretches of that width and the two beside
    reach = 9 * bins_per_bandwidth
    bins = weights.withColumn("near", F.explode(F.array(*[F.floor(F.col("key") / reach) + d for d in (-1, 0, 1)])))
    pairs = bins.join(F.broadcast(grid.withColumn("near", F.floor(F.col("home") / reach))), "near")  # ``points`` rows
    u = (F.col("x") - F.col("at")) / h
    sums = pairs.groupBy("x").agg((F.sum(F.col("w") * F.exp(-u * u / 2)) / (row.n * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))
    return grid.select("x").join(F.broadcast(sums), "x", "left").select("x", F.coalesce("density", F.lit(0.0)).alias("density"))


def _clipped(df: DataFrame, columns: list[str], factor: float = 3.0) -> list[Column]:
    found = exact_quantiles(df, columns, [0.25, 0.75])
    quartiles = {c: (found[c, 0.25], found[c, 0.75]) for c in columns}
    limits = {c: (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in quartiles.items() if a is not None and b > a}

    def clip(c: str) -> Column:
        v = number(df, c)
        return F.when(v.isNotNull(), F.greatest(F.lit(limits[c][0]), F.least(F.lit(limits[c][1]), v))) if c in limits else v

    return [clip(c) for c in columns]


def winsorised(df: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """Columns clipped to the quartiles less and plus ``factor`` times their distance, where that isn't 0."""
    return df.withColumns(dict(zip(columns, _clipped(df, columns, factor), strict=True)))


def _paired(df: DataFrame, parts: list[list[str]], names: list[str]) -> DataFrame:
    """part, column1, column2, correlation with the columns' ``names``."""
    of = F.array(*[F.lit(n) for n in names])
    return correlations_of(df, parts).select("part", F.get(of, "a").alias("column1"), F.get(of, "b").alias("column2"), "correlation")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column1, column2, correlation of each pair of columns over the rows that have both; NULL where one
    doesn't vary. One pass over the rows for all pairs."""
    columns = columns or feature_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string, correlation double")
    return _paired(df, [columns], columns).drop("part")


def correlation_comparison(df: DataFrame, columns: list[str] | None = None, noted: float = 0.2) -> DataFrame:
    """Correlations of winsorised and of raw columns, from one pass, their absolute difference, and whether it is over ``noted``."""
    columns = columns or feature_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string, corr_filtered double, corr_original double, abs_diff double, noted boolean")
    both = df.select(*[quoted(c).alias(f"raw{k}") for k, c in enumerate(columns)], *[clip.alias(f"clip{k}") for k, clip in enumerate(_clipped(df, columns))])
    found = _paired(both, [[f"{p}{k}" for k in range(len(columns))] for p in ("raw", "clip")], columns)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("correlation")))
    wide = found.groupBy("column1", "column2").agg(of(1).alias("corr_filtered"), of(0).alias("corr_original"))
    difference = F.abs(F.col("corr_filtered") - F.col("corr_original"))
    return wide.select("column1", "column2", "corr_filtered", "corr_original", difference.alias("abs_diff"), F.coalesce(difference > noted, F.lit(False)).alias("noted"))


def strongest_correlations(correlated: DataFrame, k: int = 5) -> DataFrame:
    """The k pairs with the greatest absolute correlation below 1."""
    size = F.abs("correlation")
    return correlated.filter(size < 1).select("column1", "column2", "correlation", size.alias("abs_correlation")).orderBy(F.desc("abs_correlation"), "column1", "column2").limit(k)


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2, n."""
    a, b = number(df, x), number(df, y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def structure(df: DataFrame) -> DataFrame:
    """ordinal, name, dtype, non_null_count, null_pct of each column."""
    fields = df.schema.fields
    row = df.agg(F.count("*").alias("n"), *[F.count_if(~is_null(quoted(f.name), f.dataType)).alias(f"f{k}") for k, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"f{k}").alias("non_null_count")) for k, f in enumerate(fields)])
    return row.select("n", F.inline(cells)).select("ordinal", "name", "dtype", "non_null_count", percent(F.col("n") - F.col("non_null_count"), F.col("n")).alias("null_pct"))


#: Bytes of a filled cell of each type of fixed width.
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}


def structure_size(df: DataFrame) -> DataFrame:
    """ordinal, name, bytes: what the filled cells of each column hold: numbers, dates and booleans their width, decimals 8 up to 18
    digits and 16 beyond, texts and binary their octets, all else the octets of its JSON form. An empty table: 0."""
    sizes = []
    for f in df.schema.fields:
        c, kind = quoted(f.name), f.dataType
        if isinstance(kind, T.NullType):
            size = F.lit(None)
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(kind, T.DecimalType) or type(kind) in WIDTHS:
            size = F.when(c.isNotNull(), F.lit((8 if kind.precision <= 18 else 16) if isinstance(kind, T.DecimalType) else WIDTHS[type(kind)]))
        else:
            size = F.when(c.isNotNull(), F.octet_length(F.to_json(F.struct(c.alias("v")))) - len('{"v":}'))
        sizes.append(F.coalesce(F.sum(size.cast("long")), F.lit(0)).cast("long").alias(f"b{len(sizes)}"))
    cells = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(f.name).alias("name"), F.col(f"b{k}").alias("bytes")) for k, f in enumerate(df.schema.fields)])
    return df.agg(*sizes).select(F.inline(cells))


def dataset_summary(df: DataFrame) -> DataFrame:
    """metric, value: rows, columns, numeric and categorical columns, missing cells, duplicate rows, and their shares."""
    missing = F.lit(0)
    for f in df.schema.fields:
        missing = missing + F.count_if(is_null(quoted(f.name), f.dataType))
    counts = df.agg(missing.alias("missing")).crossJoin(exact_duplicates(df))  # one row each
    width, rows = len(df.columns), F.col("total_rows")
    booleans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    metrics = {
        "Total Rows": rows, "Total Columns": F.lit(width), "Numeric Columns": F.lit(len(numeric_columns(df))), "Categorical Columns": F.lit(len(string_columns(df)) + len(booleans)),
        "Missing Values": F.col("missing"), "Missing %": percent(F.col("missing"), rows * width), "Duplicate Rows": F.col("duplicate_count"), "Duplicate %": F.col("duplicate_pct"),
    }
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])))


def categorical_summary(df: DataFrame) -> DataFrame:
    """unique_count, top_value, top_count, null_count of each text column."""
    freq = frequencies(df)
    top = top_values(freq, 1, with_nulls=False).select("column", F.col("value").alias("top_value"), F.col("cnt").alias("top_count"))
    counts = distinct_counts(freq)
    return counts.join(top, "column", "left").select("column", F.col("n_unique").alias("unique_count"), "top_value", "top_count", (F.col("total") - F.col("non_null")).alias("null_count"))


def quality_light(missing_pct: Column, duplicates: Column) -> Column:
    """good, warning or poor: the missing percentage plus 100 times the duplicates is under 10, under 30, or more."""
    score = missing_pct + duplicates * 100
    return F.when(score < 10, "good").when(score < 30, "warning").otherwise("poor")
