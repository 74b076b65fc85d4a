"""Exact quantiles of whole columns without a task that holds a column.

A sketch brackets the values at the wanted ranks, one aggregation counts what lies below and inside the
brackets, and only the different values inside are counted and ranked. A bracket that
still holds many rows is narrowed by another sketch of its own rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted

#: Relative rank error of a sketch, and the rows that a bracket may hold to be ranked.
ACCURACY = 10_000
MOST_ROWS = 100_000


def number(df: DataFrame, column: str) -> Column:
    """A numeric column as double, NaN as NULL."""
    c = quoted(column).cast("double")
    return F.when(~F.isnan(c), c)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *, accuracy: int = ACCURACY, most_rows: int = MOST_ROWS) -> dict[tuple[str, float], float | None]:
    """The linearly interpolated quantile of each column and probability; None for a column without numbers.
    What reaches the driver is a few numbers for each."""
    return quantiles_with(df, columns, probabilities, [], accuracy=accuracy, most_rows=most_rows)[0]


def quantiles_with(
    df: DataFrame, columns: list[str], probabilities: list[float], others: list[Column], *, accuracy: int = ACCURACY, most_rows: int = MOST_ROWS,
) -> tuple[dict[tuple[str, float], float | None], Row | None]:
    """The exact quantiles, and a row of other aggregates from the first pass, which counts and takes the first sketches, one for each column."""
    values = {c: number(df, c) for c in columns}
    keys = [(c, p) for c in columns for p in probabilities]
    if not keys:
        return {}, df.agg(*others).first() if others else None
    around = F.array(*[F.lit(min(1.0, max(0.0, p + by))) for p in probabilities for by in (-3 / accuracy, 3 / accuracy)])
    first = [a for k, c in enumerate(columns) for a in (F.count(values[c]).alias(f"__n{k}"), F.percentile_approx(values[c], around, accuracy).alias(f"__s{k}"))]
    counts = df.agg(*others, *first).first()
    n = {c: counts[f"__n{k}"] for k, c in enumerate(columns)}
    live = [key for key in keys if n[key[0]]]
    rank = {(c, p): p * (n[c] - 1) for c, p in live}
    bracket: dict[tuple[str, float], tuple[float, float]] = {key: (-math.inf, math.inf) for key in live}
    below, inside, settled = dict.fromkeys(live, 0), {key: n[key[0]] for key in live}, set()
    ready = {(c, p): counts[f"__s{k}"][2 * j : 2 * j + 2] for k, c in enumerate(columns) for j, p in enumerate(probabilities) if n[c]}

    def within(key) -> Column:
        lo, hi = bracket[key]
        return values[key[0]].between(F.lit(lo), F.lit(hi))

    def wide(key) -> bool:
        return bracket[key][0] < bracket[key][1] and inside[key] > most_rows and key not in settled

    while any(wide(key) for key in live):
        asked = [key for key in live if wide(key)]
        if ready:
            sketches, ready = [ready[key] for key in asked], {}
        else:
            shares = [[min(1.0, max(0.0, (at - below[key]) / max(1, inside[key] - 1) + by)) for at, by in ((math.floor(rank[key]), -2 / accuracy), (math.floor(rank[key]) + 1, 2 / accuracy))] for key in asked]
            sketches = df.agg(*[F.percentile_approx(F.when(within(key), values[key[0]]), F.array(*[F.lit(s) for s in share]), accuracy).alias(f"s{k}") for k, (key, share) in enumerate(zip(asked, shares, strict=True))]).first()
        before = {key: (bracket[key], below[key], inside[key]) for key in asked}
        for k, key in enumerate(asked):
            bracket[key] = (float(sketches[k][0]), float(sketches[k][1]))
        row = df.agg(*[f for k, key in enumerate(asked) for f in (F.count_if(values[key[0]] < F.lit(bracket[key][0])).alias(f"b{k}"), F.count_if(within(key)).alias(f"i{k}"))]).first()
        for k, key in enumerate(asked):
            under, among = row[f"b{k}"], row[f"i{k}"]
            last = min(math.floor(rank[key]) + 1, n[key[0]] - 1)
            if under <= math.floor(rank[key]) and last < under + among and among < before[key][2]:
                below[key], inside[key] = under, among
            else:  # the sketch missed, or can't part these values further
                (bracket[key], below[key], inside[key]), _ = before[key], settled.add(key)

    cells = F.array(*[F.when(within(key), F.struct(F.lit(k).alias("key"), values[key[0]].alias("v"))) for k, key in enumerate(live)])
    if not live:
        return dict.fromkeys(keys), counts
    counted = df.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("key", "v").agg(F.count("*").alias("cnt"))
    of_key = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), F.col("key"))
    upto = F.sum("cnt").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + of_key([below[key] for key in live])
    ranks = [(math.floor(rank[key]), min(math.floor(rank[key]) + 1, n[key[0]] - 1)) for key in live]
    picked = counted.select("key", "v", upto.alias("upto")).groupBy("key").agg(
        F.min(F.when(F.col("upto") > of_key([lo for lo, _ in ranks]), F.col("v"))).alias("lo"), F.min(F.when(F.col("upto") > of_key([hi for _, hi in ranks]), F.col("v"))).alias("hi"),
    )
    found: dict[tuple[str, float], float | None] = dict.fromkeys(keys)
    for r in picked.collect():  # one row for each column and probability
        key = live[r.key]
        found[key] = r.lo + (rank[key] - math.floor(rank[key])) * (r.hi - r.lo)
    return found, counts
