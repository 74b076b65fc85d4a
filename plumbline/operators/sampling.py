"""Sampling, for those who ask for it; no other operator samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.schema import quoted


def sample_rows(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer) without replacement, the same at every run: those whose key's
    digest with the seed comes first. ``key`` defaults to all columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (key or df.columns)]))
    return df.orderBy(digest, *[quoted(c) for c in (key or df.columns)]).limit(n)


def sample_fraction(df: DataFrame, fraction: float, *, at_least: int = 0, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, or about ``at_least`` rows where that is more."""
    if at_least:
        total = df.count()
        fraction = min(1.0, max(fraction, at_least / total)) if total else 1.0
    return df.sample(False, fraction, seed)
