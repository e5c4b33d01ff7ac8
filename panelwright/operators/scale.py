"""Min-max scaling fitted on training rows. A constant column scales to 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_bounds(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with {feature}_min and {feature}_max for all features."""
    return train.agg(
        *[F.min(F.col(f).cast("double")).alias(f"{f}_min") for f in features],
        *[F.max(F.col(f).cast("double")).alias(f"{f}_max") for f in features],
    )


def fit_minmax(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """{feature: (min, max)}: the single row of bounds, as numbers for any later frame."""
    if not features:
        return {}
    row = column_bounds(train, features).first()
    return {f: (row[f"{f}_min"], row[f"{f}_max"]) for f in features}


def minmax_scale(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Scale the fitted columns; all others pass through. Test values may leave [0, 1]."""

    def scaled(name: str):
        low, high = bounds[name]
        if low is None:
            return F.lit(None).cast("double").alias(name)
        return ((F.col(name).cast("double") - F.lit(low)) / F.lit((high - low) or 1.0)).alias(name)

    return df.select(*[scaled(c) if c in bounds else F.col(c) for c in df.columns])
