"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr: Column, alias: str, *keep: str, pos: str | None = None) -> DataFrame:
    """``explode`` of a computed array without Catalyst's inferred ``size(arr) > 0`` filter: that filter would
    be pushed below a repartition and evaluate the whole (expensive) array expression a second time.
    Rows of empty or null arrays are dropped, exactly as ``explode`` drops them."""
    if pos is None:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
        return out.where(F.col(alias).isNotNull())
    out = df.select(*keep, F.posexplode_outer(arr).alias(pos, alias))
    return out.where(F.col(pos).isNotNull())
