"""Semi and anti joins on key tables.

No hint is given: the planner broadcasts the key side only if its estimated size is under
``spark.sql.autoBroadcastJoinThreshold``, and AQE plans again from measured shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def semi_join_ids(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """``df LEFT SEMI JOIN keys``."""
    return df.join(keys, on, "left_semi")


def anti_join_ids(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """``df LEFT ANTI JOIN keys`` (NOT EXISTS)."""
    return df.join(keys, on, "left_anti")
