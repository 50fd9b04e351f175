"""What depends on a few columns alone is computed once for each of their combinations, not once a row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stash

#: Combinations in a task.
PORTION = 2000


def once_each(rows: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(rows)``, for a ``derive`` that adds columns and looks at ``keys`` only.

    The distinct combinations of the keys are counted and staged. Where there are at most half as many as rows, they
    alone are derived, and joined back; Spark broadcasts them when their files are small. Otherwise each row is derived
    in its place. Both give the same rows. Keys must have the same values each time that they are computed.
    """
    counted = stash(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "kinds")
    kinds, n = counted.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if not n or 2 * kinds > n:
        return derive(rows)
    tasks = min(kinds, max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(kinds / PORTION)))
    made = stash(derive(counted.drop("_rows").repartition(tasks)), "derived")
    added = [c for c in made.columns if c not in keys]
    there = made.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *added)
    here = rows.drop(*added)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return here.join(there, same, "left").select(*here.columns, *added)
