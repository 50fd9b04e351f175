"""Resuming, caches and splits as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remaining(samples: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Samples whose id is not done yet; of these the first ``most`` in the order of their lines."""
    rest = samples.join(done.select("id").distinct(), "id", "left_anti")
    return rest if most is None else rest.orderBy("line_no").limit(most)


def latest_of_each(cache: DataFrame, order: str) -> DataFrame:
    """The last row of each id."""
    best = cache.groupBy("id").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "id"]), order).alias("r"))
    return best.select("id", "r.*")


def fill_cache(pairs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Reference log-probabilities of all pairs: those in the cache, and those that ``compute`` gives for the others.

    Returns pairs with ref_chosen_logp and ref_rejected_logp, and the merged cache. Every pair must get a value.
    """
    names = ["id", "ref_chosen_logp", "ref_rejected_logp"]
    missing = pairs.join(cache.select("id"), "id", "left_anti")
    merged = cache.select(names).unionByName(compute(missing).select(names))
    checked = [F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("no reference log-probability for "), F.col("id").cast("string")))).alias(c) for c in names[1:]]
    filled = pairs.join(merged, "id", "left").select(*pairs.columns, *checked)
    return filled, merged


def split_rank(data: DataFrame, seed: int, id_col: str = "id", spread: int = 256) -> DataFrame:
    """``data`` with split_rank: the place of each row by the digest of seed and id, from 1, found without one task
    that sees all rows: rows are ranked within ``spread`` ranges of the digest and the ranges' counts are added up."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = data.withColumn("_digest", digest).withColumn("_range", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # 256 rows at most
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_digest", id_col))
    return keyed.join(F.broadcast(before), "_range").withColumn("split_rank", rank).drop("_digest", "_range", "_before")


def split_train_eval(data: DataFrame, ratio: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``data`` with ``part``: eval for the first floor(n * ratio) rows in the order of a seeded digest, else train."""
    if ratio <= 0:
        return data.withColumn("part", F.lit("train"))
    n = data.agg(F.count(F.lit(1)).alias("_n"))
    ranked = split_rank(data, seed, id_col).join(F.broadcast(n))
    return ranked.withColumn("part", F.when(F.col("split_rank") <= F.floor(F.col("_n") * F.lit(ratio)), "eval").otherwise("train")).drop("split_rank", "_n")
