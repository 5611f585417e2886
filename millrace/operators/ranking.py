"""Exact ranks within groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import shuffle_partitions


def uniform(key: Column, seed: Column | int) -> Column:
    """A number in [0, 1) from the SHA-256 of "seed:key" (its first 52 bits); the same on every run and partitioning."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def group_ranks(
    rows: DataFrame, groups: list[str], value: str, ties: list[str], buckets: int | None = None, name: str = "rank", at_most: Column | None = None
) -> DataFrame:
    """row_number over (partition by groups order by value, ties) for a value spread evenly over [0, 1).

    The value's range is cut into buckets; a row's rank is the number of rows in the buckets before it, from one aggregate of
    groups x buckets rows, plus its place in its own bucket. So a group is sorted by `buckets` tasks (four times the shuffle
    partitions and at least 64, unless given). With `at_most` only ranks up to it are returned, and rows of buckets that lie
    beyond it are left out before anything is shuffled. Null groups are groups.
    """
    buckets = buckets or max(64, 4 * shuffle_partitions(rows.sparkSession))
    cut = rows.withColumn("__bucket", F.floor(F.col(value) * buckets).cast("int"))
    counts = cut.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *(F.col(g).alias(f"__g_{g}") for g in groups), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    same = F.col("__bucket") == F.col("__b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    placed = cut.join(starts, same).drop("__b", *(f"__g_{g}" for g in groups))
    if at_most is not None:
        placed = placed.where(F.col("__before") < at_most)
    inside = Window.partitionBy(*groups, "__bucket").orderBy(value, *ties)
    ranked = placed.withColumn(name, F.col("__before") + F.row_number().over(inside)).drop("__bucket", "__before")
    return ranked if at_most is None else ranked.where(F.col(name) <= at_most)
