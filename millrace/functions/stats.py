"""Statistics as column expressions: Wilson interval, exact McNemar test, Holm adjustment, rates that survive empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def mean_or_zero(value: Column) -> Column:
    """Mean of the non-null values, 0 without any."""
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def true_rate(flag: Column) -> Column:
    """Share of rows whose flag is true; null counts as false."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, clamped to [0, 1]; null where the total is not positive."""
    n = F.when(total > 0, total.cast("double"))
    share = successes.cast("double") / n
    spread = F.lit(z) * F.sqrt(share * (1 - share) / n + F.lit(z * z) / (4 * n * n))
    middle, scale = share + F.lit(z * z) / (2 * n), 1 + F.lit(z * z) / n
    return F.when(total > 0, F.greatest(F.lit(0.0), (middle - spread) / scale)), F.when(total > 0, F.least(F.lit(1.0), (middle + spread) / scale))


def mcnemar(improved: Column, regressed: Column) -> Column:
    """Two-sided exact McNemar p value from the counts of discordant pairs; 1 without any.

    Terms C(n,k)/2^n are built from logarithms of the running product, so large n does not underflow.
    """
    n, least = (improved + regressed).cast("int"), F.least(improved, regressed).cast("int")
    start = F.struct((-n * F.lit(0.6931471805599453)).alias("log_term"), F.exp(-n * F.lit(0.6931471805599453)).alias("total"))

    def step(state: Column, k: Column) -> Column:
        log_term = state["log_term"] + F.ln((n - k + 1).cast("double")) - F.ln(k.cast("double"))
        return F.struct(log_term.alias("log_term"), (state["total"] + F.exp(log_term)).alias("total"))

    ks = F.when(least >= 1, F.sequence(F.lit(1), F.greatest(least, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(ks, start, step, lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(rows: DataFrame, p: str, key: str, into: str = "p_adjusted", family: list[str] | None = None) -> DataFrame:
    """Step-down Holm adjustment within a family of tests: running maximum of min(1, (m - i) p) over ascending p, ties by key.

    A family is a handful of tests; its window is over results, not data. Null p values stay null and are not counted.
    """
    group = family or []
    whole = Window.partitionBy(*group)
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last(p), key)
    scaled = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (F.count(p).over(whole) - F.row_number().over(order) + 1) * F.col(p)))
    held = rows.withColumn("_scaled", scaled)
    running = F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.withColumn(into, F.when(F.col(p).isNotNull(), running)).drop("_scaled")
