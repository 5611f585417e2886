"""Sample matching target category proportions: divisor-method priorities over seeded random ranks.

Every record of a category gets a random rank; its priority is (rank - 0.5) / target share, records within the category's floor
come before all others, and the smallest priorities of a family are kept until its target is full. That is the Webster/
Sainte-Laguë apportionment: seats that an exhausted category cannot fill go to the others by themselves.

Priorities of a category rise with its rank, so the smallest of a family are the first ranks of each category: `seats` finds from
the counts alone how many of each, and the sample is all ranks up to that. No order over a family is ever sorted. Ranks come from
group_ranks, so no category is sorted in one task, and records beyond what can be asked are left out before the shuffle.

Plans and categories are joined by family and band, never collected, so any number of them works. The report counts what the
ranking really gave: `filled` is the number of ranks up to the request that exist, shortfall what is missing to it.

Defined cases: null keys and null plan ids are left out; a key that occurs several times counts once, with the difficulty of the
delivery that has a number (a record keeps its value, not its spelling), else unrated; empty tables give an empty sample and a
report of shortfalls; a null target, floor or seed is 0, a null or zero share comes after all others; a band without a name or given twice counts not
at all or once; ties in a priority go to the
category, then the rank; other columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import group_ranks, uniform


def difficulty_number(column: str | Column) -> Column:
    """The first number in a difficulty, with a point or comma as decimal mark and any text around it; null without one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.replace(F.nullif(F.regexp_extract(column, r"\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def _stripped(column: str) -> Column:
    """Without white space at both ends, Unicode's separators included."""
    return F.regexp_replace(column, f"^{BLANK}+|{BLANK}+$", "")


def pools(problems: DataFrame, omni: DataFrame) -> DataFrame:
    """(family, key, number): the different available records of both families with their difficulty number."""
    medium = problems.where(F.col("id").startswith("medium_") & (_stripped("text") != "")).select(
        F.lit("medium").alias("family"), F.col("id").alias("key"), difficulty_number("difficulty").alias("number")
    )
    full = (_stripped("problem") != "") & (_stripped("solution") != "") & (_stripped("answer") != "")
    other = omni.where(full).select(F.lit("omni").alias("family"), _stripped("problem").alias("key"), difficulty_number("difficulty").alias("number"))
    return medium.unionByName(other).groupBy("family", "key").agg(F.max("number").alias("number"))


def bands_of(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Records (family, key, number) with the band of their family that holds the number, else the band without limits.

    The bands of a family join as one array, so a record meets one row; records that no band holds are left out.
    """
    rated = F.col("difficulty_from").isNotNull() & ~F.isnan("difficulty_from")
    limits = targets.where("family is not null and band is not null").select(
        "family",
        F.struct(F.when(rated, F.col("difficulty_from")).alias("low"), F.when(rated, F.col("difficulty_below")).alias("high"), "band").alias("b"),
    )
    known = limits.groupBy("family").agg(F.sort_array(F.collect_list("b")).alias("bands"))
    holds = F.filter(
        "bands",
        lambda b: F.when(F.col("number").isNull(), b["low"].isNull()).otherwise((F.col("number") >= b["low"]) & (F.col("number") < b["high"])),
    )
    return records.join(known, "family").withColumn("band", F.try_element_at(holds, F.lit(1))["band"]).where("band is not null").select("family", "key", "band")


def requests(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """(manifest_id, seed, family, band, target, target_share, floor, requested) of every plan and band of its families."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    plan = manifest.where("manifest_id is not null").select(
        "manifest_id", F.coalesce("selection_seed", F.lit(0)).alias("seed"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("family"), zero(f"{f}_target").alias("target")) for f in ("medium", "omni")))).alias("t"),
    ).select("manifest_id", "seed", "t.*")
    named = targets.where("family is not null and band is not null").groupBy("family", "band").agg(
        F.min(F.struct("target_share", zero("min_rows").alias("floor"))).alias("b")
    )
    asked = plan.join(named.select("family", "band", "b.*"), "family")
    wanted = F.greatest(F.col("floor").cast("bigint"), F.floor(F.coalesce("target_share", F.lit(0.0)) * F.col("target") + 0.5))
    return asked.withColumn("requested", wanted)


def _smallest(ranges: list[tuple[str, int, int, float]], wanted: int) -> dict[str, int]:
    """How far into each range (band, low, high, share) the `wanted` smallest priorities (rank - 0.5) / share reach."""
    reached = {band: low for band, low, _, _ in ranges}
    if sum(high - low for _, low, high, _ in ranges) <= wanted:
        return {band: high for band, _, high, _ in ranges}
    rated = [r for r in ranges if r[3] > 0]
    count = lambda p: sum(min(high, max(low, int(p * share + 0.5))) - low for _, low, high, share in rated)
    under, over = 0.0, max(((high + 1) / share for _, _, high, share in rated), default=0.0)
    for _ in range(100):
        middle = (under + over) / 2
        under, over = (middle, over) if count(middle) <= wanted else (under, middle)
    under *= 1 - 1e-9  # the last few, where rounding may decide, are taken one by one
    for band, low, high, share in rated:
        reached[band] = min(high, max(low, int(under * share + 0.5)))
    left = wanted - sum(reached[band] - low for band, low, _, _ in ranges)
    ends = {band: (high, share) for band, _, high, share in ranges}
    order = lambda band, rank: ((rank - 0.5) / ends[band][1] if ends[band][1] > 0 else float("inf"), band, rank)
    heap = [order(band, reached[band] + 1) for band in reached if reached[band] < ends[band][0]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, band, rank = heapq.heappop(heap)
        reached[band], left = rank, left - 1
        if rank < ends[band][0]:
            heapq.heappush(heap, order(band, rank + 1))
    return reached


def seats(bands: list[tuple[str, int, float, int]], target: int) -> dict[str, int]:
    """Seats of each band (band, available, share, floor): floors first, then the smallest priorities, `target` in all."""
    floors = {band: min(floor, available) for band, available, _, floor in bands}
    if sum(floors.values()) >= target:
        return _smallest([(band, 0, floors[band], share) for band, _, share, _ in bands], target)
    return _smallest([(band, floors[band], available, share) for band, available, share, _ in bands], target - sum(floors.values()))


def _seated(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one plan and family with their seats; one row a band, so a group is as small as the list of bands."""
    share = rows["target_share"].fillna(0.0)
    got = seats(list(zip(rows["band"], rows["available"].astype(int), share, rows["floor"].astype(int), strict=True)), int(rows["target"].iloc[0]))
    return rows.assign(seats=rows["band"].map(got).astype("int64"))


def proportional_sample(problems: DataFrame, omni: DataFrame, manifest: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sample (manifest_id, family, band, key, rank, floor_row) and the report per plan and band:
    (manifest_id, family, band, available, requested, filled, selected, shortfall, share, target_share)."""
    asked = requests(manifest, targets)
    records = bands_of(pools(problems, omni), targets)
    available = records.groupBy("family", "band").agg(F.count("*").alias("available"))
    counted = asked.join(available, ["family", "band"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema.fields) + ", seats bigint"
    placed = counted.groupBy("manifest_id", "family").applyInPandas(_seated, schema)
    drawn = records.join(placed.select("manifest_id", "seed", "family", "band", "floor", "requested", "seats"), ["family", "band"])
    drawn = drawn.withColumn("u", uniform(F.col("key"), F.col("seed"))).drop("seed")
    ranked = group_ranks(drawn, ["manifest_id", "family", "band"], "u", ["key"], at_most=F.greatest("seats", "requested"))
    sample = ranked.where("rank <= seats").select("manifest_id", "family", "band", "key", "rank", (F.col("rank") <= F.col("floor")).alias("floor_row"))
    return sample, shortfall_report(ranked, placed)


def shortfall_report(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """Per plan and band what is available, requested, filled by the ranking and selected; shortfall is what is missing to the request."""
    keys = ["manifest_id", "family", "band"]
    given = ranked.groupBy(*keys).agg(
        F.count_if(F.col("rank") <= F.col("requested")).alias("filled"),
        F.count_if(F.col("rank") <= F.col("seats")).alias("selected"),
    )
    size = Window.partitionBy("manifest_id", "family")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("filled", "selected")}
    return (
        placed.join(given, keys, "left")
        .withColumns(none)
        .withColumns(
            {"shortfall": F.col("requested") - F.col("filled"), "share": F.coalesce(F.try_divide(F.col("selected"), F.sum("selected").over(size)), F.lit(0.0))}
        )
        .select(*keys, "available", "requested", "filled", "selected", "shortfall", "share", "target_share")
    )
