"""Reproducible sample that stays as data grows: salted key hashes under per-stratum thresholds that only ever rise.

A record is chosen when the hash of its key, salted with the plan's seed, lies under the threshold of its stratum. The hash needs
nothing but key and seed, so reruns, partitionings and order do not matter.

Thresholds are fixed rates once they are drawn: `thresholds` takes those of earlier runs (`earlier`, a table of plan, stratum,
batch, threshold that the caller keeps and gives back) and returns them with the new batches added. The threshold after batch b is
    the greatest, over b' <= b, of the earlier threshold of b' and of min(1, target * b' / planned_batches / keys arrived by b')
so it follows a pace towards the target and never falls, neither from batch to batch nor from run to run. Rows that arrive late in
a batch already drawn, redeliveries under an earlier batch, and deleted rows change no earlier threshold and lose no earlier
choice; they can only raise one. Without `earlier` the rates are those of a first run over all the rows.

Defined cases: null keys are never chosen; a key delivered several times counts once, from its first batch; a null batch counts
as the last one planned; a key in neither family is in the family omni; null plan ids are left out, a null seed is 0; an empty table gives no rows
and keeps the earlier thresholds; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import uniform

PLANNED_BATCHES = 12
LEVELS = "plan int, stratum string, batch int, threshold double"


def family_of(column: str) -> Column:
    return F.when(F.col(column).startswith("medium_"), F.lit("medium")).otherwise(F.lit("omni"))


def stratum_keys(records: DataFrame, planned_batches: int = PLANNED_BATCHES) -> DataFrame:
    """(key, stratum, batch): every different id of (id, batch_no) with its first batch."""
    first = records.where("id is not null").groupBy("id").agg(F.min(F.coalesce("batch_no", F.lit(planned_batches))).alias("batch"))
    return first.select(F.col("id").alias("key"), family_of("id").alias("stratum"), "batch")


def plan_targets(manifest: DataFrame) -> DataFrame:
    """(plan, seed, stratum, target) of every plan and family."""
    families = F.array(
        *(F.struct(F.lit(f).alias("stratum"), F.coalesce(F.col(f"{f}_target"), F.lit(0)).cast("double").alias("target")) for f in ("medium", "omni"))
    )
    return manifest.where("manifest_id is not null").select(
        F.col("manifest_id").alias("plan"),
        F.coalesce("selection_seed", F.lit(0)).alias("seed"),
        F.explode(families).alias("t"),
    ).select("plan", "seed", "t.*")


def thresholds(keys: DataFrame, targets: DataFrame, planned_batches: int = PLANNED_BATCHES, earlier: DataFrame | None = None) -> DataFrame:
    """(plan, stratum, batch, threshold) from different keys (key, stratum, batch), targets (plan, stratum, target) and earlier thresholds.

    The aggregate has a row per stratum and batch, so its windows stay small at any data size.
    """
    arrived = keys.groupBy("stratum", "batch").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("stratum").orderBy("batch")
    pool = arrived.select("stratum", "batch", F.sum("n").over(so_far).alias("pool"))
    pace = F.col("target") * F.least(F.col("batch"), F.lit(planned_batches)) / F.lit(float(planned_batches)) / F.col("pool")
    rates = pool.join(targets.select("plan", "stratum", "target"), "stratum").select("plan", "stratum", "batch", F.least(F.lit(1.0), pace).alias("threshold"))
    if earlier is not None:
        rates = rates.unionByName(
            earlier.select("plan", "stratum", "batch", "threshold")
        ).groupBy("plan", "stratum", "batch").agg(F.max("threshold").alias("threshold"))
    rising = Window.partitionBy("plan", "stratum").orderBy("batch")
    return rates.select("plan", "stratum", "batch", F.max("threshold").over(rising).alias("threshold"))


def stable_sample(
    records: DataFrame, manifest: DataFrame, planned_batches: int = PLANNED_BATCHES, earlier: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The sample (manifest_id, id, family, batch_no, chosen_at) of (id, batch_no), and the thresholds to give back next time as `earlier`.

    chosen_at is the first batch, from that of the key on, whose threshold the key's hash lies under. Plans join by family; the side
    of the plans is as small as its table, which AQE measures.
    """
    targets, keys = plan_targets(manifest), stratum_keys(records, planned_batches)
    levels = thresholds(keys, targets, planned_batches, earlier)
    steps = levels.groupBy("plan", "stratum").agg(F.sort_array(F.collect_list(F.struct("batch", "threshold"))).alias("steps"))
    drawn = keys.join(targets.select("plan", "seed", "stratum"), "stratum").withColumn("u", uniform(F.col("key"), F.col("seed"))).drop("seed")
    sample = (
        drawn.join(steps, ["plan", "stratum"])  # after the hash, which is then made once a key and plan and not once a step
        .withColumn("chosen_at", F.try_element_at(F.expr("filter(steps, s -> s.batch >= batch and s.threshold > u)"), F.lit(1))["batch"])
        .where("chosen_at is not null")
        .select(F.col("plan").alias("manifest_id"), F.col("key").alias("id"), F.col("stratum").alias("family"), F.col("batch").alias("batch_no"), "chosen_at")
    )
    return sample, levels


def kept_and_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """(manifest_id, family, kept, lost, added) of two samples of (manifest_id, id, family)."""
    keys = ["manifest_id", "family", "id"]
    both = before.select(*keys, F.lit(1).alias("was")).join(after.select(*keys, F.lit(1).alias("now")), keys, "full")
    return both.groupBy("manifest_id", "family").agg(
        F.count_if(F.expr("was = 1 and now = 1")).alias("kept"),
        F.count_if(F.expr("was = 1 and now is null")).alias("lost"),
        F.count_if(F.expr("was is null and now = 1")).alias("added"),
    )
