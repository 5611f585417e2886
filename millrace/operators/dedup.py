"""First-wins, last-wins and conflict-aware deduplication, and exclusion by id or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text_hash


def _packed(rows: DataFrame) -> Column:
    return F.struct(*rows.columns)


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of every key by the order columns (which must be unique together).

    min_by combines before the shuffle: a key that holds a third of the rows is one row per task, not a sorted group.
    """
    kept = rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(_packed(rows), F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def last_wins(rows: DataFrame, key: str, order: list[str], position: str | None = None) -> DataFrame:
    """The last row of every key; with `position` also the smallest order value of the key, its original place."""
    aggregates = [F.max_by(_packed(rows), F.struct(*order)).alias("_row")]
    if position:
        aggregates.append(F.min(order[0]).alias(position))
    kept = rows.groupBy(F.col(key).alias("_key")).agg(*aggregates)
    return kept.select("_row.*", *([position] if position else []))


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Current rows with updates over them: rows of updates replace those with the same key, others are added."""
    order = current.withColumn("_age", F.lit(0)).unionByName(updates.withColumn("_age", F.lit(1)))
    return last_wins(order, key, ["_age"]).drop("_age")


def conflicting_keys(rows: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, rows, versions): how often each key occurs and with how many different values of the compared columns.

    Versions are counted as different hashes of the whole compared record, nulls included.
    """
    version = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in compared))
    once = rows.select(key, version.alias("_v")).groupBy(key, "_v").agg(F.count("*").alias("_n"))
    return once.groupBy(key).agg(F.sum("_n").alias("rows"), F.count("*").alias("versions"))


def unique_pool(rows: DataFrame, key: str, compared: list[str], order: list[str]) -> DataFrame:
    """First row of every key whose rows all agree in the compared columns; keys with conflicting rows are dropped whole."""
    agreed = conflicting_keys(rows, key, compared).where("versions = 1").select(F.col(key).alias("_agreed"))
    first = first_wins(rows, F.col(key), order)
    return first.join(agreed, first[key] == F.col("_agreed"), "left_semi")


def exclude_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table does not hold (the resume pattern). Null keys stay."""
    return rows.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def candidate_ids(columns: list[Column]) -> Column:
    """Different ids a row may be known by: the columns themselves and their prefix before the first colon; no nulls or blanks."""
    both = [c.cast("string") for c in columns] + [F.split_part(c.cast("string"), F.lit(":"), F.lit(1)) for c in columns]
    return F.array_distinct(F.filter(F.array(*both), lambda x: x.isNotNull() & (F.trim(x) != "")))


def exclude_known(candidates: DataFrame, forbidden: DataFrame, key: str, text: str, hashed=text_hash) -> DataFrame:
    """Candidates that share neither an id nor a normalised text with the forbidden rows.

    Two anti joins, since an OR condition would force a nested loop. Texts without word characters exclude each other.
    """
    ids = forbidden.select(F.explode(candidate_ids([F.col(key)])).alias("_id")).distinct()
    texts = forbidden.where(F.col(text).isNotNull()).select(hashed(F.col(text)).alias("_hash")).distinct()
    keyed = candidates.withColumn("_hash", hashed(F.col(text)))
    left = keyed.join(ids, keyed[key] == ids["_id"], "left_anti")
    return left.join(texts, "_hash", "left_anti").drop("_hash")
