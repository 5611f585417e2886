"""Deterministic selection: seeded hash order, largest-remainder quotas, round robin, splits, shards, quota backfill.

Every order is a hash of seed and id, ties by id, so results do not depend on partitioning. Quotas come from one aggregate of
strata; rows get their rank within a stratum from the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.constraints import require_count
from millrace.operators.ranking import group_ranks, uniform


def stable_hash(value: Column, seed: int) -> Column:
    """SHA-256 of "seed:value" in hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def seeded_order(rows: DataFrame, key: str, seed: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in hash order from `offset` on, at most `limit` of them (shuffle, then offset, then limit)."""
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("offset and limit must not be negative")
    out = rows.orderBy(stable_hash(F.col(key), seed), key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def ranked(rows: DataFrame, strata: list[str], key: str, seed: int, name: str = "rank", at_most: Column | None = None) -> DataFrame:
    """Rank of every row within its stratum in the order of a seeded uniform number of its key, exact at any stratum size; with
    `at_most` only the ranks up to it."""
    keyed = rows.withColumn("_u", uniform(F.col(key), seed))
    return group_ranks(keyed, strata, "_u", [key], name=name, at_most=at_most).drop("_u")


def tuple_text(columns: list[str]) -> Column:
    """The columns as the text of a tuple of strings, the form in which tie keys of strata are compared."""
    quoted = [F.concat(F.lit("'"), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("'")) for c in columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *quoted), F.lit(",)" if len(columns) == 1 else ")"))


def remainder_quotas(sizes: DataFrame, total: Column, ties: list[Column], fraction: float | None = None) -> DataFrame:
    """Largest-remainder quotas for strata (columns strata, n): floor of n * total / N (or n * fraction) each, the rest by descending
    remainder, then ties.

    `sizes` has one row per stratum, so its windows are small.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("n") * total / F.sum("n").over(everything) if fraction is None else F.col("n") * F.lit(fraction)
    cut = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    order = everything.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *ties)
    left = total - F.sum("_floor").over(everything)
    return cut.withColumn("quota", F.col("_floor") + (F.row_number().over(order) <= left).cast("int")).drop("_exact", "_floor")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: int, by_hash: bool = True) -> DataFrame:
    """Rows with `selected`: a sample of floor(N * fraction + 0.5) rows, each stratum by its share, by seeded rank within it.

    Equal remainders go by the seeded hash of the stratum's name, descending (`by_hash`), else by the stratum's name.
    """
    label = tuple_text(strata)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * F.lit(fraction) + 0.5)
    ties = [F.desc(stable_hash(label, seed)), label.desc()] if by_hash else [label]
    quotas = remainder_quotas(sizes, total, ties, fraction if by_hash else None).select(*(F.col(s).alias(f"__g_{s}") for s in strata), "quota")
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"__g_{s}"))
    return (
        ranked(rows, strata, key, seed)
        .join(quotas, same)
        .withColumn("selected", F.col("rank") <= F.col("quota"))
        .drop("quota", *(f"__g_{s}" for s in strata))
    )


def stratified_select(rows: DataFrame, strata: list[str], key: str, count: int, seed: int) -> DataFrame:
    """`count` rows (or all, if fewer), strata in proportion by largest remainder, equal remainders by the strata's text."""
    label = tuple_text(strata)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = F.least(F.lit(count), F.sum("n").over(Window.partitionBy(F.lit(0))))
    quotas = remainder_quotas(sizes, total, [label]).select(*(F.col(s).alias(f"__g_{s}") for s in strata), "quota")
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"__g_{s}"))
    allotted = rows.join(quotas, same).drop(*(f"__g_{s}" for s in strata))
    return ranked(allotted, strata, key, seed, at_most=F.col("quota")).drop("quota")


def stratified_split(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: int) -> DataFrame:
    """Rows with `part` validation or train; the validation part is a stratified sample of the fraction."""
    sampled = stratified_sample(rows, strata, key, fraction, seed, by_hash=False)
    return sampled.withColumn("part", F.when(F.col("selected"), F.lit("validation")).otherwise(F.lit("train"))).drop("selected", "rank")


def balanced_select(rows: DataFrame, group: str, key: str, count: int, seed: int) -> DataFrame:
    """Round robin over groups: first of every group, then the second of each, until `count` rows; groups in text order.

    Fewer rows than `count` are an error, from one eager count of at most `count` rows.
    """
    if (held := rows.limit(count).count()) < count:
        raise ValueError(f"{count} rows wanted, {held} there")
    turns = ranked(rows, [group], key, seed, name="turn", at_most=F.lit(count))
    return turns.orderBy("turn", F.col(group).cast("string"), key).limit(count)


def assign_splits(rows: DataFrame, group: str, key: str, test: float, validation: float, seed: int) -> DataFrame:
    """Rows with `part`: per group the first floor(n * test + .5) test, the next floor(n * validation + .5) validation, the rest train."""
    if test < 0 or validation < 0 or test + validation >= 1:
        raise ValueError("fractions must not be negative and must leave rows for training")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    held = ranked(rows, [group], key, seed).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    first, second = F.floor(F.col("_n") * test + 0.5), F.floor(F.col("_n") * validation + 0.5)
    part = F.when(F.col("rank") <= first, "test").when(F.col("rank") <= first + second, "validation").otherwise("train")
    return held.withColumn("part", part).drop("_g", "_n", "rank")


def hash_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows with `part`: the first floor(N * fraction + .5) in hash order are held out, without strata."""
    out = assign_splits(rows.withColumn("_all", F.lit(0)), "_all", key, fraction, 0.0, seed)
    return out.withColumn("part", F.when(F.col("part") == "test", "heldout").otherwise("train")).drop("_all")


def replay_mix(code: DataFrame, graph: DataFrame, solve: DataFrame, repeats: int, seed: int, key: str = "id") -> DataFrame:
    """(id, task): every code record `repeats` times (id:repeatN), and as many graph and solve records as code ones.

    Two repeats give half code, a quarter each of the others. Records are taken in hash order, not by a generator's state. Eager
    in a count of the code records; too few graph or solve records raise.
    """
    if repeats < 1:
        raise ValueError("repeats must be positive")
    times = code.select(key, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_r"))
    many = times.select(F.concat(F.col(key).cast("string"), F.lit(":repeat"), "_r").alias("id"), F.lit("code").alias("task"))
    n = code.count()
    require_count(graph, n, "graph records")
    require_count(solve, n, "solve records")
    parts = [many]
    for task, rows in (("graph", graph), ("solve", solve)):
        chosen = ranked(rows.select(key, F.lit(0).alias("_all")), ["_all"], key, seed, at_most=F.lit(n))
        parts.append(chosen.select(F.col(key).cast("string").alias("id"), F.lit(task).alias("task")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shards(rows: DataFrame, order: str, world: int, drop_remainder: bool = True) -> DataFrame:
    """Rows with `index` (place in the order of a unique numeric column) and `shard` = index modulo world; an incomplete last round is dropped."""
    numbered = dense_index(rows, order)
    if drop_remainder:
        n = rows.count()
        numbered = numbered.where(F.col("index") < n - n % world)
    return numbered.withColumn("shard", F.pmod(F.col("index"), F.lit(world)).cast("int"))


def dense_index(rows: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Rows with `index` 0 .. n-1 by a unique numeric column. Ranges of the column are counted, then ranked each on its own.

    The ranges come from approximate quantiles, so no task sorts more than a small share of the rows.
    """
    edges = rows.select(F.percentile_approx(order, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 10000).alias("q"))
    cuts = sorted({x for x in (edges.first().q or []) if x is not None})
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = rows.withColumn("_b", bucket)
    counts = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return cut.withColumn("_p", place).join(starts, "_b").withColumn("index", F.col("_before") + F.col("_p") - 1).drop("_b", "_p", "_before")


def quota_backfill(rows: DataFrame, first: Column, first_count: int, count: int, order: list[Column]) -> DataFrame:
    """`count` rows: the best `first_count` of the first kind, filled with the others, and if those run out with anything left.

    Only the best `count` of either kind can be chosen; both come from a distributed top-k, and the rest is bounded by `count`.
    """
    ours = rows.withColumn("_first", F.coalesce(first, F.lit(False)))
    best = ours.where("_first").orderBy(*order).limit(count).unionByName(ours.where("not _first").orderBy(*order).limit(count))
    rank = F.row_number().over(Window.partitionBy("_first").orderBy(*order))
    placed = best.withColumn("_rank", rank).withColumn(
        "_class",
        F.when(F.col("_first") & (F.col("_rank") <= first_count), 0).when(~F.col("_first"), 1).otherwise(2),
    )
    return placed.orderBy("_class", *order).limit(count).drop("_first", "_rank", "_class")
