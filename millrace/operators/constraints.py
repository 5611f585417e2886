"""Constraints as eager checks. Each aggregates violations, the driver looks at one bounded row, and a violation raises.

They are not expressions riding in a projection: Catalyst prunes those together with unused columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 10


class ConstraintError(ValueError):
    """Rows break a constraint."""


def _examples(rows: DataFrame, column: str) -> list:
    return [r[0] for r in rows.select(column).orderBy(column).limit(EXAMPLES).collect()]


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of blank, null or repeated keys. Counts combine before the shuffle, so a hot key is one partial sum per task."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def require_unique(rows: DataFrame, key: str, what: str = "rows") -> None:
    bad = duplicate_keys(rows, key)
    if found := _examples(bad, key):
        raise ConstraintError(f"{what}: missing or duplicate {key}: {found}")


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys both sides hold, and the first ten in order."""
    both = left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_semi")
    first = both.orderBy(key).limit(EXAMPLES).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    counted = both.agg(F.count("*").alias("overlap")).withColumn("examples", F.slice(F.array(F.lit(None).cast(dict(first.dtypes)["examples"][6:-1])), 1, 0))
    return counted.unionByName(first.withColumn("overlap", F.lit(None).cast("bigint"))).agg(
        F.max("overlap").alias("overlap"), F.max("examples").alias("examples")
    )


def require_disjoint(left: DataFrame, right: DataFrame, key: str, what: str = "tables") -> None:
    row = overlap_report(left, right, key).first()
    if row.overlap:
        raise ConstraintError(f"{what} overlap in {row.overlap} {key}: {row.examples}")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Different keys of the left that the right lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def require_subset(left: DataFrame, right: DataFrame, key: str, what: str = "rows") -> None:
    if found := _examples(missing_keys(left, right, key), key):
        raise ConstraintError(f"{what}: {key} not known: {found}")


def require_same_keys(left: DataFrame, right: DataFrame, key: str, what: str = "rows") -> None:
    require_subset(left, right, key, what)
    require_subset(right, left, key, what)


def require_all(rows: DataFrame, predicate: Column, key: str, what: str) -> None:
    """Every row fulfils the predicate; null counts as a violation."""
    if found := _examples(rows.where(~F.coalesce(predicate, F.lit(False))), key):
        raise ConstraintError(f"{what}: {found}")


def require_count(rows: DataFrame, least: int, what: str = "rows") -> int:
    n = rows.count()
    if n < least:
        raise ConstraintError(f"{what}: {n} rows, at least {least} are needed")
    return n


def in_unit_range(value: Column) -> Column:
    """Finite and within [0, 1]; NaN sorts above all numbers in Spark, so it is named."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value <= 1)


def runtime_ok(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value <= 2)


def test_bundle_ok(tests: Column) -> Column:
    """At least four tests with an expected value, three unit and one property test among them."""
    kind = lambda name: F.size(F.filter(tests, lambda t: F.coalesce(t["kind"], F.lit("unit")) == name))
    return (F.size(tests) >= 4) & (kind("unit") >= 3) & (kind("property") >= 1) & F.forall(tests, lambda t: t["expected"].isNotNull())


def judgments_complete(judgments: Column, rollouts: Column, nodes: Column) -> Column:
    """Indices are exactly 0 .. n-1 and every scored node is known."""
    indices = F.array_sort(F.transform(judgments, lambda j: j["index"]))
    wanted = F.when(rollouts > 0, F.sequence(F.lit(0), rollouts - 1)).otherwise(F.array().cast("array<int>"))
    known = F.forall(judgments, lambda j: F.size(F.array_except(F.map_keys(j["node_scores"]), nodes)) <= 0)
    return (indices == wanted) & known


def same_graph_api(left: Column, right: Column) -> Column:
    """Two graphs have the same nodes (id, signature, type) and edges (source, target, relation) in the same order."""
    node = lambda g: F.transform(g["nodes"], lambda n: F.struct(n["id"], n["signature"], n["expected_output_type"]))
    edge = lambda g: F.transform(g["edges"], lambda e: F.struct(e["source"], e["target"], e["relation_type"]))
    return node(left).eqNullSafe(node(right)) & edge(left).eqNullSafe(edge(right))
