import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import sampling
from millrace.operators.ranking import group_ranks, uniform


def digest(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def rows(spark, n, groups="abc"):
    return spark.createDataFrame([(f"id{i}", groups[i % len(groups)], str(i % 5)) for i in range(n)], "id string, source string, difficulty string")


def test_order_is_the_hash_order(spark):
    got = [r.id for r in sampling.seeded_order(rows(spark, 40), "id", 42).collect()]
    assert got == sorted(got, key=lambda i: digest(42, i))
    page = [r.id for r in sampling.seeded_order(rows(spark, 40), "id", 42, 3, 2).collect()]
    assert page == got[3:5]


def test_ranks_equal_row_number_for_any_buckets(spark):
    data = rows(spark, 300, "aab").withColumn("u", uniform(F.col("id"), 7))
    for buckets in (1, 7, 500):
        got = {r.id: r["rank"] for r in group_ranks(data, ["source"], "u", ["id"], buckets).collect()}
        for s in "ab":
            ids = sorted((r.id for r in data.collect() if r.source == s), key=lambda i: digest(7, i))
            assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_split_of_one_domain(spark):
    data = spark.createDataFrame([(f"p{i}", "algebra", str(i)) for i in range(10)], "id string, source string, difficulty string")
    assert sampling.stratified_sample(data, ["source"], "id", 0.2, 1).where("selected").count() == 2


def test_published_split_sizes(spark):
    parts = sampling.stratified_split(rows(spark, 20), ["source", "difficulty"], "id", 0.2, 3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 16, "validation": 4}


def test_splits_do_not_depend_on_partitioning(spark):
    data = rows(spark, 200)
    one = sampling.assign_splits(data, "source", "id", 0.1, 0.2, 5).select("id", "part").collect()
    other = sampling.assign_splits(data.repartition(13), "source", "id", 0.1, 0.2, 5).select("id", "part").collect()
    assert sorted(one) == sorted(other)


def largest_remainder(sizes, count):
    total = sum(sizes.values())
    exact = {k: count * n / total for k, n in sizes.items()}
    quota = {k: int(v) for k, v in exact.items()}
    for k in sorted(sizes, key=lambda k: (-round(exact[k] - quota[k], 9), f"('{k}',)"))[: count - sum(quota.values())]:
        quota[k] += 1
    return quota


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 30), min_size=1), st.integers(1, 25))
def test_quotas_are_largest_remainder(spark, sizes, count):
    data = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, g string")
    count = min(count, sum(sizes.values()))
    got = {r.g: r["count"] for r in sampling.stratified_select(data, ["g"], "id", count, 9).groupBy("g").count().collect()}
    assert got == {k: v for k, v in largest_remainder(sizes, count).items() if v}


def test_round_robin_equals_the_loop(spark):
    random.seed(3)
    data = [(f"r{i}", random.choice("aaabc")) for i in range(50)]
    groups = {g: sorted((i for i, h in data if h == g), key=lambda i: digest(1, i)) for g in "abc"}
    expected = []
    while len(expected) < 20:
        for g in "abc":
            if groups[g] and len(expected) < 20:
                expected.append(groups[g].pop(0))
    got = [r.id for r in sampling.balanced_select(spark.createDataFrame(data, "id string, g string"), "g", "id", 20, 1).collect()]
    assert sorted(got) == sorted(expected)


def test_shards(spark):
    data = spark.range(866)
    assert {r.shard: r["count"] for r in sampling.shards(data, "id", 2).groupBy("shard").count().collect()} == {0: 433, 1: 433}
    six = sampling.shards(data, "id", 6)
    assert six.groupBy("shard").count().select("count").distinct().collect()[0][0] == 144
    assert six.agg(F.max("id")).first()[0] == 863


def test_replay_mix_shares(spark):
    code, graph, solve = (spark.createDataFrame([(f"{t}{i}",) for i in range(n)], "id string") for t, n in (("c", 4), ("g", 9), ("s", 9)))
    counts = {r.task: r["count"] for r in sampling.replay_mix(code, graph, solve, 2, 1).groupBy("task").count().collect()}
    assert counts == {"code": 8, "graph": 4, "solve": 4}


def test_backfill(spark):
    data = spark.createDataFrame(
        [(f"o{i}", True, float(i)) for i in range(2)] + [(f"m{i}", False, float(i)) for i in range(3)],
        "id string, o boolean, s double",
    )
    got = [r.id for r in sampling.quota_backfill(data, F.col("o"), 1, 5, [F.desc("s"), F.asc("id")]).collect()]
    assert got == ["o1", "m2", "m1", "m0", "o0"]


def test_empty(spark):
    none = rows(spark, 1).where("false")
    assert sampling.stratified_select(none, ["source"], "id", 5, 1).count() == 0
    assert sampling.assign_splits(none, "source", "id", 0.1, 0.1, 1).count() == 0
    assert sampling.shards(spark.range(0), "id", 3).count() == 0
