import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import compare


def mcnemar(i, r):
    n = i + r
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(i, r) + 1)) / 2**n)


def test_mcnemar_matches_published_counts(spark):
    pairs = [(25, 8), (115, 18), (11, 5), (12, 9), (0, 0), (1, 1), (0, 7), (900, 1100)]
    rows = spark.createDataFrame(pairs, "i int, r int").select("i", "r", stats.mcnemar(F.col("i"), F.col("r")).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(mcnemar(row.i, row.r), rel=1e-9)
    assert round(next(r.p for r in rows if r.i == 25), 4) == 0.0046
    assert round(next(r.p for r in rows if r.i == 11), 4) == 0.2101
    assert round(next(r.p for r in rows if r.i == 12), 4) == 0.6636


def test_wilson(spark):
    low, high = stats.wilson(F.col("s"), F.col("n"))
    rows = {
        r.s: r for r in spark.createDataFrame([(0, 10), (5, 10), (10, 10), (7, 0)], "s int, n int").select("s", low.alias("low"), high.alias("high")).collect()
    }
    assert rows[0].low == 0 and round(rows[10].high, 12) == 1
    assert (round(rows[5].low, 4), round(rows[5].high, 4)) == (0.2366, 0.7634)
    assert rows[7].low is None


def test_holm(spark):
    rows = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double"), "p", "k")
    found = {r.k: r.p_adjusted for r in rows.collect()}
    assert [round(found[k], 6) if found[k] is not None else None for k in "abcd"] == [0.03, 0.06, 0.06, None]


def test_pairing(spark):
    rows = spark.createDataFrame(
        [("a", "x", False), ("a", "y", True), ("b", "x", True), ("b", "y", False), ("c", "x", None), ("c", "y", None), ("d", "x", True)],
        "id string, adapter string, final_answer_correct boolean",
    )
    counts = compare.with_tests(compare.transitions(compare.paired(rows, "adapter", "id", "x", "y", ("final_answer_correct",)), ["metric"])).first()
    assert (counts.n, counts.improved, counts.regressed, counts.unchanged, counts.p_value) == (3, 1, 1, 1, 1.0)


def test_label_pairs():
    assert compare.label_pairs(["b", "a", "c"], "b") == [("b", "a"), ("b", "c"), ("a", "c")]


def test_summary_ratios_of_sums(spark):
    schema = "adapter string, status string, " + ", ".join(f"{m} boolean" for m in compare.METRICS) + ", test_counts struct<unit_passed:int,unit_total:int,property_passed:int,property_total:int>, generation_seconds double, prompt_token_count int, completion_token_count int"
    rows = spark.createDataFrame([("m", "ok", *[True] * 8, (1, 2, 1, 1), 1.0, 10, 5), ("m", "error", *[None] * 8, None, None, None, None)], schema)
    s = compare.summarise(rows, ["adapter"]).first()
    assert (
        s.problems,
        s.errors,
        s.unit_test_pass_rate,
        s.property_test_pass_rate,
        s.final_answer_accuracy,
        s.mean_completion_tokens,
    ) == (2, 1, 0.5, 1.0, 0.5, 5.0)


def test_merge_weights(spark):
    parts = spark.createDataFrame([("m", 2, 1.0, 0.5), ("m", 1, 3.0, 1.0)], "a string, num_problems int, wall_time_seconds double, acc double")
    row = compare.merged_summaries(parts, ["acc"], ["a"]).first()
    assert (row.num_problems, row.wall_time_seconds, round(row.acc, 9)) == (3, 3.0, round(2 / 3, 9))
