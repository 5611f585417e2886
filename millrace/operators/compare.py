"""Evaluation summaries, paired comparison of adapters, strata by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import holm, mcnemar, mean_or_zero, ratio, true_rate, wilson

METRICS = (
    "tags_exact", "code_blocks_complete", "signature_exact", "python_executable",
    "all_hidden_tests_pass", "backward_target_correct", "final_answer_correct", "full_success",
)
MAIN_METRIC = "final_answer_correct"
RATES = {
    "tags_exact_rate": "tags_exact", "code_block_complete_rate": "code_blocks_complete", "signature_exact_rate": "signature_exact",
    "python_executable_rate": "python_executable", "all_hidden_tests_pass_rate": "all_hidden_tests_pass",
    "backward_target_accuracy": "backward_target_correct", "final_answer_accuracy": "final_answer_correct", "full_success_rate": "full_success",
}


def summarise(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: problems, errors, eight rates, test sums and their ratios, and three means; rates and means rounded to 6 digits."""
    total = lambda f: F.coalesce(F.sum(f"test_counts.{f}"), F.lit(0))
    aggregates = [F.count("*").alias("problems"), F.count_if(F.col("status") == "error").alias("errors")]
    aggregates += [F.bround(true_rate(F.col(c)), 6).alias(name) for name, c in RATES.items()]
    for kind in ("unit", "property"):
        passed, all_tests = total(f"{kind}_passed"), total(f"{kind}_total")
        aggregates += [
            passed.alias(f"{kind}_tests_passed"),
            all_tests.alias(f"{kind}_tests_total"),
            F.bround(ratio(passed, all_tests), 6).alias(f"{kind}_test_pass_rate"),
        ]
    for name, column in (
        ("mean_generation_seconds", "generation_seconds"),
        ("mean_prompt_tokens", "prompt_token_count"),
        ("mean_completion_tokens", "completion_token_count"),
    ):
        aggregates.append(F.bround(mean_or_zero(F.col(column)), 6).alias(name))
    return rows.groupBy(*by).agg(*aggregates)


def deltas(summary: DataFrame, label: str, baseline: str) -> DataFrame:
    """(label, metric, baseline, candidate, delta): candidate minus baseline of every numeric column of a summary."""
    metrics = [c for c, t in summary.dtypes if c != label and t in ("double", "bigint", "int")]
    long = summary.unpivot([label], [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value")
    base = long.where(F.col(label) == baseline).select("metric", F.col("value").alias("baseline"))
    return (
        long.where(F.col(label) != baseline)
        .join(base, "metric")
        .select(label, "metric", "baseline", F.col("value").alias("candidate"), F.bround(F.col("value") - F.col("baseline"), 6).alias("delta"))
    )


def paired(rows: DataFrame, label: str, key: str, left: str, right: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(key, metric, was, now) of all keys that both labels have, one row per metric; null flags are false.

    Rows of the two labels meet in one aggregate per key instead of a self join, so the keys are shuffled once.
    """
    side = lambda name, c: F.bool_or(F.when(F.col(label) == name, F.coalesce(F.col(c), F.lit(False))))
    one = rows.where(F.col(label).isin(left, right)).groupBy(key).agg(
        *(side(left, m).alias(f"{m}_l") for m in metrics), *(side(right, m).alias(f"{m}_r") for m in metrics)
    )
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_l").alias("was"), F.col(f"{m}_r").alias("now")) for m in metrics))
    both = one.where(F.col(f"{metrics[0]}_l").isNotNull() & F.col(f"{metrics[0]}_r").isNotNull())
    return both.select(key, F.inline(pairs))


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, successes of both sides, improved, regressed, unchanged."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("was").alias("was_successes"), F.count_if("now").alias("now_successes"),
        F.count_if(~F.col("was") & F.col("now")).alias("improved"), F.count_if(F.col("was") & ~F.col("now")).alias("regressed"),
        F.count_if(F.col("was") == F.col("now")).alias("unchanged"),
    )


def with_tests(counts: DataFrame) -> DataFrame:
    """Transition counts with both rates, their difference and the exact McNemar p value."""
    return counts.withColumns(
        {
            "was_rate": ratio(F.col("was_successes"), F.col("n")),
            "now_rate": ratio(F.col("now_successes"), F.col("n")),
            "difference": ratio(F.col("now_successes") - F.col("was_successes"), F.col("n")),
            "p_value": mcnemar(F.col("improved"), F.col("regressed")),
        }
    )


def label_pairs(labels: list[str], baseline: str) -> list[tuple[str, str]]:
    """The baseline against every other label, then all unordered pairs of the others in their order. Labels are a short list."""
    others = [x for x in labels if x != baseline]
    return [(baseline, x) for x in others] + [(a, b) for i, a in enumerate(others) for b in others[i + 1 :]]


def all_paired(rows: DataFrame, label: str, key: str, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(left_label, right_label, metric, was, now) of every key that both labels of a pair have.

    One aggregate per key holds all labels and metrics, so any number of pairs costs one scan and one shuffle.
    """
    labels = list(dict.fromkeys(x for pair in pairs for x in pair))
    flag = lambda name, c: F.bool_or(F.when(F.col(label) == name, F.coalesce(F.col(c), F.lit(False))))
    wide = rows.where(F.col(label).isin(labels)).groupBy(key).agg(*(flag(name, m).alias(f"{i}_{m}") for i, name in enumerate(labels) for m in metrics))
    cells = [
        F.struct(
            F.lit(a).alias("left_label"),
            F.lit(b).alias("right_label"),
            F.lit(m).alias("metric"),
            F.col(f"{labels.index(a)}_{m}").alias("was"),
            F.col(f"{labels.index(b)}_{m}").alias("now"),
        )
        for a, b in pairs
        for m in metrics
    ]
    return wide.select(F.inline(F.array(*cells))).where("was is not null and now is not null")


def paired_report(rows: DataFrame, label: str, key: str, labels: list[str], baseline: str) -> DataFrame:
    """Every pair of labels and metric with transition counts, rates, Wilson bounds of the second and exact p values.

    The Holm adjustment covers the comparisons of the main metric against the baseline; elsewhere it is null.
    """
    counted = transitions(all_paired(rows, label, key, label_pairs(labels, baseline)), ["left_label", "right_label", "metric"])
    tested = with_tests(counted)
    low, high = wilson(F.col("now_successes"), F.col("n"))
    tested = tested.withColumns({"now_low": low, "now_high": high})
    tested = tested.withColumn("_p", F.when((F.col("metric") == MAIN_METRIC) & (F.col("left_label") == baseline), F.col("p_value")))
    return holm(tested, "_p", "right_label", "p_adjusted").drop("_p")


def strata(rows: DataFrame, columns: list[str], flag: Column, by: list[str]) -> DataFrame:
    """(stratum, value, by, n, successes, rate, low, high): overlapping strata in one pass by grouping sets."""
    held = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    for c in columns:
        held = held.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unknown")))
    sets = [[F.col(c), *(F.col(b) for b in by)] for c in columns]
    grouped = held.groupingSets(sets, *columns, *by).agg(
        F.count("*").alias("n"), F.count_if("_flag").alias("successes"), *(F.grouping(c).alias(f"_g_{c}") for c in columns)
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        name, value = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(name), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    low, high = wilson(F.col("successes"), F.col("n"))
    return grouped.select(
        name.alias("stratum"),
        value.alias("value"),
        *by,
        "n",
        "successes",
        ratio(F.col("successes"), F.col("n")).alias("rate"),
        low.alias("low"),
        high.alias("high"),
    )


def pass_at_k(rows: DataFrame, problem: str, flags: dict[str, Column], by: list[str]) -> DataFrame:
    """Per group: problems, mean success of all rows and share of problems with at least one success, for each named flag."""
    value = lambda c: F.coalesce(c, F.lit(False))
    per = rows.groupBy(*by, problem).agg(
        F.count("*").alias("_n"), *(F.count_if(value(c)).alias(f"_s_{n}") for n, c in flags.items())
    )
    out = [F.count("*").alias("problems"), F.sum("_n").alias("rollouts")]
    for n in flags:
        out += [ratio(F.sum(f"_s_{n}"), F.sum("_n")).alias(f"{n}_rate"), F.avg((F.col(f"_s_{n}") > 0).cast("double")).alias(f"{n}_pass_at_k")]
    return per.groupBy(*by).agg(*out)


def merged_summaries(parts: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Summaries of ranks (metrics, num_problems, wall_time_seconds) merged: metrics weighted by problems, time the longest, sizes summed.

    For ratio metrics this differs from a recomputation over all rows, which `summarise` gives.
    """
    weight = F.sum("num_problems")
    return parts.groupBy(*by).agg(
        weight.alias("num_problems"), F.max("wall_time_seconds").alias("wall_time_seconds"),
        *(ratio(F.sum(F.col(m) * F.col("num_problems")), weight).alias(m) for m in metrics),
    )


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counts of every value of the columns, nulls as unknown, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns))
    return rows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def group_stats(rows: DataFrame, group: str, value: str, name: str = "value") -> DataFrame:
    """Minimum, maximum, mean and whether a group's values differ by more than 1e-9."""
    stats = rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min(value).alias(f"min_{name}"),
        F.max(value).alias(f"max_{name}"),
        F.avg(value).alias(f"mean_{name}"),
    )
    return stats.withColumn("differs", F.col(f"max_{name}") - F.col(f"min_{name}") > 1e-9)


