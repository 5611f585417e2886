"""Metrics over nested trajectory rows (a problem with its rollout records), and audits of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import mean_or_zero, ratio


def _passes(scores: Column) -> Column:
    """All values at least 1; true for an empty or missing map."""
    return F.coalesce(F.forall(F.map_values(scores), lambda v: v >= 1), F.lit(True))


def trajectory_metrics(trajectories: DataFrame) -> DataFrame:
    """One row with the sixteen metrics of trajectories (wall_time_seconds, rollout_records).

    Records are structs of rollout, execution, verification, reward and repair. Problems without rollouts count in pass@k and
    solving time. A missing repair status counts as attempted. All metrics come from two aggregates, of problems and of records.
    """
    final = lambda r: F.coalesce(r["reward"]["final_reward"], F.lit(0.0))
    per_problem = trajectories.select(
        F.coalesce("wall_time_seconds", F.lit(0.0)).alias("_wall"),
        F.coalesce(F.exists("rollout_records", lambda r: final(r) >= 1), F.lit(False)).cast("double").alias("_solved"),
        F.explode_outer(F.when(F.size("rollout_records") > 0, F.transform("rollout_records", lambda r, i: F.struct(r.alias("r"), i.alias("i"))))).alias("x"),
    )
    r = F.col("x.r")
    node_results = F.map_values(r["execution"]["node_results"])
    tests = F.flatten(F.filter(F.transform(node_results, lambda n: n["test_results"]), lambda t: t.isNotNull()))
    values = lambda m: F.coalesce(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    calls = F.coalesce(
        r["rollout"]["tool_call_count"],
        F.aggregate(r["rollout"]["parsed_spans"], F.lit(0), lambda a, s: a + F.greatest(F.size(s["code_blocks"]), F.lit(0))),
        F.lit(0),
    )
    count = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0))
    correct = final(r)
    attempted = F.coalesce(r["repair"]["status"] != "not_needed", F.lit(True))
    structured = _passes(r["verification"]["node_scores"]) & _passes(r["verification"]["edge_scores"])
    flat = per_problem.select(
        "_wall", "_solved", (F.coalesce(F.col("x.i"), F.lit(0)) == 0).alias("_first"), F.col("x").isNotNull().alias("_is"), correct.alias("_correct"),
        F.coalesce(r["execution"]["runtime_seconds"], F.lit(0.0)).alias("_sandbox"), F.coalesce(
            r["rollout"]["completion_token_count"],
            F.lit(0),
        ).alias("_tokens"), calls.alias("_calls"),
        values(r["verification"]["node_scores"]).alias("_nodes"), count(F.map_values(r["verification"]["node_scores"])).alias("_n_nodes"),
        values(r["verification"]["edge_scores"]).alias("_edges"), count(F.map_values(r["verification"]["edge_scores"])).alias("_n_edges"),
        attempted.alias("_attempted"), (F.coalesce(r["repair"]["status"], F.lit("")) == "succeeded").alias("_repaired"),
        (structured != (correct >= 1)).alias("_disagree"), (F.coalesce(r["execution"]["executable"], F.lit(False)) & (correct < 1)).alias("_wrong"),
        F.coalesce(r["execution"]["timeout"], F.lit(False)).alias("_timeout"), count(tests).alias("_tests"), count(
            F.filter(tests, lambda t: F.coalesce(t["passed"], F.lit(False)))
        ).alias("_passed"),
        count(F.filter(node_results, lambda n: ~F.coalesce(n["executable"], F.lit(False)))).alias("_invalid"),
    )
    rec = lambda c: F.when(F.col("_is"), F.col(c))
    records = F.count_if("_is")
    time, accuracy = F.avg(F.when(F.col("_first"), F.col("_wall"))), F.avg(rec("_correct"))
    return flat.agg(
        mean_or_zero(rec("_correct")).alias("rollout_accuracy"), mean_or_zero(F.when(F.col("_first"), F.col("_solved"))).alias("pass_at_k"),
        F.coalesce(time, F.lit(0.0)).alias("average_solving_time_seconds"), mean_or_zero(rec("_sandbox")).alias("average_sandbox_time_seconds"),
        mean_or_zero(rec("_calls")).alias("average_tool_calls"), mean_or_zero(rec("_tokens")).alias("average_generated_tokens"),
        ratio(accuracy, time).alias("cost_normalized_accuracy"), ratio(F.sum(rec("_nodes")), F.sum(rec("_n_nodes"))).alias("node_verification_pass_rate"),
        ratio(F.sum(rec("_edges")), F.sum(rec("_n_edges"))).alias("edge_consistency_rate"),
        ratio(F.count_if(F.col("_is") & F.col("_attempted") & F.col("_repaired")), F.count_if(F.col("_is") & F.col("_attempted"))).alias("repair_success_rate"),
        ratio(
            F.count_if(F.col("_is") & F.col("_disagree")),
            records,
        ).alias("verifier_disagreement_rate"), ratio(F.count_if(F.col("_is") & F.col("_wrong")), records).alias("executable_but_wrong_rate"),
        ratio(
            F.sum(rec("_correct")),
            F.sum(rec("_calls")) + 1,
        ).alias("tool_productivity"), ratio(F.sum(rec("_passed")), F.sum(rec("_tests"))).alias("useful_tool_ratio"),
        ratio(F.sum(rec("_invalid")), F.sum(rec("_calls"))).alias("invalid_tool_rate"), ratio(
            F.count_if(F.col("_is") & F.col("_timeout")),
            records,
        ).alias("timeout_rate"),
    )


def finite(value: Column) -> Column:
    """The number, 0 for null, NaN and infinities."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def hardness(rollouts: DataFrame, problem: str, final: Column, parts: list[Column], reward: Column) -> DataFrame:
    """Per problem: rollouts, mean final score, learnability (best mean of the parts), population deviation of the reward; 6 digits."""
    held = rollouts.select(
        problem,
        finite(final).alias("_final"),
        (sum((finite(p) for p in parts), F.lit(0.0)) / len(parts)).alias("_learn"),
        finite(reward).alias("_reward"),
    )
    return held.groupBy(problem).agg(
        F.count("*").alias("rollouts"), F.round(F.avg("_final"), 6).alias("final_rate"), F.round(F.max("_learn"), 6).alias("learnability"),
        F.round(F.coalesce(F.stddev_pop("_reward"), F.lit(0.0)), 6).alias("reward_std"),
    )


def hard_score(final: Column, learnability: Column, deviation: Column) -> Column:
    """3 for mixed outcomes, 2 times what is unsolved, 2 times what can be learned, and the deviation up to 1; 6 digits."""
    mixed = ((final > 0) & (final < 1)).cast("double")
    return F.round(3 * mixed + 2 * (1 - final) + 2 * learnability + F.least(F.lit(1.0), deviation), 6)


def reject_reason(rollouts: Column, final: Column, learnability: Column, most_final: float, least_learnability: float) -> Column:
    """First reason a problem is left out, null if it is kept."""
    return (
        F.when(rollouts.isNull(), "missing_trajectory")
        .when(rollouts < 2, "fewer_than_two_rollouts")
        .when(final > most_final, "not_hard_enough")
        .when(learnability < least_learnability, "no_process_signal")
    )


def test_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Unit and property tests passed and expected, from specification and result arrays matched by position; missing results fail.

    results: expected array<struct<kind>>, actual array<struct<passed>>.
    """
    both = F.zip_with(
        "expected",
        F.slice(F.coalesce("actual", F.array().cast(results.schema["actual"].dataType)), F.lit(1), F.size("expected")),
        lambda e, a: F.struct(
            F.when(e["kind"] == "property", "property").otherwise("unit").alias("kind"),
            F.coalesce(a["passed"], F.lit(False)).alias("passed"),
        ),
    )
    one = results.withColumn("_b", both)
    n = lambda kind, passed: F.coalesce(
        F.sum(F.size(F.filter("_b", lambda t: (t["kind"] == kind) & (t["passed"] | F.lit(not passed))))),
        F.lit(0),
    )
    return one.groupBy(*by).agg(*(n(k, p).alias(f"{k}_{'passed' if p else 'total'}") for k in ("unit", "property") for p in (True, False)))


def call_histogram(rows: DataFrame, calls: str, status: str) -> DataFrame:
    """(status, problems, mean_calls, max_calls) of teacher calls per problem."""
    return rows.groupBy(F.coalesce(F.col(status), F.lit("none")).alias("status")).agg(
        F.count("*").alias("problems"),
        mean_or_zero(F.col(calls)).alias("mean_calls"),
        F.coalesce(F.max(calls), F.lit(0)).alias("max_calls"),
    )


def before_and_after(trajectories: DataFrame) -> DataFrame:
    """One row over first rollouts: accuracy before and after repair, improved, regressed. Before falls back to the final verification."""
    first = trajectories.select(F.try_element_at("rollout_records", F.lit(1)).alias("r")).where("r is not null")
    after = F.coalesce(F.col("r.verification.final_answer_score"), F.lit(0.0)) >= 1
    before = F.coalesce(F.col("r.repair.verification_before_repair.final_answer_score"), F.col("r.verification.final_answer_score"), F.lit(0.0)) >= 1
    held = first.select(before.alias("b"), after.alias("a"))
    return held.agg(
        F.count("*").alias("problems"), ratio(F.count_if("b"), F.count("*")).alias("accuracy_before"), ratio(F.count_if("a"), F.count("*")).alias("accuracy_after"),
        F.count_if(~F.col("b") & F.col("a")).alias("improved"), F.count_if(F.col("b") & ~F.col("a")).alias("regressed"),
    )


def teacher_run(trajectories: DataFrame) -> DataFrame:
    """One row about a run with a teacher: calls, problems with shared feedback and with a group judgment, accuracies, mean and greatest
    update divergence; means have 6 digits, divergences 8, and are 0 where there is nothing."""
    rows = F.coalesce("rollout_records", F.array().cast(trajectories.schema["rollout_records"].dataType))
    score = lambda c: F.coalesce(c, F.lit(0.0))
    sums = lambda get: F.aggregate(F.transform(rows, get), F.lit(0.0), lambda a, x: a + score(x))
    judged = F.filter(rows, lambda r: r["reward"]["teacher_reward"].isNotNull())
    per = trajectories.select(
        F.coalesce("teacher_calls_used", F.lit(0)).alias("calls"), F.exists(
            rows,
            lambda r: F.coalesce(r["repair"]["status"] == "shared_feedback", F.lit(False)),
        ).alias("shared"),
        F.col("teacher_group_judgment.rollout_judgments").isNotNull().alias("judged"), F.col(
            "teacher_probe.verification.final_answer_score"
        ).alias("probe"), F.col("teacher_probe").isNotNull().alias("probed"),
        F.size(rows).alias("n"), sums(
            lambda r: r["verification"]["final_answer_score"]
        ).alias("final"), sums(lambda r: r["verification"]["backward_score"]).alias("backward"),
        F.size(judged).alias("scored"), sums(lambda r: r["reward"]["teacher_reward"]).alias("score"), F.col("grpo_update.approx_kl").alias("kl"),
    )
    mean = lambda top, n, name: F.round(ratio(top, n), 6).alias(name)
    return per.agg(
        F.count("*").alias("problems"), F.coalesce(F.sum("calls"), F.lit(0)).alias("teacher_api_calls"), mean(
            F.sum("calls"),
            F.count("*"),
            "teacher_calls_per_problem",
        ),
        F.count_if("shared").alias("problems_with_shared_feedback"), F.count_if("judged").alias("problems_with_group_judgment"), F.count_if(~F.col("shared")).alias("problems_without_feedback"),
        mean(
            F.sum(F.when(F.col("probed"), score(F.col("probe")))),
            F.count_if("probed"),
            "probe_accuracy",
        ), mean(F.sum("final"), F.sum("n"), "rollout_accuracy"), mean(F.sum("backward"), F.sum("n"), "backward_accuracy"),
        mean(
            F.sum("score"),
            F.sum("scored"),
            "mean_judge_score",
        ), F.round(F.coalesce(F.avg("kl"), F.lit(0.0)), 8).alias("mean_kl"), F.round(F.coalesce(F.max("kl"), F.lit(0.0)), 8).alias("max_kl"),
    )


def repair_statuses(trajectories: DataFrame) -> DataFrame:
    """(status, rollouts): how often each repair status occurs; a missing one is unknown."""
    held = trajectories.select(F.explode("rollout_records").alias("r"))
    return held.groupBy(F.coalesce("r.repair.status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("rollouts"))


def failure_free(verification: Column) -> Column:
    """No failures are listed."""
    return F.coalesce(F.size(verification["failures"]) <= 0, F.lit(True))


def verification_pass(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) >= 1


def main_answer(spans: Column) -> Column:
    """The extracted answer of the span of main, null without one."""
    return F.try_element_at(F.filter(spans, lambda s: s["node_id"] == "main"), F.lit(1))["extracted_answer"]


def expects_execution(node: Column) -> Column:
    """A node that is a function or has tests."""
    return F.coalesce(node["expected_output_type"] == "python_function", F.lit(False)) | (F.coalesce(F.size(node["tests"]), F.lit(0)) > 0)


def memory_preview(items: Column, most: int = 3, longest: int = 500) -> Column:
    """The first items of a memory context with their rank and the start of their text, blanks collapsed."""
    text = lambda i: F.substring(F.trim(F.regexp_replace(F.coalesce(i["text"], F.lit("")), r"\s+", " ")), 1, longest)
    first = F.slice(F.coalesce(items, F.array()), 1, most)
    return F.transform(
        first,
        lambda i, k: F.struct(
            (k + 1).cast("int").alias("rank"),
            i["id"].alias("id"),
            i["source"].alias("source"),
            i["keywords"].alias("keywords"),
            text(i).alias("text_preview"),
        ),
    )


def with_teacher(trajectories: DataFrame) -> DataFrame:
    """Per problem with rollouts, from its first: id, status, attempts, theories, and before and after repair final, backward, failure-free.

    Before is the verification before repair, or where there is none the final one.
    """
    first = trajectories.select(
        F.coalesce("problem.id", F.lit(None).cast("string")).alias("id"),
        "memory_context",
        F.try_element_at("rollout_records", F.lit(1)).alias("r"),
    ).where("r is not null")
    after = F.col("r.verification")
    before = F.coalesce(F.col("r.repair.verification_before_repair"), after)
    return first.select(
        "id", F.coalesce("r.repair.status", F.lit("not_needed")).alias("status"), F.greatest(
            F.coalesce(F.size("r.repair.attempts"), F.lit(0)),
            F.lit(0),
        ).alias("attempts"),
        F.greatest(F.coalesce(F.size(F.slice("memory_context.theorem_items", 1, 3)), F.lit(0)), F.lit(0)).alias("theories"),
        *(f(v).alias(f"{name}_{side}") for side, v in (("before", before), ("after", after)) for name, f in (
            (
                "final",
                lambda v: verification_pass(v["final_answer_score"]),
            ), ("backward", lambda v: verification_pass(v["backward_score"])), ("clean", failure_free),
        )),
    )


def with_teacher_summary(trajectories: DataFrame) -> DataFrame:
    """One row over with_teacher: memory coverage, teacher calls, rates before and after, and how full success changed."""
    rate = lambda c: ratio(F.count_if(c), F.count("*")).alias(f"{c}_rate")
    sides = [rate(f"{n}_{s}") for s in ("before", "after") for n in ("final", "backward", "clean")]
    return with_teacher(trajectories).agg(
        F.count("*").alias("problems"), F.count_if(F.col("theories") == 3).alias("with_three_theories"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("teacher_api_calls"),
        F.count_if(F.col("status").isin("succeeded", "failed")).alias("repaired"), *sides, F.count_if(
            F.col("clean_after") & ~F.col("clean_before")
        ).alias("improved"),
        F.count_if(
            F.col("clean_before") & ~F.col("clean_after")
        ).alias("regressed"), F.count_if(F.col("clean_before") == F.col("clean_after")).alias("unchanged"),
    )


def rollout_views(trajectories: DataFrame) -> DataFrame:
    """One row a rollout record: id, final, backward, execution, strict (all seven rewards full), unit and property score, tokens."""
    held = trajectories.select(F.coalesce("problem.id", F.lit(None).cast("string")).alias("id"), F.explode("rollout_records").alias("r"))
    part = lambda name: F.coalesce(F.col(f"r.reward.{name}"), F.lit(0.0))
    full = lambda name: part(name) == 1.0
    strict = full("format_gate")
    for name in ("signature_reward", "execution_reward", "unit_test_reward", "property_test_reward", "backward_reward", "final_reward"):
        strict = strict & full(name)
    return held.select(
        "id", full("final_reward").alias("final"), full("backward_reward").alias("backward"), full("execution_reward").alias("execution"), strict.alias("strict"),
        part("unit_test_reward").alias("unit_score"), part("property_test_reward").alias("property_score"),
        F.greatest(F.coalesce(F.size("r.rollout.completion_token_ids"), F.lit(0)), F.lit(0)).alias("tokens"),
    )


def sampled_summary(views: DataFrame) -> DataFrame:
    """One row over rollout views: rollouts, accuracy, pass@k in four ways, mean scores and tokens."""
    flags = {"final": "final", "strict": "strict", "executable": "execution", "backward": "backward"}
    per = views.groupBy("id").agg(
        F.count("*").alias("n"),
        *(F.bool_or(c).alias(f"any_{n}") for n, c in flags.items()),
        *(F.sum(c).alias(f"sum_{c}") for c in ("unit_score", "property_score", "tokens")),
        F.count_if("final").alias("finals"),
    )
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rollouts"), mean("finals").alias("sampled_rollout_accuracy"), *(
            ratio(F.count_if(f"any_{n}"), F.count("*")).alias(f"{n}_pass_at_k") for n in flags
        ),
        mean("sum_unit_score").alias("mean_unit_score"), mean("sum_property_score").alias("mean_property_score"), mean("sum_tokens").alias("mean_completion_tokens"),
    )


def sampled_changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, id, change) of problems whose pass@k changed between two runs' rollout views: improved or regressed. One join on the id."""
    flags = {"final": "final", "strict": "strict", "executable": "execution", "backward": "backward"}
    side = lambda views, s: views.groupBy("id").agg(*(F.bool_or(c).alias(f"{n}_{s}") for n, c in flags.items()))
    both = side(baseline, "was").join(side(candidate, "now"), "id")
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_was").alias("was"), F.col(f"{n}_now").alias("now")) for n in flags))
    held = both.select("id", F.inline(each)).where("was <> now")
    return held.select("metric", "id", F.when(F.col("now"), "improved").otherwise("regressed").alias("change"))
