"""Audits of graphs, runs and annotations, and what may be shown of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import mean_or_zero, ratio
from millrace.operators.constraints import ConstraintError

#: Fields of a failure that a prompt may show, and the mark of feedback in a prompt.
SHOWN = ("type", "node", "edge", "relation_type", "equivalence_method", "equivalence_error", "error_type")
FEEDBACK_MARK = "repair_feedback"


def reward_coverage(graphs: DataFrame) -> DataFrame:
    """One row over graphs (graph_id, nodes, edges): nodes, edges, machine-verifiable nodes and graphs by kind of evidence, with rates.

    Nodes hold id, expected_output_type, tests (array of kind), target_call and static (a specification that needs no run).
    """
    kinds = lambda n: F.transform(n["tests"], lambda t: F.coalesce(t["kind"], F.lit("unit")))
    has_tests = lambda n: F.coalesce(F.size(n["tests"]) > 0, F.lit(False))
    rules = {
        "executable_nodes": lambda n: has_tests(n) | F.coalesce(n["expected_output_type"] == "python_function", F.lit(False)),
        "unit_tests": lambda n: F.coalesce(F.array_contains(kinds(n), "unit"), F.lit(False)),
        "property_tests": lambda n: F.coalesce(F.array_contains(kinds(n), "property"), F.lit(False)),
        "backward_call": lambda n: F.coalesce(n["target_call"], F.lit("")) != "",
    }
    verifiable = lambda n: rules["executable_nodes"](n) | F.coalesce(
        n["static"] & n["expected_output_type"].isin("formula", "values"),
        F.lit(False),
    )
    per = graphs.select(
        F.greatest(F.coalesce(F.size("nodes"), F.lit(0)), F.lit(0)).alias("_n"), F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0)).alias("_e"),
        F.greatest(F.coalesce(F.size(F.filter("nodes", verifiable)), F.lit(0)), F.lit(0)).alias("_v"),
        *(F.coalesce(F.exists("nodes", rule), F.lit(False)).alias(name) for name, rule in rules.items()),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = [
        F.count("*").alias("problems"),
        total("_n").alias("total_nodes"),
        total("_e").alias("total_edges"),
        total("_v").alias("machine_verifiable_nodes"),
        (total("_n") - total("_v")).alias("unverified_nodes"),
        F.round(ratio(F.sum("_v"), F.sum("_n")), 6).alias("machine_verifiable_node_rate"),
    ]
    for name in rules:
        out += [F.count_if(name).alias(f"graphs_with_{name}"), F.round(ratio(F.count_if(name), F.count("*")), 6).alias(f"graphs_with_{name}_rate")]
    return per.agg(*out)


def type_counts(graphs: DataFrame) -> DataFrame:
    """(field, value, n) of node types, edge relations and test kinds."""
    nodes = graphs.select(F.explode("nodes").alias("n"))
    parts = [
        nodes.select(F.lit("node_type").alias("field"), F.coalesce("n.expected_output_type", F.lit("unknown")).alias("value")),
        graphs.select(F.explode("edges").alias("e")).select(F.lit("edge_type").alias("field"), F.coalesce("e.relation_type", F.lit("unknown")).alias("value")),
        nodes.select(F.explode("n.tests").alias("t")).select(F.lit("test_kind").alias("field"), F.coalesce("t.kind", F.lit("unit")).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("field", "value").agg(F.count("*").alias("n"))


def judge_run(trajectories: DataFrame, most_tokens: int) -> DataFrame:
    """One row over trajectories of a judged run: counts of judged, failed and over-budget problems, leaked prompts, capped
    generations, groups whose scores differ, score statistics, accuracies and divergence."""
    score = lambda r: F.coalesce(r["reward"]["teacher_reward"], F.lit(0.0))
    records = F.coalesce("rollout_records", F.array().cast(trajectories.schema["rollout_records"].dataType))
    part = lambda value: F.aggregate(records, F.lit(0.0), lambda a, r: a + value(r))
    count = lambda test: F.size(F.filter(records, lambda r: F.coalesce(test(r), F.lit(False))))
    scores = F.transform(records, score)
    judged = F.col("teacher_group_judgment.rollout_judgments").isNotNull()
    per = trajectories.select(
        judged.alias("_judged"), (
            F.coalesce("teacher_calls_used", F.lit(0)) > 1
        ).alias("_over"), F.size(records).alias("_n"), F.array_min(scores).alias("_min"), F.array_max(scores).alias("_max"), part(score).alias("_sum"),
        count(
            lambda r: F.contains(r["rollout"]["prompt_text"], F.lit(FEEDBACK_MARK))
        ).alias("_leaked"), count(lambda r: r["rollout"]["completion_token_count"] >= most_tokens).alias("_capped"),
        part(
            lambda r: F.coalesce(r["verification"]["final_answer_score"], F.lit(0.0))
        ).alias("_final"), part(
            lambda r: F.coalesce(r["verification"]["backward_score"], F.lit(0.0))
        ).alias("_back"), F.col("grpo_update.approx_kl").alias("_kl"),
    )
    n = F.sum("_n")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(
        F.count("*").alias("problems"), zero(n).alias("rollouts"), F.count_if("_judged").alias("judged_problems"), F.count_if(~F.col("_judged")).alias("error_problems"), F.count_if("_over").alias("calls_over_budget"),
        zero(F.sum("_leaked")).alias("prompts_with_feedback"), F.count_if(F.col("_max") - F.col("_min") > 1e-9).alias("groups_with_variance"), F.round(ratio(F.sum("_sum"), n), 6).alias("mean_score"),
        F.coalesce(F.min("_min"), F.lit(0.0)).alias("min_score"), F.coalesce(F.max("_max"), F.lit(0.0)).alias("max_score"), F.round(ratio(F.sum("_final"), n), 6).alias("final_accuracy"), F.round(ratio(F.sum("_back"), n), 6).alias("backward_accuracy"),
        zero(F.sum("_capped")).alias("capped_generations"), F.round(mean_or_zero(F.col("_kl")), 8).alias("mean_kl"), F.round(F.coalesce(F.max("_kl"), F.lit(0.0)), 8).alias("max_kl"),
    )


def require_clean_run(audit: DataFrame, problems: int | None = None, all_judged: bool = False) -> None:
    """Raises when an audit row shows a leak, a budget overrun, a wrong number of problems or (if asked) a failed judgment."""
    row = audit.first()
    faults = [
        (row.prompts_with_feedback, "feedback leaked into a prompt"), (row.calls_over_budget, "a problem used more than one call"),
        (
            problems is not None and row.problems != problems,
            f"{row.problems} problems instead of {problems}",
        ), (all_judged and row.error_problems, "a judgment failed"),
    ]
    if found := [text for bad, text in faults if bad]:
        raise ConstraintError("; ".join(found))


def bare_answer(value: Column) -> Column:
    """Answer without sizing commands, white space and dollar signs or full stops at its ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\(?:left|right)", ""), r"[\s\p{Z}]+", ""), r"^[$.]+|[$.]+$", ""))


def annotation_problem(tags_ok: Column, graph_problem: Column, spans: Column, gold: Column) -> Column:
    """First reason a teacher's annotation is refused, null if it is accepted: a broken graph, wrong tags, a node without text, no
    boxed answer in main, or one that differs from the gold answer."""
    main = F.try_element_at(F.filter(spans, lambda s: s["node_id"] == "main"), F.lit(1))
    return (
        F.when(graph_problem.isNotNull(), F.concat(F.lit("graph: "), graph_problem))
        .when(~F.coalesce(tags_ok, F.lit(False)), "tags")
        .when(main["extracted_answer"].isNull(), "no boxed answer")
        .when(~F.coalesce(bare_answer(main["extracted_answer"]) == bare_answer(gold), F.lit(False)), "answer differs")
        .when(F.exists(spans, lambda s: F.coalesce(s["raw_text"], F.lit("")) == ""), "empty span")
    )


def signature_text(signature: Column) -> Column:
    """A signature without backticks, a leading def and a closing colon."""
    bare = F.trim(F.regexp_replace(F.trim(signature), r"^`+|`+$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^def\s+", ""), r"\s*:$", ""))


def problem_text(columns: list[Column], user_messages: Column) -> Column:
    """First non-blank of the columns, else problem or text of the first user message that is a JSON object with one; else empty."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    told = F.filter(
        F.transform(
            user_messages,
            lambda m: F.coalesce(filled(F.get_json_object(m, "$.problem")), filled(F.get_json_object(m, "$.text"))),
        ), lambda t: t.isNotNull()
    )
    return F.coalesce(*(filled(c) for c in columns), F.try_element_at(told, F.lit(1)), F.lit(""))


def shown_failures(failures: Column, fields: list[str]) -> Column:
    """Failures reduced to the fields a prompt may show, so hidden values and gold answers stay out."""
    kept = [f for f in SHOWN if f in fields]
    return F.transform(failures, lambda x: F.struct(*(x[f].alias(f) for f in kept)))


def failures_of(parts: dict[str, Column], node: Column) -> Column:
    """Array of (type, node) for every condition that holds, in the order given."""
    return F.array_compact(
        F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("type"), node.alias("node"))) for name, bad in parts.items()))
    )
