"""Node scores, rewards, span rewards and group-relative advantages as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the published main run; the code defaults are all 0 with a gate floor of 1.
MAIN_WEIGHTS = {
    "format": 0.1, "signature": 0.15, "execution": 0.5, "unit_test": 0.75, "property_test": 0.5, "final": 1.5, "node": 0.0, "edge": 0.05,
    "backward": 0.75, "consensus": 0.0, "efficiency": 0.0, "repair": 0.0, "teacher": 0.0, "gate_floor": 0.25, "span_credit": 0.5,
}
NODE_WEIGHTS = (0.25, 0.5, 0.25)


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def pass_rate(tests: Column, default: float = 0.0) -> Column:
    """Share of passed tests in an array of structs; the default for none."""
    n = F.size(tests)
    return F.when(n > 0, F.size(F.filter(tests, lambda t: F.coalesce(t["passed"], F.lit(False)))) / n).otherwise(F.lit(default))


def node_score(text: Column, expects: Column, executable: Column, tests: Column, static: Column, weights: tuple[float, float, float] = NODE_WEIGHTS) -> Column:
    """Struct (execution, unit, property, combined) of a node.

    A missing text scores 0 throughout. `static` is the property score of a node that is checked without running (null if not).
    Only applicable parts weigh in; combined is null (not 0) where none applies.
    """
    unit = F.filter(tests, lambda t: F.coalesce(t["kind"], F.lit("unit")) == "unit")
    props = F.filter(tests, lambda t: t["kind"] == "property")
    execution = F.when(expects, F.coalesce(executable, F.lit(False)).cast("double")).otherwise(F.lit(0.0))
    unit_score = pass_rate(unit)
    property_score = F.when(F.size(props) > 0, pass_rate(props)).otherwise(F.coalesce(static, F.lit(0.0)))
    parts = [
        (expects, execution, weights[0]),
        (F.size(unit) > 0, unit_score, weights[1]),
        ((F.size(props) > 0) | static.isNotNull(), property_score, weights[2]),
    ]
    top = sum((F.when(on, F.lit(w) * score).otherwise(F.lit(0.0)) for on, score, w in parts), F.lit(0.0))
    bottom = sum((F.when(on, F.lit(w)).otherwise(F.lit(0.0)) for on, _, w in parts), F.lit(0.0))
    silent = F.coalesce(text, F.lit("")) == ""
    zero = lambda c: F.when(silent, F.lit(0.0)).otherwise(c)
    return F.struct(
        zero(execution).alias("execution"),
        zero(unit_score).alias("unit"),
        zero(property_score).alias("property"),
        zero(F.try_divide(top, bottom)).alias("combined"),
    )


def applicable_mean(nodes: Column, scores: Column, kind: str) -> Column:
    """Mean over the nodes of the specification to which a kind applies; a missing score counts 0, no applicable node gives 0."""
    applies = {
        "execution": lambda n: (n["expected_output_type"] == "python_function") | (F.size(n["tests"]) > 0),
        "unit": lambda n: F.exists(n["tests"], lambda t: F.coalesce(t["kind"], F.lit("unit")) == "unit"),
        "property": lambda n: F.exists(n["tests"], lambda t: t["kind"] == "property"),
    }[kind]
    held = F.filter(nodes, lambda n: F.coalesce(applies(n), F.lit(False)))
    total = F.aggregate(held, F.lit(0.0), lambda s, n: s + F.coalesce(F.try_element_at(scores, n["id"]), F.lit(0.0)))
    return F.coalesce(F.try_divide(total, F.size(held)), F.lit(0.0))


def spoken_words(texts: Column) -> Column:
    """Words between blanks of an array of texts."""
    return F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")))


def efficiency_penalty(
    runtime: Column, tool_calls: Column, tokens: Column, texts: Column | None = None, runtime_budget: float = 5.0, tool_budget: float = 8.0, token_budget: float = 2048.0
) -> Column:
    """Mean of three shares of a budget, each at most 1; a budget of 0 gives 0.

    Where no tokens are counted (null or 0) the words of the texts (the spans of the response) stand in for them.
    """
    if texts is not None:
        tokens = F.when(tokens > 0, tokens).otherwise(F.coalesce(spoken_words(texts), F.lit(0)))
    share = lambda used, budget: F.least(F.lit(1.0), F.coalesce(used.cast("double"), F.lit(0.0)) / F.lit(budget)) if budget else F.lit(0.0)
    return (share(runtime, runtime_budget) + share(tool_calls, tool_budget) + share(tokens, token_budget)) / 3.0


def reward_parts(c: dict[str, Column], weights: dict[str, float] = MAIN_WEIGHTS) -> dict[str, Column]:
    """Answer gate and total reward from component columns.

    Components: format, signature, execution, unit_test, property_test, node, edge, final, backward, consensus, teacher,
    efficiency, repaired. Missing ones count 0. The penalties lie outside of the format gate.
    """
    v = lambda name: F.coalesce(c[name].cast("double"), F.lit(0.0)) if name in c else F.lit(0.0)
    w = lambda name: F.lit(float(weights.get(name, 0.0)))
    floor = float(weights.get("gate_floor", 1.0))
    gate = F.lit(floor) + F.lit(1.0 - floor) * v("final")
    structure = w("format") * v("format") + w("signature") * v("signature")
    process = sum((w(k) * v(k) for k in ("execution", "unit_test", "property_test", "node", "edge")), F.lit(0.0))
    outcome = sum((w(k) * v(k) for k in ("final", "backward", "consensus")), F.lit(0.0))
    teacher = w("teacher") * clamp(v("teacher"))
    total = v("format") * (structure + gate * process + outcome + teacher) - w("efficiency") * v("efficiency") - w("repair") * v("repaired")
    return {"answer_gate": F.bround(gate, 6), "total_reward": F.bround(total, 6)}


def span_rewards(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame, weights: dict[str, float] = MAIN_WEIGHTS) -> DataFrame:
    """(rollout_id, node_id, reward): a node's own terms, half the credit of each edge at both ends, and the outcome for main.

    nodes: rollout_id, node_id, signature, node, execution, unit_test, property_test, teacher (scores, null is 0).
    edges: rollout_id, source, target, score. outcomes: rollout_id, format, final, backward, consensus, teacher.
    Parallel edges all give credit; an endpoint without a node of its own gets a row; without format everything is 0.
    """
    w = lambda name: F.lit(float(weights.get(name, 0.0)))
    z = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    floor = float(weights.get("gate_floor", 1.0))
    gates = outcomes.select(
        "rollout_id", z("format").alias("_format"), (
            F.lit(floor) + F.lit(1 - floor) * z("final")
        ).alias("_gate"), F.coalesce("teacher", F.lit(0.0)).alias("_teacher"),
        (w("span_credit") * (w("final") * z("final") + w("backward") * z("backward"))).alias("_shared"),
        (w("final") * z("final") + w("backward") * z("backward") + w("consensus") * z("consensus")).alias("_outcome"),
    )
    own = nodes.join(gates, "rollout_id").select(
        "rollout_id", "node_id",
        (w("signature") * z("signature")
         + F.col("_gate") * (
             w("node") * z("node") + w("execution") * z("execution") + w("unit_test") * z("unit_test") + w("property_test") * z("property_test")
         )
         + F.when(F.col("node_id") != "main", F.col("_shared")).otherwise(F.lit(0.0)) + w("teacher") * clamp(F.coalesce("teacher", "_teacher"))).alias("part"),
    )
    credit = F.lit(0.5) * F.col("_gate") * w("edge") * z("score")
    ends = edges.join(gates, "rollout_id").select("rollout_id", F.explode(F.array("source", "target")).alias("node_id"), credit.alias("part"))
    main = gates.select("rollout_id", F.lit("main").alias("node_id"), F.col("_outcome").alias("part"))
    total = own.unionByName(ends).unionByName(main).groupBy("rollout_id", "node_id").agg(F.sum("part").alias("_sum"))
    return total.join(gates.select("rollout_id", "_format"), "rollout_id").select(
        "rollout_id",
        "node_id",
        F.bround(F.when(F.col("_format") == 0, 0.0).otherwise(F.col("_sum")), 6).alias("reward"),
    )


def group_advantages(rows: DataFrame, group: list[str], value: str, into: str = "advantage") -> DataFrame:
    """(value - mean) / population deviation within the group, 0 where the deviation is under 1e-8; null values give null.

    Mean and deviation come from one aggregate that combines before the shuffle and join back, so a group that holds a third of
    the rows is never one sorted task as a window over it would be.
    """
    stats = rows.groupBy(*(F.col(g).alias(f"__g_{g}") for g in group)).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    scaled = F.when(F.col(value).isNull(), F.lit(None)).when(F.col("_std") < 1e-8, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_std"))
    return rows.join(stats, same).withColumn(into, scaled).drop("_mean", "_std", *(f"__g_{g}" for g in group))


def span_advantages(rollouts: DataFrame, rewards: DataFrame) -> DataFrame:
    """(problem_id, rollout_id, node_id, reward, advantage): rewards normalised per problem and node; a rollout without the node counts 0.

    rollouts: problem_id, rollout_id; rewards: rollout_id, node_id, reward. Missing keys enter by counts, not by a cross product:
    the mean and deviation of a node use the number of the problem's rollouts, and rows for missing keys are made per rollout
    from the problem's list of nodes (a graph's, bounded).
    """
    keyed = rewards.join(rollouts, "rollout_id")
    nodes = keyed.groupBy("problem_id").agg(F.collect_set("node_id").alias("_nodes"))
    dense = rollouts.join(nodes, "problem_id").select("problem_id", "rollout_id", F.explode("_nodes").alias("node_id"))
    filled = dense.join(rewards, ["rollout_id", "node_id"], "left").withColumn("reward", F.coalesce("reward", F.lit(0.0)))
    return group_advantages(filled, ["problem_id", "node_id"], "reward")


def token_advantages(length: Column, ranges: Column, advantages: Column) -> Column:
    """An advantage per token: ranges (node, start, end) in node order over 0; a later range overwrites an earlier one."""
    tokens = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))

    def of(t: Column) -> Column:
        return F.aggregate(
            ranges,
            F.lit(0.0),
            lambda a, r: F.when((t >= r["start"]) & (t < r["end"]), F.coalesce(F.try_element_at(advantages, r["node"]), F.lit(0.0))).otherwise(a),
        )

    return F.transform(tokens, of)


def consensus(values: DataFrame, problem: str = "problem_id", rollout: str = "rollout_id", node: str = "node_id", value: str = "value") -> DataFrame:
    """(problem, rollout, consensus): per rollout the mean, over nodes with a value, of the share of the group's values equal to its own.

    Counts per value combine before the shuffle; no window over a hot problem.
    """
    said = values.where(F.col(value).isNotNull())
    equal = said.groupBy(problem, node, value).agg(F.count("*").alias("_equal"))
    every = equal.groupBy(problem, node).agg(F.sum("_equal").alias("_all"))
    share = said.join(equal, [problem, node, value]).join(every, [problem, node]).withColumn("_share", F.col("_equal") / F.col("_all"))
    scored = share.groupBy(problem, rollout).agg(F.avg("_share").alias("consensus"))
    everyone = values.select(problem, rollout).distinct()
    return everyone.join(scored, [problem, rollout], "left").withColumn("consensus", F.coalesce("consensus", F.lit(0.0)))


def failure_class(failures: Column) -> Column:
    """execution before dependency and verification; none for an empty list. A failure's type decides."""
    has = lambda *types: F.exists(failures, lambda f: f["type"].isin(*types))
    return (
        F.when(F.coalesce(F.size(failures), F.lit(0)) <= 0, "none")
        .when(has("execution_failure", "parse_failure"), "execution")
        .when(has("dependency_failure"), "dependency")
        .otherwise("verification")
    )


def backward_score(target_call: Column, answer: Column, matched: Column) -> Column:
    """1 if the target call's output equals the main answer, 0 if not, null where there is no target call."""
    return F.when(F.coalesce(target_call, F.lit("")) == "", F.lit(None).cast("double")).otherwise(
        F.coalesce(matched & answer.isNotNull(), F.lit(False)).cast("double")
    )
