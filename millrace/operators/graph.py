"""Checks and scores of function graphs kept as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut_lineage

MAX_NODES = 64


def exploded(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, nodes, edges) to nodes (graph_id, pos, ...) and edges (graph_id, pos, ...)."""
    nodes = graphs.select("graph_id", F.posexplode("nodes").alias("pos", "n")).select("graph_id", "pos", "n.*")
    edges = graphs.select("graph_id", F.posexplode("edges").alias("pos", "e")).select("graph_id", "pos", "e.*")
    return nodes, edges


def _reach(ids: Column, edges: Column, start: Column, max_nodes: int) -> Column:
    """Ids from which `start` can be reached, within one row's arrays: as many closure steps as a graph may have nodes.

    Graphs are bounded by max_nodes (checked before), so the closure stays inside whole-stage evaluation and needs no join.
    """
    def step(seen: Column, _: Column) -> Column:
        more = F.transform(F.filter(edges, lambda e: F.array_contains(seen, e["target"])), lambda e: e["source"])
        return F.array_union(seen, more)

    rounds = F.sequence(F.lit(1), F.least(F.greatest(F.size(ids), F.lit(1)), F.lit(max_nodes)))
    return F.aggregate(rounds, start, step)


def ancestors_of_main(graphs: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(graph_id, node): main and every node with a path to it; cycles do no harm."""
    ids = F.transform("nodes", lambda n: n["id"])
    reached = _reach(ids, F.col("edges"), F.array(F.lit("main")), max_nodes)
    return graphs.where(F.array_contains(ids, "main")).select("graph_id", F.explode(F.array_intersect(reached, ids)).alias("node"))


def is_acyclic(ids: Column, edges: Column, max_nodes: int = MAX_NODES) -> Column:
    """Leaves are peeled off until nothing changes; a graph is acyclic if nothing is left."""
    def peel(left: Column, _: Column) -> Column:
        return F.filter(left, lambda i: F.exists(edges, lambda e: (e["source"] == i) & F.array_contains(left, e["target"])))

    rounds = F.sequence(F.lit(1), F.least(F.greatest(F.size(ids), F.lit(1)), F.lit(max_nodes)))
    return F.size(F.aggregate(rounds, ids, peel)) == 0


def problem_column(nodes: Column, edges: Column, max_nodes: int = MAX_NODES) -> Column:
    """The first rule the graph of a row breaks, null if it is valid; edges must be an array, not null.

    Rules in order: 1..max nodes, different ids, a node main, id syntax, required fields, known endpoints, no loop, main is a
    sink, no cycle, every node contributes to main.
    """
    ids = F.transform(nodes, lambda n: n["id"])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = [
        (F.coalesce(F.size(nodes), F.lit(0)) <= 0, "no nodes"),
        (F.size(nodes) > max_nodes, "too many nodes"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate ids"),
        (~F.array_contains(ids, "main"), "no main"),
        (F.exists(nodes, lambda n: ~F.coalesce(n["id"].rlike(r"\A[A-Za-z][A-Za-z0-9_]*\z"), F.lit(False))), "invalid id"),
        (F.exists(nodes, lambda n: blank(n["question"]) | blank(n["signature"]) | blank(n["expected_output_type"])), "missing field"),
        (F.exists(edges, lambda e: ~F.coalesce(F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]), F.lit(False))), "unknown endpoint"),
        (F.exists(edges, lambda e: e["source"] == e["target"]), "self edge"),
        (F.exists(edges, lambda e: e["source"] == "main"), "main is no sink"),
    ]
    cheap = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        cheap = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(cheap)
    deep = F.when(~is_acyclic(ids, edges, max_nodes), "cycle").when(
        F.size(F.array_except(ids, _reach(ids, edges, F.array(F.lit("main")), max_nodes))) > 0, "disconnected"
    )
    return F.coalesce(cheap, deep)


def graph_problem(graphs: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(graph_id, problem): the first rule of problem_column a graph breaks, null if it is valid; null edges are none."""
    edges = F.coalesce("edges", F.array().cast(graphs.schema["edges"].dataType))
    return graphs.select("graph_id", problem_column(F.col("nodes"), edges, max_nodes).alias("problem"))


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """(graph_id, node) reachable against the edge direction (graph_id, source, target) from start (graph_id, node), at any graph size.

    Frontier by frontier, each cut in the checkpoint folder; for graphs too large for one row.
    """
    seen = cut_lineage(start.select("graph_id", "node").distinct())
    frontier = seen
    for _ in range(rounds):
        step = edges.join(frontier.withColumnRenamed("node", "target"), ["graph_id", "target"]).select("graph_id", F.col("source").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["graph_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))
    raise RuntimeError(f"no fixed point in {rounds} rounds")


def edge_key(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), target)


def edge_scores(edges: DataFrame) -> DataFrame:
    """Edges with `score` by relation; each row holds what its relation needs of both ends (nulls where an end is missing).

    uses_value: share of the parent's values (map parent_values) found in the child's text or outputs (child_evidence).
    implements_formula: pass rate of the child's property tests, else of all (child_tests), if the parent said something and the child ran.
    aggregates_result: a test value of the parent equals the child's answer (answer_matches). equivalent_output: equal output maps.
    An unknown relation scores 0.
    """
    values = F.map_values("parent_values")
    uses = F.try_divide(F.size(F.filter(values, lambda v: F.contains(F.col("child_evidence"), v))), F.size(values))
    props = F.filter("child_tests", lambda t: t["kind"] == "property")
    tests = F.when(F.size(props) > 0, props).otherwise(F.col("child_tests"))
    passed = F.try_divide(F.size(F.filter(tests, lambda t: F.coalesce(t["passed"], F.lit(False)))), F.size(tests))
    formula = F.when((F.coalesce("parent_text", F.lit("")) != "") & F.coalesce("child_executable", F.lit(False)), passed)
    entries = lambda m: F.array_sort(F.map_entries(m))
    equal = (entries("parent_outputs") == entries("child_outputs")).cast("double")
    score = (
        F.when(F.col("relation_type") == "uses_value", uses)
        .when(F.col("relation_type") == "implements_formula", formula)
        .when(F.col("relation_type") == "aggregates_result", F.col("answer_matches").cast("double"))
        .when(F.col("relation_type") == "equivalent_output", equal)
    )
    return edges.withColumn("score", F.coalesce(score.cast("double"), F.lit(0.0)))
