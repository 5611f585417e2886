"""Verification records of responses: final and backward scores, typed failures, and checks of a locked evaluation before it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.answers import answer_equivalence
from millrace.operators import records

#: Fixed value: the severity of an edge whose break is a failure.
CRITICAL = "critical"
FAILURE = "struct<type:string,node:string,edge:string,relation_type:string,equivalence_method:string>"


def _failure(kind: str, node: Column | None = None, edge: Column | None = None, relation: Column | None = None, method: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        F.lit(kind).alias("type"),
        text(node).alias("node"),
        text(edge).alias("edge"),
        text(relation).alias("relation_type"),
        text(method).alias("equivalence_method"),
    )


def scored_answers(rows: DataFrame) -> DataFrame:
    """Rows (predicted, gold, target_call, outputs map, ...) with final_score, backward_score and equivalence_method.

    A missing answer or gold answer scores 0. backward_score is null where there is no target call: not applicable; else 1 if the
    output of that call equals the answer, 0 if not or if it was never called.
    """
    called = F.when(F.coalesce("target_call", F.lit("")) != "", F.try_element_at("outputs", F.col("target_call")))
    judged = rows.withColumns({"_final": answer_equivalence(F.col("predicted"), F.col("gold")), "_called": called})
    judged = judged.withColumn("_back", answer_equivalence(F.col("_called"), F.col("predicted")))
    score = lambda c: F.coalesce(F.col(f"{c}.equivalent").cast("double"), F.lit(0.0))
    back = F.when(F.coalesce("target_call", F.lit("")) != "", score("_back"))
    return judged.withColumns(
        {"final_score": score("_final"), "backward_score": back, "equivalence_method": F.col("_final.method")}
    ).drop("_final", "_called", "_back")


def failure_records(nodes: Column, edges: Column, final_score: Column, backward_score: Column, method: Column) -> Column:
    """Typed failures of a response, in order: nodes whose code does not run or whose tests fail, critical edges below 1, a wrong final
    answer, a target call that disagrees.

    Nodes are (id, executable, passed), edges (source, target, relation_type, severity, score). Only an edge of severity "critical"
    makes a failure, whatever other names a severity has.
    """
    none = F.array().cast(f"array<{FAILURE}>")
    broken = F.transform(F.filter(nodes, lambda n: ~F.coalesce(n["executable"], F.lit(False))), lambda n: _failure("execution_failure", node=n["id"]))
    wrong = F.transform(
        F.filter(nodes, lambda n: F.coalesce(n["executable"], F.lit(False)) & ~F.coalesce(n["passed"], F.lit(False))),
        lambda n: _failure("test_failure", node=n["id"]),
    )
    name = lambda e: F.concat(e["source"], F.lit("->"), e["target"])
    loose = F.filter(edges, lambda e: (F.coalesce(e["severity"], F.lit("")) == CRITICAL) & (F.coalesce(e["score"], F.lit(0.0)) < 1))
    apart = F.transform(loose, lambda e: _failure("dependency_failure", edge=name(e), relation=e["relation_type"]))
    final = F.when(F.coalesce(final_score, F.lit(0.0)) < 1, F.array(_failure("final_answer_failure", method=method))).otherwise(none)
    back = F.when(backward_score < 1, F.array(_failure("backward_constraint_failure"))).otherwise(none)
    return F.concat(F.coalesce(broken, none), F.coalesce(wrong, none), F.coalesce(apart, none), final, back)


def row_summary(rows: DataFrame, **by: Column) -> DataFrame:
    """One row about a selection: rows, and for each named column a map of its values to their counts; nulls are "null". The maps are as
    large as the lists of values, so they are for labels, not for ids."""
    labels = F.array(*(F.struct(F.lit(name).alias("name"), F.coalesce(c.cast("string"), F.lit("null")).alias("value")) for name, c in by.items()))
    counted = rows.select(F.inline(labels)).groupBy("name", "value").agg(F.count("*").alias("n"))
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("value", "n"))))).alias(f"{name}_counts") for name in by]
    first = next(iter(by))
    return counted.agg(F.coalesce(F.sum(F.when(F.col("name") == first, F.col("n"))), F.lit(0)).alias("rows"), *maps)


def locked_fault(rows: DataFrame, key: str, locked: bool, wanted_rows: int, wanted_digest: str, others: dict[str, DataFrame]) -> str | None:
    """The first reason a locked evaluation may not be used, null if it may: not locked, another number of rows, other ids than those
    digested, or ids that another table (training, earlier evaluations) holds. Eager; looks at counts and one digest only."""
    if not locked:
        return "not locked"
    found = records.ids_digest(rows, key, True).first()
    if found.rows != wanted_rows:
        return f"{found.rows} rows instead of {wanted_rows}"
    if found.ids_sha256 != wanted_digest:
        return "other ids"
    for name, other in others.items():
        if shared := rows.join(other.select(key).distinct(), key, "left_semi").count():
            return f"{shared} ids of {name}"
    return None
