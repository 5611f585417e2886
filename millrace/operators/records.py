"""Derived training and evaluation records: projections, chat records, encoded features, bundles, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import chatml

#: Keys that must not leave the private side; the four lists differ on purpose.
PRIVATE_KEYS = {
    "selection": ("mutant_code", "reference_code", "reference_solution", "tagged_solution", "verifier_implementations"),
    "bundle": ("expected", "expected_value", "expected_values", "formula", "values", "tests", "target_call", "reference_code", "mutant_code"),
    "code_sft": (
        "expected", "expected_value", "expected_values", "formula", "values", "tests", "target_call", "reference_code", "mutant_code",
        "verification_graph", "verifier_implementations",
    ),
    "export": (
        "gold_answer", "answer", "target_call", "tests", "expected", "reference_implementation", "mutant_implementation", "hidden_tests",
        "verification_graph", "verifier_annotation", "verifier_execution_audit",
    ),
}
IGNORED_LABEL, MOST_IDS = -100, 5_000_000


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(rows: DataFrame, key: str, tasks: dict[str, list[Column]]) -> DataFrame:
    """(id, task, messages): every row fans out to one record a task, id with the task's name as ending."""
    made = F.array(
        *(
            F.struct(
                F.concat(F.col(key), F.lit(f":{task}")).alias("id"),
                F.lit(task).alias("task"),
                F.array(*messages).alias("messages"),
            ) for task, messages in tasks.items()
        )
    )
    return rows.select(F.inline(made))


def ends_with_answer(messages: Column) -> Column:
    """At least two messages, the last one a non-blank turn of the assistant."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.coalesce((F.size(messages) >= 2) & (last["role"] == "assistant") & (F.trim(last["content"]) != ""), F.lit(False))


def encoded(rows: DataFrame, prompt: str, completion: str, longest: int) -> DataFrame:
    """(input_ids, attention_mask, labels) from token ids of prompt and completion.

    The prompt keeps its suffix so that the completion fits; its labels are masked. Completions that do not fit or are empty
    leave no row: count them with `ends_with_answer` and a size check before.
    """
    room = F.lit(longest) - F.size(completion)
    kept = F.when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(F.col(prompt))
    held = rows.where((F.size(completion) > 0) & (F.size(completion) < longest)).withColumn("_kept", kept)
    ids = F.concat("_kept", completion)
    return held.select(
        *(c for c in rows.columns if c not in (prompt, completion)), ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"),
        F.concat(F.transform("_kept", lambda _: F.lit(IGNORED_LABEL)), completion).alias("labels"),
    )


def padded(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Encoded rows padded on the right to the longest of their batch; batches are small, so their maximum joins back by an aggregate."""
    longest = rows.groupBy(F.col(batch).alias("_b")).agg(F.max(F.size("input_ids")).alias("_n"))
    wide = rows.join(longest, F.col(batch) == F.col("_b"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), (F.col("_n") - F.size(c)).cast("int")))
    return wide.withColumns(
        {"input_ids": fill("input_ids", pad), "attention_mask": fill("attention_mask", 0), "labels": fill("labels", IGNORED_LABEL)}
    ).drop("_b", "_n")


def rendered(messages: Column) -> Column:
    return chatml(messages)


def public_rows(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, in their order."""
    return rows.select(*(c for c in allowed if c in rows.columns))


def without_private(rows: DataFrame, metadata: str, fields: tuple[str, ...]) -> DataFrame:
    """A metadata struct without its private fields."""
    present = {f.name for f in rows.schema[metadata].dataType.fields}
    drop = [f for f in fields if f in present]
    return rows.withColumn(metadata, F.col(metadata).dropFields(*drop)) if drop else rows


def bounded_text(text: Column, longest: int = 2400) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def last_line(text: Column, longest: int = 500) -> Column:
    """Last non-blank line, its last characters, null without one."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    line = F.trim(F.try_element_at(lines, F.lit(-1)))
    return F.substring(line, F.greatest(F.length(line) - longest + 1, F.lit(1)), F.lit(longest))


def ids_digest(rows: DataFrame, key: str, newline_at_end: bool, order: str | None = None) -> DataFrame:
    """One row: SHA-256 of the ids joined by line breaks, in id order or that of another column.

    For locked sets and manifests, whose size a plan bounds; the joined ids are one string, so more than MOST_IDS of them are an error.
    """
    joined = F.expr(f"listagg({key}, '\\n') within group (order by {order or key})")
    digest = F.sha2(F.concat(F.coalesce(joined, F.lit("")), F.lit("\n" if newline_at_end else "")), 256)
    counted = rows.agg(digest.alias("ids_sha256"), F.count("*").alias("rows"))
    return counted.withColumn(
        "ids_sha256",
        F.when(F.col("rows") <= MOST_IDS, F.col("ids_sha256")).otherwise(F.raise_error(F.lit(f"more than {MOST_IDS} ids in one digest"))),
    )


def run_accepted(results: DataFrame, by: list[str]) -> DataFrame:
    """Accepted and rejected verifiers and their rate: the reference passes, the backward answer agrees, a mutant is caught."""
    good = F.coalesce(F.col("reference_passes") & F.col("backward_agrees") & F.col("mutant_caught"), F.lit(False))
    return results.groupBy(*by).agg(
        F.count_if(good).alias("accepted"),
        F.count_if(~good).alias("rejected"),
        F.round(F.avg(good.cast("double")), 6).alias("acceptance_rate"),
    )
