"""Sinks: JSON lines by the commit protocol, manifests, reports, digests."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, nulls kept. overwrite replaces as a whole, errorifexists refuses, append adds."""
    if mode not in ("overwrite", "errorifexists", "append"):
        raise ValueError(mode)
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_manifest(summary: DataFrame, path: str) -> dict:
    """A one-row frame as an indented JSON file, written beside the target and renamed."""
    found = summary.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a manifest is one row")
    value = found[0].asDict(recursive=True)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_name(target.name + ".tmp")
    temporary.write_text(json.dumps(value, indent=2, sort_keys=True, default=str, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(temporary, target)
    return value


def keep_manifest(summary: DataFrame, path: str) -> dict:
    """Writes a manifest once; if there is one, it must say the same, else results would be mixed."""
    if not Path(path).exists():
        return write_manifest(summary, path)
    known, value = json.loads(Path(path).read_text(encoding="utf-8")), summary.first().asDict(recursive=True)
    if known != json.loads(json.dumps(value, default=str)):
        raise ValueError(f"{path} differs from the new manifest")
    return known


def markdown_report(rows: DataFrame, path: str, title: str) -> int:
    """A report table of all rows: rates as percentages with one decimal, p values with four; the number of rows.

    Rows are fetched partition by partition and written as they come, to a file beside the target that is then renamed.
    """

    def cell(name: str, value: object) -> str:
        if value is None:
            return "-"
        if isinstance(value, float):
            return f"{value:.4f}" if name.startswith("p_") else f"{100 * value:.1f} %" if name.endswith(("rate", "low", "high", "difference")) else f"{value:g}"
        return str(value)

    written, beside = 0, Path(path + ".tmp")
    with beside.open("w", encoding="utf-8") as out:
        out.write(f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n")
        for r in rows.toLocalIterator():
            out.write("| " + " | ".join(cell(c, r[c]) for c in rows.columns) + " |\n")
            written += 1
    os.replace(beside, path)
    return written


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(folder: str) -> str:
    """SHA-256 over sorted relative paths and contents, separated by zero bytes; caches are left out."""
    total = hashlib.sha256()
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file() and "__pycache__" not in p.parts:
            total.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes() + b"\0")
    return total.hexdigest()


def replace_table(rows: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Overwrites a parquet table so that a crash at any point loses nothing: new rows are written beside it, the old table is
    renamed aside, the new one is renamed in, and only then the old one is deleted. `recovered` undoes a half-done swap."""
    fs, here, beside, aside = _paths(rows.sparkSession, path)
    recovered(rows.sparkSession, path)
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path + ".next")
    if fs.exists(here):
        fs.rename(here, aside)
    fs.rename(beside, here)
    fs.delete(aside, True)


def _paths(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    here = at(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here, at(path + ".next"), at(path + ".previous")


def recovered(spark, path: str) -> bool:
    """Whether there is a table, after putting back one that a crash left renamed aside."""
    fs, here, _, aside = _paths(spark, path)
    if not fs.exists(here) and fs.exists(aside):
        fs.rename(aside, here)
    return fs.exists(here)


def upsert_batch(batch: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Checkpointed incremental output: old and new rows by key, newest by `order`, swapped in by replace_table."""
    from millrace.operators.dedup import last_wins

    spark = batch.sparkSession
    old = spark.read.parquet(path) if recovered(spark, path) else None
    replace_table(last_wins(batch if old is None else old.unionByName(batch), key, order), path)


#: The stores of a memory and the arrays of its snapshot.
STORES = {
    "theorem": "theorem_items",
    "algorithm_template": "algorithm_templates",
    "prior_decomposition": "prior_decompositions",
    "failure_case": "failure_cases",
}


def write_memory(items: DataFrame, path: str) -> None:
    """A memory of items (memory_type, id, ...) as a table with a folder per store, replaced as a whole."""
    replace_table(items, path, ("memory_type",))


def memory_snapshot(items: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row with an array of items per store, in their order: the snapshot as one object. For memories that fit in a row; larger
    ones are kept by write_memory."""
    fields = [c for c in items.columns if c not in ("memory_type", order)]
    one = F.struct(order, *fields)
    arrays = [F.sort_array(F.collect_list(F.when(F.col("memory_type") == store, one))).alias(name) for store, name in STORES.items()]
    made = items.agg(*arrays)
    return made.select(*(F.transform(name, lambda i: i.dropFields(order)).alias(name) for name in STORES.values()))


def load_memory(seeds: list[DataFrame], snapshot: DataFrame | None, key: str = "id") -> DataFrame:
    """Seed items, then the persisted ones over them: within a store an item of the snapshot replaces the seed with its id."""
    from millrace.operators.dedup import upsert

    out = seeds[0]
    for more in seeds[1:]:
        out = out.unionByName(more)
    if snapshot is None:
        return out
    both = (df.withColumn("_k", _store_key(key)) for df in (out, snapshot.select(*out.columns)))
    return upsert(*both, "_k").drop("_k")


def _store_key(key: str):
    return F.concat_ws("|", "memory_type", key)


def mistakes(trajectories: DataFrame) -> DataFrame:
    """(problem, function_graph, rollout, execution, verification, repair): the records whose repair failed, one row each."""
    held = trajectories.select("problem", "function_graph", F.explode("rollout_records").alias("r")).where("r.repair.status = 'failed'")
    return held.select("problem", "function_graph", "r.rollout", "r.execution", "r.verification", "r.repair")


def append_mistakes(trajectories: DataFrame, path: str) -> None:
    """The notebook of mistakes: failed repairs are appended as JSON lines."""
    write_json_lines(mistakes(trajectories), path, "append")
