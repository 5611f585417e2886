"""Typed sources of nested JSON records. Schemas are given, never inferred, so that "2" and "2.0" stay what they are."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A file does not hold what it must."""


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, check: bool = True) -> DataFrame:
    """JSON lines of one or several files, all rows of all files. Blank lines are skipped.

    Lines that are no JSON object, or that hold a field of another type than the schema's, raise with examples (`check`, one eager
    pass); unchecked, lines that are no object are left out and such fields are null. Numbers and booleans are no fault where the
    schema says string: they are read as they are spelled. Catalyst parses only the fields that a query uses.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(paths if isinstance(paths, list) else [paths]).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    good = parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    if check:
        if found := [r[0][:80] for r in lines.where(~good).limit(5).collect()]:
            raise SourceError(f"lines that are no JSON object: {found}")
        wrong = _mistyped(typed, parsed, F.from_json("value", typed), "$")
        if found := [(r[0][:80], r[1]) for r in lines.select("value", F.array_compact(F.array(*wrong)).alias("w")).where(F.size("w") > 0).limit(5).collect()]:
            raise SourceError(f"fields of another type: {found}")
    else:
        lines = lines.where(good)
    return lines.select(F.from_json("value", typed).alias("r")).select("r.*")


def _mistyped(typed: T.StructType, parsed: Column, read: Column, path: str) -> list[Column]:
    """Paths of fields that are there and not null but were not read as their type; structs are looked into."""
    out = []
    for field in typed.fields:
        at = f"{path}['{field.name}']"
        there = F.try_variant_get(parsed, at, "variant")
        out.append(F.when(there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(True)) & read[field.name].isNull(), F.lit(at)))
        if isinstance(field.dataType, T.StructType):
            out += _mistyped(field.dataType, parsed, read[field.name], at)
    return out


def landed(spark: SparkSession, path: str, revision: str | None = None, split: str | None = None) -> DataFrame:
    """A dataset of a hub, landed as parquet or JSON lines; a pinned revision must be part of the path.

    With `split` only the files of that split, by their name (train-00000-of-00001.parquet or a folder train/).
    """
    if revision is not None and revision not in path.split("/"):
        raise SourceError(f"{path} is not of revision {revision}")
    reader = spark.read.option("recursiveFileLookup", "true")
    if split is not None:
        reader = reader.option("pathGlobFilter", f"{split}*")
    return reader.json(path) if path.rstrip("/").endswith((".jsonl", ".json")) else reader.parquet(path)


def rank_files(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The results of all ranks of a run, files or folders <name>.rank<k>.jsonl, with a column rank; missing ranks are no fault."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(f"{folder}/*.rank*").select("value", F.input_file_name().alias("_file"))
    rank = F.regexp_extract("_file", r"\.rank(\d+)", 1).cast("int").alias("rank")
    return lines.where(F.trim("value") != "").select(F.from_json("value", typed).alias("r"), rank).select("r.*", "rank")


def json_document(spark: SparkSession, path: str, item: T.StructType | str) -> DataFrame:
    """Records of a JSON document: a list, or an object with the list under data, else under problems."""
    element = T.StructType.fromDDL(item) if isinstance(item, str) else item
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = T.ArrayType(element)
    records = F.coalesce(
        F.try_variant_get("v", "$", lists.simpleString()), F.try_variant_get("v", "$.data", lists.simpleString()), F.try_variant_get("v", "$.problems", lists.simpleString())
    )
    rows = text.select(records.alias("r"))
    if rows.where("r is null").limit(1).count():
        raise SourceError(f"{path} is neither a list nor an object with data or problems")
    return rows.select(F.inline("r"))


def optional_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As json_lines; a path that does not exist is an empty table."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], typed)
    return json_lines(spark, path, typed)


def labelled(spark: SparkSession, sources: list[str], schema: T.StructType | str) -> DataFrame:
    """Result files given as LABEL=PATH, with a column label. At least two, labels different and not empty."""
    pairs = [tuple(s.split("=", 1)) if "=" in s else ("", s) for s in sources]
    names = [p[0] for p in pairs]
    if len(pairs) < 2 or "" in names or len(set(names)) < len(names):
        raise SourceError("at least two sources with different labels are needed")
    out = None
    for name, path in pairs:
        part = json_lines(spark, path, schema).withColumn("label", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def resumable(results: DataFrame, known: DataFrame, key: str, label: str, drop_errors: bool = False) -> DataFrame:
    """Results of an earlier run that may be kept: no duplicate or unknown key and no other label, else it raises."""
    row = results.agg(
        F.count("*").alias("n"),
        F.count_distinct(key).alias("d"),
        F.count_if(~F.coalesce(F.col("adapter") == label, F.lit(False))).alias("o"),
    ).first()
    unknown = results.join(known, key, "left_anti").limit(1).count()
    if row.n != row.d or row.o or unknown:
        raise SourceError(f"{row.n - row.d} duplicates, {row.o} rows of another label, unknown keys: {bool(unknown)}")
    return results.where(~F.coalesce(F.col("status") == "error", F.lit(False))) if drop_errors else results


def dataset(rows: DataFrame, split: str | None, seed: int | None, offset: int, limit: int | None, order: Column, key: str = "id") -> DataFrame:
    """Filter by split, then shuffle (if there is a seed), offset, limit, in that order; an empty result raises."""
    from millrace.operators.sampling import seeded_order

    kept = rows.where(F.col("split") == split) if split else rows
    if seed is not None:
        out = seeded_order(kept, key, seed, offset, limit)
    else:
        out = kept.orderBy(order).offset(offset)
        out = out if limit is None else out.limit(limit)
    if out.isEmpty():
        raise SourceError("the dataset is empty")
    return out


def theorem_traces(spark: SparkSession, path: str, prefix: str, limit: int | None) -> DataFrame:
    """Traced theorems by name, of a prefix, at most `limit`."""
    rows = spark.read.parquet(path).where(F.col("full_name").startswith(prefix)).orderBy("full_name")
    return rows if limit is None else rows.limit(limit)


def knowledge(rows: DataFrame, memory_type: str, stem: str, ordinal: Column) -> DataFrame:
    """Knowledge items with an id made of type, file stem and place where it is missing; text falls back to content."""
    has = set(rows.columns)
    text = F.coalesce(*(F.col(c) for c in ("text", "content") if c in has))
    given = F.col("id") if "id" in has else F.lit(None).cast("string")
    return rows.select(
        F.coalesce(given, F.concat(F.lit(f"{memory_type}.{stem}."), ordinal.cast("string"))).alias("id"),
        F.lit(memory_type).alias("memory_type"),
        text.alias("text"),
        (F.col("keywords") if "keywords" in has else F.array().cast("array<string>")).alias("keywords"),
    )


def resolved(path: str, config: str) -> str:
    """A relative path of a configuration, from the configuration's folder."""
    return path if os.path.isabs(path) else os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(config)), path))
