"""Canonical records from raw source rows, as column expressions.

A column that is present but null differs from an absent one only in dynamic records; with typed columns the aliases here take
the first non-null value, which is the documented difference to looking at key presence.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import content_id


def normalise_problem(rows: DataFrame, ordinal: Column) -> DataFrame:
    """(id, text, gold_answer, split): aliases of raw columns resolved; split defaults to train, id to problem-<ordinal>."""
    has = set(rows.columns)

    def first(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in has]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return rows.select(
        F.coalesce(first("id", "problem_id", "uid"), F.concat(F.lit("problem-"), ordinal.cast("string"))).alias("id"),
        first("text", "problem", "question").alias("text"),
        first("gold_answer", "answer", "final_answer").alias("gold_answer"),
        F.coalesce(first("split"), F.lit("train")).alias("split"),
    )


def _record(rows: DataFrame, problem: Column, solution: Column, answer: Column, domain: Column, difficulty: Column, source: str) -> DataFrame:
    """The canonical columns; the id is made of the source's name and the problem's hash. Blank problems or solutions are left out."""
    slug = re.sub(r"[^a-z0-9]+", "_", source.lower()).strip("_")
    made = rows.select(
        problem.alias("problem"), solution.alias("reference_solution"), answer.alias("gold_answer"), domain.alias("domain"),
        difficulty.cast("string").alias("difficulty"), F.lit(source).alias("source"), F.lit("train").alias("source_split"),
    ).where("problem <> '' and reference_solution <> ''")
    return made.select(content_id(f"medium_{slug}", F.col("problem")).alias("id"), "*", F.sha2("problem", 256).alias("problem_sha256"))


def _clamped(steps: Column) -> Column:
    return F.least(F.greatest(steps, F.lit(2)), F.lit(5))


def grade_school(rows: DataFrame, source: str = "openai/gsm8k") -> DataFrame:
    """(question, answer) with the final number after ####: 3 to 8 calculator marks <<..>> are kept, difficulty is their number within 2..5."""
    steps = F.size(F.regexp_extract_all("answer", F.lit(r"<<(.*?)>>"), F.lit(1)))
    final = F.regexp_replace(F.trim(F.regexp_extract("answer", r"####\s*(.+)\s*$", 1)), ",", "")
    kept = rows.where(F.col("question").isNotNull() & steps.between(3, 8) & numeric_answer(final))
    return _record(kept, F.trim("question"), F.trim("answer"), final, F.array(F.lit("Arithmetic"), F.lit("Multi-step Word Problems")), _clamped(steps), source)


@F.pandas_udf(T.StringType())
def last_boxed(text: pd.Series) -> pd.Series:
    """Content of the last balanced boxed or fbox command; null without one."""
    return text.map(lambda t: _last_boxed(t) if t else None)


def boxed_values(text: str) -> list[str]:
    """Contents of all balanced boxed commands, outermost ones, in order; scanning stops at one that never closes."""
    found, at = [], 0
    for command in ("\\boxed{", "\\fbox{"):
        at = 0
        while (start := text.find(command, at)) >= 0:
            depth, i = 1, start + len(command)
            while i < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
            if depth:
                break
            found.append((start, text[start + len(command) : i - 1]))
            at = i
    return [value for _, value in sorted(found)]


def _last_boxed(text: str) -> str | None:
    values = boxed_values(text)
    return values[-1].strip() if values else None


def competition(rows: DataFrame, config: str, source: str = "EleutherAI/hendrycks_math", longest_answer: int = 160) -> DataFrame:
    """(problem, solution, level, type): levels 1 to 3 with a boxed answer of bounded length; `config` names the part of the source."""
    level = F.regexp_extract("level", r"(\d+)", 1).try_cast("int")
    held = rows.withColumn("_level", level).where(F.col("_level").between(1, 3)).withColumn("_answer", last_boxed("solution"))
    kept = held.where(F.col("_answer").isNotNull() & (F.col("_answer") != "") & (F.length("_answer") <= longest_answer))
    return _record(
        kept,
        F.trim("problem"),
        F.trim("solution"),
        F.col("_answer"),
        F.array(F.lit(config), F.coalesce("type", F.lit(config))),
        F.col("_level"),
        source,
    )


def option_map(options: Column) -> Column:
    """Options such as "a ) 24 , b ) 120" as a map from lower-case letter to value; a value runs to the next marker."""
    marked = F.regexp_replace(options, r"(?:^|,\s*)([a-eA-E])\s*\)\s*", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    entry = F.transform(
        parts,
        lambda p: F.struct(F.lower(F.substring(p, 1, 1)), F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r'^[ ",]+|[ ",]+$', "")),
    )
    return F.map_from_entries(
        F.aggregate(
            entry,
            F.slice(entry, 1, 0),
            lambda kept, e: F.when(F.exists(kept, lambda k: k["col1"] == e["col1"]), kept).otherwise(F.concat(kept, F.array(e))),
        )
    )


def numeric_answer(answer: Column) -> Column:
    """Holds a digit and none of the phrases that stand for no single answer."""
    return answer.rlike(r"\d") & ~F.lower(answer).rlike(r"none|cannot|insufficient|all of the above")


def multiple_choice(rows: DataFrame, source: str = "allenai/math_qa", longest_answer: int = 96) -> DataFrame:
    """(Problem, Rationale, options, correct, linear_formula, category): 2 to 5 operations and a numeric right option."""
    steps = F.size(F.filter(F.split("linear_formula", r"\|"), lambda s: F.trim(s) != ""))
    answer = F.try_element_at(option_map(F.col("options")), F.lower(F.trim("correct")))
    held = rows.withColumn("_answer", answer).where(steps.between(2, 5))
    kept = held.where(numeric_answer(F.col("_answer")) & (F.length("_answer") <= longest_answer))
    solution = F.concat(F.trim("Rationale"), F.lit("\nOperation program: "), F.trim("linear_formula"))
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general"))
    kept = kept.where(F.trim("Rationale") != "")
    return _record(kept, F.trim("Problem"), solution, F.col("_answer"), F.array(F.lit("Math Word Problems"), category), _clamped(steps), source)


BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def omni(rows: DataFrame) -> DataFrame:
    """Raw competition rows with problem, solution and answer present: trimmed, with a content id and the problem's hash."""
    strip = lambda c: F.regexp_replace(c, BLANKS, "")
    held = rows.withColumns({"problem": strip("problem"), "solution": strip("solution"), "answer": strip("answer")})
    kept = held.where((F.col("problem") != "") & (F.col("solution") != "") & (F.col("answer") != ""))
    return kept.select(
        content_id("omni_math", F.col("problem")).alias("id"), "problem", F.col("solution").alias("reference_solution"), F.col("answer").alias("gold_answer"),
        F.coalesce(
            "domain",
            F.array().cast("array<string>"),
        ).alias("domain"), "difficulty", F.coalesce("source", F.lit("unknown")).alias("source"), F.sha2("problem", 256).alias("problem_sha256"),
    )


def family(key: Column) -> Column:
    """medium for ids with that prefix, else omni."""
    return F.when(key.startswith("medium_"), "medium").otherwise("omni")


def family_by_omni(key: Column) -> Column:
    """The other published rule: omni for ids with that prefix, else medium. Ids with neither prefix differ between the two."""
    return F.when(key.startswith("omni_math_"), "omni").otherwise("medium")


def domain_key(domain: Column) -> Column:
    """First three domains joined by a slash."""
    return F.array_join(F.slice(F.coalesce(domain, F.array().cast("array<string>")), 1, 3), "/")


def topic(domain: Column) -> Column:
    """Second component of the first domain's path, or its only one; other without a domain."""
    parts = F.split(F.try_element_at(domain, F.lit(1)), r"\s*->\s*")
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)), F.lit("other"))


def difficulty_bucket(difficulty: Column) -> Column:
    """Up to 3, 6 and 8, above, or unknown where it is no number."""
    value = F.trim(difficulty).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value <= 3, "1-3").when(value <= 6, "3.5-6").when(value <= 8, "6.5-8").otherwise("8.5-10")


def rate_bucket(rate: Column) -> Column:
    """0, up to a quarter, up to a half, above."""
    return F.when(rate <= 0, "0").when(rate <= 0.25, "(0,.25]").when(rate <= 0.5, "(.25,.5]").otherwise(">.5")


def source_id(metadata_id: Column, key: Column) -> Column:
    """The recorded source id if it is not blank, else the id without its :graph ending."""
    return F.coalesce(F.nullif(F.trim(metadata_id), F.lit("")), F.regexp_replace(key, ":graph$", ""))
