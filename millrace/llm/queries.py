"""Queries of the training-text operators, each over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import answer_defects, cross_split, encoding_repair, leakage, near_duplicates, packing, proportional, stable_sample
from millrace.llm import sql as statements
from millrace.runtime import table


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    pairs = answer_defects.with_questions(table(spark, folder, "rollouts"), table(spark, folder, "problems"), table(spark, folder, "eval_items"))
    return answer_defects.answer_defects(pairs)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).where("main").select("rollout_id", "defect")


def p1_defects(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select("rollout_id", "defect", F.round("posterior", 6).alias("posterior"), "main")


def _proportional(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return proportional.proportional_sample(*(table(spark, folder, t) for t in ("problems", "omni_records", "lock_manifest", "category_targets")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _proportional(spark, folder)[1].where("shortfall > 0").select("manifest_id", "family", "band")


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _proportional(spark, folder)[0]


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return _proportional(spark, folder)[1]


def _split_records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "problems").select(F.col("record_no").alias("record"), "split", "source", "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split.cross_split_pairs(_split_records(spark, folder), 0.75)
    return pairs.select(F.least("train_record", "other_record").alias("record_a"), F.greatest("train_record", "other_record").alias("record_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.cross_split_classes(_split_records(spark, folder), 0.75)


def p3_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    report = cross_split.overlap_report(_split_records(spark, folder), 0.75)
    return report.withColumns({c: F.round(c, 6) for c in ("max_coverage", "mean_coverage")})


def p4_stable_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stable_sample.stable_sample(table(spark, folder, "problems"), table(spark, folder, "lock_manifest"))[0]


#: Rows that come in more than a day after the event are late.
PUNCTUAL = "ingested_at <= created_at + interval 1 day"


def _late_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of the punctual rows and, with their thresholds kept, of all rows, in which late rows enter batches already drawn."""
    rows, manifest = table(spark, folder, "problems"), table(spark, folder, "lock_manifest")
    before, kept = stable_sample.stable_sample(rows.where(PUNCTUAL), manifest)
    after, levels = stable_sample.stable_sample(rows, manifest, earlier=kept)
    return before, after, levels


def p4_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    before, after, _ = _late_runs(spark, folder)
    return stable_sample.kept_and_added(before, after)


def p4_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return _late_runs(spark, folder)[2].withColumn("threshold", F.round("threshold", 9))


def _both(spark: SparkSession, folder: str) -> DataFrame:
    problems = table(spark, folder, "problems").select(F.col("record_no").alias("record"), "text")
    return problems.unionByName(table(spark, folder, "omni_records").select(F.col("record_no").alias("record"), F.col("problem").alias("text")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_both(spark, folder), threshold=0.6, size=3)


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(_both(spark, folder), threshold=0.6, size=3).withColumn("similarity", F.round("similarity", 6))


def p5_weighted_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_both(spark, folder), threshold=0.6, size=3, weights="count")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_both(spark, folder), threshold=0.6, size=3)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_kinds(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("piece = 1").select("container_kind", "doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p6_fill_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder)).withColumn("unused_share", F.round("unused_share", 6))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), window=12)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder).where("run = 1").select("doc_id", "item_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder).withColumn("coverage", F.round("coverage", 6))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_passages(spark, folder)).withColumn("max_coverage", F.round("max_coverage", 6))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.garbled_texts(table(spark, folder, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    found = encoding_repair.garbled_texts(table(spark, folder, "documents"))
    return found.select("doc_id", "restored", "complete", "pieces", "steps")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_defects, p2_found, p2_sample, p2_report, p3_found, p3_classes, p3_overlap_report, p4_stable_sample, p4_late_rows, p4_thresholds, p5_found, p5_groups, p5_links, p5_weighted_groups,
            p6_found, p6_containers, p6_fill_report, p7_found, p7_passages, p7_items, p8_found, p8_restored,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(statements.SQL)
