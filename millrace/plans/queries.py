"""One query per operator over the whole tables. Names match millrace.plans.sql."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers, stats, text
from millrace.operators import canonical, compare, constraints, dedup, graph, metrics, records, retrieval, sampling, scoring, spans
from millrace.operators.ranking import uniform
from millrace.runtime import table

BASELINE = "stage2"
LABELS = ["stage2", "main_grpo", "feedback_grpo", "teacher_judge"]
SEED = 60906
STORES = {"solution": "theorem", "theorem_note": "theorem", "worksheet": "template", "diagnosis": "failure", "thread": "prior"}


# ---- shared inputs

SUMMARY = (*compare.METRICS, "status", "test_counts", "generation_seconds", "prompt_token_count", "completion_token_count")
SCORED = ("tags_exact", "signature_exact", "python_executable", "final_answer_correct", "backward_target_correct", "test_counts")


def results(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(adapter, id, result_no, columns): one result per adapter and id, the last one recorded. Only these columns are read."""
    rows = table(spark, folder, "eval_results").where("adapter is not null and id is not null").select("adapter", "id", "result_no", *columns)
    return dedup.last_wins(rows.withColumn("_k", F.concat_ws("|", "adapter", "id")), "_k", ["result_no"]).drop("_k")


def problems(spark: SparkSession, folder: str, *columns: str | Column) -> DataFrame:
    """(id, record_no, columns): first delivery of every problem id."""
    rows = table(spark, folder, "problems").where("id is not null").select("id", "record_no", *columns)
    return dedup.first_wins(rows, F.col("id"), ["record_no"])


def rollouts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(rollout_id, ingested_at, columns): last delivery of every rollout."""
    rows = table(spark, folder, "rollouts").select("rollout_id", "ingested_at", *columns)
    return dedup.last_wins(rows, "rollout_id", ["ingested_at"])


def origins(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, difficulty) of problems and held-out items."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "source", "difficulty")
    return dedup.first_wins(
        problems(spark, folder, "source", "difficulty").select(
            "id",
            "source",
            "difficulty",
            F.lit(0).alias("_o"),
        ).unionByName(items.withColumn("_o", F.lit(1))), F.col("id"), ["_o"]
    ).drop("_o")


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


# ---- evaluation statistics

def paired_report(spark, folder):
    out = compare.paired_report(results(spark, folder, *compare.METRICS), "adapter", "id", LABELS, BASELINE)
    return out.withColumns(_r("was_rate", "now_rate", "difference", "p_value", "now_low", "now_high", "p_adjusted"))


def eval_summary(spark, folder):
    return compare.summarise(results(spark, folder, *SUMMARY), ["adapter"])


def metric_deltas(spark, folder):
    return compare.deltas(
        compare.summarise(results(spark, folder, *SUMMARY), ["adapter"]),
        "adapter",
        BASELINE,
    ).withColumns(_r("baseline", "candidate", "delta"))


def pair_transitions(spark, folder):
    return compare.transitions(compare.paired(results(spark, folder, *compare.METRICS), "adapter", "id", BASELINE, "main_grpo"), ["metric"])


def strata_rates(spark, folder):
    rows = results(spark, folder, "final_answer_correct").join(origins(spark, folder), "id", "left").withColumn("family", canonical.family(F.col("id")))
    return compare.strata(rows, ["family", "source", "difficulty"], F.col("final_answer_correct"), ["adapter"]).withColumns(_r("rate", "low", "high"))


def wilson_rates(spark, folder):
    rows = results(spark, folder, "full_success").groupBy("adapter").agg(F.count("*").alias("n"), F.count_if("full_success").alias("successes"))
    low, high = stats.wilson(F.col("successes"), F.col("n"))
    return rows.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


def mcnemar_by_source(spark, folder):
    pairs = compare.paired(
        results(spark, folder, "final_answer_correct", "python_executable"),
        "adapter",
        "id",
        BASELINE,
        "teacher_judge",
        ("final_answer_correct", "python_executable"),
    )
    sources = origins(spark, folder).select("id", F.coalesce("source", F.lit("unknown")).alias("source"))
    counts = compare.transitions(pairs.join(sources, "id"), ["source", "metric"])
    return compare.with_tests(counts).select("source", "metric", "improved", "regressed", F.round("p_value", 6).alias("p_value"))


def holm_by_source(spark, folder):
    tested = mcnemar_by_source(spark, folder)
    return stats.holm(tested, "p_value", "source", "p_adjusted", ["metric"]).withColumns(_r("p_adjusted"))


def pass_at_k(spark, folder):
    flags = {
        "final": F.col("final_answer_correct"),
        "success": F.col("full_success"),
        "executable": F.col("python_executable"),
        "tests": F.col("all_hidden_tests_pass"),
    }
    out = compare.pass_at_k(table(spark, folder, "eval_results").where("id is not null"), "id", flags, ["adapter"])
    return out.withColumns(_r(*(f"{n}_{k}" for n in flags for k in ("rate", "pass_at_k"))))


def test_count_totals(spark, folder):
    rows = results(spark, folder, "test_counts")
    total = lambda f: F.coalesce(F.sum(f"test_counts.{f}"), F.lit(0)).alias(f)
    return rows.groupBy("adapter").agg(*(total(f) for f in ("unit_passed", "unit_total", "property_passed", "property_total")))


def frequency_counts(spark, folder):
    return compare.frequencies(table(spark, folder, "documents"), ["lang", "source", "kind"])


def merged_summaries(spark, folder):
    parts = (
        results(spark, folder, "finished_at", "generation_seconds", "full_success", "python_executable")
        .groupBy("adapter", F.date_trunc("month", "finished_at").alias("month"))
        .agg(
            F.count("*").alias("num_problems"),
            F.sum("generation_seconds").alias("wall_time_seconds"),
            stats.true_rate(F.col("full_success")).alias("success"),
            stats.true_rate(F.col("python_executable")).alias("executable"),
        )
    )
    return compare.merged_summaries(parts, ["success", "executable"], ["adapter"]).withColumns(_r("wall_time_seconds", "success", "executable"))


def group_ranges(spark, folder):
    rows = rollouts(spark, folder, "problem_id", "generation_seconds").where("generation_seconds is not null")
    return compare.group_stats(rows, "problem_id", "generation_seconds", "seconds").withColumns(
        _r("min_seconds", "max_seconds") | {"mean_seconds": F.round("mean_seconds", 9)}
    )


# ---- deduplication, leakage, constraints

def dedup_first(spark, folder):
    rows = table(spark, folder, "problems").where("text is not null").withColumn("text_key", text.ascii_hash(F.col("text")))
    return dedup.first_wins(rows, F.col("text_key"), ["record_no"]).select("record_no", "id", "text_key")


def dedup_first_unicode(spark, folder):
    rows = table(spark, folder, "problems").where("text is not null").withColumn("text_key", text.text_hash(F.col("text")))
    return dedup.first_wins(rows, F.col("text_key"), ["record_no"]).select("record_no", "text_key")


def dedup_conflicts(spark, folder):
    rows = table(spark, folder, "problems").withColumns(
        {"_t": text.ascii_hash(F.coalesce("text", F.lit(""))), "_a": F.trim(F.coalesce("gold_answer", F.lit("")))}
    )
    return dedup.conflicting_keys(rows, "id", ["_t", "_a"])


def unique_pool(spark, folder):
    rows = table(spark, folder, "problems").withColumns(
        {"_t": text.ascii_hash(F.coalesce("text", F.lit(""))), "_a": F.trim(F.coalesce("gold_answer", F.lit("")))}
    )
    return dedup.unique_pool(rows, "id", ["_t", "_a"], ["record_no"]).select("record_no", "id")


def last_delivery(spark, folder):
    rows = table(spark, folder, "problems").where("id is not null").select("record_no", "id", "batch_no", "source")
    return dedup.last_wins(rows, "id", ["record_no"], position="first_record_no")


def leak_exclude(spark, folder):
    rows = table(spark, folder, "problems").withColumn("s", F.coalesce(F.lower(F.trim("split")), F.lit("train")))
    held = rows.where("s <> 'train' and text is not null").select("record_no", "id", "text")
    known = rows.where("s = 'train'").select("id", "text")
    return dedup.exclude_known(held, known, "id", "text", text.ascii_hash).select("record_no", "id")


def resume_missing(spark, folder):
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "source")
    done = table(spark, folder, "eval_results").where("status = 'ok' and adapter = 'main_grpo'")
    return dedup.exclude_ids(items, done, "id")


def repeated_keys(spark, folder):
    return constraints.duplicate_keys(table(spark, folder, "problems"), "id")


def split_overlap(spark, folder):
    rows = table(spark, folder, "problems").withColumn("s", F.coalesce(F.lower(F.trim("split")), F.lit("train")))
    return constraints.overlap_report(rows.where("s = 'train'"), rows.where("s <> 'train'"), "id").withColumn("examples", F.array_join("examples", ","))


def invalid_results(spark, folder):
    rows = table(spark, folder, "eval_results")
    broken = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("prompt_token_count") >= 0, F.lit(False)), "prompt_token_count"), F.when(
            ~F.coalesce(F.col("completion_token_count") >= 0, F.lit(False)),
            "completion_token_count",
        ),
        F.when(F.col("status").isNull(), "status"), F.when(F.col("test_counts.unit_passed") > F.col("test_counts.unit_total"), "unit_tests"),
    ))
    return rows.select("result_no", F.explode(broken).alias("rule")).groupBy("rule").agg(
        F.count("*").alias("rows"),
        F.count_distinct("result_no").alias("results"),
    )


def forbidden_keys(spark, folder):
    rows = table(spark, folder, "problems").where("metadata is not null")
    found = rows.select("record_no", spans.forbidden_keys(F.col("metadata"), F.array(F.lit("rev"), F.lit("gold_answer"))).alias("keys"))
    return found.where(F.size("keys") > 0).select("record_no", F.array_join("keys", ",").alias("keys"))


# ---- selection

def _pool(spark, folder):
    rows = problems(spark, folder, F.col("text").isNotNull().alias("has_text"), "source", "difficulty", "domain").where("has_text")
    return rows.select(
        "id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"),
        canonical.topic(F.col("domain")).alias("topic"),
        canonical.difficulty_bucket(F.col("difficulty")).alias("bucket"),
    )


def stratified_sample(spark, folder):
    return sampling.stratified_sample(_pool(spark, folder), ["topic", "bucket"], "id", 0.2, SEED).where("selected").select("id", "topic", "bucket")


def stratified_select(spark, folder):
    return sampling.stratified_select(_pool(spark, folder), ["source", "difficulty"], "id", 250, SEED).select("id", "source", "difficulty")


def stratified_split(spark, folder):
    return sampling.stratified_split(_pool(spark, folder), ["source", "difficulty"], "id", 0.1, SEED).select("id", "part")


def balanced_select(spark, folder):
    return sampling.balanced_select(_pool(spark, folder), "source", "id", 40, SEED).select("id", "source", "turn")


def assign_splits(spark, folder):
    return sampling.assign_splits(_pool(spark, folder), "source", "id", 0.1, 0.1, SEED).select("id", "source", "part")


def hash_split(spark, folder):
    return sampling.hash_split(_pool(spark, folder), "id", 0.05, SEED).select("id", "part")


def seeded_page(spark, folder):
    return sampling.seeded_order(_pool(spark, folder), "id", 42, 10, 50).select("id")


def replay_mix(spark, folder):
    rows = problems(spark, folder)
    kind = F.pmod(F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("bigint"), F.lit(10))
    return sampling.replay_mix(rows.where(kind < 2), rows.where((kind >= 2) & (kind < 6)), rows.where(kind >= 6), 2, SEED)


def shards(spark, folder):
    return sampling.shards(table(spark, folder, "rollouts").select("rollout_id").distinct(), "rollout_id", 6)


def hard_set(spark, folder):
    rows = table(spark, folder, "eval_results").where("id is not null")
    unit = stats.ratio(F.col("test_counts.unit_passed"), F.col("test_counts.unit_total"))
    prop = stats.ratio(F.col("test_counts.property_passed"), F.col("test_counts.property_total"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    measured = metrics.hardness(
        rows,
        "id",
        flag("final_answer_correct"),
        [flag("python_executable"), unit, prop, flag("backward_target_correct")],
        flag("full_success") + unit,
    )
    held = problems(spark, folder).select("id").join(measured, "id", "left")
    held = held.withColumn("reason", metrics.reject_reason(F.col("rollouts"), F.col("final_rate"), F.col("learnability"), 0.75, 0.1))
    kept = held.where("reason is null").withColumn("score", metrics.hard_score(F.col("final_rate"), F.col("learnability"), F.col("reward_std")))
    chosen = sampling.quota_backfill(kept, F.col("id").startswith("omni_math_"), 20, 60, [F.desc("score"), F.asc("final_rate"), F.asc("id")])
    return chosen.select("id", "rollouts", "final_rate", "learnability", "reward_std", "score")


def reject_reasons(spark, folder):
    rows = table(spark, folder, "eval_results").where("id is not null")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    measured = metrics.hardness(rows, "id", flag("final_answer_correct"), [flag("python_executable")], flag("full_success"))
    held = problems(spark, folder).select("id").join(measured, "id", "left")
    reason = metrics.reject_reason(F.col("rollouts"), F.col("final_rate"), F.col("learnability"), 0.5, 0.5)
    return held.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# ---- canonical records

def canonical_omni(spark, folder):
    rows = canonical.omni(table(spark, folder, "omni_records"))
    return dedup.first_wins(rows.withColumn("_n", F.coalesce("difficulty", F.lit(""))), F.col("id"), ["_n", "source"]).select(
        "id",
        "gold_answer",
        "problem_sha256",
        F.length("reference_solution").alias("solution_length"),
    )


def normalised_problems(spark, folder):
    rows = table(spark, folder, "problems").select("record_no", "id", "text", F.col("gold_answer").alias("answer"), "split")
    out = canonical.normalise_problem(rows, F.col("record_no"))
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.count("gold_answer").alias("answered"), F.count_distinct("id").alias("ids"))


def problem_labels(spark, folder):
    rows = problems(spark, folder, "domain", "difficulty")
    return rows.select(
        "id",
        canonical.family(F.col("id")).alias("family"),
        canonical.family_by_omni(F.col("id")).alias("other_family"),
        canonical.domain_key(F.col("domain")).alias("domain_key"),
        canonical.topic(F.col("domain")).alias("topic"),
        canonical.difficulty_bucket(F.col("difficulty")).alias("bucket"),
    )


def rate_buckets(spark, folder):
    per = results(spark, folder, "final_answer_correct").groupBy("id").agg(stats.true_rate(F.col("final_answer_correct")).alias("rate"))
    return per.groupBy(canonical.rate_bucket(F.col("rate")).alias("bucket")).agg(F.count("*").alias("problems"))


def safe_labels(spark, folder):
    return table(spark, folder, "problems").select(text.safe_label(F.col("source")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def chat_records(spark, folder):
    rows = problems(spark, folder, "text", "gold_answer").where("text is not null and gold_answer is not null")
    tasks = {
        "graph": [records.message("system", F.lit("Decompose.")), records.message("user", F.col("text")), records.message("assistant", F.col("gold_answer"))],
        "solve": [records.message("user", F.col("text")), records.message("assistant", F.col("gold_answer"))],
    }
    out = records.chat_records(rows, "id", tasks)
    return out.select(
        "id",
        "task",
        F.size("messages").alias("turns"),
        F.sha2(records.rendered(F.col("messages")), 256).alias("rendered_sha256"),
        records.ends_with_answer(F.col("messages")).alias("complete"),
    )


def _with_prompt(spark, folder):
    """Responses as completions of a prompt of the recorded length, whose ids are the places 1 to n; a missing length is no prompt."""
    rows = rollouts(spark, folder, "completion_token_ids", "prompt_token_count").where("completion_token_ids is not null")
    prompt = F.when(F.col("prompt_token_count") > 0, F.sequence(F.lit(1), F.col("prompt_token_count"))).otherwise(F.array().cast("array<int>"))
    return rows.select("rollout_id", prompt.alias("prompt"), F.col("completion_token_ids").alias("completion"))


def encoded_features(spark, folder):
    out = records.encoded(_with_prompt(spark, folder), "prompt", "completion", 256)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(
        "rollout_id", F.size("input_ids").alias("length"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"), total("labels").alias("label_sum"), total("input_ids").alias("id_sum")
    )


def padded_batches(spark, folder):
    wide = records.padded(
        records.encoded(_with_prompt(spark, folder), "prompt", "completion", 4096).withColumn("batch", F.floor(F.col("rollout_id") / 16)),
        "batch",
        0,
    )
    return wide.groupBy("batch").agg(
        F.max(F.size("input_ids")).alias("width"),
        F.min(F.size("labels")).alias("least"),
        F.sum(F.size(F.filter("attention_mask", lambda x: x == 0))).alias("padding"),
    )


def ids_digest(spark, folder):
    rows = table(spark, folder, "eval_items")
    a = records.ids_digest(rows, "item_id", False).withColumn("kind", F.lit("sorted"))
    return a.unionByName(records.ids_digest(rows, "item_id", True).withColumn("kind", F.lit("locked")))


def selection_manifest(spark, folder):
    rows = _pool(spark, folder).withColumn("family", canonical.family(F.col("id")))
    return rows.groupBy("family").agg(
        F.count("*").alias("rows"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("difficulty").alias("difficulties"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


# ---- retrieval

def _items(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select(
        F.col("doc_id").alias("item_id"),
        "text",
        F.col("doc_id").alias("ordinal"),
        F.coalesce(F.col("kind"), F.lit("prior")).alias("kind"),
    )


def jaccard_top_k(spark, folder):
    queries = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), retrieval.item_tokens(F.col("text")).alias("tokens"))
    items = _items(spark, folder).select("item_id", "ordinal", retrieval.item_tokens(F.col("text")).alias("tokens"))
    return retrieval.jaccard_top_k(queries, items, 3).withColumns(_r("score"))


def idf_top_k(spark, folder):
    queries = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.idf_top_k(queries, _items(spark, folder), 3).withColumns(_r("score"))


def cosine_top_k(spark, folder):
    rows = table(spark, folder, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.cosine_top_k(queries, rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5).withColumns(_r("score"))


def _store() -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in STORES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("prior")).alias("memory_type")


def memory_top_k(spark, folder):
    """Without an embedding model, as no table holds vectors of these texts: cosine adds nothing."""
    none = F.lit(None).cast("array<double>").alias("vector")
    queries = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), retrieval.item_tokens(F.col("text")).alias("tokens"), none)
    items = _items(spark, folder).select("item_id", "ordinal", _store(), retrieval.item_tokens(F.col("text")).alias("tokens"), none)
    return retrieval.memory_top_k(queries, items, 3).withColumns(_r("score"))


def memory_sizes(spark, folder):
    items = _items(spark, folder).select(_store())
    return retrieval.memory_sizes(items, ["theorem", "template", "prior", "failure", "spare"])


def memory_update(spark, folder):
    rows = table(spark, folder, "problems").where("id is not null").select("id", "record_no", F.coalesce("batch_no", F.lit(12)).alias("batch_no"), "source")
    first = dedup.first_wins(rows.where("batch_no <= 6"), F.col("id"), ["record_no"])
    newer = dedup.last_wins(rows.where("batch_no > 6"), "id", ["record_no"])
    return retrieval.update_memory(first, newer).select("id", "record_no", "batch_no")


# ---- responses: spans, graphs, answers

def _tagged(spark, folder):
    rows = rollouts(spark, folder, "problem_id", "raw_text").where("raw_text is not null").select("rollout_id", "problem_id", "raw_text")
    return rows.withColumn("nodes", F.array_distinct(F.concat(F.regexp_extract_all("raw_text", F.lit(r"<a_(f[0-9]+)>"), F.lit(1)), F.array(F.lit("main")))))


def first_tags(spark, folder):
    return _tagged(spark, folder).select(
        "rollout_id",
        F.length(spans.first_tag(F.col("raw_text"), F.lit("a_f1"))).alias("first_length"),
        F.length(spans.first_tag(F.col("raw_text"), F.lit("main"))).alias("main_length"),
    )


def exact_tags(spark, folder):
    rows = _tagged(spark, folder).withColumn("raw_text", F.regexp_replace("raw_text", r"(</?)main>", "$1a_main>"))
    return rows.select(
        "rollout_id",
        spans.exact_tags(F.col("raw_text"), F.col("nodes")).alias("exact"),
        spans.tag_set_once(F.col("raw_text"), F.col("nodes")).alias("once"),
    )


def code_checks(spark, folder):
    """Every block: its safety and, within a node, whether it is the node's one block and defines the node's function once. No table
    holds wanted parameters, so they are those of the block's first function; a block outside all nodes has no wanted signature."""
    rows = _tagged(spark, folder).where(F.col("raw_text").contains("```python\n"))
    code = rows.select("rollout_id", F.explode(spans.code_blocks("raw_text", "nodes")).alias("c")).select("rollout_id", "c.*")
    wanted = F.concat("node_id", F.regexp_extract("code", r"def \w+(\([^)]*\))", 1))
    signature = F.when(F.col("node_id").isNotNull(), spans.python_signature_ok(wanted, F.col("node_blocks")))
    return code.select(
        "rollout_id",
        "block",
        "node_id",
        F.coalesce(spans.unsafe_code(F.col("code")), F.lit("ok")).alias("safety"),
        signature.alias("signature_ok"),
    )


def boxed_answers(spark, folder):
    rows = rollouts(spark, folder, "raw_text").where("raw_text like '%boxed{%'")
    return rows.select("rollout_id", canonical.last_boxed("raw_text").alias("boxed"))


def answer_matches(spark, folder):
    gold = problems(spark, folder, "gold_answer").select("id", "gold_answer").union(table(spark, folder, "eval_items").select("item_id", "gold_answer"))
    boxed = canonical.last_boxed(F.when(F.contains("raw_text", F.lit("boxed{")), F.col("raw_text")))  # texts without a box never reach Python
    said = rollouts(spark, folder, "problem_id", "raw_text").select(
        "rollout_id",
        F.col("problem_id").alias("id"),
        F.coalesce(boxed, F.nullif(F.regexp_extract("raw_text", r"(?i)final answer is (-?[\d,./]+\d)", 1), F.lit(""))).alias("said"),
    )
    both = said.join(gold.groupBy("id").agg(F.min("gold_answer").alias("gold")), "id", "left")
    checked = both.withColumn("e", answers.answer_equivalence(F.col("said"), F.col("gold")))
    return checked.groupBy("e.method", "e.equivalent").agg(F.count("*").alias("n"))


def consensus(spark, folder):
    said = rollouts(spark, folder, "problem_id", "raw_text").where("raw_text is not null").select(
        "problem_id",
        "rollout_id",
        F.lit("main").alias("node_id"),
        F.nullif(text.math_text(F.regexp_extract("raw_text", r"boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1)), F.lit("")).alias("value"),
    )
    return scoring.consensus(said).groupBy("problem_id").agg(F.count("*").alias("rollouts"), F.round(F.avg("consensus"), 6).alias("mean_consensus"))


# ---- rewards and advantages

def _components(rows: DataFrame) -> dict:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    return {
        "format": flag("tags_exact"), "signature": flag("signature_exact"), "execution": flag("python_executable"), "final": flag("final_answer_correct"), "backward": flag("backward_target_correct"),
        "unit_test": stats.ratio(F.col("test_counts.unit_passed"), F.col("test_counts.unit_total")), "property_test": stats.ratio(
            F.col("test_counts.property_passed"),
            F.col("test_counts.property_total"),
        ),
    }


def rewards(spark, folder):
    rows = results(spark, folder, *SCORED)
    out = rows.select("adapter", "id", *(c.alias(n) for n, c in scoring.reward_parts(_components(rows)).items()))
    return out.groupBy("adapter").agg(
        F.count("*").alias("n"),
        F.round(F.avg("total_reward"), 6).alias("mean_reward"),
        F.round(F.max("total_reward"), 6).alias("max_reward"),
        F.round(F.avg("answer_gate"), 6).alias("mean_gate"),
    )


def span_rewards(spark, folder):
    rows = results(spark, folder, *SCORED)
    c = _components(rows)
    outcomes = rows.select(
        F.col("result_no").alias("rollout_id"),
        c["format"].alias("format"),
        c["final"].alias("final"),
        c["backward"].alias("backward"),
        F.lit(0.0).alias("consensus"),
        F.lit(0.0).alias("teacher"),
    )
    scores = {n: c[n].alias(n) for n in ("signature", "execution", "unit_test", "property_test")}
    nodes = rows.select(
        F.col("result_no").alias("rollout_id"),
        F.explode(F.array(F.lit("f1"), F.lit("main"))).alias("node_id"),
        F.lit(0.0).alias("node"),
        *scores.values(),
        F.lit(0.0).alias("teacher"),
    )
    edges = rows.select(F.col("result_no").alias("rollout_id"), F.lit("f1").alias("source"), F.lit("main").alias("target"), c["execution"].alias("score"))
    return scoring.span_rewards(nodes, edges, outcomes).groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.sum("reward"), 4).alias("total"))


def group_advantages(spark, folder):
    rows = results(spark, folder, *SCORED)
    scored = rows.select("id", "result_no", scoring.reward_parts(_components(rows))["total_reward"].alias("reward"))
    return scoring.group_advantages(scored, ["id"], "reward").select("id", "result_no", F.round("advantage", 6).alias("advantage"))


def span_advantages(spark, folder):
    rows = results(spark, folder, "tags_exact", "signature_exact", "python_executable")
    metrics_ = ["tags_exact", "signature_exact", "python_executable"]
    rewards_ = rows.select(
        F.col("result_no").alias("rollout_id"),
        F.inline(F.array(*(F.struct(F.lit(m).alias("node_id"), F.when(F.col(m), 1.0).alias("reward")) for m in metrics_))),
    ).where("reward is not null")
    out = scoring.span_advantages(rows.select(F.col("id").alias("problem_id"), F.col("result_no").alias("rollout_id")), rewards_)
    return out.select("problem_id", "rollout_id", "node_id", F.round("advantage", 6).alias("advantage"))


def token_advantages(spark, folder):
    rows = rollouts(spark, folder, "completion_token_ids").where("completion_token_ids is not null")
    n = F.size("completion_token_ids")
    ranges = F.array(
        F.struct(F.lit("f1").alias("node"), F.lit(0).alias("start"), F.floor(n / 2).cast("int").alias("end")),
        F.struct(F.lit("main").alias("node"), F.floor(n / 3).cast("int").alias("start"), n.alias("end")),
    )
    given = F.create_map(F.lit("f1"), F.lit(1.0), F.lit("main"), F.lit(-0.5))
    return rows.select("rollout_id", F.round(F.aggregate(scoring.token_advantages(n, ranges, given), F.lit(0.0), lambda a, x: a + x), 6).alias("advantage_sum"))


def efficiency(spark, folder):
    rows = rollouts(spark, folder, "backend", "raw_text", "generation_seconds", "completion_token_count")
    calls = F.size(F.regexp_extract_all("raw_text", F.lit(r"(```python)"), F.lit(1)))
    scored = rows.select("backend", scoring.efficiency_penalty(
        F.col("generation_seconds"), F.greatest(calls, F.lit(0)), F.greatest(F.col("completion_token_count"), F.lit(0)), F.array("raw_text")
    ).alias("penalty"))
    return scored.groupBy("backend").agg(F.count("*").alias("n"), F.round(F.avg("penalty"), 6).alias("mean_penalty"))


def _as_tests(passed, total, kind):
    places = F.when(F.col(total) > 0, F.sequence(F.lit(1), F.col(total))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.lit(kind).alias("kind"), (i <= F.coalesce(F.col(passed), F.lit(0))).alias("passed")))


def _tests(rows: DataFrame) -> DataFrame:
    """Results with an array of test results made of the counts."""
    unit = _as_tests("test_counts.unit_passed", "test_counts.unit_total", "unit")
    return rows.withColumn("tests", F.concat(unit, _as_tests("test_counts.property_passed", "test_counts.property_total", "property")))


def node_scores(spark, folder):
    rows = _tests(results(spark, folder, "python_executable", "test_counts"))
    score = scoring.node_score(F.lit("x"), F.lit(True), F.col("python_executable"), F.col("tests"), F.lit(None).cast("double"))
    scored = rows.select("adapter", score.alias("s")).select("adapter", "s.*")
    return scored.groupBy("adapter").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("execution", "unit", "property", "combined")))


def failure_classes(spark, folder):
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = {"python_executable": "execution_failure", "backward_target_correct": "dependency_failure", "final_answer_correct": "final_answer_failure"}
    failures = F.array_compact(F.array(*(F.when(~flag(c), F.struct(F.lit(k).alias("type"))) for c, k in kinds.items())))
    return results(
        spark,
        folder,
        "python_executable",
        "backward_target_correct",
        "final_answer_correct",
    ).groupBy("adapter", scoring.failure_class(failures).alias("failure")).agg(F.count("*").alias("n"))


def metadata_fields(spark, folder):
    rows = table(spark, folder, "problems").select(text.json_object(F.col("metadata")).alias("v"))
    found = rows.select(F.try_variant_get("v", "$.subject", "string").alias("subject"), F.try_variant_get("v", "$.rev", "int").alias("rev"))
    return found.groupBy("subject", "rev").agg(F.count("*").alias("n"))


def token_counts(spark, folder):
    rows = table(spark, folder, "problems").where("text is not null")
    return rows.select(
        "record_no",
        F.size(text.identifier_tokens(F.col("text"))).alias("identifiers"),
        F.size(text.lexical_tokens(F.col("text"))).alias("lexical"),
    )


def known_ids(spark, folder):
    rows = table(spark, folder, "problems").select(F.explode(dedup.candidate_ids([F.col("id"), F.col("source")])).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def answer_kinds(spark, folder):
    rows = problems(spark, folder, "gold_answer").where("gold_answer is not null")
    return rows.groupBy(
        canonical.numeric_answer(F.col("gold_answer")).alias("numeric"),
        canonical.family(F.col("id")).alias("family"),
    ).agg(F.count("*").alias("n"))


def seeded_uniform(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", F.round(uniform(F.col("item_id"), SEED), 9).alias("u"))


ALL = (
    paired_report, eval_summary, metric_deltas, pair_transitions, strata_rates, wilson_rates, mcnemar_by_source, holm_by_source, pass_at_k, test_count_totals,
    frequency_counts, merged_summaries, group_ranges, dedup_first, dedup_first_unicode, dedup_conflicts, unique_pool, last_delivery, leak_exclude, resume_missing, repeated_keys,
    split_overlap, invalid_results, forbidden_keys, stratified_sample, stratified_select, stratified_split, balanced_select, assign_splits, hash_split, seeded_page,
    replay_mix, shards, hard_set, reject_reasons, canonical_omni, normalised_problems, problem_labels, rate_buckets, safe_labels, chat_records, encoded_features, padded_batches,
    ids_digest, selection_manifest, jaccard_top_k, idf_top_k, cosine_top_k, memory_top_k, memory_sizes, memory_update, first_tags, exact_tags, code_checks, boxed_answers,
    answer_matches, consensus, rewards, span_rewards, group_advantages, span_advantages, token_advantages, efficiency, seeded_uniform,
    node_scores, failure_classes, metadata_fields, token_counts, known_ids, answer_kinds,
)
