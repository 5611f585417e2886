"""Queries of sources and sinks, written to the shared folder and read again, and of constraints, source formats and audits; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import audits, canonical, constraints, records
from millrace.plans import built
from millrace.plans import sql as base
from millrace.plans.queries import problems, results, rollouts
from millrace.runtime import shared_path, table
from millrace.sources import readers, sinks

PROBLEM = "record_no bigint, id string, text string, split string, difficulty string, batch_no int"


# ---- sources and sinks

def _problem_lines(spark, folder) -> str:
    path = shared_path(spark, "problems")
    sinks.write_json_lines(table(spark, folder, "problems").select("record_no", "id", "text", "split", "difficulty", "batch_no"), path)
    return path


def json_lines(spark, folder):
    """All problems as JSON lines and strictly read back: rows, lengths and nulls a batch."""
    rows = readers.json_lines(spark, _problem_lines(spark, folder), PROBLEM)
    return rows.groupBy("batch_no").agg(
        F.count("*").alias("rows"),
        F.sum(F.length("text")).alias("characters"),
        F.count_if(F.col("split").isNull()).alias("without_split"),
        F.count_distinct("difficulty").alias("difficulties"),
    )


def several_files(spark, folder):
    """The same lines from two folders, and a folder that is not there."""
    path = _problem_lines(spark, folder)
    both = readers.json_lines(spark, [path, path], PROBLEM).unionByName(readers.optional_json_lines(spark, shared_path(spark, "none"), PROBLEM))
    return both.groupBy("record_no").agg(F.count("*").alias("times"))


def json_document(spark, folder):
    """The held-out items as one document with a list under data, and read back."""
    items = table(spark, folder, "eval_items")
    path = shared_path(spark, "items")
    items.agg(F.to_json(F.struct(F.collect_list(F.struct("item_id", "text", "source")).alias("data"))).alias("value")).write.text(path)
    return readers.json_document(spark, path, "item_id string, text string, source string").select("item_id", "source", F.length("text").alias("characters"))


def labelled_results(spark, folder):
    rows = table(spark, folder, "eval_results").select("result_no", "id", "adapter", "full_success")
    paths = {name: shared_path(spark, name) for name in ("stage2", "main_grpo")}
    for name, path in paths.items():
        sinks.write_json_lines(rows.where(F.col("adapter") == name), path, "errorifexists")
    found = readers.labelled(spark, [f"{n}={p}" for n, p in paths.items()], "result_no bigint, id string, full_success boolean")
    return found.groupBy("label").agg(F.count("*").alias("rows"), F.count_if("full_success").alias("successes"), F.min("result_no").alias("first"))


def resumed_results(spark, folder):
    """What may be kept of main_grpo's earlier run, errors left out."""
    known = table(spark, folder, "problems").select("id").union(table(spark, folder, "eval_items").select(F.col("item_id").alias("id"))).distinct()
    own = results(spark, folder, "status").where("adapter = 'main_grpo'")
    return readers.resumable(own, known, "id", "main_grpo", drop_errors=True).groupBy("status").agg(F.count("*").alias("rows"))


def dataset_page(spark, folder):
    """Rows of the train split in seeded order, from the eleventh on, twenty of them."""
    rows = problems(spark, folder, "split").select("id", F.coalesce(F.lower(F.trim("split")), F.lit("train")).alias("split"))
    return readers.dataset(rows, "train", 42, 10, 20, F.col("id")).select("id", "split")


def rank_results(spark, folder):
    """Results split over three ranks, written by each and merged."""
    rows = table(spark, folder, "eval_results").select("result_no", "id", F.pmod("result_no", F.lit(3)).alias("r"))
    folder_ = shared_path(spark, "ranks")
    for rank in range(3):
        sinks.write_json_lines(rows.where(F.col("r") == rank).drop("r"), f"{folder_}/out.rank{rank}.jsonl")
    return readers.rank_files(spark, folder_, "result_no bigint, id string").groupBy("rank").agg(F.count("*").alias("rows"), F.sum("result_no").alias("total"))


def landed_split(spark, folder):
    """A pinned dataset, landed as parquet, of which one split is read."""
    at = shared_path(spark, "hub") + "/0a1b2c"
    table(spark, folder, "omni_records").select("record_no", "source").write.parquet(f"{at}/train")
    return readers.landed(spark, f"{at}/train", "0a1b2c").groupBy("source").agg(F.count("*").alias("rows"), F.min("record_no").alias("first"))


def theorem_scan(spark, folder):
    """The first ten traced theorems of a prefix, by name."""
    path = shared_path(spark, "traces")
    table(spark, folder, "documents").select(
        F.concat(F.lit("Notes.t"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("full_name"),
        F.length("text").alias("n"),
    ).write.parquet(path)
    return readers.theorem_traces(spark, path, "Notes.t0", 10)


def knowledge_items(spark, folder):
    """Documents as knowledge items: every third has an id of its own, the others one made of type, file and place."""
    rows = table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own"), F.col("doc_id").cast("string"))).alias("id"),
        F.lit(None).cast("string").alias("text"),
        F.col("kind").alias("content"),
        "doc_id",
    )
    return readers.knowledge(rows, "theorem", "notes", F.col("doc_id")).select("id", "memory_type", "text", F.size("keywords").alias("keywords"))


def memory_table(spark, folder):
    """Seeds of two stores with a persisted snapshot over them, written by store and read again."""
    rows = table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, "theorem").otherwise("failure_case").alias("memory_type"),
        F.pmod("doc_id", F.lit(100)).cast("string").alias("id"),
        "doc_id",
    )
    first = rows.groupBy("memory_type", "id").agg(F.min("doc_id").alias("doc_id"))
    last = rows.groupBy("memory_type", "id").agg(F.max("doc_id").alias("doc_id")).where("id % 3 = 0")
    path = shared_path(spark, "memory")
    sinks.write_memory(first, path)
    stored = spark.read.parquet(path).select("memory_type", F.col("id").cast("string").alias("id"), "doc_id")
    return sinks.load_memory([stored.where("memory_type = 'theorem'"), stored.where("memory_type <> 'theorem'")], last)


def memory_objects(spark, folder):
    """The snapshot as one object: an array a store, in order."""
    rows = table(spark, folder, "eval_items").select(
        F.when(F.col("source").isNull(), "prior_decomposition").otherwise("theorem").alias("memory_type"),
        F.col("item_id").alias("id"),
        F.col("item_id").alias("ordinal"),
    )
    one = sinks.memory_snapshot(rows)
    return one.select(*(F.size(c).alias(c) for c in one.columns), F.try_element_at("theorem_items", F.lit(1))["id"].alias("first_theorem"))


def upserted_table(spark, folder):
    """Deliveries of problems in three batches into one table that keeps the newest of every id."""
    rows = table(spark, folder, "problems").where("id is not null").select("id", "record_no", "source")
    path = shared_path(spark, "upserts")
    for part in range(3):
        sinks.upsert_batch(rows.where(F.pmod("record_no", F.lit(3)) == part), path, "id", ["record_no"])
    return spark.read.parquet(path)


def mistakes(spark, folder):
    """The notebook of failed repairs, written twice, a row each time."""
    runs = built._runs(spark, folder).withColumn("function_graph", F.lit("g"))
    widened = runs.withColumn(
        "rollout_records",
        F.transform(
            "rollout_records",
            lambda r: F.struct(
                r["rollout"].alias("rollout"),
                F.lit("e").alias("execution"),
                r["verification"].alias("verification"),
                r["repair"].alias("repair"),
            ),
        ),
    )
    path = shared_path(spark, "mistakes")
    for _ in range(2):
        sinks.append_mistakes(widened, path)
    return spark.read.schema("problem struct<id:string>, repair struct<status:string>").json(path).groupBy(
        F.col("problem.id").alias("id"),
        F.col("repair.status").alias("status"),
    ).agg(F.count("*").alias("rows"))


# ---- formats of sources

def grade_school(spark, folder):
    """Problems as worked answers: marks by number, the final number with separators, text as the question."""
    marks = F.array_join(F.transform(F.sequence(F.lit(0), F.pmod("record_no", F.lit(10)).cast("int")), lambda i: F.lit("<<1+1=2>>")), " ")
    rows = table(spark, folder, "problems").select(
        F.col("text").alias("question"),
        F.concat(
            marks,
            F.lit(" #### "),
            F.when(F.pmod("record_no", F.lit(4)) == 0, F.lit("none")).otherwise(F.concat(F.lit("1,"), F.col("record_no").cast("string"))),
        ).alias("answer"),
    )
    return canonical.grade_school(rows).groupBy("difficulty").agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.min("gold_answer").alias("least"),
        F.max("gold_answer").alias("most"),
    )


def competition(spark, folder):
    """Problems by level with a boxed answer that nests braces; every fifth has none."""
    k = F.col("record_no")
    solution = F.when(k % 5 == 0, F.lit("no box")).otherwise(F.concat(F.lit("so \\boxed{1} or \\boxed{\\frac{"), k.cast("string"), F.lit("}{2}} ends")))
    rows = table(spark, folder, "problems").select(
        F.col("text").alias("problem"),
        solution.alias("solution"),
        F.concat(F.lit("Level "), (k % 6).cast("string")).alias("level"),
        F.lit(None).cast("string").alias("type"),
    )
    made = canonical.competition(rows, "algebra")
    return made.groupBy("difficulty").agg(F.count("*").alias("rows"), F.min("gold_answer").alias("least"), F.max(F.array_join("domain", "/")).alias("domain"))


def multiple_choice(spark, folder):
    """Options by letter; operations, letters and rationales vary by number."""
    k = F.col("record_no")
    operations = F.array_join(F.transform(F.sequence(F.lit(0), (k % 7).cast("int")), lambda i: F.lit("add(n0,n1)")), "|")
    options = F.concat(F.lit("a ) 24 , b ) 1,000 , c ) none , d ) "), k.cast("string"), F.lit(" , e ) 5"))
    rows = table(spark, folder, "problems").select(
        F.col("text").alias("Problem"),
        F.when(k % 8 > 0, F.lit("because")).otherwise(F.lit(" ")).alias("Rationale"),
        options.alias("options"),
        F.substring(F.lit("aBcDe"), (k % 5 + 1).cast("int"), F.lit(1)).alias("correct"),
        operations.alias("linear_formula"),
        F.lit(" ").alias("category"),
    )
    made = canonical.multiple_choice(rows)
    return made.groupBy(
        "difficulty",
        F.when(F.length("gold_answer") > 5, "long").otherwise(F.col("gold_answer")).alias("answer"),
    ).agg(F.count("*").alias("rows"), F.max(F.array_join("domain", "/")).alias("domain"))


# ---- constraints, texts, audits

def constraint_outcomes(spark, folder):
    """Which eager constraints the tables break."""
    p, items, r = table(spark, folder, "problems"), table(spark, folder, "eval_items"), table(spark, folder, "eval_results")
    side = F.coalesce(F.lower(F.trim("split")), F.lit("train"))
    checks: dict[str, Callable[[], object]] = {
        "unique ids": lambda: constraints.require_unique(p, "id"), "unique records": lambda: constraints.require_unique(p, "record_no"),
        "disjoint splits": lambda: constraints.require_disjoint(
            p.where(side == "train"),
            p.where(side != "train"),
            "id",
        ), "disjoint items": lambda: constraints.require_disjoint(p, items.withColumnRenamed("item_id", "id"), "id"),
        "known results": lambda: constraints.require_subset(
            r.where("id is not null"),
            p.select("id").union(items.select("item_id")),
            "id",
        ), "same keys": lambda: constraints.require_same_keys(p, r, "id"),
        "counts": lambda: constraints.require_all(
            r,
            F.col("prompt_token_count") >= 0,
            "result_no",
            "tokens",
        ), "results have numbers": lambda: constraints.require_all(r, F.col("result_no") >= 0, "result_no", "numbers"),
        "enough items": lambda: constraints.require_count(items, 320), "too many items": lambda: constraints.require_count(items, 321),
    }

    def broken(check: Callable[[], object]) -> bool:
        try:
            check()
        except constraints.ConstraintError:
            return True
        return False

    return spark.createDataFrame([(name, broken(check)) for name, check in checks.items()], "name string, broken boolean")


def bounds(spark, folder):
    """Numbers within their bounds, missing and undefined ones without."""
    rows = table(spark, folder, "rollouts").select(
        F.when(F.col("rollout_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("generation_seconds") / 4).alias("v")
    )
    return rows.groupBy(constraints.in_unit_range(F.col("v")).alias("unit"), constraints.runtime_ok(F.col("v")).alias("runtime")).agg(F.count("*").alias("n"))


def test_bundles(spark, folder):
    """Whether the recorded tests would do as a bundle; an expected value is missing where the number divides by four."""
    rows = results(spark, folder, "test_counts")
    tests = lambda t, kind: F.transform(
        F.when(F.col(f"test_counts.{t}") > 0, F.sequence(F.lit(1), F.col(f"test_counts.{t}"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).cast("string").alias("kind"), F.when((F.col("result_no") % 4 != 0) | (i > 1), i.cast("string")).alias("expected")),
    )
    whole = F.concat(tests("unit_total", None), tests("property_total", "property"))
    return rows.groupBy(constraints.test_bundle_ok(whole).alias("ok")).agg(F.count("*").alias("n"))


def judgment_sets(spark, folder):
    """Indices of a problem's rollouts as judgments: complete where they are 0 to n-1 and the scored node is known."""
    rows = rollouts(spark, folder, "problem_id", "rollout_index").where("problem_id is not null and rollout_index is not null")
    small = rows.groupBy("problem_id").agg(
        F.count("*").alias("n"),
        F.max("rollout_index").alias("most"),
        F.count_distinct("rollout_index").alias("d"),
        F.min("rollout_index").alias("least"),
    )
    node = F.when(F.pmod(F.length("problem_id"), F.lit(2)) == 0, "f1").otherwise("f2")
    judged = small.where("n <= 64").join(rows, "problem_id").groupBy("problem_id").agg(
        F.collect_list(F.struct(F.col("rollout_index").alias("index"), F.create_map(node, F.lit(1.0)).alias("node_scores"))).alias("j"),
        F.first("n").cast("int").alias("n"),
    )
    return judged.select("problem_id", constraints.judgments_complete(F.col("j"), F.col("n"), F.array(F.lit("f1"))).alias("complete"))


def audit_texts(spark, folder):
    """Signatures, bare answers and bounded views of the texts of problems."""
    rows = problems(spark, folder, "text", "gold_answer", "source")
    return rows.select(
        "id", audits.signature_text(F.concat(F.lit(" `def "), F.col("id"), F.lit("(x):` "))).alias("signature"), audits.bare_answer(
            F.concat(F.lit("\\left( "), F.col("gold_answer"), F.lit(" $."))
        ).alias("answer"),
        F.length(records.bounded_text(F.col("text"), 100)).alias("bounded"), records.last_line(
            F.concat(F.coalesce("source", F.lit("")), F.lit("\n last \n\n"))
        ).alias("line"),
        text.message_text(
            F.array(
                F.struct(F.lit("text").alias("type"), F.col("id").alias("text")),
                F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
                F.struct(F.lit("text").alias("type"), F.col("source").alias("text")),
            )
        ).alias("message"),
        audits.problem_text(
            [F.when(F.pmod("record_no", F.lit(2)) == 0, F.col("source")), F.lit(" ")],
            F.array(F.lit("no json"), F.to_json(F.struct(F.col("id").alias("text")))),
        ).alias("told"),
    )


def reward_coverage(spark, folder):
    """Graphs of two nodes a result: a function with the recorded tests, and main with a target call at even numbers."""
    rows = results(spark, folder, "test_counts", "python_executable")
    tests = lambda t, kind: F.transform(
        F.when(F.col(f"test_counts.{t}") > 0, F.sequence(F.lit(1), F.col(f"test_counts.{t}"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).alias("kind")),
    )
    node = lambda kind, held, target, static: F.struct(
        F.lit("i").alias("id"),
        kind.alias("expected_output_type"),
        held.alias("tests"),
        target.alias("target_call"),
        static.alias("static"),
    )
    own = node(
        F.when(F.col("result_no") % 3 == 0, "values").otherwise("proof_claim"),
        F.concat(tests("unit_total", "unit"), tests("property_total", "property")),
        built.none(),
        F.col("python_executable"),
    )
    main = node(F.lit("final_answer"), F.array().cast("array<struct<kind:string>>"), F.when(F.col("result_no") % 2 == 0, "f(1)"), F.lit(False))
    graphs = rows.select(
        F.col("result_no").alias("graph_id"),
        F.array(own, main).alias("nodes"),
        F.array(F.struct(F.lit("uses_value").alias("relation_type"))).alias("edges"),
    )
    out = audits.reward_coverage(graphs)
    return out.select(
        "problems",
        "total_nodes",
        "total_edges",
        "machine_verifiable_nodes",
        "unverified_nodes",
        "graphs_with_unit_tests",
        "graphs_with_property_tests",
        "graphs_with_backward_call",
        "graphs_with_executable_nodes",
    )


def judge_run(spark, folder):
    """Recorded results as a judged run, a problem a trajectory; prompts with feedback and capped generations by number."""
    runs = built._runs(spark, folder)
    prompt = lambda r: F.when(F.size(r["rollout"]["completion_token_ids"]) % 5 == 0, "see repair_feedback").otherwise("plain")
    widened = runs.withColumn(
        "rollout_records",
        F.transform(
            "rollout_records",
            lambda r: F.struct(
                F.struct(prompt(r).alias("prompt_text"), F.size(r["rollout"]["completion_token_ids"]).alias("completion_token_count")).alias("rollout"),
                r["verification"].alias("verification"),
                r["reward"].alias("reward"),
            ),
        ),
    )
    out = audits.judge_run(widened, 256)
    return out.select(
        "problems",
        "rollouts",
        "judged_problems",
        "error_problems",
        "calls_over_budget",
        "prompts_with_feedback",
        "capped_generations",
        "mean_score",
        "final_accuracy",
        "mean_kl",
    )


SQL = {
    "json_lines": "select batch_no, count(*) as rows, sum(length(text))::bigint as characters, count(*) filter (split is null) as without_split, count(distinct difficulty) as difficulties from problems group by batch_no",
    "several_files": "select record_no, 2::bigint as times from problems",
    "json_document": "select item_id, source, length(text)::int as characters from eval_items",
    "labelled_results": "select adapter as label, count(*) as rows, count(*) filter (full_success) as successes, min(result_no) as first from eval_results where adapter in ('stage2', 'main_grpo') group by adapter",
    "resumed_results": f"with {base.RESULTS} select status, count(*) as rows from results where adapter = 'main_grpo' and status is distinct from 'error' group by status",
    "dataset_page": f"with {base.PROB}, s as (select id, coalesce(lower(trim(split)), 'train') as split from prob) select id, split from s where split = 'train' order by sha256('42:' || id), id limit 20 offset 10",
    "rank_results": "select (result_no % 3)::int as rank, count(*) as rows, sum(result_no)::bigint as total from eval_results group by 1",
    "landed_split": "select source, count(*) as rows, min(record_no) as first from omni_records group by source",
    "theorem_scan": "select 'Notes.t' || lpad(doc_id::varchar, 9, '0') as full_name, length(text)::int as n from documents where 'Notes.t' || lpad(doc_id::varchar, 9, '0') like 'Notes.t0%' order by 1 limit 10",
    "knowledge_items": "select if(doc_id % 3 = 0, 'own' || doc_id, 'theorem.notes.' || doc_id) as id, 'theorem' as memory_type, kind as text, 0::int as keywords from documents",
    "memory_table": """with r as (select if(doc_id % 2 = 0, 'theorem', 'failure_case') as memory_type, (doc_id % 100)::varchar as id, doc_id from documents)
select memory_type, id, if(id::int % 3 = 0, max(doc_id), min(doc_id)) as doc_id from r group by memory_type, id""",
    "memory_objects": """select count(*) filter (source is not null)::int as theorem_items, 0::int as algorithm_templates, count(*) filter (source is null)::int as prior_decompositions, 0::int as failure_cases,
  min(item_id) filter (source is not null) as first_theorem from eval_items""",
    "upserted_table": "select id, record_no, source from (select *, row_number() over (partition by id order by record_no desc) as n from problems where id is not null) where n = 1",
    "mistakes": f"with {base.RESULTS} select id, 'failed' as status, (2 * count(*))::bigint as rows from results where result_no % 4 = 3 group by id",
    "grade_school": f"""with q as (select trim(text) as t, least(greatest(record_no % 10 + 1, 2), 5) as d, record_no % 10 + 1 as n, record_no % 4 = 0 as none_, '1' || record_no as a from problems where text is not null)
select d::varchar as difficulty, count(*) as rows, count(distinct t) as ids, min(a) as least, max(a) as most from q where t <> '' and n between 3 and 8 and not none_ group by d""",
    "competition": """with q as (select trim(text) as t, record_no % 6 as l, '\\frac{' || record_no || '}{2}' as a from problems where record_no % 5 <> 0)
select l::varchar as difficulty, count(*) as rows, min(a) as least, 'algebra/algebra' as domain from q where t <> '' and l between 1 and 3 group by l""",
    "multiple_choice": """with q as (select trim(text) as t, record_no % 7 + 1 as n, record_no % 8 > 0 as told, case record_no % 5 when 0 then '24' when 1 then '1,000' when 2 then 'none' when 3 then record_no::varchar else '5' end as a from problems)
select least(greatest(n, 2), 5)::varchar as difficulty, if(length(a) > 5, 'long', a) as answer, count(*) as rows, 'Math Word Problems/general' as domain from q where t <> '' and n between 2 and 5 and told and a <> 'none' group by 1, 2""",
    "constraint_outcomes": """with s as (select id, coalesce(lower(trim(split)), 'train') = 'train' as train from problems where id is not null), k as (select id from problems where id is not null union select item_id from eval_items)
select 'unique ids' as name, (select count(*) from problems) > (select count(distinct id) from problems) as broken union all select 'unique records', (select count(*) from problems) > (select count(distinct record_no) from problems)
union all select 'disjoint splits', exists(select id from s where train intersect select id from s where not train) union all select 'disjoint items', exists(select id from problems intersect select item_id from eval_items)
union all select 'known results', exists(select 1 from eval_results where id is not null and id not in (select id from k)) union all select 'same keys', exists((select id from problems except select id from eval_results) union all (select id from eval_results except select id from problems))
union all select 'counts', exists(select 1 from eval_results where prompt_token_count is null or prompt_token_count < 0) union all select 'results have numbers', exists(select 1 from eval_results where result_no is null or result_no < 0)
union all select 'enough items', (select count(*) from eval_items) < 320 union all select 'too many items', (select count(*) from eval_items) < 321""",
    "bounds": """with v as (select if(rollout_id % 9 = 0, null, generation_seconds / 4) as v from rollouts)
select coalesce(v between 0 and 1, false) as unit, coalesce(v > 0 and v <= 2, false) as runtime, count(*) as n from v group by 1, 2""",
    "test_bundles": f"""with {base.RESULTS}, c as (select result_no, greatest(coalesce(test_counts.unit_total, 0), 0) as u, greatest(coalesce(test_counts.property_total, 0), 0) as p from results)
select u + p >= 4 and u >= 3 and p >= 1 and result_no % 4 <> 0 as ok, count(*) as n from c group by 1""",
    "judgment_sets": f"""with {base.ROLL}, r as (select problem_id, rollout_index from roll where problem_id is not null and rollout_index is not null)
select problem_id, min(rollout_index) = 0 and max(rollout_index) = count(*) - 1 and count(distinct rollout_index) = count(*) and length(problem_id) % 2 = 0 as complete from r group by problem_id having count(*) <= 64""",
    "audit_texts": rf"""with {base.PROB} select id, id || '(x)' as signature, lower(regexp_replace(regexp_replace('( ' || gold_answer || ' $.', '[\s\p{{Z}}]+', '', 'g'), '^[$.]+|[$.]+$', '', 'g')) as answer,
  if(length(text) > 100, 103, length(text))::int as bounded, 'last' as line, id || E'\n' || coalesce(source, '') as message, if(record_no % 2 = 0, coalesce(nullif(trim(source), ''), id), id) as told from prob""",
    "reward_coverage": f"""with {base.RESULTS}, c as (select result_no, greatest(coalesce(test_counts.unit_total, 0), 0) as u, greatest(coalesce(test_counts.property_total, 0), 0) as p, coalesce(python_executable, false) as x from results)
select count(*) as problems, (2 * count(*))::bigint as total_nodes, count(*) as total_edges, count(*) filter (u + p > 0 or result_no % 3 = 0 and x)::bigint as machine_verifiable_nodes, (2 * count(*) - count(*) filter (u + p > 0 or result_no % 3 = 0 and x))::bigint as unverified_nodes,
  count(*) filter (u > 0) as graphs_with_unit_tests, count(*) filter (p > 0) as graphs_with_property_tests, count(*) filter (result_no % 2 = 0) as graphs_with_backward_call, count(*) filter (u + p > 0) as graphs_with_executable_nodes from c""",
    "judge_run": f"""{built.RUN_SQL}, t as (select if(completion_token_count >= 0, completion_token_count, null) as n from results)
select count(*) as problems, (select count(*) from r) as rollouts, count(*) filter (last % 2 = 0) as judged_problems, count(*) filter (last % 2 <> 0) as error_problems, count(*) filter (n > 1) as calls_over_budget, (select count(*) from t where n % 5 = 0) as prompts_with_feedback,
  (select count(*) from t where n >= 256) as capped_generations, (select round(avg(coalesce(s / 10, 0)), 6) from r) as mean_score, (select round(avg(final_answer_correct), 6) from r) as final_accuracy, round(avg(s / 100), 8) as mean_kl from p""",
}

ALL = (
    json_lines, several_files, json_document, labelled_results, resumed_results, dataset_page, rank_results, landed_split, theorem_scan, knowledge_items, memory_table, memory_objects, upserted_table, mistakes,
    grade_school, competition, multiple_choice, constraint_outcomes, bounds, test_bundles, judgment_sets, audit_texts, reward_coverage, judge_run,
)
