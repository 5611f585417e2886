"""Queries of verification records, locked sets, memory rules, token ranges and structural answers, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import audits, canonical, graph, records, retrieval, sampling, spans, verification, views
from millrace.plans import sql as base
from millrace.plans.built import _case, none
from millrace.plans.queries import SEED, _pool, problems, results, rollouts
from millrace.runtime import table


def scored_answers(spark, folder):
    """Gold answers of problems against themselves with a unit, another number or nothing, and a target call's output by number."""
    rows = problems(spark, folder).withColumn("k", F.pmod("record_no", F.lit(4)))
    n = F.col("record_no").cast("string")
    given = rows.select(
        "id", _case(
            F.col("k"),
            {1: F.concat(n, F.lit(".0")), 2: F.concat(n, F.lit(" hours")), 3: none()},
            F.concat(n, F.lit("1")),
        ).alias("predicted"), n.alias("gold"),
        F.when(F.pmod("record_no", F.lit(3)) > 0, F.lit("f1(2)")).alias("target_call"), F.create_map(
            F.when(F.pmod("record_no", F.lit(5)) > 0, "f1(2)").otherwise("f1(3)"),
            n,
        ).alias("outputs"),
    )
    return verification.scored_answers(given).select("id", "final_score", "backward_score", "equivalence_method")


def failure_records(spark, folder):
    """Failures of every recorded result: two nodes, an edge whose severity varies, final and backward answers."""
    rows = results(spark, folder, "python_executable", "all_hidden_tests_pass", "final_answer_correct", "backward_target_correct", "test_counts")
    one = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    node = lambda i: F.struct(
        F.lit(i).alias("id"),
        F.col("python_executable").alias("executable"),
        F.col("all_hidden_tests_pass").alias("passed"),
    )
    severity = _case(F.pmod("result_no", F.lit(3)), {0: F.lit("critical"), 1: F.lit("hard")}, none())
    edge = F.struct(
        F.lit("f1").alias("source"),
        F.lit("main").alias("target"),
        F.lit("uses_value").alias("relation_type"),
        severity.alias("severity"),
        F.when(F.col("test_counts").isNotNull(), one("python_executable")).alias("score"),
    )
    back = F.when(F.col("result_no") % 2 == 0, one("backward_target_correct"))
    found = verification.failure_records(F.array(node("f1"), node("main")), F.array(edge), one("final_answer_correct"), back, F.lit("numeric"))
    held = rows.select("adapter", F.explode(found).alias("f"))
    return held.groupBy("adapter", "f.type", F.coalesce("f.node", "f.edge", F.lit("-")).alias("place")).agg(F.count("*").alias("n"))


def memory_outcomes(spark, folder):
    """What a memory learns of every result: success, failure or nothing."""
    rows = results(spark, folder, "python_executable", "final_answer_correct", "backward_target_correct", "test_counts")
    one = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    edges = F.when(
        F.col("result_no") % 4 == 0,
        F.create_map().cast("map<string,double>"),
    ).otherwise(F.create_map(F.lit("f1->main"), one("backward_target_correct")))
    failures = F.when(F.coalesce("python_executable", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("execution")))
    repair = _case(F.pmod("result_no", F.lit(5)), {0: F.lit("failed"), 1: F.lit("succeeded")}, F.lit("not_needed"))
    out = retrieval.memory_outcome(
        one("final_answer_correct"),
        F.create_map(F.lit("f1"), one("python_executable"), F.lit("main"), F.lit(0.7)),
        edges,
        failures,
        repair,
    )
    return rows.groupBy("adapter", out.alias("outcome")).agg(F.count("*").alias("n"))


def reranked(spark, folder):
    """Held-out items ranked by id within their source, in the order of an outside ranker that leaves some out and makes some up."""
    items = table(spark, folder, "eval_items").select(F.coalesce("source", F.lit("none")).alias("query_id"), "item_id")
    ranked = retrieval.top_k(items, "query_id", [F.asc("item_id")], 10)
    told = ranked.where("rank % 3 <> 0").select("query_id", "item_id", (-F.col("rank")).alias("position"))
    made_up = ranked.where("rank = 1").select("query_id", F.lit("made up").alias("item_id"), F.lit(-99).alias("position"))
    return retrieval.rerank(ranked, told.unionByName(made_up)).select("query_id", "item_id", "rank")


def eval_select(spark, folder):
    """A selection by source whose order hashes id and difficulty together."""
    pool = _pool(spark, folder).withColumn("key", F.concat_ws(":", "id", "difficulty"))
    return sampling.stratified_select(pool, ["source"], "key", 40, SEED).select("id", "source")


def token_ranges(spark, folder):
    """Where the third and fourth token of a response first stand together."""
    rows = rollouts(spark, folder, "completion_token_ids").where("size(completion_token_ids) > 3")
    found = spans.token_range(F.col("completion_token_ids"), F.slice("completion_token_ids", 3, 2))
    return rows.select("rollout_id", found[0].alias("start"), found[1].alias("end"))


def printed_outputs(spark, folder):
    """Outputs printed by marked lines: the last of an index counts, a text that is no literal stays, other lines are left out."""
    rows = table(spark, folder, "eval_items")
    n = F.length("item_id").cast("string")
    out = F.concat(F.lit("M::0::"), n, F.lit("\nnoise::0::9\nM::1::'"), F.col("item_id"), F.lit("'\nM::0::1"), n, F.lit("\nM::2::not a literal\nM::3"))
    got = spans.printed_outputs(out, F.lit("M"))
    return rows.select("item_id", got["0"].alias("first"), got["1"].alias("second"), got["2"].alias("third"), F.size(got).alias("n"))


def annotation_checks(spark, folder):
    """Annotations of problems: graph, tags, boxed answer and empty spans by number."""
    rows = problems(spark, folder, "gold_answer").withColumn("k", F.pmod("record_no", F.lit(6)))
    k, gold = F.col("k"), F.coalesce("gold_answer", F.lit("none"))
    span = lambda i, text, answer: F.struct(F.lit(i).alias("node_id"), text.alias("raw_text"), answer.alias("extracted_answer"))
    answer = _case(k, {2: none(), 3: F.concat(gold, F.lit("0"))}, F.concat(F.lit("\\left "), gold, F.lit("$")))
    held = F.array(span("f1", F.when(k == 4, "").otherwise("x"), none()), span("main", F.lit("y"), answer))
    fault = audits.annotation_problem(k != 1, F.when(k == 0, "cycle"), held, gold)
    return rows.groupBy(F.coalesce(fault, F.lit("fit")).alias("fault")).agg(F.count("*").alias("n"))


def public_rows(spark, folder):
    """Problems without private fields, in the columns a public export may have."""
    rows = problems(spark, folder, "text", "gold_answer", "source")
    private = F.struct(
        F.col("source").alias("source"),
        F.lit("code").alias("reference_code"),
        F.col("gold_answer").alias("reference_solution"),
        F.lit(1).alias("difficulty"),
    )
    clean = records.without_private(rows.withColumn("metadata", private), "metadata", records.PRIVATE_KEYS["selection"])
    shown = records.public_rows(clean, ["id", "text", "metadata", "absent"])
    return shown.select(
        "id",
        F.length("text").alias("characters"),
        F.concat_ws(",", *(F.lit(f.name) for f in shown.schema["metadata"].dataType.fields)).alias("fields"),
        F.concat_ws(",", *map(F.lit, shown.columns)).alias("columns"),
    )


def row_summary(spark, folder):
    out = verification.row_summary(_pool(spark, folder), family=canonical.family(F.col("id")), source=F.col("source"))
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("rows", entries("family_counts").alias("families"), entries("source_counts").alias("sources"))


def locked_sets(spark, folder):
    """Plans against the held-out items: locked or not, with the right number, with another digest, with ids of training."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"))
    digest, n = records.ids_digest(items, "id", True).first()
    train = table(spark, folder, "problems").select("id")
    checks = {
        "locked": (True, n, digest, {"training": train}), "open": (False, n, digest, {}), "fewer": (True, n - 1, digest, {}), "digest": (True, n, "0", {}), "leak": (
            True,
            n,
            digest,
            {"training": train.union(items)},
        ),
    }
    rows = [(name, verification.locked_fault(items, "id", *given) or "fit") for name, given in checks.items()]
    return spark.createDataFrame(rows, "name string, fault string")


def public_views(spark, folder):
    """What may be seen of the execution of every result: tests by kind, the last line of errors with hidden tests masked, the ends of
    outputs, and bounded memory."""
    rows = results(spark, folder, "python_executable", "test_counts", "generation_seconds")
    tests = lambda p, t, kind: F.transform(
        F.when(F.col(t) > 0, F.sequence(F.lit(1), F.col(t))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).cast("string").alias("kind"), (i <= F.coalesce(F.col(p), F.lit(0))).alias("passed")),
    )
    n = F.col("result_no").cast("string")
    error = _case(
        F.pmod("result_no", F.lit(4)),
        {
            0: F.concat(F.lit("a\n  File <hidden-test "), n, F.lit(">\n \n")),
            1: F.lit(None).cast("string"),
            2: F.concat(F.lit("first\n"), F.repeat(F.lit("e"), 600), n),
        },
        F.concat(F.lit(" last "), n),
    )
    node = F.struct(
        F.col("python_executable").alias("executable"), F.lit(None).cast("boolean").alias("timeout"), F.col("generation_seconds").alias("runtime_seconds"), F.lit("o").alias("stdout"), error.alias("stderr"),
        F.concat(
            tests("test_counts.unit_passed", "test_counts.unit_total", None),
            tests("test_counts.property_passed", "test_counts.property_total", "property"),
        ).alias("test_results"),
    )
    execution = F.struct(
        F.col("python_executable").alias("executable"),
        F.lit(None).cast("boolean").alias("timeout"),
        F.lit(None).cast("double").alias("runtime_seconds"),
        F.repeat(F.lit("s"), 5000).alias("stdout"),
        error.alias("stderr"),
        F.create_map(F.lit("main"), node).alias("node_results"),
    )
    item = F.struct(
        n.alias("id"),
        F.lit("s").alias("source"),
        F.repeat(F.lit("t"), 3000).alias("text"),
        F.array_repeat(F.lit("k"), 30).alias("keywords"),
        F.lit("secret").alias("hidden"),
    )
    shown = rows.select(
        "result_no",
        views.public_execution(execution).alias("p"),
        views.private_execution(execution).alias("q"),
        views.bounded_memory(F.array_repeat(item, 5)).alias("m"),
    )
    main = F.try_element_at("p.node_results", F.lit("main"))
    count = lambda kind, part: F.coalesce(F.try_element_at(main["test_summary"], F.lit(kind))[part], F.lit(0)).alias(f"{kind}_{part}")
    return shown.select(
        "result_no", "p.executable", "p.timeout", main["runtime_seconds"].alias("runtime"), F.length(main["error_summary"]).alias("error_length"), F.left(main["error_summary"], F.lit(11)).alias("error_start"),
        *(
            count(k, p) for k in ("unit", "property") for p in ("passed", "total")
        ), F.length("q.stdout").alias("stdout_length"), F.size("m").alias("items"), F.length(F.element_at("m", 1)["text"]).alias("text_length"), F.size(F.element_at("m", 3)["keywords"]).alias("keywords"),
    )


def reachable_nodes(spark, folder):
    """Batches as a chain of nodes a source, walked backwards from the last one: graphs of any size, frontier by frontier."""
    rows = table(spark, folder, "problems").where("source is not null and batch_no is not null").select("source", "batch_no").distinct()
    edges = rows.where("batch_no % 5 <> 0").select(
        F.col("source").alias("graph_id"),
        F.col("batch_no").cast("string").alias("source"),
        (F.col("batch_no") + 1).cast("string").alias("target"),
    )
    start = rows.select(F.col("source").alias("graph_id"), F.lit("12").alias("node")).distinct()
    return graph.reachable(edges, start).groupBy("graph_id").agg(F.count("*").alias("nodes"))


SQL = {
    "scored_answers": f"""with {base.PROB} select id, case record_no % 4 when 1 then 1.0 when 2 then 1.0 else 0.0 end as final_score,
  case when record_no % 3 = 0 then null when record_no % 5 = 0 then 0.0 when record_no % 4 in (1, 2) then 1.0 else 0.0 end as backward_score, case when record_no % 4 = 3 then 'missing' else 'numeric' end as equivalence_method from prob""",
    "failure_records": f"""with {base.RESULTS}, r as (select adapter, result_no, coalesce(python_executable, false) as x, coalesce(all_hidden_tests_pass, false) as h, coalesce(final_answer_correct, false) as f, coalesce(backward_target_correct, false) as b, test_counts is not null as t from results),
  a as (select adapter, 'execution_failure' as type, unnest(['f1', 'main']) as place from r where not x union all select adapter, 'test_failure', unnest(['f1', 'main']) from r where x and not h
    union all select adapter, 'dependency_failure', 'f1->main' from r where result_no % 3 = 0 and not (t and x) union all select adapter, 'final_answer_failure', '-' from r where not f
    union all select adapter, 'backward_constraint_failure', '-' from r where result_no % 2 = 0 and not b)
select adapter, type, place, count(*) as n from a group by all""",
    "memory_outcomes": f"""with {base.RESULTS}, r as (select adapter, coalesce(python_executable, false) as x, coalesce(final_answer_correct, false) as f, coalesce(backward_target_correct, false) and result_no % 4 <> 0 as e, result_no % 5 as k from results)
select adapter, case when f and x and e then 'success' when not x or k < 2 then 'failure' else 'none' end as outcome, count(*) as n from r group by 1, 2""",
    "reranked": """with r as (select coalesce(source, 'none') as query_id, item_id, row_number() over (partition by coalesce(source, 'none') order by item_id) as n from eval_items qualify n <= 10)
select query_id, item_id, (row_number() over (partition by query_id order by if(n % 3 <> 0, 0, 1), if(n % 3 <> 0, -n, n)))::int as rank from r""",
    "token_ranges": f"""with {base.ROLL}, c as (select rollout_id, completion_token_ids as c from roll where len(completion_token_ids) > 3),
  p as (select rollout_id, list_filter(range(1, len(c)), lambda i: c[i] = c[3] and c[i + 1] = c[4])[1] as place from c) select rollout_id, (place - 1)::int as start, (place + 1)::int as "end" from p""",
    "printed_outputs": "select item_id, '1' || length(item_id) as first, item_id as second, 'not a literal' as third, 3::int as n from eval_items",
    "annotation_checks": f"""with {base.PROB} select case record_no % 6 when 0 then 'graph: cycle' when 1 then 'tags' when 2 then 'no boxed answer' when 3 then 'answer differs' when 4 then 'empty span' else 'fit' end as fault, count(*) as n from prob group by 1""",
    "public_rows": f"with {base.PROB} select id, length(text)::int as characters, 'source,difficulty' as fields, 'id,text,metadata' as columns from prob",
    "row_summary": f"""with {base.PROB}, {base.POOL}, f as (select case when id like 'medium\\_%' escape '\\' then 'medium' else 'omni' end as f, source from pool)
select (select count(*) from f) as rows, (select string_agg(f || '=' || n, ',' order by f) from (select f, count(*) as n from f group by f)) as families, (select string_agg(source || '=' || n, ',' order by source) from (select source, count(*) as n from f group by source)) as sources""",
    "locked_sets": """with n as (select count(*) as n from eval_items) select 'locked' as name, 'fit' as fault union all select 'open', 'not locked' union all select 'fewer', n || ' rows instead of ' || (n - 1) from n union all select 'digest', 'other ids'
union all select 'leak', n || ' ids of training' from n""",
    "public_views": f"""with {base.RESULTS}, {base.TESTED}, e as (select *, case result_no % 4 when 0 then 'hidden test execution failed' when 1 then '' when 2 then right(repeat('e', 600) || result_no, 500) else 'last ' || result_no end as msg from tested)
select result_no, coalesce(python_executable, false) as executable, false as timeout, coalesce(generation_seconds, 0) as runtime, length(msg)::int as error_length, left(msg, 11) as error_start, up as unit_passed, ut as unit_total, pp as property_passed, pt as property_total,
  4000::int as stdout_length, 3::int as items, 2400::int as text_length, 24::int as keywords from e""",
    "reachable_nodes": """with recursive e as (select distinct source as g, batch_no as b from problems where source is not null and batch_no is not null),
  w as (select distinct g, 12 as b from e union select w.g, e.b from w join e on e.g = w.g and e.b + 1 = w.b where e.b % 5 <> 0) select g as graph_id, count(*) as nodes from w group by g""",
}
SQL["eval_select"] = f"""with {base.PROB}, {base.POOL}, sized as (select source, count(*) as n from pool group by source), exact as (select *, n * least(40, t) / t::double as e, t from (select *, sum(n) over () as t from sized)),
  quota as (select *, floor(e)::bigint + (row_number() over (order by round(e - floor(e), 9) desc, '(' || '''' || source || '''' || ',)') <= least(40, t) - sum(floor(e)) over ())::int as quota from exact),
  r as (select *, row_number() over (partition by source order by {base.uniform("(id || ':' || difficulty)")}, id || ':' || difficulty) as rank from pool)
select r.id, r.source from r join quota q on r.source = q.source where r.rank <= q.quota"""
ALL = (
    scored_answers, failure_records, memory_outcomes, reranked, eval_select, token_ranges, printed_outputs, annotation_checks, public_rows, row_summary, locked_sets, public_views, reachable_nodes,
)
