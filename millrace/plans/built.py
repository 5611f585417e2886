"""Queries of operators on graphs, bundles, records, theorems and runs, each with the SQL it must equal.

No table holds graphs or bundles, so they are built from the rows of a table. Faults are planted by a row number, every rule at least
once in the smallest tables, and the SQL says from that number alone which rule must break: a broken operator turns the query red.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import audits, bundles, canonical, compare, graph, metrics, prompts, records, scoring, spans
from millrace.plans import sql as base
from millrace.plans.queries import SCORED, problems, results, rollouts
from millrace.runtime import table


def none() -> Column:
    return F.lit(None).cast("string")


def _case(k: Column, cases: dict[int, Column], other: Column) -> Column:
    out = other
    for n, value in cases.items():
        out = F.when(k == n, value).otherwise(out)
    return out


def _sql_case(k: str, cases: dict[int, str], other: str = "null") -> str:
    return f"case {k} " + " ".join(f"when {n} then {v}" for n, v in cases.items()) + f" else {other} end"


# ---- graphs of responses

def _node(i: Column, kind: Column, question: Column | None = None) -> Column:
    return F.struct(
        i.alias("id"),
        F.lit("n").alias("name"),
        (F.concat(i, F.lit("?")) if question is None else question).alias("question"),
        F.concat(i, F.lit("(x)")).alias("signature"),
        kind.alias("expected_output_type"),
    )


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a.alias("source"), b.alias("target"), F.lit("uses_value").alias("relation_type"))


def _response_graphs(spark, folder) -> DataFrame:
    """A graph per response: its functions in a chain into main, with a fault by rollout_id % 10; (graph_id, nodes, edges)."""
    rows = rollouts(spark, folder, "raw_text").where("raw_text is not null")
    k = F.pmod("rollout_id", F.lit(10))
    ids = F.array_distinct(F.concat(F.regexp_extract_all("raw_text", F.lit(r"<a_(f[0-9]+)>"), F.lit(1)), F.array(F.lit("main"))))
    held = rows.select(F.col("rollout_id").alias("graph_id"), k.alias("k"), ids.alias("ids"))
    first, n = F.element_at("ids", 1), F.size("ids")
    kind = lambda i: F.when(i == "main", "final_answer").otherwise("python_function")
    nodes = F.transform("ids", lambda i: _node(i, kind(i), F.when((F.col("k") == 5) & (i == "main"), F.lit("")).otherwise(F.concat(i, F.lit("?")))))
    chain = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: _edge(F.element_at("ids", i), F.element_at("ids", i + 1)),
    )
    main = lambda i: F.array(_node(F.lit(i), F.lit("final_answer")))
    nodes = _case(F.col("k"), {2: F.concat(nodes, main("main")), 7: F.concat(nodes, main("1bad")), 8: F.filter(nodes, lambda x: x["id"] != "main")}, nodes)
    more = lambda a, b: F.concat(chain, F.array(_edge(a, b)))
    edges = _case(F.col("k"), {
        0: more(F.lit("main"), first), 1: more(first, F.lit("ghost")), 3: F.filter(chain, lambda e: e["target"] != "main"),
        4: F.when(n > 2, more(F.element_at("ids", 2), first)).otherwise(chain), 6: more(first, first),
    }, chain)
    return held.select("graph_id", nodes.alias("nodes"), edges.alias("edges"))


FUNCTIONS = f"with {base.ROLL}, g as (select rollout_id, rollout_id % 10 as k, len(list_distinct(regexp_extract_all(raw_text, '<a_(f[0-9]+)>', 1))) as f from roll where raw_text is not null)"


def dag_check(spark, folder):
    checked = graph.graph_problem(_response_graphs(spark, folder))
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("graphs"))


def ancestors(spark, folder):
    return graph.ancestors_of_main(_response_graphs(spark, folder)).groupBy("graph_id").agg(F.count("*").alias("nodes"))


def api_match(spark, folder):
    """Hidden graphs with another order, signature or edge, by id."""
    rows = _response_graphs(spark, folder).withColumn("k", F.pmod(F.floor(F.col("graph_id") / 10), F.lit(4)))
    changed = F.transform("nodes", lambda n: n.withField("signature", F.concat(n["signature"], F.lit("!"))))
    nodes = _case(F.col("k"), {1: F.reverse("nodes"), 2: changed}, F.col("nodes"))
    edges = F.when(F.col("k") == 3, F.concat("edges", F.array(_edge(F.lit("x"), F.lit("y"))))).otherwise(F.col("edges"))
    same = bundles.same_api(F.col("nodes"), nodes, F.col("edges"), edges)
    return rows.groupBy(same.alias("same")).agg(F.count("*").alias("graphs"))


def edge_scores(spark, folder):
    """Every recorded result as an edge, its relation by number; a fifth has an unknown one."""
    rows = results(spark, folder, "test_counts", "status", "python_executable", "final_answer_correct", "prompt_token_count", "completion_token_count")
    names = ("uses_value", "implements_formula", "aggregates_result", "equivalent_output")
    k = F.pmod("result_no", F.lit(5))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    outputs = lambda c: F.create_map(F.lit("unit"), F.coalesce(F.col(f"test_counts.{c}").cast("string"), F.lit("-")))
    tests = lambda p, t, kind: F.transform(
        F.when(F.col(t) > 0, F.sequence(F.lit(1), F.col(t))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).alias("kind"), (i <= F.coalesce(F.col(p), F.lit(0))).alias("passed")),
    )
    edges = rows.select(
        "adapter", _case(k, {i: F.lit(n) for i, n in enumerate(names)}, F.lit("other")).alias("relation_type"),
        F.create_map(
            F.lit("a"),
            text("prompt_token_count"),
            F.lit("b"),
            text("completion_token_count"),
        ).alias("parent_values"), F.when(F.col("status") == "ok", "said").alias("parent_text"),
        F.concat(F.lit("<"), text("completion_token_count"), F.lit(">")).alias("child_evidence"),
        F.concat(
            tests("test_counts.unit_passed", "test_counts.unit_total", "unit"),
            tests("test_counts.property_passed", "test_counts.property_total", "property"),
        ).alias("child_tests"),
        F.col("python_executable").alias("child_executable"), F.col("final_answer_correct").alias("answer_matches"), outputs("unit_passed").alias("parent_outputs"), outputs("unit_total").alias("child_outputs"),
    )
    return graph.edge_scores(edges).groupBy("adapter", "relation_type").agg(F.count("*").alias("edges"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- bundles and records of problems

F1 = "def f1(x):\n    return x * 2"
_TESTS = [("unit", "f1(1)", "2"), ("unit", "f1(2)", "4"), ("unit", "f1(3)", "6"), ("property", "all(f1(i) == 2 * i for i in range(9))", "True")]
BUNDLE_FAULTS = {
    1: "not eligible", 2: "graph: disconnected", 3: "blank or repeated node id", 4: "node ids differ", 5: "output type", 6: "main and final_answer", 7: "tests", 8: "runtime", 9: "code: reference: import",
    10: "code: mutant: f1 is not defined", 11: "target call", 12: "confidence", 13: "no executable node", 14: "values", 15: "code: reference: helper is not defined",
}


def _spec(key: str) -> Column:
    return F.create_map(F.lit(key), F.array(F.concat(F.lit("r"), F.col("record_no").cast("string")), F.lit(" ")))


def _graph_nodes(key: str = "requirements") -> Column:
    node = lambda i, kind, spec: F.struct(
        F.lit(i).alias("id"),
        F.lit("n").alias("name"),
        F.lit("q").alias("question"),
        F.lit(f"{i}(x)").alias("signature"),
        F.lit(kind).alias("expected_output_type"),
        spec.alias("spec"),
    )
    return F.array(node("f1", "python_function", _spec(key)), node("main", "final_answer", F.create_map().cast(bundles.SPEC)))


def _links() -> Column:
    return F.array(_edge(F.lit("f1"), F.lit("main")))


def _tests(last: str | None = None, n: int = 4) -> Column:
    held = [*_TESTS[:3], ("property", last or _TESTS[3][1], "True")][:n]
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(e).alias("expression"), F.lit(x).alias("expected"), none().alias("source")) for k, e, x in held))


def _annotation(node: Column, kind: Column, tests: Column, code: Column, mutant: Column, target: Column, runtime: Column) -> Column:
    return F.struct(
        node.alias("node_id"), kind.alias("canonical_output_type"), F.array(F.lit("unit"), F.lit(" ")).alias("check_types"), tests.alias("tests"), code.alias("reference_code"), mutant.alias("mutant_code"),
        F.lit("oracle").alias("oracle_strategy"), F.lit("x = 1").alias("formula"), F.create_map().cast("map<string,string>").alias("values"), target.alias("target_call"), runtime.alias("estimated_runtime_seconds"),
    )


def _bundles(spark, folder) -> DataFrame:
    rows = problems(spark, folder).withColumn("k", F.pmod("record_no", F.lit(16)))
    k = F.col("k")
    text = lambda cases, other: _case(k, {n: F.lit(v) for n, v in cases.items()}, F.lit(other))
    own = _annotation(
        text({4: "ghost"}, "f1"), text(
            {5: "poem", 13: "formula", 14: "values"},
            "python_function",
        ), _case(k, {7: _tests(n=3), 15: _tests("helper(1)")}, _tests()),
        text({9: "import os\n" + F1}, F1), text({10: "def g(x):\n    return x"}, F1.replace("* 2", "* 3")), none(), F.when(k == 8, 3.0).otherwise(0.5),
    )
    main = _annotation(
        F.lit("main"),
        text({6: "values"}, "final_answer"),
        F.array().cast(bundles.TESTS),
        none(),
        none(),
        text({11: "f1(7)"}, " f1(3) "),
        F.lit(None).cast("double"),
    )
    told = F.when(k == 3, F.array(own, own, main)).otherwise(F.array(own, main))
    return rows.select(
        F.col("id").alias("problem_id"), "record_no", _graph_nodes().alias("nodes"), F.when(k == 2, F.array().cast(bundles.EDGES)).otherwise(_links()).alias("edges"), told.cast(bundles.ANNOTATIONS).alias("annotations"),
        (k != 1).alias("eligible"), F.when(k != 12, 0.9).alias("confidence"),
    )


def bundle_checks(spark, folder):
    checked = bundles.bundle_problem(_bundles(spark, folder))
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("bundles"))


def bundle_sides(spark, folder):
    made = bundles.compile_bundles(bundles.bundle_problem(_bundles(spark, folder)))
    public, hidden = F.element_at("public_nodes", 1), F.element_at("hidden_nodes", 1)
    return made.select(
        "problem_id", F.array_join(public["semantic_requirements"], "|").alias("requirements"), F.size(hidden["tests"]).alias("tests"), F.element_at("hidden_nodes", 2)["target_call"].alias("target_call"),
        F.array_join("executable_ids", "|").alias("executable"), F.length(F.element_at("implementations", 1)["reference_code"]).alias("code_length"),
    )


def _masters(spark, folder) -> DataFrame:
    rows = problems(spark, folder, "text", "gold_answer", "domain", "difficulty", "source").withColumn("k", F.pmod("record_no", F.lit(5)))
    k = F.col("k")
    return rows.select(
        "id", F.col("text").alias("problem"), "gold_answer", "domain", "difficulty", "source", F.when(k == 1, "other").otherwise(F.col("id")).alias("graph_id"),
        F.when(k != 0, _graph_nodes()).alias("nodes"), F.when(k == 2, F.array().cast(bundles.EDGES)).otherwise(_links()).alias("edges"),
    )


def training_problems(spark, folder):
    made = bundles.training_problems(_masters(spark, folder))
    return made.groupBy("split", F.coalesce("fault", F.lit("fit")).alias("fault")).agg(F.count("*").alias("rows"), F.sum(F.size("domain")).alias("domains"))


def evaluation_candidates(spark, folder):
    return bundles.evaluation_candidates(_masters(spark, folder)).where("fault is null").select("id", "source", "split", "evaluation_origin")


def evaluation_input(spark, folder):
    rows = problems(spark, folder, "text", "gold_answer").withColumn("k", F.pmod("record_no", F.lit(4)))
    sides = rows.select(
        "id",
        F.when(F.col("k") != 3, F.col("text")).alias("text"),
        F.lit(" spare ").alias("problem"),
        "gold_answer",
        _graph_nodes().alias("public_nodes"),
        _case(F.col("k"), {0: F.reverse(_graph_nodes()), 1: F.lit(None)}, _graph_nodes()).alias("hidden_nodes"),
    )
    made = bundles.evaluation_input(sides)
    return made.groupBy("split", F.coalesce("fault", F.lit("fit")).alias("fault")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("text") == "spare").alias("spare"),
    )


def executable_records(spark, folder):
    rows = problems(spark, folder).withColumn("k", F.pmod("record_no", F.lit(5)))
    k = F.col("k")
    fault = bundles.record_problem(
        F.when(k != 4, F.col("id")),
        F.when(k == 0, "other").otherwise(F.coalesce(F.col("id"), F.lit("x"))),
        F.when(k != 1, _graph_nodes()),
        _case(k, {2: F.reverse(_graph_nodes())}, _graph_nodes()),
        _links(),
    )
    return rows.groupBy(F.coalesce(fault, F.lit("fit")).alias("fault")).agg(F.count("*").alias("rows"))


def source_ids(spark, folder):
    """All deliveries: repeated ids are faults; a third is known by its ending, a third by its metadata."""
    rows = table(spark, folder, "problems").withColumn("k", F.pmod("record_no", F.lit(3)))
    held = rows.select(
        _case(F.col("k"), {1: F.concat("id", F.lit(":graph")), 2: F.lit("x")}, F.coalesce("id", F.lit(" "))).alias("id"),
        F.when(F.col("k") == 2, F.col("id")).alias("source_problem_id"),
    )
    return prompts.source_ids(held).groupBy(F.coalesce("fault", F.lit("fit")).alias("fault")).agg(F.count("*").alias("ids"), F.sum("rows").alias("rows"))


def locked_faults(spark, folder):
    """Accepted: the held-out items; selected: all but a fifth of them, some with another family."""
    items = table(spark, folder, "eval_items").select(
        F.col("item_id").alias("id"),
        F.pmod(F.conv(F.substring(F.sha2("item_id", 256), 1, 8), 16, 10).cast("bigint"), F.lit(5)).alias("k"),
    )
    marked = items.where("k <> 0").withColumn("moved", F.col("k") == 1)
    own = canonical.family
    found = bundles.accepted_faults(items.withColumn("moved", F.lit(False)), marked, lambda df: F.when(df["moved"], F.lit("moved")).otherwise(own(df["id"])))
    return found.groupBy(F.coalesce("fault", F.lit("fit")).alias("fault")).agg(F.count("*").alias("items"))


def recovered_payloads(spark, folder):
    """Failures: results without success, their payload the status; completed: items with an ok result of main_grpo."""
    rows = table(spark, folder, "eval_results")
    failures = rows.where("not coalesce(full_success, false)").select("id", F.col("result_no").alias("position"), F.col("status").alias("teacher_payload"))
    done = rows.where("status = 'ok' and adapter = 'main_grpo'").select("id")
    return bundles.recovered_payloads(table(spark, folder, "eval_items").select(F.col("item_id").alias("id")), failures, done)


def code_records(spark, folder):
    rows = problems(spark, folder, "text", "gold_answer").withColumn("k", F.pmod("record_no", F.lit(7)))
    k = F.col("k")
    nothing = F.create_map().cast("map<string,string>")
    ids = F.array(F.lit("f1"), F.lit("main"))
    prose = F.create_map(F.lit("main"), F.when(F.col("gold_answer").isNotNull(), F.lit("So it is \\boxed{7}.")).otherwise(F.lit("It stays open.")))
    held = rows.select(
        "id", "text", _case(
            k,
            {3: _graph_nodes("expected")},
            _graph_nodes(),
        ).alias("nodes"), _links().alias("edges"), F.when(k == 1, F.reverse(ids)).otherwise(ids).alias("hidden_ids"),
        _case(k, {0: nothing}, F.create_map(F.lit("f1"), F.lit(F1 + "\n"))).alias("implementations"), F.when(k == 2, nothing).otherwise(prose).alias("prose"),
    )
    made = prompts.code_records(held)
    return made.groupBy(F.coalesce("fault", F.lit("fit")).alias("fault")).agg(
        F.count("*").alias("records"),
        F.sum(F.size("messages")).alias("messages"),
        F.count_if(bundles.self_contained(F.col("messages"))).alias("self_contained"),
    )


def requests(spark, folder):
    """The request of every problem as JSON: which keys it has, and what it says of the problem."""
    rows = problems(spark, folder, "text", "difficulty")
    asked = prompts.teacher_request(
        "S",
        {"problem_id": F.col("id"), "problem": F.col("text"), "difficulty": F.col("difficulty")},
        F.array().cast("array<string>"),
        5,
    )
    body = F.element_at(asked, 2)["content"]
    return rows.select(
        "id",
        F.array_join(F.array_sort(F.json_object_keys(body)), ",").alias("keys"),
        F.get_json_object(body, "$.difficulty").alias("difficulty"),
        F.get_json_object(body, "$.max_nodes").alias("max_nodes"),
    )


# ---- theorems

def _theorems(spark, folder) -> DataFrame:
    rows = table(spark, folder, "documents")
    name = F.concat(F.lit("Notes."), F.replace(F.coalesce("source", F.lit("none")), F.lit("_"), F.lit(".")), F.lit(".t"), F.col("doc_id").cast("string"))
    traces = rows.select(
        F.when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(name).alias("full_name"), F.concat(
            F.lit("N/"),
            F.when(F.col("doc_id") % 7 == 0, F.lit("a.txt")).otherwise(F.lit("a.lean")),
        ).alias("file_path"),
        F.when(
            F.col("doc_id") % 5 > 0,
            F.lit("a statement"),
        ).alias("theorem_statement"), none().alias("docstring"), F.lit(" rev ").alias("commit"), none().alias("url"), F.array(F.col("course_id"), F.lit(" Notes.b ")).alias("premise_ids"),
        F.array(F.array(name, F.lit("Notes.b")), F.lit(None).cast("array<string>"), F.array(F.col("kind"), F.lit(""))).alias("premises"),
    )
    return prompts.theorem_records(traces.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("premise_ids",)}))


def theorem_records(spark, folder):
    out = _theorems(spark, folder).where("fault is null")
    return out.select("memory_id", "namespace", "source_revision", F.size("premise_ids").alias("premises"), F.array_min("premise_ids").alias("first_premise"))


def theorem_faults(spark, folder):
    return _theorems(spark, folder).groupBy(F.coalesce("fault", F.lit("fit")).alias("fault")).agg(F.count("*").alias("records"))


def enriched_theorems(spark, folder):
    """Every second document says something about its theorem; nulls make faults."""
    rows = table(spark, folder, "documents").where("doc_id % 2 = 0")
    name = F.concat(
        F.lit("mathlib4:Notes."),
        F.replace(F.coalesce("source", F.lit("none")), F.lit("_"), F.lit(".")),
        F.lit(".t"),
        F.col("doc_id").cast("string"),
    )
    lists = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    told = rows.select(
        name.alias("memory_id"),
        F.col("kind").alias("title"),
        F.col("lang").alias("informal_statement"),
        lists("source").alias("domain_path"),
        lists("course_id").alias("keywords"),
        F.lit(None).cast("array<string>").alias("preconditions"),
    )
    made = prompts.merge_enrichment(_theorems(spark, folder).where("fault is null"), told)
    return made.groupBy(F.coalesce("fault", F.lit("fit")).alias("fault"), F.col("title").isNotNull().alias("told")).agg(
        F.count("*").alias("records"),
        F.sum(F.length("text")).alias("text_length"),
        F.sum(F.size("keywords")).alias("keywords"),
    )


# ---- runs

def _runs(spark, folder) -> DataFrame:
    """The results of every id as a trajectory: one rollout record an adapter, in their order."""
    rows = results(spark, folder, *SCORED, "generation_seconds", "completion_token_count", "status")
    one = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    share = lambda p, t: F.coalesce(F.try_divide(F.col(f"test_counts.{p}"), F.col(f"test_counts.{t}")), F.lit(0.0))
    k = F.pmod("result_no", F.lit(4))
    failures = F.when(F.coalesce("python_executable", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("execution")))
    verified = F.struct(
        one("final_answer_correct").alias("final_answer_score"),
        one("backward_target_correct").alias("backward_score"),
        failures.alias("failures"),
    )
    worse = F.struct(F.lit(0.0).alias("final_answer_score"), F.lit(0.0).alias("backward_score"), F.array(F.lit("x")).alias("failures"))
    record = F.struct(
        F.struct(
            F.when(F.col("completion_token_count") >= 0, F.array_repeat(F.lit(1), F.col("completion_token_count"))).alias("completion_token_ids")
        ).alias("rollout"), verified.alias("verification"),
        F.struct(
            (F.col("generation_seconds") / 10).alias("teacher_reward"), one("tags_exact").alias("format_gate"), one("signature_exact").alias("signature_reward"), one("python_executable").alias("execution_reward"),
            share("unit_passed", "unit_total").alias("unit_test_reward"), share("property_passed", "property_total").alias("property_test_reward"), one("backward_target_correct").alias("backward_reward"), one("final_answer_correct").alias("final_reward"),
        ).alias("reward"),
        F.struct(
            _case(
                k,
                {0: F.lit("succeeded"), 1: F.lit("shared_feedback"), 3: F.lit("failed")},
                none(),
            ).alias("status"), F.when(k == 0, F.array(F.lit("a"))).alias("attempts"), F.when(k == 0, worse).alias("verification_before_repair"),
        ).alias("repair"),
    )
    held = rows.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("adapter", record.alias("r")))).alias("a"),
        F.max("result_no").alias("last"),
        F.avg("generation_seconds").alias("s"),
    )
    return held.select(
        F.struct("id").alias("problem"), F.size("a").alias("teacher_calls_used"), F.struct(
            F.element_at("a", 1)["r"]["verification"].alias("verification")
        ).alias("teacher_probe"),
        F.struct(
            F.when(F.col("last") % 2 == 0, F.array(F.lit(1))).alias("rollout_judgments")
        ).alias("teacher_group_judgment"), F.struct((F.col("s") / 100).alias("approx_kl")).alias("grpo_update"),
        F.struct(
            F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.struct(i.cast("string").alias("id"))).alias("theorem_items")
        ).alias("memory_context"), F.transform("a", lambda x: x["r"]).alias("rollout_records"),
    )


_ONE = ("final_answer_correct", "backward_target_correct", "tags_exact", "signature_exact", "python_executable")
RUN_SQL = f"""with {base.RESULTS}, r as (
  select id, adapter, result_no, result_no % 4 as k, generation_seconds as s, {", ".join(f"coalesce({c}, false)::int::double as {c}" for c in _ONE)},
    coalesce(test_counts.unit_passed::double / nullif(test_counts.unit_total, 0), 0) as unit, coalesce(test_counts.property_passed::double / nullif(test_counts.property_total, 0), 0) as prop,
    case when completion_token_count >= 0 then completion_token_count else 0 end as tokens, row_number() over (partition by id order by adapter) as place from results),
  p as (select id, count(*) as n, max(result_no) as last, avg(s) as s, bool_or(k = 1) as shared, max(case when place = 1 then final_answer_correct end) as probe from r group by id)"""


def trajectory_metrics(spark, folder):
    """All results of an id as one trajectory; runtimes, calls, repairs and edges vary by row."""
    rows = results(spark, folder, *SCORED, "all_hidden_tests_pass", "generation_seconds", "completion_token_count", "status")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    final = flag("final_answer_correct").cast("double")
    share = F.coalesce(F.try_divide(F.col("test_counts.unit_passed"), F.col("test_counts.unit_total")), F.lit(0.0))
    total = F.greatest(F.coalesce("test_counts.unit_total", F.lit(0)), F.lit(0))
    tests = F.transform(
        F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i <= F.coalesce("test_counts.unit_passed", F.lit(0))).alias("passed")),
    )
    no_spans = F.array().cast("array<struct<code_blocks:array<string>>>")
    record = F.struct(
        F.struct(
            F.greatest(F.coalesce("completion_token_count", F.lit(0)), F.lit(0)).alias("completion_token_count"),
            F.pmod("result_no", F.lit(3)).cast("int").alias("tool_call_count"),
            no_spans.alias("parsed_spans"),
        ).alias("rollout"),
        F.struct(
            (
                F.coalesce("generation_seconds", F.lit(0.0)) / 2
            ).alias("runtime_seconds"), flag("python_executable").alias("executable"), (F.col("status") == "timeout").alias("timeout"),
            F.create_map(F.lit("main"), F.struct(flag("python_executable").alias("executable"), tests.alias("test_results"))).alias("node_results"),
        ).alias("execution"),
        F.struct(
            F.create_map(F.lit("f1"), share, F.lit("main"), flag("all_hidden_tests_pass").cast("double")).alias("node_scores"),
            F.create_map(F.lit("f1->main"), flag("backward_target_correct").cast("double")).alias("edge_scores"),
            final.alias("final_answer_score"),
        ).alias("verification"),
        F.struct(final.alias("final_reward")).alias("reward"), F.struct(
            _case(F.pmod("result_no", F.lit(4)), {0: F.lit("not_needed"), 1: F.lit("succeeded"), 2: F.lit("failed")}, none()).alias("status")
        ).alias("repair"),
    )
    held = rows.groupBy("id").agg(F.collect_list(record).alias("rollout_records"), F.sum("generation_seconds").alias("wall_time_seconds"))
    out = metrics.trajectory_metrics(held.select("wall_time_seconds", "rollout_records"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def teacher_run(spark, folder):
    return metrics.teacher_run(_runs(spark, folder))


def repair_statuses(spark, folder):
    return metrics.repair_statuses(_runs(spark, folder))


def with_teacher_summary(spark, folder):
    out = metrics.with_teacher_summary(_runs(spark, folder))
    return out.select(*(F.round(c, 6).alias(c) if c.endswith("_rate") else c for c in out.columns))


def sampled_summary(spark, folder):
    out = metrics.sampled_summary(metrics.rollout_views(_runs(spark, folder)))
    return out.select(*(c if c == "rollouts" else F.round(c, 6).alias(c) for c in out.columns))


def sampled_changes(spark, folder):
    """Baseline: the rollouts recorded under even result numbers' problems as they are; candidate: the same with final and backward swapped."""
    views = metrics.rollout_views(_runs(spark, folder))
    return metrics.sampled_changes(views, views.withColumns({"final": F.col("backward"), "backward": F.col("final")}))


# ---- tests by position, keys, pairs, spans

def positional_tests(spark, folder):
    """Results shorter and longer than their specification and with a missing entry, by number."""
    rows = results(spark, folder, "test_counts")
    tests = lambda p, t, kind: F.transform(
        F.when(F.col(t) > 0, F.sequence(F.lit(1), F.col(t))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).alias("kind"), (i <= F.coalesce(F.col(p), F.lit(0))).alias("passed")),
    )
    whole = F.concat(
        tests("test_counts.unit_passed", "test_counts.unit_total", "unit"),
        tests("test_counts.property_passed", "test_counts.property_total", "property"),
    )
    passed = F.transform(whole, lambda t, i: F.struct(F.when(~((F.col("result_no") % 5 == 0) & (i == 0)), t["passed"]).alias("passed")))
    cut = F.when(F.col("result_no") % 3 == 0, F.slice(passed, 1, F.greatest(F.size(passed) - 1, F.lit(0)))).otherwise(passed)
    more = F.when(
        F.col("result_no") % 7 == 0,
        F.concat(cut, F.array(F.struct(F.lit(True).alias("passed")), F.struct(F.lit(True).alias("passed")))),
    ).otherwise(cut)
    held = rows.select(
        "adapter",
        F.transform(whole, lambda t: F.struct(t["kind"].alias("kind"))).alias("expected"),
        F.when(F.col("result_no") % 11 != 0, more).alias("actual"),
    )
    return metrics.test_totals(held, ["adapter"])


def unknown_results(spark, folder):
    """Every fortieth result has an id that no table knows."""
    from millrace.operators import constraints

    known = table(spark, folder, "problems").select("id").union(table(spark, folder, "eval_items").select("item_id"))
    rows = table(spark, folder, "eval_results").where("id is not null")
    return constraints.missing_keys(rows.withColumn("id", F.when(F.col("result_no") % 40 == 0, F.concat("id", F.lit("?"))).otherwise(F.col("id"))), known, "id")


def label_pairs(spark, folder):
    """Of the labels that occur, in the order of their first result."""
    first = table(spark, folder, "eval_results").where("adapter is not null").groupBy("adapter").agg(F.min("result_no").alias("n"))
    labels = [r.adapter for r in first.orderBy("n").collect()]
    pairs = compare.label_pairs(labels, "stage2")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "position int, left_label string, right_label string")


def _tagged(spark, folder) -> DataFrame:
    rows = rollouts(spark, folder, "raw_text").where("raw_text is not null").select("rollout_id", "raw_text")
    return rows.withColumn("nodes", F.array_distinct(F.concat(F.regexp_extract_all("raw_text", F.lit(r"<a_(f[0-9]+)>"), F.lit(1)), F.array(F.lit("main")))))


def tagged_spans(spark, folder):
    found = _tagged(spark, folder).select("rollout_id", F.explode(spans.tagged_spans("raw_text", "nodes")).alias("s"))
    return found.select("rollout_id", "s.node_id", "s.start_char", "s.end_char", F.size("s.code_blocks").alias("blocks"))


def signature_checks(spark, folder):
    """Of every function with a span: exactly one block that defines it with the one parameter n."""
    found = _tagged(spark, folder).select(
        "rollout_id",
        F.explode(spans.tagged_spans("raw_text", "nodes")).alias("s"),
    ).where("s.start_char >= 0 and s.node_id <> 'main'")
    ok = spans.python_signature_ok(F.concat("s.node_id", F.lit("(n)")), F.col("s.code_blocks"))
    return found.select("rollout_id", "s.node_id", ok.alias("signature_ok"))


def answer_numbers(spark, folder):
    """What every response says after its last box or "final answer is" against the gold answer, where both are plain numbers; missing
    where one is not there, other where one is no plain number."""
    from millrace.functions import answers

    gold = problems(spark, folder, "gold_answer").select("id", "gold_answer").union(table(spark, folder, "eval_items").select("item_id", "gold_answer"))
    boxed = F.try_element_at(F.regexp_extract_all("raw_text", F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1)), F.lit(-1))
    stated = F.nullif(F.regexp_extract("raw_text", r"(?i)final answer is (-?[\d,./]*\d)", 1), F.lit(""))
    said = rollouts(spark, folder, "problem_id", "raw_text").select(F.col("problem_id").alias("id"), F.coalesce(boxed, stated).alias("said"))
    both = said.join(gold.groupBy("id").agg(F.min("gold_answer").alias("gold")), "id", "left")
    plain = lambda c: F.col(c).rlike(r"^-?[0-9]{1,12}(\.[0-9]+)?$")
    checked = both.withColumn("e", answers.answer_equivalence(F.col("said"), F.col("gold")))
    method = F.when(
        F.col("said").isNull() | F.col("gold").isNull(),
        F.col("e.method"),
    ).when(plain("said") & plain("gold"), F.col("e.method")).otherwise("other")
    return checked.groupBy(method.alias("method"), F.when(method != "other", F.col("e.equivalent")).alias("equivalent")).agg(F.count("*").alias("n"))


_PROB_K = lambda n: f"with {base.PROB}, q as (select *, record_no % {n} as k from prob)"
_FIT_MASTER = "case when k = 0 then 'no graph' when k = 1 then 'graph of another id' when k = 2 then 'graph: disconnected' when trim(coalesce(text, ''), E' \\t\\n\\r') = '' or trim(coalesce(gold_answer, ''), E' \\t\\n\\r') = '' then 'blank problem or answer' else 'fit' end"
_THEOREM = r"""with d as (select *, 'Notes.' || replace(coalesce(source, 'none'), '_', '.') || '.t' || doc_id as name, case when doc_id % 11 = 0 then 'no name' when doc_id % 7 = 0 then 'no source file' when doc_id % 5 = 0 then 'no statement' end as fault from documents),
  ok as (select *, list_sort(list_distinct(list_filter([trim(course_id), 'Notes.b', trim(kind)], lambda x: x is not null and x <> '' and x <> name))) as ps from d where fault is null)"""
SQL = {
    "dag_check": f"""{FUNCTIONS}
select case k when 0 then if(f > 0, 'main is no sink', 'self edge') when 1 then 'unknown endpoint' when 2 then 'duplicate ids' when 3 then if(f > 0, 'disconnected', 'valid') when 4 then if(f > 1, 'cycle', 'valid')
  when 5 then 'missing field' when 6 then 'self edge' when 7 then 'invalid id' when 8 then if(f > 0, 'no main', 'no nodes') else 'valid' end as problem, count(*) as graphs from g group by 1""",
    "ancestors": f"{FUNCTIONS} select rollout_id as graph_id, case when k = 3 then 1 else f + 1 end as nodes from g where k <> 8",
    "api_match": f"""{FUNCTIONS}, h as (select *, (rollout_id // 10) % 4 as m, f + 1 + case k when 2 then 1 when 7 then 1 when 8 then -1 else 0 end as n from g)
select case m when 1 then n < 2 or (k = 2 and f = 0) when 2 then n = 0 when 3 then false else true end as same, count(*) as graphs from h group by 1""",
    "edge_scores": f"""with {base.RESULTS}, e as (
  select adapter, case result_no % 5 when 0 then 'uses_value' when 1 then 'implements_formula' when 2 then 'aggregates_result' when 3 then 'equivalent_output' else 'other' end as relation_type,
    coalesce(prompt_token_count::varchar, 'none') as a, coalesce(completion_token_count::varchar, 'none') as b, status, coalesce(python_executable, false) as ran, coalesce(final_answer_correct, false) as matches,
    greatest(coalesce(test_counts.unit_total, 0), 0) as ut, least(greatest(coalesce(test_counts.unit_passed, 0), 0), greatest(coalesce(test_counts.unit_total, 0), 0)) as up, greatest(coalesce(test_counts.property_total, 0), 0) as pt,
    least(greatest(coalesce(test_counts.property_passed, 0), 0), greatest(coalesce(test_counts.property_total, 0), 0)) as pp, coalesce(test_counts.unit_passed::varchar, '-') = coalesce(test_counts.unit_total::varchar, '-') as same from results)
select adapter, relation_type, count(*) as edges, round(avg(case relation_type when 'uses_value' then (contains('<' || b || '>', a)::int + 1) / 2.0
  when 'implements_formula' then case when status = 'ok' and ran then coalesce(case when pt > 0 then pp::double / pt else up::double / nullif(ut, 0) end, 0) else 0 end
  when 'aggregates_result' then matches::int when 'equivalent_output' then same::int else 0 end), 6) as mean_score from e group by 1, 2""",
    "bundle_checks": f"{_PROB_K(16)} select {_sql_case('k', {n: f'{chr(39)}{v}{chr(39)}' for n, v in BUNDLE_FAULTS.items()}, chr(39) + 'valid' + chr(39))} as problem, count(*) as bundles from q group by 1",
    "bundle_sides": f"{_PROB_K(16)} select id as problem_id, 'r' || record_no as requirements, 4::int as tests, 'f1(3)' as target_call, 'f1' as executable, {len(F1)}::int as code_length from q where k = 0",
    "training_problems": f"{_PROB_K(5)} select 'train' as split, {_FIT_MASTER} as fault, count(*) as rows, sum(coalesce(len(domain), 0))::bigint as domains from q group by 2",
    "evaluation_candidates": f"{_PROB_K(5)} select id, source, 'locked_test_candidate' as split, 'locked_holdout' as evaluation_origin from q where {_FIT_MASTER} = 'fit'",
    "evaluation_input": f"""{_PROB_K(4)}, t as (select *, trim(coalesce(case when k <> 3 then text end, ' spare '), E' \\t\\n\\r') as said from q)
select 'validation' as split, case when k = 1 then 'no graph' when k = 0 then 'node order' when trim(said) = '' or trim(coalesce(gold_answer, ''), E' \\t\\n\\r') = '' then 'blank text or answer' else 'fit' end as fault, count(*) as rows,
  count(*) filter (said = 'spare') as spare from t group by 2""",
    "executable_records": f"{_PROB_K(5)} select case k when 0 then 'graph of another id' when 1 then 'no graph' when 2 then 'node order' when 4 then 'no id' else 'fit' end as fault, count(*) as rows from q group by 1",
    "source_ids": """with s as (select case record_no % 3 when 1 then coalesce(id, '') when 2 then coalesce(nullif(trim(id), ''), 'x') else coalesce(id, '') end as source_id from problems), c as (select trim(source_id) as source_id, count(*) as n from s group by 1)
select case when source_id = '' then 'blank' when n > 1 then 'repeated' else 'fit' end as fault, count(*) as ids, sum(n)::bigint as rows from c group by 1""",
    "locked_faults": """with i as (select ('0x' || substr(sha256(item_id), 1, 8))::bigint % 5 as k from eval_items)
select case k when 0 then 'not selected' when 1 then 'family changed' else 'fit' end as fault, count(*) as items from i group by 1""",
    "recovered_payloads": """with f as (select id, arg_min(status, result_no) as teacher_payload from eval_results where not coalesce(full_success, false) and trim(coalesce(id, '')) <> '' and status is not null group by id)
select f.id, teacher_payload from f where id in (select item_id from eval_items) and id not in (select id from eval_results where status = 'ok' and adapter = 'main_grpo' and id is not null)""",
    "code_records": f"""{_PROB_K(7)} select case when k = 0 then 'no implementations' when k = 1 then 'node order' when not regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]') then 'blank text' when k = 2 then 'blank span'
  when k = 3 then 'private keys' when gold_answer is null then 'no boxed answer' else 'fit' end as fault, count(*) as records, (3 * count(*))::bigint as messages, count(*) as self_contained from q group by 1""",
    "requests": f"with {base.PROB} select id, 'difficulty,max_nodes,problem,problem_id,retrieved_memory' as keys, difficulty, '5' as max_nodes from prob",
    "theorem_records": f"{_THEOREM} select 'mathlib4:' || name as memory_id, regexp_replace(name, '\\.[^.]*$', '') as namespace, 'rev' as source_revision, len(ps)::int as premises, ps[1] as first_premise from ok",
    "theorem_faults": f"{_THEOREM} select coalesce(fault, 'fit') as fault, count(*) as records from d group by 1",
    "enriched_theorems": f"""{_THEOREM}, m as (select *, doc_id % 2 = 0 as told, trim(coalesce(kind, '')) as title, trim(coalesce(lang, '')) as informal from ok)
select case when told and (title = '' or informal = '') then 'no title or statement' when told and trim(coalesce(source, '')) = '' then 'no domain' when told and trim(coalesce(course_id, '')) = '' then 'no keywords' else 'fit' end as fault, told,
  count(*) as records, sum(case when told then length(concat_ws(E'\\n', nullif(title, ''), nullif(informal, ''), 'Formal Lean statement: a statement')) else length('a statement') end)::bigint as text_length,
  sum(case when not told then 0 when course_id is null then null when trim(course_id) = '' then 0 else 1 end)::bigint as keywords from m group by 1, 2""",
    "trajectory_metrics": f"""with {base.RESULTS}, {base.TESTED}, r as (select id, f, x, coalesce(all_hidden_tests_pass, false)::int::double as h, coalesce(backward_target_correct, false)::int::double as b, coalesce(test_counts.unit_passed::double / nullif(test_counts.unit_total, 0), 0) as u,
    up, ut, greatest(coalesce(completion_token_count, 0), 0) as tokens, result_no % 3 as calls, result_no % 4 as k, coalesce(generation_seconds, 0) / 2 as run, coalesce(status = 'timeout', false)::int as late, generation_seconds as s from tested),
  p as (select id, max(f) as best, coalesce(sum(s), 0) as wall from r group by id)
select round(avg(f), 6) as rollout_accuracy, (select round(avg(best), 6) from p) as pass_at_k, (select round(avg(wall), 6) from p) as average_solving_time_seconds, round(avg(run), 6) as average_sandbox_time_seconds, round(avg(calls), 6) as average_tool_calls,
  round(avg(tokens), 6) as average_generated_tokens, round(avg(f) / (select avg(wall) from p), 6) as cost_normalized_accuracy, round(sum(u + h) / (2 * count(*)), 6) as node_verification_pass_rate, round(avg(b), 6) as edge_consistency_rate,
  round(count(*) filter (k = 1)::double / count(*) filter (k <> 0), 6) as repair_success_rate, round(avg(((u >= 1 and h >= 1 and b >= 1) <> (f >= 1))::int), 6) as verifier_disagreement_rate, round(avg((x = 1 and f < 1)::int), 6) as executable_but_wrong_rate,
  round(sum(f) / (sum(calls) + 1), 6) as tool_productivity, round(sum(up)::double / sum(ut), 6) as useful_tool_ratio, round(sum(1 - x) / sum(calls), 6) as invalid_tool_rate, round(avg(late), 6) as timeout_rate from r""",
    "teacher_run": f"""{RUN_SQL} select count(*) as problems, sum(n)::bigint as teacher_api_calls, round(sum(n)::double / count(*), 6) as teacher_calls_per_problem, count(*) filter (shared) as problems_with_shared_feedback,
  count(*) filter (last % 2 = 0) as problems_with_group_judgment, count(*) filter (not shared) as problems_without_feedback, round(avg(probe), 6) as probe_accuracy, (select round(avg(final_answer_correct), 6) from r) as rollout_accuracy,
  (select round(avg(backward_target_correct), 6) from r) as backward_accuracy, (select round(avg(s / 10), 6) from r) as mean_judge_score, round(avg(s / 100), 8) as mean_kl, round(max(s / 100), 8) as max_kl from p""",
    "repair_statuses": f"{RUN_SQL} select case k when 0 then 'succeeded' when 1 then 'shared_feedback' when 3 then 'failed' else 'unknown' end as status, count(*) as rollouts from r group by 1",
    "with_teacher_summary": f"""{RUN_SQL}, f as (select r.*, p.n, case when k = 0 then 0 else final_answer_correct end as fb, case when k = 0 then 0 else backward_target_correct end as bb, case when k = 0 then 0 else python_executable end as cb from r join p using (id) where place = 1)
select count(*) as problems, count(*) filter (n >= 3) as with_three_theories, count(*) filter (k = 0) as teacher_api_calls, count(*) filter (k in (0, 3)) as repaired, round(avg(fb), 6) as final_before_rate, round(avg(bb), 6) as backward_before_rate,
  round(avg(cb), 6) as clean_before_rate, round(avg(final_answer_correct), 6) as final_after_rate, round(avg(backward_target_correct), 6) as backward_after_rate, round(avg(python_executable), 6) as clean_after_rate,
  count(*) filter (python_executable = 1 and cb = 0) as improved, count(*) filter (python_executable = 0 and cb = 1) as regressed, count(*) filter (python_executable = cb) as unchanged from f""",
    "sampled_summary": f"""{RUN_SQL}, v as (select *, final_answer_correct = 1 and backward_target_correct = 1 and tags_exact = 1 and signature_exact = 1 and python_executable = 1 and unit = 1 and prop = 1 as strict from r),
  k as (select id, bool_or(final_answer_correct = 1) as f, bool_or(strict) as s, bool_or(python_executable = 1) as e, bool_or(backward_target_correct = 1) as b from v group by id)
select (select count(*) from v) as rollouts, (select round(avg(final_answer_correct), 6) from v) as sampled_rollout_accuracy, round(avg(f::int), 6) as final_pass_at_k, round(avg(s::int), 6) as strict_pass_at_k, round(avg(e::int), 6) as executable_pass_at_k,
  round(avg(b::int), 6) as backward_pass_at_k, (select round(avg(unit), 6) from v) as mean_unit_score, (select round(avg(prop), 6) from v) as mean_property_score, (select round(avg(tokens), 6) from v) as mean_completion_tokens from k""",
    "sampled_changes": f"""{RUN_SQL}, k as (select id, bool_or(final_answer_correct = 1) as f, bool_or(backward_target_correct = 1) as b from r group by id)
select 'final' as metric, id, if(b, 'improved', 'regressed') as change from k where f <> b union all select 'backward', id, if(f, 'improved', 'regressed') from k where f <> b""",
    "positional_tests": f"""with {base.RESULTS}, {base.TESTED}, e as (select adapter, result_no, ut, ut + pt as n, unnest(range(1, (ut + pt + 1)::bigint)) as i, up, pp from tested),
  t as (select adapter, i <= ut as unit, case when i <= ut then i <= up else i - ut <= pp end as base, result_no % 11 = 0 or (result_no % 5 = 0 and i = 1) or (result_no % 3 = 0 and i = n and result_no % 7 <> 0) as lost,
    result_no % 3 = 0 and result_no % 7 = 0 and i = n and result_no % 11 <> 0 as extra from e),
  a as (select adapter, count(*) filter (unit and (base and not lost and not extra or extra)) as unit_passed, count(*) filter (unit) as unit_total, count(*) filter (not unit and (base and not lost and not extra or extra)) as property_passed, count(*) filter (not unit) as property_total from t group by adapter)
select adapter, coalesce(unit_passed, 0) as unit_passed, coalesce(unit_total, 0) as unit_total, coalesce(property_passed, 0) as property_passed, coalesce(property_total, 0) as property_total from (select distinct adapter from tested) left join a using (adapter)""",
    "unknown_results": """select distinct if(result_no % 40 = 0, id || '?', id) as id from eval_results where id is not null
  and if(result_no % 40 = 0, id || '?', id) not in (select id from problems where id is not null union select item_id from eval_items)""",
    "label_pairs": """with l as (select adapter, row_number() over (order by min(result_no)) as n from eval_results where adapter is not null group by adapter),
  p as (select 0 as o, 0 as i, n as j, 'stage2' as a, adapter as b from l where adapter <> 'stage2' union all select 1, x.n, y.n, x.adapter, y.adapter from l x join l y on x.n < y.n where x.adapter <> 'stage2' and y.adapter <> 'stage2')
select (row_number() over (order by o, i, j) - 1)::int as position, a as left_label, b as right_label from p""",
}
_SPANS = f"""with {base.ROLL}, n as (select rollout_id, raw_text, unnest(list_concat(list_distinct(regexp_extract_all(raw_text, '<a_(f[0-9]+)>', 1)), ['main'])) as node_id from roll where raw_text is not null),
  t as (select *, if(node_id = 'main', 'main', 'a_' || node_id) as tag from n), o as (select *, strpos(raw_text, '<' || tag || '>') as opens from t),
  c as (select *, if(opens > 0, strpos(substr(raw_text, opens + length(tag) + 2), '</' || tag || '>'), 0) as ends from o),
  s as (select rollout_id, node_id, if(ends > 0, opens + length(tag) + 1, -1)::int as start_char, if(ends > 0, opens + length(tag) + ends, -1)::int as end_char, if(ends > 0, substr(raw_text, opens + length(tag) + 2, ends - 1), '') as inside from c)"""
SQL["tagged_spans"] = f"{_SPANS} select rollout_id, node_id, start_char, end_char, ((length(inside) - length(replace(inside, '```', ''))) // 3 // 2)::int as blocks from s"
SQL["signature_checks"] = f"""{_SPANS}, b as (select *, (length(inside) - length(replace(inside, '```', ''))) // 3 // 2 as blocks from s where start_char >= 0 and node_id <> 'main')
select rollout_id, node_id, blocks = 1 and len(regexp_extract_all(split_part(inside, '```', 2), '(?m)^def ' || node_id || '\\(')) = 1 and regexp_matches(split_part(inside, '```', 2), '(?m)^def ' || node_id || '\\(n\\):') as signature_ok from b"""
SQL["answer_numbers"] = f"""with {base.ROLL}, {base.PROB}, g as (select id, min(gold_answer) as gold from (select id, gold_answer from prob union all select item_id, gold_answer from eval_items) group by id),
  s as (select problem_id as id, coalesce(regexp_extract_all(raw_text, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)[-1], nullif(regexp_extract(raw_text, '(?i)final answer is (-?[\\d,./]*\\d)', 1), '')) as said from roll),
  b as (select said, gold, regexp_matches(said, '^-?[0-9]{{1,12}}(\\.[0-9]+)?$') and regexp_matches(gold, '^-?[0-9]{{1,12}}(\\.[0-9]+)?$') as plain from s left join g using (id)),
  m as (select case when said is null or gold is null then 'missing' when plain and said = gold then 'canonical_text' when plain then 'numeric' else 'other' end as method, said, gold from b)
select method, case method when 'missing' then false when 'canonical_text' then true when 'numeric' then said::double = gold::double end as equivalent, count(*) as n from m group by 1, 2"""

ALL = (
    dag_check, ancestors, api_match, edge_scores, bundle_checks, bundle_sides, training_problems, evaluation_candidates, evaluation_input, executable_records, source_ids, locked_faults, recovered_payloads,
    code_records, requests, theorem_records, theorem_faults, enriched_theorems, trajectory_metrics, teacher_run, repair_statuses, with_teacher_summary, sampled_summary, sampled_changes, positional_tests, unknown_results, label_pairs,
    tagged_spans, signature_checks, answer_numbers,
)
