"""Verifier bundles, executable records, prompts, theorem records, run summaries."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import bundles, metrics, prompts, verification, views

NODES = [("f1", "n", "q", "f1(x)", "python_function", {"must_state": [" a ", ""], "requirements": ["r"]}), ("main", "m", "q", "main()", "final_answer", {})]
LINKS = [("f1", "main", "uses_value")]
CODE, MUTANT = "def f1(x):\n    return x * 2", "def f1(x):\n    return x"
TESTS = [
    ("unit", "f1(1)", "2", None),
    ("unit", "f1(2)", "4", " book "),
    ("unit", "f1(3)", "6", None),
    ("property", "all(f1(i) == 2 * i for i in range(9))", "True", "invariant"),
]
SCHEMA = f"problem_id string, nodes {bundles.NODES}, edges {bundles.EDGES}, annotations {bundles.ANNOTATIONS}, eligible boolean, confidence double"


def annotation(node="f1", kind="python_function", tests=TESTS, code=CODE, mutant=MUTANT, formula=None, values=None, target=None, runtime=0.5):
    return (node, kind, ["unit", " "], tests, code, mutant, "oracle", formula, values, target, runtime)


MAIN = annotation("main", "final_answer", None, None, None, target=" f1(3) ", runtime=None)


def bundle(own=None, main=MAIN, nodes=NODES, links=LINKS, eligible=True, confidence=0.9, more=()):
    return ("p", nodes, links, [own or annotation(), main, *more], eligible, confidence)


BROKEN = [
    (bundle(), None), (bundle(eligible=False), "not eligible"), (bundle(eligible=None), "not eligible"), (bundle(links=[]), "graph: disconnected"), (
        bundle(links=LINKS + [("main", "f1", "x")]),
        "graph: main is no sink",
    ),
    (
        bundle(more=[annotation()]),
        "blank or repeated node id",
    ), (bundle(more=[annotation("f9")]), "node ids differ"), (bundle(annotation("g")), "node ids differ"), (bundle(annotation(kind="poem")), "output type"),
    (bundle(annotation(kind="final_answer")), "main and final_answer"), (
        bundle(main=annotation("main", "values", values={"a": "1"})),
        "main and final_answer",
    ), (bundle(annotation(tests=TESTS[:3])), "tests"),
    (bundle(annotation(tests=TESTS[:3] + [("unit", "f1(4)", "8", None)])), "tests"), (
        bundle(annotation(tests=TESTS[:3] + [("other", "f1(4)", "8", None)])),
        "tests",
    ), (
        bundle(annotation(tests=TESTS[:3] + [("property", "f1(4)", None, None)])),
        "tests",
    ),
    (bundle(annotation(runtime=2.5)), "runtime"), (bundle(annotation(runtime=0.0)), "runtime"), (
        bundle(annotation(code="import os\ndef f1(x): return x")),
        "code: reference: import",
    ), (bundle(annotation(mutant="def f2(x): return x")), "code: mutant: f1 is not defined"),
    (
        bundle(annotation(tests=TESTS[:3] + [("property", "helper(1)", "True", None)])),
        "code: reference: helper is not defined",
    ), (bundle(annotation(tests=[("unit", "open(1)", "1", None)] + TESTS[1:])), "code: test: name"),
    (bundle(annotation(kind="formula", formula=" ")), "formula"), (bundle(annotation(kind="values", values={})), "values"), (
        bundle(annotation(kind="formula", formula="x")),
        "no executable node",
    ),
    (
        bundle(main=annotation("main", "final_answer", None, None, None, target="f1(7)")),
        "target call",
    ), (
        bundle(main=annotation("main", "final_answer", None, None, None)),
        "target call",
    ), (bundle(confidence=1.5), "confidence"), (bundle(confidence=None), "confidence"),
]


def test_every_rule_of_a_bundle(spark):
    rows = spark.createDataFrame([(str(i), *b[1:], "clash") for i, (b, _) in enumerate(BROKEN)], SCHEMA + ", _spare string")
    got = {r.problem_id: r.problem for r in bundles.bundle_problem(rows).collect()}
    assert [got[str(i)] for i in range(len(BROKEN))] == [p for _, p in BROKEN]
    assert bundles.bundle_problem(rows.where("false")).count() == 0


def test_public_and_hidden_side(spark):
    rows = bundles.bundle_problem(spark.createDataFrame([bundle(), bundle(eligible=False)], SCHEMA))
    (made,) = bundles.compile_bundles(rows).collect()
    public, hidden = made.public_nodes[0].asDict(), made.hidden_nodes[0].asDict(True)
    assert (public["check_types"], public["semantic_requirements"]) == (["unit"], ["r", "a"]) and "tests" not in public and "target_call" not in public
    assert len(hidden["tests"]) == 4 and hidden["tests"][1]["source"] == "book" and made.hidden_nodes[1].target_call == "f1(3)" and made.hidden_nodes[1].tests is None
    assert made.executable_ids == ["f1"] and made.implementations[0].mutant_code == MUTANT
    text = made.public_nodes[0].asDict(True)
    assert not {"tests", "reference_code", "mutant_code", "target_call", "formula", "values"} & set(text)


def test_semantic_requirements_are_ordered_and_bounded(spark):
    spec = {"check_method": ["last"], "requirements": [str(i) for i in range(11)], "method": ["m"], "other": ["never"]}
    rows = spark.createDataFrame([(spec,), (None,)], f"s {bundles.SPEC}")
    got = [r[0] for r in rows.select(bundles.semantic_requirements(F.col("s"))).collect()]
    assert got == [[*(str(i) for i in range(11)), "m"], []]


def test_same_api(spark):
    n, e = bundles.NODES, bundles.EDGES
    other = [(*NODES[0][:3], "f1(y)", *NODES[0][4:]), NODES[1]]
    rows = spark.createDataFrame(
        [
            (NODES, NODES, LINKS, LINKS),
            (NODES, other, LINKS, LINKS),
            (NODES, NODES[::-1], LINKS, LINKS),
            (NODES, NODES, LINKS, None),
            (NODES, NODES, None, None),
        ],
        f"a {n}, b {n}, c {e}, d {e}",
    )
    assert [r[0] for r in rows.select(bundles.same_api(*map(F.col, "abcd"))).collect()] == [True, False, False, False, True]


def test_executable_records(spark):
    n, e = bundles.NODES, bundles.EDGES
    three = [*NODES[:1], ("f2", "n", "q", "f2(x)", "formula", {}), NODES[1]]
    links = [*LINKS, ("f2", "main", "uses_value")]
    rows = spark.createDataFrame(
        [
            ("p", "p", NODES, NODES, LINKS),
            (" ", "p", NODES, NODES, LINKS),
            ("p", "p", None, NODES, LINKS),
            ("p", "q", NODES, NODES, LINKS),
            ("p", "p", NODES[:1], NODES, []),
            ("p", "p", three, [three[1], three[0], three[2]], links),
        ],
        f"i string, g string, a {n}, b {n}, e {e}",
    )
    got = [r[0] for r in rows.select(bundles.record_problem(*map(F.col, "igabe"))).collect()]
    assert got == [None, "no id", "no graph", "graph of another id", "public: no main", "node order"]


MASTER = f"id string, problem string, gold_answer string, domain array<string>, difficulty double, source string, graph_id string, nodes {bundles.NODES}, edges {bundles.EDGES}"


def test_projections_of_masters(spark):
    rows = spark.createDataFrame(
        [
            ("b", " What? ", " 4 ", None, 2.0, "s", "b", NODES, LINKS),
            ("a", "x", "1", ["d"], None, None, "z", NODES, LINKS),
            ("c", " ", "1", None, None, None, "c", NODES, LINKS),
            ("d", "x", "1", None, None, None, "d", NODES, None),
            ("e", "x", "1", None, None, None, "e", None, None),
        ],
        MASTER,
    )
    train = {r.id: r for r in bundles.training_problems(rows).collect()}
    assert {i: r.fault for i, r in train.items()} == {
        "b": None,
        "a": "graph of another id",
        "c": "blank problem or answer",
        "d": "graph: disconnected",
        "e": "no graph",
    }
    assert (train["b"].text, train["b"].gold_answer, train["b"].split, train["b"].domain) == ("What?", "4", "train", [])
    held = bundles.evaluation_candidates(rows).collect()
    assert [r.id for r in held] == ["a", "b", "c", "d", "e"] and held[1].split == "locked_test_candidate" and held[1].evaluation_origin == "locked_holdout"
    assert {r.split for r in bundles.with_split(rows, "validation").collect()} == {"validation"}


def test_locked_rows(spark):
    family = lambda df: F.when(df["id"].startswith("medium_"), "medium").otherwise("omni")
    selected, accepted = spark.createDataFrame([("medium_1",), ("omni_2",)], "id string"), spark.createDataFrame(
        [("medium_1",), ("omni_2",), ("omni_9",)],
        "id string",
    )
    assert {
        r.id: r.fault for r in bundles.accepted_faults(accepted, selected, family).collect()
    } == {"medium_1": None, "omni_2": None, "omni_9": "not selected"}
    moved = lambda df: F.lit("medium") if df is accepted else F.lit("omni")
    assert {
        r.fault for r in bundles.accepted_faults(
            accepted.where("id <> 'omni_9'"),
            selected,
            lambda df: F.lit("omni") if df is selected else F.lit("medium"),
        ).collect()
    } == {"family changed"} and moved
    failures = spark.createDataFrame(
        [("a", 2, "late"), ("a", 1, "early"), ("b", 1, None), ("c", 1, "done"), ("z", 1, "unknown"), (None, 1, "x")],
        "id string, position int, teacher_payload string",
    )
    known, done = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("c",)], "id string")
    assert [tuple(r) for r in bundles.recovered_payloads(known, failures, done).collect()] == [("a", "early")]


def test_evaluation_input(spark):
    rows = spark.createDataFrame(
        [
            ("a", None, " x ", "1", NODES, NODES),
            ("b", "t", None, " ", NODES, NODES),
            ("c", "t", None, "1", NODES, NODES[::-1]),
            ("d", "t", None, "1", NODES, None),
        ],
        f"id string, text string, problem string, gold_answer string, public_nodes {bundles.NODES}, hidden_nodes {bundles.NODES}",
    )
    got = {r.id: (r.text, r.split, r.fault) for r in bundles.evaluation_input(rows).collect()}
    assert got == {
        "a": ("x", "validation", None),
        "b": ("t", "validation", "blank text or answer"),
        "c": ("t", "validation", "node order"),
        "d": ("t", "validation", "no graph"),
    }


CODE_ROW = f"id string, text string, nodes {bundles.NODES}, edges {bundles.EDGES}, hidden_ids array<string>, implementations map<string,string>, prose map<string,string>"
PROSE = {"main": "So it is \\boxed{6}."}
CASES = [
    (
        ("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": CODE + "\n"}, PROSE),
        None,
    ), (("p", "What?", NODES, LINKS, ["f1", "main"], {}, PROSE), "no implementations"), (
        ("p", "What?", NODES, LINKS, ["main", "f1"], {"f1": CODE}, PROSE),
        "node order",
    ),
    (("p", " ", NODES, LINKS, ["f1", "main"], {"f1": CODE}, PROSE), "blank text"), (
        ("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": CODE}, {}),
        "blank span",
    ), (
        ("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": " "}, PROSE),
        "blank span",
    ),
    (("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": "x = '</a_f1>'"}, PROSE), "tags"), (
        ("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": "a = '''```'''"}, PROSE),
        "code block",
    ),
    (
        ("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": CODE}, {"main": "the TARGET_CALL is \\boxed{6}"}),
        "private names",
    ), (("p", "What?", NODES, LINKS, ["f1", "main"], {"f1": CODE}, {"main": "It is 6."}), "no boxed answer"),
    (("p", "What?", [(*NODES[0][:5], {"expected": ["6"]}), NODES[1]], LINKS, ["f1", "main"], {"f1": CODE}, PROSE), "private keys"),
]


def test_code_records(spark):
    rows = spark.createDataFrame([(str(i), *c[1:]) for i, (c, _) in enumerate(CASES)], CODE_ROW)
    got = {r.id: r for r in prompts.code_records(rows).collect()}
    assert [got[f"{i}:code_solve"].fault for i in range(len(CASES))] == [f for _, f in CASES]
    good = got["0:code_solve"]
    assert [m.role for m in good.messages] == ["system", "user", "assistant"] and good.executable_node_ids == ["f1"]
    assert good.messages[2].content == f"<a_f1>\n```python\n{CODE}\n```\n</a_f1>\n<a_main>\nSo it is \\boxed{{6}}.\n</a_main>"
    asked = json.loads(good.messages[1].content)
    assert [s["tag"] for s in asked["required_output_spans"]] == ["a_f1", "a_main"] and asked["function_graph"]["edges"][0]["target"] == "main"
    contained = prompts.code_records(rows).select(bundles.self_contained(F.col("messages"))).first()[0]
    assert contained and prompts.code_records(rows).where("fault is null").count() == 1
    assert not rows.select(bundles.self_contained(F.array(F.struct(F.lit("x").alias("content"))))).first()[0]


def test_requests(spark):
    rows = spark.createDataFrame([("p", "t", "ref", None)], "id string, problem string, solution string, feedback string")
    memory, nodes = F.array(F.lit("m")), F.array().cast(bundles.NODES)
    plain = prompts.policy_request("S", F.col("problem"), F.col("id"), nodes, F.array().cast(bundles.EDGES), memory, F.col("feedback"))
    again = prompts.policy_request("S", F.col("problem"), F.col("id"), nodes, F.array().cast(bundles.EDGES), memory, F.lit("wrong"))
    r = rows.select(
        plain.alias("a"),
        again.alias("b"),
        prompts.teacher_request("T", {"problem_id": F.col("id"), "difficulty": F.col("feedback")}, memory, 5).alias("c"),
        prompts.bundle_request("B", F.struct("id"), F.col("solution"), F.col("feedback")).alias("d"),
    ).first()
    assert "repair_feedback" not in r.a[1].content and json.loads(r.b[1].content)["repair_feedback"] == "wrong" and r.b[0].content.startswith("S This is another try")
    assert json.loads(r.c[1].content) == {"problem_id": "p", "difficulty": None, "retrieved_memory": ["m"], "max_nodes": 5}
    assert json.loads(r.d[1].content) == {"candidate": {"id": "p"}, "reference_solution": "ref", "tagged_solution": None}
    item = spark.createDataFrame(
        [(("i", "t", "x", "y", ["p"], "secret"),)],
        "i struct<memory_id:string,title:string,informal_statement:string,formal_statement:string,preconditions:array<string>,embedding:string>",
    )
    assert "embedding" not in item.select(prompts.compact_memory(F.col("i")).alias("c")).first().c.asDict()
    ids = spark.createDataFrame([("a:graph", None), ("x", "a"), ("b", " "), (" ", None)], "id string, source_problem_id string")
    assert {r.source_id: r.fault for r in prompts.source_ids(ids).collect()} == {"a": "repeated", "b": None, "": "blank"}


TRACE = "full_name string, file_path string, theorem_statement string, docstring string, commit string, url string, premise_ids array<string>, premises array<array<string>>"


def test_theorems(spark):
    rows = spark.createDataFrame([
        ("Nat.add.comm", "M/N.lean", " theorem x ", None, " abc ", None, ["Nat.z"], [["Nat.b", "Nat.add.comm"], None, [" Nat.a ", "", None]]),
        (
            " ",
            "a.lean",
            "s",
            None,
            None,
            None,
            None,
            None,
        ), ("x", "a.txt", "s", None, None, None, None, None), ("x", "a.lean", " ", None, None, None, None, None),
    ], TRACE)
    made = prompts.theorem_records(rows)
    got = made.collect()
    assert [r.fault for r in got] == [None, "no name", "no source file", "no statement"]
    r = got[0]
    assert (r.memory_id, r.namespace, r.premise_ids, r.source_revision, r.text) == (
        "mathlib4:Nat.add.comm",
        "Nat.add",
        ["Nat.a", "Nat.b", "Nat.z"],
        "abc",
        "theorem x",
    ) and got[2].namespace == ""
    told = "memory_id string, title string, informal_statement string, domain_path array<string>, keywords array<string>, preconditions array<string>"
    one = made.where("fault is null")
    for row, fault, text in (
        (("T", "I", ["a"], [" k "], None), None, "T\nI\nFormal Lean statement: theorem x"),
        ((" ", "I", ["a"], ["k"], None), "no title or statement", None),
        (("T", "I", [" "], ["k"], None), "no domain", None),
        (("T", "I", ["a"], None, None), "no keywords", None),
    ):
        m = prompts.merge_enrichment(one, spark.createDataFrame([(r.memory_id, *row)], told)).first()
        assert m.fault == fault and (text is None or (m.text, m.keywords, m.preconditions) == (text, ["k"], []))
    assert prompts.merge_enrichment(one, spark.createDataFrame([], told)).first().text == "theorem x"


RUN = """problem struct<id:string>, teacher_calls_used int, teacher_probe struct<verification:struct<final_answer_score:double>>, teacher_group_judgment struct<rollout_judgments:array<int>>, grpo_update struct<approx_kl:double>,
 memory_context struct<theorem_items:array<struct<id:string,source:string,text:string,keywords:array<string>>>>,
 rollout_records array<struct<rollout:struct<completion_token_ids:array<int>>,verification:struct<final_answer_score:double,backward_score:double,failures:array<string>>,
 reward:struct<teacher_reward:double,format_gate:double,signature_reward:double,execution_reward:double,unit_test_reward:double,property_test_reward:double,backward_reward:double,final_reward:double>,
 repair:struct<status:string,attempts:array<string>,verification_before_repair:struct<final_answer_score:double,backward_score:double,failures:array<string>>>>>"""
FULL = (0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
ITEMS = [(f"t{i}", "s", " a  b ", ["k"]) for i in range(4)]


def trajectories(spark):
    return spark.createDataFrame([
        (
            ("p",),
            2,
            ((1.0,),),
            ([1],),
            (0.25,),
            (ITEMS,),
            [
                (([1, 2],), (1.0, 1.0, []), FULL, ("succeeded", ["a"], (0.0, 0.0, ["x"]))),
                (([1],), (0.0, None, ["y"]), (None, 1.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0), ("shared_feedback", None, None)),
            ],
        ),
        (("q",), None, None, None, None, (ITEMS[:1],), [((None,), (1.0, 0.0, []), FULL, None)]), (("r",), 1, None, (None,), (0.75,), None, []),
    ], RUN)


def test_run_summaries(spark):
    t = trajectories(spark)
    r = metrics.teacher_run(t).first()
    assert (
        r.problems,
        r.teacher_api_calls,
        r.teacher_calls_per_problem,
        r.problems_with_shared_feedback,
        r.problems_with_group_judgment,
        r.problems_without_feedback,
    ) == (3, 3, 1.0, 1, 1, 2)
    assert (r.probe_accuracy, r.rollout_accuracy, r.backward_accuracy, r.mean_judge_score, r.mean_kl, r.max_kl) == (1.0, 0.666667, 0.333333, 0.5, 0.5, 0.75)
    assert {x.status: x.rollouts for x in metrics.repair_statuses(t).collect()} == {"succeeded": 1, "shared_feedback": 1, "unknown": 1}
    s = metrics.with_teacher_summary(t).first()
    assert (s.problems, s.with_three_theories, s.teacher_api_calls, s.repaired, s.improved, s.regressed, s.unchanged) == (2, 1, 1, 1, 1, 0, 1)
    assert (s.final_before_rate, s.final_after_rate, s.clean_before_rate) == (0.5, 1.0, 0.5)
    preview = t.select(metrics.memory_preview(F.col("memory_context.theorem_items")).alias("m")).collect()
    assert [i["rank"] for i in preview[0].m] == [1, 2, 3] and preview[0].m[0].text_preview == "a b"
    empty = metrics.teacher_run(t.where("false")).first()
    assert (empty.problems, empty.rollout_accuracy) == (0, 0.0)


def test_sampled_runs(spark):
    views = metrics.rollout_views(trajectories(spark))
    r = metrics.sampled_summary(views).first()
    assert (
        r.rollouts,
        r.final_pass_at_k,
        r.strict_pass_at_k,
        r.mean_completion_tokens,
    ) == (3, 1.0, 1.0, 1.0) and r.sampled_rollout_accuracy == pytest.approx(2 / 3)
    worse = views.withColumn("final", F.lit(False)).withColumn("backward", F.col("id") == "q")
    got = {(x.metric, x.id, x.change) for x in metrics.sampled_changes(views, worse).collect()}
    assert got == {("final", "p", "regressed"), ("final", "q", "regressed"), ("backward", "p", "regressed")}


def test_small_predicates(spark):
    rows = spark.createDataFrame(
        [([("f1", "x"), ("main", "7")], ("python_function", None), 1.0), ([], ("formula", [1]), None), (None, ("formula", []), 0.5)],
        "s array<struct<node_id:string,extracted_answer:string>>, n struct<expected_output_type:string,tests:array<int>>, v double",
    )
    got = [
        tuple(r) for r in rows.select(metrics.main_answer(F.col("s")), metrics.expects_execution(F.col("n")), metrics.verification_pass(F.col("v"))).collect()
    ]
    assert got == [("7", True, True), (None, True, False), (None, False, False)]


def test_scores_and_failures_of_a_response(spark):
    rows = spark.createDataFrame(
        [
            (1, "7", "7.0", "f(1)", {"f(1)": "14/2"}),
            (2, "7", "8", "f(1)", {"f(2)": "7"}),
            (3, None, "7", "f(1)", {"f(1)": "7"}),
            (4, "7", None, " ", None),
            (5, "\\sqrt{8}", "2\\sqrt{2}", "", {}),
        ],
        "i int, predicted string, gold string, target_call string, outputs map<string,string>",
    )
    got = {r.i: (r.final_score, r.backward_score) for r in verification.scored_answers(rows).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (1.0, None)}
    n, e = "array<struct<id:string,executable:boolean,passed:boolean>>", "array<struct<source:string,target:string,relation_type:string,severity:string,score:double>>"
    rows = spark.createDataFrame([
        (
            [("f1", True, False), ("f2", None, None), ("main", True, True)],
            [
                ("f1", "main", "uses_value", "critical", 0.5),
                ("f2", "main", "uses_value", "hard", 0.0),
                ("f1", "f2", "x", "critical", None),
                ("a", "b", "x", "critical", 1.0),
            ],
            0.0,
            0.0,
        ),
        (None, None, 1.0, None), ([], [], None, 1.0),
    ], f"n {n}, e {e}, f double, b double")
    got = [[(f.type, f.node or f.edge) for f in r[0]] for r in rows.select(verification.failure_records(*map(F.col, "nefb"), F.lit("m"))).collect()]
    assert got == [
        [
            ("execution_failure", "f2"),
            ("test_failure", "f1"),
            ("dependency_failure", "f1->main"),
            ("dependency_failure", "f1->f2"),
            ("final_answer_failure", None),
            ("backward_constraint_failure", None),
        ],
        [],
        [("final_answer_failure", None)],
    ]


def test_locked_sets(spark):
    rows, other = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("b",), (None,)], "id string")
    digest = "4e07b0a54fb4ad6a2f1a2cf6b3b1e3b8"
    from millrace.operators import records

    right = records.ids_digest(rows, "id", True).first().ids_sha256
    check = lambda *given: verification.locked_fault(rows, "id", *given)
    assert check(
        True,
        2,
        right,
        {"x": other.where("false")},
    ) is None and check(False, 2, right, {}) == "not locked" and check(True, 3, right, {}) == "2 rows instead of 3"
    assert check(True, 2, digest, {}) == "other ids" and check(True, 2, right, {"training": other}) == "1 ids of training"
    summary = verification.row_summary(rows, kind=F.when(F.col("id") == "a", "x"), id=F.col("id")).first()
    assert (summary.rows, summary.kind_counts, summary.id_counts) == (2, {"x": 1, "null": 1}, {"a": 1, "b": 1})
    assert verification.row_summary(rows.where("false"), id=F.col("id")).first().rows == 0


def test_views_hide_what_is_private(spark):
    s = "x struct<executable:boolean,timeout:boolean,runtime_seconds:double,stdout:string,stderr:string,node_results:map<string,struct<executable:boolean,timeout:boolean,runtime_seconds:double,stdout:string,stderr:string,test_results:array<struct<kind:string,passed:boolean,expected:string>>>>>"
    node = (True, None, 0.5, "o" * 3000, "trace\n <hidden-test 3> \n\n", [(None, True, "1"), ("unit", False, "2"), ("property", None, "3")])
    rows = spark.createDataFrame(
        [((True, False, 1.0, "s" * 5000, None, {"f1": node, "main": (None, None, None, None, None, None)}),), ((None, None, None, None, None, None),)],
        s,
    )
    shown = [r[0] for r in rows.select(views.public_execution(F.col("x"))).collect()]
    f1 = shown[0].node_results["f1"]
    assert (f1.error_summary, {k: tuple(v) for k, v in f1.test_summary.items()}) == (
        "hidden test execution failed",
        {"unit": (1, 2), "property": (0, 1)},
    ) and "expected" not in str(shown)
    assert (shown[0].node_results["main"].error_summary, shown[0].node_results["main"].test_summary, shown[1].node_results) == ("", {}, None)
    private = rows.select(views.private_execution(F.col("x"))).first()[0]
    assert (len(private.stdout), len(private.node_results["f1"].stdout), private.stderr) == (4000, 2000, "")
    v = spark.createDataFrame(
        [((1.0, [("final_answer_failure", "42")]),)],
        "v struct<final_answer_score:double,failures:array<struct<type:string,gold:string>>>",
    )
    assert v.select(views.public_verification(F.col("v"), ["type", "gold"])).first()[0].failures[0].asDict() == {"type": "final_answer_failure"}
    m = spark.createDataFrame(
        [([("i", "s", "t" * 3000, ["k"] * 30, "secret")] * 5,), (None,)],
        "m array<struct<id:string,source:string,text:string,keywords:array<string>,embedding:string>>",
    )
    first, none = (r[0] for r in m.select(views.bounded_memory(F.col("m"))).collect())
    assert (len(first), len(first[0].text), len(first[0].keywords), none) == (3, 2400, 24, []) and "secret" not in str(first)
