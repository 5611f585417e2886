"""Spans, tags, code checks, graphs, retrieval, canonical records, rewards, metrics."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import canonical, graph, metrics, records, retrieval, scoring, spans

RAW = "<a_f1>\nlet n = 4, dp[2] = 3\nrecurrence: f(n) = f(n-1)\n```python\ndef f1(n: int = 2):\n    return n\n```\n</a_f1>\n<a_main>\\boxed{\\frac{1}{2}} so \\boxed{6}</a_main>"


def test_spans():
    one, main = spans.parse_spans(RAW, ["f1", "main"])
    assert RAW[one["start_char"] : one["end_char"]].strip() == one["raw_text"]
    assert one["extracted_values"] == {"dp[2]": "3", "n": "4", "int": "2"} and one["extracted_formula"] == "f(n) = f(n-1)"
    assert one["code_blocks"] == ["def f1(n: int = 2):\n    return n"]
    assert main["extracted_answer"] == "6"
    assert spans.parse_spans("<main>the final answer is -7</main>", ["main"])[0]["extracted_answer"] == "-7"
    assert spans.parse_spans(None, ["main"])[0]["start_char"] == -1
    assert spans.parse_spans("é<a_2>x</a_2>", ["f1", "f2"])[1]["start_char"] == 6


def test_tag_columns(spark):
    rows = spark.createDataFrame(
        [(1, RAW), (2, "x" + RAW), (3, "<a_main>1</a_main><a_f1>2</a_f1>"), (4, None), (5, "<a_f1>a</a_f1> \n<a_main></a_main>")], "i int, raw string"
    ).withColumn("nodes", F.array(F.lit("f1"), F.lit("main")))
    got = {
        r.i: (r.e, r.o, r.t) for r in rows.select(
            "i",
            spans.exact_tags(F.col("raw"), F.col("nodes")).alias("e"),
            spans.tag_set_once(F.col("raw"), F.col("nodes")).alias("o"),
            spans.first_tag(F.col("raw"), F.lit("a_f1")).alias("t"),
        ).collect()
    }
    assert [got[i][0] for i in range(1, 6)] == [True, False, False, False, True]
    assert [got[i][1] for i in range(1, 6)] == [True, True, True, False, True]
    assert got[3][2] == "2" and got[4][2] is None and got[5][2] == "a"
    nested = rows.select(spans.tagged_spans("raw", "nodes").alias("s")).select(F.inline("s")).where("node_id = 'f1'").collect()
    assert len(nested) == 5


def test_one_scan_of_tags():
    text = "<a_f1>x = 3, dp[0]=1, dp[0] = 2, x = 9, y == 4\nRecurrence: f(n) = 2\n```Python\ncode\n``` ```open</a_f1><main>The final answer is x; the final answer is -12th</main><a_f2>never closed"
    f1, main, f2 = spans.parse_spans(text, ["f1", "main", "f2"])
    assert (
        f1["extracted_values"],
        f1["extracted_formula"],
        f1["code_blocks"],
        f1["extracted_answer"],
    ) == ({"dp[0]": "2", "x": "3"}, "f(n) = 2", ["code"], None)
    assert (main["extracted_answer"], f2["start_char"], f2["raw_text"]) == ("-12", -1, "")
    assert text[f1["start_char"] : f1["end_char"]].startswith("x = 3")


def test_signatures_and_safety():
    assert spans.signature_matches("f(a, *, b)", ["def f(a: int, *, b=2):\n    pass"])
    assert not spans.signature_matches("f(a, b)", ["def f(a, *, b):\n    pass"])
    assert not spans.signature_matches("f(a)", ["def f(a): pass", "def f(a): pass"])
    assert not spans.signature_matches("f(a", ["def f(a): pass"])
    assert spans.code_problem("import math\nprint(math.pi)") is None
    bad = {"import os": "import", "eval('1')": "name", "().__class__": "dunder", "x = '__y'": "dunder", "def": "syntax", "": "empty", "#" * 20_001: "too long"}
    assert {k: spans.code_problem(k) for k in bad} == bad
    assert spans.code_problem("f(2)", expression=True) is None and spans.code_problem("x = 1", expression=True) == "syntax"
    contract = spans.contract_problem
    assert contract("def f(x): return x", "f(x)", ["f(1) == 1", "len([f(2)])"]) is None
    assert contract("def g(x): return x", "f(x)", []) == "f is not defined" and contract("def f(x): return x", "f(x)", ["h(1)"]) == "h is not defined"
    assert contract(
        "import math\nfrom fractions import Fraction as Q\ndef f(x): return x",
        "f(x)",
        ["Q(1, 2)"],
    ) is None and contract("def", "f(x)", []) == "syntax"
    assert spans.outputs_of("M::0::[1, 2]\nM::0::3\nnoise\nM::1::oops(", "M") == {"0": "3", "1": "oops("}


def test_json_and_tokens(spark):
    rows = spark.createDataFrame(
        [('{"a": [{"secret": 1}], "b": "secret"}', [5, 1, 2, 3], [1, 2]), ("no json", None, [1]), (None, [1], [])],
        "d string, t array<int>, w array<int>",
    )
    got = rows.select(spans.forbidden_keys("d", F.array(F.lit("secret"), F.lit("b"))).alias("k"), spans.token_range("t", "w").alias("r")).collect()
    assert [list(r.k) for r in got] == [["b", "secret"], [], []]
    assert [r.r for r in got] == [[1, 3], None, None]


def test_memory_ranks_each_store_by_the_sum_of_both_scores(spark):
    t = "tokens array<string>, vector array<double>"
    queries = spark.createDataFrame([("q", ["a", "b"], [1.0, 0.0]), ("n", ["z"], None)], f"query_id string, {t}")
    rows = [
        (1, 1, "theorem", ["a", "b"], [0.0, 1.0]), (2, 2, "theorem", ["c"], [1.0, 0.0]), (3, 3, "theorem", ["a", "c"], [3.0, 4.0]), (4, 4, "theorem", ["a"], [4.0, 3.0]),
        (5, 5, "failure", ["x"], None), (6, 6, "failure", ["y"], [0.0, 0.0]), (7, 7, "prior", ["b"], [0.0, -1.0]),
    ]
    items = spark.createDataFrame(rows, f"item_id int, ordinal int, memory_type string, {t}")
    best = lambda df, q="q": [
        (r.memory_type, r.item_id, round(r.score, 6)) for r in df.where(F.col("query_id") == q).orderBy("memory_type", "rank").collect()
    ]
    for block in (1, 9):
        assert best(retrieval.memory_top_k(queries, items, 1, block=block)) == [("failure", 5, 0.0), ("prior", 7, 0.25), ("theorem", 4, 0.65)]
    assert best(retrieval.memory_top_k(queries, items, 4))[3:] == [
        ("theorem", 4, 0.65),
        ("theorem", 1, 0.5),
        ("theorem", 2, 0.5),
        ("theorem", 3, round(0.5 / 3 + 0.3, 6)),
    ]
    order = spark.createDataFrame(
        [("q", "theorem", 1, 0), ("q", "theorem", 3, -1), ("q", "failure", 6, 0)],
        "query_id string, memory_type string, item_id int, position int",
    )
    assert best(retrieval.memory_top_k(queries, items, 1, order=order)) == [("failure", 6, 0.0), ("prior", 7, 0.25), ("theorem", 1, 0.5)]
    assert [i for _, i, _ in best(retrieval.memory_top_k(queries, items, 1), "n")] == [5, 7, 1]
    assert retrieval.memory_top_k(queries.where("false"), items, 1).count() == 0


def test_every_code_block_is_checked(spark, monkeypatch):
    from millrace.plans import queries

    block = lambda code: f"```python\n{code}\n```\n"
    raw = [
        "<a_f1>" + block("def f1(x):\n    return x") + "</a_f1><a_f2>" + block("import os") + "</a_f2><a_f3>" + block("def g(x):\n    return x") + "</a_f3>",
        "<a_f1>" + block("def f1(x):\n    return x") + block("def f1(x):\n    return x") + "</a_f1>" + block("def h(:"),
    ]
    rows = spark.createDataFrame([(i, "p", t) for i, t in enumerate(raw)], "rollout_id int, problem_id string, raw_text string")
    monkeypatch.setattr(queries, "rollouts", lambda *_: rows)
    got = {(r.rollout_id, r.block): (r.node_id, r.safety == "ok", r.signature_ok) for r in queries.code_checks(spark, "").collect()}
    assert got == {
        (0, 1): ("f1", True, True), (0, 2): ("f2", False, False), (0, 3): ("f3", True, False),
        (1, 1): ("f1", True, False), (1, 2): ("f1", True, False), (1, 3): (None, False, None),
    }


G = "graph_id int, nodes array<struct<id:string,question:string,signature:string,expected_output_type:string>>, edges array<struct<source:string,target:string,relation_type:string>>"


def node(i):
    return (i, "q", f"{i}(x)", "python_function")


def edge(a, b):
    return (a, b, "uses_value")


def test_graph_rules(spark):
    n = [node("f1"), node("f2"), node("main")]
    cases = [
        (n, [edge("f1", "f2"), edge("f2", "main")], None), ([], [], "no nodes"), (
            n,
            [edge("f1", "main"), edge("f2", "main"), edge("main", "f1")],
            "main is no sink",
        ),
        ([*n, node("f1")], [], "duplicate ids"), ([node("f1")], [], "no main"), ([node("1x"), node("main")], [], "invalid id"), (
            [("f1", "", "s", "t"), node("main")],
            [],
            "missing field",
        ),
        (n, [edge("f1", "zz")], "unknown endpoint"), (n, [edge("f1", "f1")], "self edge"), (
            n,
            [edge("f1", "f2"), edge("f2", "f1"), edge("f2", "main")],
            "cycle",
        ), (n, [edge("f1", "main")], "disconnected"),
        ([node(f"n{i}") for i in range(64)] + [node("main")], [], "too many nodes"), (None, None, "no nodes"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], G)
    got = {r.graph_id: r.problem for r in graph.graph_problem(rows).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    reach = {r.node for r in graph.ancestors_of_main(rows).where("graph_id = 9").collect()}
    assert reach == {"f1", "f2", "main"}
    _, edges = graph.exploded(rows.where("graph_id = 0"))
    far = graph.reachable(edges, spark.createDataFrame([(0, "main")], "graph_id int, node string"))
    assert {r.node for r in far.collect()} == {"f1", "f2", "main"}


def test_edge_relations(spark):
    t = "array<struct<kind:string,passed:boolean>>"
    m = "map<string,string>"
    rows = spark.createDataFrame(
        [
            ("uses_value", {"a": "4", "b": "9"}, "x", "uses 4 only", None, True, None, None, None),
            ("implements_formula", None, "text", None, [("unit", False), ("property", True)], True, None, None, None),
            ("implements_formula", None, "text", None, [("unit", True)], False, None, None, None),
            ("aggregates_result", None, None, None, None, None, True, None, None),
            ("equivalent_output", None, None, None, None, None, None, {"a": "1", "b": "2"}, {"b": "2", "a": "1"}),
            ("other", None, None, None, None, None, True, None, None),
        ],
        f"relation_type string, parent_values {m}, parent_text string, child_evidence string, child_tests {t}, child_executable boolean, answer_matches boolean, parent_outputs {m}, child_outputs {m}",
    )
    assert [r.score for r in graph.edge_scores(rows).collect()] == [0.5, 1.0, 0.0, 1.0, 1.0, 0.0]


def test_canonical(spark):
    g = spark.createDataFrame(
        [("Q ", "a <<1+1=2>> b <<2*3=6>> c <<6+1=7>>\n#### 1,018"), ("Q2", "<<1>> #### 3"), (None, "x")],
        "question string, answer string",
    )
    rows = canonical.grade_school(g).collect()
    assert [(r.gold_answer, r.difficulty) for r in rows] == [("1018", "3")] and rows[0].id.startswith("medium_openai_gsm8k_")
    m = spark.createDataFrame(
        [("P", "so \\boxed{\\frac{3}{7}}", "Level 2", "Algebra"), ("P", "none", "Level 2", "A"), ("P", "\\boxed{1}", "Level 5", "A")],
        "problem string, solution string, level string, type string",
    )
    assert [r.gold_answer for r in canonical.competition(m, "algebra").collect()] == ["\\frac{3}{7}"]
    q = spark.createDataFrame(
        [("P", "R", "a ) 24 , b ) 120 , c ) none of these", o, "multiply(n0,n1)|power(#0,n2)|", "physics") for o in ("c", "b", "z")],
        "Problem string, Rationale string, options string, correct string, linear_formula string, category string",
    )
    assert [r.gold_answer for r in canonical.multiple_choice(q).collect()] == ["120"]
    o = spark.createDataFrame(
        [(" p ", "s", "\xa0a ", None, None, None), ("p", " ", "a", ["x"], "1", "s")],
        "problem string, solution string, answer string, domain array<string>, difficulty string, source string",
    )
    got = canonical.omni(o).collect()
    assert len(got) == 1 and (got[0].problem, got[0].gold_answer, got[0].source) == ("p", "a", "unknown")
    n = canonical.normalise_problem(
        spark.createDataFrame([(None, "t", None, "2")], "id string, question string, split string, answer string"),
        F.lit(3),
    ).first()
    assert (n.id, n.text, n.gold_answer, n.split) == ("problem-3", "t", "2", "train")


def test_retrieval(spark):
    items = spark.createDataFrame(
        [(i, i, t) for i, t in enumerate([["a", "b"], ["b"], ["z"], ["a", "b", "c"]])],
        "item_id long, ordinal long, tokens array<string>",
    )
    queries = spark.createDataFrame([("q", ["a", "b"]), ("none", ["y"])], "query_id string, tokens array<string>")
    got = {(r.query_id, r["rank"]): (r.item_id, round(r.score, 4)) for r in retrieval.jaccard_top_k(queries, items, 3).collect()}
    assert got == {("q", 1): (0, 1.0), ("q", 2): (3, 0.6667), ("q", 3): (1, 0.5), ("none", 1): (0, 0.0), ("none", 2): (1, 0.0), ("none", 3): (2, 0.0)}
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, None)], "item_id long, text string")
    idf = retrieval.idf_top_k(spark.createDataFrame([("q", "Alpha beta")], "query_id string, text string"), texts, 2).collect()
    assert [r.item_id for r in sorted(idf, key=lambda r: r["rank"])] == [1, 2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0])], "item_id long, vector array<float>")
    near = retrieval.cosine_top_k(v.where("item_id in (1, 2)").withColumnRenamed("item_id", "query_id"), v, 2, block=1).collect()
    assert {(r.query_id, r["rank"]): r.item_id for r in near} == {(1, 1): 1, (1, 2): 3, (2, 1): 2, (2, 2): 3}
    order = spark.createDataFrame([("q", 3, 1), ("q", 99, 2)], "query_id string, item_id long, position int")
    ranked = retrieval.jaccard_top_k(queries, items, 3).where("query_id = 'q'")
    assert {r["rank"]: r.item_id for r in retrieval.rerank(ranked, order).collect()} == {1: 3, 2: 0, 3: 1}


def test_rewards(spark):
    w = {"format": 0.1, "signature": 0.15, "execution": 0.2, "unit_test": 0.35, "property_test": 0.25, "final": 1.0, "backward": 0.25, "gate_floor": 1.0}
    row = spark.range(1)
    one = {k: F.lit(1.0) for k in ("format", "signature", "execution", "unit_test", "property_test", "final", "backward")}
    assert row.select(scoring.reward_parts(one, w)["total_reward"]).first()[0] == pytest.approx(2.3)
    gated = dict(w, gate_floor=0.25)
    wrong = dict(one, final=F.lit(0.0), backward=F.lit(0.0))
    right = dict(one, execution=F.lit(0.0), unit_test=F.lit(0.0), property_test=F.lit(0.0))
    both = row.select(scoring.reward_parts(wrong, gated)["total_reward"].alias("w"), scoring.reward_parts(right, gated)["total_reward"].alias("r")).first()
    assert both.r > both.w
    assert row.select(scoring.reward_parts(dict(one, format=F.lit(0.0), repaired=F.lit(1.0)), dict(w, repair=0.5))["total_reward"]).first()[0] == -0.5


def test_span_rewards(spark):
    nodes = spark.createDataFrame(
        [(1, "f1", 1.0, None, 1.0, 1.0, None, None), (1, "main", 0.0, None, None, None, None, None)],
        "rollout_id int, node_id string, signature double, node double, execution double, unit_test double, property_test double, teacher double",
    )
    edges = spark.createDataFrame(
        [(1, "f1", "main", 1.0), (1, "f1", "main", 1.0), (1, "gone", "main", 1.0)],
        "rollout_id int, source string, target string, score double",
    )
    out = spark.createDataFrame(
        [(1, 1.0, 1.0, 0.0, 0.0, None)],
        "rollout_id int, format double, final double, backward double, consensus double, teacher double",
    )
    w = {"signature": 0.1, "execution": 0.2, "unit_test": 0.3, "edge": 0.5, "final": 1.0, "span_credit": 0.5, "gate_floor": 0.25}
    got = {r.node_id: r.reward for r in scoring.span_rewards(nodes, edges, out, w).collect()}
    assert got == {"f1": pytest.approx(0.1 + 0.5 + 0.5 + 0.5), "main": pytest.approx(0.75 + 1.0), "gone": pytest.approx(0.25)}
    closed = scoring.span_rewards(nodes, edges, out.withColumn("format", F.lit(0.0)), w).collect()
    assert {r.reward for r in closed} == {0.0}


def test_advantages(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 3.0), ("q", 2.0), ("q", 2.0), (None, 1.0)], "problem string, value double")
    got = scoring.group_advantages(rows, ["problem"], "value").collect()
    assert sum(r.advantage for r in got if r.problem == "p") == pytest.approx(0)
    assert {r.advantage for r in got if r.problem == "q"} == {0.0} and len(got) == 6
    rollouts = spark.createDataFrame([("p", 1), ("p", 2)], "problem_id string, rollout_id int")
    rewards = spark.createDataFrame([(1, "f1", 1.0)], "rollout_id int, node_id string, reward double")
    dense = {r.rollout_id: r.advantage for r in scoring.span_advantages(rollouts, rewards).collect()}
    assert dense == {1: 1.0, 2: -1.0}
    t = spark.range(1).select(
        scoring.token_advantages(
            F.lit(5),
            F.expr("array(struct('a' as node, 0 as start, 3 as end), struct('b' as node, 2 as start, 4 as end))"),
            F.expr("map('a', 1D, 'b', 2D)"),
        )
    ).first()[0]
    assert t == [1.0, 1.0, 2.0, 2.0, 0.0]
    said = spark.createDataFrame(
        [("p", 1, "m", "x"), ("p", 2, "m", "x"), ("p", 3, "m", "y"), ("p", 4, "m", None)],
        "problem_id string, rollout_id int, node_id string, value string",
    )
    assert {r.rollout_id: round(r.consensus, 4) for r in scoring.consensus(said).collect()} == {1: 0.6667, 2: 0.6667, 3: 0.3333, 4: 0.0}


def test_node_scores(spark):
    t = "array<struct<kind:string,passed:boolean>>"
    rows = spark.createDataFrame(
        [("x", True, True, [("unit", True), ("property", False)], None), ("", True, True, [], None), ("x", False, None, [], None), ("x", False, None, [], 0.5)],
        f"text string, expects boolean, ok boolean, tests {t}, static double",
    )
    got = [r[0] for r in rows.select(scoring.node_score(F.col("text"), F.col("expects"), F.col("ok"), F.col("tests"), F.col("static"))).collect()]
    assert [g.combined for g in got] == [0.75, 0.0, None, 0.5]


REC = """wall_time_seconds double, rollout_records array<struct<rollout:struct<completion_token_count:int,tool_call_count:int,parsed_spans:array<struct<code_blocks:array<string>>>>,
 execution:struct<runtime_seconds:double,executable:boolean,timeout:boolean,node_results:map<string,struct<executable:boolean,test_results:array<struct<passed:boolean>>>>>,
 verification:struct<node_scores:map<string,double>,edge_scores:map<string,double>,final_answer_score:double>,reward:struct<final_reward:double>,
 repair:struct<status:string,verification_before_repair:struct<final_answer_score:double>>>>"""


def test_trajectory_metrics(spark):
    good = ((10, None, [(["a", "b"],)]), (0.5, True, False, {"f": (True, [(True,), (False,)])}), ({"f": 1.0}, {}, 1.0), (1.0,), ("not_needed", None))
    bad = ((20, 1, None), (1.5, True, True, {"f": (False, None)}), ({"f": 1.0}, None, 0.0), (0.0,), (None, (1.0,)))
    m = metrics.trajectory_metrics(spark.createDataFrame([(2.0, [good])], REC)).first()
    assert (m.rollout_accuracy, m.pass_at_k, m.cost_normalized_accuracy, m.average_tool_calls, m.useful_tool_ratio) == (1.0, 1.0, 0.5, 2.0, 0.5)
    m = metrics.trajectory_metrics(spark.createDataFrame([(2.0, [good, bad]), (4.0, []), (None, None)], REC)).first()
    assert (
        m.rollout_accuracy,
        round(m.pass_at_k, 4),
        m.average_solving_time_seconds,
        m.repair_success_rate,
        m.verifier_disagreement_rate,
    ) == (0.5, 0.3333, 2.0, 0.0, 0.5)
    assert (m.executable_but_wrong_rate, m.timeout_rate, m.tool_productivity, round(m.invalid_tool_rate, 4)) == (0.5, 0.5, 0.25, 0.3333)
    b = metrics.before_and_after(spark.createDataFrame([(2.0, [bad]), (1.0, [good])], REC)).first()
    assert (b.problems, b.accuracy_before, b.accuracy_after, b.improved, b.regressed) == (2, 1.0, 0.5, 0, 1)
    assert metrics.trajectory_metrics(spark.createDataFrame([], REC)).first().rollout_accuracy == 0.0


def test_positional_tests(spark):
    rows = spark.createDataFrame(
        [(1, [("unit",), ("property",), ("unit",)], [(True,), (True,)]), (1, [("unit",)], None)],
        "g int, expected array<struct<kind:string>>, actual array<struct<passed:boolean>>",
    )
    r = metrics.test_totals(rows, ["g"]).first()
    assert (r.unit_passed, r.unit_total, r.property_passed, r.property_total) == (1, 3, 1, 1)


def test_records(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4], [5, 6]), (1, [1], [7]), (2, [1], []), (2, [], [1, 2, 3, 4, 5])], "b int, p array<int>, c array<int>")
    out = records.encoded(rows, "p", "c", 5)
    got = sorted(out.collect(), key=lambda r: len(r.input_ids))
    assert [(r.input_ids, r.labels) for r in got] == [([1, 7], [-100, 7]), ([2, 3, 4, 5, 6], [-100, -100, -100, 5, 6])]
    wide = records.padded(out, "b", 0).collect()
    assert {len(r.labels) for r in wide} == {5} and {len(r.attention_mask) for r in wide} == {5}
    chat = records.chat_records(
        spark.createDataFrame([("x", "q")], "id string, t string"),
        "id",
        {"graph": [records.message("user", F.col("t"))], "solve": [records.message("user", F.col("t")), records.message("assistant", F.lit(" "))]},
    )
    assert [
        (r.id, r.ok) for r in chat.select("id", records.ends_with_answer(F.col("messages")).alias("ok")).collect()
    ] == [("x:graph", False), ("x:solve", False)]
    assert spark.range(1).select(records.last_line(F.lit("a\n b \n\n"))).first()[0] == "b"
