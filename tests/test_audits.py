import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import audits
from millrace.operators.constraints import ConstraintError
from millrace.sources import config

RUN = """teacher_calls_used int, teacher_group_judgment struct<rollout_judgments:array<struct<index:int>>>, grpo_update struct<approx_kl:double>,
 rollout_records array<struct<rollout:struct<prompt_text:string,completion_token_count:int>,verification:struct<final_answer_score:double,backward_score:double>,reward:struct<teacher_reward:double>>>"""


def test_judge_run(spark):
    a, b = (("see repair_feedback", 2048), (1.0, 1.0), (0.9,)), (("plain", 10), (0.0, None), (0.1,))
    row = audits.judge_run(spark.createDataFrame([(1, ([(0,), (1,)],), (0.25,), [a, b]), (2, None, None, []), (None, None, None, None)], RUN), 2048)
    r = row.first()
    assert (r.problems, r.rollouts, r.judged_problems, r.error_problems, r.calls_over_budget) == (3, 2, 1, 2, 1)
    assert (r.prompts_with_feedback, r.capped_generations, r.groups_with_variance, r.final_accuracy, r.max_kl) == (1, 1, 1, 0.5, 0.25)
    with pytest.raises(ConstraintError, match="leaked"):
        audits.require_clean_run(row)
    clean = audits.judge_run(spark.createDataFrame([(1, ([(0,)],), None, [b])], RUN), 2048)
    audits.require_clean_run(clean, 1, True)
    with pytest.raises(ConstraintError, match="instead of 5"):
        audits.require_clean_run(clean, 5)


def test_coverage(spark):
    g = "graph_id int, nodes array<struct<id:string,expected_output_type:string,tests:array<struct<kind:string>>,target_call:string,static:boolean>>, edges array<struct<relation_type:string>>"
    rows = spark.createDataFrame(
        [
            (1, [("f1", "python_function", [("unit",), (None,)], None, None), ("main", "final_answer", None, "f1(2)", None)], [("uses_value",)]),
            (2, [("v", "values", [("property",)], "", True), ("w", "formula", None, None, True)], None),
            (3, None, None),
        ],
        g,
    )
    r = audits.reward_coverage(rows).first()
    assert (r.problems, r.total_nodes, r.total_edges, r.machine_verifiable_nodes, r.unverified_nodes) == (3, 4, 1, 3, 1)
    assert (r.graphs_with_unit_tests, r.graphs_with_property_tests, r.graphs_with_backward_call, r.graphs_with_executable_nodes) == (1, 1, 1, 2)
    counts = {(c.field, c.value): c.n for c in audits.type_counts(rows).collect()}
    assert counts[("test_kind", "unit")] == 2 and counts[("edge_type", "uses_value")] == 1


def test_annotations(spark):
    s = "ok boolean, problem string, spans array<struct<node_id:string,raw_text:string,extracted_answer:string>>, gold string"
    rows = [
        (True, None, [("f1", "x", None), ("main", "y", "\\left( 1 \\right)$")], "(1)."),
        (True, "cycle", [], "1"),
        (False, None, [], "1"),
        (True, None, [("main", "y", None)], "1"),
        (True, None, [("main", "y", "2")], "1"),
        (True, None, [("f1", "", None), ("main", "y", "1")], "1"),
    ]
    got = [
        r[0] for r in spark.createDataFrame(rows, s).select(audits.annotation_problem(F.col("ok"), F.col("problem"), F.col("spans"), F.col("gold"))).collect()
    ]
    assert got == [None, "graph: cycle", "tags", "no boxed answer", "answer differs", "empty span"]


def test_texts(spark):
    row = spark.createDataFrame([(" `def f(x):` ", None, " ", ["no json", '{"text": " told "}'])], "s string, p string, t string, m array<string>")
    r = row.select(audits.signature_text(F.col("s")).alias("s"), audits.problem_text([F.col("p"), F.col("t")], F.col("m")).alias("p")).first()
    assert (r.s, r.p) == ("f(x)", "told")
    shown = spark.createDataFrame(
        [([("e", "n", "secret")],)],
        "f array<struct<type:string,node:string,gold:string>>",
    ).select(audits.shown_failures(F.col("f"), ["type", "node", "gold"]).alias("f")).first().f
    assert shown[0].asDict() == {"type": "e", "node": "n"}
    made = spark.range(1).select(audits.failures_of({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)}, F.lit("main")).alias("f")).first().f
    assert [x.type for x in made] == ["a", "c"]


GOOD = {
    "dataset": {"algorithm_problem_dataset_path": "d/x.jsonl"},
    "policy": {"backend": "transformers", "model_name_or_path": "m"},
    "rollout": {"num_rollouts": 4},
    "decomposition": {"backend": "dataset"},
}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(GOOD))
    loaded = config.load(str(tmp_path / "c.json"))
    assert loaded["dataset"]["algorithm_problem_dataset_path"] == str(tmp_path / "d/x.jsonl")
    config.require_valid(loaded, "train")
    bad = json.loads(json.dumps(GOOD)) | {
        "rollout": {"num_rollouts": 1},
        "reward": {"answer_gate_floor": 2},
        "repair": {"enabled": True, "group_mode": "group_judge"},
        "sandbox": {"backend": "subprocess"},
    }
    assert len(config.broken_rules(bad, "train")) == 5
    with pytest.raises(config.ConfigError):
        config.require_valid(bad, "train")


def test_sizes():
    assert [config.byte_size(x) for x in (5, "7", "1k", "1.5 MiB", "2GB")] == [5, 7, 1024, 1572864, 2147483648]
    for bad in ("", "x", "-1", "0k", 0):
        with pytest.raises(config.ConfigError):
            config.byte_size(bad)
