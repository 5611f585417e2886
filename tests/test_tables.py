"""Constraints, deduplication, sources, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import constraints, dedup, records
from millrace.operators.components import connected_components
from millrace.sources import readers, sinks
from millrace.streaming import incremental


def test_unique_and_disjoint(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    constraints.require_unique(a, "id")
    with pytest.raises(constraints.ConstraintError):
        constraints.require_unique(a.union(a), "id")
    with pytest.raises(constraints.ConstraintError, match="1 id"):
        constraints.require_disjoint(a, b, "id")
    with pytest.raises(constraints.ConstraintError, match="'x'"):
        constraints.require_subset(a, b, "id")
    constraints.require_same_keys(a, a, "id")
    with pytest.raises(constraints.ConstraintError):
        constraints.require_count(a, 3)
    row = constraints.overlap_report(a, b, "id").first()
    assert (row.overlap, row.examples) == (1, ["y"])


def test_bundle_and_judgments(spark):
    t = "array<struct<kind:string,expected:string>>"
    rows = spark.createDataFrame([([("unit", "1"), (None, "2"), ("unit", "3"), ("property", "4")],), ([("unit", "1")] * 4,)], f"tests {t}")
    assert [r[0] for r in rows.select(constraints.test_bundle_ok(F.col("tests"))).collect()] == [True, False]
    j = "array<struct<index:int,node_scores:map<string,double>>>"
    rows = spark.createDataFrame([([(1, {"a": 1.0}), (0, {})], 2), ([(0, {"z": 1.0})], 1), ([(0, {}), (0, {})], 2)], f"j {j}, n int")
    assert [r[0] for r in rows.select(constraints.judgments_complete(F.col("j"), F.col("n"), F.array(F.lit("a")))).collect()] == [True, False, False]


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "a", "A"), (2, "a", "A"), (3, "b", "B"), (4, "b", "C"), (5, "a", None)], "n int, id string, v string")
    assert sorted(r.n for r in dedup.first_wins(rows, F.col("id"), ["n"]).collect()) == [1, 3]
    last = {r.id: (r.n, r.first) for r in dedup.last_wins(rows, "id", ["n"], position="first").collect()}
    assert last == {"a": (5, 1), "b": (4, 3)}
    assert [r.id for r in dedup.unique_pool(rows.where("n < 5"), "id", ["v"], ["n"]).collect()] == ["a"]
    assert dedup.unique_pool(rows, "id", ["v"], ["n"]).count() == 0
    new = dedup.upsert(rows.where("n = 1"), rows.where("n in (2, 3)"), "id")
    assert sorted(r.n for r in new.collect()) == [2, 3]


def test_exclusion_by_id_or_text(spark):
    medium = spark.createDataFrame([(f"medium_{i}", f"What is {i} plus {i}?") for i in range(6)], "id string, text string")
    known = spark.createDataFrame([("medium_0:solve", None), ("old_eval", "what is １ PLUS 1")], "id string, text string")
    assert sorted(r.id for r in dedup.exclude_known(medium, known, "id", "text").collect()) == [f"medium_{i}" for i in range(2, 6)]


def test_hashes(spark):
    rows = spark.createDataFrame([("Ünï Code_1!",), ("ünï code_1",), ("１２",), ("12",), ("!!",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.text_hash(F.col("t"))).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] != got[0] and got[5] is None


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (None, 4), (9, 8), (8, 10), (10, 9)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}
    chain = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.where("false")).count() == 0


def test_json_lines(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": "a", "difficulty": "2"}\n\n{"id": "b", "difficulty": "2.0"}\n')
    rows = readers.json_lines(spark, str(good), "id string, difficulty string")
    assert sorted(r.difficulty for r in rows.collect()) == ["2", "2.0"]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "a"}\n[1]\nnot json\n')
    with pytest.raises(readers.SourceError):
        readers.json_lines(spark, str(bad), "id string")
    assert readers.optional_json_lines(spark, str(tmp_path / "none"), "id string").count() == 0
    assert readers.json_lines(spark, [str(good), str(good)], "id string").count() == 4
    both = readers.labelled(spark, [f"x={good}", f"y={good}"], "id string")
    assert sorted(r.label for r in both.collect()) == ["x", "x", "y", "y"]
    with pytest.raises(readers.SourceError):
        readers.labelled(spark, [f"x={good}"], "id string")


def test_json_document(spark, tmp_path):
    for name, body in (("l", [{"id": "a"}]), ("d", {"data": [{"id": "a"}], "problems": []}), ("p", {"problems": [{"id": "a"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [r.id for r in readers.json_document(spark, str(tmp_path / name), "id string").collect()] == ["a"]
    (tmp_path / "x").write_text("{}")
    with pytest.raises(readers.SourceError):
        readers.json_document(spark, str(tmp_path / "x"), "id string")


def test_dataset_and_resume(spark):
    rows = spark.createDataFrame([(f"p{i}", "a" if i < 2 else "b") for i in range(8)], "id string, split string")
    assert readers.dataset(rows, "a", None, 0, None, F.col("id")).count() == 2
    whole = [r.id for r in readers.dataset(rows, None, 42, 0, None, F.col("id")).collect()]
    assert [r.id for r in readers.dataset(rows, None, 42, 3, 2, F.col("id")).collect()] == whole[3:5]
    with pytest.raises(readers.SourceError):
        readers.dataset(rows, "none", None, 0, None, F.col("id"))
    results = spark.createDataFrame([("p0", "m", "ok"), ("p1", "m", "error")], "id string, adapter string, status string")
    assert readers.resumable(results, rows, "id", "m", True).count() == 1
    with pytest.raises(readers.SourceError):
        readers.resumable(results.union(results), rows, "id", "m")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.25, 0.0046)], "id string, rate double, p_value double")
    sinks.write_json_lines(rows, str(tmp_path / "o"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_json_lines(rows, str(tmp_path / "o"), "errorifexists")
    assert sinks.write_manifest(rows, str(tmp_path / "m.json"))["rate"] == 0.25
    sinks.keep_manifest(rows, str(tmp_path / "m.json"))
    with pytest.raises(ValueError, match="differs"):
        sinks.keep_manifest(rows.withColumn("rate", F.lit(0.5)), str(tmp_path / "m.json"))
    assert sinks.markdown_report(rows, str(tmp_path / "r.md"), "Report") == 1
    report = (tmp_path / "r.md").read_text()
    assert "25.0 %" in report and "0.0046" in report
    assert len(sinks.file_digest(str(tmp_path / "r.md"))) == 64 and len(sinks.tree_digest(str(tmp_path))) == 64
    sinks.upsert_batch(rows, str(tmp_path / "t"), "id", ["rate"])
    sinks.upsert_batch(rows.withColumn("rate", F.lit(0.9)), str(tmp_path / "t"), "id", ["rate"])
    assert [r.rate for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [0.9]
    many = spark.range(1001).selectExpr("cast(id as string) id", "0.5D rate", "0.1D p_value")
    assert sinks.markdown_report(many, str(tmp_path / "many.md"), "All") == 1001
    assert (tmp_path / "many.md").read_text().count("50.0 %") == 1001


def test_a_crash_between_the_renames_loses_nothing(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    sinks.upsert_batch(rows, str(path), "id", ["n"])
    path.rename(tmp_path / "t.previous")  # as after the first rename
    sinks.upsert_batch(spark.createDataFrame([("b", 2)], "id string, n int"), str(path), "id", ["n"])
    assert {r.id: r.n for r in spark.read.parquet(str(path)).collect()} == {"a": 1, "b": 2}
    assert not (tmp_path / "t.previous").exists()


def test_memory_is_kept_by_store(spark, tmp_path):
    items = spark.createDataFrame(
        [("theorem", "t1", "x", 0), ("failure_case", "f1", "y", 1), ("theorem", "t2", "z", 2)],
        "memory_type string, id string, text string, ordinal int",
    )
    sinks.write_memory(items, str(tmp_path / "m"))
    sinks.write_memory(items, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 3 and (tmp_path / "m" / "memory_type=theorem").exists()
    row = sinks.memory_snapshot(items).first()
    assert [i.id for i in row.theorem_items] == ["t1", "t2"] and row.algorithm_templates == [] and row.failure_cases[0].text == "y"
    seeds = spark.createDataFrame([("theorem", "t1", "old", 0), ("theorem", "t9", "seed", 1), ("failure_case", "t1", "other store", 2)], items.schema)
    loaded = {(r.memory_type, r.id): r.text for r in sinks.load_memory([seeds], items).collect()}
    assert loaded == {
        ("theorem", "t1"): "x",
        ("theorem", "t9"): "seed",
        ("failure_case", "t1"): "other store",
        ("failure_case", "f1"): "y",
        ("theorem", "t2"): "z",
    }
    assert sinks.load_memory([seeds, items], None).count() == 6


def test_mistakes_are_failed_repairs(spark, tmp_path):
    s = "problem struct<id:string>, function_graph string, rollout_records array<struct<rollout:string,execution:string,verification:string,repair:struct<status:string>>>"
    rows = spark.createDataFrame(
        [(("p",), "g", [("r1", "e", "v", ("failed",)), ("r2", "e", "v", ("succeeded",)), ("r3", "e", "v", None)]), (("q",), "g", [])],
        s,
    )
    sinks.append_mistakes(rows, str(tmp_path / "n"))
    sinks.append_mistakes(rows, str(tmp_path / "n"))
    assert [r.rollout for r in spark.read.json(str(tmp_path / "n")).collect()] == ["r1", "r1"]


def test_strict_types(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"n": 1, "s": {"b": true}}\n{"n": null, "s": null}\n{}\n')
    assert readers.json_lines(spark, str(path), "n int, s struct<b:boolean>").count() == 3
    for line in ('{"n": "one"}', '{"n": [1]}', '{"s": 5}', '{"s": {"b": "maybe"}}'):
        path.write_text('{"n": 1}\n' + line + "\n")
        with pytest.raises(readers.SourceError, match="another type"):
            readers.json_lines(spark, str(path), "n int, s struct<b:boolean>")
        assert readers.json_lines(spark, str(path), "n int, s struct<b:boolean>", check=False).count() == 2


def test_landed_and_rank_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "abc123" / "train"))
    assert readers.landed(spark, str(tmp_path / "abc123" / "train"), "abc123").count() == 1
    with pytest.raises(readers.SourceError):
        readers.landed(spark, str(tmp_path / "abc123" / "train"), "main")
    folder = tmp_path / "ranks"
    folder.mkdir()
    (folder / "out.rank0.jsonl").write_text('{"id": "a"}\n\n')
    (folder / "out.rank2.jsonl").write_text('{"id": "b"}\n')
    (folder / "other.jsonl").write_text('{"id": "c"}\n')
    assert {(r.id, r.rank) for r in readers.rank_files(spark, str(folder), "id string").collect()} == {("a", 0), ("b", 2)}


def test_digest(spark):
    import hashlib

    row = records.ids_digest(spark.createDataFrame([("b",), ("a",)], "id string"), "id", True).first()
    assert row.ids_sha256 == hashlib.sha256(b"a\nb\n").hexdigest()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 1}\n')
    (folder / "2.json").write_text('{"id": "a", "n": 2}\n')
    rows = incremental.arriving(spark, str(folder), "id string, n int")
    incremental.upserting(rows, str(tmp_path / "out"), str(tmp_path / "cp"), "id", ["n"]).awaitTermination()
    assert {r.id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 2, "b": 1}
