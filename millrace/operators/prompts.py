"""Prompts and supervised records: requests as JSON objects, code records from executable graphs, theorem records and enrichments.

A prompt is two messages: a system text, which is a parameter, and one JSON object of named columns. Everything is built from
expressions within a row; wrong rows are not dropped but carry `fault`, the first rule they break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import canonical, records, spans
from millrace.operators.bundles import SELF_CONTAINED, _blank, stripped

POLICY = f"Solve every node of the function graph within its own tag. Python code stands in one fenced block a node and is {SELF_CONTAINED}."
REPAIR = " This is another try: correct the reported failure and write the whole answer again."
CODE_TASK = "solve_with_executable_function_graph"
#: Prefix of a theorem's memory id, its item type and licence, ending of a source file, and the line before a formal statement.
THEOREM_PREFIX, THEOREM_TYPE, THEOREM_SOURCE, LICENSE, SOURCE_ENDING, FORMAL = "mathlib4:", "theorem", "mathlib4", "Apache-2.0", ".lean", "Formal Lean statement: "
THEOREM_URL = "https://github.com/leanprover-community/mathlib4"


#: Kept where they stand: a filter on a fault must not be pushed into expressions that cannot run Python.
_span_array = F.udf(lambda raw, nodes: spans.parse_spans(raw, list(nodes or [])), T.ArrayType(spans.SPAN), useArrow=True).asNondeterministic()
_private_keys = F.pandas_udf(spans.forbidden_keys.func, T.ArrayType(T.StringType())).asNondeterministic()


def request(system: Column | str, **fields: Column) -> Column:
    """Messages (role, content) of a system text and one JSON object; null fields are kept as null."""
    told = F.lit(system) if isinstance(system, str) else system
    body = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})
    return F.array(F.struct(F.lit("system").alias("role"), told.alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def policy_request(system: str, problem: Column, problem_id: Column, nodes: Column, edges: Column, memory: Column, feedback: Column | None = None) -> Column:
    """What a policy is asked: the problem, its graph, retrieved memory and the spans wanted; with feedback the repair of a failure."""
    wanted = F.transform(
        nodes,
        lambda n: F.struct(
            F.concat(F.lit("a_"), n["id"]).alias("tag"),
            n["name"].alias("name"),
            n["question"].alias("subquestion"),
            n["signature"].alias("signature"),
            n["expected_output_type"].alias("expected_output_type"),
        ),
    )
    graph = F.struct(problem_id.alias("problem_id"), nodes.alias("nodes"), edges.alias("edges"))
    asked = {"problem": problem, "function_graph": graph, "retrieved_memory": memory, "required_output_spans": wanted}
    plain = request(system, **asked)
    return plain if feedback is None else F.when(feedback.isNull(), plain).otherwise(request(system + REPAIR, **asked, repair_feedback=feedback))


def teacher_request(system: str, rows: dict[str, Column], memory: Column, most_nodes: int) -> Column:
    """What a teacher is asked to annotate: the record's columns, retrieved memory and the most nodes allowed."""
    return request(system, **rows, retrieved_memory=memory, max_nodes=F.lit(most_nodes))


def bundle_request(system: str, candidate: Column, reference_solution: Column, tagged_solution: Column) -> Column:
    """What a teacher is asked to turn into a hidden verifier; the solutions are for its eyes only."""
    return request(system, candidate=candidate, reference_solution=reference_solution, tagged_solution=tagged_solution)


def enrichment_request(system: str) -> Column:
    """What is asked about a theorem record."""
    return request(system, **{c: F.col(c) for c in ("lean_name", "namespace", "source_file", "formal_statement", "docstring")})


def compact_memory(item: Column) -> Column:
    """The fields of a memory item that a prompt shows."""
    return F.struct(*(item[c].alias(c) for c in ("memory_id", "title", "informal_statement", "formal_statement", "preconditions")))


def sft_metadata(source: str) -> Column:
    """Metadata of a supervised record of a master row (id, domain, difficulty, source, problem_sha256)."""
    return F.struct(
        F.lit(source).alias("source"), F.col("id").alias("source_problem_id"), F.coalesce("domain", F.array().cast("array<string>")).alias("domain"),
        F.col("difficulty"), F.col("source").alias("original_source"), F.col("problem_sha256"),
    )


def code_records(rows: DataFrame, system: str = POLICY) -> DataFrame:
    """Supervised records of executable graphs: (id, task, messages, executable_node_ids, fault).

    Rows: id, text, nodes, edges, hidden_ids (array), implementations (map of node to reference code), prose (map of node to the text of
    its span in the teacher's solution). The target is, node by node, the code in a block or the prose, in the node's tag.

    Faults, in order: no implementations, other node order than the hidden graph's, blank text, a node whose code or prose is blank, an
    executable node whose span does not hold its code as its one block, private keys in the prompt, private field names in the target, main
    without a boxed answer.
    """
    code = lambda n: F.try_element_at("implementations", n["id"])
    told = lambda n: F.coalesce(stripped(F.try_element_at("prose", n["id"])), F.lit(""))
    fence = lambda text: F.concat(F.lit("```python\n"), stripped(text), F.lit("\n```"))
    content = lambda n: F.when(code(n).isNotNull(), fence(code(n))).otherwise(told(n))
    span = lambda n: F.concat(F.lit("<a_"), n["id"], F.lit(">\n"), content(n), F.lit("\n</a_"), n["id"], F.lit(">"))
    ids = F.transform("nodes", lambda n: n["id"])
    none = F.array().cast("array<string>")
    made = rows.withColumns({"_ids": ids, "_target": F.array_join(F.transform("nodes", span), "\n")})
    made = made.withColumns({
        "_asked": policy_request(system, F.trim("text"), F.col("id"), F.col("nodes"), F.col("edges"), none),
        "_spans": _span_array("_target", "_ids"),
    })
    private = F.array(*map(F.lit, records.PRIVATE_KEYS["code_sft"]))
    made = made.withColumn("_leaked", _private_keys(F.element_at("_asked", 2)["content"], private))
    executable = F.filter("_ids", lambda i: F.map_contains_key("implementations", i))
    kept = lambda s: (F.size(s["code_blocks"]) == 1) & (
        F.try_element_at(s["code_blocks"], F.lit(1)) == stripped(F.try_element_at("implementations", s["node_id"]))
    )
    main = F.try_element_at(F.filter("_spans", lambda s: s["node_id"] == "main"), F.lit(1))
    fault = (
        F.when(F.coalesce(F.size("implementations"), F.lit(0)) <= 0, "no implementations")
        .when(~F.col("_ids").eqNullSafe(F.col("hidden_ids")), "node order")
        .when(_blank(F.col("text")), "blank text")
        .when(F.exists("nodes", lambda n: F.when(code(n).isNotNull(), _blank(code(n))).otherwise(told(n) == "")), "blank span")
        .when(~F.coalesce(spans.exact_tags(F.col("_target"), F.col("_ids")), F.lit(False)), "tags")
        .when(
            F.exists(F.filter("_spans", lambda s: F.map_contains_key("implementations", s["node_id"])), lambda s: ~F.coalesce(kept(s), F.lit(False))),
            "code block",
        )
        .when(F.size("_leaked") > 0, "private keys")
        .when(F.lower("_target").rlike("mutant_code|target_call"), "private names")
        .when(main["extracted_answer"].isNull(), "no boxed answer")
    )
    answer = F.struct(F.lit("assistant").alias("role"), F.col("_target").alias("content"))
    return made.select(
        F.concat("id", F.lit(":code_solve")).alias("id"), F.lit(CODE_TASK).alias("task"), F.concat("_asked", F.array(answer)).alias("messages"),
        executable.alias("executable_node_ids"), fault.alias("fault"),
    )


def theorem_records(traces: DataFrame) -> DataFrame:
    """Memory records of traced theorems, with `fault`: a blank name, a source that is no source file, a blank statement.

    Traces: full_name, file_path, theorem_statement, docstring, commit, url, premise_ids array<string>, premises array<array<string>> (those of
    each tactic). The namespace is what stands before the last dot; premises of both kinds are trimmed, different, sorted, without blanks
    and the theorem itself.
    """
    name, file, statement = (F.trim(F.coalesce(c, F.lit(""))) for c in ("full_name", "file_path", "theorem_statement"))
    none = F.array().cast("array<string>")
    named = F.concat(F.coalesce("premise_ids", none), F.coalesce(F.flatten(F.filter("premises", lambda p: p.isNotNull())), none))
    premises = F.array_sort(F.array_distinct(F.filter(F.transform(named, lambda p: F.trim(p)), lambda p: (p != "") & (p != name))))
    fault = F.when(name == "", "no name").when(~file.endswith(SOURCE_ENDING), "no source file").when(statement == "", "no statement")
    key = F.concat(F.lit(THEOREM_PREFIX), name)
    return traces.select(
        key.alias("memory_id"), key.alias("id"), F.lit(THEOREM_TYPE).alias("item_type"), name.alias("lean_name"),
        F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("").alias("namespace"), file.alias("source_file"),
        statement.alias("formal_statement"), "docstring", premises.alias("premise_ids"), F.lit(THEOREM_SOURCE).alias("source"),
        F.coalesce("url", F.lit(THEOREM_URL)).alias("source_url"), F.trim(F.coalesce("commit", F.lit(""))).alias("source_revision"), F.lit(LICENSE).alias("license"),
        F.array().cast("array<string>").alias("keywords"), statement.alias("text"), fault.alias("fault"),
    )


def merge_enrichment(theorems: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Theorem records with what was told about them (memory_id, title, informal_statement, domain_path, keywords, preconditions).

    Theorems without an enrichment stay as they are; the text of the others is title, informal and formal statement. `fault` becomes the
    first rule the enrichment breaks: a blank title or statement, or a list without an item. One left join on memory_id.
    """
    items = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    told = enrichments.select(
        F.col("memory_id").alias("_id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(
            F.coalesce("informal_statement", F.lit(""))
        ).alias("informal_statement"),
        items("domain_path").alias("domain_path"), items("keywords").alias("_keywords"), F.coalesce(
            "preconditions",
            F.array().cast("array<string>"),
        ).alias("preconditions"),
    )
    joined = theorems.join(told, theorems["memory_id"] == told["_id"], "left")
    has = F.col("_id").isNotNull()
    lacks = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    fault = F.when(
        has & ((F.col("title") == "") | (F.col("informal_statement") == "")),
        "no title or statement",
    ).when(has & lacks("domain_path"), "no domain").when(has & lacks("_keywords"), "no keywords")
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("informal_statement", F.lit("")), F.concat(F.lit(FORMAL), "formal_statement"))
    return joined.withColumns({
        "fault": F.coalesce("fault", fault), "text": F.when(has, text).otherwise(F.col("text")), "keywords": F.when(has, F.col("_keywords")).otherwise(F.col("keywords")),
    }).drop("_id", "_keywords")


def source_ids(rows: DataFrame) -> DataFrame:
    """(source_id, rows, fault) of records (id, source_problem_id): the given id, else the record's without its ending; blank or repeated
    ids are faults."""
    own = canonical.source_id(F.col("source_problem_id"), F.col("id"))
    counted = rows.select(F.trim(F.coalesce(own, F.lit(""))).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("rows"))
    return counted.withColumn("fault", F.when(F.col("source_id") == "", "blank").when(F.col("rows") > 1, "repeated"))
