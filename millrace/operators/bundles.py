"""Verifier bundles and executable evaluation records: checks, split into public and hidden graphs, projections.

A problem row holds its graph as arrays: nodes (id, name, question, signature, expected_output_type, spec) and edges (source, target,
relation_type), at most graph.MAX_NODES nodes. Everything stays inside the row, as array expressions: nothing is exploded, joined or
shuffled. Only what must parse Python runs in an Arrow-batched function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import graph, records, spans

#: Output types of nodes, kinds of tests, and the least number of tests of an executable node.
OUTPUT_TYPES = ("formula", "values", "python_function", "proof_claim", "final_answer")
KINDS, LEAST_TESTS, LEAST_UNIT, LEAST_PROPERTY, LONGEST_RUN = ("unit", "property"), 4, 3, 1, 2.0
#: Keys of a node's specification whose texts are semantic requirements, in this order; the first twelve count.
REQUIREMENT_KEYS = (
    "requirements",
    "must_establish",
    "must_include",
    "must_show",
    "must_state",
    "required_claims",
    "required_conclusion",
    "reason",
    "method",
    "check_method",
)
MOST_REQUIREMENTS = 12
#: Fixed value: what a prompt says that stands on its own.
SELF_CONTAINED = "executed alone in a fresh Python 3 interpreter"

SPEC = "map<string,array<string>>"
NODES = f"array<struct<id:string,name:string,question:string,signature:string,expected_output_type:string,spec:{SPEC}>>"
EDGES = "array<struct<source:string,target:string,relation_type:string>>"
TESTS = "array<struct<kind:string,expression:string,expected:string,source:string>>"
ANNOTATIONS = (
    f"array<struct<node_id:string,canonical_output_type:string,check_types:array<string>,tests:{TESTS},reference_code:string,mutant_code:string,"
    "oracle_strategy:string,formula:string,values:map<string,string>,target_call:string,estimated_runtime_seconds:double>>"
)


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def semantic_requirements(spec: Column) -> Column:
    """The texts of REQUIREMENT_KEYS of a map of lists, trimmed, without blanks, the first twelve."""
    lists = [F.coalesce(F.try_element_at(spec, F.lit(k)), F.array().cast("array<string>")) for k in REQUIREMENT_KEYS]
    texts = F.filter(F.transform(F.flatten(F.array(*lists)), lambda t: F.trim(t)), lambda t: t != "")
    return F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, MOST_REQUIREMENTS)


def implementation_problem(signature: str | None, reference: str | None, mutant: str | None, expressions: list[str]) -> str | None:
    """First rule that a node's code and tests break: safe test expressions, safe code, the signature's function defined, and no test
    calling what the code does not define; null if none."""
    for expression in expressions:
        if problem := spans.code_problem(expression, expression=True):
            return f"test: {problem}"
    for name, code in (("reference", reference), ("mutant", mutant)):
        if problem := spans.code_problem(code) or spans.contract_problem(code, signature, expressions):
            return f"{name}: {problem}"
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _implementation_problems(nodes: pd.Series, annotations: pd.Series) -> pd.Series:
    """The problems of all executable nodes of a row."""
    out = []
    for held, told in zip(nodes, annotations, strict=True):
        signatures = {n["id"]: n["signature"] for n in (() if held is None else held)}
        found = []
        for a in () if told is None else told:
            if (a["canonical_output_type"] or "").strip() == "python_function":
                calls = [(t["expression"] or "").strip() for t in (() if a["tests"] is None else a["tests"])]
                found.append(implementation_problem(signatures.get((a["node_id"] or "").strip()), a["reference_code"], a["mutant_code"], calls))
        out.append([f for f in found if f is not None])
    return pd.Series(out, dtype=object)


#: Kept where it stands: a filter on its result must not be pushed into expressions that cannot run Python.
_implementation_problems = _implementation_problems.asNondeterministic()


def bundle_problem(rows: DataFrame) -> DataFrame:
    """Rows (problem_id, nodes, edges, annotations, eligible, confidence) and `problem`: the first rule the bundle breaks, null if none.

    Order: eligible, graph, annotation ids, output types, tests, runtimes, code, formulas and values, an executable node, target call,
    confidence. A missing value breaks the rule that needs it.
    """
    named = F.transform("nodes", lambda n: n["id"])
    told = F.transform("annotations", lambda a: F.trim(F.coalesce(a["node_id"], F.lit(""))))
    kind = lambda a: F.coalesce(F.trim(a["canonical_output_type"]), F.lit(""))
    python = F.filter("annotations", lambda a: kind(a) == "python_function")
    tests = lambda a: F.coalesce(a["tests"], F.array().cast(TESTS))
    of_kind = lambda a, k: F.size(F.filter(tests(a), lambda t: F.trim(t["kind"]) == k))
    bad_tests = lambda a: (
        (F.size(tests(a)) < LEAST_TESTS) | F.exists(tests(a), lambda t: ~F.coalesce(F.trim(t["kind"]).isin(*KINDS), F.lit(False)) | t["expected"].isNull())
        | (of_kind(a, "unit") < LEAST_UNIT) | (of_kind(a, "property") < LEAST_PROPERTY)
    )
    target = F.trim(F.try_element_at(F.filter("annotations", lambda a: F.trim(a["node_id"]) == "main"), F.lit(1))["target_call"])
    calls = F.flatten(F.transform(python, lambda a: F.transform(tests(a), lambda t: F.trim(t["expression"]))))
    runs = lambda a: (a["estimated_runtime_seconds"] > 0) & (a["estimated_runtime_seconds"] <= LONGEST_RUN)
    rules = [
        (~F.coalesce("eligible", F.lit(False)), F.lit("not eligible")),
        (F.col("_graph").isNotNull(), F.concat(F.lit("graph: "), F.col("_graph"))),
        (F.exists(told, lambda i: i == "") | (F.size(F.array_distinct(told)) < F.size(told)), F.lit("blank or repeated node id")),
        ((F.size(F.array_except(named, told)) > 0) | (F.size(F.array_except(told, named)) > 0), F.lit("node ids differ")),
        (F.exists("annotations", lambda a: ~kind(a).isin(*OUTPUT_TYPES)), F.lit("output type")),
        (F.exists("annotations", lambda a: (F.trim(a["node_id"]) == "main") != (kind(a) == "final_answer")), F.lit("main and final_answer")),
        (F.exists(python, bad_tests), F.lit("tests")),
        (F.exists(python, lambda a: ~F.coalesce(runs(a), F.lit(False))), F.lit("runtime")),
        (F.size("_code") > 0, F.concat(F.lit("code: "), F.try_element_at("_code", F.lit(1)))),
        (F.exists("annotations", lambda a: (kind(a) == "formula") & _blank(a["formula"])), F.lit("formula")),
        (F.exists("annotations", lambda a: (kind(a) == "values") & (F.coalesce(F.size(a["values"]), F.lit(0)) <= 0)), F.lit("values")),
        (F.size(python) == 0, F.lit("no executable node")),
        (_blank(target) | ~F.array_contains(calls, target), F.lit("target call")),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("confidence")),
    ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(out)
    graphed = rows.withColumn("_graph", graph.problem_column(F.col("nodes"), F.coalesce("edges", F.array().cast(EDGES))))
    return graphed.withColumn("_code", _implementation_problems("nodes", "annotations")).withColumn("problem", out).drop("_graph", "_code")


def compile_bundles(rows: DataFrame) -> DataFrame:
    """Valid bundles (problem null) split into what a policy may see and what stays hidden.

    (problem_id, public_nodes, hidden_nodes, edges, implementations, executable_ids): both node lists keep the node order; public
    nodes have check types and semantic requirements, hidden ones tests, formula, values and target call, whichever their type has.
    """
    told = lambda n: F.try_element_at(F.filter("annotations", lambda a: F.trim(a["node_id"]) == n["id"]), F.lit(1))
    both = F.transform("nodes", lambda n: F.struct(n.alias("n"), told(n).alias("a")))
    kind = lambda x: F.trim(x["a"]["canonical_output_type"])
    own = lambda x: (
        x["n"]["id"].alias("id"),
        x["n"]["name"].alias("name"),
        x["n"]["question"].alias("question"),
        x["n"]["signature"].alias("signature"),
        kind(x).alias("expected_output_type"),
    )
    only = lambda x, k, c: F.when(kind(x) == k, c)
    texts = lambda ts: F.filter(F.transform(F.coalesce(ts, F.array().cast("array<string>")), stripped), lambda t: t != "")
    clean = lambda ts: F.transform(
        ts,
        lambda t: F.struct(
            F.trim(t["kind"]).alias("kind"),
            F.trim(t["expression"]).alias("expression"),
            t["expected"].alias("expected"),
            F.nullif(F.trim(t["source"]), F.lit("")).alias("source"),
        ),
    )
    public = F.transform(
        "_both",
        lambda x: F.struct(*own(x), texts(x["a"]["check_types"]).alias("check_types"), semantic_requirements(x["n"]["spec"]).alias("semantic_requirements")),
    )
    hidden = F.transform("_both", lambda x: F.struct(
        *own(x), only(x, "python_function", clean(x["a"]["tests"])).alias("tests"), only(x, "formula", F.trim(x["a"]["formula"])).alias("formula"),
        only(x, "values", x["a"]["values"]).alias("values"), only(x, "final_answer", F.nullif(F.trim(x["a"]["target_call"]), F.lit(""))).alias("target_call"),
    ))
    python = F.filter("_both", lambda x: kind(x) == "python_function")
    made = F.transform(
        python,
        lambda x: F.struct(
            x["n"]["id"].alias("node_id"),
            stripped(x["a"]["reference_code"]).alias("reference_code"),
            stripped(x["a"]["mutant_code"]).alias("mutant_code"),
            F.trim(x["a"]["oracle_strategy"]).alias("oracle_strategy"),
            x["a"]["estimated_runtime_seconds"].alias("estimated_runtime_seconds"),
        ),
    )
    held = rows.where("problem is null").withColumn("_both", both)
    return held.select(
        "problem_id", public.alias("public_nodes"), hidden.alias("hidden_nodes"), "edges", made.alias("implementations"), F.transform(python, lambda x: x["n"]["id"]).alias("executable_ids")
    )


def same_api(public_nodes: Column, hidden_nodes: Column, public_edges: Column, hidden_edges: Column) -> Column:
    """Both graphs have the same (id, signature, type) and (source, target, relation) in the same order."""
    nodes = lambda ns: F.transform(ns, lambda n: F.struct(n["id"], n["signature"], n["expected_output_type"]))
    edges = lambda es: F.transform(F.coalesce(es, F.array().cast(EDGES)), lambda e: F.struct(e["source"], e["target"], e["relation_type"]))
    return nodes(public_nodes).eqNullSafe(nodes(hidden_nodes)) & edges(public_edges).eqNullSafe(edges(hidden_edges))


def record_problem(row_id: Column, graph_id: Column, public_nodes: Column, hidden_nodes: Column, edges: Column) -> Column:
    """First rule an executable record breaks: an id, both graphs, valid graphs, the row's id on them, nodes in the same order."""
    ids = lambda ns: F.transform(ns, lambda n: n["id"])
    links = F.coalesce(edges, F.array().cast(EDGES))
    return (
        F.when(_blank(row_id), "no id")
        .when(public_nodes.isNull() | hidden_nodes.isNull(), "no graph")
        .when(graph.problem_column(public_nodes, links).isNotNull(), F.concat(F.lit("public: "), graph.problem_column(public_nodes, links)))
        .when(graph.problem_column(hidden_nodes, links).isNotNull(), F.concat(F.lit("hidden: "), graph.problem_column(hidden_nodes, links)))
        .when(~F.coalesce(graph_id == row_id, F.lit(False)), "graph of another id")
        .when(ids(public_nodes) != ids(hidden_nodes), "node order")
    )


def training_problems(masters: DataFrame) -> DataFrame:
    """Masters (id, problem, gold_answer, domain, difficulty, graph_id, nodes, edges) as training rows with `fault`, null if they are fit.

    (id, text, gold_answer, split, domain, difficulty, nodes, edges, fault): split is train; faults are a missing graph, a graph of
    another id, an invalid graph, and a blank problem or answer.
    """
    return _projected(masters, F.lit("train"), [])


def evaluation_candidates(masters: DataFrame, origin: str = "locked_holdout") -> DataFrame:
    """Masters as candidates of a locked evaluation, by id: as training_problems with their source and origin, and nothing private."""
    out = _projected(masters, F.lit("locked_test_candidate"), ["source"]).withColumn("evaluation_origin", F.lit(origin))
    leaked = sorted(set(out.columns) & set(records.PRIVATE_KEYS["selection"]))
    if leaked:
        raise ValueError(f"private columns: {leaked}")
    return out.orderBy("id")


def _projected(masters: DataFrame, split: Column, more: list[str]) -> DataFrame:
    links = F.coalesce("edges", F.array().cast(EDGES))
    broken = graph.problem_column(F.col("nodes"), links)
    fault = (
        F.when(_blank(F.col("id")), "no id")
        .when(F.col("nodes").isNull(), "no graph")
        .when(~F.coalesce(F.col("graph_id") == F.col("id"), F.lit(False)), "graph of another id")
        .when(broken.isNotNull(), F.concat(F.lit("graph: "), broken))
        .when(_blank(F.col("problem")) | _blank(F.col("gold_answer")), "blank problem or answer")
    )
    domain = F.coalesce("domain", F.array().cast("array<string>"))
    return masters.select(
        F.trim("id").alias("id"), F.trim("problem").alias("text"), F.trim("gold_answer").alias("gold_answer"), split.alias("split"), *more,
        domain.alias("domain"), "difficulty", "nodes", "edges", fault.alias("fault"),
    )


def with_split(rows: DataFrame, split: str) -> DataFrame:
    """All rows under one split, whatever they had."""
    return rows.withColumn("split", F.lit(split))


def evaluation_input(rows: DataFrame) -> DataFrame:
    """Rows (id, text, problem, gold_answer, public_nodes, hidden_nodes, ...) as (id, text, gold_answer, split, fault, ...).

    The text falls back to the problem; faults are a missing graph, different node orders, and a blank text or answer.
    """
    ids = lambda c: F.transform(c, lambda n: n["id"])
    text = F.trim(F.coalesce("text", "problem", F.lit("")))
    fault = (
        F.when(F.col("public_nodes").isNull() | F.col("hidden_nodes").isNull(), "no graph")
        .when(ids("public_nodes") != ids("hidden_nodes"), "node order")
        .when((text == "") | _blank(F.col("gold_answer")), "blank text or answer")
    )
    kept = [c for c in rows.columns if c not in ("id", "text", "problem", "gold_answer", "split", "fault")]
    return rows.select("id", text.alias("text"), F.trim("gold_answer").alias("gold_answer"), F.lit("validation").alias("split"), fault.alias("fault"), *kept)


def self_contained(messages: Column) -> Column:
    """The first message says, whatever its blanks, that its code runs alone."""
    first = F.try_element_at(messages, F.lit(1))["content"]
    return F.contains(F.regexp_replace(F.coalesce(first, F.lit("")), r"\s+", " "), F.lit(SELF_CONTAINED))


def accepted_faults(accepted: DataFrame, selected: DataFrame, family) -> DataFrame:
    """(id, fault) of accepted rows: never selected, or of another family than the row selected; null for rows that are fit.

    `family` makes the family of a row from its columns. One left join on the id.
    """
    known = selected.select(F.col("id").alias("_id"), family(selected).alias("_was"), F.lit(True).alias("_is"))
    joined = accepted.withColumn("_now", family(accepted)).join(known, accepted["id"] == known["_id"], "left")
    fault = F.when(F.col("_is").isNull(), "not selected").when(~F.col("_now").eqNullSafe(F.col("_was")), "family changed")
    return joined.select("id", fault.alias("fault"))


def recovered_payloads(records_: DataFrame, failures: DataFrame, completed: DataFrame) -> DataFrame:
    """(id, teacher_payload): payloads of earlier failures whose record exists and is not completed; one per id, the first by position.

    Failures are (id, position, teacher_payload); those without a payload are left to be asked again.
    """
    held = failures.where(~_blank(F.col("id")) & F.col("teacher_payload").isNotNull())
    first = held.groupBy("id").agg(F.min_by("teacher_payload", "position").alias("teacher_payload"))
    return first.join(records_.select("id").distinct(), "id", "left_semi").join(completed.select("id").distinct(), "id", "left_anti")
