"""What a teacher or a policy may see of executions, verifications and memory: bounded, without hidden tests and expected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.audits import shown_failures
from millrace.operators.records import last_line

#: The mark of a hidden test's frame and what is said instead, and the bounds of shown texts.
HIDDEN, MASKED = "<hidden-test", "hidden test execution failed"
LONGEST_OUTPUT, LONGEST_NODE_OUTPUT, MOST_ITEMS, LONGEST_TEXT, MOST_KEYWORDS = 4000, 2000, 3, 2400, 24


def error_summary(stderr: Column) -> Column:
    """The last line that is not blank, its last 500 characters; masked if it names a hidden test, empty without one."""
    line = F.coalesce(last_line(stderr), F.lit(""))
    whole = F.coalesce(last_line(stderr, 1 << 30), F.lit(""))
    return F.when(F.contains(whole, F.lit(HIDDEN)), F.lit(MASKED)).otherwise(line)


def test_summary(tests: Column) -> Column:
    """Map of a test's kind (unit, if it has none) to how many passed and how many there are."""
    short = F.transform(tests, lambda t: F.struct(F.coalesce(t["kind"], F.lit("unit")).alias("kind"), t["passed"].alias("passed")))
    held = F.coalesce(short, F.array().cast("array<struct<kind:string,passed:boolean>>"))
    kinds = F.array_sort(F.array_distinct(F.transform(held, lambda t: t["kind"])))
    of = lambda k: F.filter(held, lambda t: t["kind"] == k)
    passed = lambda k: F.size(F.filter(of(k), lambda t: F.coalesce(t["passed"], F.lit(False))))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.struct(passed(k).alias("passed"), F.size(of(k)).alias("total")))))


def public_execution(execution: Column) -> Column:
    """An execution (executable, timeout, runtime_seconds, node_results) with counts of tests and one line of errors a node."""
    flag, number = lambda c: F.coalesce(c, F.lit(False)), lambda c: F.coalesce(c, F.lit(0.0))
    node = lambda n: F.struct(
        flag(n["executable"]).alias("executable"), flag(n["timeout"]).alias("timeout"), number(n["runtime_seconds"]).alias("runtime_seconds"),
        error_summary(n["stderr"]).alias("error_summary"), test_summary(n["test_results"]).alias("test_summary"),
    )
    nodes = F.transform_values(execution["node_results"], lambda _, n: node(n))
    return F.struct(
        flag(execution["executable"]).alias("executable"),
        flag(execution["timeout"]).alias("timeout"),
        number(execution["runtime_seconds"]).alias("runtime_seconds"),
        nodes.alias("node_results"),
    )


def _end(text: Column, longest: int) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return F.substring(filled, F.greatest(F.length(filled) - longest + 1, F.lit(1)), F.lit(longest))


def private_execution(execution: Column) -> Column:
    """An execution with the ends of its outputs, for a private teacher."""
    node = lambda n: n.withField("stdout", _end(n["stdout"], LONGEST_NODE_OUTPUT)).withField("stderr", _end(n["stderr"], LONGEST_NODE_OUTPUT))
    shorter = execution.withField("stdout", _end(execution["stdout"], LONGEST_OUTPUT)).withField("stderr", _end(execution["stderr"], LONGEST_OUTPUT))
    return shorter.withField("node_results", F.transform_values(execution["node_results"], lambda _, n: node(n)))


def public_verification(verification: Column, failure_fields: list[str]) -> Column:
    """A verification whose failures keep only the fields a prompt may show."""
    return verification.withField("failures", shown_failures(verification["failures"], failure_fields))


def bounded_memory(items: Column, metadata: tuple[str, ...] = ()) -> Column:
    """The first items of a memory context with bounded texts and keywords and the named metadata fields; null contexts are empty."""
    fields = lambda i: [i[c].alias(c) for c in metadata]
    shown = lambda i: F.struct(
        i["id"].alias("id"),
        i["source"].alias("source"),
        F.substring(i["text"], 1, LONGEST_TEXT).alias("text"),
        F.slice(i["keywords"], 1, MOST_KEYWORDS).alias("keywords"),
        *fields(i),
    )
    return F.transform(F.slice(F.coalesce(items, F.array()), 1, MOST_ITEMS), shown)
