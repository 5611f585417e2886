"""Tagged spans of a response, exact tag order, and static checks of generated code. Code is parsed, never run."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.canonical import boxed_values

SPAN = T.StructType(
    [
        T.StructField("node_id", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("code_blocks", T.ArrayType(T.StringType())),
        T.StructField("extracted_answer", T.StringType()), T.StructField("extracted_formula", T.StringType()),
        T.StructField(
            "extracted_values",
            T.MapType(T.StringType(), T.StringType()),
        ), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()),
    ]
)
CODE = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("node_blocks", T.ArrayType(T.StringType())),
    ]
)
PYTHON = re.compile(r"```python\n(.*?)```", re.S)
TAGS = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9_]*)>")
#: A name or a place of a table at the end of a text, and a whole number at its start.
TARGET, WHOLE = re.compile(r"(dp\[\d+\]|(?<!\w)[A-Za-z]\w*)\s*\Z", re.A), re.compile(r"\s*(-?\d+)(?!\w)", re.A)


def _after(text: str, phrase: str) -> list[str]:
    """What follows each place of a phrase, in any case."""
    lower, at, out = text.lower(), -1, []
    while (at := lower.find(phrase, at + 1)) >= 0:
        out.append(text[at + len(phrase) :])
    return out


def _answer(text: str) -> str | None:
    """The last boxed value, else the whole number after "final answer is"."""
    if boxes := boxed_values(text.replace("\\fbox", "\\nobox")):
        return boxes[-1].strip()
    for rest in _after(text, "final answer is"):
        stated = rest.lstrip()
        digits = stated.removeprefix("-")
        n = len(digits) - len(digits.lstrip("0123456789"))
        if rest[:1].isspace() and n:
            return stated[: len(stated) - len(digits) + n]
    return None


def _formula(text: str) -> str | None:
    """The rest of the line after "recurrence:"."""
    for rest in _after(text, "recurrence"):
        head, colon, said = rest.partition(":")
        line = said.lstrip().split("\n", 1)[0].strip()
        if colon and not head.strip() and line:
            return line
    return None


def assignments(text: str) -> dict[str, str]:
    """Whole numbers given to names and to places of a table; the last value of a place and the first of a name count."""
    places, names = {}, {}
    pieces = text.split("=")
    for left, right in zip(pieces, pieces[1:]):
        target, value = TARGET.search(left), WHOLE.match(right)
        if target and value:
            name = target.group(1)
            if "[" in name:
                places[name] = value.group(1)
            else:
                names.setdefault(name, value.group(1))
    return places | names


def _blocks(text: str) -> list[str]:
    """Contents of closed code blocks, without a leading language name."""
    found = text.split("```")[1:-1:2] if text.count("```") > 1 else []
    return [(b[6:] if b[:6].lower() == "python" else b).strip() for b in found]


def tag_places(raw: str) -> dict[str, tuple[int, int]]:
    """Start and end of the inside of the first tag of every name, from one scan; names that never close are left out."""
    opened: dict[str, int] = {}
    found: dict[str, tuple[int, int]] = {}
    for m in TAGS.finditer(raw):
        slash, name = m.groups()
        if not slash:
            opened.setdefault(name, m.end())
        elif name in opened and name not in found:
            found[name] = (opened[name], m.start())
    return found


def parse_spans(raw: str | None, nodes: list[str]) -> list[dict]:
    """One span a node, in node order. A node's tag is a_<id>, a_<position>, and for main also a_main and main; the first of these that
    closes wins. Nodes without a span have an empty text and offsets -1. Offsets count code points."""
    places, spans = tag_places(raw or ""), []
    for place, node in enumerate(nodes, 1):
        names = (f"a_{node}", f"a_{place}", *(("a_main", "main") if node == "main" else ()))
        start, end = next((places[n] for n in names if n in places), (-1, -1))
        text = raw[start:end] if start >= 0 else ""
        spans.append(
            {
                "node_id": node, "raw_text": text.strip(), "code_blocks": _blocks(text), "extracted_answer": _answer(text),
                "extracted_formula": _formula(text), "extracted_values": assignments(text), "start_char": start, "end_char": end,
            }
        )
    return spans


@F.udf(T.ArrayType(SPAN), useArrow=True)
def tagged_spans(raw, nodes):
    """Array of spans of a response for an array of node ids; nested results travel as Arrow batches."""
    return parse_spans(raw, list(nodes) if nodes is not None else [])


def parse_code(raw: str | None, nodes: list[str]) -> list[dict]:
    """Every closed Python block of a response, numbered from 1, with the node whose span holds it and all blocks of that span;
    both are null for a block outside all spans."""
    spans, found = [s for s in parse_spans(raw, nodes) if s["start_char"] >= 0], []
    for place, m in enumerate(PYTHON.finditer(raw or ""), 1):
        own = next((s for s in spans if s["start_char"] <= m.start() and m.end() <= s["end_char"]), None)
        found.append({"block": place, "node_id": own and own["node_id"], "code": m.group(1), "node_blocks": own and own["code_blocks"]})
    return found


@F.udf(T.ArrayType(CODE), useArrow=True)
def code_blocks(raw, nodes):
    """Array of the Python blocks of a response for an array of node ids."""
    return parse_code(raw, list(nodes) if nodes is not None else [])


def exact_tags(raw: Column, nodes: Column) -> Column:
    """The text is exactly <a_id>..</a_id> for all nodes in order, with nothing but blanks outside."""
    tags = F.regexp_extract_all(raw, F.lit(r"(</?a_[A-Za-z0-9_]+>)"), F.lit(1))
    wanted = F.flatten(F.transform(nodes, lambda n: F.array(F.concat(F.lit("<a_"), n, F.lit(">")), F.concat(F.lit("</a_"), n, F.lit(">")))))
    outside = F.regexp_replace(raw, r"(?s)<a_([A-Za-z0-9_]+)>.*?</a_\1>", "")
    return F.coalesce((F.array_join(tags, "|") == F.array_join(wanted, "|")) & (F.regexp_replace(outside, r"[\s\p{Z}]+", "") == ""), F.lit(False))


def tag_set_once(raw: Column, nodes: Column) -> Column:
    """The weaker rule: every node's tag opens and closes once; order and outside text are free."""
    tags = F.array_sort(F.regexp_extract_all(raw, F.lit(r"(</?a_[A-Za-z0-9_]+>)"), F.lit(1)))
    wanted = F.array_sort(F.flatten(F.transform(nodes, lambda n: F.array(F.concat(F.lit("<a_"), n, F.lit(">")), F.concat(F.lit("</a_"), n, F.lit(">"))))))
    return F.coalesce(F.array_join(tags, "|") == F.array_join(wanted, "|"), F.lit(False))


def first_tag(raw: Column, name: Column) -> Column:
    """Inside of the first pair of tags of that name, null without one."""
    at = F.instr(raw, F.concat(F.lit("<"), name, F.lit(">")))
    after = F.substring(raw, at + F.length(name) + 2, F.length(raw))
    end = F.instr(after, F.concat(F.lit("</"), name, F.lit(">")))
    return F.when((at > 0) & (end > 0), F.substring(after, F.lit(1), end - 1))


def call_shape(function: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple:
    """What callers see: name, async, and parameter names by kind. Annotations and defaults do not count."""
    a = function.args
    names = lambda args: tuple(x.arg for x in args)
    return (
        function.name,
        isinstance(function, ast.AsyncFunctionDef),
        names(a.posonlyargs),
        names(a.args),
        a.vararg and a.vararg.arg,
        names(a.kwonlyargs),
        a.kwarg and a.kwarg.arg,
    )


def signature_matches(signature: str | None, blocks: list[str]) -> bool:
    """Exactly one block, with exactly one top-level function of the wanted name and the wanted parameters."""
    if not signature or not signature.strip() or len(blocks) != 1:
        return False
    try:
        wanted = call_shape(ast.parse(f"def {signature.strip()}:\n    pass\n").body[0])
        found = [call_shape(f) for f in ast.parse(blocks[0]).body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name == wanted[0]]
    except (SyntaxError, ValueError, AttributeError, RecursionError, MemoryError):
        return False
    return found == [wanted]


@F.pandas_udf(T.BooleanType())
def python_signature_ok(signature: pd.Series, blocks: pd.Series) -> pd.Series:
    return pd.Series([signature_matches(s, list(b) if b is not None else []) for s, b in zip(signature, blocks, strict=True)], dtype=bool)


#: Modules generated code may import, and names it must not use.
IMPORTS = frozenset(["collections", "fractions", "functools", "heapq", "itertools", "math", "operator", "statistics"])
FORBIDDEN = frozenset([
    "__import__", "breakpoint", "compile", "delattr", "dir", "eval", "exec", "exit", "getattr", "globals", "help", "input", "locals",
    "memoryview", "open", "quit", "requests", "setattr", "socket", "subprocess", "type", "urllib", "vars",
])
LONGEST_CODE, LONGEST_EXPRESSION = 20_000, 4_000


class _Refused(Exception):
    """Why a piece of code is refused."""


class _Guard(ast.NodeVisitor):
    """Visits every node of a tree and refuses imports, names and attributes that are not allowed."""

    def visit_Import(self, node: ast.Import) -> None:
        self._modules(a.name for a in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self._modules([node.module or ""])

    def _modules(self, names) -> None:
        if any(name.partition(".")[0] not in IMPORTS for name in names):
            raise _Refused("import")

    def visit_Name(self, node: ast.Name) -> None:
        if node.id in FORBIDDEN:
            raise _Refused("name")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if node.attr.startswith("__"):
            raise _Refused("dunder")
        self.visit(node.value)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and "__" in node.value:
            raise _Refused("dunder")


def code_problem(code: str | None, expression: bool = False) -> str | None:
    """Why code, or a test expression, is refused; null if it is not. Of several reasons the first in the text counts."""
    text = (code or "").strip()
    if not text:
        return "empty"
    if len(text) > (LONGEST_EXPRESSION if expression else LONGEST_CODE):
        return "too long"
    try:
        _Guard().visit(ast.parse(text, mode="eval" if expression else "exec"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "syntax"
    except _Refused as refused:
        return str(refused)
    return None


@F.pandas_udf(T.StringType())
def unsafe_code(code: pd.Series) -> pd.Series:
    return code.map(code_problem)


#: Calls that a test may make beside what the code defines or imports.
TEST_CALLS = frozenset(
    [
        "abs",
        "all",
        "any",
        "bool",
        "dict",
        "enumerate",
        "filter",
        "float",
        "int",
        "len",
        "list",
        "map",
        "max",
        "min",
        "pow",
        "range",
        "reversed",
        "round",
        "set",
        "sorted",
        "str",
        "sum",
        "tuple",
        "zip",
    ]
)


class _Names(ast.NodeVisitor):
    """Names that code defines or imports, at any depth, and names it calls."""

    def __init__(self) -> None:
        self.defined: set[str] = set()
        self.imported: set[str] = set()
        self.called: set[str] = set()

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.defined.add(node.name)
        elif isinstance(node, ast.alias):
            self.imported.add(node.asname or node.name.partition(".")[0])
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            self.called.add(node.func.id)
        super().generic_visit(node)


def names_of(code: str) -> _Names:
    names = _Names()
    names.visit(ast.parse(code.strip()))
    return names


def contract_problem(code: str | None, signature: str | None, calls: list[str]) -> str | None:
    """The code must define the function of the signature, and tests may call only what it defines or imports and TEST_CALLS."""
    try:
        own = names_of(code or "")
        head, bracket, _ = (signature or "").strip().partition("(")
        if bracket and head.strip().isidentifier() and head.strip() not in own.defined:
            return f"{head.strip()} is not defined"
        for call in calls:
            if missing := sorted(names_of(call).called - own.defined - own.imported - TEST_CALLS):
                return f"{missing[0]} is not defined"
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "syntax"
    return None


@F.pandas_udf(T.StringType())
def contract_fault(code: pd.Series, signature: pd.Series, calls: pd.Series) -> pd.Series:
    """contract_problem as a column; null if the contract holds."""
    return pd.Series([contract_problem(c, s, [] if k is None else list(k)) for c, s, k in zip(code, signature, calls, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def forbidden_keys(document: pd.Series, keys: pd.Series) -> pd.Series:
    """Keys of a JSON text, at any depth, that are in the row's list; sorted. Text that is no JSON has none."""

    def search(value: object, wanted: set[str], found: set[str]) -> None:
        stack = [value]
        while stack:
            item = stack.pop()
            if isinstance(item, dict):
                found |= wanted & item.keys()
                stack += item.values()
            elif isinstance(item, list):
                stack += item

    out = []
    for text, wanted in zip(document, keys, strict=True):
        found: set[str] = set()
        try:
            search(json.loads(text) if text else None, set(wanted), found)
        except (ValueError, RecursionError):
            pass
        out.append(sorted(found))
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def token_range(tokens: pd.Series, wanted: pd.Series) -> pd.Series:
    """[start, end) of the first place where the wanted ids stand in the ids; null without one."""

    def find(ids, part):
        if ids is None or part is None or not len(part):
            return None
        ids, part = list(ids), list(part)
        return next(([i, i + len(part)] for i in range(len(ids) - len(part) + 1) if ids[i : i + len(part)] == part), None)

    return pd.Series([find(a, b) for a, b in zip(tokens, wanted, strict=True)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def printed_outputs(stdout: pd.Series, marker: pd.Series) -> pd.Series:
    """outputs_of as a column."""
    return pd.Series([outputs_of(o, m) for o, m in zip(stdout, marker, strict=True)])


def outputs_of(stdout: str | None, marker: str) -> dict[str, str]:
    """Lines marker::index::repr as a map; the last line of an index wins, a repr that is no literal stays text."""
    out: dict[str, str] = {}
    for line in (stdout or "").splitlines():
        head, _, rest = line.partition("::")
        index, mark, text = rest.partition("::")
        if head == marker and mark:
            try:
                out[index] = str(ast.literal_eval(text))
            except (ValueError, SyntaxError):
                out[index] = text
    return out
