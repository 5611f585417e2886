"""Text helpers as column expressions; NFKC and balanced braces go through Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores, Unicode-aware, no NFKC."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def text_hash(text: Column, compatible: bool = True) -> Column:
    """SHA-256 of the collapsed text, after NFKC if `compatible`. Texts without a word character share the hash of the empty string."""
    return F.sha2(collapsed(nfkc(text) if compatible else text), 256)


def ascii_hash(text: Column) -> Column:
    """The hash over ASCII letters, digits and underscores only, which SQL engines without Unicode classes can reproduce."""
    return F.sha2(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", ""), 256)


def content_id(prefix: str, text: Column) -> Column:
    """prefix_ and the first 16 hex digits of the text's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 16))


def identifier_tokens(text: Column) -> Column:
    """Different lower-case identifiers, numbers and single CJK characters of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]*|[0-9]+|[\x{4e00}-\x{9fff}])"), F.lit(1)))


def lexical_tokens(text: Column) -> Column:
    """Different lower-case words that start with a letter, and numbers; no leading underscore, no CJK."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9_]*|[0-9]+)"), F.lit(1)))


def safe_label(label: Column, default: str = "adapter") -> Column:
    """Runs of anything but letters, digits, dot, underscore and hyphen become one underscore; none at the ends."""
    clean = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_.-]+", "_"), r"^[_.-]+|[_.-]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(default)).otherwise(clean)


def message_text(parts: Column) -> Column:
    """Texts of a list of message parts (type, text), joined by line breaks; parts of other types are left out."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def chatml(messages: Column) -> Column:
    """Messages (role, content) in ChatML with the assistant's turn opened at the end."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def math_text(text: Column) -> Column:
    """Trimmed, without thin spaces, blanks and one dollar sign at either end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"\\,| ", ""), r"^\$|\$$", ""))


def json_object(text: Column) -> Column:
    """The JSON object in a reply: fences stripped, else from the first opening to the last closing brace, as variant or null."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))))
