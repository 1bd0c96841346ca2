"""Results as JSON, XML, Markdown or plain text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(results: DataFrame, code: str = "code") -> DataFrame:
    return results.agg(F.count("*").alias("count"), F.coalesce(F.sum(F.octet_length(code)), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.greatest(F.lit(1), F.floor(F.octet_length(code) / 4))), F.lit(0)).alias("total_tokens"))


VERSION = "0.2.0"
# What code fences call a language, by extension.
FENCES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "php": "php", "sh": "bash", "md": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "html": "html", "css": "css", "sql": "sql", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "cs": "csharp", "scala": "scala", "dart": "dart", "ex": "elixir", "exs": "elixir",
    "hs": "haskell", "clj": "clojure", "lua": "lua", "r": "r", "pl": "perl", "pm": "perl", "proto": "protobuf",
}


def fence(path: Column) -> Column:
    """The language of a code fence; empty for extensions that have none."""
    ext = F.regexp_extract(path, r"\.(\w+)$", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])[ext], F.lit(""))


def _part(name: str) -> Column:
    """A column of a result as text; null is empty, so that a row never goes whole."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def json_rows(results: DataFrame) -> DataFrame:
    """All columns, whatever their names, as an object a row; nulls keep their keys."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def json_document(results: DataFrame, **more: str) -> DataFrame:
    """One row a result, then one with the summary and the version: (part, json), the pieces of one document.

    A writer puts the pieces of ``results`` between brackets; nothing is
    gathered in one task. more: texts that go along, such as the
    ``system_prompt``, ``user_instructions`` and ``original_input`` of an extraction.
    """
    end = F.struct(F.struct("count", "total_bytes", "total_tokens").alias("summary"), F.lit(VERSION).alias("version"), *[F.lit(v).alias(k) for k, v in more.items()])
    return json_rows(results).select(F.lit("results").alias("part"), "json").unionByName(summary(results).select(F.lit("summary").alias("part"), F.to_json(end).alias("json")))


def dry_run(results: DataFrame) -> DataFrame:
    """The results without their text."""
    return results.drop("code")


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_rows(results: DataFrame) -> DataFrame:
    """A row of (path, start, end, code) as an element; null path, lines or code are empty."""
    code = F.replace(_part("code"), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return results.select(F.concat(F.lit("<result><file>"), escape(_part("path")), F.lit("</file><lines>"), _part("start"), F.lit("-"), _part("end"), F.lit("</lines><code><![CDATA["), code, F.lit("]]></code></result>")).alias("xml"))


def xml_summary(results: DataFrame) -> DataFrame:
    tag = lambda c: F.concat(F.lit(f"<{c}>"), F.col(c).cast("string"), F.lit(f"</{c}>"))
    return summary(results).select(F.concat(F.lit("<summary>"), tag("count"), tag("total_bytes"), tag("total_tokens"), F.lit("</summary>")).alias("xml"))


def markdown_rows(results: DataFrame) -> DataFrame:
    """A row of (path, start, end, code) under a heading, in a fence of its language; nulls are empty."""
    return results.select(F.concat(F.lit("## "), _part("path"), F.lit(":"), _part("start"), F.lit("-"), _part("end"), F.lit("\n```"), fence(F.col("path")), F.lit("\n"), _part("code"), F.lit("\n```")).alias("markdown"))


def plain_rows(results: DataFrame) -> DataFrame:
    """A row of (path, start, end, code) as plain lines; nulls are empty."""
    return results.select(F.concat(F.lit("File: "), _part("path"), F.lit("\nLines: "), _part("start"), F.lit("-"), _part("end"), F.lit("\n"), _part("code"), F.lit("\n")).alias("plain"))


def highlighted(text: Column, terms: list[str], on: str = "\x1b[1;33m", off: str = "\x1b[0m") -> Column:
    """Terms in a text between marks, whatever the case; the longest first."""
    if not terms:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")", f"{on}$1{off}")
