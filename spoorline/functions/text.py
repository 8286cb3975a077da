"""Statements, commands, addresses and identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def end_position(line: Column, col: Column, code: Column) -> Column:
    """struct(line, col) where code that starts at (line, col) ends."""
    parts = F.split(code, r"\r\n|\n|\r", -1)
    breaks = F.size(parts) - 1
    return F.struct((line + breaks).alias("line"), F.when(breaks == 0, col + F.length(code)).otherwise(F.length(F.element_at(parts, -1))).alias("col"))


def call_end(line: Column, col: Column, code: Column) -> Column:
    """struct(line, col): a lower bound of where a call ends whose code may be cut off; a written \\n breaks the line too."""
    parts = F.split(F.regexp_replace(code, r"^\s+|\s+$", ""), r"\n|\\n", -1)
    breaks = F.size(parts) - 1
    return F.struct((line + breaks).alias("line"), F.when(breaks == 0, col + F.length(F.get(parts, F.lit(0)))).otherwise(F.length(F.element_at(parts, -1))).alias("col"))


def whole_numbers(values: Column) -> Column:
    """Node numbers that a judge gave as texts: whole and decimal numbers, the latter cut off; others are left out."""
    number = F.transform(values, lambda x: F.when(F.trim(x).rlike(r"^-?\d+(\.\d+)?$"), F.floor(F.abs(F.trim(x).try_cast("double"))).cast("long") * F.when(F.startswith(F.trim(x), F.lit("-")), -1).otherwise(1)))
    return F.filter(number, lambda x: x.isNotNull())


def eval_preview(args: Column, most: int = 3, chars: int = 4000) -> Column:
    """The texts that an eval was given, on one line: the first few, each cut, and how many there are more."""
    flat = F.transform(F.filter(F.slice(args, 1, most), lambda a: a.isNotNull()), lambda a: one_line(a))
    cut = F.transform(flat, lambda a: F.concat(F.lit("`"), F.substring(a, 1, chars), F.when(F.length(a) > chars, F.concat(F.lit("...("), F.length(a) - chars, F.lit(" more chars truncated)"))).otherwise(""), F.lit("`")))
    more = F.when(F.size(args) > most, F.array(F.concat(F.lit("...("), F.size(args) - most, F.lit(" additional unique source variant(s) omitted)")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(cut) > 0, F.array_join(F.concat(cut, more), " | ")).otherwise("<no resolved source captured>")


def script_targets(command: Column) -> Column:
    """The script files that a command line hands to node, one string of them for each node call."""
    return F.regexp_extract_all(command, F.lit(r"\bnode\s+((?:[\w./-]+\.(?:js|cjs|mjs)\s*)+)"), F.lit(1))


def node_ids(text: Column) -> Column:
    """The numbers of all [Node ID: n] marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[Node ID: (\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def url_fields(url: Column) -> Column:
    """struct(protocol, host, port, path); the port is a string, and null where the address has none."""
    part = lambda n: F.nullif(F.regexp_extract(url, r"^(https?):\/\/([^\/:?#]+)(?::(\d+))?(\/[^?#]*)?", n), F.lit(""))
    return F.struct(part(1).alias("protocol"), part(2).alias("host"), part(3).alias("port"), F.coalesce(part(4), F.lit("/")).alias("path"))


def status_of(judgement: Column) -> Column:
    """benign, malicious, undetermined -> the status that a report shows."""
    return F.when(judgement == "malicious", "Malicious Code").when(judgement == "undetermined", "Undetermined").otherwise("Benign")
