"""Package files as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of binary formats, in hexadecimal: fixed values.
MAGIC = ("7F454C46", "4D5A", "CAFEBABE", "CFFAEDFE", "CEFAEDFE", "FEEDFACE", "FEEDFACF", "0061736D")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, content) of all files below a folder; path is relative to it. Content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.expr(f"substr(regexp_replace(path, '^[a-z]+:/+', '/'), {len(root) + 1})").alias("path"), F.col("length").alias("size"), "content")


def scripts(files: DataFrame) -> DataFrame:
    """JavaScript files outside node_modules."""
    return files.where(F.col("path").rlike(r"\.(js|cjs|mjs)$") & ~F.contains("path", F.lit("node_modules")))


def without_modules(files: DataFrame) -> DataFrame:
    """A package's own files: none below node_modules."""
    return files.where(~F.concat(F.lit("/"), F.col("path")).contains("/node_modules/"))


def rewritten(files: DataFrame, tool: Callable[[str], str], text: str = "text") -> DataFrame:
    """files with what a tool, as a deobfuscator, makes of each text; a text that it fails on stays as it is."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else tool(x)
        except Exception:  # one file's failure is its own
            return x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[text] = b[text].map(one)
            yield b

    return files.mapInPandas(run, files.schema)


def preprocessed(files: DataFrame, tool: Callable[[str], str] | None = None, text: str = "text") -> DataFrame:
    """A package's own scripts as they are analysed: what the tool makes of them, with isolated evals of plain text as functions."""
    from ..functions.javascript import evals_inlined

    own = scripts(files)
    return (rewritten(own, tool, text) if tool else own).withColumn(text, evals_inlined(text))


def resolved(wanted: DataFrame, files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """wanted (by, path) with `file`, the first of the files (by, path) that its path may mean, and its text; null without one."""
    from ..functions import file_candidates

    c = wanted.select(*by, path).distinct().select(*by, path, F.posexplode(file_candidates(F.col(path))).alias("__k", "file"))
    found = c.join(files.select(*by, F.col("path").alias("file"), "text"), [*by, "file"]).groupBy(*by, path).agg(F.min_by(F.struct("file", "text"), "__k").alias("f"))
    return wanted.join(found.select(*by, path, "f.file", "f.text"), [*by, path], "left")


def lines(files: DataFrame) -> DataFrame:
    """(path, lines): text by lines; an empty list where the bytes aren't UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1)).alias("lines"))


def is_binary(content: Column) -> Column:
    """A known first few bytes, or a NUL among the first eight."""
    head = F.hex(F.substring(content, 1, 8))
    known = F.lit(False)
    for m in MAGIC:
        known = known | F.startswith(head, F.lit(m))
    return known | head.rlike(r"^(..)*00")


def read_status(wanted: DataFrame, files: DataFrame, by: list[str], path: str = "path", pos: str = "pos", budget: int = 5) -> DataFrame:
    """wanted (by, pos, path) with status, checked in order: budget_exhausted, bare, out_of_scope, binary_extension, not_found,
    already_visited, binary, ok."""
    from pyspark.sql import Window

    f = files.select(F.col("path").alias(path), is_binary(F.col("content")).alias("__bin"))
    w = wanted.join(f, path, "left").withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(pos))).withColumn("__again", F.row_number().over(Window.partitionBy(*by, path).orderBy(pos)) > 1)
    p = F.col(path)
    status = (
        F.when(F.col("__k") > budget, "budget_exhausted")
        .when(~F.contains(p, F.lit("/")) & ~F.contains(p, F.lit(".")), "bare")
        .when(p.rlike(r"^(/|[A-Za-z]:|\.\.)|/\.\./"), "out_of_scope")
        .when(p.rlike(r"(?i)\.(node|exe|dll|so|dylib|wasm|bin)$"), "binary_extension")
        .when(F.col("__bin").isNull(), "not_found")
        .when(F.col("__again"), "already_visited")
        .when(F.col("__bin"), "binary")
        .otherwise("ok")
    )
    return w.withColumn("status", status).drop("__bin", "__k", "__again")
