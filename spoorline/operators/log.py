"""The ordered log of runtime events. Each package's log is a partition of its own: `by` names its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admissible(file: Column) -> Column:
    """Events that no file of the runtime itself has made."""
    return file.isNull() | ~F.startswith(file, F.lit("node"))


def last_wins(events: DataFrame, by: list[str], key: list[str], pos: str) -> DataFrame:
    """A later event of the same key replaces an earlier one and takes the later place; a key with a null in it never does.

    Adds log_index, from 0 in each package. The duplicates of a key are one aggregation, not a sort of the key's rows.
    """
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    rest = [c for c in events.columns if c not in (*by, *key, pos)]
    lone = F.when(null, F.col(pos))  # its place makes a key with nulls unique
    last = events.groupBy(*by, *key, lone.alias("__lone")).agg(F.max(F.struct(pos, *rest)).alias("__e"))
    last = last.select(*by, *key, f"__e.{pos}", *[f"__e.{c}" for c in rest])
    return last.withColumn("log_index", F.row_number().over(Window.partitionBy(*by).orderBy(pos)) - 1)


def backfill(events: DataFrame, by: list[str], args: str, result: str, pos: str, is_callback: Column) -> DataFrame:
    """The events that are no callbacks; the last of each non-empty arguments gets the result of their last callback."""
    callbacks = events.where(is_callback & (F.col(args) != "")).groupBy(*by, args).agg(F.max_by(result, pos).alias("__result"))
    calls = events.where(~is_callback)
    target = calls.where(F.col(args) != "").groupBy(*by, args).agg(F.max(pos).alias(pos)).join(callbacks, [*by, args]).select(*by, pos, F.struct("__result").alias("__found"))
    return calls.join(target, [*by, pos], "left").withColumn(result, F.when(F.col("__found").isNotNull(), F.col("__found.__result")).otherwise(F.col(result))).drop("__found")


def sources_of_calls(trace: DataFrame, by: list[str], pos: str, is_call: Column, value: str) -> DataFrame:
    """(by, pos, call, source): each source with the nearest call before it; those before any call go."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = trace.withColumn("__is", is_call).withColumn("call", F.last(F.when(F.col("__is"), F.col(value)), ignorenulls=True).over(w))
    return seen.where(~F.col("__is") & F.col("call").isNotNull()).select(*by, pos, "call", F.col(value).alias("source"))


def distinct_args(events: DataFrame, by: list[str], args: str, pos: str) -> DataFrame:
    """(by, n, args): how many events, and their distinct arguments in order of first occurrence."""
    first = events.groupBy(*by, args).agg(F.min(pos).alias("__p"), F.count("*").alias("__n"))
    return first.groupBy(*by).agg(F.sum("__n").alias("n"), F.transform(F.sort_array(F.collect_list(F.when(F.col(args).isNotNull(), F.struct("__p", args)))), lambda x: x[args]).alias("args"))
