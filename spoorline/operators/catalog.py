"""The catalog of sensitive operations, and the lookup of names in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("module", "property", "full_name", "domain", "behavior")
#: Domains whose arguments are resolved.
RESOLVED_DOMAINS = ("Process", "File", "Network")


def last_wins(rows: DataFrame, line: str = "line") -> DataFrame:
    """Of the rows of each (module, property), the one with the greatest line. Their number is the catalog's, not the data's."""
    w = Window.partitionBy("module", "property").orderBy(F.col(line).desc())
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*COLUMNS)


def lookup(df: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """df with full_name, domain and behavior of the catalog's row for its dotted name, or nulls.

    The name's first segment is the module, the rest the property; a name of one segment matches nothing. Spark broadcasts the
    catalog by its size.
    """
    keys = catalog.select(F.col("module").alias("__m"), F.col("property").alias("__p"), "full_name", "domain", "behavior")
    first, rest = F.substring_index(name, ".", 1), F.expr(f"CASE WHEN instr({name}, '.') > 0 THEN substr({name}, instr({name}, '.') + 1) END")
    return df.join(keys, (first == F.col("__m")) & (rest == F.col("__p")), "left").drop("__m", "__p")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog in CSV, its first line a header: rows of exactly five fields (module, property, full name, domain, behaviour), of equal
    (module, property) the last. The header isn't read by name: it may have fewer names than the rows have fields."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "x")).where("line > 0")
    field = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
    f = whole.withColumn("f", F.regexp_extract_all("x", F.lit(field), F.lit(1))).where((F.size("f") == 5) & (F.col("x") != ""))
    plain = lambda c: F.replace(F.regexp_replace(c, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return last_wins(f.select("line", *[plain(F.col("f")[k]).alias(c) for k, c in enumerate(COLUMNS)]))


def sensitive(events: DataFrame, calls: DataFrame, properties: DataFrame, kind: str, name: str) -> DataFrame:
    """events with the row of the catalog of their kind: function events by calls, others by properties."""
    is_call = F.col(kind) == "function"
    return lookup(events.where(is_call), calls, name).unionByName(lookup(events.where(~F.coalesce(is_call, F.lit(False))), properties, name))
