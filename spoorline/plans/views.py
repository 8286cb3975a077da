"""The driver's tables seen as an event log, functions, chains and graphs. oracle.py has the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import last_wins

#: Event type -> the sensitive name it stands for; misc.noop isn't in the catalog.
NAMES = {"click": "fs.readFile", "view": "os.hostname", "purchase": "https.request", "signup": "child_process.exec", "error": "misc.noop"}
#: line, module, property, full name, domain, behaviour; the later of two rows of one name holds.
CATALOG = [
    (1, "fs", "readFile", "fs.readFile", "File", "File Deletion"),
    (2, "os", "hostname", "os.hostname", "Environment", "Environment Information Retrieval"),
    (3, "https", "request", "https.request", "Network", "Data Transmission"),
    (4, "child_process", "exec", "child_process.exec", "Process", "Command Execution"),
    (5, "fs", "readFile", "fs.readFile", "File", "File Reading"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    return last_wins(spark.createDataFrame(CATALOG, "line int, module string, property string, full_name string, domain string, behavior string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkg (five users), idx (0, 1, ... in each package), event_id, user_id, event_type, qn, file, line, args."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    qn = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("event_type")]
    file = F.when(u % 5 == 0, F.concat(F.lit("package/src/f"), u, F.lit(".js"))).otherwise(F.concat(F.lit("package/node_modules/p"), u % 7, F.lit("/f"), u, F.lit(".js")))
    e = e.select(F.floor(u / 5).alias("pkg"), "ts", "event_id", "user_id", "event_type", qn.alias("qn"), file.alias("file"), F.get_json_object("props", "$.k").cast("long").alias("line"), F.col("props").alias("args"))
    return e.withColumn("idx", (F.row_number().over(Window.partitionBy("pkg").orderBy("ts", "event_id")) - 1).cast("long")).drop("ts")


def functions(ev: DataFrame) -> DataFrame:
    """pkg, file, sl, el, fid: each file's blocks of ten lines, and of fifty."""
    ten = ev.select("pkg", "file", (F.floor(F.col("line") / 10) * 10).alias("sl")).distinct().withColumn("el", F.col("sl") + 9)
    fifty = ev.select("pkg", "file", (F.floor(F.col("line") / 50) * 50).alias("sl")).distinct().withColumn("el", F.col("sl") + 49)
    return ten.unionByName(fifty).withColumn("fid", F.concat("file", F.lit(":"), "sl", F.lit(":"), "el"))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g (the event's quarter of a day), src, dst, label: arcs between users and lines, a graph for each quarter."""
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type").isin("click", "view"), "DDG").when(F.col("event_type") == "purchase", "Object_Data").otherwise("CFG")
    g = F.date_diff("ts", F.lit("2024-01-01").cast("date")) * 4 + F.floor(F.hour("ts") / 6)
    return e.select(g.cast("long").alias("g"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), label.alias("label")).distinct()


def chains(ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, roots, anchors) of a log: a chain for each user modulo seven, anchors at signups on lines below 30 but for chains 2, 5."""
    c = ev.select("pkg", (F.col("user_id") % 7).alias("chain")).distinct().withColumn("chain_ord", F.col("chain"))
    own = c.select("pkg", "chain", F.concat(F.lit("node_modules/p"), "chain", F.lit("/")).alias("root"))
    more = c.where("chain % 2 = 1").select("pkg", "chain", F.concat(F.lit("node_modules/p"), F.col("chain") - 1, F.lit("/")).alias("root"))
    anchors = ev.where((F.col("event_type") == "signup") & (F.col("line") < 30) & (F.col("user_id") % 7 % 3 != 2)).select("pkg", (F.col("user_id") % 7).alias("chain"), "idx")
    return c, own.unionByName(more), anchors
