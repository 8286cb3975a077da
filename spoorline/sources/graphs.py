"""Graphs in GraphML and DOT as nodes and edges. Every row has its file's path: ids are a file's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.syntax import parameter_arcs

_DATA = "array<struct<_key:string,_VALUE:string>>"
#: Attributes that DOT nodes carry, with the columns they become: fixed names.
ATTRIBUTES = {"NAME": "name", "FULL_NAME": "full_name", "FILENAME": "file", "CODE": "code", "LINE_NUMBER": "line", "LINE_NUMBER_END": "line_end", "COLUMN_NUMBER": "col", "COLUMN_NUMBER_END": "col_end"}


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: path, id, label, attrs; edges: path, src, dst, labels): parallel edges are one with all their labels."""

    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("path", F.col("_metadata.file_path"))

    attrs = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = read("node", f"_id string, data {_DATA}").select("path", F.col("_id").cast("long").alias("id"), attrs.alias("a"))
    nodes = nodes.select("path", "id", F.coalesce(F.col("a")["labelV"], F.col("a")["label"]).alias("label"), F.map_filter("a", lambda k, _: ~k.isin("labelV", "label")).alias("attrs"))
    edges = read("edge", f"_source string, _target string, data {_DATA}").select("path", F.col("_source").cast("long").alias("src"), F.col("_target").cast("long").alias("dst"), attrs.alias("a"))
    edges = edges.select("path", "src", "dst", F.coalesce(F.col("a")["labelE"], F.col("a")["label"]).alias("label"))
    return nodes, edges.groupBy("path", "src", "dst").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def syntax_nodes(nodes: DataFrame) -> DataFrame:
    """GraphML nodes with the attributes that syntax trees are read by as columns: name, code, ord, arg, line, col."""
    a = lambda k: F.col("attrs")[k]
    return nodes.select("path", "id", "label", a("NAME").alias("name"), a("CODE").alias("code"), *[a(k).try_cast("int").alias(c) for k, c in (("ORDER", "ord"), ("ARGUMENT_INDEX", "arg"), ("LINE_NUMBER", "line"), ("COLUMN_NUMBER", "col"))], "attrs")


def dot(spark: SparkSession, path: str, empty_label: str = "CFG") -> tuple[DataFrame, DataFrame]:
    """(nodes: path, pos, id, label, attrs; edges: path, src, dst, label) of DOT files, read whole, an element a line or several lines.

    Edges labelled only "DDG: " or "CDG: " go; an empty label becomes empty_label. pos is a node's place in its file, from 0.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    element = r'(?m)^\s*("?\d+"?(?:\s*->\s*"?\d+"?)?)\s*\[((?:[^"\]]|"(?:[^"\\]|\\.)*")*)\]'
    each = whole.select("path", F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(element), F.lit(1)).alias("head"), F.regexp_extract_all("value", F.lit(element), F.lit(2)).alias("attrs"))).alias("pos", "e")).select("path", "pos", "e.*")
    pair = r'(\w+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s",\]]+))'
    keys, quoted, bare = (F.regexp_extract_all("attrs", F.lit(pair), F.lit(k)) for k in (1, 2, 3))
    value = lambda p: F.replace(F.replace(F.when(p["q"] != "", p["q"]).otherwise(p["b"]), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    entries = F.transform(F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")), lambda p: F.struct(p["k"], value(p)))
    # of an attribute given twice the later holds
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"]))
    each = each.withColumn("a", F.map_from_entries(last)).withColumn("ids", F.regexp_extract_all("head", F.lit(r"\d+"), F.lit(0)))
    edges = each.where("size(ids) = 2").select("path", F.col("ids")[0].cast("long").alias("src"), F.col("ids")[1].cast("long").alias("dst"), F.coalesce(F.col("a")["label"], F.lit("")).alias("label"))
    edges = edges.where(~F.col("label").isin("DDG: ", "CDG: ")).withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit(empty_label)))
    nodes = each.where("size(ids) = 1").select("path", "pos", F.col("ids")[0].cast("long").alias("id"), F.col("a")["label"].alias("label"), F.map_filter("a", lambda k, _: k != "label").alias("attrs"))
    return nodes, edges


def graph_name(path: Column) -> Column:
    """What the two files of a function have in common: the name up to -pdg or -cfg, with the folder above their own."""
    return F.regexp_replace(F.regexp_replace(path, r"-(pdg|cfg)\.dot$", ""), r"/(pdg|cfg)/(\d+)$", "/$2")


def programs(nodes: DataFrame) -> DataFrame:
    """(path, pdg, name, full_name, file, sl, sc, el, ec, type, nodes): what a function's graph says of it, by its first node;
    type program, lambda or function."""
    a = lambda k: F.col("n.attrs")[k]
    first = nodes.groupBy("path").agg(F.min_by(F.struct("id", "attrs"), "pos").alias("n"), F.count("*").alias("nodes"))
    name = a("NAME")
    kind = F.when(name == ":program", "program").when(name.rlike("<lambda>"), "lambda").otherwise("function")
    number = lambda k, c: a(k).try_cast("int").alias(c)
    return first.select("path", F.col("n.id").alias("pdg"), name.alias("name"), a("FULL_NAME").alias("full_name"), F.trim(a("FILENAME")).alias("file"), number("LINE_NUMBER", "sl"), number("COLUMN_NUMBER", "sc"), number("LINE_NUMBER_END", "el"), number("COLUMN_NUMBER_END", "ec"), kind.alias("type"), "nodes")


def merged(pdg: DataFrame, cfg: DataFrame, attributes: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A function's two graphs as one: (edges: by, src, dst, labels; nodes: by, id, type, code and what the attributes say).

    pdg and cfg: edges (by, src, dst, label); attributes (by, id, label, code, ...) of the parser's whole tree. A function whose
    second graph is missing is left out; edges into return nodes go; labels keep those of the first graph before the second's.
    """
    by = by or ["path"]
    both = pdg.join(cfg.select(*by).distinct(), by, "left_semi").withColumn("__o", F.lit(0)).unionByName(cfg.join(pdg.select(*by).distinct(), by, "left_semi").withColumn("__o", F.lit(1)))
    returns = attributes.where("label = 'METHOD_RETURN'").select(*by, F.col("id").alias("dst"))
    kept = both.join(returns, [*by, "dst"], "left_anti")
    labels = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__o", "label"))), lambda x: x["label"]))
    ids = both.select(*by, F.col("src").alias("id")).unionByName(both.select(*by, F.col("dst").alias("id"))).distinct()
    nodes = ids.join(attributes, [*by, "id"], "left").withColumnRenamed("label", "type")
    nodes = nodes.withColumn("code", F.replace(F.coalesce("code", F.lit("")), F.lit("\n"), F.lit("\\n")))
    shown = F.concat(F.lit("["), "id", F.lit("]["), F.coalesce("line", F.lit(0)), F.lit(":"), F.coalesce("col", F.lit(0)), F.lit("]["), F.coalesce("type", F.lit("")), F.lit("]"), F.when(F.col("type") == "CALL", F.concat(F.lit(": "), "code")).otherwise(""))
    return kept.groupBy(*by, "src", "dst").agg(labels.alias("labels")), nodes.withColumn("shown", shown)


def functions(spark: SparkSession, pdg_path: str, cfg_path: str, attributes: DataFrame, formals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(programs, edges, nodes) of all functions of a folder of graphs, each merged with its control flow and the parser's attributes (id,
    label, name, code, line, col), with arcs from methods to parameters. Files that don't parse have no rows and hold up no other."""
    n, p = dot(spark, pdg_path)
    _, c = dot(spark, cfg_path)
    own = lambda df: df.withColumn("path", graph_name(F.col("path")))
    n = own(n)
    a = n.select("path", "id").unionByName(own(c).select("path", F.explode(F.array("src", "dst")).alias("id"))).distinct().join(attributes, "id")
    edges, nodes = merged(own(p), own(c), a)
    lead = parameter_arcs(nodes.select(F.lit(1).alias("g"), F.col("path").alias("pdg"), "id", F.col("type").alias("label"), "name", "code"), formals.withColumn("g", F.lit(1)), ["g"])
    where = nodes.select("path", F.col("id").alias("src"))
    more = lead.select("src", "dst", F.array("label").alias("labels")).join(where, "src").select("path", "src", "dst", "labels")
    both = edges.unionByName(more).groupBy("path", "src", "dst").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    return programs(n), both, nodes


def first_of_each(nodes: DataFrame) -> DataFrame:
    """(path, id): each graph's first node, its entrance."""
    w = Window.partitionBy("path").orderBy("pos")
    return nodes.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("path", "id")
