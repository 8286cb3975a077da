"""Syntax trees that a parser has given as rows: nodes (by, id, label, name, code, ord, arg, line, col) and edges (by, src, dst, label).

Edges AST lead from a node to its parts, ARGUMENT to what a call is given, CALL to what it enters. Trees have no cycles; a walk up is
a frontier loop over all nodes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import stored


def children(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, parent, id, pos): a node's parts from 0 in order of their ord; those without one, or with one below 0, come last, by id."""
    kids = edges.where("label = 'AST'").select(*by, F.col("src").alias("parent"), F.col("dst").alias("id")).distinct().join(nodes.select(*by, "id", "ord"), [*by, "id"])
    return _placed(kids, by, "parent", F.when(F.col("ord") >= 0, 0).otherwise(1), F.when(F.col("ord") >= 0, F.col("ord")))


def _placed(kids: DataFrame, by: list[str], of: str, *order: Column) -> DataFrame:
    rows = kids.groupBy(*by, of).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], "id"))).alias("__kids"))
    return rows.select(*by, of, F.posexplode("__kids").alias("pos", "__k")).select(*by, of, "__k.id", "pos")


def parent(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, parent): of several the least."""
    return edges.where("label = 'AST'").groupBy(*by, F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def arguments(nodes: DataFrame, edges: DataFrame, by: list[str], receivers: bool = False) -> DataFrame:
    """(by, call, id, pos): what a call is given, in order of arg, from 1; with receivers what has an arg below 1."""
    given = edges.where("label = 'ARGUMENT'").select(*by, F.col("src").alias("call"), F.col("dst").alias("id")).distinct().join(nodes.select(*by, "id", "arg"), [*by, "id"])
    return _placed(given.where("arg < 1" if receivers else "arg >= 1"), by, "call", F.col("arg"))


def first_own_part(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, call, id): each call's first part that isn't one of its arguments."""
    given = arguments(nodes, edges, by).select(*by, F.col("call").alias("parent"), "id")
    own = children(nodes, edges, by).join(given, [*by, "parent", "id"], "left_anti")
    return own.groupBy(*by, F.col("parent").alias("call")).agg(F.min_by("id", "pos").alias("id"))


def entered(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, method): what a call's edge CALL leads to; of several the greatest."""
    return edges.where("label = 'CALL'").groupBy(*by, F.col("src").alias("id")).agg(F.max("dst").alias("method"))


def enclosing_method(nodes: DataFrame, edges: DataFrame, by: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(by, id, method, name): the nearest method around each (wanted) node that is no lambda; nodes without one are left out.

    All nodes climb at once: a round is a join with the parents, and a node that has found its method leaves.
    """
    up = stored(parent(edges, by).join(nodes.select(*by, F.col("id").alias("parent"), (F.coalesce((F.col("label") == "METHOD") & ~F.contains("name", F.lit("<lambda>")), F.lit(False))).alias("stop"), "name"), [*by, "parent"]), "parents")
    at = stored((nodes if wanted is None else wanted).select(*by, "id", F.col("id").alias("at")).distinct(), "climb")
    found = None
    while not at.isEmpty():
        step = stored(at.join(up.withColumnRenamed("id", "at"), [*by, "at"]).select(*by, "id", F.col("parent").alias("at"), "stop", "name"), "climb")
        done = step.where("stop").select(*by, "id", F.col("at").alias("method"), "name")
        found = done if found is None else found.unionByName(done)
        at = step.where("NOT stop").select(*by, "id", "at")
    return found if found is not None else nodes.select(*by, "id", F.col("id").alias("method"), "name").where("false")


def deepest_at(ranges: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """places (by, place, line, col) with `id`, the smallest syntax node (by, id, SPAN-like sl, sc, el, ec) that holds the
    place; a node's end is outside. Lines are cut into bins, so that it is an equi join."""
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("sl") / 16), F.floor(F.col("el") / 16))))
    p = places.withColumn("__bin", F.floor(F.col("line") / 16))
    at = F.struct(F.col("line").cast("long"), F.col("col").cast("long"))
    start, end = F.struct(F.col("sl").cast("long"), F.col("sc").cast("long")), F.struct(F.col("el").cast("long"), F.col("ec").cast("long"))
    held = p.join(r, [*by, "__bin"]).where((start <= at) & (at < end))
    size = F.struct((F.col("el") - F.col("sl")).alias("lines"), F.when(F.col("el") == F.col("sl"), F.col("ec") - F.col("sc")).otherwise(F.col("ec")).alias("cols"), (-F.col("depth")).alias("up"), "id")
    return held.groupBy(*by, "place").agg(F.min(size).alias("b")).select(*by, "place", "b.id")


def ancestor_of_type(ranges: DataFrame, parents: DataFrame, starts: DataFrame, by: list[str], fits: Column) -> DataFrame:
    """(by, place, id): for each start (by, place, id) itself or the nearest node around it whose row in ranges fits."""
    known = stored(ranges.select(*by, "id", fits.alias("fits")).join(parents, [*by, "id"], "left"), "types")
    at = stored(starts.select(*by, "place", "id"), "climb")
    found = None
    while not at.isEmpty():
        step = stored(at.join(known, [*by, "id"]), "climb")
        done = step.where("fits").select(*by, "place", "id")
        found = done if found is None else found.unionByName(done)
        at = step.where("NOT coalesce(fits, false) AND parent IS NOT NULL").select(*by, "place", F.col("parent").alias("id"))
    return found if found is not None else starts.select(*by, "place", "id").where("false")


def nearest_statement(ranges: DataFrame, parents: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """The statement or declaration that each start stands in."""
    return ancestor_of_type(ranges, parents, starts, by, F.col("type").rlike("(statement|declaration)$"))


def call_around(ranges: DataFrame, parents: DataFrame, starts: DataFrame, by: list[str], kind: str = "function") -> DataFrame:
    """(by, place, sl, sc, el, ec): the call or construction (function), or member access (property), that each start stands in."""
    types = ("call_expression", "new_expression") if kind == "function" else ("member_expression", "subscript_expression")
    found = ancestor_of_type(ranges, parents, starts, by, F.col("type").isin(*types))
    return found.join(ranges.select(*by, "id", "sl", "sc", "el", "ec"), [*by, "id"]).select(*by, "place", "sl", "sc", "el", "ec")


def this_scope(ranges: DataFrame, parents: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, id): the function, method or class that `this` belongs to; arrow functions have none of their own."""
    return ancestor_of_type(ranges, parents, starts, by, F.col("type").isin("function_declaration", "function_expression", "function", "method_definition", "generator_function_declaration", "class_body"))


def parameter_arcs(nodes: DataFrame, formals: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, label): DDG arcs from a program's method to its parameters. A lambda's parameters count only where its
    source names them: formals (by, pdg, name). nodes (by, pdg, id, label, name, code)."""
    method = nodes.where("label = 'METHOD' AND name IS NOT NULL").groupBy(*by, "pdg").agg(F.max(F.struct("id", "name")).alias("m"))
    p = nodes.where("label = 'METHOD_PARAMETER_IN'").select(*by, "pdg", "id", "code").join(method, [*by, "pdg"])
    is_lambda = F.col("m.name").rlike("<lambda>")
    named = formals.select(*by, "pdg", F.col("name").alias("code")).distinct()
    kept = p.where(~is_lambda).unionByName(p.where(is_lambda).join(named, [*by, "pdg", "code"], "left_semi"), allowMissingColumns=True)
    return kept.select(*by, F.col("m.id").alias("src"), F.col("id").alias("dst"), F.lit("DDG").alias("label"))


def has_data_arc(pairs: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """pairs (by, src, dst) that a data arc joins."""
    return pairs.join(edges.where(F.contains("label", F.lit("DDG"))).select(*by, "src", "dst").distinct(), [*by, "src", "dst"], "left_semi")


def argument_arcs(calls: DataFrame, nodes: DataFrame, edges: DataFrame, bound: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """What arguments add to a graph: (arcs: by, src, dst, label; objects: by, object, dst).

    calls: (by, call, id) as arguments() gives them; nodes: those of the program graph; bound: (by, id, def, object, kind), what
    an identifier holds where it stands, kind telling globals and module-level names. An argument, a call's result, a block's
    statement, and where an identifier was set are arcs into the call, where no data arc is there already; global and
    module-level names give none; what an identifier holds is an object arc. `this` gives nothing but itself.
    """
    n = nodes.select(*by, "id", "label", "name", "code")
    given = calls.join(n, [*by, "id"])
    own = given.select(*by, F.col("id").alias("src"), F.col("call").alias("dst"), F.when(F.col("label") == "CALL", "DDG").otherwise(F.concat(F.lit("DDG: "), F.coalesce("code", F.lit("")))).alias("label"))
    parts = edges.where("label = 'AST'").select(*by, F.col("src").alias("id"), F.col("dst").alias("part")).join(given.where("label = 'BLOCK'").select(*by, "id", "call"), [*by, "id"])
    blocks = parts.select(*by, F.col("part").alias("id"), "call").join(n, [*by, "id"]).select(*by, F.col("id").alias("src"), F.col("call").alias("dst"), F.concat(F.lit("DDG: "), F.coalesce("code", F.lit(""))).alias("label"))
    names = given.where("label = 'IDENTIFIER' AND code <> 'this'").join(bound, [*by, "id"])
    set_ = names.where("def IS NOT NULL AND kind NOT IN ('global', 'file')").select(*by, F.col("def").alias("src"), F.col("call").alias("dst"), F.concat(F.lit("DDG: "), "code").alias("label"))
    inside = parts.select(*by, F.col("part").alias("id"), "call").join(n.where("label = 'CALL' AND name = '<operator>.assignment'"), [*by, "id"]).select(*by, F.col("id").alias("parent"), "call")
    right = children(nodes, edges, by).where("pos = 1").join(inside, [*by, "parent"]).join(n.where("label = 'IDENTIFIER'"), [*by, "id"]).join(bound, [*by, "id"])
    objects = names.select(*by, "object", F.col("call").alias("dst")).unionByName(right.select(*by, "object", F.col("call").alias("dst"))).where("object IS NOT NULL").distinct()
    new = own.unionByName(blocks).unionByName(set_).distinct()
    there = edges.where(F.contains("label", F.lit("DDG"))).select(*by, "src", "dst").distinct()
    return new.join(there, [*by, "src", "dst"], "left_anti"), objects


def without_named(labels: Column) -> Column:
    """Data labels that name a variable, as ones to be left out of the graph."""
    return F.transform(labels, lambda x: F.regexp_replace(x, "^DDG: ", "REMOVE: "))
