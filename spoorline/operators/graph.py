"""Queries on behaviour graphs. A graph is a table of arcs (by, src, dst, label); `by` tells graphs apart.

Walks are frontier loops: a round joins the frontier with the arcs, and an anti join takes out what was visited. What was
visited is one stored table, a folder for each round, so that the plan of a round doesn't grow with their number; the loop ends
when a frontier is empty, after as many rounds as the longest shortest path has arcs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import forget, fresh, stored

#: Labels of data arcs.
DATA = ("DDG", "Object_Data")


def edge_type(labels: Column) -> Column:
    """CFG_DDG, DDG, CFG or REMOVE by what the labels contain, in that order; CFG for all others."""
    has = lambda x: F.exists(labels, lambda y: F.contains(y, F.lit(x)))
    return F.when(has("CFG") & has("DDG"), "CFG_DDG").when(has("DDG"), "DDG").when(has("CFG"), "CFG").when(has("REMOVE"), "REMOVE").otherwise("CFG")


def arcs_of(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, labels) -> (by, src, dst, label): two arcs for CFG_DDG, none for REMOVE, parallel ones once."""
    kind = edges.groupBy(*by, "src", "dst").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels")).withColumn("kind", edge_type(F.col("labels")))
    both = F.when(F.col("kind") == "CFG_DDG", F.array(F.lit("CFG"), F.lit("DDG"))).when(F.col("kind") == "REMOVE", F.array().cast("array<string>")).otherwise(F.array("kind"))
    return kind.select(*by, "src", "dst", F.explode(both).alias("label"))


def flow_type(labels: Column) -> Column:
    """DDG if a label has it, else CFG: what a traversal takes an edge for."""
    return F.when(F.exists(labels, lambda y: F.contains(y, F.lit("DDG"))), "DDG").otherwise("CFG")


def merged_edges(base: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, labels): edges of both; an edge of base keeps its own labels."""
    return base.unionByName(more.join(base.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti"))


def merged_programs(base: tuple[DataFrame, DataFrame], part: tuple[DataFrame, DataFrame], entrances: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices: by, part, v; edges: by, part, src, dst, labels) of a graph with those of parts (by, part) added whose entrance,
    a vertex (by, part, v), isn't in it yet. Vertices and edges that are there stay as they are."""
    vertices, edges = base
    absent = entrances.join(vertices.select(*by, "v").distinct(), [*by, "v"], "left_anti").select(*by, "part")
    more_v = part[0].join(absent, [*by, "part"], "left_semi").drop("part").distinct()
    more_e = part[1].join(absent, [*by, "part"], "left_semi").groupBy(*by, "src", "dst").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    return vertices.unionByName(more_v.join(vertices.select(*by, "v"), [*by, "v"], "left_anti")), merged_edges(edges, more_e, by)


def behavior_graph(nodes: DataFrame, edges: DataFrame, writes: DataFrame, reads: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices: by, v, kind, colour; arcs: by, src, dst, label) of a program's behaviour; vertices without an arc are left out.

    nodes (by, id, type, third_party, sensitive, unresolved); edges (by, src, dst, labels); writes (by, id, object) and reads (by,
    object, id): what nodes give to named objects and take from them. Objects of one name are one vertex, so that all that is
    only known as a wildcard meets in one. Vertices are texts: n: and a node's id, o: and an object's name.
    """
    node, obj = lambda c: F.concat(F.lit("n:"), c), lambda c: F.concat(F.lit("o:"), c)
    flow = arcs_of(edges, by).select(*by, node("src").alias("src"), node("dst").alias("dst"), "label")
    data = writes.select(*by, node("id").alias("src"), obj("object").alias("dst")).unionByName(reads.select(*by, obj("object").alias("src"), node("id").alias("dst"))).distinct()
    arcs = flow.unionByName(data.withColumn("label", F.lit("Object_Data")))
    ends = arcs.select(*by, F.col("src").alias("v")).unionByName(arcs.select(*by, F.col("dst").alias("v"))).distinct()
    drawn = nodes.select(*by, node("id").alias("v"), F.when(F.col("type") == "METHOD", "method").otherwise("node").alias("kind"), colour(F.col("third_party"), F.col("sensitive"), F.col("unresolved"), F.col("type") == "METHOD").alias("colour"))
    objects = ends.where(F.startswith("v", F.lit("o:"))).select(*by, "v", F.lit("object").alias("kind"), F.lit("black").alias("colour"))
    return drawn.join(ends, [*by, "v"], "left_semi").unionByName(objects), arcs


def colour(third_party: Column, sensitive: Column, unresolved: Column, method: Column) -> Column:
    """What a vertex is drawn as; the first that holds."""
    return F.when(method, "blue").when(third_party, "yellow").when(sensitive, "red").when(unresolved, "orange").otherwise("black")


def reached(seeds: DataFrame, arcs: DataFrame, by: list[str], backward: bool = False, barriers: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """(by, v, depth) from seeds (by, v): all that arcs lead to, the seeds included, with the least number of steps.

    by may hold the walk's origin, to tell walks apart; arcs need only those of its columns that they have. barriers (by, v)
    are neither entered nor crossed, seeds that are barriers included; stops (by, v) are entered but, other than as seeds, not crossed.
    """
    near, far = ("dst", "src") if backward else ("src", "dst")
    spark = arcs.sparkSession
    on = [c for c in by if c in arcs.columns]
    step = stored(arcs.select(*on, F.col(near).alias("v"), F.col(far).alias("__to")).distinct(), "arcs")

    def open_(df: DataFrame) -> DataFrame:
        return df if barriers is None else df.join(barriers, [c for c in barriers.columns if c in df.columns], "left_anti")

    first = open_(seeds.select(*by, "v").distinct())
    path = fresh(spark, "walk")
    schema = first.withColumn("depth", F.lit(0)).schema

    def visited(depth: int | None = None) -> DataFrame:
        if depth is None:
            return spark.read.schema(schema).parquet(path)
        return spark.read.schema(first.schema).parquet(f"{path}/depth={depth}")

    first.write.parquet(f"{path}/depth=0")
    depth, frontier = 0, visited(0)
    while not frontier.isEmpty():
        depth += 1
        start = frontier if stops is None or depth == 1 else frontier.join(stops, [c for c in stops.columns if c in frontier.columns], "left_anti")
        to = start.join(step, [*on, "v"]).select(*by, F.col("__to").alias("v")).distinct()
        open_(to).join(visited().select(*by, "v"), [*by, "v"], "left_anti").write.parquet(f"{path}/depth={depth}")
        frontier = visited(depth)
    forget(step)
    return visited()


def components(vertices: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """(by, v, component) of vertices (by, v): the least vertex that undirected arcs between them connect each with."""
    a = arcs.select(*by, "src", "dst").where("src <> dst").distinct()
    inside = lambda c: vertices.select(*by, F.col("v").alias(c))
    a = a.join(inside("src"), [*by, "src"], "left_semi").join(inside("dst"), [*by, "dst"], "left_semi")
    both = stored(a.unionByName(a.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "arcs")
    label = stored(vertices.select(*by, "v").distinct().withColumn("component", F.col("v")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("v", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("v")).agg(F.min("component").alias("__near"))
        low = label.join(near, [*by, "v"], "left").select(*by, "v", "component", F.least("component", F.coalesce("__near", "component")).alias("__low"))
        ahead = label.select(*by, F.col("v").alias("__low"), F.col("component").alias("__ahead"))  # the label's label: doubles the reach
        new = stored(low.join(ahead, [*by, "__low"], "left").select(*by, "v", F.least("__low", F.coalesce("__ahead", "__low")).alias("component"), (F.least("__low", F.coalesce("__ahead", "__low")) < F.col("component")).alias("__moved")), "labels")
        still = new.where("__moved").isEmpty()
        forget(label)
        label = new.drop("__moved")
        label.stored_at = new.stored_at
        if still:
            forget(both)
            return label


def slice_components(arcs: DataFrame, flagged: DataFrame, by: list[str], program: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """(by, v, component): data arcs forward and backward from the flagged vertices that have any arc, split into components.

    program vertices stop the backward walk alone; hidden ones (objects, methods) connect but aren't returned.
    """
    linked = arcs.select(*by, F.col("src").alias("v")).unionByName(arcs.select(*by, F.col("dst").alias("v"))).distinct()
    seeds = flagged.join(linked, [*by, "v"], "left_semi")
    data = arcs.where(F.col("label").isin(*DATA))
    members = reached(seeds, data, by).select(*by, "v").unionByName(reached(seeds, data, by, backward=True, barriers=program).select(*by, "v")).distinct()
    out = components(stored(members, "members"), data, by)
    return out if hidden is None else out.join(hidden, [*by, "v"], "left_anti")


def representatives(members: DataFrame, lines: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, v, cfg_order): each component's vertex of the least line, among its seeds if it has any; line 0 where
    none has one; a tie goes to the least vertex."""
    m = members.join(lines, [*by, "v"], "left").join(seeds.select(*by, "v").distinct().withColumn("__seed", F.lit(0)), [*by, "v"], "left")
    key = F.struct(F.coalesce("__seed", F.lit(1)).alias("seed"), F.col("line").isNull().alias("none"), "line", "v")
    return m.groupBy(*by, "component").agg(F.min(key).alias("k")).select(*by, "component", "k.v", F.coalesce("k.line", F.lit(0)).alias("cfg_order"))


def toward(arcs: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The arcs that lead on to a target (by, v): one walk backward from all of them at once tells which do. A walk from each of
    many origins over these alone doesn't gather what it has no use for."""
    useful = reached(targets, arcs, by, backward=True).select(*by, F.col("v").alias("dst"))
    return arcs.join(useful, [*by, "dst"], "left_semi")


def component_order(reps: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, successor): components whose representative a control-flow path from another's leads to."""
    from_ = reps.select(*by, F.col("component").alias("origin"), "v")
    walk = reached(from_, toward(arcs.where("label = 'CFG'"), reps.select(*by, "v"), by), [*by, "origin"])
    to = reps.select(*by, F.col("component").alias("successor"), "v")
    return walk.join(to, [*by, "v"]).where("origin <> successor").select(*by, F.col("origin").alias("component"), "successor")


def nearest_flagged(sources: DataFrame, arcs: DataFrame, flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, origin, v, depth): flagged vertices that a walk from a source meets first on some branch; it doesn't go past one."""
    stops = flagged.select(*by, "v").distinct()
    walk = reached(sources.select(*by, F.col("v").alias("origin"), "v"), arcs, [*by, "origin"], stops=stops)
    return walk.where("depth > 0").join(stops, [*by, "v"], "left_semi")


def least_ancestor(vertices: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """(by, v, least): the least vertex that leads to each of vertices (by, v), which have every end of an arc; each leads to itself.

    A round takes the least label among those that lead to a vertex, then that label's label, so that the reach doubles.
    """
    step = stored(arcs.select(*by, "src", "dst").where("src <> dst").distinct(), "arcs")
    label = stored(vertices.select(*by, "v").distinct().withColumn("least", F.col("v")), "labels")
    while True:
        near = step.join(label.withColumnRenamed("v", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("v")).agg(F.min("least").alias("__near"))
        low = label.join(near, [*by, "v"], "left").select(*by, "v", "least", F.least("least", F.coalesce("__near", "least")).alias("__low"))
        ahead = label.select(*by, F.col("v").alias("__low"), F.col("least").alias("__ahead"))
        new = stored(low.join(ahead, [*by, "__low"], "left").select(*by, "v", F.least("__low", F.coalesce("__ahead", "__low")).alias("least"), (F.least("__low", F.coalesce("__ahead", "__low")) < F.col("least")).alias("__moved")), "labels")
        still = new.where("__moved").isEmpty()
        forget(label)
        label = new.drop("__moved")
        label.stored_at = new.stored_at
        if still:
            forget(step)
            return label


def common_ancestors(pairs: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (by, a, b) with `common`: whether a vertex leads to both; each is its own ancestor.

    Two with one least ancestor have it in common. Only the ends of the other pairs are walked from.
    """
    ends = pairs.select(*by, F.col("a").alias("v")).unionByName(pairs.select(*by, F.col("b").alias("v"))).distinct()
    every = ends.unionByName(arcs.select(*by, F.col("src").alias("v"))).unionByName(arcs.select(*by, F.col("dst").alias("v"))).distinct()
    every = stored(every, "vertices")
    least = least_ancestor(every, arcs, by)
    side = lambda c: least.select(*by, F.col("v").alias(c), F.col("least").alias(f"__l{c}"))
    known = stored(pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]), "pairs")
    open_ = known.where("__la <> __lb").select(*by, "a", "b").distinct()
    starts = open_.select(*by, F.col("a").alias("v")).unionByName(open_.select(*by, F.col("b").alias("v"))).distinct()
    up = stored(reached(starts.withColumn("origin", F.col("v")), arcs, [*by, "origin"], backward=True).select(*by, "origin", "v"), "ancestors")
    a, b = up.select(*by, F.col("origin").alias("a"), "v"), up.select(*by, F.col("origin").alias("b"), "v")
    met = open_.join(a, [*by, "a"]).join(b, [*by, "b", "v"]).select(*by, "a", "b").distinct().withColumn("__met", F.lit(True))
    return known.join(met, [*by, "a", "b"], "left").select(*pairs.columns, (F.coalesce("__met", F.lit(False)) | (F.col("__la") == F.col("__lb"))).alias("common"))


def closure(deps: DataFrame, by: list[str]) -> DataFrame:
    """(by, parent, child) -> (by, pkg, dep): the reflexive transitive closure; cycles end."""
    names = deps.select(*by, F.col("parent").alias("v")).unionByName(deps.select(*by, F.col("child").alias("v"))).distinct()
    walk = reached(names.withColumn("pkg", F.col("v")), deps.select(*by, F.col("parent").alias("src"), F.col("child").alias("dst")), [*by, "pkg"])
    return walk.select(*by, "pkg", F.col("v").alias("dep"))


def data_paths(pairs: DataFrame, arcs: DataFrame, flagged: DataFrame, by: list[str]) -> DataFrame:
    """pairs (by, a, b) with `linked`: whether data arcs lead from a to b past no other flagged vertex; each leads to itself."""
    starts = pairs.select(*by, F.col("a").alias("origin"), F.col("a").alias("v")).distinct()
    walk = reached(starts, arcs.where(F.col("label").isin(*DATA)), [*by, "origin"], stops=flagged.select(*by, "v").distinct())
    met = walk.select(*by, F.col("origin").alias("a"), F.col("v").alias("b"), F.lit(True).alias("linked"))
    return pairs.join(met, [*by, "a", "b"], "left").fillna(False, ["linked"])


def nearest_in_order(sources: DataFrame, arcs: DataFrame, flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, origin, v): flagged vertices that data arcs lead a source to first, of those that control flow leads it to as well;
    the others are walked past."""
    origins = sources.select(*by, F.col("v").alias("origin"), "v").distinct()
    cfg = reached(origins, arcs.where("label = 'CFG'"), [*by, "origin"]).select(*by, "origin", "v")
    stops = stored(cfg.join(flagged.select(*by, "v").distinct(), [*by, "v"], "left_semi").where("v <> origin"), "stops")
    walk = reached(origins, arcs.where(F.col("label").isin(*DATA)), [*by, "origin"], stops=stops)
    return walk.where("depth > 0").select(*by, "origin", "v").join(stops, [*by, "origin", "v"], "left_semi")


def flagged_graph(arcs: DataFrame, flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, label): the graph of flagged vertices alone. Data_Flow to what data arcs, or data arcs in the order of
    control flow, lead to next; Control_Flow to what control flow leads to next; and Data_Flow, the lesser vertex first,
    between two that control flow joins neither way but leads to from one vertex, where data arcs lead from one to the other
    and nothing joins them yet in that direction."""
    f = stored(flagged.select(*by, "v").distinct(), "flagged")
    arcs = stored(arcs.select(*by, "src", "dst", "label").distinct(), "graph")
    cfg = arcs.where("label = 'CFG'")
    near = lambda a, name: nearest_flagged(f, a, f, by).where("origin <> v").select(*by, F.col("origin").alias("src"), F.col("v").alias("dst"), F.lit(name).alias("label"))
    data = near(arcs.where("label = 'DDG'"), "Data_Flow").unionByName(nearest_in_order(f, arcs, f, by).select(*by, F.col("origin").alias("src"), F.col("v").alias("dst"), F.lit("Data_Flow").alias("label"))).distinct()
    direct = stored(data.unionByName(near(cfg, "Control_Flow")), "direct")
    up = stored(reached(f.select(*by, F.col("v").alias("origin"), "v"), cfg, [*by, "origin"], backward=True).select(*by, "origin", "v"), "ancestors")
    joined = up.select(*by, F.least("origin", "v").alias("a"), F.greatest("origin", "v").alias("b")).where("a < b").distinct()
    linked = nearest_flagged(f, arcs.where(F.col("label").isin(*DATA)), f, by).select(*by, F.col("origin").alias("a"), F.col("v").alias("b")).where("a < b")
    apart = linked.join(joined, [*by, "a", "b"], "left_anti").join(direct.select(*by, F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), [*by, "a", "b"], "left_anti")
    side = lambda c: up.select(*by, F.col("origin").alias(c), "v")
    siblings = apart.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b", "v"]).select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("Data_Flow").alias("label")).distinct()
    return direct.unionByName(siblings)


def with_missing(missing: DataFrame, recorded: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst): Control_Flow arcs that put events (by, idx, v) no vertex accounts for where they were seen: each run of
    consecutive ones is a path from the vertex of the recorded event (by, idx, v) before it to that of the one after."""
    w = Window.partitionBy(*by).orderBy("idx")
    log_ = missing.select(*by, "idx", "v", F.lit(True).alias("new")).unionByName(recorded.select(*by, "idx", "v", F.lit(False).alias("new")))
    before = log_.withColumn("pv", F.lag("v").over(w)).withColumn("pn", F.lag("new").over(w)).withColumn("pi", F.lag("idx").over(w))
    # within a run events follow one another without a gap; a recorded event may be any distance away
    last_seen = F.last(F.when(~F.col("new"), F.col("v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    linked = before.withColumn("seen", last_seen).withColumn("src", F.when(F.col("pn") & (F.col("pi") == F.col("idx") - 1), F.col("pv")).otherwise(F.when(F.col("new"), F.col("seen"))))
    into = linked.where("new AND src IS NOT NULL").select(*by, "src", F.col("v").alias("dst"))
    after = log_.withColumn("nn", F.lead("new").over(w)).withColumn("ni", F.lead("idx").over(w))
    next_seen = F.first(F.when(~F.col("new"), F.col("v")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = after.withColumn("dst", next_seen).where("new AND dst IS NOT NULL AND NOT (coalesce(nn, false) AND ni = idx + 1)").select(*by, F.col("v").alias("src"), "dst")
    return into.unionByName(out)
