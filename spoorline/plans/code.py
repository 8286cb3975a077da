"""Queries of sources, call graphs, syntax trees and behaviour graphs. Files are written from the driver's tables first, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import callgraph, graph, joins, syntax
from ..operators.work import fresh
from ..sources import artefacts, graphs
from . import views as V
from .oracle import ARCS, EV
from .registry import query
from .views import events, table

#: Files that one kind of artefact is dealt over.
PARTS = 12


def _files(df: DataFrame, key: str, text: str, name: str) -> str:
    """The folder of a file for each key, f=<key>/..., with its texts as lines."""
    path = fresh(df.sparkSession, name)
    df.select(F.col(key).alias("f"), F.col(text).alias("value")).repartition("f").write.partitionBy("f").text(path)
    return path


def _key(path: str = "path"):
    """The key in a file's path."""
    return F.regexp_extract(path, r"/f=(\d+)/", 1).cast("long")


def _s(text: str, *cols):
    parts = text.split("{}")
    return F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(p)] + ([F.col(cols[k]).cast("string")] if k < len(cols) else []))])


# call graphs

_CG = f"""{EV}, u AS (SELECT g, usr, CAST(row_number() OVER (PARTITION BY g ORDER BY usr) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT user_id % {PARTS} AS g, user_id AS usr FROM ev) t),
  fun AS (SELECT g, i, 'f' || usr || '.js' AS file, i % 7 AS sl, i % 7 + 9 AS el FROM u), f2f AS (SELECT g, i AS a, (i * 2 + 1) % n AS b FROM u), c2f AS (SELECT g, i AS a, (i + 1) % n AS b FROM u UNION SELECT g, i, (i * 3) % n FROM u)"""


def _graphs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Call graphs as an analyser writes them, one for users of a residue, read back: functions and calls as an object by place in odd
    ones, as a list in the others."""
    u = events(spark, sf).select((F.col("user_id") % PARTS).alias("g"), "user_id").distinct()
    u = u.groupBy("g").agg(F.array_sort(F.collect_list("user_id")).alias("us"))
    n = F.size("us")
    line = lambda shape: F.transform("us", shape)
    span = lambda i, sl, sc, el, ec: F.concat_ws(":", i, sl, sc, el, ec)
    funs = line(lambda x, i: span(i, i % 7 + 1, F.lit(1), i % 7 + 10, F.lit(3)))
    calls = line(lambda x, i: span(i, i % 5 + 21, F.lit(4), i % 5 + 21, F.lit(10)))
    keyed = lambda xs: F.map_from_entries(F.transform(xs, lambda x, i: F.struct(i.cast("string"), x)))
    pair = lambda a, b: F.array(a.cast("long"), b.cast("long"))
    c2f = F.concat(line(lambda x, i: pair(i, (i + 1) % n)), line(lambda x, i: pair(i, (i * 3) % n)))
    common = [line(lambda x: F.concat(F.lit("f"), x, F.lit(".js"))).alias("files"), c2f.alias("call2fun"), line(lambda x, i: pair(i, (i * 2 + 1) % n)).alias("fun2fun")]
    text = F.when(F.col("g") % 2 == 1, F.to_json(F.struct(*common, keyed(funs).alias("functions"), keyed(calls).alias("calls")))).otherwise(F.to_json(F.struct(*common, funs.alias("functions"), calls.alias("calls"))))
    path = _files(u.withColumn("text", text), "g", "text", "call_graphs")
    spans, edges = artefacts.call_graph(artefacts.texts(spark, path))
    return spans.withColumn("g", _key()).drop("path"), edges.withColumn("g", _key()).drop("path")


@query(f"""WITH {_CG} SELECT c.g, x.file AS caller, c.a % 5 + 20 AS sl, y.file AS callee, y.sl AS callee_sl FROM c2f c JOIN fun x ON x.g = c.g AND x.i = c.a JOIN fun y ON y.g = c.g AND y.i = c.b""")
def q_call_graph_files(spark, sf):
    c2f, _ = callgraph.edges_of(*_graphs(spark, sf), ["g"])
    return c2f.select("g", F.col("call.file").alias("caller"), F.col("call.sl").cast("long").alias("sl"), F.col("callee.file").alias("callee"), F.col("callee.sl").cast("long").alias("callee_sl"))


@query(f"""WITH RECURSIVE {_CG}, r AS (SELECT g, CAST(0 AS BIGINT) AS v FROM u WHERE i = 0 UNION SELECT r.g, f.b FROM r JOIN f2f f ON f.g = r.g AND f.a = r.v) SELECT r.g, fun.file FROM r JOIN fun ON fun.g = r.g AND fun.i = r.v""")
def q_transitive_callees(spark, sf):
    spans, edges = _graphs(spark, sf)
    _, f2f = callgraph.edges_of(spans, edges, ["g"])
    starts = spans.where("kind = 'functions' AND at = 0").select("g", F.lit(0).alias("origin"), callgraph.span().alias("v"))
    return callgraph.transitive(starts, f2f, ["g"]).select("g", F.col("v.file").alias("file"))


@query(f"""WITH RECURSIVE {_CG}, r AS (SELECT g, i AS o, i AS v FROM u WHERE i < 3 UNION SELECT r.g, r.o, f.b FROM r JOIN f2f f ON f.g = r.g AND f.a = r.v),
  e AS (SELECT user_id % {PARTS} AS g, event_id AS idx, 'f' || user_id || '.js' AS file, line % 20 AS sl, CASE WHEN event_type = 'error' THEN NULL ELSE line % 3 END AS sc FROM ev),
  h AS (SELECT r.g, r.o AS origin, e.* EXCLUDE (g) FROM r JOIN fun ON fun.g = r.g AND fun.i = r.v JOIN e ON e.g = fun.g AND e.file = fun.file AND e.sl BETWEEN fun.sl AND fun.el)
SELECT g, origin, min(idx) AS idx FROM h WHERE sc IS NOT NULL GROUP BY g, origin, file, sl, sc UNION ALL SELECT g, origin, idx FROM h WHERE sc IS NULL""")
def q_reached_events(spark, sf):
    """Events that calls from a graph's first functions lead to, of each caller the first."""
    spans, edges = _graphs(spark, sf)
    _, f2f = callgraph.edges_of(spans, edges, ["g"])
    starts = spans.where("kind = 'functions' AND at < 3").select("g", F.col("at").alias("origin"), callgraph.span().alias("v"))
    e = events(spark, sf)
    sl = (F.col("line") % 20).cast("int")
    e = e.select((F.col("user_id") % PARTS).alias("g"), F.col("event_id").alias("idx"), F.concat(F.lit("package/f"), "user_id", F.lit(".js")).alias("file"), sl.alias("sl"), F.when(F.col("event_type") != "error", F.col("line") % 3).cast("int").alias("sc"), sl.alias("el"), F.lit(9).alias("ec"))
    return callgraph.reached_events(starts, f2f, e, ["g"])


@query(f"""WITH {_CG} SELECT g, 'f' || usr || '.js' AS file, i, CAST(CASE WHEN i % 4 = 3 THEN 9 WHEN i % 4 = 0 THEN 9 WHEN i % 4 = 1 THEN 12 ELSE 30 END AS BIGINT) AS ec, CASE WHEN i % 4 < 3 THEN (i + 1) % n END AS callee FROM u""")
def q_callee_programs(spark, sf):
    """Calls whose expressions start at one place and end at several: the code tells which is meant; that one's callee is looked up by place."""
    spans, edges = _graphs(spark, sf)
    f = spans.where("kind = 'functions'")
    k = F.col("at") % 4
    code = F.when(k == 0, "f(1)").when(k == 1, "f(1)(2) ").when(k == 2, F.repeat(F.lit("x"), 90)).otherwise("f(1)")
    nodes = f.select("g", F.col("at").alias("node"), "file", F.lit(41).alias("line"), F.lit(3).alias("col"), code.alias("code"))
    every = F.when(k == 3, F.array(F.lit(9))).otherwise(F.array(F.lit(9), F.lit(12), F.lit(30)))
    ends = callgraph.expression_ends(f.select("g", "file", F.lit(40).alias("sl"), F.lit(3).alias("sc"), F.lit(40).alias("el"), F.explode(every).alias("ec")), ["g"])
    picked = callgraph.call_span(nodes, ends, ["g"])
    n = f.groupBy("g").agg(F.count("*").alias("n"))
    to = f.join(n, "g").select("g", F.col("at").alias("to"), callgraph.span().alias("callee"))
    want = picked.join(n, "g").where("node % 4 < 3").select("g", "node", "call", ((F.col("node") + 1) % F.col("n")).alias("to"))
    c2f = want.join(to, ["g", "to"]).select("g", "call", "callee")
    programs = f.select("g", "file", (F.col("sl") + 1).alias("sl"), F.when(F.col("at") % 2 == 0, F.col("sc")).otherwise(F.lit(-1)).alias("sc"), (F.col("el") + 1).alias("el"), F.when(F.col("at") % 2 == 0, F.col("ec")).otherwise(F.lit(99)).alias("ec"), F.col("at").alias("pdg"))
    into = callgraph.callee_programs(nodes, ends, c2f, programs, ["g"])
    return picked.join(into.withColumnRenamed("pdg", "callee"), ["g", "node"], "left").select("g", "file", F.col("node").alias("i"), F.col("call.ec").cast("long").alias("ec"), "callee")


@query(f"""WITH {_CG}, p AS (SELECT *, i % 5 AS k FROM u) SELECT g, 'full' AS how, k AS what, min(i) AS pdg FROM p WHERE k <> 2 GROUP BY g, k UNION ALL SELECT g, 'main', NULL, i FROM p WHERE i % 3 = 0 AND k <> 2 UNION ALL SELECT g, 'exact', i, i FROM p WHERE i % 2 = 0""")
def q_program_lookups(spark, sf):
    """Programs by full name, by file, and functions by place."""
    spans, _ = _graphs(spark, sf)
    f = spans.where("kind = 'functions'")
    k = F.col("at") % 5
    p = f.select("g", F.col("at").alias("pdg"), F.when(k == 2, "a.ts").otherwise(F.col("file")).alias("file"), F.when(F.col("at") % 3 == 0, ":program").otherwise("f").alias("name"), F.concat(F.lit(" n"), k).alias("full_name"), F.lit(2).alias("nodes"))
    p = callgraph.admitted(p)
    wanted = f.select("g", F.concat(F.lit("n"), k, F.lit(" ")).alias("full_name"), k.alias("what")).distinct()
    full = callgraph.by_full_name(wanted, p, ["g"]).where("pdg IS NOT NULL").select("g", F.lit("full").alias("how"), "what", "pdg")
    main = callgraph.main_program(p, ["g"]).select("g", F.lit("main").alias("how"), F.lit(None).cast("long").alias("what"), "pdg")
    at = f.select("g", "at", *[F.when(F.col("at") % 2 == 0, F.col(c)).otherwise(F.col(c) + 1).alias(c) if c == "sc" else F.col(c) for c in callgraph.SPAN])
    exact = callgraph.function_at(at, f, ["g"]).select("g", F.lit("exact").alias("how"), F.col("at").alias("what"), F.col("at").alias("pdg"))
    return full.unionByName(main).unionByName(exact)


@query(f"""WITH {_CG}, new AS (SELECT g, i AS a, (i + 2) % n AS b FROM u WHERE i % 3 = 1) SELECT g, a, b FROM c2f UNION SELECT g, a, b FROM new""")
def q_call_sources(spark, sf):
    """Traces of calls and the sources they load, one file a graph: what follows a call is what it loaded; others load nothing known."""
    spans, edges = _graphs(spark, sf)
    f = spans.where("kind = 'functions'")
    n = f.groupBy("g").agg(F.count("*").alias("n"))
    to = f.select("g", F.col("at").alias("to"), F.concat_ws(":", F.lit("Source"), F.regexp_replace("file", "^package/", ""), F.col("sl") + 1, F.col("sc") + 1, F.col("el") + 1, F.col("ec") + 1).alias("source"))
    call = F.concat_ws(":", F.lit("Call"), F.concat(F.lit("("), "file"), F.col("at") % 5 + 21, F.lit(4), F.col("at") % 5 + 21, F.concat(F.lit("10"), F.lit(")")))
    t = f.where("at % 3 = 1").join(n, "g").select("g", "at", call.alias("call"), ((F.col("at") + 2) % F.col("n")).alias("to")).join(to, ["g", "to"])
    items = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "call", "source"))), lambda x: F.array(F.lit("Call:(x.js:1:1:1:1)"), x["call"], x["source"], F.lit("Source:/usr/lib/a.js:1:1:1:1"), F.lit("Source:none.js:1:1:2:2"))))
    path = _files(t.groupBy("g").agg(F.to_json(F.concat(F.array(F.lit("Source:early.js:1:1:1:1")), items)).alias("text")), "g", "text", "call_sources")
    pairs = artefacts.call_sources(spark, path).withColumn("g", _key()).select("g", "call", "source")
    strip = lambda c: F.struct(F.regexp_replace(F.col(f"{c}.file"), "^package/", "").alias("file"), *[F.col(f"{c}.{k}").alias(k) for k in callgraph.SPAN[1:]])
    c2f, _ = callgraph.edges_of(spans, edges, ["g"])
    packed = f.select("g", F.concat(F.lit("package/"), "file").alias("file"), *callgraph.SPAN[1:])
    more = callgraph.with_sources(c2f.where("false"), pairs, packed, ["g"]).select("g", strip("call").alias("call"), strip("callee").alias("callee"))
    both = callgraph.merged(c2f, more)
    a = spans.where("kind = 'calls'").select("g", F.col("at").alias("a"), callgraph.span().alias("call"))
    b = f.select("g", F.col("at").alias("b"), callgraph.span().alias("callee"))
    return both.join(a, ["g", "call"]).join(b, ["g", "callee"]).select("g", "a", "b")


@query(f"""WITH {EV}, e AS (SELECT user_id, event_id, line FROM ev WHERE event_type = 'signup'), t AS (SELECT * FROM e WHERE line % 2 = 0) SELECT a.event_id AS node, b.event_id AS eval FROM e a JOIN t b ON b.user_id = a.user_id AND b.line = a.line""")
def q_eval_matches(spark, sf):
    """Traced evals, from trace files, at the place of nodes."""
    e = events(spark, sf).where("event_type = 'signup'")
    item = F.struct(F.concat(F.lit("(f"), "user_id", F.lit(".js:"), "line", F.lit(":5:9:9)")).alias("Call"), F.col("event_id").cast("string").alias("Arg"))
    bad = F.struct(F.lit("f.js:1:1").alias("Call"), F.lit("x").alias("Arg"))
    t = e.where("line % 2 = 0").groupBy((F.col("user_id") % PARTS).alias("g")).agg(F.to_json(F.concat(F.collect_list(item), F.array(bad))).alias("text"))
    evals = artefacts.eval_calls(spark, _files(t, "g", "text", "evals"))
    nodes = e.select(F.lit(1).alias("g"), F.col("event_id").alias("node"), F.concat(F.lit("./f"), "user_id", F.lit(".js")).alias("file"), F.col("line").cast("int").alias("line"), F.lit(4).alias("col"))
    return callgraph.eval_matches(nodes, evals.withColumn("g", F.lit(1)), ["g"]).select("node", F.col("arg").cast("long").alias("eval"))


@query(f"""WITH {EV}, f AS (SELECT DISTINCT pkg, user_id FROM ev) SELECT pkg, 'f' || user_id || '.js' AS path, 'kept' AS what FROM f WHERE pkg % 3 = 0 OR user_id % 2 = 0 UNION ALL SELECT pkg, 'f' || user_id || '.js', 'dynamic' FROM f WHERE user_id % 2 = 1""")
def q_listed_files(spark, sf):
    """Files that a package's graph lists; all where it lists none. And those that only the run named."""
    f = events(spark, sf).select("pkg", "user_id").distinct().withColumn("path", _s("f{}.js", "user_id"))
    named = f.where("pkg % 3 <> 0 AND user_id % 2 = 0").select("pkg", F.concat(F.lit("package/"), "path").alias("file"))
    kept = callgraph.listed(f, named, ["pkg"]).select("pkg", "path", F.lit("kept").alias("what"))
    only = callgraph.only_in(f.select("pkg", F.col("path").alias("file")), f.where("user_id % 2 = 0").select("pkg", F.col("path").alias("file")), ["pkg"])
    return kept.unionByName(only.select("pkg", F.col("file").alias("path"), F.lit("dynamic").alias("what")))


# syntax trees

#: A program for each package: methods for users, every third a lambda in the method before it, calls for events.
_TREE = f"""{EV}, m AS (SELECT pkg, user_id, 1000000 + user_id AS id, CASE WHEN user_id % 5 % 3 = 2 THEN '<lambda>' || user_id ELSE 'm' || user_id END AS name, CASE WHEN user_id % 5 % 3 = 2 THEN 1000000 + user_id - 1 ELSE 900000 END AS parent FROM (SELECT DISTINCT pkg, user_id FROM ev) t),
  c AS (SELECT pkg, idx, 2000000 + idx * 4 AS id, 1000000 + user_id AS parent, line, CASE WHEN line % 5 = 0 THEN NULL WHEN line % 5 = 1 THEN -1 ELSE line END AS ord FROM ev)"""


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf)
    m = e.select("pkg", "user_id").distinct()
    u, mid = F.col("user_id"), (F.col("user_id") + 1000000)
    lam = u % 5 % 3 == 2
    present = m.select("pkg", (F.col("user_id") + 1).alias("user_id"), F.lit(True).alias("before"))
    m = m.join(present, ["pkg", "user_id"], "left")
    none = F.lit(None)
    node = lambda id_, label, name, code, ord_, arg, line: [id_.cast("long").alias("id"), F.lit(label).alias("label"), name.cast("string").alias("name"), code.cast("string").alias("code"), ord_.cast("int").alias("ord"), arg.cast("int").alias("arg"), line.cast("int").alias("line"), F.lit(1).alias("col")]
    edge = lambda src, dst, label: [src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(label).alias("label")]
    call = F.lit(2000000) + F.col("idx") * 4
    ord_ = F.when(F.col("line") % 5 == 1, -1).when(F.col("line") % 5 != 0, F.col("line"))
    top = m.select("pkg").distinct()
    nodes = top.select("pkg", *node(F.lit(900000), "METHOD", F.lit(":program"), F.lit(":program"), F.lit(1), none, F.lit(1)))
    nodes = nodes.unionByName(m.select("pkg", *node(mid, "METHOD", F.when(lam, F.concat(F.lit("<lambda>"), u)).otherwise(F.concat(F.lit("m"), u)), F.lit("x"), u % 5, none, u % 5)))
    nodes = nodes.unionByName(e.select("pkg", *node(call, "CALL", F.lit("f"), F.lit("f()"), ord_, none, F.col("line"))))
    edges = m.select("pkg", *edge(F.when(lam, mid - 1).otherwise(F.lit(900000)), mid, "AST")).unionByName(e.select("pkg", *edge(mid, call, "AST")))
    for k in (1, 2, 3):
        some = e if k < 3 else e.where("line % 2 = 0")
        nodes = nodes.unionByName(some.select("pkg", *node(call + k, "IDENTIFIER" if k < 3 else "LITERAL", none, _s("v{}", "line"), F.lit(4 - k), F.lit(k - 1), F.col("line"))))
        edges = edges.unionByName(some.select("pkg", *edge(call, call + k, "AST")))
        edges = edges.unionByName((some if k > 1 else some.where("line % 3 <> 0")).select("pkg", *edge(call, call + k, "ARGUMENT")))
    edges = edges.unionByName(e.where("line % 4 = 0").select("pkg", *edge(call, mid, "CALL")))
    return nodes, edges


@query(f"""WITH {_TREE}, k AS (SELECT pkg, parent, id, ord FROM c UNION ALL SELECT pkg, parent, id, user_id % 5 FROM m WHERE parent > 900000),
  n AS (SELECT pkg, parent, id, CAST(row_number() OVER (PARTITION BY pkg, parent ORDER BY CASE WHEN ord >= 0 THEN 0 ELSE 1 END, CASE WHEN ord >= 0 THEN ord END, id) - 1 AS INT) AS pos FROM k) SELECT * FROM n WHERE id >= 2000000""")
def q_syntax_children(spark, sf):
    return syntax.children(*_tree(spark, sf), ["pkg"]).where("parent >= 1000000 AND parent < 2000000 AND id >= 2000000")


@query(f"""WITH {_TREE} SELECT pkg, id AS call, id + 2 AS arg, 0 AS pos, 'given' AS what FROM c UNION ALL SELECT pkg, id, id + 3, 1, 'given' FROM c WHERE line % 2 = 0 UNION ALL SELECT pkg, id, id + 1, 0, 'receiver' FROM c WHERE line % 3 <> 0
  UNION ALL SELECT pkg, id, id + 1, NULL, 'own' FROM c UNION ALL SELECT pkg, id, parent, NULL, 'enters' FROM c WHERE line % 4 = 0""")
def q_syntax_calls(spark, sf):
    """Of each call what it is given, its receiver, its first part of its own, and what it enters."""
    n, e = _tree(spark, sf)
    row = lambda df, arg, pos, what: df.select("pkg", "call", F.col(arg).alias("arg"), pos.cast("int").alias("pos"), F.lit(what).alias("what"))
    none = F.lit(None)
    out = row(syntax.arguments(n, e, ["pkg"]), "id", F.col("pos"), "given").unionByName(row(syntax.arguments(n, e, ["pkg"], True), "id", F.col("pos"), "receiver"))
    out = out.unionByName(row(syntax.first_own_part(n, e, ["pkg"]), "id", none, "own").where("call >= 2000000"))
    return out.unionByName(row(syntax.entered(e, ["pkg"]).withColumnRenamed("id", "call"), "method", none, "enters"))


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT c.pkg, c.id, c.parent AS cur, m.name, m.parent AS next FROM c JOIN m ON m.pkg = c.pkg AND m.id = c.parent
    UNION ALL SELECT up.pkg, up.id, up.next, coalesce(m.name, CASE WHEN up.next = 900000 THEN ':program' END), m.parent FROM up LEFT JOIN m ON m.pkg = up.pkg AND m.id = up.next WHERE contains(up.name, '<lambda>') AND (m.id IS NOT NULL OR up.next = 900000))
SELECT pkg, id, cur AS method, name FROM up WHERE NOT contains(name, '<lambda>')""")
def q_enclosing_method(spark, sf):
    n, e = _tree(spark, sf)
    return syntax.enclosing_method(n, e, ["pkg"], n.where("label = 'CALL'"))


_PLACES = f"""{EV}, p AS (SELECT event_id, file, line, event_id % 25 AS col FROM ev)"""


def _ranges(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parsed files: a program, a statement of ten lines each, on every line in use a call with a member in it."""
    l = events(spark, sf).select("file", "line").distinct()  # noqa: E741
    at = lambda df, id_, type_, depth, sl, sc, el, ec, parent: df.select("file", id_.cast("string").alias("id"), F.lit(type_).alias("type"), F.lit(depth).alias("depth"), *[x.cast("int").alias(n) for x, n in ((sl, "sl"), (sc, "sc"), (el, "el"), (ec, "ec"))], parent.cast("string").alias("parent")).distinct()
    i, ten = F.col("line"), (F.floor(F.col("line") / 10) * 10)
    z = F.lit(0)
    root, block = F.lit("root"), F.concat(F.lit("b"), ten)
    out = at(l, root, "program", 0, z, z, F.lit(200), z, F.lit(None)).unionByName(at(l, block, "expression_statement", 1, ten, z, ten + 10, z, root))
    out = out.unionByName(at(l, F.concat(F.lit("c"), i), "call_expression", 2, i, z + 4, i, z + 20, block)).unionByName(at(l, F.concat(F.lit("m"), i), "member_expression", 3, i, z + 4, i, z + 10, F.concat(F.lit("c"), i)))
    return out.drop("parent"), out.where("parent IS NOT NULL").select("file", "id", "parent")


@query(f"""WITH {_PLACES} SELECT event_id AS place, CASE WHEN col >= 4 AND col < 10 THEN 'm' || line WHEN col >= 10 AND col < 20 THEN 'c' || line ELSE 'b' || line // 10 * 10 END AS id, 'b' || line // 10 * 10 AS statement,
  CASE WHEN col >= 4 AND col < 20 THEN 20 END AS call_end, CASE WHEN col >= 4 AND col < 10 THEN 10 END AS member_end FROM p""")
def q_syntax_places(spark, sf):
    """What stands at a place: the smallest node, its statement, the call and the member access around it."""
    r, up = _ranges(spark, sf)
    e = events(spark, sf)
    places = e.select("file", F.col("event_id").alias("place"), F.col("line").cast("int").alias("line"), (F.col("event_id") % 25).cast("int").alias("col"))
    here = syntax.deepest_at(r, places, ["file"])
    st = syntax.nearest_statement(r, up, here, ["file"]).select("file", "place", F.col("id").alias("statement"))
    call = syntax.call_around(r, up, here, ["file"]).select("file", "place", F.col("ec").alias("call_end"))
    member = syntax.call_around(r, up, here, ["file"], "property").select("file", "place", F.col("ec").alias("member_end"))
    return here.join(st, ["file", "place"], "left").join(call, ["file", "place"], "left").join(member, ["file", "place"], "left").drop("file")


@query(f"""WITH {EV}, t AS (SELECT *, line % 4 AS k FROM ev WHERE event_type IN ('click', 'view')) SELECT pkg % {PARTS} AS g, event_id AS result, CASE WHEN line = 0 THEN NULL ELSE file END AS file, CASE WHEN line > 0 AND event_type = 'click' THEN line - 1 END AS sl, CAST(CASE WHEN line > 0 AND event_type = 'click' THEN 20 END AS BIGINT) AS ec,
  CASE k WHEN 0 THEN 'a"b' WHEN 1 THEN 'x,y' WHEN 2 THEN '' ELSE '[1]' END AS arguments FROM t""")
def q_trace_files(spark, sf):
    """Traces in CSV, read back with their callers: fields with commas, quotes and nothing in them, and rows of other widths."""
    e = events(spark, sf).where("event_type IN ('click', 'view')").withColumn("k", F.col("line") % 4)
    args = F.when(F.col("k") == 0, '"""a""""b"""').when(F.col("k") == 1, '"x,y"').when(F.col("k") == 2, "").otherwise("[1]")
    row = F.concat_ws(",", F.when(F.col("event_type") == "click", "function").otherwise("view"), F.lit("fs"), F.lit("readFile"), args, F.col("event_id").cast("string"), F.concat(F.lit("/app/"), F.regexp_replace("file", "^package/", "")), F.col("line").cast("string"), F.lit("13"))
    lines = e.select((F.col("pkg") % PARTS).alias("g"), F.explode(F.array(row, F.lit("function,fs,readFile,,1,/app/x.js,1"), F.lit("a,b,c,d,e,f,1,2,3"))).alias("text"))
    t = artefacts.trace(spark, _files(lines, "g", "text", "traces"))
    r, up = _ranges(spark, sf)
    # a line of every file is parsed: the one before the line in use, as traces count from one
    down = lambda c: F.when(F.col("type").isin("call_expression", "member_expression"), F.col(c) - 1).otherwise(F.col(c))
    out = artefacts.located(t, r.withColumn("sl", down("sl")).withColumn("el", down("el")), up, "/app")
    args = F.col("arguments")
    return out.select(_key("source").alias("g"), F.col("result").cast("long").alias("result"), F.col("caller.file").alias("file"), F.col("caller.sl").cast("long").alias("sl"), F.col("caller.ec").cast("long").alias("ec"), args.alias("arguments"))


# graphs as files


@query(f"""WITH {ARCS}, a AS (SELECT g % {PARTS} AS f, src, dst + 100000 AS dst, label FROM arc) SELECT f, src, dst, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY ALL""")
def q_graphml_files(spark, sf):
    """Graphs in GraphML, several files with the same ids: parallel edges are one with all their labels, in each file by itself."""
    a = V.arcs(spark, sf).select((F.col("g") % PARTS).alias("f"), "src", (F.col("dst") + 100000).alias("dst"), "label")
    node = lambda c: a.select("f", F.col(c).alias("id")).distinct()
    nodes = node("src").unionByName(node("dst")).select("f", _s('<node id="{}"><data key="labelV">CALL</data><data key="NAME">n&lt;{}</data><data key="ORDER">{}</data></node>', "id", "id", "id").alias("text"))
    edges = a.select("f", _s('<edge source="{}" target="{}"><data key="labelE">{}</data></edge>', "src", "dst", "label").alias("text"))
    whole = nodes.unionByName(edges).groupBy("f").agg(F.concat(F.lit('<?xml version="1.0"?>\n<graphml><graph>\n'), F.array_join(F.array_sort(F.collect_list("text")), "\n"), F.lit("\n</graph></graphml>")).alias("text"))
    n, e = graphs.graphml(spark, _files(whole, "f", "text", "graphml"))
    named = graphs.syntax_nodes(n).where(F.col("name") == F.concat(F.lit("n<"), "id")).where("ord = id AND label = 'CALL'").select("path", F.col("id").alias("src"))
    return e.join(named, ["path", "src"]).select(_key().alias("f"), "src", "dst", F.array_join("labels", ",").alias("labels"))


_DOTS = f"""{ARCS}, a AS (SELECT g % {PARTS} AS f, src + 500000 AS src, dst + 100000 AS dst, label FROM arc), pdg AS (SELECT DISTINCT f, src, dst, 'DDG: v' || (dst % 7) AS label FROM a WHERE label <> 'CFG' AND src % 10 <> 0), cfg AS (SELECT DISTINCT f, src, dst, 'CFG' AS label FROM a WHERE label = 'CFG')"""


def _dots(spark, sf) -> tuple[str, str, DataFrame]:
    a = V.arcs(spark, sf).select((F.col("g") % PARTS).alias("f"), (F.col("src") + 500000).alias("src"), (F.col("dst") + 100000).alias("dst"), "label")
    ids = a.select("f", F.col("src").alias("id")).unionByName(a.select("f", F.col("dst").alias("id"))).distinct()
    head = a.select("f").distinct().select("f", F.lit(0).alias("o"), _s('"0" [label = "m" NAME="f{}" FULL_NAME="x::f{}"\n FILENAME=" a{}.js " LINE_NUMBER=3 LINE_NUMBER_END="9"]', "f", "f", "f").alias("text"))
    nodes = ids.select("f", F.lit(1).alias("o"), _s('"{}" [label = "say \\"{}\\" ]" NAME=n{}]', "id", "id", "id").alias("text"))
    data = a.where("label <> 'CFG'").select("f", F.lit(2).alias("o"), F.concat(_s('"{}" -> "{}" [label = "', "src", "dst"), F.when(F.col("src") % 10 == 0, "DDG: ").otherwise(F.concat(F.lit("DDG: v"), F.col("dst") % 7)), F.lit('"]')).alias("text"))
    flow = a.where("label = 'CFG'").select("f", F.lit(2).alias("o"), _s('  {} -> {} [label = ""] ', "src", "dst").alias("text"))

    def whole(df):
        return df.groupBy("f").agg(F.concat(F.lit("digraph g {\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n"), F.lit("\n}")).alias("text"))

    pdg, cfg = _files(whole(head.unionByName(nodes).unionByName(data)), "f", "text", "pdg"), _files(whole(head.unionByName(flow)), "f", "text", "cfg")
    attributes = ids.select("f", "id", F.when(F.col("id") % 11 == 0, "METHOD_RETURN").when(F.col("id") % 3 == 0, "CALL").otherwise("IDENTIFIER").alias("label"), F.lit("x\ny").alias("code"), F.lit(2).alias("line"), F.lit(None).cast("int").alias("col"))
    return pdg, cfg, attributes


@query(f"""WITH {_DOTS}, b AS (SELECT f, src, dst, 0 AS o, label FROM pdg UNION ALL SELECT f, src, dst, 1, label FROM cfg) SELECT f, src, dst, string_agg(label, ',' ORDER BY o, label) AS labels FROM b WHERE dst % 11 <> 0 GROUP BY ALL""")
def q_dot_edges(spark, sf):
    """Functions' graphs in DOT, data and control flow in two files each, merged: labels in that order, none into return nodes."""
    pdg, cfg, attributes = _dots(spark, sf)
    side = lambda p: graphs.dot(spark, p)[1].select(_key().alias("f"), "src", "dst", "label").distinct()
    edges, _ = graphs.merged(side(pdg), side(cfg), attributes, ["f"])
    return edges.select("f", "src", "dst", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {_DOTS}, i AS (SELECT f, src AS id FROM a UNION SELECT f, dst FROM a) SELECT f, 'f' || f AS name, 'x::f' || f AS full_name, 'a' || f || '.js' AS file, 3 AS sl, 9 AS el, 'function' AS type, count(*) + 1 AS nodes FROM i GROUP BY f""")
def q_dot_programs(spark, sf):
    pdg, _, _ = _dots(spark, sf)
    n, _ = graphs.dot(spark, pdg)
    said = n.where(F.col("id") > 0).where(F.col("label") == F.concat(F.lit('say "'), "id", F.lit('" ]'))).select("path", "id")
    p = graphs.programs(n.join(said.unionByName(n.where("id = 0").select("path", "id")), ["path", "id"]))
    return p.select(_key().alias("f"), "name", "full_name", "file", "sl", "el", "type", "nodes")


# manifests and dependencies as files


@query(f"""WITH {EV}, p AS (SELECT pkg, min(user_id) AS u, count(DISTINCT user_id) AS n FROM ev GROUP BY pkg) SELECT pkg, CASE WHEN pkg % 5 = 4 THEN 'no JSON' WHEN pkg % 5 = 3 THEN 'no object' END AS error, CASE WHEN pkg % 5 < 2 THEN 'lib/m' || u || '.js' ELSE 'index.js' END AS entry FROM p WHERE pkg % 5 < 3
  UNION ALL SELECT pkg, NULL, 'x' || u || '.js' FROM p WHERE pkg % 5 = 1 UNION ALL SELECT pkg, NULL, 'cli.js' FROM p WHERE pkg % 5 = 0""")
def q_manifest_entries(spark, sf):
    """Manifests read from files, and the entries they name that exist: mains with and without an extension, nested exports, commands."""
    p = events(spark, sf).groupBy("pkg").agg(F.min("user_id").alias("u"))
    k = F.col("pkg") % 5
    text = F.when(k == 0, _s('{"main": "./lib/m{}", "bin": {"x": "./cli.js", "y": "gone.js"}}', "u")).when(k == 1, _s('{"main": "lib/m{}.js", "exports": {".": {"import": "./x{}.js", "types": "./t.d.ts"}}}', "u", "u")).when(k == 2, '{"main": 3, "directories": {"bin": "b"}}').when(k == 3, "[1]").otherwise("{")
    rows = p.withColumn("text", F.to_json(F.struct("pkg", text.alias("text")))).select((F.col("pkg") % PARTS).alias("g"), "text")
    read = artefacts.texts(spark, _files(rows, "g", "text", "manifests")).select(F.explode(F.split(F.trim("text"), "\n")).alias("x"))
    read = read.select(F.from_json("x", "pkg long, text string").alias("m")).select("m.*")
    m = artefacts.manifests(read)
    there = p.select("pkg", F.explode(F.array(_s("package/lib/m{}.js", "u"), _s("x{}.js", "u"), F.lit("index.js"), F.lit("cli.js"))).alias("path"))
    out = artefacts.entries(m.where("error IS NULL"), there, ["pkg"])
    return out.join(m.select("pkg", "error"), "pkg")


@query(f"""WITH {EV}, u AS (SELECT DISTINCT pkg, user_id FROM ev) SELECT pkg, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'd' || (user_id - 1) END AS parent, 'd' || user_id AS child FROM u x WHERE NOT EXISTS (SELECT 1 FROM range(1, 5) r(k) WHERE k <= user_id % 5 AND NOT EXISTS (SELECT 1 FROM u y WHERE y.pkg = x.pkg AND y.user_id = x.user_id - k))""")
def q_dependency_files(spark, sf):
    """Dependency trees as nested JSON in files: each of a package's users depends on the next, as long as none is missing."""
    u = events(spark, sf).select("pkg", "user_id").distinct().groupBy("pkg").agg(F.collect_set(F.col("user_id") % 5).alias("r"))
    base = F.col("pkg") * 5
    text = F.lit("{}")
    for k in range(4, -1, -1):  # a chain of five at most, innermost first
        ok = F.array_contains("r", k)
        for j in range(k):
            ok = ok & F.array_contains("r", j)
        text = F.when(ok, F.concat(F.lit('{"dependencies": {"d'), base + k, F.lit('": '), text, F.lit("}}"))).otherwise(F.lit("{}"))
    rows = u.select((F.col("pkg") % PARTS).alias("g"), F.to_json(F.struct(F.col("pkg"), text.alias("tree"))).alias("text"))
    read = artefacts.texts(spark, _files(rows, "g", "text", "trees")).select(F.explode(F.split(F.trim("text"), "\n")).alias("x"))
    t = read.select(F.from_json("x", "pkg long, tree string").alias("m")).select(F.col("m.pkg").cast("string").alias("path"), F.col("m.tree").alias("text"))
    return artefacts.dependency_edges(t).select(F.col("path").cast("long").alias("pkg"), "parent", "child")


# behaviour graphs


@query("""WITH e AS (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type, event_id FROM events), ed AS (SELECT DISTINCT user_id % 8 AS g, user_id AS src, 100000 + k AS dst, event_type AS t FROM e WHERE event_type IN ('click', 'view', 'error')),
  lab AS (SELECT g, src, dst, bool_or(t = 'click') AS ddg, bool_or(t = 'view') AS cfg FROM ed GROUP BY ALL), flow AS (SELECT g, 'n:' || src AS src, 'n:' || dst AS dst, 'DDG' AS label FROM lab WHERE ddg UNION ALL SELECT g, 'n:' || src, 'n:' || dst, 'CFG' FROM lab WHERE cfg),
  w AS (SELECT DISTINCT user_id % 8 AS g, 'n:' || user_id AS src, 'o:obj' || (k % 9) AS dst FROM e WHERE event_type = 'signup'), r AS (SELECT DISTINCT user_id % 8 AS g, 'o:obj' || (k % 9) AS src, 'n:' || user_id AS dst FROM e WHERE event_type = 'purchase'),
  arcs AS (SELECT * FROM flow UNION ALL SELECT g, src, dst, 'Object_Data' FROM w UNION ALL SELECT g, src, dst, 'Object_Data' FROM r), ends AS (SELECT g, src AS v FROM arcs UNION SELECT g, dst FROM arcs)
SELECT g, v, CASE WHEN starts_with(v, 'o:') THEN 'object' WHEN CAST(v[3:] AS BIGINT) % 10 = 9 THEN 'method' ELSE 'node' END AS kind, CASE WHEN starts_with(v, 'o:') THEN 'black' WHEN CAST(v[3:] AS BIGINT) % 10 = 9 THEN 'blue' WHEN CAST(v[3:] AS BIGINT) % 3 = 0 THEN 'yellow' WHEN CAST(v[3:] AS BIGINT) % 2 = 0 THEN 'red' WHEN CAST(v[3:] AS BIGINT) % 5 = 0 THEN 'orange' ELSE 'black' END AS colour,
  (SELECT count(*) FROM arcs a WHERE a.g = ends.g AND a.src = ends.v) AS out FROM ends""")
def q_behavior_graph(spark, sf):
    """Vertices of a graph of nodes and named objects, with their colours; nodes without an arc aren't there."""
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", (F.col("user_id") % 8).alias("g"))
    label = F.when(F.col("event_type") == "click", "DDG: x").when(F.col("event_type") == "view", "CFG").otherwise("REMOVE: y")
    edges = e.where("event_type IN ('click', 'view', 'error')").select("g", F.col("user_id").alias("src"), (F.col("k") + 100000).alias("dst"), F.array(label).alias("labels"))
    obj = F.concat(F.lit("obj"), F.col("k") % 9)
    writes, reads = (e.where(F.col("event_type") == t).select("g", F.col("user_id").alias("id"), obj.alias("object")) for t in ("signup", "purchase"))
    i = F.col("id")
    ids = e.select("g", F.col("user_id").alias("id")).unionByName(e.select("g", (F.col("k") + 100000).alias("id"))).distinct()
    nodes = ids.select("g", "id", F.when(i % 10 == 9, "METHOD").otherwise("CALL").alias("type"), (i % 3 == 0).alias("third_party"), (i % 2 == 0).alias("sensitive"), (i % 5 == 0).alias("unresolved"))
    v, arcs = graph.behavior_graph(nodes, edges, writes, reads, ["g"])
    out = arcs.groupBy("g", F.col("src").alias("v")).agg(F.count("*").alias("out"))
    return v.join(out, ["g", "v"], "left").fillna(0, ["out"])


_FLAG = f"""{ARCS}, f AS (SELECT DISTINCT g, src AS v FROM arc WHERE src % 3 = 1 UNION SELECT DISTINCT g, dst FROM arc WHERE dst % 5 = 1)"""


def _flagged(spark, sf):
    a = V.arcs(spark, sf)
    return a, a.where("src % 3 = 1").select("g", F.col("src").alias("v")).unionByName(a.where("dst % 5 = 1").select("g", F.col("dst").alias("v"))).distinct()


@query(f"""WITH RECURSIVE {_FLAG},
  d1 AS (SELECT f.g, f.v AS o, a.dst AS v FROM f JOIN arc a ON a.g = f.g AND a.src = f.v AND a.label = 'DDG' WHERE a.dst <> f.v UNION SELECT d.g, d.o, a.dst FROM d1 d JOIN arc a ON a.g = d.g AND a.src = d.v AND a.label = 'DDG' WHERE a.dst <> d.o AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = d.g AND f.v = d.v)),
  c1 AS (SELECT f.g, f.v AS o, a.dst AS v FROM f JOIN arc a ON a.g = f.g AND a.src = f.v AND a.label = 'CFG' WHERE a.dst <> f.v UNION SELECT d.g, d.o, a.dst FROM c1 d JOIN arc a ON a.g = d.g AND a.src = d.v AND a.label = 'CFG' WHERE a.dst <> d.o AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = d.g AND f.v = d.v)),
  cr AS (SELECT g, v AS o, v FROM f UNION SELECT c.g, c.o, a.dst FROM cr c JOIN arc a ON a.g = c.g AND a.src = c.v AND a.label = 'CFG'),
  st AS (SELECT cr.g, cr.o, cr.v FROM cr JOIN f ON f.g = cr.g AND f.v = cr.v WHERE cr.o <> cr.v),
  o1 AS (SELECT f.g, f.v AS o, a.dst AS v FROM f JOIN arc a ON a.g = f.g AND a.src = f.v AND a.label <> 'CFG' WHERE a.dst <> f.v UNION SELECT d.g, d.o, a.dst FROM o1 d JOIN arc a ON a.g = d.g AND a.src = d.v AND a.label <> 'CFG' WHERE a.dst <> d.o AND NOT EXISTS (SELECT 1 FROM st WHERE st.g = d.g AND st.o = d.o AND st.v = d.v)),
  l1 AS (SELECT f.g, f.v AS o, a.dst AS v FROM f JOIN arc a ON a.g = f.g AND a.src = f.v AND a.label <> 'CFG' WHERE a.dst <> f.v UNION SELECT d.g, d.o, a.dst FROM l1 d JOIN arc a ON a.g = d.g AND a.src = d.v AND a.label <> 'CFG' WHERE a.dst <> d.o AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = d.g AND f.v = d.v)),
  an AS (SELECT g, v AS o, v FROM f UNION SELECT x.g, x.o, a.src FROM an x JOIN arc a ON a.g = x.g AND a.dst = x.v AND a.label = 'CFG'),
  direct AS (SELECT d.g, o AS src, d.v AS dst, 'Data_Flow' AS label FROM d1 d JOIN f ON f.g = d.g AND f.v = d.v UNION SELECT d.g, d.o, d.v, 'Data_Flow' FROM o1 d JOIN st ON st.g = d.g AND st.o = d.o AND st.v = d.v UNION SELECT d.g, o, d.v, 'Control_Flow' FROM c1 d JOIN f ON f.g = d.g AND f.v = d.v),
  sib AS (SELECT DISTINCT l.g, l.o AS src, l.v AS dst, 'Data_Flow' AS label FROM l1 l JOIN f ON f.g = l.g AND f.v = l.v JOIN an x ON x.g = l.g AND x.o = l.o JOIN an y ON y.g = l.g AND y.o = l.v AND y.v = x.v WHERE l.o < l.v
    AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.g = l.g AND cr.o = l.o AND cr.v = l.v) AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.g = l.g AND cr.o = l.v AND cr.v = l.o) AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.g = l.g AND d.src = l.o AND d.dst = l.v))
SELECT * FROM direct UNION SELECT * FROM sib""")
def q_flagged_graph(spark, sf):
    """The graph of flagged vertices alone: what leads to what next, by data, by control, and between siblings."""
    return graph.flagged_graph(*_flagged(spark, sf), ["g"])


@query(f"""WITH {EV}, m AS (SELECT pkg, idx, event_type IN ('click', 'view') AS rec FROM ev WHERE event_type <> 'signup'), r AS (SELECT pkg, idx FROM m WHERE rec), x AS (SELECT *, lag(idx) OVER w AS pi, lag(rec) OVER w AS pr, lead(idx) OVER w AS ni, lead(rec) OVER w AS nr FROM m WINDOW w AS (PARTITION BY pkg ORDER BY idx))
SELECT pkg, CASE WHEN NOT pr AND pi = idx - 1 THEN 'x' || pi ELSE 'r' || (SELECT max(r.idx) FROM r WHERE r.pkg = x.pkg AND r.idx < x.idx) END AS src, 'x' || idx AS dst FROM x WHERE NOT rec AND ((NOT pr AND pi = idx - 1) OR EXISTS (SELECT 1 FROM r WHERE r.pkg = x.pkg AND r.idx < x.idx))
UNION ALL SELECT pkg, 'x' || idx, 'r' || (SELECT min(r.idx) FROM r WHERE r.pkg = x.pkg AND r.idx > x.idx) FROM x WHERE NOT rec AND NOT coalesce(NOT nr AND ni = idx + 1, false) AND EXISTS (SELECT 1 FROM r WHERE r.pkg = x.pkg AND r.idx > x.idx)""")
def q_missing_events(spark, sf):
    """Events without a vertex, put between those that have one."""
    e = events(spark, sf)
    missing = e.where("event_type IN ('purchase', 'error')").select("pkg", "idx", _s("x{}", "idx").alias("v"))
    recorded = e.where("event_type IN ('click', 'view')").select("pkg", "idx", _s("r{}", "idx").alias("v"))
    return graph.with_missing(missing, recorded, ["pkg"])


@query(f"""WITH {ARCS}, base AS (SELECT DISTINCT g, src, dst FROM arc WHERE label = 'DDG'), part AS (SELECT DISTINCT g, src % 4 AS part, src, dst FROM arc WHERE label = 'CFG'), bv AS (SELECT g, src AS v FROM base UNION SELECT g, dst FROM base),
  ent AS (SELECT g, part, min(src) AS v FROM part GROUP BY ALL), ok AS (SELECT g, part FROM ent WHERE NOT EXISTS (SELECT 1 FROM bv WHERE bv.g = ent.g AND bv.v = ent.v)), more AS (SELECT DISTINCT p.g, p.src, p.dst FROM part p JOIN ok ON ok.g = p.g AND ok.part = p.part)
SELECT g, src, dst, 'DDG' AS labels FROM base UNION ALL SELECT g, src, dst, 'CFG' FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.g = m.g AND b.src = m.src AND b.dst = m.dst)""")
def q_merged_programs(spark, sf):
    """Parts of a program join a graph where their entrance isn't in it yet; edges that are there keep their labels."""
    a = V.arcs(spark, sf)
    ends = lambda e, *more: e.select("g", *more, F.col("src").alias("v")).unionByName(e.select("g", *more, F.col("dst").alias("v"))).distinct()
    base = a.where("label = 'DDG'").select("g", "src", "dst").distinct().withColumn("labels", F.array(F.lit("DDG")))
    part = a.where("label = 'CFG'").select("g", (F.col("src") % 4).alias("part"), "src", "dst").distinct().withColumn("labels", F.array(F.lit("CFG")))
    entrances = part.groupBy("g", "part").agg(F.min("src").alias("v"))
    _, edges = graph.merged_programs((ends(base), base), (ends(part, "part"), part), entrances, ["g"])
    return edges.select("g", "src", "dst", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH RECURSIVE {_FLAG}, s AS (SELECT g, v FROM f WHERE v < 200), w AS (SELECT g, v AS o, v FROM s UNION SELECT w.g, w.o, a.dst FROM w JOIN arc a ON a.g = w.g AND a.src = w.v AND a.label <> 'CFG' WHERE w.v = w.o OR NOT EXISTS (SELECT 1 FROM f WHERE f.g = w.g AND f.v = w.v)),
  p AS (SELECT g, v AS a, lead(v) OVER (PARTITION BY g ORDER BY v) AS b FROM s) SELECT p.g, p.a, p.b, EXISTS (SELECT 1 FROM w WHERE w.g = p.g AND w.o = p.a AND w.v = p.b) AS linked FROM p WHERE b IS NOT NULL""")
def q_data_paths(spark, sf):
    a, f = _flagged(spark, sf)
    s = f.where("v < 200")
    pairs = s.select("g", F.col("v").alias("a"), F.lead("v").over(Window.partitionBy("g").orderBy("v")).alias("b")).where("b IS NOT NULL")
    return graph.data_paths(pairs, a, f, ["g"])


# names in scopes


@query(f"""WITH {EV}, ref AS (SELECT event_id, pkg, 'v' || (user_id % 3) AS name, line, 'a' || pkg || '.js::program' || CASE line % 3 WHEN 0 THEN '' WHEN 1 THEN ':f' || (user_id % 2) ELSE ':f' || (user_id % 2) || ':g' END AS scope FROM ev WHERE event_type = 'view'),
  b AS (SELECT pkg, 'v' || (user_id % 3) AS name, line, idx AS seq, event_id AS value, 'a' || pkg || '.js::program' || CASE line % 2 WHEN 0 THEN '' ELSE ':f' || (user_id % 2) END AS scope FROM ev WHERE event_type = 'click' AND line > 0),
  cand AS (SELECT r.event_id, b.value, row_number() OVER (PARTITION BY r.event_id ORDER BY length(b.scope) DESC, b.seq DESC) AS k FROM ref r JOIN b ON b.pkg = r.pkg AND b.name = r.name AND (r.scope = b.scope OR starts_with(r.scope, b.scope || ':')) AND b.line <= r.line WHERE r.line > 0)
SELECT r.event_id AS ref, CASE WHEN c.value IS NOT NULL THEN c.value WHEN r.name = 'v0' THEN -1 WHEN r.name = 'v1' THEN -2 END AS value, CASE WHEN c.value IS NOT NULL THEN 'scope' WHEN r.name = 'v0' THEN 'file' WHEN r.name = 'v1' THEN 'global' END AS level FROM ref r LEFT JOIN cand c ON c.event_id = r.event_id AND c.k = 1""")
def q_scoped_names(spark, sf):
    """What a name holds: in its scope, in those around it, in its file, anywhere."""
    e = events(spark, sf)
    i, u = F.col("line"), F.col("user_id")
    name, top = F.concat(F.lit("v"), u % 3), _s("a{}.js::program", "pkg")
    f = F.concat(F.lit(":f"), u % 2)
    refs = e.where("event_type = 'view'").select("pkg", F.col("event_id").alias("ref"), name.alias("name"), "line", F.concat(top, F.when(i % 3 == 0, "").when(i % 3 == 1, f).otherwise(F.concat(f, F.lit(":g")))).alias("scope"))
    bind = e.where("event_type = 'click'").select("pkg", F.concat(top, F.when(i % 2 == 0, "").otherwise(f)).alias("scope"), name.alias("name"), "line", F.col("idx").alias("seq"), F.col("event_id").alias("value"))
    p = e.select("pkg").distinct()
    wide = p.select("pkg", F.lit("v0").alias("name"), F.lit("file").alias("level"), F.lit(-1).cast("long").alias("value"))
    for nm, level, v in (("v0", "global", -3), ("v1", "global", -2)):
        wide = wide.unionByName(p.select("pkg", F.lit(nm).alias("name"), F.lit(level).alias("level"), F.lit(v).cast("long").alias("value")))
    return joins.scoped_names(refs, bind, wide, ["pkg"]).select("ref", "value", "level")


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE event_type <> 'error' AND idx % 2 = 0), last AS (SELECT pkg, event_type, user_id, line, max(idx) AS idx FROM k GROUP BY ALL) SELECT pkg, user_id, CAST(row_number() OVER (PARTITION BY pkg ORDER BY idx) - 1 AS BIGINT) AS log_index, idx AS pos FROM last""")
def q_api_log(spark, sf):
    """Recorded calls as JSON files, read back as a log: known calls, the last of each caller, numbered."""
    e = events(spark, sf).where("idx % 2 = 0")
    caller = F.struct(F.concat(F.lit("package/f"), "user_id", F.lit(".js")).alias("file"), *[F.col("line").cast("int").alias(c) for c in ("start_line", "start_column", "end_line", "end_column")])
    item = F.struct(F.col("event_type").alias("type"), F.substring_index("qn", ".", 1).alias("module"), F.substring_index("qn", ".", -1).alias("function"), F.col("idx").cast("string").alias("arguments"), F.lit("").alias("result"), caller.alias("caller"))
    rows = e.groupBy("pkg").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("i")))), lambda x: x["i"])).alias("text"))
    out = artefacts.api_log(artefacts.api_events(spark, _files(rows, "pkg", "text", "api")), V.catalog(spark))
    return out.select(_key().alias("pkg"), F.regexp_extract("file", r"f(\d+)", 1).cast("long").alias("user_id"), F.col("log_index").cast("long").alias("log_index"), F.col("arguments").cast("long").alias("pos"))

