"""Queries of programs, annotations, attribution and judges that read files, and of a package's whole run."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import javascript
from ..operators import attribution, callgraph, enrichment, graph, interpreter, loops, model, programs, slicing, verdict
from . import views as V
from .code import PARTS, _graphs, _s
from .oracle import EV
from .registry import query
from .views import events, table


@query(f"""WITH {EV}, n AS (SELECT event_id, event_type AS t, line, user_id AS u FROM ev)
SELECT event_id, CASE t WHEN 'purchase' THEN 'Method name: c' || line || CASE line % 4 WHEN 0 THEN ', third-party call of m' || u || '.get. Module: mb. API behavior: ab.' WHEN 1 THEN ', third-party call of m' || u || '.get. Module: mb. API behavior: not documented.' WHEN 2 THEN ', third-party call of m' || u || '.get. API behavior: ab.' ELSE ', is a third-party API call of m' || u || '.get with module name: m' || u || '.' END
  WHEN 'error' THEN CASE WHEN line % 2 = 0 THEN 'Method name: c' || line || ' is statically unresolved call.' ELSE 'Code: a b contains statically unresolved call.' END
  WHEN 'signup' THEN 'Method name: c' || line || CASE line % 3 WHEN 0 THEN ' is a conditional sensitive API call of ' WHEN 1 THEN ' is a sensitive property access of ' ELSE ' is a sensitive API call of ' END || 'child_process.exec.' WHEN 'click' THEN 'Method name: x is a sensitive API call of <unknown>.' END || ' [Node ID: ' || event_id || ']' AS annotation FROM n""")
def q_static_annotation(spark, sf):
    e = events(spark, sf)
    t, i = F.col("event_type"), F.col("line")
    kind = F.when(t == "purchase", "THIRD_PARTY_CALL").when(t == "error", "UNRESOLVED_CALL").when(t == "view", "FUNCTION_CALL").when((t == "signup") & (i % 3 == 0), "CONDITIONAL_CALL").when((t == "signup") & (i % 3 == 1), "FIELD_ACCESS").otherwise("CALL")
    n = e.select(
        F.col("event_id").alias("node"), F.when(t == "click", "x").alias("name"), F.lit(" a \n b").alias("code"), kind.alias("call_type"), t.isin("signup", "click").alias("sensitive"), F.when(t == "signup", "child_process.exec").alias("qualified_name"),
        F.when(~((t == "error") & (i % 2 == 1)), F.concat(F.lit("c"), i)).alias("call_name"), F.concat(F.lit("m"), "user_id").alias("module"), F.lit("get").alias("property"), F.when(i % 4 < 2, "mb").alias("module_behavior"), F.when(i % 2 == 0, "ab").alias("behavior"),
    )
    return slicing.static_annotation(n).select(F.col("node").alias("event_id"), "annotation")


_DYN = f"""{EV}, n AS (SELECT event_id, event_type AS t, line, 'Method name: c' || line AS m, ' [Node ID: ' || event_id || ']' AS z, CASE WHEN line % 2 = 0 THEN ' Resolved arguments: a. Resolved return value: N/A.' ELSE '' END AS res FROM ev)"""


@query(f"""WITH {_DYN} SELECT event_id, CASE t
  WHEN 'click' THEN CASE line % 3 WHEN 0 THEN m || ' is a sensitive API call of fs.readFile.' || res WHEN 1 THEN m || ' is a sensitive API call of fs.readFile. Dynamically captured 2 invocation(s); resolved eval source argument(s): `x y` | `z`.' ELSE m || ' is a conditional sensitive API call of fs.readFile. This node was NOT executed during dynamic analysis.' END
  WHEN 'view' THEN 'require() call importing module: fs.' WHEN 'purchase' THEN CASE WHEN line % 2 = 0 THEN m || ', third-party call resolved with behavior: [b] [io]' ELSE m || ', third-party API call of mm.get. No API trace captured in dynamic analysis.' END
  WHEN 'signup' THEN CASE WHEN line % 2 = 0 THEN m || ', previously unresolved call resolved with behavior: [b] [io]' ELSE m || ', statically unresolved call. No API trace captured in dynamic analysis.' END
  ELSE CASE line % 4 WHEN 0 THEN m || ', sensitive API call with resolved call-chain behavior: [b] [io]' WHEN 1 THEN m || ' is a sensitive property access of fs.readFile.' WHEN 2 THEN m || ', sensitive API call with resolved call-chain behavior: [b] [io]' ELSE m || ' is a conditional sensitive API call of fs.readFile.' END END || z AS annotation FROM n""")
def q_dynamic_annotation(spark, sf):
    e = events(spark, sf)
    t, i = F.col("event_type"), F.col("line")
    pending = F.when(t == "click", "conditional").when(t == "purchase", "third_party").when(t == "signup", "unresolved")
    kind = F.when(t == "view", "REQUIRE_CALL").when((t == "error") & (i % 4 == 1), "INDEX_ACCESS").when((t == "error") & (i % 4 == 3), "CONDITIONAL_CALL").otherwise("CALL")
    n = e.select(
        F.col("event_id").alias("node"), kind.alias("call_type"), t.isin("click", "error").alias("sensitive"), F.lit("fs.readFile").alias("qualified_name"), F.concat(F.lit("c"), i).alias("call_name"), F.when(i % 2 == 0, "File").otherwise("Path").alias("domain"),
        F.lit("mm").alias("module"), F.lit("get").alias("property"), F.when((i % 2 == 0) & (t != "click"), "b").alias("behavior"), F.lit("a").alias("resolved_args"), F.lit("").alias("resolved_result"), ((t == "click") & (i % 3 == 0)).alias("resolved"),
        F.when((t == "click") & (i % 3 == 1), F.lit(2)).cast("bigint").alias("evals"), F.when((t == "click") & (i % 3 == 1), F.array(F.lit("x\n  y"), F.lit("z"))).alias("eval_args"), F.lit("io").alias("io"), pending.alias("pending"), F.when(t == "view", "fs").alias("require"),
    )
    return slicing.dynamic_annotation(n).select(F.col("node").alias("event_id"), "annotation")


@query(f"""WITH {EV}, n AS (SELECT pkg, user_id % 5 AS component, idx, 'f' || (user_id % 3) || '.js' AS file, line // 10 AS st, event_type, line FROM ev WHERE event_type <> 'error'),
  s AS (SELECT pkg, component, file, st, min(idx) AS o, count(DISTINCT CASE WHEN event_type = 'click' THEN line % 4 END) AS infos FROM n GROUP BY ALL),
  f AS (SELECT pkg, component, file, string_agg('s' || st || '+' || infos, '|' ORDER BY st) AS code FROM s GROUP BY ALL) SELECT pkg, component, string_agg(file || ':' || code, ';' ORDER BY file) AS slices, CASE WHEN component < 3 THEN component * 2 ELSE 0 END AS cfg_order FROM f GROUP BY ALL""")
def q_component_structs(spark, sf):
    """Nodes of components, their statements with what is said of them, as slices of files, as what a judge is given."""
    e = events(spark, sf)
    n = e.select("pkg", (F.col("user_id") % 5).alias("component"), F.col("idx").alias("pos"), F.when(F.col("event_type") == "error", "METHOD_PARAMETER_IN").otherwise("CALL").alias("type"), F.concat(F.lit("f"), F.col("user_id") % 3, F.lit(".js")).alias("file"), F.floor(F.col("line") / 10).alias("statement"), F.when(F.col("event_type") == "click", F.concat(F.lit("i"), F.col("line") % 4)).alias("annotation"), F.array(F.lit("c")).alias("callees"))
    st = slicing.statements(n, ["pkg", "component"])
    text = F.concat(F.lit("s"), "statement", F.lit("+"), F.size("infos"))
    pieces = st.groupBy("pkg", "component", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("statement", text.alias("t")))), lambda x: x["t"]), "\n").alias("slice"), F.flatten(F.collect_list("callees")).alias("callees"))
    slices = slicing.file_slices(pieces, ["pkg", "component"])
    none = F.array().cast("array<bigint>")
    order = e.select("pkg").distinct().select("pkg", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])).alias("component")).select("pkg", "component", (F.col("component") * 2).alias("cfg_order"), none.alias("predecessors"), none.alias("successors"))
    c = slicing.component_structs(slices, order, ["pkg"])
    shape = "struct<sliced_code:array<struct<file:string,code_snippet:array<string>,callee_info:array<string>>>>"
    files = F.from_json("code_slice", shape)["sliced_code"]
    one = F.array_join(F.transform(files, lambda f: F.concat(f["file"], F.lit(":"), F.array_join(f["code_snippet"], "|"))), ";")
    return c.where("size(predecessors) = 0").select("pkg", "component", one.alias("slices"), F.col("cfg_order").cast("long").alias("cfg_order"))


@query(f"""WITH {EV}, u AS (SELECT DISTINCT pkg, user_id FROM ev) SELECT pkg, 'f' || user_id || '.js() in a.js -> function g in b.js|f' || user_id || '.js() in a.js -> function h in b.js' AS callees FROM u""")
def q_callee_lines(spark, sf):
    u = events(spark, sf).select("pkg", "user_id").distinct()
    c = u.select("pkg", F.col("user_id").alias("node"), _s("f{}.js", "user_id").alias("name"), F.lit("a.js").alias("file"), F.explode(F.array(F.struct(F.lit(2).alias("pos"), F.lit("h").alias("callee")), F.struct(F.lit(1).alias("pos"), F.lit("g").alias("callee")))).alias("c"), F.lit("b.js").alias("callee_file"))
    return slicing.callee_lines(c.select("pkg", "node", "name", "file", "c.*", "callee_file"), ["pkg"]).select("pkg", F.array_join("callees", "|").alias("callees"))


# programs from trees

#: For each user a file: a module is loaded into a name, a function takes two names and runs a command, an event's line tells which.
_PROG = f"""{EV}, u AS (SELECT user_id, min(line) % 4 AS k FROM ev GROUP BY user_id)"""


def _programs(spark, sf):
    u = events(spark, sf).groupBy("user_id").agg((F.min("line") % 4).alias("k"))
    node = lambda id_, label, name=None, code=None, ord_=None, arg=None, full=None, ref=None: F.struct(*[(x if not isinstance(x, int | str | type(None)) else F.lit(x)).cast(t).alias(c) for x, c, t in ((id_, "id", "long"), (label, "label", "string"), (name, "name", "string"), (code, "code", "string"), (ord_, "ord", "int"), (arg, "arg", "int"), (full, "full_name", "string"), (ref, "method_full_name", "string"))])
    k = F.col("k")
    module = F.when(k == 0, "'child_process'").when(k == 1, "'fs'").when(k == 2, "'left-pad'").otherwise("name")
    nodes = [
        node(1, "METHOD", ":program", full="a.js::program"), node(2, "BLOCK", ord_=1),
        # const m = require(module)
        node(10, "CALL", "<operator>.assignment", "m = require()", 1), node(11, "IDENTIFIER", "m", "m", 1, 1), node(12, "CALL", "require", "require()", 2, 2), node(13, F.when(k == 3, "IDENTIFIER").otherwise("LITERAL"), code=module, name=F.when(k == 3, "name"), ord_=1, arg=1),
        # f("ls" + k, cb)
        node(20, "CALL", "f", "f()", 2), node(21, "CALL", "<operator>.addition", "'ls' + 1", 2, 1), node(22, "LITERAL", code="'ls '", ord_=1, arg=1), node(23, "LITERAL", code=F.concat(F.lit("'"), F.col("user_id"), F.lit("'")), ord_=2, arg=2),
        # function f(c) { m.exec(c); return c }
        node(30, "METHOD", "f", "f", 3, full="a.js::program:f"), node(31, "METHOD_PARAMETER_IN", "c", "c", 1), node(32, "BLOCK", ord_=2), node(33, "CALL", "exec", "m.exec(c)", 1), node(34, "CALL", "<operator>.fieldAccess", "m.exec", 1, 0), node(35, "IDENTIFIER", "m", "m", 1, 1), node(36, "FIELD_IDENTIFIER", "exec", "exec", 2, 2), node(37, "IDENTIFIER", "c", "c", 2, 1), node(38, "RETURN", ord_=2), node(39, "IDENTIFIER", "c", "c", 1),
    ]
    tree = [(1, 2), (2, 10), (10, 11), (10, 12), (12, 13), (2, 20), (20, 21), (21, 22), (21, 23), (1, 30), (30, 31), (30, 32), (32, 33), (33, 34), (34, 35), (34, 36), (33, 37), (32, 38), (38, 39)]
    given = [(10, 11), (10, 12), (12, 13), (20, 21), (21, 22), (21, 23), (34, 35), (34, 36), (33, 37)]
    edge = lambda ps, label: [F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"), F.lit(label).alias("label")) for a, b in ps]
    n = u.select("user_id", F.explode(F.array(*nodes)).alias("n")).select("user_id", "n.*")
    e = u.select("user_id", F.explode(F.array(*edge(tree, "AST"), *edge(given, "ARGUMENT"))).alias("e")).select("user_id", "e.*")
    return n, e


@query(f"""WITH {_PROG} SELECT user_id, 33 AS node, CASE k WHEN 0 THEN 'child_process.exec' WHEN 1 THEN 'fs.exec' WHEN 2 THEN 'left-pad.exec' ELSE '*.exec' END AS qn, CASE k WHEN 2 THEN 'third_party' WHEN 3 THEN 'unresolved' ELSE 'external' END AS state, true AS literal, 31 AS source FROM u
  UNION ALL SELECT user_id, 20, 'f', 'local', true, 30 FROM u UNION ALL SELECT user_id, 12, CASE k WHEN 0 THEN 'child_process' WHEN 1 THEN 'fs' WHEN 2 THEN 'left-pad' END, CASE WHEN k = 3 THEN 'unresolved' ELSE 'module' END, k <> 3, NULL FROM u""")
def q_programs_from_trees(spark, sf):
    """Syntax trees as a parser gives them, made into programs and interpreted: names, a call of a local function, its parameter, a module's method."""
    p = programs.statements_of(*_programs(spark, sf), ["user_id"])
    out = interpreter.interpreted(p, ["user_id"]).where("node IN (12, 20, 33)")
    return out.select("user_id", F.col("node").cast("int").alias("node"), "qn", "state", "literal", F.array_max("sources").cast("int").alias("source"))


@query(f"""WITH {EV}, n AS (SELECT * FROM ev WHERE event_type IN ('click', 'view')), e AS (SELECT pkg, user_id, line, min(idx) AS idx FROM ev WHERE event_type IN ('purchase', 'error') AND line % 3 > 0 GROUP BY ALL)
SELECT n.event_id, e.idx FROM n LEFT JOIN e ON e.pkg = n.pkg AND e.user_id = n.user_id AND e.line = n.line""")
def q_node_events(spark, sf):
    """Nodes and the first event that a run made at their place, which ends where their text does."""
    e = events(spark, sf)
    n = e.where("event_type IN ('click', 'view')").select("pkg", F.col("event_id").alias("node"), F.concat(F.lit("./f"), "user_id", F.lit(".js")).alias("file"), (F.col("line") + 1).alias("line"), F.lit(4).alias("col"), F.lit(" f(\nab)\n").alias("code"))
    ev = e.where("event_type IN ('purchase', 'error')").select("pkg", "idx", F.lit("function").alias("type"), F.concat(F.lit("f"), "user_id", F.lit(".js")).alias("file"), F.col("line").cast("int").alias("sl"), F.when(F.col("line") % 3 == 0, 5).otherwise(4).alias("sc"), (F.col("line") + 1).cast("int").alias("el"), F.lit(3).alias("ec"))
    return programs.with_events(n, ev, ["pkg"]).select(F.col("node").alias("event_id"), "idx")


@query(f"""WITH {EV} SELECT event_id, 'l' || line || '|?|' || user_id AS texts, CASE WHEN line % 2 = 0 THEN user_id END AS pdg, CASE event_type WHEN 'click' THEN 'fs:readFile' WHEN 'error' THEN 'misc:noop' WHEN 'view' THEN 'hostname:' WHEN 'signup' THEN 'child_process:exec' ELSE 'https:request' END AS path FROM ev""")
def q_call_values(spark, sf):
    """What calls are given: literals, names, functions; the last one's program; and the object that a catalog's name stands for."""
    e = events(spark, sf).withColumn("g", F.lit(1))
    arg = lambda pos, label, code, type_: F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), code.alias("code"), F.lit(type_).alias("type_full_name"))
    args = F.array(arg(1, "LITERAL", _s(" \"'l{}'\"", "line"), None), arg(2, "IDENTIFIER", F.lit("x"), None), arg(3, "LITERAL", F.col("user_id").cast("string"), None), arg(4, "METHOD_REF", F.lit("f"), "a.js::program:<lambda>1"))
    a = e.select("g", F.col("event_id").alias("call"), "line", "user_id", F.explode(args).alias("a")).select("g", "call", "line", "user_id", "a.*")
    a = a.withColumn("method_full_name", F.when((F.col("pos") == 4) & (F.col("line") % 2 == 0), F.concat(F.lit(" p"), "user_id")))
    texts = programs.literal_arguments(a, ["g"])
    progs = e.select("g", F.col("user_id").alias("pdg"), F.concat(F.lit("p"), "user_id").alias("full_name")).distinct()
    lam = programs.lambda_argument(a, progs, ["g"])
    name = F.when(F.col("event_type") == "view", "global.hostname").otherwise(F.col("qn"))
    path = programs.qualified_path(name)
    own = e.select(F.col("event_id").alias("call"), F.concat(path["root"], F.lit(":"), F.array_join(path["path"], ".")).alias("path"))
    return texts.join(lam, ["g", "call"], "left").join(own, "call").select(F.col("call").alias("event_id"), F.array_join(F.transform("texts", lambda t: F.coalesce(t, F.lit("?"))), "|").alias("texts"), "pdg", "path")


@query(f"""WITH {EV} SELECT event_id, CASE line % 4 WHEN 0 THEN 'eval_wrap_1(); g(eval("b")); x = eval("c")' || chr(10) || chr(10) || 'function eval_wrap_1() {{' || chr(10) || 'a' || user_id || ';' || chr(10) || '}}' || chr(10)
  WHEN 1 THEN 'eval("a" + b)' WHEN 2 THEN 'var y = eval("a")' ELSE 'if (z) {{ eval_wrap_1() }} // eval("q")' || chr(10) || chr(10) || 'function eval_wrap_1() {{' || chr(10) || 'ab;' || chr(10) || '}}' || chr(10) END AS code FROM ev WHERE line % 4 <> 0 UNION ALL
  SELECT event_id, 'eval_wrap_1(); g(eval_wrap_2()); x = eval("c")' || chr(10) || chr(10) || 'function eval_wrap_1() {{' || chr(10) || 'a' || user_id || ';' || chr(10) || '}}' || chr(10) || chr(10) || 'function eval_wrap_2() {{' || chr(10) || 'b;' || chr(10) || '}}' || chr(10) FROM ev WHERE line % 4 = 0""")
def q_inlined_evals(spark, sf):
    e = events(spark, sf)
    k = F.col("line") % 4
    code = F.when(k == 0, _s('eval("a{}"); g(eval("b")); x = eval("c")', "user_id")).when(k == 1, 'eval("a" + b)').when(k == 2, 'var y = eval("a")').otherwise("if (z) { eval('a' + \"b\") } // eval(\"q\")")
    return e.select("event_id", javascript.evals_inlined(code).alias("code"))


# attribution


@query(f"""WITH RECURSIVE {EV}, f AS (SELECT DISTINCT pkg, file, CASE WHEN user_id % 5 <> 0 THEN 'p' || (user_id % 7) END AS m FROM ev), d AS (SELECT DISTINCT pkg, 'p' || (user_id % 7) AS a, 'p' || ((user_id * 3 + 1) % 7) AS b FROM ev),
  n AS (SELECT pkg, a AS x FROM d UNION SELECT pkg, b FROM d), cl AS (SELECT pkg, x, x AS y FROM n UNION SELECT cl.pkg, cl.x, d.b FROM cl JOIN d ON d.pkg = cl.pkg AND d.a = cl.y)
SELECT pkg, file, '' AS root FROM f WHERE m IS NULL UNION SELECT f.pkg, file, 'node_modules/' || cl.y || '/' FROM f JOIN cl ON cl.pkg = f.pkg AND cl.x = f.m""")
def q_owner_roots(spark, sf):
    """What a file's package may call: its own module root and those of all that it depends on."""
    e = events(spark, sf).withColumnRenamed("pkg", "g")
    u = F.col("user_id")
    deps = e.select("g", F.concat(F.lit("p"), u % 7).alias("parent"), F.concat(F.lit("p"), (u * 3 + 1) % 7).alias("child")).distinct()
    return attribution.owner_roots(e.select("g", "file"), graph.closure(deps, ["g"]), ["g"]).withColumnRenamed("g", "pkg")


@query(f"""WITH {EV}, n AS (SELECT event_id AS node, user_id, line, event_type, line % 3 AS p FROM ev) SELECT node, 'chain' AS what, 'node_modules/m' || user_id || '.js' AS value FROM n WHERE line % 2 = 1 AND NOT (p = 1 AND event_type = 'view') AND NOT (line % 5 = 0 AND p <> 2)
  UNION ALL SELECT node, 'require', 'r' || line FROM n WHERE line % 2 = 1 AND p = 1 AND event_type = 'view'""")
def q_third_party_calls(spark, sf):
    e = events(spark, sf)
    i = F.col("line")
    file = F.when(i % 2 == 1, _s("node_modules/m{}.js", "user_id")).otherwise(_s("src/m{}.js", "user_id"))
    one = F.lit(1)
    callees = e.select(F.lit(1).alias("g"), F.col("event_id").alias("node"), F.lit(0).alias("pos"), F.struct(file.alias("file"), one.alias("sl"), one.alias("sc"), one.alias("el"), one.alias("ec")).alias("callee"))
    req = F.col("event_type") == "view"
    nodes = e.select(F.lit(1).alias("g"), F.col("event_id").alias("node"), (i % 5 == 0).alias("visited"), F.when(i % 3 == 1, "unresolved").when(i % 3 == 2, "third_party").alias("pending"), F.when(req, "module").alias("event_module"), F.when(req, "require").alias("event_function"), F.when(req, _s('{"id": "r{}"}'.replace("{\"id", "[[\"id").replace("\"}", "\"]]"), "line")).alias("event_arguments"))
    nodes = nodes.withColumn("event_arguments", F.regexp_replace(F.regexp_replace("event_arguments", r"^\[\[", "{"), r"\]\]$", "}"))
    chains, requires = attribution.third_party_calls(callees, nodes, ["g"])
    return chains.select("node", F.lit("chain").alias("what"), F.col("callee.file").alias("value")).unionByName(requires.select("node", F.lit("require").alias("what"), F.col("module").alias("value")))


def _summing(text: str) -> str:
    """A judge for tests: how many calls a sequence has."""
    return json.dumps({"behavior_description": f"{text.count('qualified_name')} calls", "key_files": []})


_CHAINED = f"""{EV}, u AS (SELECT g, usr, CAST(row_number() OVER (PARTITION BY g ORDER BY usr) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT user_id % {PARTS} AS g, user_id AS usr FROM ev) t),
  f2f AS (SELECT g, i AS a, (i * 2 + 1) % n AS b FROM u), lg AS (SELECT user_id % {PARTS} AS g, 'f' || user_id || '.js' AS file, line % 20 AS sl, row_number() OVER (PARTITION BY user_id % {PARTS} ORDER BY event_id) - 1 AS idx, event_type FROM ev)"""


@query(f"""WITH RECURSIVE {_CHAINED}, r AS (SELECT g, i AS o, i AS v FROM u WHERE i IN (1, 2) UNION SELECT r.g, r.o, f.b FROM r JOIN f2f f ON f.g = r.g AND f.a = r.v),
  h AS (SELECT r.g, r.o, lg.file, lg.sl, min(idx) AS idx FROM r JOIN u ON u.g = r.g AND u.i = r.v JOIN lg ON lg.g = r.g AND lg.file = 'f' || u.usr || '.js' AND lg.sl BETWEEN u.i % 7 AND u.i % 7 + 9 GROUP BY ALL)
SELECT g, o AS node, count(DISTINCT idx) AS n, count(DISTINCT idx) || ' calls' AS behavior FROM h GROUP BY g, o""")
def q_chain_behaviors(spark, sf):
    """Chains of third-party calls, the events that a run made in them, and what those do together as a judge says; without recovery of others."""
    spans, edges = _graphs(spark, sf)
    _, f2f = callgraph.edges_of(spans, edges, ["g"])
    calls = spans.where("kind = 'functions' AND at IN (1, 2)").select("g", F.col("at").alias("node"), F.lit(0).alias("pos"), callgraph.span().alias("callee"))
    e = events(spark, sf)
    g = F.col("user_id") % PARTS
    from pyspark.sql import Window

    sl = (F.col("line") % 20).cast("int")
    at = F.lit(1)
    log_ = e.select(g.alias("g"), (F.row_number().over(Window.partitionBy(g).orderBy("event_id")) - 1).alias("idx"), _s("f{}.js", "user_id").alias("file"), sl.alias("sl"), at.alias("sc"), sl.alias("el"), at.alias("ec"), "qn", F.lit("Environment").alias("domain"), F.lit(None).cast("string").alias("behavior"), F.lit("").alias("arguments"), F.lit("").alias("result"))
    closure = e.select(g.alias("g"), F.lit("x").alias("pkg"), F.lit("x").alias("dep")).distinct()
    chains, roots, anchors = attribution.chain_matches(calls, f2f, log_, closure, ["g"])
    none = log_.select("g", "idx").where("false")
    out = attribution.behaviors(log_, none, chains, roots, anchors, ["g"], _summing, recover=False)
    return out.select("g", "node", F.col("n").cast("long").alias("n"), "behavior")


# judges that read files


def _reader(text: str) -> str:
    """A judge for tests that reads: it asks for what a command or file names, and judges by what it was served."""
    body = json.loads(text[text.index("\n\n{") + 2 :])
    served = [r for r in body.get("read_results", []) if r.get("status") == "ok"]
    seen = " ".join([body.get("entry_content", ""), *(r["content"] for r in served)])
    if "broken" in body.get("shell_command", ""):
        return "no JSON"
    wanted = [w for w in (body.get("shell_command", "") + " " + seen).replace('"', " ").split() if w.endswith((".sh", ".js")) and w.startswith("./") and w not in [p for t in body.get("prior_reads", []) for p in t["requested_paths"]]]
    if wanted and body["remaining_hops"]:
        return json.dumps({"action": "read_files", "paths": wanted, "running_synthesis": seen[:20]})
    verdict_ = "malicious" if "evil" in seen else "benign"
    return json.dumps({"action": "final", "label": verdict_, "judgement": verdict_, "reason": "r", "explanation": str(body["turn"]), "executed_js_files": ["a.js", 1]})


def _package_files(spark, sf):
    p = events(spark, sf).groupBy("pkg").agg(F.min("line").alias("k"))
    bad = F.when(F.col("pkg") % 3 == 0, "evil").otherwise("good")
    files = F.array(F.struct(F.lit("run.sh").alias("path"), F.concat(F.lit("sh ./next.sh "), "pkg").alias("text")), F.struct(F.lit("next.sh").alias("path"), bad.alias("text")), F.struct(F.lit("index.js").alias("path"), F.lit('require("./lib.js")').alias("text")), F.struct(F.lit("lib.js").alias("path"), bad.alias("text")), F.struct(F.lit("x.node").alias("path"), F.lit("\0").alias("text")))
    return p.select("pkg"), p.select("pkg", F.explode(files).alias("f")).select("pkg", "f.*")


@query(f"""WITH {EV}, p AS (SELECT DISTINCT pkg FROM ev) SELECT pkg, CASE WHEN pkg % 5 = 0 THEN 'warning' WHEN pkg % 3 = 0 THEN 'malicious' ELSE 'benign' END AS label, CASE WHEN pkg % 5 = 0 THEN '' ELSE '3' END AS explanation, CASE WHEN pkg % 5 = 0 THEN '' ELSE 'a.js' END AS executed FROM p""")
def q_shell_commands(spark, sf):
    """Install commands whose judge reads the scripts that they run, and the scripts that those run; one that answers nonsense."""
    p, files = _package_files(spark, sf)
    c = p.withColumn("command", F.when(F.col("pkg") % 5 == 0, "broken ./run.sh").otherwise("sh ./run.sh"))
    out = loops.judged_commands(loops.with_files(c, files, ["pkg"]), _reader)
    return out.select("pkg", "label", "explanation", F.array_join("executed", ",").alias("executed"))


@query(f"""WITH {EV}, p AS (SELECT DISTINCT pkg FROM ev) SELECT pkg, 'index.js' AS entry, CASE WHEN pkg % 3 = 0 THEN 'malicious' ELSE 'benign' END AS judgement, 'index.js,lib.js' AS served FROM p UNION ALL SELECT pkg, 'gone', 'undetermined', '' FROM p UNION ALL SELECT pkg, 'x.node', 'undetermined', '' FROM p""")
def q_fallback_entries(spark, sf):
    """Entries that there is no graph of, judged by their text and what it names."""
    p, files = _package_files(spark, sf)
    e = p.select("pkg", F.explode(F.array(*map(F.lit, ("index.js", "gone", "x.node")))).alias("entry"))
    out = loops.judged_entries(loops.with_files(e, files, ["pkg"]), _reader)
    return out.select("pkg", "entry", "judgement", F.array_join("served", ",").alias("served"))


def _rereader(text: str) -> str:
    body = json.loads(text[text.index("\n\n{") + 2 :])
    seen = " ".join(r.get("content", "") for r in body["read_files"])
    return json.dumps({"judgement": "malicious" if "evil" in seen else "odd", "reason": "read", "files_to_read": ["package/lib.js"]})


@query(f"""WITH {EV}, p AS (SELECT DISTINCT pkg FROM ev) SELECT pkg, CASE pkg % 4 WHEN 0 THEN 'malicious' WHEN 1 THEN 'undetermined' WHEN 2 THEN CASE WHEN pkg % 3 = 0 THEN 'malicious' ELSE 'benign' END ELSE 'benign' END AS judgement, CASE pkg % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS hops FROM p""")
def q_reread_reports(spark, sf):
    """Reports that ask for files: a native binary, one that isn't there, ones that change the verdict, none."""
    p, files = _package_files(spark, sf)
    k = F.col("pkg") % 4
    report = F.when(k == 0, '{"judgement": "benign", "files_to_read": ["x.node"], "node_to_be_checked": ["7"]}').when(k == 1, '{"judgement": "undetermined", "files_to_read": ["nope.js"]}').when(k == 2, '{"judgement": "benign", "files_to_read": ["./package/index.js"]}').otherwise('{"judgement": "benign"}')
    out = loops.reread_reports(loops.with_files(p.withColumn("slice", F.lit("s")).withColumn("report", report), files, ["pkg"]), _rereader)
    return out.select("pkg", F.get_json_object("revised", "$.judgement").alias("judgement"), "hops")


def _reporter(text: str) -> str:
    """A judge for tests: of three reports one says malicious; the verifier goes by the number of those that came."""
    if "Report 2 of 3" in text and "odd" in text:
        return "nothing"
    if "Check the reports" in text:
        return json.dumps({"judgement": "undetermined", "reports": text.count("malicious\\\\\\\"") + text.count("benign\\\\\\\"")})
    return json.dumps({"judgement": "malicious" if "Report 1" in text else "benign"})


@query(f"""WITH {EV}, p AS (SELECT DISTINCT pkg FROM ev) SELECT pkg, 'undetermined' AS judgement FROM p""")
def q_verified_reports(spark, sf):
    p = events(spark, sf).select("pkg").distinct().withColumn("slice", F.when(F.col("pkg") % 2 == 0, _s("even {}", "pkg")).otherwise(_s("odd {}", "pkg")))
    return model.verified(p, ["pkg"], "slice", _reporter).select("pkg", F.get_json_object("report", "$.judgement").alias("judgement"))


# a package's whole run


def _slice_judge(text: str) -> str:
    return json.dumps({"judgement": "malicious" if "v7." in text else "undetermined" if "v3." in text else "benign", "reason": "r"})


@query(None)
def q_package_run(spark, sf):
    """From graphs to reports: flagged vertices, components in order, slices with annotations, a judge for each component, one verdict for each graph, and its
    report. Graphs stand for packages; tests/test_run.py holds it against a plain version."""
    a = V.arcs(spark, sf)
    flagged = a.where("src % 3 = 1").select("g", F.col("src").alias("v")).distinct()
    members = graph.slice_components(a, flagged, ["g"])
    reps = graph.representatives(members, members.select("g", "v", (F.col("v") % 37).alias("line")), flagged, ["g"])
    after = graph.component_order(reps, a, ["g"]).groupBy("g", "component").agg(F.array_sort(F.collect_set("successor")).alias("successors"))
    node = slicing.static_annotation(members.select("g", "component", "v", F.col("v").alias("node"), F.lit("CALL").alias("call_type"), (F.col("v") % 3 == 1).alias("sensitive"), F.lit("fs.readFile").alias("qualified_name"), F.concat(F.lit("v"), F.col("v") % 10, F.lit(".")).alias("call_name")))
    pieces = node.groupBy("g", "component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "annotation"))), lambda x: F.coalesce(x["annotation"], F.lit("-"))), "\n").alias("slice")).withColumn("file", F.lit("a.js")).withColumn("callees", F.array().cast("array<string>"))
    order = reps.select("g", "component", F.col("cfg_order").cast("long").alias("cfg_order")).join(after, ["g", "component"], "left").withColumn("predecessors", F.array().cast("array<bigint>"))
    c = slicing.component_structs(slicing.file_slices(pieces, ["g", "component"]), order, ["g"])
    judged = model.judged(c, "code_slice", _slice_judge, "report")
    judged = judged.withColumn("judgement", F.get_json_object("report", "$.judgement"))
    cross = a.select("g").distinct().withColumn("judgement", F.lit(None).cast("string"))
    outcome = verdict.entry_outcome(judged, cross, ["g"])
    return outcome.join(judged.groupBy("g").agg(F.count("*").alias("components")), "g", "left").select("g", "judgement", "rule", F.coalesce("components", F.lit(0)).alias("components"))


@query("""SELECT s_suppkey, s_suppkey % 7 AS downloads, CAST(s_nationkey AS BIGINT) AS dependents, CAST(s_suppkey AS VARCHAR) AS stars, CAST(s_nationkey AS VARCHAR) AS forks, '2' AS commits, CAST(s_suppkey % 90 AS VARCHAR) AS contributors FROM supplier""")
def q_repository_metadata(spark, sf):
    s = table(spark, sf, "supplier")
    obj = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    m = enrichment.repository_metadata(obj(stargazers_count=F.col("s_suppkey"), forks_count=F.col("s_nationkey")), F.lit(None).cast("string"), F.lit("[1, 2]"), F.concat(F.lit('<https://x?per_page=1&page='), F.col("s_suppkey") % 90, F.lit('>; rel="last"')), F.lit("[1]"))
    return s.select("s_suppkey", enrichment.weekly_downloads(obj(downloads=F.col("s_suppkey") % 7)).alias("downloads"), enrichment.dependents(obj(dependent_packages_count=F.col("s_nationkey"))).alias("dependents"), m["stars"].alias("stars"), m["forks"].alias("forks"), m["commits_number"].alias("commits"), m["contributors_number"].alias("contributors"))
