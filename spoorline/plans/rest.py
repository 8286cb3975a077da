"""Queries of what the other modules leave: catalogs as files, parameters, arcs of arguments and returns, places, and judges of several kinds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import catalog, enrichment, evidence, graph, localization, loops, model, programs, slicing, syntax
from ..sources import files as sources
from .code import _TREE, _files, _s, _tree
from .judgements import COMP, _components, _reports
from .oracle import ARCS, EV
from .registry import query
from .views import arcs, events, table


@query(f"""WITH {EV} SELECT event_id, CASE event_type WHEN 'click' THEN 'File Reading' WHEN 'signup' THEN 'a "b", c' WHEN 'view' THEN 'Property' END AS behavior FROM ev""")
def q_catalog_files(spark, sf):
    """Catalogs in CSV: rows of other widths don't count, the later of two holds; property events look in a catalog of their own."""
    one = spark.createDataFrame([(0, "\n".join(["module,property,fullName,domain,category", "fs,readFile,fs.readFile,File,Old", "https,request,https.request,Network", "fs,readFile,fs.readFile,File,File Reading", 'child_process,exec,child_process.exec,Process,"a ""b"", c"', "misc,noop,x,y,z,w", ""]))], "f int, t string")
    two = spark.createDataFrame([(0, "module,property,fullName,domain\nos,hostname,os.hostname,Environment,Property")], "f int, t string")
    calls, props = (catalog.read(spark, _files(d, "f", "t", "catalog")) for d in (one, two))
    e = events(spark, sf).withColumn("kind", F.when(F.col("event_type") == "view", "property").when(F.col("event_type") != "purchase", "function"))
    return catalog.sensitive(e, calls, props, "kind", "qn").select("event_id", "behavior")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT a.l_orderkey, a.k + 1 AS place, CASE WHEN a.k = 3 THEN (SELECT string_agg(l_partkey, ',' ORDER BY k) FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.k >= 3) ELSE CAST(a.l_partkey AS VARCHAR) END AS vals FROM l a WHERE a.k <= 3""")
def q_bound_parameters(spark, sf):
    """Lines as arguments; the third parameter takes the rest, `this` comes first and takes none, a fifth comes too late."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("value"))
    o = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    p = o.select("l_orderkey", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit("this" if k == 1 else f"p{k}").alias("name"), F.lit(k == 4).alias("rest")) for k in range(1, 6)])).alias("p")).where("p.pos <= n + 1").select("l_orderkey", "p.*")
    out = slicing.bound_parameters(li, p, ["l_orderkey"])
    return out.select("l_orderkey", F.col("pos").cast("long").alias("place"), F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query(f"""WITH {EV}, u AS (SELECT DISTINCT pkg, user_id FROM ev), p AS (SELECT pkg, min(user_id) AS u FROM u GROUP BY pkg)
SELECT pkg, w AS path, CASE w WHEN './src/a' THEN 'src/a.js' WHEN 'lib' THEN 'lib/index.cjs' WHEN 'src/../b.json' THEN 'b.json' END AS file FROM p, (VALUES ('./src/a'), ('lib'), ('src/../b.json'), ('../x'), ('gone')) v(w)""")
def q_resolved_files(spark, sf):
    """Requested paths as files of a package: with an extension added, an index file, back and forth, out of it, not there."""
    p = events(spark, sf).select("pkg").distinct()
    files = p.select("pkg", F.explode(F.array(*map(F.lit, ("src/a.js", "src/a.json", "lib/index.cjs", "b.json", "x")))).alias("path")).withColumn("text", F.lit("t"))
    wanted = p.select("pkg", F.explode(F.array(*map(F.lit, ("./src/a", "lib", "src/../b.json", "../x", "gone")))).alias("path"))
    return sources.resolved(wanted, files, ["pkg"]).select("pkg", "path", "file")


@query(f"""WITH {EV}, f AS (SELECT DISTINCT user_id FROM ev) SELECT 'src/f' || user_id || '.js' AS path, CASE WHEN user_id % 2 = 0 THEN 'EVAL_WRAP' ELSE 'X' || user_id END AS text FROM f""")
def q_preprocessed_files(spark, sf):
    """Scripts outside node_modules, rewritten by a tool, their evals of plain text made functions."""
    f = events(spark, sf).select("user_id").distinct()
    path = F.explode(F.array(_s("src/f{}.js", "user_id"), _s("node_modules/f{}.js", "user_id"), _s("f{}.txt", "user_id"))).alias("path")
    rows = f.select("user_id", path).withColumn("text", F.when(F.col("user_id") % 2 == 0, "eval('q')").otherwise(_s("x{}", "user_id")))
    out = sources.preprocessed(rows.select("path", "text"), _shouted)
    return out.select("path", F.when(F.startswith("text", F.lit("eval_wrap_1()")), "EVAL_WRAP").otherwise(F.col("text")).alias("text"))


def _shouted(text: str) -> str:
    if text.startswith("eval"):
        raise ValueError("left alone")
    return text.upper()


@query(f"""WITH {_TREE}, g AS (SELECT pkg, id, parent, line FROM c) SELECT pkg, id + 2 AS src, id AS dst, 'DDG: v' || line AS label FROM g UNION ALL SELECT pkg, 7000000 + line, id, 'DDG: v' || line FROM g WHERE line % 3 = 1 UNION ALL SELECT pkg, id + 3, id, 'DDG: v' || line FROM g WHERE line % 2 = 0 AND line % 4 <> 0
  UNION ALL SELECT pkg, -1, id, 'obj' || line FROM g WHERE line % 3 < 2""")
def q_argument_arcs(spark, sf):
    """Arcs that arguments add: from what is given and from where a name was set, unless a data arc is there; and what names hold."""
    n, e = _tree(spark, sf)
    given = syntax.arguments(n, e, ["pkg"])
    call = n.where("label = 'CALL'").select("pkg", F.col("id").alias("call"), "line")
    there = call.where("line % 4 = 0").select("pkg", (F.col("call") + 3).alias("src"), F.col("call").alias("dst"), F.lit("DDG: old").alias("label"))
    i = F.col("line")
    bound = call.select("pkg", (F.col("call") + 2).alias("id"), F.when(i % 3 < 2, i + 7000000).cast("long").alias("def"), F.when(i % 3 < 2, F.concat(F.lit("obj"), i)).alias("object"), F.when(i % 3 == 0, "global").otherwise("scope").alias("kind"))
    arcs_, objects = syntax.argument_arcs(given, n, e.unionByName(there), bound, ["pkg"])
    return arcs_.unionByName(objects.select("pkg", F.lit(-1).cast("long").alias("src"), "dst", F.col("object").alias("label")))


@query(f"""WITH {_TREE} SELECT pkg, 'param' AS what, id AS src, 5000000 + user_id AS dst FROM m WHERE NOT contains(name, '<lambda>') OR user_id % 2 = 0 UNION ALL SELECT c.pkg, 'return', c.parent + 100, c.id FROM c WHERE line % 4 = 0
  UNION ALL SELECT pkg, 'data', id, id + 2 FROM c WHERE line % 5 = 0""")
def q_program_arcs(spark, sf):
    """From methods to parameters, of lambdas only those that their source names; from returns to calls; and arcs that there are."""
    n, e = _tree(spark, sf)
    m = n.where("label = 'METHOD' AND id >= 1000000").select("pkg", F.col("id").alias("pdg"), "id", "label", "name", "code")
    p = m.select("pkg", "pdg", (F.col("id") + 4000000).alias("id"), F.lit("METHOD_PARAMETER_IN").alias("label"), F.lit("p").alias("name"), F.lit("p").alias("code"))
    formals = m.where("(id - 1000000) % 2 = 0").select("pkg", "pdg", F.lit("p").alias("name"))
    param = syntax.parameter_arcs(m.unionByName(p), formals, ["pkg"]).select("pkg", F.lit("param").alias("what"), "src", "dst")
    into = syntax.entered(e, ["pkg"]).select("pkg", F.col("id").alias("node"), F.col("method").alias("pdg"))
    back = programs.return_arcs(into, m.select("pkg", "pdg", (F.col("id") + 100).alias("id")), ["pkg"]).select("pkg", F.lit("return").alias("what"), "src", "dst")
    calls = n.where("label = 'CALL'").select("pkg", "id", "line")
    edges = calls.select("pkg", F.col("id").alias("src"), (F.col("id") + 2).alias("dst"), F.when(F.col("line") % 5 == 0, "DDG: x").otherwise("CFG").alias("label"))
    data = syntax.has_data_arc(edges.select("pkg", "src", "dst"), edges, ["pkg"]).select("pkg", F.lit("data").alias("what"), "src", "dst")
    return param.unionByName(back).unionByName(data)


@query(f"""WITH {ARCS}, e AS (SELECT g, src, dst, list_sort(list(DISTINCT label)) AS ls FROM arc GROUP BY ALL) SELECT g, src, dst, CASE WHEN list_contains(ls, 'DDG') THEN 'DDG' ELSE 'CFG' END AS flow, array_to_string(list_transform(ls, lambda x: CASE WHEN x = 'DDG' THEN 'REMOVE: v' ELSE x END), ',') AS labels FROM e""")
def q_flow_types(spark, sf):
    e = arcs(spark, sf).groupBy("g", "src", "dst").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    named = F.transform("ls", lambda x: F.when(x == "DDG", "DDG: v").otherwise(x))
    return e.select("g", "src", "dst", graph.flow_type(named).alias("flow"), F.array_join(syntax.without_named(named), ",").alias("labels"))


@query(f"""WITH {EV}, r AS (SELECT pkg, user_id AS node, idx FROM ev WHERE event_type = 'click'), o AS (SELECT DISTINCT pkg, user_id AS node FROM ev WHERE event_type = 'signup' AND line < 50) SELECT r.pkg, r.node, r.idx FROM r JOIN o ON o.pkg = r.pkg AND o.node = r.node""")
def q_collected_records(spark, sf):
    e = events(spark, sf)
    rec = e.where("event_type = 'click'").select("pkg", F.col("user_id").alias("node"), "idx")
    own = e.where("event_type = 'signup' AND line < 50").select("pkg", F.col("user_id").alias("node"))
    return evidence.collected(rec, own, ["pkg"])


# judges


def _behaving(text: str) -> str:
    if "overall_functionality" in text:
        return json.dumps({"overall_functionality": "unknown" if '"package_name":"m1"' in text else "does"})
    return json.dumps({"api_behavior": "declared" if "declare function get" in text else "unknown"})


@query(f"""WITH {EV}, u AS (SELECT DISTINCT 'm' || (user_id % 4) AS module, CASE WHEN line % 2 = 0 THEN 'get' ELSE 'put' END AS property FROM ev) SELECT module, property, CASE WHEN module <> 'm1' THEN 'does' END AS module_behavior, CASE WHEN property = 'get' AND module <> 'm2' THEN 'declared' END AS api_behavior, CASE WHEN module = 'm1' AND property = 'get' THEN 'api_only' WHEN module = 'm1' THEN 'not_enriched' WHEN module = 'm2' OR property = 'put' THEN 'module_only' ELSE 'fully_enriched' END AS level FROM u""")
def q_judged_behaviors(spark, sf):
    """What a judge says of modules and their calls, by readme and declaration files, and how far that enriches their uses."""
    u = events(spark, sf).select(F.concat(F.lit("m"), F.col("user_id") % 4).alias("module"), F.when(F.col("line") % 2 == 0, "get").otherwise("put").alias("property")).distinct()
    m = u.select("module").distinct()
    text = F.when(F.col("module") == "m2", "x").otherwise("/** Gets. */\ndeclare function get(): void;")
    m = m.select("module", F.lit(True).alias("trusted"), F.lit("d").alias("description"), F.array().cast("array<string>").alias("keywords"), F.lit("r").alias("readme"), F.array(F.struct(F.lit("t.d.ts").alias("path"), text.alias("text"))).alias("declarations"), F.array(F.lit("t.d.ts")).alias("types"))
    said = enrichment.judged_behaviors(u, m, _behaving)
    levels = enrichment.enriched(u.withColumn("node", F.lit(1)), enrichment.with_behaviors(m.select("module", "trusted"), said), [])
    return said.join(levels.select("module", "property", "level"), ["module", "property"])


def _locator(text: str) -> str:
    body = json.loads(text[text.index("\n\n{") + 2 :])
    if "files" in body:
        return json.dumps({"summary": "f", "locations": [{"file": f, "code": "x", "reason": body["reason"]} for f in [*sorted(body["files"]), "other.js"]]})
    return json.dumps({"summary": f"{len(body['components'])}", "locations": [{"file": "f0.js", "code": "bad()"}, {"file": "f9.js", "code": "bad()"}]})


@query(f"""WITH {COMP}, a AS (SELECT *, bool_or(coalesce(judgement = 'malicious', false)) OVER (PARTITION BY pkg) AS anybad FROM comp), rel AS (SELECT * FROM a WHERE judgement = 'malicious' OR NOT anybad)
SELECT pkg, count(*) || '' AS summary, 'f0.js' AS places FROM rel GROUP BY pkg HAVING bool_or(component % 4 = 0) UNION ALL SELECT pkg, 'f', 'a.js,b.js' FROM (SELECT DISTINCT pkg FROM ev) t WHERE pkg % 2 = 0 UNION ALL SELECT pkg, 'f', 'a.js' FROM (SELECT DISTINCT pkg FROM ev) t WHERE pkg % 2 = 1""")
def q_localized(spark, sf):
    """Malicious places by slices, and by the files that a judge read: those in files that it was shown."""
    c = _components(spark, sf)
    full = c.select("pkg", "component", "judgement", F.lit("e").alias("explanation"), F.lit("r").alias("reason"), F.array(F.lit("k")).alias("key_evidence"), F.lit("s").alias("sliced_code"))
    slices = c.select("pkg", "component", F.concat(F.lit("f"), F.col("component") % 4, F.lit(".js")).alias("file"), F.array(F.lit("x")).alias("code"))
    reports = c.select("pkg").distinct().select("pkg", F.lit("malicious").alias("judgement"), F.lit("x").alias("hidden"))
    a = localization.localized(full, reports, slices, ["pkg"], _locator)
    p = c.select("pkg").distinct()
    files = p.select("pkg", F.explode(F.array(*map(F.lit, ("a.js", "b.js", "c.js")))).alias("file")).withColumn("text", F.lit("t"))
    cited = p.where("pkg % 2 = 0").select("pkg", F.lit("b.js").alias("file"), F.lit("c").alias("claim"))
    b = localization.localized_in_files(p.select("pkg", F.lit("a.js").alias("file"), F.lit("r").alias("reason")), files, cited, ["pkg"], _locator)
    return a.unionByName(b).select("pkg", "summary", F.array_join(F.transform("locations", lambda x: x["file"]), ",").alias("places"))


def _second(text: str) -> str:
    if "Check the judgement" in text:
        return json.dumps({"judgement": "benign" if "n\\\\\\\": 4" in text or '4' in text[-40:] else "malicious", "explanation": "second"})
    return "x" if '"component":0' in text.replace(" ", "") else json.dumps({"judgement": "undetermined", "explanation": "first"})


@query(f"""WITH {COMP} SELECT pkg, component, CASE WHEN component > 0 THEN 'second' END AS explanation FROM comp""")
def q_dynamic_verdicts(spark, sf):
    c = _components(spark, sf).withColumn("payload", F.to_json(F.struct("component")))
    return model.dynamic_verdict(c, "payload", _second).select("pkg", "component", F.get_json_object("report", "$.explanation").alias("explanation"))


def _crossing(text: str) -> str:
    body = json.loads(text[text.index("\n\n{") + 2 :])
    return json.dumps({"judgement": f"{len(body['components'])}:{len(body.get('ordering') or [])}"})


@query(f"""WITH {COMP}, c AS (SELECT pkg, count(*) AS n, sum(component % 3) AS e FROM comp GROUP BY pkg) SELECT pkg, n || ':' || CAST(e AS BIGINT) AS judgement FROM c WHERE n > 1""")
def q_cross_judged(spark, sf):
    c = _components(spark, sf).withColumn("slice", F.lit("")).withColumn("report", F.lit("")).withColumn("successors", F.filter(F.transform(F.array(F.lit(1), F.lit(2)), lambda s: F.when(s <= F.col("component") % 3, F.col("component") + s)), lambda x: x.isNotNull()))
    return model.cross_judged(c, ["pkg"], _crossing).select("pkg", F.get_json_object("report", "$.judgement").alias("judgement"))


def _launcher(text: str) -> str:
    if "node" not in text.split("Command: ")[1]:
        return json.dumps({"launches_node": False, "js_files": ["x.js"]})
    return json.dumps({"js_files": []}) if "broken" in text else json.dumps({"launches_node": True, "js_files": ["a.js", 3]})


@query(f"""WITH {EV} SELECT event_id, line % 3 = 0 AS launches_node, CASE WHEN line % 3 = 0 THEN 'a.js' ELSE '' END AS files FROM ev WHERE event_type = 'signup'""")
def q_node_launches(spark, sf):
    e = events(spark, sf).where("event_type = 'signup'")
    k = F.col("line") % 3
    c = e.select("event_id", F.lit("child_process.exec").alias("name"), F.when(k == 0, "node a.js").when(k == 1, "ls").otherwise("node broken").alias("command"))
    return model.node_launches(c, "name", "command", _launcher).select("event_id", "launches_node", F.array_join("js_files", ",").alias("files"))


@query(f"""WITH {COMP} SELECT pkg, component AS seq, 'static' AS stage, 'e' AS entry, CASE WHEN component % 6 = 5 THEN 'warning' ELSE coalesce(judgement, 'benign') END AS result, CASE WHEN component % 5 = 0 THEN ' ; ' ELSE 'r' || component || '; ' END || 'x' || component AS finding FROM comp""")
def q_recorded_steps(spark, sf):
    r = _reports(spark, sf).withColumn("entry", F.lit("e"))
    return loops.recorded_step(r, ["pkg"], "component", "static", "entry", "judgement", ["reason", "explanation"])
