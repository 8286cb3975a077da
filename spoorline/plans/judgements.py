"""Queries of judgements, localisation, enrichment and evidence, with packages, entries and components made from the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import enrichment, evidence, localization, model, verdict
from . import views as V
from .oracle import EV, JUDGED
from .registry import query
from .views import events, table

#: Components of an entry: users of a package. What each is judged, by its number.
COMP = f"""{EV}, comp AS (SELECT pkg, user_id AS component, min(line) AS cfg_order, min(idx) AS first, count(*) AS n,
  CASE WHEN user_id % 7 = 3 THEN 'malicious' WHEN user_id % 3 = 0 THEN 'undetermined' WHEN user_id % 3 = 1 THEN 'benign' END AS judgement FROM ev GROUP BY ALL)"""


def _components(spark, sf):
    e = events(spark, sf)
    u = F.col("component")
    c = e.groupBy("pkg", F.col("user_id").alias("component")).agg(F.min("line").alias("cfg_order"), F.min("idx").alias("first"), F.count("*").alias("n"))
    return c.withColumn("judgement", F.when(u % 7 == 3, "malicious").when(u % 3 == 0, "undetermined").when(u % 3 == 1, "benign"))


def _s(text: str, *cols):
    parts = text.split("{}")
    return F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(p)] + ([F.col(cols[k]).cast("string")] if k < len(cols) else []))])


@query(f"""WITH {EV}, s AS (SELECT pkg, line, CASE WHEN user_id % 5 = 0 AND event_type = 'signup' THEN 'malicious' WHEN event_type = 'error' THEN 'warning' ELSE 'benign' END AS label, idx, user_id FROM ev WHERE idx < 5)
SELECT pkg, 'install_script_analysis' AS stage, CASE max(CASE label WHEN 'malicious' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'malicious' WHEN 1 THEN 'warning' ELSE 'benign' END AS result,
  string_agg('• s' || idx || ': "node f' || user_id || '" → ' || label || CASE WHEN line % 2 = 0 THEN ' (line ' || line || ')' ELSE '' END || CASE WHEN line % 3 = 0 THEN chr(10) || '  ↳ Launches JS: f' || user_id || ', g' ELSE chr(10) || '  ↳ No JS entry files identified' END, chr(10) ORDER BY idx) AS finding FROM s GROUP BY pkg""")
def q_install_step(spark, sf):
    e = events(spark, sf).where("idx < 5")
    label = F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "signup"), "malicious").when(F.col("event_type") == "error", "warning").otherwise("benign")
    none = F.array().cast("array<string>")
    s = e.select("pkg", F.col("idx").alias("pos"), _s("s{}", "idx").alias("name"), _s("node f{}", "user_id").alias("content"), label.alias("label"), F.when(F.col("line") % 2 == 0, _s("line {}", "line")).otherwise("").alias("explanation"), F.when(F.col("line") % 3 == 0, F.array(_s("f{}", "user_id"), F.lit("g"))).otherwise(none).alias("executed"))
    return verdict.install_step(s, ["pkg"])


@query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN turn % 3 <> 0 THEN 'e' || (turn % 2) || '.js' END AS entry, turn % 3 AS m, md5(text) AS f FROM conversations WHERE turn % 3 = 0 OR turn % 2 = 1)
SELECT conv_id, '=== Prior Analysis Context ===' || chr(10) || 'Package: c' || conv_id || chr(10) || chr(10) ||
  string_agg('[' || k || '] ' || CASE m WHEN 0 THEN 'Install-Phase Shell Command Analysis' WHEN 1 THEN 'Static Analysis' ELSE 'other' END || CASE WHEN entry IS NULL THEN '' ELSE ' (' || entry || ')' END || ' → ' || CASE WHEN m = 1 THEN 'Benign' ELSE 'Malicious' END || chr(10) || '    ' || f || chr(10) || '    x' || chr(10)
    || CASE WHEN m = 2 THEN '    → Next step reason: r' || turn || chr(10) ELSE '' END || chr(10), '' ORDER BY k) || '==============================' AS history FROM s GROUP BY conv_id""")
def q_history(spark, sf):
    c = table(spark, sf, "conversations")
    m = F.col("turn") % 3
    steps = c.select("conv_id", F.col("turn").alias("seq"), F.when(m == 0, "install_script_analysis").when(m == 1, "static").otherwise("other").alias("stage"), F.when(m != 0, F.concat(F.lit("e"), F.col("turn") % 2, F.lit(".js"))).alias("entry"), F.when(m == 1, "benign").otherwise("MALICIOUS").alias("result"), F.concat(F.md5("text"), F.lit("\nx")).alias("finding"), F.when(m == 2, _s("r{}", "turn")).otherwise("").alias("next_reason"), _s("c{}", "conv_id").alias("package"))
    return verdict.history(steps, ["conv_id"], "package", F.lit("e1.js"))


_REPORT = "struct<" + ",".join(f"{n}:{t}" for n, t in (c.strip().split(" ", 1) for c in "judgement string; reason string; explanation string; key_evidence array<struct<node_id:string,node_type:string,claim:string,file:string>>; cross_component_evidence array<struct<pattern:string>>; node_to_be_checked array<string>; files_to_read array<string>".split(";"))) + ">"


def _reports(spark, sf, shift: int = 0):
    """A report for each component, from its number, as a judge would write it."""
    c = _components(spark, sf)
    u = F.col("component") + shift
    claim = F.when(u % 4 == 0, "").otherwise(F.concat(F.lit("c"), u.cast("string")))
    item = lambda id_, kind, cl: F.struct(id_.cast("string").alias("node_id"), kind.alias("node_type"), cl.alias("claim"), F.concat(F.lit("f"), (u % 5).cast("string"), F.lit(".js")).alias("file"))
    evidence_ = F.array(item(u, F.lit("third_party"), claim), item(u + 1, F.lit(None).cast("string"), F.lit("z")))
    cols = {
        "judgement": F.when(u % 6 == 5, "maybe").otherwise(F.coalesce("judgement", F.lit("benign"))),
        "reason": F.when(u % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("r"), u.cast("string"))),
        "explanation": F.concat(F.lit("x"), u.cast("string")),
        "key_evidence": F.when(u % 8 != 1, evidence_),
        "cross_component_evidence": F.array(F.struct(F.when(u % 2 == 0, F.concat(F.lit("p"), u.cast("string"))).alias("pattern"))),
        "node_to_be_checked": F.when(u % 3 == 0, F.array(F.lit("x"), F.concat(u.cast("string"), F.lit(".0")), (u + 1).cast("string"))).otherwise(F.array().cast("array<string>")),
        "files_to_read": F.array(_s("package/f{}.js", "component"), F.lit("")),
    }
    return c.select("pkg", "component", *[v.alias(k) for k, v in cols.items()])


@query(f"""WITH {COMP} SELECT pkg, component, CASE WHEN component % 5 = 0 THEN 'reason:  ' ELSE 'reason: r' || component END || CASE WHEN component % 8 = 1 THEN '' WHEN component % 4 = 0 THEN ' | evidence: z' ELSE ' | evidence: c' || component || '; z' END
  || CASE WHEN component % 2 = 0 THEN ' | cross-component patterns: p' || component ELSE '' END || ' | flagged nodes: ' || CASE WHEN component % 2 = 1 THEN 'conditional=[' || component || '], ' ELSE '' END || 'unresolved=[1, 2]' AS finding FROM comp""")
def q_finding(spark, sf):
    r = _reports(spark, sf)
    none = F.array().cast("array<bigint>")
    f = verdict.finding(F.col("reason"), F.col("explanation"), F.col("key_evidence"), F.col("cross_component_evidence"), F.when(F.col("component") % 2 == 1, F.array("component")).otherwise(none), none, F.array(F.lit(1), F.lit(2)))
    return r.select("pkg", "component", f.alias("finding"))


@query(f"""WITH {COMP} SELECT pkg, 'r' AS reason, string_agg(component || ':' || CASE WHEN component % 6 = 5 THEN 'maybe' ELSE coalesce(judgement, 'benign') END || ':x' || component, '|' ORDER BY component) AS verdicts, 'k' AS claims FROM comp GROUP BY pkg""")
def q_prior_summary(spark, sf):
    r = _reports(spark, sf)
    entries = r.select("pkg").distinct().select("pkg", F.lit("").alias("reason"), F.lit("r").alias("explanation"), F.array(F.struct(F.lit("k").alias("claim")), F.struct(F.lit("").alias("claim"))).alias("key_evidence"), F.array(F.struct(F.lit(None).cast("string").alias("pattern"))).alias("cross_component_evidence"))
    out = verdict.prior_summary(entries, r, ["pkg"])
    shown = F.transform("verdicts", lambda v: F.concat_ws(":", v["component"], v["judgement"], v["explanation"]))
    return out.select("pkg", "reason", F.array_join(shown, "|").alias("verdicts"), F.array_join(F.concat("key_evidence", "patterns"), "|").alias("claims"))


_NODES = f"""{EV}, node AS (SELECT pkg, idx AS node, CASE event_type WHEN 'purchase' THEN 'third_party' WHEN 'signup' THEN 'conditional' WHEN 'error' THEN 'unresolved' ELSE 'local' END AS bucket, user_id FROM ev)"""


def _nodes(spark, sf):
    k = F.col("event_type")
    bucket = F.when(k == "purchase", "third_party").when(k == "signup", "conditional").when(k == "error", "unresolved").otherwise("local")
    return events(spark, sf).select("pkg", F.col("idx").alias("node"), bucket.alias("bucket"), "user_id")


@query(f"""WITH {_NODES}, want AS (SELECT pkg, user_id, idx FROM ev WHERE line % 2 = 0 UNION ALL SELECT pkg, user_id, idx FROM ev WHERE line % 10 = 0),
  cross_ids AS (SELECT pkg, idx FROM ev WHERE pkg % 3 = 0 AND line = 7), pick AS (SELECT pkg, 0 AS c, idx AS p, idx FROM cross_ids UNION ALL SELECT pkg, user_id, idx, idx FROM want WHERE pkg NOT IN (SELECT pkg FROM cross_ids))
SELECT pick.pkg, coalesce(string_agg(CASE WHEN bucket = 'conditional' THEN node END, ',' ORDER BY c, p), '') AS conditional, coalesce(string_agg(CASE WHEN bucket = 'third_party' THEN node END, ',' ORDER BY c, p), '') AS third_party, coalesce(string_agg(CASE WHEN bucket = 'unresolved' THEN node END, ',' ORDER BY c, p), '') AS unresolved
FROM pick JOIN node ON node.pkg = pick.pkg AND node.node = pick.idx GROUP BY pick.pkg""")
def q_flagged_ids(spark, sf):
    """Nodes to check: those of a judgement across components where there is one, else of the components, by what their call is."""
    e = events(spark, sf)
    own = e.where("line % 2 = 0").unionByName(e.where("line % 10 = 0")).groupBy("pkg", F.col("user_id").alias("component")).agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    cross = e.select("pkg").distinct().join(e.where("pkg % 3 = 0 AND line = 7").groupBy("pkg").agg(F.array_sort(F.collect_list("idx")).alias("ids")), "pkg", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    flagged = verdict.ids_to_check(own, cross, ["pkg"])
    out = verdict.classified_ids(flagged, _nodes(spark, sf), ["pkg"])
    return out.select("pkg", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("conditional", "third_party", "unresolved")])


@query(f"""WITH {_NODES}, r AS (SELECT pkg, bucket, row_number() OVER (PARTITION BY pkg ORDER BY CASE bucket WHEN 'third_party' THEN 1 WHEN 'conditional' THEN 2 ELSE 3 END, node) AS k FROM node WHERE bucket <> 'local')
SELECT pkg, bucket, count(*) AS dropped FROM r WHERE k > 10 GROUP BY ALL""")
def q_router_dropped(spark, sf):
    return verdict.dropped_by_bucket(_nodes(spark, sf).where("bucket <> 'local'"), ["pkg"], "bucket", "node")


@query(f"""WITH {COMP} SELECT c.pkg, c.component, e.idx AS node, 'f' || (c.component % 4) || '.js' AS file, 'a [Node ID: ' || e.idx || ']' AS infos FROM comp c JOIN ev e ON e.pkg = c.pkg AND e.user_id = c.component WHERE e.event_type = 'purchase'""")
def q_node_source(spark, sf):
    e = events(spark, sf)
    slices = e.groupBy("pkg", F.col("user_id").alias("component")).agg(F.array_sort(F.collect_list(_s("a [Node ID: {}]", "idx"))).alias("infos")).withColumn("file", F.concat(F.lit("f"), F.col("component") % 4, F.lit(".js")))
    wanted = e.where("event_type = 'purchase'").select("pkg", F.col("user_id").alias("component"), F.col("idx").alias("node"))
    return verdict.node_source(slices, wanted, ["pkg"]).select("pkg", "component", "node", "file", F.array_join("infos", "|").alias("infos"))


@query(f"""WITH {COMP}, p AS (SELECT pkg, string_agg(component || '@' || cfg_order, '|' ORDER BY cfg_order, component) AS payload FROM comp GROUP BY pkg)
SELECT c.pkg, c.component AS "from", c.component + u.s AS "to", p.payload FROM comp c, unnest(range(1, 1 + c.component % 3)) u(s), p WHERE p.pkg = c.pkg""")
def q_synthesis_input(spark, sf):
    c = _components(spark, sf).withColumn("slice", F.lit("")).withColumn("report", F.lit("")).withColumn("successors", F.filter(F.transform(F.array(F.lit(1), F.lit(2)), lambda s: F.when(s <= F.col("component") % 3, F.col("component") + s)), lambda x: x.isNotNull()))
    payload, edges = verdict.synthesis_input(c, ["pkg"])
    return edges.join(payload.select("pkg", F.array_join(F.transform("payload", lambda x: F.concat(x["component"], F.lit("@"), x["cfg_order"])), "|").alias("payload")), "pkg")


@query(f"""WITH {COMP}, c AS (SELECT pkg, count(*) AS n, max(coalesce(judgement, 'benign')) AS own, CASE WHEN bool_or(judgement = 'malicious') THEN 'malicious' WHEN bool_and(coalesce(judgement, 'benign') = 'benign') THEN 'benign' WHEN bool_or(judgement = 'undetermined') THEN 'undetermined' ELSE 'benign' END AS ruled
    FROM comp WHERE component % 5 < 2 + pkg % 3 - 1 GROUP BY pkg), p AS (SELECT DISTINCT pkg, CASE WHEN pkg % 4 = 0 THEN 'undetermined' WHEN pkg % 4 = 1 THEN 'odd' END AS x FROM ev)
SELECT p.pkg, CASE WHEN n IS NULL THEN 'benign' WHEN n = 1 THEN own WHEN x = 'odd' THEN 'benign' WHEN x IS NOT NULL THEN x ELSE ruled END AS judgement, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' WHEN x IS NOT NULL THEN 'cross' ELSE 'rule' END AS rule FROM p LEFT JOIN c ON c.pkg = p.pkg""")
def q_entry_outcome(spark, sf):
    c = _components(spark, sf)
    p = F.col("pkg")
    cross = c.select("pkg").distinct().withColumn("judgement", F.when(p % 4 == 0, "undetermined").when(p % 4 == 1, "odd"))
    return verdict.entry_outcome(c.where("component % 5 < 2 + pkg % 3 - 1"), cross, ["pkg"])


@query(f"""WITH {COMP}, b AS (SELECT *, component + 1 AS v FROM comp), r AS (SELECT *, v % 4 <> 0 AS has, CASE WHEN v % 6 = 5 THEN NULL ELSE coalesce(judgement, 'benign') END AS rj, CASE WHEN component % 6 = 5 THEN 'maybe' ELSE coalesce(judgement, 'benign') END AS pj FROM b)
SELECT pkg, component, CASE WHEN has THEN coalesce(rj, pj) ELSE pj END AS judgement, CASE WHEN has AND v % 5 <> 0 THEN 'r' || v WHEN component % 5 = 0 THEN ' ' ELSE 'r' || component END AS reason,
  CASE WHEN has THEN CASE WHEN coalesce(rj, pj) = 'undetermined' AND v % 3 = 0 THEN 3 ELSE 0 END WHEN component % 3 = 0 THEN 3 ELSE 0 END AS checks, CASE WHEN has AND component % 2 = 0 THEN 'f' || component || '.js' END AS files FROM r""")
def q_reread_overlay(spark, sf):
    fresh = _reports(spark, sf, 1).where("(component + 1) % 4 <> 0")
    out = verdict.overlaid(_reports(spark, sf), fresh, ["pkg", "component"], F.col("component") % 2 == 1)
    return out.select("pkg", "component", "judgement", "reason", F.size("node_to_be_checked").alias("checks"), F.array_join("files_to_read", ",").alias("files"))


@query(f"""WITH {COMP}, s AS (SELECT *, CASE WHEN component % 3 = 0 OR component % 8 <> 1 THEN component END AS id FROM comp) SELECT pkg, component, 'malicious' AS judgement, id, CASE WHEN id IS NULL THEN NULL WHEN component % 8 <> 1 THEN 'third_party' ELSE 'unresolved' END AS type FROM s""")
def q_binary_verdict(spark, sf):
    r = verdict.binary_verdict(_reports(spark, sf).withColumn("path", F.lit("bin/x.node")), "path")
    first = F.get("key_evidence", F.lit(0))
    return r.select("pkg", "component", "judgement", first["node_id"].cast("long").alias("id"), first["node_type"].alias("type"))


@query(f"""WITH {COMP}, hit AS (SELECT DISTINCT pkg, user_id AS component FROM ev WHERE event_type = 'purchase' AND line < 30) SELECT c.pkg, c.component, CASE WHEN h.pkg IS NOT NULL THEN 'new' ELSE 'old' END || c.component AS report
FROM comp c LEFT JOIN hit h ON h.pkg = c.pkg AND h.component = c.component WHERE (h.pkg IS NOT NULL AND c.component % 4 <> 0) OR (h.pkg IS NULL AND c.component % 3 <> 0)""")
def q_recomputed(spark, sf):
    """Components whose slice names a flagged node are judged anew, the others keep their first report."""
    e = events(spark, sf)
    index = e.select("pkg", F.col("idx").alias("node"), F.col("user_id").alias("component"))
    hit = verdict.affected(index, e.where("event_type = 'purchase' AND line < 30").select("pkg", F.col("idx").alias("node")), ["pkg"])
    c = _components(spark, sf).select("pkg", "component")
    return verdict.recomputed(c, hit, c.where("component % 4 <> 0").withColumn("report", _s("new{}", "component")), c.where("component % 3 <> 0").withColumn("report", _s("old{}", "component")), ["pkg"])


@query(f"""WITH {COMP}, n AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY 'e' || component) AS k FROM comp), f AS (SELECT * FROM n WHERE k <= 3), m AS (SELECT pkg, min(CASE WHEN judgement = 'malicious' THEN k END) AS m FROM f GROUP BY pkg)
SELECT f.pkg, CASE WHEN any_value(m.m) IS NULL THEN 'benign' ELSE 'malicious' END AS judgement, count(*) AS tried, max_by('e' || component, k) AS last FROM f JOIN m ON m.pkg = f.pkg WHERE m.m IS NULL OR f.k <= m.m GROUP BY f.pkg""")
def q_fallback_rollup(spark, sf):
    return verdict.fallback_rollup(_components(spark, sf).select("pkg", _s("e{}", "component").alias("entry"), "judgement"), ["pkg"], 3)


@query(f"""WITH {COMP}, steps AS (SELECT pkg, user_id % 3 AS e, idx, event_type FROM ev WHERE user_id % 3 > 0), last AS (SELECT pkg, e, max_by(event_type, idx) AS r FROM steps GROUP BY ALL),
  l AS (SELECT pkg, string_agg('e' || e || '=' || r, ',' ORDER BY e) AS verdicts FROM last GROUP BY pkg), s AS (SELECT pkg, count(*) AS scripts, bool_or(event_type = 'signup') AS bad FROM ev WHERE idx < 3 GROUP BY pkg)
SELECT CAST(p.pkg AS VARCHAR) AS package_name, s.bad AS malicious_manifest, s.scripts, coalesce(l.verdicts, '') AS verdicts FROM (SELECT DISTINCT pkg FROM ev) p JOIN s ON s.pkg = p.pkg LEFT JOIN l ON l.pkg = p.pkg""")
def q_package_report(spark, sf):
    e = events(spark, sf).withColumn("pkg", F.col("pkg").cast("string"))
    p = e.select("pkg").distinct().withColumn("statuses", F.array(F.lit("0")))
    scripts = e.where("idx < 3").select("pkg", F.col("idx").alias("pos"), F.lit("s").alias("name"), F.lit("c").alias("content"), F.when(F.col("event_type") == "signup", "malicious").otherwise("benign").alias("label"), F.lit("").alias("explanation"))
    steps = e.select("pkg", F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("e"), F.col("user_id") % 3)).alias("entry"), F.col("idx").alias("seq"), F.lit("static").alias("stage"), F.col("event_type").alias("result"), F.lit("f").alias("finding"))
    r = verdict.package_report(p, scripts, steps, "pkg")
    shown = F.array_join(F.transform("entry_final_verdicts", lambda v: F.concat(v["entry"], F.lit("="), v["result"])), ",")
    return r.select("package_name", F.col("maliciousness_in_package_json").alias("malicious_manifest"), F.size("install_time_script").cast("long").alias("scripts"), F.coalesce(shown, F.lit("")).alias("verdicts"))


@query(f"""WITH {JUDGED} SELECT lang, source, bool_or(coalesce(judgement = 'malicious', false)) AS malicious, max(CASE judgement WHEN 'malicious' THEN 'malicious' WHEN 'benign' THEN 'benign' ELSE 'warning' END) AS worst FROM j GROUP BY ALL""")
def q_statuses(spark, sf):
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    j = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "undetermined").when(F.col("quality") == 1, "benign")
    status = F.when(j == "malicious", "Malicious Code").when(j == "benign", "Benign")
    out = d.groupBy("lang", "source").agg(verdict.any_malicious(status).alias("malicious"), F.max(F.when(verdict.is_terminal(status), F.when(status == "Benign", "benign").otherwise("malicious")).otherwise(verdict.result_of(F.lit("x")))).alias("worst"))
    return out


# where the malicious code is


@query(f"""WITH {COMP}, a AS (SELECT *, bool_or(coalesce(judgement = 'malicious', false)) OVER (PARTITION BY pkg) AS anybad FROM comp), rel AS (SELECT * FROM a WHERE judgement = 'malicious' OR NOT anybad),
  t AS (SELECT pkg, 'f' || (component % 4) || '.js' AS file, string_agg('l' || component || chr(10) || 'm', chr(10) ORDER BY component) AS text FROM rel GROUP BY ALL) SELECT pkg, file, md5(text) AS digest FROM t""")
def q_slice_texts(spark, sf):
    c = localization.relevant_components(_components(spark, sf), ["pkg"])
    s = c.select("pkg", "component", F.concat(F.lit("f"), F.col("component") % 4, F.lit(".js")).alias("file"), F.array(_s("l{}", "component"), F.lit("m")).alias("code"))
    return localization.slice_texts(s, ["pkg"]).select("pkg", "file", F.md5("text").alias("digest"))


@query(f"""WITH {COMP}, l AS (SELECT pkg, idx, 'f' || (line % 6) || '.js' AS file, CASE line % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'c' || line END AS code, CASE WHEN line % 2 = 0 THEN 'r' || line END AS reason FROM ev WHERE event_type = 'signup')
SELECT pkg, 's' || pkg AS summary, string_agg(file || ':' || code || ':' || coalesce(reason, ''), '|' ORDER BY idx) AS locations FROM l WHERE trim(code) <> '' AND EXISTS (SELECT 1 FROM comp WHERE comp.pkg = l.pkg AND 'f' || (component % 4) || '.js' = l.file) GROUP BY pkg""")
def q_locations(spark, sf):
    """A judge's places: those in files that it was shown, with code."""
    e = events(spark, sf).where("event_type = 'signup'")
    code = F.when(F.col("line") % 7 == 1, "  ").when(F.col("line") % 7 != 0, _s("c{}", "line"))
    loc = F.struct(F.concat(F.lit("f"), F.col("line") % 6, F.lit(".js")).alias("file"), code.alias("code"), F.when(F.col("line") % 2 == 0, _s("r{}", "line")).alias("reason"))
    answers = e.groupBy("pkg").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", loc.alias("l")))), lambda x: x["l"]).alias("locations")).withColumn("summary", _s("s{}", "pkg"))
    allowed = _components(spark, sf).select("pkg", F.concat(F.lit("f"), F.col("component") % 4, F.lit(".js")).alias("file"))
    out = localization.validated(answers, allowed, ["pkg"])
    return out.select("pkg", "summary", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["file"], x["code"], x["reason"])), "|").alias("locations"))


@query(f"""WITH {COMP}, k AS (SELECT DISTINCT pkg, 'f' || (component % 5) || '.js' AS file FROM comp WHERE component % 2 = 0 UNION SELECT DISTINCT pkg, 'f0.js' FROM ev) SELECT k.pkg, k.file FROM k WHERE k.file <> 'f3.js'""")
def q_relevant_files(spark, sf):
    c = _components(spark, sf)
    p = c.select("pkg").distinct()
    files = p.select("pkg", F.explode(F.array(*map(F.lit, ("f0.js", "f1.js", "f2.js", "f4.js", "g.js")))).alias("file")).withColumn("text", F.lit(""))
    cited = c.select("pkg", F.when(F.col("component") % 2 == 0, F.concat(F.lit("f"), F.col("component") % 5, F.lit(".js"))).alias("file"))
    return localization.relevant_files(files, p.withColumn("file", F.lit("f0.js")), cited, ["pkg"]).select("pkg", "file")


@query(f"""WITH {COMP} SELECT pkg, component, CAST(CASE WHEN component % 8 = 1 THEN 0 ELSE 2 END AS BIGINT) AS kept, 'x' || component AS explanation FROM comp""")
def q_component_view(spark, sf):
    r = _reports(spark, sf).withColumn("sliced_code", F.lit("")).withColumn("reason", F.lit(""))
    v = localization.component_view(r, ["pkg"])
    return v.select("pkg", "component", F.size(localization.clean_evidence(F.col("key_evidence"))).cast("long").alias("kept"), "explanation")


# third-party modules

_USES = f"""{EV}, use AS (SELECT pkg, idx AS node, CASE WHEN line % 9 = 0 THEN '' ELSE 'm' || (user_id % 7) END AS module, CASE WHEN line % 2 = 0 THEN 'get' ELSE 'put' END AS property FROM ev WHERE event_type = 'purchase')"""


def _uses(spark, sf):
    e = events(spark, sf).where("event_type = 'purchase'")
    return e.select("pkg", F.col("idx").alias("node"), F.when(F.col("line") % 9 == 0, "").otherwise(F.concat(F.lit("m"), F.col("user_id") % 7)).alias("module"), F.when(F.col("line") % 2 == 0, "get").otherwise("put").alias("property"))


def _modules(spark):
    rows = [("m0", True, "cache", {"get": "reads", "put": "unknown"}), ("m1", True, None, {"get": "reads"}), ("m2", True, "unknown", {}), ("m3", False, "x", {"get": "y"}), ("m4", None, "x", None), ("m5", True, "net", None)]
    return spark.createDataFrame(rows, "module string, trusted boolean, module_behavior string, api_behavior map<string,string>")


@query(f"""WITH {_USES}, l AS (SELECT *, CASE WHEN module = 'm0' AND property = 'get' THEN 'fully_enriched' WHEN module IN ('m0', 'm5') THEN 'module_only' WHEN module = 'm1' AND property = 'get' THEN 'api_only' ELSE 'not_enriched' END AS level FROM use),
  s AS (SELECT pkg, level, string_agg(node, ', ' ORDER BY node) AS ids FROM l GROUP BY ALL), m AS (SELECT pkg, string_agg(module, ', ' ORDER BY module) AS ms FROM (SELECT DISTINCT pkg, module FROM l) GROUP BY pkg)
SELECT m.pkg, 'modules: ' || ms || string_agg(' | ' || level || ': nodes [' || ids || ']', '' ORDER BY CASE level WHEN 'fully_enriched' THEN 0 WHEN 'module_only' THEN 1 WHEN 'api_only' THEN 2 ELSE 3 END) AS summary FROM m JOIN s ON s.pkg = m.pkg GROUP BY m.pkg, ms""")
def q_enrichment_summary(spark, sf):
    return enrichment.summary(enrichment.enriched(_uses(spark, sf), _modules(spark), ["pkg"]), ["pkg"])


def _registry(name: str) -> str | None:
    """A registry for tests: it knows m0 to m3, fails on m5, and has nothing else."""
    if name == "m5":
        raise ConnectionError(name)
    return json.dumps({"version": f"1.{name[1:]}", "repository": {"url": f"git+https://github.com/o/{name}.git"}, "versions": ["1", "2"], "types": "./t.d.ts", "exports": {".": {"types": "./u.d.ts"}}}) if name in ("m0", "m1", "m2", "m3") else None


@query(f"""WITH {_USES}, m AS (SELECT DISTINCT module FROM use WHERE module <> '') SELECT module, CASE WHEN module < 'm4' THEN CASE WHEN module = 'm0' THEN NULL ELSE '1.' || module[2:] END END AS version, CASE WHEN module IN ('m1', 'm2', 'm3') THEN 'https://github.com/o/' || module END AS repository,
  CASE WHEN module IN ('m1', 'm2', 'm3') THEN 't.d.ts|u.d.ts' END AS types FROM m UNION SELECT 'm9', '9', NULL, '' """)
def q_fetched_metadata(spark, sf):
    """Modules in use, each fetched once; the cache knows that there is nothing of m0, and a module that nobody uses."""
    cache = spark.createDataFrame([("m0", None), ("m9", '{"version": "9"}')], "module string, data string")
    got = enrichment.fetched(enrichment.needed_modules(_uses(spark, sf), ["pkg"]), cache, _registry)
    m = enrichment.registry_metadata(F.col("data"))
    return got.select("module", m["version"].alias("version"), m["repository"].alias("repository"), F.array_join(m["types"], "|").alias("types"))


@query(f"""WITH {_USES} SELECT pkg, node, module, CASE WHEN module = 'm1' THEN 'b1' END AS behavior, module IN ('m1', 'm2') AS hit FROM use""")
def q_derived_lookup(spark, sf):
    derived = spark.createDataFrame([("m1", "behavior", "b1"), ("m2", "behavior", None), ("m3", "trust", "x")], "module string, field string, value string")
    return enrichment.derived_lookup(_uses(spark, sf).drop("property"), derived, "module", "behavior")


def _trusting(text: str) -> str:
    return json.dumps({"trust_level": "HIGH_TRUST" if '"readme":"many' in text else "LOW_TRUST"})


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k, s_acctbal FROM supplier) SELECT s_suppkey, CASE WHEN k = 0 THEN 'trusted' WHEN k = 1 THEN 'untrusted' ELSE 'ask' END AS rule, k = 0 OR k = 2 AS trusted FROM s""")
def q_judged_trust(spark, sf):
    k = F.col("s_suppkey") % 4
    release = F.create_map(F.lit("1.0.0"), F.when(k == 0, "2024-05-01T00:00:00Z").otherwise("2020-05-01T00:00:00Z"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(20000).alias("downloads"), F.lit("https://x/y").alias("repository"), F.array(*map(F.lit, "123")).alias("versions"), F.when(k == 1, "").when(k == 2, F.concat(F.lit("many "), F.col("s_nationkey"))).when(k == 3, "few").otherwise("r").alias("readme"), release.alias("changelog"), F.lit(None).cast("long").alias("dependents"), F.lit("d").alias("description"))
    return enrichment.judged_metadata(s, _trusting, F.to_timestamp(F.lit("2024-08-01"))).select("s_suppkey", "rule", "trusted")


# what runtime events show

_SEQ = f"""{EV}, act AS (SELECT pkg, user_id, idx, event_type, line, CASE event_type WHEN 'click' THEN 'fs.readFile' WHEN 'signup' THEN 'child_process.exec' WHEN 'purchase' THEN 'https.request' ELSE 'os.hostname' END AS name,
  CASE event_type WHEN 'click' THEN 'File' WHEN 'signup' THEN 'Process' WHEN 'purchase' THEN 'Network' ELSE 'Environment' END AS domain,
  CASE event_type WHEN 'click' THEN 'File Reading' WHEN 'signup' THEN 'Command Execution' WHEN 'purchase' THEN 'Environment' ELSE 'Environment' END AS x FROM ev WHERE event_type <> 'error'),
  shown AS (SELECT *, CASE event_type WHEN 'click' THEN '{{"file_path":"/d' || line || '","read_content":' || CASE WHEN line % 10 = 0 THEN '{{"content_type":"plain_text","size":6000}}' ELSE '{{"inline":"r' || line || '"}}' END || '}}' WHEN 'signup' THEN 'ls ' || line WHEN 'purchase' THEN '{{"url":"https://h' || line || '"}}' ELSE 'q' || line END AS args,
    CASE line % 4 WHEN 0 THEN 'adjacency' WHEN 1 THEN 'shared' ELSE 'bfs' END AS confidence FROM act)"""


def _acts(spark, sf):
    e = events(spark, sf).where("event_type <> 'error'")
    k = F.col("event_type")
    pick = lambda a, b, c, d: F.when(k == "click", a).when(k == "signup", b).when(k == "purchase", c).otherwise(d)
    lit = F.lit
    args = pick(_s('{"path": "/d{}"}', "line"), _s('["ls   {}", null]', "line"), _s('["https://h{}"]', "line"), _s("q{}", "line"))
    result = F.when(k == "click", F.when(F.col("line") % 10 == 0, F.repeat(lit("ab cd "), 1000)).otherwise(_s("r{}", "line")))
    return e.select("pkg", "user_id", "idx", "line", pick(lit("fs.readFile"), lit("child_process.exec"), lit("https.request"), lit("os.hostname")).alias("qn"), pick(lit("File"), lit("Process"), lit("Network"), lit("Environment")).alias("domain"), pick(lit("File Reading"), lit("Command Execution"), lit(None), lit(None)).alias("behavior"), args.alias("arguments"), result.alias("result"), F.when(F.col("line") % 4 == 0, "adjacency").when(F.col("line") % 4 == 1, "shared").alias("confidence"))


@query(f"""WITH {_SEQ}, j AS (SELECT *, '{{"qualified_name":"' || name || '","domain":"' || domain || '","category":"' || CASE event_type WHEN 'click' THEN 'File Reading' WHEN 'signup' THEN 'Command Execution' WHEN 'purchase' THEN 'Network' ELSE 'Environment' END || '","arguments":"' || replace(args, '"', '\\"') || '","confidence":"' || confidence || '"}}' AS entry FROM shown),
  s AS (SELECT pkg, user_id, count(*) AS n, list_sort(list(DISTINCT confidence) FILTER (WHERE confidence <> 'bfs')) AS kinds, string_agg(entry, ',' ORDER BY idx) AS es FROM j GROUP BY ALL)
SELECT pkg, user_id, n, array_to_string(kinds, ',') AS kinds, md5('{{"api_sequence":[' || es || ']' || CASE WHEN len(kinds) > 0 THEN ',"attribution_notes":{{"has_uncertain_attribution":true,"confidence_kinds_present":["' || array_to_string(kinds, '","') || '"],"hedging_required":true}}' ELSE '' END || '}}') AS digest FROM s""")
def q_sequences(spark, sf):
    """Each user's events in order, as a judge is given them."""
    s = evidence.sequences(evidence.serialized(evidence.resolved(_acts(spark, sf))), ["pkg", "user_id"])
    return s.select("pkg", "user_id", F.col("n").cast("long").alias("n"), F.array_join("kinds", ",").alias("kinds"), F.md5("sequence").alias("digest"))


@query(f"""WITH {_SEQ} SELECT pkg, idx, '/d' || line AS file_path, 'read' AS operation, 'plain_text' AS content_type, CAST(6000 AS BIGINT) AS content_size FROM act WHERE event_type = 'click' AND line % 10 = 0""")
def q_io_records(spark, sf):
    return evidence.io_records(evidence.serialized(evidence.resolved(_acts(spark, sf))), ["pkg"])


def _teller(text: str) -> str:
    """A judge for tests: it names two files, one of which it mentions."""
    if "child_process" not in text:
        raise ConnectionError("busy")
    return json.dumps({"behavior_description": "reads /d10 and runs ", "key_files": [{"file_path": "/d10", "operation": "read"}, {"file_path": "/d20", "operation": "read"}]})


@query(f"""WITH {_SEQ}, u AS (SELECT pkg, user_id, bool_or(event_type = 'signup') AS runs, bool_or(event_type = 'click' AND line = 10) AS ten FROM act GROUP BY ALL)
SELECT pkg, user_id, CASE WHEN runs THEN 'reads /d10 and runs' END AS behavior, CASE WHEN runs AND ten THEN '/d10' WHEN runs THEN '' END AS files FROM u""")
def q_described(spark, sf):
    by = ["pkg", "user_id"]
    s = evidence.serialized(evidence.resolved(_acts(spark, sf)))
    out = evidence.described(evidence.sequences(s, by), evidence.io_records(s, by), by, _teller_quick)
    return out.select(*by, "behavior", F.array_join(F.transform("key_files", lambda f: f["file_path"]), ",").alias("files"))


def _teller_quick(text: str) -> str:
    try:
        return _teller(text)
    except ConnectionError:
        return "no JSON"


def _inspector(text: str) -> str:
    return json.dumps({"content_summary": "s", "security_signals": ["a", "b"]}) if "ab cd" in text else "?"


@query(f"""WITH {_SEQ}, w AS (SELECT pkg, user_id AS node, line, idx, row_number() OVER (PARTITION BY pkg ORDER BY idx) AS k FROM act WHERE event_type = 'click' AND line % 5 = 0)
SELECT pkg, idx AS pos, '/d' || line AS file_path, CASE WHEN line % 10 <> 0 THEN 'content_unavailable' END AS status, CASE WHEN line % 10 = 0 THEN 'a,b' END AS signals FROM w WHERE k <= 10""")
def q_inspected(spark, sf):
    a = evidence.resolved(_acts(spark, sf))
    rec = evidence.io_records(evidence.serialized(a), ["pkg", "user_id"])
    contents = evidence.large_contents(a, rec, ["pkg", "user_id"]).withColumnRenamed("user_id", "node")
    wanted = a.where("domain = 'File' AND line % 5 = 0").select("pkg", F.col("idx").alias("pos"), F.col("user_id").alias("node"), F.col("resolved_path").alias("file_path"), F.lit("read").alias("operation"))
    out = evidence.inspected(wanted, contents, ["pkg"], _inspector)
    return out.select("pkg", "pos", "file_path", "status", F.array_join("signals", ",").alias("signals"))


def _router(text: str) -> str:
    return json.dumps({"next_action": "try_dynamic", "reason": "r"}) if '"third_party":0' in text else json.dumps({"next_action": "stop"})


@query(f"""WITH {_NODES}, c AS (SELECT pkg, count(*) FILTER (WHERE bucket = 'third_party') AS n FROM node GROUP BY pkg) SELECT pkg, CASE WHEN n = 0 THEN 'try_dynamic' ELSE 'try_enrichment' END AS action, CASE WHEN n = 0 THEN 'router chose try_dynamic: r' ELSE 'router fallback: try_enrichment' END AS why FROM c""")
def q_routes(spark, sf):
    n = _nodes(spark, sf).groupBy("pkg").agg(F.to_json(F.struct(F.count(F.when(F.col("bucket") == "third_party", 1)).alias("third_party"))).alias("payload"))
    return model.routed(n, "payload", _router).select("pkg", "action", "why")
