"""Queries over the driver's tables, one or more for each family of operators; oracle.py holds each in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import arguments
from ..operators import attribution, graph, interpreter, intervals, joins, log, model, rendering, slicing, verdict
from ..operators.catalog import RESOLVED_DOMAINS, lookup
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the catalog knows, with its columns."""
    ev = V.events(spark, sf_dir).where(log.admissible(F.col("file")))
    return lookup(ev, V.catalog(spark), "qn").where(F.col("domain").isNotNull())


@query
def q_domain_rollup(spark, sf):
    """The flagship: admissible events, catalog, last-wins dedup, domains and a verdict for each package."""
    e = log.last_wins(_known(spark, sf), ["pkg"], ["file", "line", "qn"], "idx")
    by_domain = e.groupBy("pkg", "domain").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    j = by_domain.withColumn("judgement", F.when((F.col("domain") == "Process") & (F.col("n") >= 40), "malicious").when(F.col("domain") == "Network", "undetermined").otherwise("benign"))
    return j.groupBy("pkg").agg(F.sum("n").alias("events"), F.max("files").alias("most_files"), F.count("*").alias("domains"), verdict.synthesis(F.col("judgement")).alias("verdict"))


@query
def q_catalog_lookup(spark, sf):
    e = lookup(V.events(spark, sf), V.catalog(spark), "qn")
    return e.groupBy("qn", "domain", "behavior").agg(F.count("*").alias("n"), F.max(F.col("domain").isin(*RESOLVED_DOMAINS)).alias("resolved"))


@query
def q_last_wins_dedup(spark, sf):
    e = V.events(spark, sf).withColumn("line", F.when(F.col("event_id") % 10 != 0, F.col("line")))
    return log.last_wins(e.select("pkg", "file", "line", "qn", "idx", "event_id"), ["pkg"], ["file", "line", "qn"], "idx").select("pkg", "event_id", F.col("log_index").cast("long").alias("log_index"))


@query
def q_callback_backfill(spark, sf):
    e = V.events(spark, sf).select("pkg", "idx", "event_id", "args", "event_type", F.lit(None).cast("string").alias("result"))
    e = e.withColumn("result", F.when(F.col("event_type") == "error", F.concat(F.lit("r"), "event_id")))
    return log.backfill(e, ["pkg"], "args", "result", "idx", F.col("event_type") == "error").select("pkg", "idx", "result")


@query
def q_call_to_source_asof(spark, sf):
    c = V.table(spark, sf, "conversations")
    out = log.sources_of_calls(c.select("conv_id", "turn", "role", F.md5("text").alias("text")), ["conv_id"], "turn", F.col("role") == "user", "text")
    return out


@query
def q_eval_args(spark, sf):
    return log.distinct_args(V.events(spark, sf).where("event_type = 'signup'"), ["pkg"], "args", "idx").select("pkg", "n", F.array_join("args", "|").alias("args"))


@query
def q_range_contains(spark, sf):
    ev = V.events(spark, sf)
    hits = joins.in_range(V.functions(ev), ev.select("pkg", "file", "line", "idx"), ["pkg", "file"], "sl", "el", "line")
    return hits.groupBy("pkg", "fid").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query
def q_exact_span(spark, sf):
    ev = V.events(spark, sf).withColumn("line", F.when(F.col("event_id") % 10 != 0, F.col("line")))
    return joins.first_match(ev.select("event_id", "file", "line"), ev.where("event_type IN ('click', 'view')").select("file", "line", "idx"), ["file", "line"], "idx")


@query
def q_exact_else_contain(spark, sf):
    ev = V.events(spark, sf)
    refs = ev.select("event_id", "pkg", "file", (F.floor(F.col("line") / 10) * 10 + F.when(F.col("event_id") % 4 == 0, 0).otherwise(1)).alias("s"), (F.floor(F.col("line") / 10) * 10 + 9).alias("e"))
    return joins.exact_else_containing(refs, V.functions(ev), "event_id", ["pkg", "file"], "sl", "el", "fid", "s", "e")


@query
def q_smallest_end(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return joins.smallest_end(li, ["l_orderkey"], F.col("l_quantity"), (F.col("l_orderkey") % 50).cast("double"))


@query
def q_module_root(spark, sf):
    f = V.events(spark, sf).select("file").distinct()
    nested = f.select(F.concat("file", F.lit("/node_modules/@s/q/i.js")).alias("file")).unionByName(f).unionByName(f.select(F.concat(F.lit("./"), "file").alias("file")))
    r = X.module_root(F.col("file"))
    return nested.select("file", r.alias("root"), X.root_depth(r).alias("depth"), X.root_package(r).alias("package"), X.package_root(F.col("file")).alias("own"), X.normal_path(F.col("file")).alias("path"), X.path_is_under(F.col("file"), F.lit("node_modules/p1/")).alias("under_p1"))


@query
def q_prefix_candidates(spark, sf):
    ev = V.events(spark, sf)
    _, roots, _ = V.chains(ev)
    return joins.under_roots(ev, roots, ["pkg"], X.root_ancestors(F.col("file")), "root", "chain", X.root_depth(F.col("root")), "idx")


@query
def q_scoped_asof(spark, sf):
    o = V.table(spark, sf, "orders")
    refs = o.select(F.col("o_orderkey").alias("ref"), "o_custkey", F.col("o_orderdate").alias("at"))
    bind = o.select("o_custkey", F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("seq"))
    return joins.scoped_asof(refs, bind, ["o_custkey"], "ref", "at", "since", ["seq"]).select("ref", "seq")


def _registered(spark, sf):
    ev = V.events(spark, sf)
    c, roots, anchors = V.chains(ev)
    reg = attribution.registrations(ev, c, roots, anchors, ["pkg"])
    return ev, c, roots, anchors, reg


@query
def q_registrations(spark, sf):
    return _registered(spark, sf)[4]


@query
def q_claim_window(spark, sf):
    ev, _, _, _, reg = _registered(spark, sf)
    return joins.claim_window(ev.select("pkg", "idx"), reg.where("reg IS NOT NULL").select("pkg", "chain", "reg"), ["pkg"], "idx", "reg").select("pkg", "idx", "chain", "reg")


@query
def q_nearest_anchor(spark, sf):
    ev, _, _, anchors, _ = _registered(spark, sf)
    cand = ev.select("pkg", "idx").join(anchors.select("pkg", "chain").distinct(), "pkg")
    return joins.nearest(cand, anchors.withColumnRenamed("idx", "anchor"), ["pkg"], "chain", "idx", "anchor").select("pkg", "idx", "chain", F.col("distance").cast("long").alias("distance"), F.col("later").cast("long").alias("later"), "winners")


@query
def q_orphans_anti(spark, sf):
    ev = V.events(spark, sf).withColumn("line", F.when(F.col("event_id") % 10 != 0, F.col("line")))
    return joins.orphans(ev.select("event_id", "file", "line"), ev.where("event_type = 'purchase'").select("file", "line"), ["file", "line"])


@query
def q_gap_islands(spark, sf):
    ev = V.events(spark, sf)
    bounds = ev.groupBy("pkg").agg((F.max("idx") + 1).alias("n"))
    return intervals.missing_runs(ev.where("event_type IN ('click', 'view')").select("pkg", "idx"), ["pkg"], "idx", bounds)


@query
def q_adjacency_islands(spark, sf):
    ev, _, _, anchors, _ = _registered(spark, sf)
    a = anchors.select("pkg", F.col("chain").alias("chain_ord"), F.col("idx").alias("anchor"))
    return intervals.adjacency(ev.where("event_type = 'error'").select("pkg", "idx"), a, ["pkg"], "idx", "chain_ord", "anchor", 5)


@query
def q_attribution(spark, sf):
    ev = V.events(spark, sf)
    c, roots, anchors = V.chains(ev)
    return attribution.attribute(ev.select("pkg", "idx", "file"), ev.where("event_type IN ('click', 'view')").select("pkg", "idx"), c, roots, anchors, ["pkg"], 5)


@query
def q_fingerprint_groups(spark, sf):
    f = attribution.fingerprints(V.events(spark, sf), ["pkg", "user_id", "line"], ["qn"])
    return f.groupBy("fingerprint").agg(F.count("*").alias("chains"), F.max("n").alias("length"), F.min("user_id").alias("first_user"))


@query
def q_reach_forward(spark, sf):
    a = V.arcs(spark, sf).where(F.col("label").isin(*graph.DATA))
    return graph.reached(a.where("label = 'Object_Data'").select("g", F.col("src").alias("v")), a, ["g"]).select("g", "v", F.col("depth").cast("long").alias("depth"))


@query
def q_reach_backward_barrier(spark, sf):
    a = V.arcs(spark, sf).where(F.col("label").isin(*graph.DATA))
    barrier = a.where("src % 10 = 7").select(F.col("src").alias("v")).distinct()
    return graph.reached(a.where("label = 'Object_Data'").select("g", F.col("dst").alias("v")), a, ["g"], backward=True, barriers=barrier).select("g", "v")


def _sliced(spark, sf):
    a = V.arcs(spark, sf)
    flagged = a.where("src % 3 = 1").select("g", F.col("src").alias("v")).distinct()
    return a, flagged, graph.slice_components(a, flagged, ["g"])


@query
def q_components(spark, sf):
    return _sliced(spark, sf)[2]


@query
def q_component_order(spark, sf):
    a, flagged, members = _sliced(spark, sf)
    lines = members.select("g", "v", (F.col("v") % 37).alias("line"))
    reps = graph.representatives(members, lines, flagged, ["g"])
    order = graph.component_order(reps, a, ["g"]).groupBy("g", "component").agg(F.array_join(F.sort_array(F.collect_set("successor")), ",").alias("successors"))
    return reps.join(order, ["g", "component"], "left").select("g", "component", "v", "cfg_order", F.coalesce("successors", F.lit("")).alias("successors"))


@query
def q_nearest_flagged(spark, sf):
    a = V.arcs(spark, sf)
    flagged = a.where("dst % 5 = 1").select("g", F.col("dst").alias("v")).distinct()
    sources = a.select("g", F.col("src").alias("v")).distinct()
    return graph.nearest_flagged(sources, a, flagged, ["g"]).select("g", "origin", "v")


@query
def q_common_ancestor(spark, sf):
    a = V.arcs(spark, sf)
    v = a.select("g", F.col("dst").alias("a")).distinct()
    pairs = v.withColumn("b", F.lead("a").over(Window.partitionBy("g").orderBy("a"))).where("b IS NOT NULL")
    return graph.common_ancestors(pairs, a, ["g"])


@query
def q_dep_closure(spark, sf):
    a = V.arcs(spark, sf)
    return graph.closure(a.select("g", F.col("src").alias("parent"), F.col("dst").alias("child")).distinct(), ["g"])


@query
def q_edge_type(spark, sf):
    e = V.table(spark, sf, "events")
    label = F.when(F.col("event_type") == "click", "DDG: x").when(F.col("event_type") == "view", "CFG").when(F.col("event_type") == "error", "REMOVE: x").otherwise("CDG: x")
    edges = e.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.array(label).alias("labels"))
    return graph.arcs_of(edges.withColumn("g", F.lit(0)), ["g"]).drop("g")


def _nodes(spark, sf):
    ev = V.events(spark, sf)
    bucket = F.when(F.col("event_type") == "purchase", "third_party").when(F.col("event_type") == "signup", "conditional").when(F.col("event_type") == "error", "unresolved")
    return ev.select("pkg", "idx", bucket.alias("bucket")).where("bucket IS NOT NULL")


@query
def q_classify_buckets(spark, sf):
    return _nodes(spark, sf).groupBy("pkg").agg(*[F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in verdict.PRIORITY])


@query
def q_router_topk(spark, sf):
    return verdict.top_details(_nodes(spark, sf), ["pkg"], "bucket", "idx").select("pkg", "idx", "bucket", F.col("k").cast("long").alias("k"), F.col("cut").cast("long").alias("cut"))


def _judged(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", "lang")
    j = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "undetermined").otherwise("benign")
    return d.join(V.table(spark, sf, "labels"), "doc_id", "left").withColumn("judgement", F.when(F.col("quality").isNotNull(), j))


@query
def q_verdict_entry(spark, sf):
    return _judged(spark, sf).groupBy("source", "lang").agg(verdict.synthesis(F.col("judgement")).alias("verdict"), F.count("judgement").alias("n"))


@query
def q_verdict_package(spark, sf):
    j = _judged(spark, sf).groupBy("source").agg(F.max(verdict.severity(F.col("judgement"))).cast("long").alias("severity"), F.bool_or(F.coalesce(F.col("judgement") == "malicious", F.lit(False))).alias("malicious"))
    return j.withColumn("status", X.status_of(F.when(F.col("malicious"), "malicious")))


@query
def q_status_counts(spark, sf):
    return verdict.status_counts(_judged(spark, sf), ["lang"], "judgement")


@query
def q_latest_step(spark, sf):
    c = V.table(spark, sf, "conversations")
    return verdict.latest(c.select("conv_id", "turn", "role", F.md5("text").alias("finding")), ["conv_id"], "turn", ["role", "finding"])


@query
def q_sanitize_report(spark, sf):
    ev = V.events(spark, sf)
    reports = ev.groupBy("pkg", "user_id").agg(F.sort_array(F.collect_set("line")).alias("ids"), F.when(F.min("event_id") % 2 == 0, "undetermined").otherwise("malicious").alias("judgement"))
    kind = F.when(F.col("event_type").isin("click", "view", "signup"), "sensitive_api").when(F.col("event_type") == "error", "sensitive_property").otherwise("third_party")
    evidence = ev.select("pkg", "user_id", F.col("line").alias("id"), kind.alias("kind"))
    return verdict.sanitized(reports, evidence, ["pkg", "user_id"]).select("pkg", "user_id", "judgement", F.array_join("ids", ",").alias("ids"))


@query
def q_reconcile(spark, sf):
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    first = c.where("turn = 0").select("conv_id", "role", "chars")
    last = c.where("turn > 0").groupBy("conv_id").agg(F.max_by(F.struct("role", "chars"), "turn").alias("l")).select("conv_id", F.when(F.col("l.chars") % 2 == 0, F.col("l.role")).alias("role"), "l.chars")
    return verdict.reconciled(first, last, ["conv_id"], ["role", "chars"])


@query
def q_text_type(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("kind"), "text")
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("p").alias("kind"), F.col("html").alias("text"))
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("e").alias("kind"), F.col("props").alias("text"))
    t = F.col("text")
    k = F.col("event_id") % 7
    script = F.when(k == 0, "#!/usr/bin/env -S node\nx").when(k == 1, " #!/bin/dash").when(k == 2, "x\n for a in b").when(k == 3, F.concat(F.lit("const a"), "event_id", F.lit(" = 1"))).when(k == 4, "<?XML ?>").when(k == 5, '{"a": ').otherwise("#! python")
    s = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("s").alias("kind"), script.alias("text"))
    return d.unionByName(p).unionByName(e).unionByName(s).select("kind", "id", X.text_type(t).alias("type"), X.content_tier(t).alias("tier"))


@query
def q_security_snippets(spark, sf):
    d = V.table(spark, sf, "documents")
    hits = slicing.hit_lines(d.select("doc_id", "text"), ["doc_id"], "text")
    return intervals.merged_ranges(hits, ["doc_id"], "line", "last").select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "hits")


@query
def q_url_fields(spark, sf):
    u = X.url_fields(F.col("url"))
    return V.table(spark, sf, "pages").select("page_id", u["protocol"].alias("protocol"), u["host"].alias("host"), u["port"].alias("port"), u["path"].alias("path"), X.safe_entry_name(F.col("url")).alias("entry"))


@query
def q_node_scripts(spark, sf):
    ev = V.events(spark, sf).select("event_id", F.concat(F.lit("cd x && node ./f"), "user_id", F.lit(".js g"), "line", F.lit(".mjs ; echo node; node "), "event_type", F.lit(".txt")).alias("cmd"))
    return ev.select("event_id", F.array_join(F.transform(X.script_targets(F.col("cmd")), lambda x: F.trim(x)), "|").alias("scripts"))


@query
def q_node_id_index(spark, sf):
    ev = V.events(spark, sf)
    snippets = ev.select("pkg", F.col("idx").alias("component"), F.concat(F.lit("x() // [Node ID: "), "line", F.lit("] y [Node ID: "), F.col("user_id"), F.lit("]")).alias("snippet"))
    ids = snippets.select("pkg", "component", F.explode(X.node_ids(F.col("snippet"))).alias("node"))
    return ids.groupBy("pkg", "node").agg(F.max("component").alias("component"))


@query
def q_enrichment_levels(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 3 == 0).alias("trusted"))
    li = V.table(spark, sf, "lineitem")
    module = li.where("l_quantity <= 1").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("module", F.lit(True))
    api = li.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("api", F.lit(True))
    return slicing.enrichment(p.join(module, "p_partkey", "left").join(api, "p_partkey", "left"), "trusted", "module", "api").groupBy("p_brand", "level").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query
def q_trust_rules(spark, sf):
    o = V.table(spark, sf, "orders")
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    m = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("versions"), F.max("o_orderdate").alias("last_release"))
    as_of = F.to_timestamp(F.lit("1998-08-02"))
    recent = F.coalesce(F.col("last_release") > as_of - F.expr("INTERVAL 360 DAYS"), F.lit(False))
    v = F.coalesce("versions", F.lit(0))
    rule = F.when(v == 0, "no_release").when(~recent, "stale").when(F.col("c_acctbal") > 9000, "trusted").when(v < 3, "few_versions").otherwise("ask")
    return c.join(m, "c_custkey", "left").select("c_custkey", rule.alias("rule"))


@query
def q_interval_nesting(spark, sf):
    li = V.table(spark, sf, "lineitem")
    r = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("long")).alias("lo"), F.max((F.col("l_quantity") + F.floor(F.col("l_extendedprice") / 2000)).cast("long")).alias("hi"))
    return intervals.parents(r, ["l_orderkey"], "l_linenumber", "lo", "hi")


@query
def q_positional_params(spark, sf):
    li = V.table(spark, sf, "lineitem")
    args = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("value"))
    params = li.select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_suppkey").alias("name"))
    return slicing.positional(args, params, ["l_orderkey"], "l_linenumber")


@query
def q_listing_semi(spark, sf):
    ev = V.events(spark, sf).withColumn("file", F.concat("file", F.lit("#"), "line"))
    listed = ev.where("event_type IN ('click', 'view')").select("file").distinct()
    only = ev.where("event_type NOT IN ('click', 'view')").select("file").distinct().join(listed, "file", "left_anti").select("file", F.lit("dynamic_only").alias("kind"))
    both = ev.where("event_type = 'purchase'").select("file").distinct().join(listed, "file", "left_semi").select("file", F.lit("listed").alias("kind"))
    return only.unionByName(both)


@query
def q_entry_union(spark, sf):
    f = V.events(spark, sf).select("file", "event_type", "user_id").distinct()
    main = f.where("event_type = 'click' AND user_id % 5 = 0").select(F.explode(X.main_candidates(F.concat(F.lit("./src/f"), "user_id"))).alias("entry"))
    exports = f.where("event_type = 'view'").select(X.normal_path(F.col("file")).alias("entry"))
    exists = f.select(X.normal_path(F.col("file")).alias("entry")).distinct()
    return main.unionByName(exports).distinct().join(exists, "entry", "left_semi")


@query
def q_annotation_text(spark, sf):
    e = lookup(V.events(spark, sf), V.catalog(spark), "qn")
    return e.select("event_id", slicing.annotation(F.col("event_id"), F.col("qn"), F.col("behavior"), F.col("event_type") == "purchase", F.col("event_type") == "error").alias("text"))


@query
def q_end_position(spark, sf):
    d = V.table(spark, sf, "documents")
    e = X.end_position(F.col("doc_id") % 100, F.col("doc_id") % 7, F.col("text"))
    return d.select("doc_id", e["line"].cast("long").alias("line"), e["col"].cast("long").alias("col"))


@query
def q_base_package(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("@"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("/m"), "p_partkey", F.lit("/sub"))).when(F.col("p_partkey") % 4 == 1, "node:fs").when(F.col("p_partkey") % 4 == 2, "./local").otherwise(F.concat(F.lit("m"), "p_partkey", F.lit("/x"))).alias("name"))
    n = F.col("name")
    return p.select("p_partkey", X.base_package(n).alias("base"), X.is_core_module(n).alias("core"), X.is_third_party(n).alias("third_party"))


@query
def q_model_stub(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = model.judged(d, "prompt", model.stub)
    return out.select("doc_id", F.get_json_object("answer", "$.judgement").alias("judgement"), F.get_json_object("answer", "$.words").cast("long").alias("words"))


@query
def q_interpreted_calls(spark, sf):
    """Each package's events as a program: clicks, signups and purchases load a module into a name, errors a text; views call it."""
    ev = V.events(spark, sf)
    kind, name = F.col("event_type"), F.concat(F.lit("v"), "line")
    module = F.when(kind == "click", "fs").when(kind == "signup", "node:child_process").otherwise(F.concat(F.lit("p"), F.col("user_id") % 7))
    op = F.when(kind == "view", "call").when(kind == "error", "assign").otherwise("require")
    args = F.when(kind == "view", F.array(F.concat(name, F.lit(".exec")), F.when(F.col("user_id") % 2 == 0, "'ls'").otherwise("command"))).when(kind == "error", F.array(F.lit("'x'"))).otherwise(F.array(F.concat(F.lit("'"), module, F.lit("'"))))
    program = ev.select("pkg", F.lit("").alias("fn"), F.col("idx").alias("seq"), F.col("event_id").alias("node"), op.alias("op"), F.when(kind != "view", name).alias("dst"), args.alias("args"))
    out = interpreter.interpreted(program, ["pkg"]).where(F.col("state").isin("external", "third_party", "conditional", "unresolved"))
    return interpreter.classified(lookup(out, V.catalog(spark), "qn")).select("pkg", "node", "qn", "state", "literal", "kind", F.get("sources", F.lit(0)).alias("source"))


@query
def q_call_arguments(spark, sf):
    """Events as recorded calls: signups spawn, clicks write a buffer, purchases request, views connect, errors resolve."""
    e = V.table(spark, sf, "events").withColumn("line", F.get_json_object("props", "$.k"))
    u, odd = F.col("user_id"), F.col("user_id") % 2 == 1
    t = lambda x, *cols: F.format_string(x, *cols)
    spawned = F.when(odd, t('{"args": ["f%d.js", %s], "file": "node"}', u, "line")).otherwise(t('["node", ["f%d.js", "-k"], null]', u))
    request = F.when(odd, t('["https://h%d/", null]', u)).otherwise(t('[{"port": %s, "hostname": "h%d"}]', "line", u))
    call = (
        F.when(F.col("event_type") == "signup", F.struct(F.lit("child_process.spawn").alias("name"), spawned.alias("args")))
        .when(F.col("event_type") == "click", F.struct(F.lit("fs.writeFile").alias("name"), t('{"path": "/p%d", "data": {"type": "Buffer", "data": [104, 195, 169]}}', u).alias("args")))
        .when(F.col("event_type") == "purchase", F.struct(F.lit("https.request").alias("name"), request.alias("args")))
        .when(F.col("event_type") == "view", F.struct(F.lit("net.connect").alias("name"), t('[%s, "h%d", null]', "line", u).alias("args")))
        .otherwise(F.struct(F.lit("dns.resolveMx").alias("name"), t('["h%d"]', u).alias("args")))
    )
    e = e.select("event_id", call.alias("c"))
    name, args = F.col("c.name"), F.col("c.args")
    wrote = arguments.written(name, args)
    process = F.when(name.startswith("child_process."), arguments.command(name, args))
    return e.select("event_id", process.alias("command"), wrote["path"].alias("path"), wrote["data"].alias("data"), arguments.endpoint(name, args).alias("endpoint"))


@query
def q_rendered_slices(spark, sf):
    """Documents as files: each line that starts with a capital is flagged, its first word said of it."""
    lines = F.split("text", "\n")
    sizes = F.transform(lines, lambda x: F.octet_length(x))
    places = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b) + i).alias("start"), F.element_at(sizes, i + 1).alias("size")))
    hits = F.filter(places, lambda p: p["line"].rlike("^[A-Z]"))
    none = F.lit(None).cast("int")
    nodes = F.transform(hits, lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), none.alias("head"), none.alias("foot"), F.lit(True).alias("hit"), F.array(F.regexp_extract(p["line"], "^[A-Za-z]+", 0)).alias("info")))
    d = V.table(spark, sf, "documents").select("doc_id", rendering.rendered(F.col("text"), nodes).alias("slice"))
    return d.select("doc_id", F.length("slice").cast("long").alias("chars"), F.md5("slice").alias("digest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_domain_rollup(spark, sf_dir)
