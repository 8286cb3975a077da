"""Judgements of components, rolled up to entries and packages, and what is done with a judge's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaned_paths

#: The order in which nodes to check are shown.
PRIORITY = ("third_party", "conditional", "unresolved")


def synthesis(judgement: Column) -> Column:
    """Aggregate: malicious if any is, benign if all are or there is none, undetermined if any is, else benign."""
    return F.when(F.coalesce(F.bool_or(judgement == "malicious"), F.lit(False)), "malicious").when(F.coalesce(F.bool_or(judgement == "undetermined"), F.lit(False)), "undetermined").otherwise("benign")


def severity(judgement: Column) -> Column:
    return F.when(judgement == "malicious", 2).when(judgement == "warning", 1).otherwise(0)


def status_counts(df: DataFrame, by: list[str], status: str) -> DataFrame:
    """(by, status, n); null counts as unknown."""
    return df.groupBy(*by, F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def latest(df: DataFrame, by: list[str], seq: str, cols: list[str]) -> DataFrame:
    """The row of the greatest seq for each `by` that isn't null."""
    kept = df.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.max(F.struct(seq, *cols)).alias("k"))
    return kept.select(*by, "k.*")


def top_details(nodes: DataFrame, by: list[str], bucket: str, pos: str, most: int = 10) -> DataFrame:
    """The first `most` nodes by bucket priority, then position, and `cut`: how many of the bucket were left out."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(bucket))
    n = nodes.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(rank, pos)))
    return n.withColumn("cut", F.sum(F.when(F.col("k") > most, 1).otherwise(0)).over(Window.partitionBy(*by, bucket))).where(F.col("k") <= most)


def sanitized(reports: DataFrame, evidence: DataFrame, by: list[str], resolved: tuple[str, ...] = ("sensitive_api", "sensitive_property")) -> DataFrame:
    """reports (by, judgement, ids): ids of resolved evidence go; an undetermined report that loses all its ids is benign."""
    gone = evidence.where(F.col("kind").isin(*resolved)).groupBy(*by).agg(F.collect_set("id").alias("__gone"))
    r = reports.join(gone, by, "left").withColumn("ids", F.when(F.col("__gone").isNull(), F.col("ids")).otherwise(F.filter("ids", lambda i: ~F.array_contains(F.col("__gone"), i))))
    return r.withColumn("judgement", F.when((F.col("judgement") == "undetermined") & (F.size("ids") == 0), "benign").otherwise(F.col("judgement"))).drop("__gone")


def reconciled(cached: DataFrame, fresh: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Fresh values over cached ones, field by field; rows that neither has are none."""
    f = fresh.select(*by, *[F.col(c).alias(f"__{c}") for c in cols])
    return cached.join(f, by, "full_outer").select(*by, *[F.coalesce(f"__{c}", c).alias(c) for c in cols])


#: How stages are shown in a history: fixed texts.
STAGES = {
    "install_script_analysis": "Install-Phase Shell Command Analysis",
    "static": "Static Analysis",
    "static_fallback": "Static Analysis (LLM Fallback)",
    "static_local_read": "Static Local File Read",
    "third_party_info_enrichment": "Third-Party Info Enrichment",
    "dynamic": "Dynamic Analysis",
    "dynamic_local_read": "Dynamic Local File Read",
}
JUDGEMENTS = ("benign", "malicious", "undetermined")
#: A judge's report: fixed fields.
REPORT = "judgement string, key_evidence array<struct<node_id:string,node_type:string,claim:string,file:string>>, reason string, explanation string, cross_component_evidence array<struct<pattern:string>>, node_to_be_checked array<string>, files_to_read array<string>"


def result_of(status: Column) -> Column:
    """benign, malicious and undetermined as they are; anything else is a warning."""
    return F.when(status.isin(*JUDGEMENTS), status).otherwise("warning")


def is_terminal(status: Column) -> Column:
    """Whether an entry's status ends its analysis."""
    return F.coalesce(status.isin("Benign", "Malicious Code"), F.lit(False))


def any_malicious(status: Column) -> Column:
    """Aggregate: whether any status says malicious code, in the package or in its manifest."""
    return F.coalesce(F.bool_or(status.isin("Malicious Code", "Malicious Package Json")), F.lit(False))


def install_step(scripts: DataFrame, by: list[str]) -> DataFrame:
    """Install scripts (by, pos, name, content, label, explanation, executed) -> (by, stage, result, finding): the worst label, and a
    line for each script with what it launches."""
    why = F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit(" ("), "explanation", F.lit(")"))).otherwise("")
    launches = F.when(F.size("executed") > 0, F.concat(F.lit("\n  ↳ Launches JS: "), F.array_join("executed", ", "))).otherwise("\n  ↳ No JS entry files identified")
    line = F.concat(F.lit("• "), "name", F.lit(': "'), "content", F.lit('" → '), "label", why, launches)
    out = scripts.groupBy(*by).agg(F.max(severity(F.col("label"))).alias("s"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
    return out.select(*by, F.lit("install_script_analysis").alias("stage"), F.when(F.col("s") == 2, "malicious").when(F.col("s") == 1, "warning").otherwise("benign").alias("result"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("finding"))


def history(steps: DataFrame, by: list[str], package: str, entry: Column | None = None) -> DataFrame:
    """(by, history): the steps (by, seq, stage, entry, result, finding, next_reason) of a package in words; with an entry only
    those of the package as a whole and of that entry. Packages without steps have no row."""
    kept = steps if entry is None else steps.where(F.col("entry").isNull() | (F.col("entry") == entry))
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    n = kept.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))
    own = F.when(F.coalesce("entry", F.lit("")) != "", F.concat(F.lit(" ("), "entry", F.lit(")"))).otherwise("")
    head = F.concat(F.lit("["), "__k", F.lit("] "), F.coalesce(names[F.col("stage")], "stage"), own, F.lit(" → "), F.concat(F.upper(F.substring("result", 1, 1)), F.lower(F.expr("substr(result, 2)"))))
    body = F.when(F.col("finding") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.regexp_replace("finding", r"\n$", ""), "\n", -1), lambda x: F.concat(F.lit("    "), x)))
    after = F.when(F.coalesce("next_reason", F.lit("")) != "", F.array(F.concat(F.lit("    → Next step reason: "), "next_reason"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(head), body, after, F.array(F.lit("")))
    out = n.groupBy(*by, F.col(package).alias("__package")).agg(F.array_sort(F.collect_list(F.struct("__k", lines.alias("ls")))).alias("s"))
    top = F.array(F.lit("=== Prior Analysis Context ==="), F.concat(F.lit("Package: "), "__package"), F.lit(""))
    return out.select(*by, F.array_join(F.concat(top, F.flatten(F.transform("s", lambda x: x["ls"])), F.array(F.lit("=============================="))), "\n").alias("history"))


def claims(evidence: Column, field: str = "claim") -> Column:
    """The texts of a field of an array of structs that aren't empty."""
    return F.transform(F.filter(evidence, lambda e: F.coalesce(e[field], F.lit("")) != ""), lambda e: e[field])


def said(reason: Column, explanation: Column) -> Column:
    return F.coalesce(F.nullif(reason, F.lit("")), F.nullif(explanation, F.lit("")), F.lit(""))


def finding(reason: Column, explanation: Column, key: Column, cross: Column, conditional: Column, third_party: Column, unresolved: Column) -> Column:
    """A judgement in one line: its reason, the claims of its evidence, patterns across components and flagged nodes, as far as
    there are any; "no findings" otherwise."""
    some = lambda xs, sep, before: F.when(F.size(xs) > 0, F.concat(F.lit(before), F.array_join(xs, sep)))
    ids = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}=["), F.array_join(xs.cast("array<string>"), ", "), F.lit("]")))
    nodes = F.nullif(F.concat_ws(", ", ids("conditional", conditional), ids("third_party", third_party), ids("unresolved", unresolved)), F.lit(""))
    why = F.nullif(said(reason, explanation), F.lit(""))
    out = F.concat_ws(" | ", F.concat(F.lit("reason: "), why), some(claims(key), "; ", "evidence: "), some(claims(cross, "pattern"), ", ", "cross-component patterns: "), F.concat(F.lit("flagged nodes: "), nodes))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("no findings"))


def prior_summary(entries: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """entries (by, REPORT) -> (by, reason, key_evidence, patterns, verdicts): what a router is told of an analysis so far, with
    each component's (by, component, judgement, reason, explanation) verdict in order."""
    each = components.select(*by, F.struct("component", F.coalesce("judgement", F.lit("unknown")).alias("judgement"), said(F.col("explanation"), F.col("reason")).alias("explanation")).alias("c"))
    verdicts = each.groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("verdicts"))
    own = entries.select(*by, said(F.col("reason"), F.col("explanation")).alias("reason"), claims(F.col("key_evidence")).alias("key_evidence"), claims(F.col("cross_component_evidence"), "pattern").alias("patterns"))
    return own.join(verdicts, by, "left")


def classified_ids(flagged: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """flagged (by, pos, node) -> (by, conditional, third_party, unresolved): node ids by what their call is (nodes: by, node,
    bucket), in order of pos and as often as flagged; others, and unknown ones, are in none."""
    j = flagged.join(nodes, [*by, "node"])
    ids = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("pos", "node")))), lambda x: x["node"]).alias(b)
    return j.groupBy(*by).agg(*[ids(b) for b in ("conditional", "third_party", "unresolved")])


def ids_to_check(components: DataFrame, cross: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, node): the nodes that a judgement across components (by, ids) names, else those that the components (by,
    component, ids) name, in their order."""
    c = cross.where("size(ids) > 0")
    own = components.join(c.select(*by), by, "left_anti").select(*by, "component", F.posexplode("ids").alias("p", "node"))
    return c.select(*by, F.posexplode("ids").alias("p", "node")).select(*by, F.struct(F.lit(0).cast("long").alias("component"), "p").alias("pos"), "node").unionByName(own.select(*by, F.struct(F.col("component").cast("long").alias("component"), "p").alias("pos"), "node"))


def dropped_by_bucket(nodes: DataFrame, by: list[str], bucket: str, pos: str, most: int = 10) -> DataFrame:
    """(by, bucket, dropped): how many nodes of each bucket the first `most` of all leave out; buckets that lose none have no row."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(bucket))
    n = nodes.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(rank, pos)))
    return n.where(F.col("__k") > most).groupBy(*by, bucket).agg(F.count("*").alias("dropped"))


def node_source(slices: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted (by, component, node) joined with the files of its component's slice (by, component, file, code, infos), and of the infos
    those that name the node."""
    j = wanted.join(slices, [*by, "component"])
    return j.withColumn("infos", F.filter("infos", lambda i: F.contains(i, F.concat(F.lit("[Node ID: "), F.col("node"), F.lit("]")))))


def synthesis_input(components: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Components (by, component, cfg_order, slice, report, successors) -> (by, payload: array by cfg_order, then id; by, from, to)."""
    own = F.struct("cfg_order", "component", "slice", "report")
    payload = components.groupBy(*by).agg(F.array_sort(F.collect_list(own)).alias("payload"))
    return payload, components.select(*by, F.col("component").alias("from"), F.explode("successors").alias("to"))


def entry_outcome(components: DataFrame, cross: DataFrame, by: list[str]) -> DataFrame:
    """(by, judgement, rule): no component is benign; one has its own verdict (null is benign); of more the judgement across
    them (by, judgement) holds, and where that is missing the rule over their verdicts. cross has a row for each entry."""
    c = components.groupBy(*by).agg(F.count("*").alias("n"), synthesis(F.coalesce("judgement", F.lit("benign"))).alias("ruled"), F.max(F.coalesce("judgement", F.lit("benign"))).alias("own"))
    j = cross.withColumnRenamed("judgement", "judged").join(c, by, "left")
    n = F.coalesce("n", F.lit(0))
    keep = lambda x: F.when(x.isin("malicious", "undetermined"), x).otherwise("benign")
    out = F.when(n == 0, "benign").when(n == 1, keep(F.col("own"))).when(F.col("judged").isNotNull(), keep(F.col("judged"))).otherwise(F.col("ruled"))
    return j.select(*by, out.alias("judgement"), F.when(n == 0, "none").when(n == 1, "single").when(F.col("judged").isNotNull(), "cross").otherwise("rule").alias("rule"))


def overlaid(prior: DataFrame, reread: DataFrame, by: list[str], last: Column, dynamic: bool = False) -> DataFrame:
    """Reports (by, REPORT) with a second reading's fields over them, as far as they are valid: a judgement of the three, evidence
    that is a list, words that aren't blank. Nodes to check are the second reading's, and only of what is undetermined; files to
    read too, none after the last hop. Without a second reading the report stays, but for its files. Dynamic reports have a
    judgement and an explanation only."""
    r = reread.select(*by, F.struct(*[c for c in reread.columns if c not in by]).alias("__r"))
    j = prior.join(r, by, "left")
    has = F.col("__r").isNotNull()
    judgement = F.when(F.col("__r.judgement").isin(*JUDGEMENTS), F.col("__r.judgement")).otherwise(F.coalesce("judgement", F.lit("undetermined")))
    words = lambda c: F.when(F.trim(F.col(f"__r.{c}")) != "", F.col(f"__r.{c}")).otherwise(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    nodes = F.when(judgement == "undetermined", F.coalesce("__r.node_to_be_checked", none)).otherwise(none)
    files = F.when(has & ~last, cleaned_paths(F.col("__r.files_to_read")))
    out = {"judgement": judgement, "explanation": words("explanation")} if dynamic else {"judgement": judgement, "key_evidence": F.coalesce("__r.key_evidence", "key_evidence"), "reason": words("reason"), "node_to_be_checked": nodes}
    cols = [F.when(has, v).otherwise(F.col(k)).alias(k) for k, v in out.items()]
    return j.select(*by, *cols, F.when(F.size(files) > 0, files).alias("files_to_read"))


def spawn_node(checked: Column, evidence: Column) -> Column:
    """struct(id, type): the first node to check that is a number, else the first of the evidence; its type there, else unresolved."""
    number = lambda x: x.try_cast("double").cast("long")
    first = F.get(F.filter(F.transform(checked, number), lambda x: x.isNotNull()), F.lit(0))
    from_evidence = F.get(F.filter(F.transform(evidence, lambda e: number(e["node_id"])), lambda x: x.isNotNull()), F.lit(0))
    id_ = F.coalesce(first, from_evidence)
    kind = F.get(F.transform(F.filter(evidence, lambda e: (number(e["node_id"]) == id_) & e["node_type"].isNotNull()), lambda e: e["node_type"]), F.lit(0))
    return F.when(id_.isNotNull(), F.struct(id_.alias("id"), F.coalesce(kind, F.lit("unresolved")).alias("type")))


def binary_verdict(reports: DataFrame, path: str, dynamic: bool = False) -> DataFrame:
    """Reports whose code hands control to a native binary at `path`, as malicious ones: what is compiled can't be read."""
    file = F.concat(F.lit("`"), F.col(path), F.lit("`"))
    if dynamic:
        return reports.withColumn("judgement", F.lit("malicious")).withColumn("explanation", F.concat(F.lit("hands control to the native binary "), file, F.lit(", which can't be read; malicious by policy")))
    spawn = spawn_node(F.col("node_to_be_checked"), F.col("key_evidence"))
    claim = F.concat(F.lit("spawns the native binary "), file, F.lit(", which can't be read; malicious by policy"))
    kind = reports.schema["key_evidence"].dataType.simpleString()
    evidence = F.when(spawn.isNotNull(), F.array(F.struct(spawn["id"].cast("string").alias("node_id"), spawn["type"].alias("node_type"), claim.alias("claim"), F.col(path).alias("file")))).otherwise(F.array())
    return reports.select(*[c for c in reports.columns if c not in ("judgement", "key_evidence", "reason", "node_to_be_checked")], F.lit("malicious").alias("judgement"), evidence.cast(kind).alias("key_evidence"), claim.alias("reason"), F.array().cast("array<string>").alias("node_to_be_checked"))


def recomputed(components: DataFrame, affected: DataFrame, fresh: DataFrame, cached: DataFrame, by: list[str], key: str = "component") -> DataFrame:
    """Components (by, key) with their report: the fresh one of those affected, the cached one of the others; those without
    the one that they need are left out."""
    own = components.select(*by, key).join(affected.select(*by, key).distinct().withColumn("__hit", F.lit(True)), [*by, key], "left")
    j = own.join(fresh.select(*by, key, F.col("report").alias("__new")), [*by, key], "left").join(cached.select(*by, key, F.col("report").alias("__old")), [*by, key], "left")
    return j.withColumn("report", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("__old"))).where("report IS NOT NULL").select(*by, key, "report")


def affected(index: DataFrame, flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by, component): components whose slice names any flagged node. index: (by, node, component)."""
    return index.join(flagged.select(*by, "node").distinct(), [*by, "node"], "left_semi").select(*by, "component").distinct()


def fallback_rollup(entries: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """(by, judgement, tried, last): entries (by, entry, judgement) that no graph was found for, in order of name: at most `most` are
    read, and none after the first malicious one; anything but malicious is benign."""
    n = entries.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("entry"))).where(F.col("__k") <= most)
    first = n.groupBy(*by).agg(F.min(F.when(F.col("judgement") == "malicious", F.col("__k"))).alias("__m"), F.count("*").alias("__n"))
    tried = n.join(first, by).where("__m IS NULL OR __k <= __m")
    return tried.groupBy(*by).agg(F.when(F.max("__m").isNotNull(), "malicious").otherwise("benign").alias("judgement"), F.count("*").alias("tried"), F.max_by("entry", "__k").alias("last"))


def package_report(packages: DataFrame, scripts: DataFrame, steps: DataFrame, by: str) -> DataFrame:
    """A row for each package (by, statuses): its install scripts, the last step of each entry, and whether its manifest is malicious."""
    s = scripts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "content", "label", "explanation"))).alias("s"))
    last = latest(steps.where("entry IS NOT NULL"), [by, "entry"], "seq", ["stage", "result", "finding"]).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("entry", "stage", "result", "finding"))).alias("entry_final_verdicts"))
    own = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content"), x["label"].alias("label"), x["explanation"].alias("explanation")))
    bad = F.exists("s", lambda x: x["label"] == "malicious")
    j = packages.join(s, by, "left").join(last, by, "left")
    return j.select(F.col(by).alias("package_name"), F.coalesce(bad, F.lit(False)).alias("maliciousness_in_package_json"), own.alias("install_time_script"), "entry_final_verdicts", F.col("statuses").alias("overall_statuses"))
