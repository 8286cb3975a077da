"""Queries of the column functions, over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..functions.content import SECURITY
from ..operators import evidence
from .oracle import EV
from .registry import query
from .views import events, table

_ARGS = "CASE event_id % 6 WHEN 0 THEN 'git+https://github.com/o' || u || '/r' || line || '.git#main' WHEN 1 THEN 'git://github.com/o' || u || '/r' || line || '/' WHEN 2 THEN 'git@github.com:o' || u || '/r' || line || '.git' WHEN 3 THEN 'GitHub:o' || u || '/r' || line WHEN 4 THEN ' ssh://git@github.com/o' || u || '/r' || line || ' x' ELSE 'file:../r' || line END"


def _numbers(spark, sf):
    return events(spark, sf).select("event_id", F.col("user_id").alias("u"), "line", "event_type")


def _choice(key, *texts):
    out = F.when(key == 0, texts[0])
    for k, t in enumerate(texts[1:], 1):
        out = out.when(key == k, t)
    return out


def _s(text: str, *cols: str):
    """text with columns in place of its braces."""
    parts = text.split("{}")
    return F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(p)] + ([F.col(cols[k]).cast("string")] if k < len(cols) else []))])


@query(f"""WITH {EV}, n AS (SELECT event_id, user_id AS u, line FROM ev)
SELECT event_id, CASE WHEN event_id % 6 < 5 THEN 'https://github.com/o' || u || '/r' || line END AS url, CASE WHEN event_id % 6 < 5 THEN 'o' || u || '/r' || line END AS repo FROM n""")
def q_repo_url(spark, sf):
    n = _numbers(spark, sf)
    raw = _choice(F.col("event_id") % 6, _s("git+https://github.com/o{}/r{}.git#main", "u", "line"), _s("git://github.com/o{}/r{}/", "u", "line"), _s("git@github.com:o{}/r{}.git", "u", "line"), _s("GitHub:o{}/r{}", "u", "line"), _s(" ssh://git@github.com/o{}/r{} x", "u", "line"), _s("file:../r{}", "line"))
    url = X.repo_url(raw)
    return n.select("event_id", url.alias("url"), X.owner_repo(url).alias("repo"))


@query(f"""WITH {EV} SELECT event_id, sha256('m' || user_id) AS key, CAST(('0x' || substr(sha256('m' || user_id), 9, 8)) AS BIGINT) % 2147483648 AS place,
  CASE line % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, CASE WHEN line % 3 = 0 THEN NULL ELSE 'b' || line END AS behavior,
  CASE WHEN line % 2 = 0 THEN user_id ELSE line END AS pages, CASE WHEN line % 3 = 1 THEN 'lib/f' || line || '.d.ts' END AS types FROM ev""")
def q_package_facts(spark, sf):
    n = _numbers(spark, sf)
    k = F.col("line")
    said = _choice(k % 4, F.lit("Yes"), F.lit("0"), F.lit("T"), F.lit("maybe"))
    link = F.when(k % 2 == 0, _s('<https://x/y?per_page=1&page=2>; rel="next", <https://x/y?per_page=1&page={}>; rel="last"', "u"))
    path = F.when(k % 3 == 1, _s(" ././/lib/f{}.d.ts", "line")).otherwise(_s("./lib/f{}.ts", "line"))
    name = _s("m{}", "u")
    return n.select(
        "event_id", X.cache_key(name).alias("key"), X.lock_offset(name).alias("place"), X.flag(said).alias("flag"),
        X.known(F.when(k % 3 == 0, "unknown").otherwise(_s("b{}", "line"))).alias("behavior"), X.last_page(link, k).alias("pages"), X.declaration_path(path).alias("types"),
    )


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n, max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END) AS last, sum(CAST(floor(o_totalprice) AS BIGINT)) AS spent FROM orders GROUP BY ALL),
  m AS (SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last > TIMESTAMP '1998-08-02' - INTERVAL 360 DAYS, false) AS recent, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS readme, c_custkey % 3 <> 0 AS repo, c_custkey % 7 = 0 AS big, c_acctbal FROM customer LEFT JOIN o ON c = c_custkey)
SELECT c_custkey, recent, CASE WHEN (c_acctbal > 1000 AND repo AND n >= 3 AND readme IS NOT NULL AND recent) OR big THEN 'trusted' WHEN readme IS NULL OR NOT repo THEN 'untrusted' ELSE 'ask' END AS rule FROM m""")
def q_release_trust(spark, sf):
    """Customers as packages: orders are versions, those with a key divisible by five the entry `modified`."""
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("modified"), "o_orderkey")).otherwise(F.concat(F.lit("v"), "o_orderkey"))
    o = table(spark, sf, "orders").withColumn("k", name).withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    o = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("log"), F.count("*").alias("n"))
    log_ = F.map_filter("log", lambda k, _: ~F.startswith(k, F.lit("modified")))
    bad = F.map_concat(log_, F.create_map(F.lit("modified"), F.lit("2030-01-01T00:00:00Z"), F.lit("broken"), F.lit("soon")))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left")
    recent = X.recent_release(F.coalesce(bad, F.create_map(F.lit("created"), F.lit("2030-01-01T00:00:00Z"))), F.to_timestamp(F.lit("1998-08-02")))
    k = F.col("c_custkey")
    rule = X.trust_rule(F.when(F.col("c_acctbal") > 1000, 20000).otherwise(5), k % 3 != 0, F.coalesce("n", F.lit(0)), F.when(k % 4 != 0, F.col("c_mktsegment")), recent, F.when(k % 7 == 0, 10001))
    return c.select("c_custkey", recent.alias("recent"), rule.alias("rule"))


@query(f"""WITH {EV}, n AS (SELECT event_id, event_id % 8 AS k, user_id AS u, line FROM ev)
SELECT event_id, CASE k WHEN 0 THEN 'script' WHEN 1 THEN 'binary' WHEN 4 THEN 'script' WHEN 5 THEN 'binary' WHEN 7 THEN 'script' ELSE 'unknown' END AS kind, k IN (2, 3, 4, 5) AS bare, k IN (2, 4, 5) AS command,
  CASE k WHEN 0 THEN 'lib/f' || u || '.js' WHEN 1 THEN 'bin/x' || u || '.NODE' WHEN 2 THEN 'm' || u WHEN 3 THEN '@s/m' || u || '/x' WHEN 4 THEN 'm' || u || '.txt' WHEN 5 THEN 'x' || line || '.so' END AS path,
  CASE k WHEN 2 THEN 14 WHEN 3 THEN 14 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 4 END AS candidates FROM n""")
def q_requested_paths(spark, sf):
    n = _numbers(spark, sf)
    p = _choice(F.col("event_id") % 8, _s("./a/../lib//f{}.js", "u"), _s("bin/x{}.NODE", "u"), _s("m{}", "u"), _s("@s/m{}/x", "u"), _s("m{}.txt", "u"), _s("x{}.so", "line"), _s("../up{}", "u"), _s("/abs/f{}.json", "u"))
    return n.select("event_id", X.kind_of_path(p).alias("kind"), X.is_bare_specifier(p).alias("bare"), X.is_bare_command(p).alias("command"), X.resolved_path(p).alias("path"), F.size(X.file_candidates(p)).alias("candidates"))


@query(f"""WITH {EV} SELECT event_id, 'dist/f' || line || '.js|package|lib/package/x' || CASE WHEN line % 2 = 0 THEN '|other' ELSE '' END AS paths,
  CASE WHEN line % 3 = 0 THEN '7|' || line || '|12' ELSE '7|' || line END AS ids, user_id % 3 = 0 AS method FROM ev""")
def q_cleaned_answers(spark, sf):
    n = _numbers(spark, sf)
    f = _s("dist/f{}.js", "line")
    paths = F.array(F.concat(F.lit(" ./package/"), f), f, F.lit("package"), F.lit(""), F.lit(None).cast("string"), F.lit("lib/package/x "), F.when(F.col("line") % 2 == 0, "package//other").otherwise(" "))
    ids = F.array(F.lit("7"), F.concat(F.col("line").cast("string"), F.lit(".9")), F.lit("x"), F.lit(None).cast("string"), F.when(F.col("line") % 3 == 0, " 12 ").otherwise("1e3x"))
    return n.select("event_id", F.array_join(X.cleaned_paths(paths), "|").alias("paths"), F.array_join(X.whole_numbers(ids).cast("array<string>"), "|").alias("ids"), X.is_instance_method(F.when(F.col("u") % 3 == 0, "forEach").otherwise("readFile")).alias("method"))


@query(r"""WITH d AS (SELECT doc_id, string_split(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), 'e', chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, doc_id % 50 + len(ls) - 1 AS line, CASE WHEN len(ls) = 1 THEN doc_id % 9 + length(ls[1]) ELSE length(ls[len(ls)]) END AS col FROM d""")
def q_call_end(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("text", F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), "e", "\\\\\\\\n"))
    e = X.call_end(F.col("doc_id") % 50, F.col("doc_id") % 9, F.col("text"))
    return d.select("doc_id", e["line"].cast("long").alias("line"), e["col"].cast("long").alias("col"))


@query(f"""WITH {EV}, g AS (SELECT user_id, list(DISTINCT args ORDER BY args) AS a FROM ev GROUP BY ALL)
SELECT user_id, array_to_string(list_transform(a[1:3], lambda x: '`' || CASE WHEN length(x) > 8 THEN substr(x, 1, 8) || '...(' || (length(x) - 8) || ' more chars truncated)' ELSE x END || '`'), ' | ')
  || CASE WHEN len(a) > 3 THEN ' | ...(' || (len(a) - 3) || ' additional unique source variant(s) omitted)' ELSE '' END AS preview FROM g""")
def q_eval_preview(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_set("args")).alias("a"))
    return g.select("user_id", X.eval_preview(F.col("a"), 3, 8).alias("preview"))


@query("""WITH d AS (SELECT doc_id, text AS t, length(text) AS n, substring(text, 1, 1024) AS h FROM documents),
  c AS (SELECT *, contains(h, chr(0)) OR length(regexp_replace(h, '[\\x00-\\x7F]', '', 'g')) > 0.3 * length(h) AS bin FROM d)
SELECT doc_id, CASE WHEN n <= 5000 AND n > 0 THEN md5(t) WHEN bin THEN md5('[binary data, ' || n || ' bytes]') END AS inline, CASE WHEN n > 5000 AND NOT bin THEN n END AS size,
  CASE WHEN n > 5000 AND NOT bin THEN 'File I/O: read "d' || doc_id || '" (type=plain_text, size=' || n || ') | write "e"' ELSE '' END AS summary FROM c""")
def q_shown_content(spark, sf):
    d = table(spark, sf, "documents").withColumn("c", X.shown_content(F.col("text")))
    rec = lambda op, p, t, n: F.struct(op.alias("operation"), p.alias("file_path"), t.alias("content_type"), n.alias("content_size"))
    none = F.lit(None)
    records = F.array(rec(F.lit("read"), F.concat(F.lit("d"), "doc_id"), F.when(F.col("c.content_type").isNotNull(), "plain_text"), F.col("c.size")), rec(F.lit("write"), F.lit("e"), none.cast("string"), none.cast("long")))
    summary = X.io_summary(F.when(F.col("c.size").isNotNull(), records))
    return d.select("doc_id", F.md5("c.inline").alias("inline"), F.col("c.size").alias("size"), F.coalesce(summary, F.lit("")).alias("summary"))


_SQL_SECURITY = SECURITY.replace("'", "''")


@query(r"""WITH d AS (SELECT doc_id, text AS t, length(text) AS n, substring(text, 301, greatest(length(text) - 500, 0)) AS mid FROM documents WHERE length(text) > 500),
  l AS (SELECT doc_id, len(ls) - 1 AS last, p - 1 AS i, ls[p] AS x FROM (SELECT doc_id, string_split(mid, chr(10)) AS ls FROM d) s, unnest(range(1, len(ls) + 1)) u(p)),
  h AS (SELECT doc_id, i, greatest(i - 2, 0) AS s, least(i + 2, last) AS e FROM l WHERE regexp_matches(x, '""" + _SQL_SECURITY + r"""')),
  n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
  g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM n),
  r AS (SELECT doc_id, k, min(s) AS s, max(e) AS e FROM g GROUP BY ALL),
  f AS (SELECT r.doc_id, k, string_agg(x, chr(10) ORDER BY i) AS part FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY ALL),
  c AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS total FROM f),
  kept AS (SELECT doc_id, count(*) AS m, string_agg(part, chr(10) || '---' || chr(10) ORDER BY k) AS parts FROM c WHERE k = 1 OR (k <= 10 AND total <= 2000) GROUP BY ALL)
SELECT o.doc_id, md5(CASE WHEN d.n IS NULL THEN o.text WHEN m IS NULL THEN substring(t, 1, 300) || chr(10) || '... [truncated, ' || n || ' chars total, no security patterns found in middle] ...' || chr(10) || right(t, 200)
  ELSE substring(t, 1, 300) || chr(10) || '... [middle truncated, ' || n || ' chars total, extracted ' || m || ' security-relevant fragments] ...' || chr(10) || parts || chr(10) || '... [end of extracted fragments] ...' || chr(10) || right(t, 200) END) AS digest, coalesce(m, 0) AS fragments
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id LEFT JOIN kept ON kept.doc_id = o.doc_id""")
def q_excerpts(spark, sf):
    d = evidence.excerpted(table(spark, sf, "documents").select("doc_id", "text"), "text", "excerpt", 300, 200)
    n = F.regexp_extract("excerpt", r"chars total, extracted (\d+) security", 1)
    return d.select("doc_id", F.md5("excerpt").alias("digest"), F.when((n != "") & (F.length("text") > 500), n.cast("long")).otherwise(0).alias("fragments"))
