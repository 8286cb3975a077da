"""The registered queries of the ten operators, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, quality_classifier
from .decontaminate import report
from .jaccard_join import jaccard_classes
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import pack
from .quality_rules import judge
from .suffix_dedup import remove_repeats
from .token_count import count_tokens

#: Target proportions of the packed sources: the square root of their tokens, so that small sources aren't drowned.
MIXTURE = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), alpha=MIXTURE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "pages"), language_id.train(_table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).drop("rk")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents")).drop("rk", "class_key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("rk", "hit")


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_quality_rules that SQL can express."""
    return judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_packing, op4_line_dedup, op5_language_id, op6_quality_rules, op7_quality_classifier, op8_jaccard_join, op9_license_scan, op10_decontamination, llm_quality_base)}

#: The lines of a text, and their keys, in DuckDB.
_LINES = """
  lines AS (SELECT doc_id, p AS pos, ls[p] AS line, CAST(len(ls) AS BIGINT) AS n_lines
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t, unnest(range(1, len(ls) + 1)) u(p)),
  keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines)"""

ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_join": r"""WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM w),
  kind AS (SELECT s, min(doc_id) AS set_id, count(*) AS copies, len(s) AS n FROM s GROUP BY s),
  tok AS (SELECT set_id, n, copies, unnest(s) AS t FROM kind),
  pair AS (SELECT a.set_id AS a, b.set_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(b.copies) AS more, count(*) AS both_ FROM tok a JOIN tok b ON b.t = a.t AND b.set_id <> a.set_id GROUP BY a.set_id, b.set_id),
  link AS (SELECT a, b, more FROM pair WHERE both_ >= 0.8 * (na + nb - both_) - 1e-9),
  walk AS (SELECT set_id AS a, set_id AS b FROM kind UNION SELECT walk.a, link.b FROM walk JOIN link ON link.a = walk.b),
  class AS (SELECT a, min(b) AS class_id FROM walk GROUP BY a), deg AS (SELECT a, count(*) AS k, CAST(sum(more) AS BIGINT) AS docs FROM link GROUP BY a)
SELECT s.doc_id, c.class_id, k.set_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(d.docs, 0) + k.copies - 1 AS n_links, coalesce(d.k, 0) AS n_text_links
FROM s JOIN kind k ON k.s = s.s JOIN class c ON c.a = k.set_id LEFT JOIN deg d ON d.a = k.set_id""",
    "llm_quality_base": r"""WITH
  t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, y) AS k FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS y FROM t) WHERE regexp_matches(y, '[^\x20\x09-\x0D]')),
  dup AS (SELECT doc_id, count(*) AS n FROM l WHERE k > 1 GROUP BY doc_id),
  g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS win FROM t, unnest(range(1, len(w) - 1)) u(i)),
  again AS (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1),
  rep AS (SELECT g.doc_id, count(DISTINCT p) AS n FROM g JOIN again a ON a.doc_id = g.doc_id AND a.win = g.win, unnest([i, i + 1, i + 2]) v(p) GROUP BY g.doc_id)
SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN rep ON rep.doc_id = t.doc_id""",
    "op4_line_dedup": f"""WITH {_LINES},
  repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  marked AS (SELECT k.*, coalesce(k.doc_id < r.last, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, any_value(n_lines) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_decontamination": r"""WITH
  split AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
  worded AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
  wins AS (SELECT id AS item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
           FROM worded, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE kind = 'b' AND len(w) > 0),
  found AS (SELECT d.id AS doc_id, i, s.n, d.item_id FROM (SELECT DISTINCT n FROM wins) s,
              LATERAL (SELECT x.id, i, b.item_id FROM worded x, unnest(range(1, len(x.w) - s.n + 2)) u(i), wins b
                       WHERE x.kind = 'd' AND b.n = s.n AND b.win = array_to_string(x.w[i : i + s.n - 1], ' ')) d),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM worded w LEFT JOIN hit h ON h.doc_id = w.id LEFT JOIN items i ON i.doc_id = w.id WHERE w.kind = 'd'""",
}
