"""Each query of queries.py in DuckDB's SQL, written from the operators' definitions, not from their plans."""

from __future__ import annotations

from ..functions.content import SECURITY

EV = """ev AS (SELECT user_id // 5 AS pkg, CAST(row_number() OVER (PARTITION BY user_id // 5 ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id, user_id, event_type,
  CASE event_type WHEN 'click' THEN 'fs.readFile' WHEN 'view' THEN 'os.hostname' WHEN 'purchase' THEN 'https.request' WHEN 'signup' THEN 'child_process.exec' ELSE 'misc.noop' END AS qn,
  CASE WHEN user_id % 5 = 0 THEN 'package/src/f' || user_id || '.js' ELSE 'package/node_modules/p' || (user_id % 7) || '/f' || user_id || '.js' END AS file,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS line, props AS args FROM events)"""
CAT = """cat(qn, domain, behavior) AS (VALUES ('fs.readFile', 'File', 'File Reading'), ('os.hostname', 'Environment', 'Environment Information Retrieval'),
  ('https.request', 'Network', 'Data Transmission'), ('child_process.exec', 'Process', 'Command Execution'))"""
NULLED = f"{EV}, e AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN line END AS line) FROM ev)"
FUNCS = f"""{EV}, fn AS (SELECT *, file || ':' || sl || ':' || el AS fid FROM (
  SELECT DISTINCT pkg, file, line // 10 * 10 AS sl, line // 10 * 10 + 9 AS el FROM ev UNION ALL SELECT DISTINCT pkg, file, line // 50 * 50, line // 50 * 50 + 49 FROM ev))"""
CHAINS = f"""{EV}, chain AS (SELECT DISTINCT pkg, user_id % 7 AS chain FROM ev),
  root AS (SELECT pkg, chain, 'node_modules/p' || chain || '/' AS root FROM chain UNION ALL SELECT pkg, chain, 'node_modules/p' || (chain - 1) || '/' FROM chain WHERE chain % 2 = 1),
  anchor AS (SELECT pkg, user_id % 7 AS chain, idx FROM ev WHERE event_type = 'signup' AND line < 30 AND user_id % 7 % 3 <> 2),
  under AS (SELECT e.pkg, e.idx, e.event_id, r.chain, r.root FROM ev e JOIN root r ON r.pkg = e.pkg AND starts_with(e.file, 'package/' || r.root)),
  reg AS (SELECT c.pkg, c.chain, c.chain AS chain_ord, coalesce((SELECT min(idx) FROM anchor a WHERE a.pkg = c.pkg AND a.chain = c.chain), (SELECT min(idx) FROM under u WHERE u.pkg = c.pkg AND u.chain = c.chain)) AS reg FROM chain c)"""
_LABEL = "CASE WHEN event_type IN ('click', 'view') THEN 'DDG' WHEN event_type = 'purchase' THEN 'Object_Data' ELSE 'CFG' END"


ARCS = f"arc AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 4 + hour(ts) // 6 AS g, user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst, {_LABEL} AS label FROM events)"

SLICE = f"""RECURSIVE {ARCS}, data AS (SELECT DISTINCT g, src, dst FROM arc WHERE label <> 'CFG'), flagged AS (SELECT DISTINCT g, src AS v FROM arc WHERE src % 3 = 1),
  fwd AS (SELECT g, v FROM flagged UNION SELECT d.g, d.dst FROM fwd f JOIN data d ON d.g = f.g AND d.src = f.v),
  bwd AS (SELECT g, v FROM flagged UNION SELECT d.g, d.src FROM bwd f JOIN data d ON d.g = f.g AND d.dst = f.v),
  member AS (SELECT g, v FROM fwd UNION SELECT g, v FROM bwd),
  both_ways AS (SELECT g, src AS a, dst AS b FROM data UNION SELECT g, dst, src FROM data),
  link AS (SELECT x.* FROM both_ways x JOIN member m ON m.g = x.g AND m.v = x.a JOIN member n ON n.g = x.g AND n.v = x.b),
  pair AS (SELECT g, v, v AS w FROM member UNION SELECT p.g, p.v, l.b FROM pair p JOIN link l ON l.g = p.g AND l.a = p.w),
  comp AS (SELECT g, v, min(w) AS component FROM pair GROUP BY g, v)"""
JUDGED = """j AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'malicious' WHEN l.quality = 0 THEN 'undetermined' ELSE 'benign' END AS judgement
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SYNTHESIS = "CASE WHEN coalesce(bool_or(judgement = 'malicious'), false) THEN 'malicious' WHEN coalesce(bool_or(judgement = 'undetermined'), false) THEN 'undetermined' ELSE 'benign' END"
NODES = f"""{EV}, node AS (SELECT pkg, idx, CASE event_type WHEN 'purchase' THEN 'third_party' WHEN 'signup' THEN 'conditional' ELSE 'unresolved' END AS bucket FROM ev WHERE event_type IN ('purchase', 'signup', 'error'))"""

ORACLE_SQL: dict[str, str] = {
    "q_domain_rollup": f"""WITH {EV}, {CAT}, kept AS (SELECT DISTINCT e.pkg, e.file, e.line, e.qn, c.domain FROM ev e JOIN cat c ON c.qn = e.qn WHERE NOT starts_with(e.file, 'node')),
  d AS (SELECT pkg, domain, count(*) AS n, count(DISTINCT file) AS files FROM kept GROUP BY ALL),
  j AS (SELECT *, CASE WHEN domain = 'Process' AND n >= 40 THEN 'malicious' WHEN domain = 'Network' THEN 'undetermined' ELSE 'benign' END AS judgement FROM d)
SELECT pkg, CAST(sum(n) AS BIGINT) AS events, max(files) AS most_files, count(*) AS domains, {SYNTHESIS} AS verdict FROM j GROUP BY pkg""",
    "q_catalog_lookup": f"WITH {EV}, {CAT} SELECT e.qn, c.domain, c.behavior, count(*) AS n, c.domain IN ('Process', 'File', 'Network') AS resolved FROM ev e LEFT JOIN cat c ON c.qn = e.qn GROUP BY ALL",
    "q_last_wins_dedup": f"""WITH {NULLED}, k AS (SELECT *, row_number() OVER (PARTITION BY pkg, file, line, qn ORDER BY idx DESC) AS r FROM e)
SELECT pkg, event_id, CAST(row_number() OVER (PARTITION BY pkg ORDER BY idx) - 1 AS BIGINT) AS log_index FROM k WHERE r = 1 OR line IS NULL""",
    "q_callback_backfill": f"""WITH {EV}, cb AS (SELECT pkg, args, arg_max('r' || event_id, idx) AS result FROM ev WHERE event_type = 'error' GROUP BY ALL),
  c AS (SELECT *, row_number() OVER (PARTITION BY pkg, args ORDER BY idx DESC) AS r FROM ev WHERE event_type <> 'error')
SELECT c.pkg, c.idx, CASE WHEN c.r = 1 THEN cb.result END AS result FROM c LEFT JOIN cb ON cb.pkg = c.pkg AND cb.args = c.args""",
    "q_call_to_source_asof": """WITH t AS (SELECT conv_id, turn, role, md5(text) AS text, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call FROM conversations)
SELECT conv_id, turn, call, text AS source FROM t WHERE role <> 'user' AND call IS NOT NULL""",
    "q_eval_args": f"""WITH {EV}, f AS (SELECT pkg, args, min(idx) AS p, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY ALL)
SELECT pkg, CAST(sum(n) AS BIGINT) AS n, string_agg(args, '|' ORDER BY p) AS args FROM f GROUP BY pkg""",
    "q_range_contains": f"WITH {FUNCS} SELECT f.pkg, f.fid, count(*) AS n, min(e.idx) AS first_idx FROM fn f JOIN ev e ON e.pkg = f.pkg AND e.file = f.file AND e.line BETWEEN f.sl AND f.el GROUP BY ALL",
    "q_exact_span": f"""WITH {NULLED} SELECT a.event_id, a.file, a.line, (SELECT min(b.idx) FROM e b WHERE b.event_type IN ('click', 'view') AND b.file IS NOT DISTINCT FROM a.file AND b.line IS NOT DISTINCT FROM a.line) AS idx FROM e a""",
    "q_exact_else_contain": f"""WITH {FUNCS}, ref AS (SELECT event_id, pkg, file, line // 10 * 10 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS s, line // 10 * 10 + 9 AS t FROM ev),
  k AS (SELECT r.event_id, f.fid, f.sl = r.s AND f.el = r.t AS exact, row_number() OVER (PARTITION BY r.event_id ORDER BY CASE WHEN f.sl = r.s AND f.el = r.t THEN 0 ELSE 1 END, f.fid) AS k
        FROM ref r JOIN fn f ON f.pkg = r.pkg AND f.file = r.file AND f.sl <= r.s AND f.el >= r.t)
SELECT event_id, fid, exact FROM k WHERE k = 1""",
    "q_smallest_end": """SELECT l_orderkey, coalesce(min(l_quantity) FILTER (WHERE l_quantity >= l_orderkey % 50), max(l_quantity)) AS "end" FROM lineitem GROUP BY l_orderkey""",
    "q_module_root": f"""WITH {EV}, f AS (SELECT DISTINCT file FROM ev), n AS (SELECT file || '/node_modules/@s/q/i.js' AS file FROM f UNION ALL SELECT file FROM f UNION ALL SELECT './' || file FROM f),
  p AS (SELECT file, regexp_replace(regexp_replace(file, '^\\./', ''), '^package/', '') AS path FROM n),
  r AS (SELECT *, CASE WHEN contains(path, '@s/q/') THEN regexp_extract(path, '^(.*node_modules/@s/q/)', 1) WHEN starts_with(path, 'node_modules/') THEN regexp_extract(path, '^(node_modules/[^/]+/)', 1) END AS root FROM p)
SELECT file, root, CAST((length(root) - length(replace(root, 'node_modules/', ''))) / 13 AS BIGINT) AS depth, CASE WHEN root IS NULL THEN NULL WHEN contains(root, '@s/q') THEN '@s/q' ELSE split_part(root, '/', 2) END AS package,
  CASE WHEN NOT contains('/' || path, '/node_modules/') THEN '' END AS own, path, starts_with(path, 'node_modules/p1/') OR contains(path, '/node_modules/p1/') AS under_p1 FROM r""",
    "q_prefix_candidates": f"""WITH {CHAINS}, c AS (SELECT pkg, idx, chain, CAST(1 AS BIGINT) AS depth FROM under GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY pkg, idx) AS tops FROM c""",
    "q_scoped_asof": """SELECT r.o_orderkey AS ref, max(b.o_orderkey) AS seq FROM orders r LEFT JOIN orders b ON b.o_custkey = r.o_custkey AND b.o_orderdate <= r.o_orderdate GROUP BY r.o_orderkey""",
    "q_registrations": f"WITH {CHAINS} SELECT pkg, chain, chain_ord, reg FROM reg",
    "q_claim_window": f"""WITH {CHAINS}, o AS (SELECT pkg, idx, (SELECT max(reg) FROM reg r WHERE r.pkg = e.pkg AND r.reg <= e.idx) AS reg FROM ev e)
SELECT o.pkg, o.idx, r.chain, r.reg FROM o JOIN reg r ON r.pkg = o.pkg AND r.reg = o.reg""",
    "q_nearest_anchor": f"""WITH {CHAINS}, d AS (SELECT e.pkg, e.idx, a.chain, min(abs(a.idx - e.idx)) AS distance, CAST(CASE WHEN bool_or(a.idx <= e.idx) THEN 0 ELSE 1 END AS BIGINT) AS later FROM ev e JOIN anchor a ON a.pkg = e.pkg GROUP BY ALL),
  k AS (SELECT *, rank() OVER (PARTITION BY pkg, idx ORDER BY distance, later) AS k FROM d)
SELECT pkg, idx, chain, distance, later, count(*) OVER (PARTITION BY pkg, idx) AS winners FROM k WHERE k = 1""",
    "q_orphans_anti": f"WITH {NULLED} SELECT a.event_id, a.file, a.line FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND b.file IS NOT DISTINCT FROM a.file AND b.line IS NOT DISTINCT FROM a.line)",
    "q_gap_islands": f"""WITH {EV}, m AS (SELECT pkg, idx, idx - row_number() OVER (PARTITION BY pkg ORDER BY idx) AS grp FROM ev WHERE event_type NOT IN ('click', 'view')),
  r AS (SELECT pkg, grp, min(idx) AS first, max(idx) AS last FROM m GROUP BY ALL)
SELECT r.pkg, r.first, r.last, (SELECT max(idx) FROM ev e WHERE e.pkg = r.pkg AND e.event_type IN ('click', 'view') AND e.idx < r.first) AS before, (SELECT min(idx) FROM ev e WHERE e.pkg = r.pkg AND e.event_type IN ('click', 'view') AND e.idx > r.last) AS after FROM r""",
    "q_adjacency_islands": f"""WITH {CHAINS}, o AS (SELECT pkg, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY pkg ORDER BY idx) <= 5 THEN 0 ELSE 1 END AS new FROM ev WHERE event_type = 'error'),
  i AS (SELECT pkg, idx, sum(new) OVER (PARTITION BY pkg ORDER BY idx) AS island FROM o),
  own AS (SELECT i.pkg, i.island, min(a.chain) AS chain_ord FROM i JOIN anchor a ON a.pkg = i.pkg AND abs(a.idx - i.idx) <= 5 GROUP BY ALL)
SELECT i.pkg, i.idx, own.chain_ord FROM i JOIN own ON own.pkg = i.pkg AND own.island = i.island""",
    "q_attribution": f"""WITH {CHAINS}, orph AS (SELECT * FROM ev e WHERE event_type NOT IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM anchor a WHERE a.pkg = e.pkg AND a.idx = e.idx)),
  top AS (SELECT u.pkg, u.idx, u.chain, count(*) OVER (PARTITION BY u.pkg, u.idx) AS tops FROM (SELECT DISTINCT pkg, idx, chain FROM under) u JOIN orph o ON o.pkg = u.pkg AND o.idx = u.idx),
  rest AS (SELECT pkg, idx FROM orph o WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.pkg = o.pkg AND t.idx = o.idx)),
  isl AS (SELECT pkg, idx, sum(new) OVER (PARTITION BY pkg ORDER BY idx) AS island FROM (SELECT pkg, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY pkg ORDER BY idx) <= 5 THEN 0 ELSE 1 END AS new FROM rest)),
  own AS (SELECT i.pkg, i.island, min(a.chain) AS chain FROM isl i JOIN anchor a ON a.pkg = i.pkg AND abs(a.idx - i.idx) <= 5 GROUP BY ALL),
  adj AS (SELECT i.pkg, i.idx, own.chain FROM isl i JOIN own ON own.pkg = i.pkg AND own.island = i.island),
  rest2 AS (SELECT pkg, idx FROM rest r WHERE NOT EXISTS (SELECT 1 FROM adj a WHERE a.pkg = r.pkg AND a.idx = r.idx)),
  win AS (SELECT x.pkg, x.idx, r.chain FROM (SELECT pkg, idx, (SELECT max(reg) FROM reg r WHERE r.pkg = q.pkg AND r.reg <= q.idx) AS reg FROM rest2 q) x JOIN reg r ON r.pkg = x.pkg AND r.reg = x.reg),
  pend AS (SELECT pkg, idx, chain, 'module_root' AS alone FROM top WHERE tops > 1 UNION ALL SELECT pkg, idx, chain, 'registration_adjacency' FROM win),
  point AS (SELECT pkg, chain, idx AS p FROM anchor UNION SELECT pkg, chain, reg FROM reg WHERE reg IS NOT NULL),
  dist AS (SELECT n.pkg, n.idx, n.chain, n.alone, min(abs(p.p - n.idx)) AS d, min(CASE WHEN p.p <= n.idx THEN 0 ELSE 1 END) AS l FROM pend n JOIN point p ON p.pkg = n.pkg AND p.chain = n.chain GROUP BY ALL),
  won AS (SELECT *, count(*) OVER (PARTITION BY pkg, idx) AS winners FROM (SELECT *, rank() OVER (PARTITION BY pkg, idx ORDER BY d, l) AS k FROM dist) WHERE k = 1),
  bare AS (SELECT pkg, chain, reg, count(*) OVER (PARTITION BY pkg, reg) AS n FROM reg r WHERE reg IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anchor a WHERE a.pkg = r.pkg AND a.chain = r.chain)),
  every AS (SELECT pkg, chain, idx, 'bfs' AS confidence, 1 AS rank FROM anchor UNION ALL SELECT pkg, chain, idx, 'module_root', 2 FROM top WHERE tops = 1 UNION ALL SELECT pkg, chain, idx, 'adjacency', 2 FROM adj
    UNION ALL SELECT pkg, chain, idx, CASE WHEN winners = 1 THEN alone ELSE 'shared' END, 2 FROM won UNION ALL SELECT pkg, chain, reg, CASE WHEN n = 1 THEN 'registration_adjacency' ELSE 'shared' END, 3 FROM bare)
SELECT pkg, chain, idx, arg_min(confidence, rank) AS confidence FROM every GROUP BY ALL""",
    "q_fingerprint_groups": f"""WITH {EV}, f AS (SELECT pkg, user_id, line, sha256(string_agg(qn, chr(30) ORDER BY idx)) AS fingerprint, count(*) AS n FROM ev GROUP BY ALL)
SELECT fingerprint, count(*) AS chains, max(n) AS length, min(user_id) AS first_user FROM f GROUP BY fingerprint""",
    "q_reach_forward": f"""WITH RECURSIVE {ARCS}, data AS (SELECT DISTINCT g, src, dst FROM arc WHERE label <> 'CFG'),
  walk AS (SELECT DISTINCT g, src AS v, CAST(0 AS BIGINT) AS depth FROM arc WHERE label = 'Object_Data' UNION SELECT d.g, d.dst, w.depth + 1 FROM walk w JOIN data d ON d.g = w.g AND d.src = w.v WHERE w.depth < 40)
SELECT g, v, min(depth) AS depth FROM walk GROUP BY ALL""",
    "q_reach_backward_barrier": f"""WITH RECURSIVE {ARCS}, data AS (SELECT DISTINCT g, src, dst FROM arc WHERE label <> 'CFG'), bar AS (SELECT DISTINCT src AS v FROM data WHERE src % 10 = 7),
  walk AS (SELECT g, dst AS v FROM arc WHERE label = 'Object_Data' AND dst NOT IN (SELECT v FROM bar) UNION SELECT d.g, d.src FROM walk w JOIN data d ON d.g = w.g AND d.dst = w.v WHERE d.src NOT IN (SELECT v FROM bar))
SELECT DISTINCT g, v FROM walk""",
    "q_components": f"WITH {SLICE} SELECT g, v, component FROM comp",
    "q_component_order": f"""WITH {SLICE}, rep AS (SELECT c.g, c.component, arg_min(c.v, (CASE WHEN f.v IS NULL THEN 1 ELSE 0 END) * 1000000000000 + (c.v % 37) * 1000000000 + c.v) AS v FROM comp c LEFT JOIN flagged f ON f.g = c.g AND f.v = c.v GROUP BY ALL),
  cfg AS (SELECT DISTINCT g, src, dst FROM arc WHERE label = 'CFG'),
  walk AS (SELECT g, component, v FROM rep UNION SELECT w.g, w.component, c.dst FROM walk w JOIN cfg c ON c.g = w.g AND c.src = w.v),
  suc AS (SELECT w.g, w.component, array_to_string(list_sort(list(DISTINCT r.component)), ',') AS successors FROM walk w JOIN rep r ON r.g = w.g AND r.v = w.v WHERE r.component <> w.component GROUP BY ALL)
SELECT r.g, r.component, r.v, r.v % 37 AS cfg_order, coalesce(s.successors, '') AS successors FROM rep r LEFT JOIN suc s ON s.g = r.g AND s.component = r.component""",
    "q_nearest_flagged": f"""WITH RECURSIVE {ARCS}, a AS (SELECT DISTINCT g, src, dst FROM arc), fl AS (SELECT DISTINCT g, dst AS v FROM arc WHERE dst % 5 = 1),
  walk AS (SELECT DISTINCT g, src AS origin, src AS v, true AS go FROM arc
    UNION SELECT w.g, w.origin, a.dst, NOT EXISTS (SELECT 1 FROM fl WHERE fl.g = a.g AND fl.v = a.dst) AND a.dst <> w.origin FROM walk w JOIN a ON a.g = w.g AND a.src = w.v WHERE w.go)
SELECT DISTINCT w.g, w.origin, w.v FROM walk w JOIN fl ON fl.g = w.g AND fl.v = w.v WHERE w.v <> w.origin""",
    "q_common_ancestor": f"""WITH RECURSIVE {ARCS}, ends AS (SELECT DISTINCT g, dst AS v FROM arc), pair AS (SELECT * FROM (SELECT g, v AS a, lead(v) OVER (PARTITION BY g ORDER BY v) AS b FROM ends) WHERE b IS NOT NULL),
  up AS (SELECT g, v AS origin, v FROM ends UNION SELECT u.g, u.origin, a.src FROM up u JOIN arc a ON a.g = u.g AND a.dst = u.v)
SELECT p.g, p.a, p.b, EXISTS (SELECT 1 FROM up x JOIN up y ON y.g = x.g AND y.v = x.v WHERE x.g = p.g AND x.origin = p.a AND y.origin = p.b) AS common FROM pair p""",
    "q_dep_closure": f"""WITH RECURSIVE {ARCS}, d AS (SELECT DISTINCT g, src, dst FROM arc),
  walk AS (SELECT g, v AS pkg, v AS dep FROM (SELECT g, src AS v FROM d UNION SELECT g, dst FROM d) UNION SELECT w.g, w.pkg, d.dst FROM walk w JOIN d ON d.g = w.g AND d.src = w.dep) SELECT DISTINCT g, pkg, dep FROM walk""",
    "q_edge_type": """WITH e AS (SELECT user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS dst, bool_or(event_type IN ('view')) AS cfg, bool_or(event_type = 'click') AS ddg, bool_or(event_type = 'error') AS rem FROM events GROUP BY ALL)
SELECT src, dst, 'CFG' AS label FROM e WHERE cfg OR (NOT ddg AND NOT rem) UNION ALL SELECT src, dst, 'DDG' FROM e WHERE ddg""",
    "q_classify_buckets": f"WITH {NODES} SELECT pkg, count(*) FILTER (WHERE bucket = 'third_party') AS third_party, count(*) FILTER (WHERE bucket = 'conditional') AS conditional, count(*) FILTER (WHERE bucket = 'unresolved') AS unresolved FROM node GROUP BY pkg",
    "q_router_topk": f"""WITH {NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY CASE bucket WHEN 'third_party' THEN 1 WHEN 'conditional' THEN 2 ELSE 3 END, idx) AS k FROM node),
  c AS (SELECT *, CAST(count(*) FILTER (WHERE k > 10) OVER (PARTITION BY pkg, bucket) AS BIGINT) AS cut FROM k) SELECT pkg, idx, bucket, k, cut FROM c WHERE k <= 10""",
    "q_verdict_entry": f"WITH {JUDGED} SELECT source, lang, {SYNTHESIS} AS verdict, count(judgement) AS n FROM j GROUP BY ALL",
    "q_verdict_package": f"""WITH {JUDGED}, s AS (SELECT source, CAST(max(CASE WHEN judgement = 'malicious' THEN 2 WHEN judgement = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS severity FROM j GROUP BY source)
SELECT source, severity, severity = 2 AS malicious, CASE WHEN severity = 2 THEN 'Malicious Code' ELSE 'Benign' END AS status FROM s""",
    "q_status_counts": f"WITH {JUDGED} SELECT lang, coalesce(judgement, 'unknown') AS status, count(*) AS n FROM j GROUP BY ALL",
    "q_latest_step": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(md5(text), turn) AS finding FROM conversations GROUP BY conv_id",
    "q_sanitize_report": f"""WITH {EV}, e AS (SELECT * FROM ev), r AS (SELECT pkg, user_id, CASE WHEN min(event_id) % 2 = 0 THEN 'undetermined' ELSE 'malicious' END AS judgement FROM e GROUP BY ALL),
  gone AS (SELECT DISTINCT user_id, line FROM e WHERE event_type <> 'purchase'), left_ AS (SELECT DISTINCT e.user_id, e.line FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = e.user_id AND g.line = e.line)),
  l AS (SELECT user_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS ids FROM left_ GROUP BY user_id)
SELECT r.pkg, r.user_id, CASE WHEN r.judgement = 'undetermined' AND l.ids IS NULL THEN 'benign' ELSE r.judgement END AS judgement, coalesce(l.ids, '') AS ids FROM r LEFT JOIN l ON l.user_id = r.user_id""",
    "q_reconcile": """WITH l AS (SELECT conv_id, max_by(role, turn) AS role, length(max_by(text, turn)) AS n FROM conversations WHERE turn > 0 GROUP BY conv_id)
SELECT coalesce(f.conv_id, l.conv_id) AS conv_id, coalesce(CASE WHEN l.n % 2 = 0 THEN l.role END, f.role) AS role, coalesce(l.n, length(f.text)) AS chars FROM (SELECT * FROM conversations WHERE turn = 0) f FULL JOIN l ON l.conv_id = f.conv_id""",
    "q_text_type": r"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages UNION ALL SELECT 'e', event_id, props FROM events
    UNION ALL SELECT 's', event_id, CASE event_id % 7 WHEN 0 THEN '#!/usr/bin/env -S node' || chr(10) || 'x' WHEN 1 THEN ' #!/bin/dash' WHEN 2 THEN 'x' || chr(10) || ' for a in b' WHEN 3 THEN 'const a' || event_id || ' = 1' WHEN 4 THEN '<?XML ?>' WHEN 5 THEN '{"a": ' WHEN 6 THEN '#! python' END FROM events),
  u AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, substring(text, 1, 1000) AS head, substring(text, 1, 1024) AS h FROM t),
  v AS (SELECT *, lower(regexp_extract(x, '^#!\s*(?:/usr/(?:local/)?bin/env\s+(?:-\S+\s+)*|/(?:usr/(?:local/)?)?bin/)(\w+)', 1)) AS i FROM u)
SELECT kind, id, CASE WHEN i IN ('bash', 'sh', 'zsh', 'dash', 'fish') THEN 'shell' WHEN i IN ('node', 'nodejs') THEN 'javascript' WHEN i IN ('python', 'python3') THEN 'python' WHEN regexp_matches(x, '^[\[{]') AND try_cast(x AS JSON) IS NOT NULL THEN 'json'
  WHEN regexp_matches(x, '(?i)^(?:<!doctype\s|<html[\s>])') THEN 'html' WHEN regexp_matches(x, '(?i)^<\?xml\b') THEN 'xml'
  WHEN regexp_matches(head, '\brequire\s*\(|\bmodule\.exports\b|\bexport\s+(?:default|function|class|const|let|var)\b|\bimport\s+.+?\bfrom\s+[''"]|\b(?:const|let|var)\s+\w+\s*=|\bfunction\s+\w+\s*\(|=>\s*[{(]') THEN 'javascript'
  WHEN regexp_matches(head, '(?m)^\s*(?:if\s+\[|for\s+\w+\s+in\b|while\s+\[|case\s+\S+\s+in\b)|^\s*\w+=\S|^\s*(?:echo|export|source|alias|eval)\s+') THEN 'shell' ELSE 'plain_text' END AS type,
  CASE WHEN contains(h, chr(0)) OR length(regexp_replace(h, '[\x00-\x7F]', '', 'g')) > 0.3 * length(h) THEN 'binary' WHEN length(text) <= 5000 THEN 'inline' ELSE 'large_text' END AS tier FROM v""",
    "q_security_snippets": r"""WITH l AS (SELECT doc_id, len(ls) - 1 AS last, p - 1 AS line, ls[p] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) u(p)),
  h AS (SELECT doc_id, greatest(line - 2, 0) AS s, least(line + 2, last) AS e FROM l WHERE regexp_matches(x, '""" + SECURITY.replace("'", "''") + r"""')),
  n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
  i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT doc_id, min(s) AS first, max(e) AS last, count(*) AS hits FROM i GROUP BY doc_id, k""",
    "q_url_fields": r"""SELECT page_id, nullif(regexp_extract(url, '^(https?)://', 1), '') AS protocol, nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://[^/:?#]+:([0-9]+)', 1), '') AS port,
  coalesce(nullif(regexp_extract(url, '^https?://[^/:?#]+(?::[0-9]+)?(/[^?#]*)', 1), ''), '/') AS path, regexp_replace(url, '[\\/:*?"<>|]', '-', 'g') AS entry FROM pages""",
    "q_node_scripts": f"WITH {EV} SELECT event_id, './f' || user_id || '.js g' || line || '.mjs' AS scripts FROM ev",
    "q_node_id_index": f"""WITH {EV}, x AS (SELECT pkg, idx, line AS node FROM ev UNION ALL SELECT pkg, idx, user_id FROM ev) SELECT pkg, node, max(idx) AS component FROM x GROUP BY ALL""",
    "q_enrichment_levels": """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'trusted' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN 'api' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity <= 1) THEN 'module' ELSE 'none' END AS level FROM part)
SELECT p_brand, level, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY ALL""",
    "q_trust_rules": """WITH m AS (SELECT o_custkey, count(*) AS v, max(o_orderdate) AS last FROM orders GROUP BY ALL)
SELECT c_custkey, CASE WHEN coalesce(v, 0) = 0 THEN 'no_release' WHEN NOT coalesce(last > TIMESTAMP '1998-08-02' - INTERVAL 360 DAYS, false) THEN 'stale' WHEN c_acctbal > 9000 THEN 'trusted' WHEN v < 3 THEN 'few_versions' ELSE 'ask' END AS rule FROM customer LEFT JOIN m ON o_custkey = c_custkey""",
    "q_interval_nesting": """WITH r AS (SELECT l_orderkey, l_linenumber, min(CAST(floor(l_quantity) AS BIGINT)) AS lo, max(CAST(floor(l_quantity + floor(l_extendedprice / 2000)) AS BIGINT)) AS hi FROM lineitem GROUP BY ALL),
  k AS (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS parent, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY b.hi - b.lo, b.l_linenumber) AS k FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.lo <= a.lo AND b.hi >= a.hi AND (b.lo < a.lo OR b.hi > a.hi))
SELECT r.*, k.parent FROM r LEFT JOIN k ON k.l_orderkey = r.l_orderkey AND k.l_linenumber = r.l_linenumber AND k.k = 1""",
    "q_positional_params": """SELECT p.l_orderkey, p.l_linenumber, 'p' || p.l_suppkey AS name, a.l_partkey AS value FROM lineitem p LEFT JOIN lineitem a ON a.l_orderkey = p.l_orderkey AND a.l_linenumber = p.l_linenumber""",
    "q_listing_semi": f"""WITH {EV}, fe AS (SELECT event_type, file || '#' || line AS file FROM ev), l AS (SELECT DISTINCT file FROM fe WHERE event_type IN ('click', 'view'))
SELECT DISTINCT file, 'dynamic_only' AS kind FROM fe WHERE event_type NOT IN ('click', 'view') AND file NOT IN (SELECT file FROM l) UNION ALL SELECT DISTINCT file, 'listed' FROM fe WHERE event_type = 'purchase' AND file IN (SELECT file FROM l)""",
    "q_entry_union": f"""WITH {EV}, f AS (SELECT DISTINCT user_id, event_type, replace(file, 'package/', '') AS entry FROM ev)
SELECT DISTINCT entry FROM f WHERE event_type = 'view' UNION SELECT 'src/f' || user_id || '.js' FROM f WHERE event_type = 'click' AND user_id % 5 = 0""",
    "q_annotation_text": f"""WITH {EV}, {CAT} SELECT e.event_id, CASE WHEN e.event_type = 'purchase' THEN 'third-party call ' || e.qn WHEN e.event_type = 'error' THEN 'unresolved call ' || e.qn ELSE e.qn || ': ' || c.behavior END || ' [Node ID: ' || e.event_id || ']' AS text
FROM ev e LEFT JOIN cat c ON c.qn = e.qn""",
    "q_end_position": """WITH d AS (SELECT doc_id, text, string_split(replace(text, chr(13), chr(10)), chr(10)) AS ls FROM documents) SELECT doc_id, doc_id % 100 + len(ls) - 1 AS line, CASE WHEN len(ls) = 1 THEN doc_id % 7 + length(text) ELSE length(ls[len(ls)]) END AS col FROM d""",
    "q_base_package": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '@' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/m' || p_partkey WHEN 1 THEN 'node:fs' WHEN 2 THEN '.' ELSE 'm' || p_partkey END AS base, p_partkey % 4 = 1 AS core, p_partkey % 4 IN (0, 3) AS third_party FROM part""",
    "q_model_stub": r"""WITH d AS (SELECT doc_id, text AS p FROM documents)
SELECT doc_id, CASE WHEN contains(lower(p), 'password') OR contains(lower(p), 'secret') THEN 'malicious' WHEN contains(lower(p), 'http') THEN 'undetermined' ELSE 'benign' END AS judgement, CAST(len(regexp_extract_all(p, '\S+')) AS BIGINT) AS words FROM d""",
    "q_interpreted_calls": f"""WITH {EV}, l AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY pkg, line ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM ev),
  c AS (SELECT l.pkg, l.event_id AS node, l.source, l.user_id % 2 = 0 AS literal, s.event_type AS bt,
    CASE s.event_type WHEN 'click' THEN 'fs' WHEN 'signup' THEN 'child_process' WHEN 'purchase' THEN 'p' || (s.user_id % 7) WHEN 'error' THEN '*' ELSE 'v' || l.line END || '.exec' AS qn
    FROM l LEFT JOIN ev s ON s.event_id = l.source WHERE l.event_type = 'view')
SELECT pkg, node, qn, CASE bt WHEN 'purchase' THEN 'third_party' WHEN 'error' THEN 'unresolved' ELSE 'external' END AS state, literal,
  CASE WHEN bt = 'purchase' THEN 'third_party' WHEN bt = 'error' THEN 'unresolved' WHEN bt = 'signup' AND literal THEN 'sensitive' WHEN bt = 'signup' THEN 'conditional' END AS kind, source FROM c""",
    "q_call_arguments": """WITH e AS (SELECT event_id, event_type, user_id AS u, regexp_extract(props, '([0-9]+)', 1) AS line FROM events)
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'node f' || u || '.js ' || CASE WHEN u % 2 = 1 THEN line ELSE '-k' END END AS command,
  CASE WHEN event_type = 'click' THEN '/p' || u END AS path, CASE WHEN event_type = 'click' THEN 'hé' END AS data,
  CASE event_type WHEN 'purchase' THEN CASE WHEN u % 2 = 1 THEN '{"url":"https://h' || u || '/"}' ELSE '{"hostname":"h' || u || '","port":"' || line || '"}' END
    WHEN 'view' THEN '[' || line || ',"h' || u || '"]' WHEN 'error' THEN 'h' || u END AS endpoint FROM e""",
    "q_rendered_slices": """WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-Z]')), lambda x: x || ' // ' || regexp_extract(x, '^[A-Za-z]+')) AS ls FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, array_to_string(ls, chr(10)) AS slice FROM l) SELECT d.doc_id, length(s.slice) AS chars, md5(s.slice) AS digest FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
}
