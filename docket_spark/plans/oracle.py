"""SQL (DuckDB dialect) that gives the rows of the registered queries."""

from __future__ import annotations

from . import trials

EVENTS = "ev AS (SELECT o_custkey, o_orderpriority, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _prior(keys: list[str], events: str, queries: str, out: str) -> str:
    """Prior rate and count over CTEs ev(keys, d, y) and q(o_orderkey, keys, d)."""
    k = ", ".join(keys)
    on = " AND ".join(f"q.{x} = c.{x}" for x in keys)
    return f"""
WITH {events}, {queries},
g AS (SELECT {k}, d, count(*) AS n, sum(y) AS s FROM ev WHERE d IS NOT NULL GROUP BY {k}, d),
c AS (SELECT {k}, d, sum(n) OVER w AS n, sum(s) OVER w AS s FROM g WINDOW w AS (PARTITION BY {k} ORDER BY d)),
a0 AS (SELECT d, count(*) AS n, sum(y) AS s FROM ev WHERE d IS NOT NULL GROUP BY d),
a AS (SELECT d, sum(n) OVER (ORDER BY d) AS n, sum(s) OVER (ORDER BY d) AS s FROM a0),
m AS (SELECT avg(y) AS mean FROM ev WHERE d IS NOT NULL)
SELECT q.o_orderkey, round(CAST(coalesce(c.s / c.n, a.s / a.n, m.mean) AS DOUBLE), 6) AS {out}rate, CAST(coalesce(c.n, 0) AS BIGINT) AS {out}n
FROM q ASOF LEFT JOIN c ON {on} AND q.d > c.d ASOF LEFT JOIN a ON q.d > a.d CROSS JOIN m"""


Q = "q AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders)"
WEAK_EVENTS = EVENTS.replace("o_orderpriority, CAST", "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '-' END AS o_orderpriority, CAST")
WEAK_Q = Q.replace("o_orderpriority, CAST", "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '-' END AS o_orderpriority, CAST")
FREQUENCY = """(SELECT q.o_orderkey, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM
  (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) q ASOF LEFT JOIN
  (SELECT o_custkey, d, sum(n) OVER (PARTITION BY o_custkey ORDER BY d) AS n FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL)) c
  ON q.o_custkey = c.o_custkey AND q.d > c.d)"""
ROLLING_EVENTS = "ev AS (SELECT o_custkey, o_orderpriority, r.d, r.y FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS d, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1) r ON o_orderkey = l_orderkey)"
FULL_FRAME = "frame AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, c_mktsegment, c_nationkey, CAST(o_orderdate AS DATE) AS day, r.d, r.y FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS d, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1) r ON o_orderkey = l_orderkey)"


def _full(rates: list[list[str]], frequencies: list[str]) -> str:
    """All keys by joins of each order with the grain of what was resolved, or asked, before its day."""
    part = lambda k: f"(SELECT f.o_orderkey, sum(g.n) AS n, sum(g.s) AS s FROM frame f JOIN (SELECT {', '.join(k)}, d, count(*) AS n, sum(y) AS s FROM frame WHERE d IS NOT NULL GROUP BY ALL) g ON {' AND '.join(f'f.{x} = g.{x}' for x in k)} AND g.d < f.day GROUP BY 1)"
    asked = lambda k: f"(SELECT f.o_orderkey, sum(g.n) AS n FROM frame f JOIN (SELECT {k}, day, count(*) AS n FROM frame GROUP BY ALL) g ON f.{k} = g.{k} AND g.day < f.day GROUP BY 1)"
    names = ["_".join(k) for k in rates]
    columns = [f"round(CAST(coalesce(r{i}.s / r{i}.n, a.s / a.n, m.mean) AS DOUBLE), 6) AS {k}_rate, CAST(coalesce(r{i}.n, 0) AS BIGINT) AS {k}_n" for i, k in enumerate(names)]
    columns += [f"CAST(coalesce(q{i}.n, 0) AS BIGINT) AS {k}_frequency" for i, k in enumerate(frequencies)]
    joined = " ".join([*(f"LEFT JOIN {part(k)} r{i} USING (o_orderkey)" for i, k in enumerate(rates)), *(f"LEFT JOIN {asked(k)} q{i} USING (o_orderkey)" for i, k in enumerate(frequencies))])
    return f"""WITH {FULL_FRAME}, g0 AS (SELECT d, count(*) AS n, sum(y) AS s FROM frame WHERE d IS NOT NULL GROUP BY d),
a AS (SELECT days.day, sum(g0.n) AS n, sum(g0.s) AS s FROM (SELECT DISTINCT day FROM frame) days JOIN g0 ON g0.d < days.day GROUP BY 1),
m AS (SELECT avg(y) AS mean FROM frame WHERE d IS NOT NULL)
SELECT frame.o_orderkey, {', '.join(columns)} FROM frame {joined} LEFT JOIN a ON frame.day = a.day CROSS JOIN m"""


SCORED = "s AS (SELECT quality AS y, floor(n_chars / 50) * 50 / (floor(n_chars / 50) * 50 + 2000.0) AS p FROM labels JOIN documents USING (doc_id)), h AS (SELECT y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS z FROM s)"
GRAIN = "g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM s GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g)"
CELLS = "n AS (SELECT CAST(count(*) FILTER (y = 0 AND z = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (y = 0 AND z = 1) AS DOUBLE) AS b, CAST(count(*) FILTER (y = 1 AND z = 0) AS DOUBLE) AS c, CAST(count(*) FILTER (y = 1 AND z = 1) AS DOUBLE) AS d FROM h)"
PR = "pr AS (SELECT *, coalesce(a / nullif(a + c, 0), 0) AS p0, coalesce(a / nullif(a + b, 0), 0) AS r0, coalesce(d / nullif(b + d, 0), 0) AS p1, coalesce(d / nullif(c + d, 0), 0) AS r1, a + b AS s0, c + d AS s1, a + b + c + d AS total FROM n), f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM pr)"
ERA = "CASE WHEN d >= DATE '2000-06-30' THEN 'fifth' WHEN d >= DATE '1999-01-01' THEN 'fourth' WHEN d >= DATE '1997-07-15' THEN 'third' WHEN d >= DATE '1996-03-01' THEN 'second' WHEN d >= DATE '1900-01-01' THEN 'first' END"
HEAD_VERDICT = "CASE WHEN regexp_matches({0}, '(?i)the') THEN 1 WHEN regexp_matches({0}, '(?i)die') THEN 0 END"

SQL = {
    "prior_rate_single": _prior(["o_custkey"], EVENTS, Q, ""),
    "prior_rate_pair": _prior(["o_custkey", "o_orderpriority"], WEAK_EVENTS, WEAK_Q, ""),
    "prior_frequency": f"SELECT * FROM {FREQUENCY}",
    "rolling_all": f"SELECT x.*, y.priority_rate, y.priority_n, z.n AS frequency FROM ({_prior(['o_custkey'], ROLLING_EVENTS, Q, 'customer_')}) x JOIN ({_prior(['o_orderpriority'], ROLLING_EVENTS, Q, 'priority_')}) y USING (o_orderkey) JOIN {FREQUENCY} z USING (o_orderkey)",
    "rolling_full": _full([["o_custkey"], ["o_orderpriority"], ["o_orderstatus"], ["c_mktsegment"], ["c_nationkey", "o_orderpriority"], ["c_mktsegment", "o_orderstatus"]], ["o_custkey", "c_nationkey"]),
    "unmatched_parts": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "contract_rows": """WITH r AS (SELECT CAST(doc_id AS BIGINT) AS trial, CASE WHEN doc_id % 5 > 0 THEN lang END AS kind, CASE WHEN doc_id % 7 > 0 THEN CAST(n_chars AS BIGINT) END AS length, source AS origin, CAST(NULL AS VARCHAR) AS remark FROM documents)
SELECT *, concat_ws(',', CASE WHEN trial IS NULL THEN 'trial' END, CASE WHEN kind IS NULL THEN 'kind' END, CASE WHEN length IS NULL THEN 'length' END) AS missing FROM r""",
    "features_labels": "SELECT d.doc_id, lang, n_chars, source, quality, toxic FROM (SELECT doc_id, lang, n_chars, source FROM documents) d JOIN (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l ON d.doc_id = l.doc_id",
    "pending_keys": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id % 3 > 0)",
    "numeric_totals": "SELECT round(CAST(sum(p_partkey) AS DOUBLE), 3) AS p_partkey, round(CAST(sum(p_size) AS DOUBLE), 3) AS p_size FROM part",
    "resolved_dates": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 4 THEN CAST(l_shipdate AS DATE) ELSE DATE '1999-12-31' END AS resolved FROM lineitem",
    "work_list": "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_custkey LIMIT 100",
    "filled_ids": "SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 3 > 0 AND role <> '' THEN role END, ',' ORDER BY turn, role), '') AS ids, count(*) AS n FROM conversations GROUP BY conv_id",
    "upsert_rows": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 1",
    "earliest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "first_per_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "pick_cascade": "SELECT source, doc_id, doc_id % 15 AS number FROM documents WHERE lang NOT IN ('es') AND doc_id % 15 BETWEEN 1 AND 9 AND regexp_matches(substr(text, 1, 40), '(?i)the|der|que') AND NOT regexp_matches(substr(text, 1, 40), '(?i)with|und') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 15, doc_id) = 1",
    "terminating_rows": "SELECT o_custkey, o_orderkey AS first_order, CAST(o_orderdate AS DATE) AS first_day, CAST(NULL AS VARCHAR) AS absent FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderpriority = '2-HIGH' AND contains(lower(o_orderstatus), 'o')) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) = 1",
    "label_cascade": """
WITH said AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 0 END) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 END AS a, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 1 END AS b, t FROM orders LEFT JOIN said ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT o_orderkey, coalesce(a, b, t) AS label, CASE WHEN a IS NOT NULL THEN 'status' WHEN b IS NOT NULL THEN 'title' ELSE 'text' END AS label_source FROM x WHERE coalesce(a, b, t) IS NOT NULL""",
    "text_verdict": r"""
WITH x AS (SELECT doc_id, substr(text, 1, 400) AS h, right(text, 1000) AS l FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(h, '(?is)the\s+and') THEN 1 WHEN regexp_matches(h, '(?is)der\s+die') THEN 0 WHEN regexp_matches(l, '(?is)que\s+de') THEN 0 WHEN regexp_matches(l, '(?is)of\s+the') THEN 1 END AS label FROM x""",
    "verdict_agreement": f"WITH x AS (SELECT {HEAD_VERDICT.format('substr(text, 1, 300)')} AS a, {HEAD_VERDICT.format('right(text, 300)')} AS b FROM documents) SELECT count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (a = b) AS n_agree, count(*) FILTER (a IS NULL AND b IS NULL) AS n_neither FROM x",
    "join_audit": """
WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'), x AS (SELECT o_orderstatus, l_orderkey IS NOT NULL AS f, c_custkey IS NOT NULL AS b FROM orders LEFT JOIN f ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey)
SELECT count(*) AS n_rows, count(*) FILTER (f) AS n_found, count(*) FILTER (b) AS n_building, count(*) FILTER (f AND b) AS n_both, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM x""",
    "date_mismatch": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, ship FROM orders JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <> ship",
    "gap_list": "SELECT doc_id, source AS trial, lang FROM documents JOIN (SELECT source, max(doc_id) AS last FROM documents GROUP BY 1) USING (source) WHERE trim(lang) <> '' AND last % 2 = 0 AND lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "gap_texts": "SELECT doc_id, source FROM documents WHERE doc_id IS NOT NULL AND trim(source) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "unmatched_keys": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "era_lookup": f"SELECT o_orderkey, {ERA} AS era FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
    "era_join": "WITH e AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS era, min(CAST(o_orderdate AS DATE)) AS s FROM orders GROUP BY 1), q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS d FROM orders) SELECT q.o_orderkey, e.era FROM q ASOF LEFT JOIN e ON q.d >= e.s",
    "category_counts_t0": """
WITH x AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, DATE '2024-01-05' + CAST(user_id % 20 AS INTEGER) AS t0 FROM events),
k AS (SELECT user_id, d, CASE event_type WHEN 'click' THEN 'EX' WHEN 'view' THEN 'AA' WHEN 'purchase' THEN 'ISS' ELSE 'OTHER' END AS c, d < t0 AND NOT starts_with(event_type, 'err') AS ok FROM x)
SELECT user_id, count(*) FILTER (ok AND c = 'EX') AS n_ex, count(*) FILTER (ok AND c = 'AA') AS n_aa, count(*) FILTER (ok AND c = 'ISS') AS n_iss, count(*) FILTER (ok AND c = 'OTHER') AS n_other, count(*) FILTER (ok) AS n_events,
  CASE WHEN count(*) FILTER (ok) >= 2 THEN datediff('day', min(d) FILTER (ok), max(d) FILTER (ok)) END AS span FROM k GROUP BY user_id""",
    "recency_t0": """
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 60 AS t0, CAST(l_shipdate AS DATE) AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, datediff('day', max(d) FILTER (d < t0), max(t0)) AS recency, CAST(count(*) FILTER (d < t0) = 0 AS BIGINT) AS none, count(*) FILTER (d < t0) AS n FROM x GROUP BY o_orderkey""",
    "distinct_names": "SELECT l_orderkey, count(DISTINCT trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'))) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "array_profile": "SELECT p_brand, count(*) AS n, count(DISTINCT left(p_type, 4)) AS prefixes, upper(left(min(p_type), 1)) AS initial, CASE WHEN bool_and(p_type = 'STANDARD') THEN 'one' ELSE 'many' END AS bucket FROM part GROUP BY 1",
    "text_features": r"""
SELECT doc_id, len(list_distinct(list_filter(list_concat(regexp_extract_all(text, '(th[a-z]+) of|of (th[a-z]+)', 1), regexp_extract_all(text, '(th[a-z]+) of|of (th[a-z]+)', 2)), lambda x: x <> ''))) AS n_distinct,
  len(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS n_numbers, CAST(regexp_matches(text, '(?is)the.{0,20}and') OR regexp_matches(text, '(?is)que.{0,20}de') AS BIGINT) AS has_any,
  CASE WHEN contains(text, 'token') OR contains(text, 'Token') THEN len(regexp_extract_all(text, '[0-9a-f]{8,}')) ELSE 0 END AS n_gated, length(text) AS n_chars FROM documents""",
    "usable_text": "SELECT count(*) AS n_rows, count(*) FILTER (length(text) >= 1000) AS n_usable, count(*) FILTER (text IS NULL) AS n_null FROM documents",
    "scalar_functions": """
SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS normal, lower(trim(regexp_replace('  A ' || s_name, '\\s+', ' ', 'g'))) AS doctype, TRY_CAST(left(right(s_name, 4), 3) AS DOUBLE) AS lead,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'other' END AS filled, CASE WHEN s_suppkey % 3 > 0 THEN '2021' ELSE 'unknown' END AS bucket, s_suppkey % 2 = 0 AS flag, starts_with(s_name, 'Supplier#00000000') AS low,
  CASE s_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS mapped FROM supplier""".replace("\\\\", "\\"),
    "time_split": "SELECT CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY 1",
    "mature_filter": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2000-01-01' - 540 GROUP BY 1",
    "date_safe_folds": """
WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT d, sum(n) OVER (ORDER BY d) AS upto FROM days), t AS (SELECT count(*) AS n FROM orders),
e AS (SELECT k, (SELECT min(d) FROM u, t WHERE upto >= t.n - (5 - k) * (t.n // 6)) AS d FROM range(6) r(k)),
f AS (SELECT a.k AS fold, a.d AS train_end, b.d AS test_end FROM e a JOIN e b ON b.k = a.k + 1 WHERE a.d < b.d)
SELECT CAST(fold AS INTEGER) AS fold, train_end, test_end, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <= train_end) AS n_train, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) > train_end AND CAST(o_orderdate AS DATE) <= test_end) AS n_test FROM f""",
    "one_hot": "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
    "median_impute": "WITH x AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 > 0 THEN p_size END AS DOUBLE) AS p_size, p_retailprice FROM part) SELECT p_partkey, coalesce(p_size, (SELECT median(p_size) FROM x)) AS p_size, coalesce(p_retailprice, (SELECT median(p_retailprice) FROM x)) AS p_retailprice FROM x",
    "balanced_weights": "WITH x AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT y, round((SELECT sum(n) FROM x) / (2.0 * n), 6) AS weight, n FROM x",
    "roc_auc": f"WITH {SCORED}, {GRAIN} SELECT round(sum(neg * (tp - pos) + neg * pos / 2) / (sum(pos) * sum(neg)), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c",
    "avg_precision_f1": f"WITH {SCORED}, {GRAIN}, {CELLS.replace('n AS (', 'n AS (', 1)}, {PR} SELECT round((SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM c), 6) AS average_precision, round(f1, 6) AS f1 FROM f",
    "class_report": f"""
WITH {SCORED}, {CELLS}, {PR}, r AS (
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support, (a + d) / total AS accuracy FROM f UNION ALL SELECT '1', p1, r1, f1, s1, (a + d) / total FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total, (a + d) / total FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / total, (r0 * s0 + r1 * s1) / total, (f0 * s0 + f1 * s1) / total, total, (a + d) / total FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, CAST(support AS BIGINT) AS support FROM r""",
    "calibration": f"WITH {SCORED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS fraction_positive, count(*) AS n FROM s GROUP BY 1",
    "roc_points": f"WITH {SCORED}, {GRAIN} SELECT round(p, 6) AS threshold, round(fp / sum(neg) OVER (), 6) AS fpr, round(tp / sum(pos) OVER (), 6) AS tpr FROM c",
    "confusion": f"WITH {SCORED} SELECT y AS label, z AS predicted, count(*) AS n FROM h GROUP BY ALL",
    "stratified_sample": """
WITH x AS (SELECT doc_id, concat_ws('|', coalesce(lang, 'unknown'), coalesce(source, 'unknown')) AS stratum, md5('7:' || doc_id) AS place FROM documents),
y AS (SELECT doc_id, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY place, doc_id) AS INTEGER) AS turn FROM x)
SELECT * FROM y ORDER BY turn, md5(stratum), stratum LIMIT 150""",
    "sample_report": "SELECT count(*) AS n, count(text) AS n_ok, count(*) FILTER (length(text) > 1000) AS n_long FROM documents",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "flatten_paths": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS none FROM events",
    "flatten_structs": "SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS customer, CAST(NULL AS VARCHAR) AS none FROM orders",
    "polymorphic_bag": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE '' END AS items FROM part",
    "parallel_bag": "SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_returnflag, CAST(l_suppkey AS VARCHAR)) AS lines, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, CAST(l_suppkey AS VARCHAR)) AS flags, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_returnflag, CAST(l_suppkey AS VARCHAR)) AS names, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS codes, count(*) AS n FROM lineitem GROUP BY 1",
    "explode_pages": "SELECT conv_id, turn, role FROM conversations",
    "page_completeness": "WITH p AS (SELECT conv_id, count(*) AS held, max(turn) + 1 AS announced FROM conversations GROUP BY 1) SELECT conv_id % 7 AS bucket, max(announced) AS announced, CAST(sum(held) AS BIGINT) AS held, max(announced) = sum(held) AS complete FROM p GROUP BY 1",
    "constant_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "search_filters": "SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(o_orderpriority), 'urg') AND o_orderstatus IN ('O', 'F') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20",
    "facet_counts": "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "distinct_keys": "SELECT DISTINCT trim(source) AS source FROM documents WHERE trim(source) <> ''",
    "feature_matrix": f"""
WITH f AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS ship FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1), x AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, ship FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS level, CAST(datediff('day', d, ship) AS INTEGER) AS gap, CAST(ship IS NULL AS INTEGER) AS gap_missing, {ERA} AS era FROM x""",
    "ablation": "SELECT doc_id, quality, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM labels JOIN documents USING (doc_id)",
    "candidate_scan": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderstatus <> 'P' GROUP BY 1",
    "typed_view": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.other.x') AS x FROM events",
    "stream_ingest": "SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS none FROM events",
}
SQL["stream_upsert"] = SQL["upsert_latest"]
SQL["prior_rate_saved"] = SQL["prior_rate_single"]
SQL |= trials.SQL
