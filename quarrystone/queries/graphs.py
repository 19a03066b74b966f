"""Checks of call logs, and stream replay in batch form."""

from quarrystone.queries.filters_joins import CALLS

STREAM = """deltas AS (SELECT * FROM (VALUES
  ('s1', 1, 'text.delta', NULL, 'Checking '), ('s1', 2, 'tool.arguments.delta', 'c1', '{"city":'), ('s1', 3, 'tool.arguments.delta', 'c1', '"Shanghai"}'), ('s1', 4, 'response.completed', NULL, NULL),
  ('s2', 1, 'text.delta', NULL, 'cut off'), ('s3', 1, 'response.completed', NULL, NULL), ('s3', 2, 'text.delta', NULL, 'late'), ('s4', 1, 'mystery', NULL, 'x'), ('s4', 2, 'response.completed', NULL, NULL),
  ('s5', 1, 'tool.arguments.delta', '', 'x'), ('s5', 2, 'response.completed', NULL, NULL), ('s6', 1, 'text.delta', NULL, 'a'), ('s6', 2, 'text.delta', NULL, 'b'), ('s6', 3, 'response.error', NULL, NULL)
) AS t(stream_id, seq, kind, call_id, delta))"""
KNOWN = "('text.delta', 'tool.arguments.delta', 'response.completed', 'response.error')"

QUERIES = {
    "fan_out_in": "SELECT a.doc_id, a.n_words, b.n_lines, a.n_words / cast(b.n_lines AS double) AS ratio FROM (SELECT doc_id, @size(@words(text)) AS n_words FROM {documents}) a JOIN (SELECT doc_id, @size(@split(text|\\n)) AS n_lines FROM {documents}) b ON a.doc_id = b.doc_id",  # L
    "dynamic_send": "SELECT conv_id, turn, @each(@words(text)) AS word FROM {conversations}",  # P
    "merge_streams": "SELECT origin, id, seq, arrived FROM (SELECT 'events' AS origin, event_id AS id, @rank(PARTITION BY user_id ORDER BY event_id) AS seq, event_id * 2 AS arrived FROM {events} UNION ALL SELECT 'turns' AS origin, conv_id AS id, turn AS seq, (conv_id * 100 + turn) * 2 + 1 AS arrived FROM {conversations}) u",  # P, rows keep their origin and the order of arrival
    "stream_guards": f"WITH {STREAM}, closed AS (SELECT stream_id, min(CASE WHEN kind IN ('response.completed', 'response.error') THEN seq END) AS done FROM deltas GROUP BY stream_id) SELECT s.stream_id, coalesce(min_by(CASE WHEN s.seq > c.done THEN 'after_terminal' WHEN s.kind NOT IN {KNOWN} THEN 'unknown_type' WHEN s.kind = 'tool.arguments.delta' AND coalesce(s.call_id, '') = '' THEN 'missing_call_id' END, CASE WHEN s.seq > c.done OR s.kind NOT IN {KNOWN} OR (s.kind = 'tool.arguments.delta' AND coalesce(s.call_id, '') = '') THEN s.seq END), CASE WHEN max(c.done) IS NULL THEN 'no_completion' ELSE 'ok' END) AS status FROM deltas s JOIN closed c ON s.stream_id = c.stream_id GROUP BY s.stream_id",  # E
    "conversation_validate": f"""WITH {CALLS}, a AS (SELECT conv, seq, call_id FROM calls WHERE role = 'assistant' AND call_id IS NOT NULL), goal AS (SELECT conv, min(CASE WHEN role = 'user' THEN seq END) AS said FROM calls GROUP BY conv),
        issued AS (SELECT conv, call_id, min(seq) AS seq, count(*) - 1 AS again FROM a GROUP BY conv, call_id),
        res AS (SELECT r.conv, r.seq, r.call_id, coalesce(r.call_id, '') = '' AS no_id, NOT coalesce(i.seq < r.seq, false) AS unknown, g.said IS NULL OR g.said > r.seq AS no_goal FROM calls r LEFT JOIN issued i ON r.conv = i.conv AND r.call_id = i.call_id JOIN goal g ON r.conv = g.conv WHERE r.role = 'tool'),
        good AS (SELECT conv, call_id, count(*) AS n FROM res WHERE NOT no_id AND NOT unknown GROUP BY conv, call_id),
        one AS (SELECT conv, 'duplicate_call' AS problem, cast(sum(again) AS bigint) AS n FROM issued GROUP BY conv UNION ALL SELECT conv, 'no_user_goal' AS problem, count(CASE WHEN no_goal THEN 1 END) AS n FROM res GROUP BY conv UNION ALL SELECT conv, 'missing_call_id' AS problem, count(CASE WHEN no_id THEN 1 END) AS n FROM res GROUP BY conv
          UNION ALL SELECT conv, 'unknown_call' AS problem, count(CASE WHEN unknown AND NOT no_id THEN 1 END) AS n FROM res GROUP BY conv UNION ALL SELECT conv, 'duplicate_result' AS problem, cast(sum(n - 1) AS bigint) AS n FROM good GROUP BY conv
          UNION ALL SELECT i.conv, 'unresolved' AS problem, count(CASE WHEN g.call_id IS NULL THEN 1 END) AS n FROM issued i LEFT JOIN good g ON i.conv = g.conv AND i.call_id = g.call_id GROUP BY i.conv)
        SELECT conv, problem, n FROM one WHERE n > 0""",  # E
    "turn_validate": """WITH turns AS (SELECT * FROM (VALUES (1, 'assistant', 'tool_calls'), (2, 'assistant', 'completed'), (3, 'assistant', 'tool_calls'), (4, 'user', 'tool_calls'), (5, 'assistant', 'tool_calls'), (6, 'assistant', 'completed')) AS t(turn, role, stop_reason)), history AS (SELECT * FROM (VALUES (5, 'c0')) AS h(turn, call_id)),
        batch AS (SELECT * FROM (VALUES (1, 0, 'c1', 'weather', true), (1, 1, 'c1', 'time', true), (2, 0, 'c2', '', true), (4, 0, ' ', 'time', true), (5, 0, 'c0', 'time', false), (5, 1, 'c5', 'time', true)) AS b(turn, idx, call_id, name, text_arguments)),
        n AS (SELECT t.turn, t.role, t.stop_reason, count(b.idx) AS calls FROM turns t LEFT JOIN batch b ON t.turn = b.turn GROUP BY t.turn, t.role, t.stop_reason),
        one AS (SELECT turn, -1 AS idx, 'role' AS problem FROM n WHERE role <> 'assistant' UNION ALL SELECT turn, -1 AS idx, 'stop_reason' AS problem FROM n WHERE calls > 0 AND stop_reason <> 'tool_calls' UNION ALL SELECT turn, -1 AS idx, 'no_calls' AS problem FROM n WHERE calls = 0 AND stop_reason = 'tool_calls'
          UNION ALL SELECT b.turn, b.idx, CASE WHEN trim(b.call_id) = '' THEN 'empty_id' WHEN b.before > 0 THEN 'repeated_id' WHEN h.call_id IS NOT NULL THEN 'id_in_history' END AS problem FROM (SELECT turn, idx, call_id, count(*) OVER (PARTITION BY turn, call_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS before FROM batch) b LEFT JOIN history h ON b.turn = h.turn AND b.call_id = h.call_id
          UNION ALL SELECT turn, idx, 'empty_name' AS problem FROM batch WHERE trim(name) = '' UNION ALL SELECT turn, idx, 'arguments' AS problem FROM batch WHERE NOT text_arguments)
        SELECT turn, idx, problem FROM one WHERE problem IS NOT NULL""",  # E
    "storm_backpressure": """WITH e AS (SELECT cast(floor(@micros(ts) / 3600000000) AS bigint) AS hour, event_id, ts, @hash_unit(concat('storm:', @text(event_id))) AS u FROM {events}), f AS (SELECT hour, event_id FROM (SELECT hour, event_id, row_number() OVER (PARTITION BY hour ORDER BY ts, event_id) AS r FROM e) q WHERE r <= 12)
        SELECT hour, event_id, 'admitted' AS taken FROM f UNION ALL SELECT e.hour, e.event_id, 'sampled' AS taken FROM e LEFT JOIN f ON e.event_id = f.event_id WHERE f.event_id IS NULL AND e.u < 0.1""",  # P, a limit an hour, cut before the shuffle, and a sample of the rest
    "notify_drain": "SELECT user_id, call_no, @inorder(event_id|concat(event_type, ':', @text(event_id))|',') AS notes FROM (SELECT user_id, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS call_no FROM {events}) q WHERE event_type <> 'view' GROUP BY user_id, call_no",  # L, a view is a model call that takes what waits
    "ext_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "ext_star_join": "SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
    "ext_rollup": "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "ext_top_parts": "SELECT p.p_brand, p.p_partkey, qty FROM (SELECT p_brand, p_partkey, qty, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS r FROM (SELECT p.p_brand, p.p_partkey, sum(l.l_quantity) AS qty FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, p.p_partkey) a) p WHERE r <= 3",
    "ext_event_windows": "SELECT event_type, cast(floor(@micros(ts) / 21600000000) AS bigint) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2",
    "ext_supplier_customer": "SELECT s.s_nationkey, count(DISTINCT s.s_suppkey) AS suppliers, count(DISTINCT c.c_custkey) AS customers FROM {supplier} s LEFT JOIN {customer} c ON s.s_nationkey = c.c_nationkey GROUP BY s.s_nationkey",
    "ext_asof": "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM {events}) q WHERE event_type = 'error'",
}
