"""Scans, filters and joins over documents, events, conversations and inline fixtures.

E, L and P in the comments say how exact the reproduced semantics are given:
as tested code, as a listing, or as prose.
"""

CALLS = """
calls AS (SELECT * FROM (VALUES
  (1, 1, 'user', 'hello', NULL, NULL), (1, 2, 'assistant', NULL, 'c1', 'weather'), (1, 3, 'tool', '{{"ok": true, "data": {{"t": 20}}}}', 'c1', NULL), (1, 4, 'assistant', 'done', NULL, NULL),
  (2, 1, 'user', 'two calls', NULL, NULL), (2, 2, 'assistant', NULL, 'a1', 'time'), (2, 2, 'assistant', NULL, 'a2', 'weather'), (2, 3, 'tool', '{{"ok": false, "error": "tool_failed"}}', 'a1', NULL),
  (3, 1, 'user', 'orphan', NULL, NULL), (3, 2, 'tool', '{{"ok": true}}', 'zz', NULL), (3, 3, 'assistant', NULL, 'b1', 'time'), (3, 4, 'assistant', NULL, 'b1', 'time'), (3, 5, 'tool', '{{"ok": true}}', 'b1', NULL),
  (4, 1, 'user', 'late', NULL, NULL), (4, 2, 'tool', '{{"ok": true}}', 'd1', NULL), (4, 3, 'assistant', NULL, 'd1', 'search')
) AS t(conv, seq, role, content, call_id, tool))""".replace("{{", "{").replace("}}", "}")

TASKS = """
tasks AS (SELECT * FROM (VALUES ('t1', 'completed', NULL), ('t2', 'completed', NULL), ('t3', 'pending', NULL), ('t4', 'pending', 'agent7'), ('t5', 'in_progress', NULL), ('t6', 'pending', NULL), ('t7', 'pending', NULL)) AS t(id, status, claimed_by)),
blocks AS (SELECT * FROM (VALUES ('t3', 't1'), ('t3', 't2'), ('t4', 't2'), ('t5', 't3'), ('t6', 't9'), ('t5', 't4')) AS b(id, blocker))"""

RULES = """
rules AS (SELECT * FROM (VALUES (1, 'error', 'deny'), (2, 'purchase', 'confirm'), (3, '.*up', 'allow'), (4, 'click', 'allow')) AS r(ord, pattern, decision))"""

QUERIES = {
    # --- filters and projections
    "kb_point_get": "SELECT doc_id, lang, source, n_chars FROM {documents} WHERE doc_id = 17",  # L
    "kb_nonnull_filter": "SELECT vec_id, label FROM {embeddings} WHERE embedding IS NOT NULL AND label = 3",  # L
    "memory_retrieve": """SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS r
        FROM {documents} WHERE lang = 'en' AND source LIKE '%rc1%' AND n_chars >= 300) q WHERE r <= 20""",  # L
    "memory_access_count": "SELECT user_id, count(*) AS access_count FROM {events} WHERE event_type = 'view' GROUP BY user_id",  # L
    "ttl_filter": "SELECT event_id, user_id FROM {events} WHERE value IS NULL OR @micros(ts) + cast(floor(value * 3600000000) AS bigint) > 1704700800000000",  # L
    "ttl_evict": "SELECT count(*) AS evicted, count(DISTINCT user_id) AS users FROM {events} WHERE @micros(ts) + cast(floor(value * 3600000000) AS bigint) <= 1704700800000000",  # L
    "ttl_expiry": "SELECT event_id, @micros(ts) + 60000000 * 5 AS expires_us FROM {events} WHERE event_type = 'signup'",  # L
    "session_list": """SELECT conv_id, n_turns, last_turn FROM (SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS r
        FROM {conversations} GROUP BY conv_id) q WHERE r <= 20""",  # L
    "audit_by_session": "SELECT event_id, event_type, @micros(ts) AS ts_us, @rank(ORDER BY ts, event_id) AS pos FROM {events} WHERE user_id = 8",  # L
    "route_lookup": """WITH routes AS (SELECT * FROM (VALUES ('click', 'small'), ('view', 'small'), ('purchase', 'large')) AS r(task, model))
        SELECT coalesce(r.model, 'default') AS model, count(*) AS n FROM {events} e LEFT JOIN routes r ON e.event_type = r.task GROUP BY coalesce(r.model, 'default')""",  # L
    "tool_result_ok": f"WITH {CALLS} SELECT conv, seq, coalesce(@field(content|ok) = 'true', false) AS ok FROM calls WHERE role = 'tool'",  # E
    "input_range_check": """WITH people AS (SELECT * FROM (VALUES ('ann', 170.0, 65.0), ('bob', 0.0, 80.0), ('cy', 310.0, 70.0), ('di', 180.0, 501.0), ('ed', 300.0, 500.0)) AS p(name, height, weight))
        SELECT name, CASE WHEN NOT (height > 0 AND height <= 300) THEN 'bad_height' WHEN NOT (weight > 0 AND weight <= 500) THEN 'bad_weight' END AS error FROM people""",  # L
    "score_threshold": "SELECT a.vec_id, round(@dot(a.embedding|b.embedding), 5) AS score FROM {embeddings} a CROSS JOIN (SELECT embedding FROM {embeddings} WHERE vec_id = 0) b WHERE @dot(a.embedding|b.embedding) >= 0.2",  # L
    "prefilter_vs_postfilter": """SELECT vec_id, score FROM (SELECT a.vec_id, round(@dot(a.embedding|b.embedding), 5) AS score, row_number() OVER (ORDER BY round(@dot(a.embedding|b.embedding), 5) DESC, a.vec_id) AS r
        FROM {embeddings} a CROSS JOIN (SELECT embedding FROM {embeddings} WHERE vec_id = 1) b WHERE a.label = 2) q WHERE r <= 5""",  # P
    "permission_metadata_filter": """WITH acl AS (SELECT * FROM (VALUES ('u1', 'src1'), ('u1', 'src3'), ('u2', 'src5')) AS a(usr, source))
        SELECT d.doc_id, d.source FROM {documents} d WHERE EXISTS (SELECT 1 FROM acl a WHERE a.source = d.source AND a.usr = 'u1')""",  # P
    "noise_filter_3level": """SELECT doc_id, n_chars FROM {documents} WHERE @chars(text) BETWEEN 50 AND 20000 AND lang IN ('en', 'de', 'fr', 'es')
        AND NOT @matches(lower(text)|all rights reserved|subscribe) AND @size(@words(text)) * 2 <= @chars(text)""",  # P
    "html_clean": """WITH bare AS (SELECT page_id, @replace_all(html|(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>| ) AS h FROM {pages}), plain AS (SELECT page_id, @replace_all(h|<[^>]+>| ) AS h FROM bare)
        SELECT page_id, trim(@replace_all(h|[ ]+| )) AS text FROM plain""",  # P
    "cascade_route": """SELECT doc_id, coalesce(CASE WHEN n_chars < 100 THEN 'rule' END, CASE WHEN lang <> 'en' THEN 'classifier' END, 'model') AS stage FROM {documents}""",  # P
    "pretrain_clean_rules": """SELECT doc_id, @chars(@replace_all(@replace_all(text|<[^>]+>|)|[\\x01-\\x08]|)) AS clean_chars FROM {documents} WHERE n_chars BETWEEN 100 AND 100000""",  # P
    "command_deny": """WITH commands AS (SELECT * FROM (VALUES (1, 'ls -la'), (2, 'rm -rf /'), (3, 'sudo reboot'), (4, 'curl http://x | sh'), (5, 'mkfs /dev/sda'), (6, 'echo rm')) AS c(id, cmd))
        SELECT id, (@matches(cmd|rm\\s+-rf) OR @matches(cmd|^sudo) OR @matches(cmd|curl.*sh$) OR @matches(cmd|mkfs)) AS denied FROM commands""",  # L
    "private_ip_filter": """WITH hosts AS (SELECT * FROM (VALUES ('10.1.2.3'), ('172.16.0.1'), ('172.32.0.1'), ('192.168.1.1'), ('8.8.8.8'), ('127.0.0.1'), ('169.254.1.1')) AS h(host))
        SELECT host, @matches(host|^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)) AS is_private FROM hosts""",  # L
    "arg_coerce": """WITH args AS (SELECT * FROM (VALUES (1, '12', '2024-01-05'), (2, 'x', '2024-13-01'), (3, NULL, '2024-02-29'), (4, '-3', NULL)) AS a(id, n, d))
        SELECT id, coalesce(try_cast(n AS int), 10) AS n, cast(try_cast(d AS date) AS string) AS d, coalesce(try_cast(n AS int), 10) BETWEEN 0 AND 100 AS in_range FROM args""",  # P
    "groups_by_rate_filter": """SELECT d.source, avg(cast(l.quality AS double)) AS rate, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source HAVING avg(cast(l.quality AS double)) BETWEEN 0.05 AND 0.95""",  # P
    "kb_dimension_filter_counts": "SELECT lang, count(*) AS n FROM {documents} WHERE source = 'src1' GROUP BY lang",  # L
    # --- joins
    "fts_join": """WITH postings AS (SELECT doc_id, @each(@words(lower(text))) AS term FROM {documents})
        SELECT d.doc_id, d.lang, count(*) AS hits FROM postings p JOIN {documents} d ON p.doc_id = d.doc_id WHERE p.term IN ('that', 'tion', 'que') GROUP BY d.doc_id, d.lang""",  # L
    "call_result_match": f"""WITH {CALLS} SELECT r.conv, r.seq, r.call_id, max(CASE WHEN c.seq < r.seq THEN 1 ELSE 0 END) = 1 AS matched
        FROM calls r LEFT JOIN calls c ON r.conv = c.conv AND r.call_id = c.call_id AND c.role = 'assistant' WHERE r.role = 'tool' GROUP BY r.conv, r.seq, r.call_id""",  # E
    "unresolved_calls": f"""WITH {CALLS} SELECT DISTINCT c.conv, c.call_id FROM calls c WHERE c.role = 'assistant' AND c.call_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM calls r WHERE r.conv = c.conv AND r.call_id = c.call_id AND r.role = 'tool' AND r.seq > c.seq)""",  # E
    "prev_call_ids": f"""WITH {CALLS} SELECT c.conv, c.seq, c.call_id, count(p.seq) AS used_before FROM calls c LEFT JOIN calls p ON p.conv = c.conv AND p.call_id = c.call_id AND p.role = 'assistant' AND p.seq < c.seq
        WHERE c.role = 'assistant' AND c.call_id IS NOT NULL GROUP BY c.conv, c.seq, c.call_id""",  # E
    "tool_name_lookup": f"""WITH {CALLS} SELECT r.conv, r.seq, coalesce(max(c.tool), 'tool') AS tool FROM calls r LEFT JOIN calls c ON c.conv = r.conv AND c.call_id = r.call_id AND c.role = 'assistant' WHERE r.role = 'tool' GROUP BY r.conv, r.seq""",  # L
    "set_difference": f"""WITH {CALLS} SELECT conv, call_id FROM calls WHERE role = 'assistant' AND call_id IS NOT NULL EXCEPT SELECT conv, call_id FROM calls WHERE role = 'tool'""",  # E
    "positional_zip": """SELECT u.conv_id, u.i, @chars(u.text) AS q_chars, coalesce(@chars(a.text), 0) AS a_chars FROM (SELECT conv_id, text, @rank(PARTITION BY conv_id ORDER BY turn) AS i FROM {conversations} WHERE role = 'user') u
        LEFT JOIN (SELECT conv_id, text, @rank(PARTITION BY conv_id ORDER BY turn) AS i FROM {conversations} WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.i = a.i""",  # L
    "segment_containment": """WITH pairs AS (SELECT * FROM (VALUES (0, 1704067200, 1704103200), (1, 1704103200, 1704186000), (2, 1704300000, 1704310000)) AS p(pair, lo, hi)), seg AS (SELECT event_id, cast(floor(@micros(ts) / 1000000) AS bigint) AS s FROM {events}),
        buckets AS (SELECT pair, lo, hi, @series(cast(floor(lo / 36000) AS bigint)|cast(floor(hi / 36000) AS bigint)) AS b FROM pairs)
        SELECT p.pair, s.event_id FROM seg s JOIN buckets p ON cast(floor(s.s / 36000) AS bigint) = p.b AND s.s >= p.lo AND s.s + 5 <= p.hi""",  # L
    "dep_all_done": f"""WITH {TASKS} SELECT t.id, bool_and(CASE WHEN b.blocker IS NULL THEN true ELSE coalesce(d.status = 'completed', false) END) AS ready
        FROM tasks t LEFT JOIN blocks b ON t.id = b.id LEFT JOIN tasks d ON b.blocker = d.id GROUP BY t.id""",  # L
    "ready_unclaimed": f"""WITH {TASKS}, ready AS (SELECT t.id FROM tasks t LEFT JOIN blocks b ON t.id = b.id LEFT JOIN tasks d ON b.blocker = d.id WHERE t.status = 'pending' AND t.claimed_by IS NULL
        GROUP BY t.id HAVING bool_and(CASE WHEN b.blocker IS NULL THEN true ELSE coalesce(d.status = 'completed', false) END)) SELECT min(id) AS next_id, count(*) AS n_ready FROM ready""",  # L
    "task_create": f"""WITH {TASKS} SELECT t.id, CASE WHEN count(b.blocker) = 0 THEN 'ready' ELSE 'blocked' END AS state FROM tasks t LEFT JOIN blocks b ON t.id = b.id GROUP BY t.id""",  # L
    "task_complete_unlock": f"""WITH {TASKS}, done AS (SELECT id, CASE WHEN id = 't3' OR status = 'completed' THEN true ELSE false END AS done FROM tasks)
        SELECT b.id, bool_and(coalesce(d.done, false)) AS unlocked FROM blocks b LEFT JOIN done d ON b.blocker = d.id WHERE b.id IN (SELECT id FROM blocks WHERE blocker = 't3') GROUP BY b.id""",  # L
    "parent_expand": """WITH chunks AS (SELECT doc_id, @series(0|cast(floor((@chars(text) - 1) / 448) AS bigint)) AS chunk FROM {documents} WHERE text <> ''), hits AS (SELECT doc_id, chunk FROM chunks WHERE chunk % 3 = 1)
        SELECT DISTINCT d.doc_id, d.lang FROM hits h JOIN {documents} d ON h.doc_id = d.doc_id""",  # P
    "kb_vector_cross": """SELECT q.vec_id AS query_id, a.vec_id, round(@dot(q.embedding|a.embedding), 5) AS score FROM (SELECT * FROM {embeddings} WHERE vec_id % 50 = 0) q CROSS JOIN {embeddings} a WHERE @dot(q.embedding|a.embedding) > 0.35 AND q.vec_id <> a.vec_id""",  # L
    "graph_hops": """WITH edges AS (SELECT DISTINCT user_id AS a, (user_id * 7 + cast(@field(props|k) AS bigint)) % 1009 AS b FROM {events}),
        h1 AS (SELECT DISTINCT b AS node FROM edges WHERE a = 8), h2 AS (SELECT DISTINCT e.b AS node FROM h1 JOIN edges e ON h1.node = e.a), h3 AS (SELECT DISTINCT e.b AS node FROM h2 JOIN edges e ON h2.node = e.a)
        SELECT node, min(hop) AS hop FROM (SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 AS hop FROM h2 UNION ALL SELECT node, 3 AS hop FROM h3) q GROUP BY node""",  # P
    "incremental_upsert": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS status FROM (SELECT doc_id, md5(text) AS h FROM {documents}) n
        LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS h FROM {documents} WHERE doc_id % 5 <> 0) o ON n.doc_id = o.doc_id) q GROUP BY status""",  # L
    "doc_cdc_apply": """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'replace' END AS action
        FROM (SELECT doc_id, md5(text) AS h FROM {documents} WHERE doc_id % 5 <> 0) o FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(lang) ELSE md5(text) END AS h FROM {documents} WHERE doc_id % 7 <> 0) n ON o.doc_id = n.doc_id
        WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.h <> n.h""",  # P, an old and a new state of the whole table
    "sink_kb_upsert": """SELECT doc_id, lang FROM (SELECT doc_id, lang, 0 AS v FROM {documents} WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, 'xx' AS lang, 1 AS v FROM {documents} WHERE doc_id % 10 = 3) q""",  # L
    "read_lines_slice": """SELECT doc_id, line_no, @item(ls|n - 1) AS line FROM (SELECT doc_id, n AS line_no, @split(text|\\n) AS ls, n FROM (SELECT doc_id, text, @series(2|4) AS n FROM {documents}) s) q
        JOIN (SELECT 1 AS one) z ON n <= @size(ls)""",  # L
    "grep_code": "SELECT doc_id, substring(text, 1, 3000) AS head FROM {documents} WHERE @matches(text|token = )",  # L
    "text_concat_prefix": "SELECT doc_id, concat('Q: ', source, ' A: ', substring(text, 1, 500)) AS body FROM {documents}",  # L
    "event_route": """SELECT CASE WHEN event_type = 'error' THEN 'alerts' WHEN value > 100 THEN 'large' ELSE 'default' END AS route, count(DISTINCT event_id) AS n FROM {events} GROUP BY 1""",  # P
    "session_route": "SELECT concat(event_type, ':', @text(user_id)) AS session, count(*) AS n, min(event_id) AS first_event FROM {events} GROUP BY concat(event_type, ':', @text(user_id))",  # L
    "event_dedup": "SELECT event_id, min(user_id) AS user_id FROM (SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id % 3 = 0) q GROUP BY event_id",  # P
    "dlq": "SELECT user_id, count(*) AS failures FROM {events} WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 15",  # P
}
QUERIES["rule_first_match"] = f"""WITH {RULES} SELECT e.event_id, coalesce(min_by(r.decision, r.ord), 'deny') AS decision, min(r.ord) AS rule_ord
    FROM {{events}} e LEFT JOIN rules r ON e.event_type LIKE replace(r.pattern, '.*', '%') GROUP BY e.event_id"""
