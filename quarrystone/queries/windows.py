"""Order-dependent operators as window functions, over events and conversations."""

SEG = "(SELECT user_id AS rec, event_id, @micros(ts) / 1000000.0 AS start_s, @micros(ts) / 1000000.0 + value AS end_s, event_type FROM {events})"

QUERIES = {
    "long_pauses": f"SELECT rec, event_id, round(cast(gap AS double), 3) AS gap_s FROM (SELECT rec, event_id, start_s - lag(end_s) OVER (PARTITION BY rec ORDER BY start_s, event_id) AS gap FROM {SEG} s) q WHERE gap > 100000",  # L
    "group_by_pause": f"SELECT rec, island, count(*) AS n, min(event_id) AS first_event FROM (SELECT rec, event_id, sum(brk) OVER (PARTITION BY rec ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT rec, event_id, start_s, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY rec ORDER BY start_s, event_id) > 36000 THEN 1 ELSE 0 END AS brk FROM {SEG} s) b) q GROUP BY rec, island".replace("rec, island, count", "rec, cast(island AS bigint) AS island, count"),  # L
    "speaker_heuristic": "SELECT conv_id, turn, CASE WHEN @matches(text|[?]) OR n < 0.5 * avg(n) OVER (PARTITION BY conv_id) THEN 'interviewer' ELSE 'candidate' END AS speaker FROM (SELECT conv_id, turn, text, @chars(text) AS n FROM {conversations}) q",  # L
    "recent_by_token_budget": "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(cast(ceil(@chars(text) / 4.0) AS bigint)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM {conversations}) q WHERE total <= 1000",  # L
    "sliding_window": "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM {conversations}) q WHERE (a = 1 AND role IN ('system', 'developer')) OR z = 1",  # E
    "keep_recent_results": """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND r > 3 AND @chars(text) > 100 THEN concat('[Previous: used ', coalesce(tool, 'tool'), ']') ELSE text END AS text FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r,
        CASE WHEN turn % 4 = 1 THEN 'search' END AS tool FROM {conversations}) q""",  # L, answers stand for tool results
    "capped_append": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) q WHERE r <= 5",  # L
    "count_since_cursor": "WITH cur AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS pos FROM {conversations} GROUP BY conv_id) SELECT c.conv_id, count(CASE WHEN c.turn > coalesce(cur.pos, -1) THEN 1 END) AS unread FROM {conversations} c JOIN cur ON c.conv_id = cur.conv_id GROUP BY c.conv_id",  # L
    "adaptive_topk": """WITH ranked AS (SELECT q.vec_id AS qid, a.vec_id, round(@dot(q.embedding|a.embedding), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(@dot(q.embedding|a.embedding), 5) DESC, a.vec_id) AS r FROM (SELECT * FROM {embeddings} WHERE vec_id % 50 = 0) q JOIN {embeddings} a ON q.vec_id <> a.vec_id),
        stops AS (SELECT qid, vec_id, score, r, CASE WHEN score < 0.25 OR lag(score) OVER (PARTITION BY qid ORDER BY r) - score > 0.3 THEN 1 ELSE 0 END AS stop FROM ranked WHERE r <= 10)
        SELECT qid, vec_id, score FROM (SELECT qid, vec_id, score, r, max(stop) OVER (PARTITION BY qid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM stops) q WHERE stopped = 0 OR r = 1""",  # L
    "latest_per_key": "SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_event FROM {events} GROUP BY user_id",  # L
    "checkpoint_latest": "SELECT user_id, event_id, @micros(ts) AS created_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) q WHERE r = 1",  # L
    "checkpoint_rewind": "SELECT e.user_id, count(*) AS kept, max(e.event_id) AS at_event FROM {events} e JOIN (SELECT user_id, max(event_id) AS cp FROM {events} WHERE event_type = 'signup' GROUP BY user_id) c ON e.user_id = c.user_id WHERE e.event_id <= c.cp GROUP BY e.user_id",  # L
    "checkpoint_every_n": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM {events}) q WHERE done % 5 = 0",  # L
    "attention_nudge": "SELECT user_id, event_id FROM (SELECT user_id, event_id, n - coalesce(max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS since FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) a) q WHERE since > 0 AND since % 3 = 0",  # L
    "qa_pair_fsm": "SELECT conv_id, turn, q_turn FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS q_turn FROM {conversations} WHERE role IN ('user', 'assistant')) q WHERE role = 'assistant' AND prev = 'user'",  # L
    "last_write_merge": "WITH w AS (SELECT * FROM (VALUES (1, 'a', 'x', NULL), (2, 'a', NULL, 'p'), (3, 'a', 'y', NULL), (1, 'b', NULL, 'q')) AS w(step, id, f, g)) SELECT id, max_by(f, CASE WHEN f IS NOT NULL THEN step END) AS f, max_by(g, CASE WHEN g IS NOT NULL THEN step END) AS g FROM w GROUP BY id",  # L
    "cumulative_offset": "WITH files AS (SELECT * FROM (VALUES (1, 600.0), (2, 600.0), (3, 123.5)) AS f(file, dur)), seg AS (SELECT * FROM (VALUES (1, 1.0, 4.0), (2, 2.0, 3.0), (3, 0.5, 9.0)) AS s(file, a, b)) SELECT s.file, cast(s.a + f.off AS double) AS start_s, cast(s.b + f.off AS double) AS end_s FROM seg s JOIN (SELECT file, coalesce(sum(dur) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM files) f ON s.file = f.file",  # L
    "stuck_signals": "SELECT user_id, event_id, same3, fail_rate > 0.6 AS failing FROM (SELECT user_id, event_id, event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w AS same3, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fail_rate FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) q WHERE same3 OR fail_rate > 0.6",  # P
    "confidence_converge": "SELECT user_id, min(event_id) AS settled_at FROM (SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS low FROM {events}) q WHERE low > 85 GROUP BY user_id",  # P
    "ts_features": "SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma3, n - lag(n) OVER (ORDER BY day) AS change, lag(n, 7) OVER (ORDER BY day) AS week_before, round(m, 6) AS mean, round(sd * sd, 5) AS variance, low, high, round(sd, 6) AS deviation, round(sd / nullif(m, 0), 6) AS cv FROM (SELECT @day(ts) AS day, count(*) AS n, avg(value) AS m, min(value) AS low, max(value) AS high, stddev_pop(value) AS sd FROM {events} GROUP BY @day(ts)) q",  # P, one row a day
    "autocorrelation": "SELECT round(corr(n, prev), 6) AS lag1 FROM (SELECT cast(n AS double) AS n, cast(lag(n) OVER (ORDER BY day) AS double) AS prev FROM (SELECT @day(ts) AS day, count(*) AS n FROM {events} GROUP BY @day(ts)) d) q WHERE prev IS NOT NULL",  # P
    "rate_fixed": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, floor(@micros(ts) / 86400000000) ORDER BY ts, event_id) AS n FROM {events}) q WHERE n <= 2",  # P
    "tiered_retention": "SELECT CASE WHEN age < 1 THEN 'raw' WHEN age <= 168 THEN 'summary' ELSE 'facts' END AS tier, count(*) AS n FROM (SELECT (1706659200000000 - @micros(ts)) / 3600000000.0 AS age FROM {events}) q GROUP BY 1",  # P
    "retry_budget": "SELECT user_id, event_id, n_same <= 2 AND n_all <= 5 AS allowed FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, @field(props|k) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_same, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_all FROM {events} WHERE event_type = 'error') q",  # P
    "loop_breaker": "SELECT user_id, prev, event_type, n, total, CASE WHEN total > 20 THEN 'max_transitions' WHEN n >= 3 THEN 'same_path' END AS broken FROM (SELECT user_id, prev, event_type, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY user_id) AS bigint) AS total FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM {events}) q WHERE prev IS NOT NULL GROUP BY user_id, prev, event_type) t WHERE n >= 3 OR total > 20",  # P
    "circuit_breaker": "SELECT user_id, max(run) AS longest, max(run) >= 3 AS tripped FROM (SELECT user_id, grp, count(*) AS run FROM (SELECT user_id, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS grp FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) a WHERE event_type = 'error') b GROUP BY user_id, grp) q GROUP BY user_id",  # L
    "inbox_drain": "WITH cur AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) AS pos FROM {events} GROUP BY user_id) SELECT e.user_id, count(*) AS unread, max(e.event_id) AS new_cursor FROM {events} e JOIN cur ON e.user_id = cur.user_id WHERE e.event_id > coalesce(cur.pos, -1) GROUP BY e.user_id",  # L, the last signup is the cursor
    "output_delta": "SELECT conv_id, turn, substring(text, 101, 200) AS delta FROM {conversations} WHERE @chars(text) > 100",  # L
    "idle_timeout": "SELECT user_id, event_id FROM (SELECT user_id, event_id, @micros(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - @micros(ts) AS idle FROM {events}) q WHERE idle > 86400000000",  # L
    "out_of_order": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, us < coalesce(seen, us) AS was_late, us < coalesce(seen, us) - 600000000 AS dropped FROM (SELECT user_id, event_id, us, max(us) OVER (PARTITION BY user_id ORDER BY arrive, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT event_id, user_id, @micros(ts) AS us, @micros(ts) + (event_id * 7919 % 5) * 100000000000 AS arrive FROM {events}) a) q",  # P, sorted at the consumer; a watermark of ten minutes
    "gae_advantage": "WITH r AS (SELECT * FROM (VALUES (1, 1, 1.0, 0.5), (1, 2, 0.0, 0.4), (1, 3, 2.0, 0.3), (2, 1, 1.0, 0.2)) AS r(traj, t, reward, v)), d AS (SELECT traj, t, cast(reward + 0.9 * coalesce(lead(v) OVER (PARTITION BY traj ORDER BY t), 0) - v AS double) AS delta FROM r) SELECT a.traj, a.t, round(sum(b.delta * power(0.9 * 0.95, b.t - a.t)), 6) AS advantage FROM d a JOIN d b ON a.traj = b.traj AND b.t >= a.t GROUP BY a.traj, a.t",  # P
    "ts_fourier": "WITH d AS (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS size FROM (SELECT @day(ts) AS day, cast(count(*) AS double) AS n FROM {events} GROUP BY @day(ts)) q) SELECT k, round(sqrt(power(sum(n * cos(6.283185307179586 * k * i / size)), 2) + power(sum(n * sin(6.283185307179586 * k * i / size)), 2)) / max(size), 4) AS amplitude FROM d CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (7)) AS f(k)) f GROUP BY k",  # P, days number the rows
}
