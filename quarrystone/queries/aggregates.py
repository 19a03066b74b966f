"""Aggregations: metrics, usage, evaluation, rewards and drift."""

OUTCOMES = "(SELECT l.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id)"
EV = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM {events})"

QUERIES = {
    "kb_dimension_counts": "SELECT lang AS dimension, source, count(*) AS n FROM {documents} GROUP BY lang, source",  # L
    "kb_stats": "SELECT count(*) AS total, count(DISTINCT label) AS dimensions, count(embedding) AS embedded FROM {embeddings}",  # L
    "memory_stats": "SELECT @joined(concat(lang, '=', @text(n))) AS by_type, cast(sum(n) AS bigint) AS total FROM (SELECT lang, count(*) AS n FROM {documents} GROUP BY lang) q",  # L
    "audit_stats": "SELECT count(*) AS total, cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS bigint) AS denied, cast(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bigint) AS confirmed, cast(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS bigint) AS risky FROM {events}",  # L
    "tool_metrics": f"SELECT event_type AS tool, count(*) AS calls, round(coalesce(avg(value), 0), 6) AS avg_ms, round(coalesce(avg(cast(ok AS double)), 0), 6) AS success_rate FROM {EV} q GROUP BY event_type",  # L
    "usage_rollup": """WITH price AS (SELECT * FROM (VALUES ('click', 0.5, 1.5), ('view', 0.1, 0.3), ('default', 3.0, 15.0)) AS p(provider, p_in, p_out)), used AS (SELECT event_type, cast(floor(value) AS bigint) AS tin, cast(@field(props|k) AS bigint) AS tout FROM {events})
        SELECT u.event_type AS provider, cast(sum(tin) AS bigint) AS tokens_in, cast(sum(tout) AS bigint) AS tokens_out, round(sum(cast(tin * coalesce(p.p_in, 3.0) + tout * coalesce(p.p_out, 15.0) AS double)) / 1000000, 6) AS cost, count(*) AS requests FROM used u LEFT JOIN price p ON u.event_type = p.provider GROUP BY u.event_type""",  # L
    "budget_check": """SELECT user_id, event_id, round(cost, 4) AS cost, round(tokens, 4) AS tokens, CASE WHEN cost >= 1000 THEN 'cost' WHEN tokens >= 500 THEN 'input' END AS over_budget FROM (SELECT user_id, event_id,
        sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cost, cast(sum(cast(@field(props|k) AS bigint)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS tokens FROM {events}) q""",  # L, cost is checked first
    "report_means": f"SELECT source, floor(avg(100.0 * quality) + 0.5) AS content, floor(avg(100.0 - 50.0 * toxic) + 0.5) AS speech, floor(0.75 * avg(100.0 * quality) + 0.25 * avg(100.0 - 50.0 * toxic) + 0.5) AS overall FROM {OUTCOMES} q GROUP BY source".replace("floor(", "cast(floor(").replace("+ 0.5)", "+ 0.5) AS bigint)"),  # L
    "top_recurring": "SELECT term, n FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS r FROM (SELECT term, count(*) AS n FROM (SELECT @each(@words(lower(text))) AS term FROM {documents}) w GROUP BY term) c) q WHERE r <= 3",  # L
    "weighted_overall": """WITH parts AS (SELECT * FROM (VALUES (1, 80.0, 80.0, 80.0), (2, 90.0, NULL, 60.0), (3, NULL, NULL, NULL), (4, NULL, 40.0, NULL)) AS p(id, a, b, c))
        SELECT id, round(cast((coalesce(a * 0.6, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.15, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.15 END, 0) AS double), 4) AS overall FROM parts""",  # L
    "speech_overall": """SELECT id, confidence, rhythm, round(0.3 * fluency + 0.2 * pace + 0.3 * confidence + 0.2 * rhythm, 4) AS overall FROM (SELECT id, fluency, pace, greatest(0, 100 - 8 * fillers) AS confidence, greatest(0, 100 - 15 * pauses) AS rhythm
        FROM (SELECT conv_id AS id, 100.0 * avg(CASE WHEN @chars(text) >= 20 THEN 1.0 ELSE 0.0 END) AS fluency, least(100.0, avg(@size(@words(text)))) AS pace, cast(sum(@count_of(text| the | der | la )) AS bigint) AS fillers, count(CASE WHEN @chars(text) < 40 THEN 1 END) AS pauses FROM {conversations} GROUP BY conv_id) s) t""",  # L; fluency and pace, which no listing defines, are ours
    "action_counts": """WITH acts AS (SELECT * FROM (VALUES (1, 1, 'a'), (1, 1, 'a'), (1, 2, 'a'), (1, 2, 'b'), (2, 1, 'c'), (2, 2, 'c'), (2, 3, 'c')) AS t(conv, turn, fp))
        SELECT conv, turn, fp, max(n) AS seen, max(n) > 2 AS blocked FROM (SELECT conv, turn, fp, count(*) OVER (PARTITION BY conv, fp ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM acts) q GROUP BY conv, turn, fp""",  # E
    "loop_summary": "SELECT conv_id, count(*) AS messages, count(CASE WHEN role = 'assistant' THEN 1 END) AS model_calls, cast(sum(greatest(1, cast(floor((@chars(text) + 30) / 4) AS bigint))) AS bigint) AS input_units FROM {conversations} GROUP BY conv_id",  # E
    "weighted_recall_merge": """WITH hits AS (SELECT * FROM (VALUES ('d1', 0.9, 'vector'), ('d1', 0.5, 'bm25'), ('d2', 0.8, 'graph'), ('d3', 0.7, 'other'), ('d2', 0.4, 'vector')) AS h(doc, score, source)), w AS (SELECT * FROM (VALUES ('vector', 0.6), ('bm25', 0.3), ('graph', 0.1)) AS w(source, weight))
        SELECT h.doc, round(cast(sum(h.score * coalesce(w.weight, 0)) AS double), 4) AS score, @joined(h.source) AS sources FROM hits h LEFT JOIN w ON h.source = w.source GROUP BY h.doc""",  # L
    "search_accuracy": """WITH s AS (SELECT q.vec_id, q.label AS want, a.label AS got, a.vec_id AS top_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(@dot(q.embedding|a.embedding), 5) DESC, a.vec_id) AS r FROM (SELECT * FROM {embeddings} WHERE vec_id % 50 = 0) q JOIN {embeddings} a ON q.vec_id <> a.vec_id)
        SELECT round(avg(CASE WHEN want = got OR coalesce(d.text LIKE '%that%', false) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM s LEFT JOIN {documents} d ON s.top_id = d.doc_id WHERE r = 1""",  # L, the dimension or a keyword
    "eval_pass_rate": f"SELECT source, bool_and(quality = 1) AS all_pass, count(*) AS assertions, round(avg(cast(quality AS double)), 6) AS rate FROM {OUTCOMES} q GROUP BY source",  # L
    "pass_at_1": f"SELECT round(avg(cast(first_ok AS double)), 6) AS pass_at_1 FROM (SELECT source, min_by(quality, doc_id) AS first_ok FROM {OUTCOMES} q GROUP BY source) t",  # P
    "pass_at_k": f"SELECT round(avg(cast(any_ok AS double)), 6) AS pass_at_k FROM (SELECT source, max(CASE WHEN r <= 3 THEN quality ELSE 0 END) AS any_ok FROM (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {OUTCOMES} q) o GROUP BY source) t",  # P
    "partial_score": f"SELECT source, round(avg(0.7 * quality + 0.3 * (1 - toxic)), 6) AS partial FROM {OUTCOMES} q GROUP BY source",  # P
    "avg_steps": "SELECT round(avg(cast(n AS double)), 6) AS steps FROM (SELECT conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id) q",  # P
    "redundant_rate": "SELECT round(1 - count(DISTINCT concat(@text(user_id), event_type)) / cast(count(*) AS double), 6) AS redundant FROM {events}",  # P
    "first_try_rate": f"SELECT round(avg(cast(ok AS double)), 6) AS first_try FROM (SELECT user_id, min_by(ok, event_id) AS ok FROM {EV} q GROUP BY user_id) t",  # P
    "token_cost": "SELECT lang, round(sum(n_chars / 4.0) * 0.02 / 1000000, 9) AS cost FROM {documents} GROUP BY lang",  # P
    "robustness_rates": f"SELECT event_type, round(var_pop(rate), 6) AS variance, round(min(rate), 6) AS worst FROM (SELECT event_type, user_id % 10 AS variant, avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS rate FROM {EV} q GROUP BY event_type, user_id % 10) t GROUP BY event_type",  # P
    "safety_rates": f"SELECT round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic_rate, round(avg(CASE WHEN toxic = 1 AND quality = 0 THEN 1.0 ELSE 0.0 END), 6) AS refused FROM {OUTCOMES} q",  # P
    "efficiency_score": f"SELECT source, round(avg(cast(quality AS double)) * (20.0 / nullif(count(*), 0)), 6) AS efficiency FROM {OUTCOMES} q GROUP BY source",  # P
    "stratified_pass_rate": f"SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars <= 4000 THEN 'medium' ELSE 'long' END AS bucket, round(avg(cast(quality AS double)), 6) AS rate, count(*) AS n FROM {OUTCOMES} q GROUP BY 1 UNION ALL SELECT 'all', round(avg(cast(quality AS double)), 6), count(*) FROM {OUTCOMES} q",  # P
    "tool_precision_recall": f"SELECT round(count(CASE WHEN quality = 1 AND n_chars > 500 THEN 1 END) / cast(nullif(count(CASE WHEN n_chars > 500 THEN 1 END), 0) AS double), 6) AS tool_precision, round(count(CASE WHEN quality = 1 AND n_chars > 500 THEN 1 END) / cast(nullif(count(CASE WHEN quality = 1 THEN 1 END), 0) AS double), 6) AS tool_recall FROM {OUTCOMES} q",  # P
    "group_advantage": f"SELECT t.doc_id, t.source, round((t.quality - g.m) / g.s, 6) AS advantage FROM {OUTCOMES} t JOIN (SELECT source, avg(quality) AS m, stddev_pop(quality) AS s FROM {OUTCOMES} q GROUP BY source) g ON t.source IS NOT DISTINCT FROM g.source WHERE g.s > 0.000001",  # P
    "batch_advantage": f"SELECT doc_id, round((quality - m) / s, 6) AS advantage FROM {OUTCOMES} o CROSS JOIN (SELECT avg(quality) AS m, stddev_pop(quality) AS s FROM {OUTCOMES} q) t WHERE s > 0",  # P
    "composite_reward": f"SELECT doc_id, round(0.6 * quality + 0.2 * (1 - toxic) - 0.1 * least(1, n_chars / 20000.0) - 0.1 * (CASE WHEN n_chars < 100 THEN 1 ELSE 0 END), 6) AS reward FROM {OUTCOMES} q",  # P
    "credit_assign": "SELECT c.conv_id, c.turn, o.outcome FROM {conversations} c JOIN (SELECT conv_id, max_by(role, turn) AS outcome FROM {conversations} GROUP BY conv_id) o ON c.conv_id = o.conv_id",  # P
    "majority_vote": "SELECT source, lang AS answer, n AS votes FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) c) q WHERE r = 1",  # P
    "slo_alerts": f"SELECT event_type, round(avg(cast(ok AS double)), 6) AS success, avg(cast(ok AS double)) < 0.95 AS success_alert, max(value) > 400 AS latency_alert FROM {EV} q GROUP BY event_type",  # P
    "weighted_scorecard_veto": f"SELECT source, CASE WHEN max(toxic) = 1 THEN 0.0 ELSE round(0.4 * avg(quality) + 0.3 * avg(1 - toxic) + 0.3 * least(1, avg(n_chars) / 5000), 6) END AS score FROM {OUTCOMES} q GROUP BY source",  # P
    "drift_stats": "SELECT day, round(m, 6) AS mean_value, round(avg(m) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving, m < 0.9 * avg(m) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS dropped FROM (SELECT @day(ts) AS day, avg(value) AS m FROM {events} GROUP BY @day(ts)) q",  # P
    "chunk_count_outliers": "SELECT doc_id, chunks FROM (SELECT doc_id, cast(floor(greatest(n_chars - 1, 0) / 448) AS bigint) + 1 AS chunks FROM {documents}) q WHERE chunks > (SELECT @quantile(floor(greatest(n_chars - 1, 0) / 448) + 1|0.98) FROM {documents})",  # P
    "kappa": """SELECT round((avg(agree) - sum(p2)) / nullif(1 - sum(p2), 0), 6) AS kappa FROM (SELECT avg((ones * (ones - 1) + (3 - ones) * (2 - ones)) / 6.0) AS agree, power(avg(ones / 3.0), 2) + power(1 - avg(ones / 3.0), 2) AS p2
        FROM (SELECT quality + (1 - toxic) + (CASE WHEN n_chars > 300 THEN 1 ELSE 0 END) AS ones FROM """ + OUTCOMES + """ o WHERE quality IS NOT NULL AND toxic IS NOT NULL) r) k""",  # P, Fleiss over three raters
    "self_consistency": """SELECT query, round(avg(cosine), 4) AS similarity, count(*) AS pairs FROM (SELECT cast(floor(a.vec_id / 5) AS bigint) AS query, @dot(a.embedding|b.embedding) / nullif(sqrt(@dot(a.embedding|a.embedding)) * sqrt(@dot(b.embedding|b.embedding)), 0) AS cosine
        FROM {embeddings} a JOIN {embeddings} b ON floor(a.vec_id / 5) = floor(b.vec_id / 5) AND a.vec_id < b.vec_id) q GROUP BY query""",  # P, five outputs a query
    "psi_kl": "WITH h AS (SELECT cast(least(9, floor(value / 10)) AS int) AS b, count(CASE WHEN event_id % 2 = 0 THEN 1 END) + 0.5 AS p, count(CASE WHEN event_id % 2 = 1 THEN 1 END) + 0.5 AS q FROM {events} GROUP BY 1), t AS (SELECT cast(p AS double) / all_p AS p, cast(q AS double) / all_q AS q FROM h CROSS JOIN (SELECT sum(cast(p AS double)) AS all_p, sum(cast(q AS double)) AS all_q FROM h) z) SELECT round(sum((p - q) * ln(p / q)), 6) AS psi, round(sum(p * ln(p / q)), 6) AS kl, sum((p - q) * ln(p / q)) > 0.25 AS drifted FROM t",  # P
    "cache_hit_rate": "SELECT round(cast(count(*) - count(DISTINCT coalesce(md5(text), '')) AS double) / count(*), 6) AS hit_rate FROM {documents}",  # P, all but the first of equal texts are hits
    "mapreduce_sum": "SELECT shard, round(sum(value), 4) AS local_sum, count(*) AS n FROM (SELECT event_id % 8 AS shard, value FROM {events}) q GROUP BY shard",  # P
    "latency_percentiles": "SELECT event_type, round(@quantile(value|0.5), 6) AS p50, round(@quantile(value|0.95), 6) AS p95, round(@quantile(value|0.99), 6) AS p99, count(*) AS n FROM {events} GROUP BY event_type",  # P
    "wall_vs_compute": "SELECT user_id, max(@micros(ts)) - min(@micros(ts)) AS wall_us, round(sum(value), 4) AS compute_ms FROM {events} GROUP BY user_id",  # P
    "label_confusion": "SELECT quality, toxic, count(*) AS n FROM {labels} GROUP BY quality, toxic",  # P
}
