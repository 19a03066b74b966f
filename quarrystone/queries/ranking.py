"""Top-k, sampling, rank fusion, deduplication and retrieval scores."""

SCORED = "(SELECT q.vec_id AS qid, q.label AS qlabel, a.vec_id, a.label, round(@dot(q.embedding|a.embedding), 5) AS score FROM (SELECT * FROM {embeddings} WHERE vec_id % 50 = 0) q JOIN {embeddings} a ON q.vec_id <> a.vec_id)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM {SCORED} s)"
TOKENS = "(SELECT doc_id, @each(@words(lower(text))) AS term FROM {documents})"
TAGS = "(SELECT doc_id, bit_or(CASE term WHEN 'that' THEN 1 WHEN 'the' THEN 2 WHEN 'tion' THEN 4 WHEN 'der' THEN 8 WHEN 'que' THEN 16 ELSE 0 END) AS tags FROM " + TOKENS + " g GROUP BY doc_id)"
FTS = "(SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM (SELECT doc_id, @count_any(@words(lower(text))|'that', 'the', 'tion') AS n FROM {documents}) c WHERE n > 0)"
VEC = "(SELECT vec_id AS doc_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT a.vec_id, round(@dot(a.embedding|b.embedding), 5) AS score FROM {embeddings} a CROSS JOIN (SELECT embedding FROM {embeddings} WHERE vec_id = 0) b) s)"
BM25 = """base AS (SELECT doc_id, @words(lower(text)) AS w FROM {documents}), stats AS (SELECT cast(count(*) AS double) AS n, avg(cast(@size(w) AS double)) AS avgdl FROM base WHERE @size(w) > 0),
    tf AS (SELECT doc_id, term, cast(@size(w) AS double) AS len, cast(@count_in(w|term) AS double) AS tf FROM base CROSS JOIN (SELECT * FROM (VALUES ('that'), ('the'), ('tion')) AS t(term)) t WHERE @count_in(w|term) > 0), df AS (SELECT term, cast(count(*) AS double) AS df FROM tf GROUP BY term),
    bm AS (SELECT tf.doc_id, sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / s.avgdl))) AS score FROM tf JOIN df ON tf.term = df.term CROSS JOIN stats s GROUP BY tf.doc_id)"""
SPREAD = "(SELECT min(score) AS low, max(score) AS high, avg(score) AS mean, stddev_pop(score) AS deviation FROM bm)"

QUERIES = {
    "cosine_topk": f"SELECT doc_id AS vec_id, score FROM {VEC} v WHERE r <= 4 AND score >= 0.1",  # L
    "fts_topk": f"SELECT doc_id, n FROM {FTS} f WHERE r <= 9",  # L
    "rerank_topn": f"SELECT doc_id, round(n / (1.0 + r), 6) AS rerank FROM {FTS} f WHERE r <= 30 ORDER BY rerank DESC, doc_id LIMIT 5",  # L, a stated proxy stands for the model
    "random_sample_n": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7:', @text(doc_id))), doc_id) AS r FROM {documents}) q WHERE r <= 25",  # L
    "slow_query_top10": "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM {events}) q WHERE r <= 10",  # L
    "stratified_sample": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(@text(doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM {documents}) q WHERE r <= ceil(n * 0.1)",  # P
    "hard_case_select": "SELECT event_id FROM {events} WHERE event_type = 'error' OR value > 300 OR cast(@field(props|k) AS bigint) > 95",  # P
    "mixture_sample": "WITH q AS (SELECT * FROM (VALUES ('en', 100), ('de', 30), ('fr', 20), ('es', 10)) AS q(lang, quota)) SELECT d.lang, d.doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(@text(doc_id)), doc_id) AS r FROM {documents}) d JOIN q ON d.lang = q.lang WHERE d.r <= q.quota",  # P
    "difficulty_mix": "SELECT bucket, doc_id FROM (SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY md5(@text(doc_id)), doc_id) AS r FROM (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 4000 THEN 'medium' ELSE 'hard' END AS bucket FROM {documents}) b) q WHERE r <= CASE bucket WHEN 'easy' THEN 30 WHEN 'medium' THEN 50 ELSE 20 END",  # P
    "rejection_sample": "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM {events}) q WHERE r <= 2",  # P
    "experience_rank": f"""WITH used AS (SELECT vec_id, count(CASE WHEN label = qlabel THEN 1 END) / cast(count(*) AS double) AS success FROM {RANKED} r WHERE r <= 10 GROUP BY vec_id),
        traits AS (SELECT e.vec_id, coalesce(t.tags, 0) AS tags, exp(-(n.newest - e.vec_id) / 5000.0) AS recency, coalesce(u.success, 0.0) AS success FROM {{embeddings}} e CROSS JOIN (SELECT max(vec_id) AS newest FROM {{embeddings}}) n LEFT JOIN {TAGS} t ON t.doc_id = e.vec_id LEFT JOIN used u ON u.vec_id = e.vec_id)
        SELECT vec_id, relevance, qid FROM (SELECT vec_id, relevance, qid, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, vec_id) AS place FROM (SELECT s.vec_id, s.qid, round(0.2 * (CASE WHEN s.label = s.qlabel THEN 1 ELSE 0 END) + 0.4 * s.score + 0.15 * coalesce(bit_count(a.tags & q.tags) / cast(nullif(bit_count(a.tags | q.tags), 0) AS double), 0.0) + 0.1 * a.recency + 0.15 * a.success, 5) AS relevance
        FROM {SCORED} s JOIN traits a ON a.vec_id = s.vec_id JOIN traits q ON q.vec_id = s.qid) p) o WHERE place <= 5""",  # P, type, similarity, tags (keywords of the document), recency, and success where it was among the ten nearest
    "merge_boost": f"SELECT coalesce(v.doc_id, f.doc_id) AS id, CASE WHEN v.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN 'both' WHEN v.doc_id IS NULL THEN 'fts' ELSE 'embedding' END AS match_type, round(CASE WHEN v.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN least(1.0, v.score * 1.2) ELSE coalesce(v.score, 1.0 / (1 + f.r)) END, 5) AS similarity FROM (SELECT * FROM {VEC} a WHERE r <= 200) v FULL OUTER JOIN (SELECT * FROM {FTS} b WHERE r <= 200) f ON v.doc_id = f.doc_id",  # L
    "merge_prefix_dedup": "SELECT doc_id, channel, similarity FROM (SELECT doc_id, channel, similarity, row_number() OVER (ORDER BY similarity DESC, channel, doc_id) AS place FROM (SELECT u.doc_id, u.channel, u.similarity, row_number() OVER (PARTITION BY substring(d.text, 1, 50) ORDER BY u.channel, u.r, u.doc_id) AS k FROM (SELECT doc_id, 0 AS channel, score AS similarity, r FROM " + VEC + " v WHERE r <= 200 UNION ALL SELECT doc_id, 1 AS channel, round(1.0 / (1 + r), 5) AS similarity, r FROM " + FTS + " f WHERE r <= 200) u JOIN {documents} d ON u.doc_id = d.doc_id) q WHERE k = 1) p WHERE place <= 50",  # L, vectors before text
    "dedup_first": "WITH dirs AS (SELECT * FROM (VALUES ('a', 1, '/x/a'), ('a', 2, '/y/a'), ('b', 2, '/y/b'), ('c', 1, '/x/c'), ('c', 3, '/z/c')) AS d(slug, ord, path)) SELECT slug, min_by(path, ord) AS first_path, max_by(path, ord) AS last_path FROM dirs GROUP BY slug",  # L
    "dedup_exact_hash": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY md5(text)",  # P
    "dedup_composite_key": "SELECT conv_id, turn, min(role) AS role FROM (SELECT * FROM {conversations} UNION ALL SELECT * FROM {conversations} WHERE turn = 1) q GROUP BY conv_id, turn",  # P
    "conflict_resolve": "SELECT user_id, max_by(event_type, value) AS winner, count(DISTINCT event_type) > 1 AS conflict FROM {events} WHERE value > 50 GROUP BY user_id",  # P
    "bloom_membership": "SELECT n AS members, m AS bits, k AS hashes, round(power(1 - exp(-k * n / cast(m AS double)), k), 6) AS fpr, found FROM (SELECT n, n * 10 AS m, cast(round(10 * ln(2)) AS int) AS k FROM (SELECT count(DISTINCT doc_id) AS n FROM {labels}) a) b CROSS JOIN (SELECT count(*) AS found FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)) c",  # P, membership itself is an exact semi-join
    "repeat_paragraphs": "SELECT md5(line) AS line_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, @each(@split(text|\\n)) AS line FROM {documents}) q WHERE line <> '' GROUP BY md5(line) HAVING count(*) > 1",  # P
    "leakage_match": """WITH iw AS (SELECT item_id, @words(lower(text)) AS w FROM {benchmark}), ir AS (SELECT item_id, cast(count(*) OVER (PARTITION BY item_id) AS double) AS n, run FROM (SELECT DISTINCT item_id, @run(w|i|8) AS run FROM (SELECT item_id, w, @series(1|@size(w) - 7) AS i FROM iw WHERE @size(w) >= 8) a) b),
        dr AS (SELECT DISTINCT doc_id, @run(w|i|8) AS run FROM (SELECT doc_id, w, @series(1|@size(w) - 7) AS i FROM (SELECT doc_id, @words(lower(text)) AS w FROM {documents}) c WHERE @size(w) >= 8) d)
        SELECT dr.doc_id, ir.item_id, round(count(*) / max(ir.n), 6) AS share FROM dr JOIN ir ON dr.run = ir.run GROUP BY dr.doc_id, ir.item_id HAVING count(*) / max(ir.n) >= 0.5""",  # P, runs of eight words of whole texts
    "rrf": f"SELECT id, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT doc_id AS id, r FROM {VEC} v WHERE r <= 50 UNION ALL SELECT doc_id AS id, r FROM {FTS} f WHERE r <= 50) u GROUP BY id",  # L
    "bm25": f"WITH {BM25} SELECT doc_id, round(score, 5) AS score FROM bm",  # P
    "minmax": f"WITH {BM25} SELECT doc_id, round((score - low) / nullif(high - low, 0), 5) AS score FROM bm CROSS JOIN {SPREAD} s",  # P
    "zscore": f"WITH {BM25} SELECT doc_id, round((score - mean) / nullif(deviation, 0), 5) AS score FROM bm CROSS JOIN {SPREAD} s",  # P
    "score_fusion": f"WITH {BM25}, n AS (SELECT doc_id, score / high AS s FROM bm CROSS JOIN {SPREAD} t), v AS (SELECT a.vec_id AS doc_id, round(@dot(a.embedding|b.embedding), 5) AS score FROM {{embeddings}} a CROSS JOIN (SELECT embedding FROM {{embeddings}} WHERE vec_id = 0) b) SELECT v.doc_id, round(0.7 * v.score + 0.3 * coalesce(n.s, 0), 4) AS score FROM v LEFT JOIN n ON v.doc_id = n.doc_id",  # P
    "cascade_fusion": f"SELECT doc_id, score FROM (SELECT f.doc_id, v.score, row_number() OVER (ORDER BY v.score DESC, f.doc_id) AS k FROM {FTS} f JOIN {VEC} v ON f.doc_id = v.doc_id WHERE f.r <= 100) q WHERE k <= 10",  # P
    "recency_boost": "SELECT event_id, round(value * exp(-(newest - event_id) / 5000.0), 6) AS boosted FROM {events} CROSS JOIN (SELECT max(event_id) AS newest FROM {events}) n",  # P
    "inverse_freq_weight": "SELECT event_type, round(1.0 / ln(1 + count(*)), 8) AS weight FROM {events} GROUP BY event_type",  # P
    "memory_score": "SELECT event_id, round(0.5 * least(1, value / 100) + 0.3 * (CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.3 END) + 0.2 * exp(-(CASE event_type WHEN 'purchase' THEN 0.001 WHEN 'signup' THEN 0.002 ELSE 0.01 END) * (newest - event_id)), 6) AS score FROM {events} CROSS JOIN (SELECT max(event_id) AS newest FROM {events}) n",  # P, a rate of decay for each type
    "retention_score": "SELECT user_id, round(avg(value) * ln(1 + count(*)) * exp(-0.001 * (max(newest) - max(event_id))), 6) AS retention, user_id IN (1, 2, 3) AS pinned FROM {events} CROSS JOIN (SELECT max(event_id) AS newest FROM {events}) n GROUP BY user_id",  # P
    "router_score": "SELECT event_type, round(0.6 * avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END) + 10 / avg(value) + 0.1 / (1 + count(DISTINCT user_id)), 6) AS score FROM {events} GROUP BY event_type",  # P
    "recall_k": f"SELECT qid, count(CASE WHEN r <= 10 AND label = qlabel THEN 1 END) / cast(count(CASE WHEN label = qlabel THEN 1 END) AS double) AS recall FROM {RANKED} q GROUP BY qid".replace("count(CASE WHEN r", "round(count(CASE WHEN r").replace("AS double) AS recall", "AS double), 6) AS recall"),  # P
    "precision_k": f"SELECT qid, round(avg(CASE WHEN label = qlabel THEN 1.0 ELSE 0.0 END), 6) AS p10 FROM {RANKED} q WHERE r <= 10 GROUP BY qid",  # P
    "mrr": f"SELECT round(avg(1.0 / first_hit), 6) AS mrr FROM (SELECT qid, min(r) AS first_hit FROM {RANKED} q WHERE label = qlabel GROUP BY qid) f",  # P
    "ndcg": f"WITH q AS {RANKED}, rel AS (SELECT qid, count(CASE WHEN label = qlabel THEN 1 END) AS n FROM q GROUP BY qid), ideal AS (SELECT qid, sum(ln(2) / ln(i + 1)) AS best FROM rel JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS t(i)) t ON t.i <= rel.n GROUP BY qid) SELECT q.qid, round(sum(CASE WHEN q.label = q.qlabel THEN ln(2) / ln(q.r + 1) ELSE 0 END) / max(ideal.best), 6) AS ndcg FROM q LEFT JOIN ideal ON q.qid = ideal.qid WHERE q.r <= 10 GROUP BY q.qid",  # P, null where nothing is relevant
    "topk_per_label": f"SELECT qid, label, cast(min(r) AS bigint) AS best_rank FROM {RANKED} q GROUP BY qid, label",
    "dedup_keywords": "SELECT doc_id, @joined(term) AS terms FROM (SELECT DISTINCT doc_id, term FROM " + TOKENS + " t WHERE term IN ('that', 'the', 'tion', 'der', 'que')) q GROUP BY doc_id",  # L
    "dedup_tokens": "SELECT doc_id, count(DISTINCT term) AS n_distinct, count(*) AS n FROM " + TOKENS + " t GROUP BY doc_id",  # L
}
