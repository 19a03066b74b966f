"""Text, JSON, date and arithmetic scalars."""

MSG = "{conversations}"
QUERIES = {
    "redact_pii": "SELECT doc_id, md5(@replace_all(@replace_all(text|1[3-9][0-9]{{9}}|[PHONE])|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+|[EMAIL])) AS redacted FROM {documents}".replace("{{", "{").replace("}}", "}").replace("+@[A", "+[@][A"),  # L
    "tokenize_query": "SELECT conv_id, turn, @joined(t) AS tokens FROM (SELECT DISTINCT conv_id, turn, t FROM (SELECT conv_id, turn, @each(@split(@replace_all(text|[,.!?;:]| )|\\s+)) AS t FROM {conversations}) w WHERE length(t) >= 2) q GROUP BY conv_id, turn",  # L
    "fts_query_build": "SELECT conv_id, turn, @inorder(t|concat('\"', t, '\"')|' OR ') AS match FROM (SELECT DISTINCT conv_id, turn, t FROM (SELECT conv_id, turn, @each(@split(@replace_all(text|[,.!?;:]| )|\\s+)) AS t FROM {conversations}) w WHERE length(t) >= 2) q GROUP BY conv_id, turn",  # L, no token: no row
    "rank_normalize": "WITH r AS (SELECT * FROM (VALUES (-12.0), (-5.0), (0.0), (3.0)) AS r(rank)) SELECT rank, greatest(0.0, least(1.0, -rank / 10)) AS score FROM r".replace("SELECT rank,", "SELECT cast(rank AS double) AS rank,").replace("greatest(0.0", "greatest(0.0"),  # L
    "tech_keywords": "SELECT doc_id, @count_of(lower(text)|(token|password|license|http)) AS hits FROM {documents}",  # L
    "estimate_units": "SELECT conv_id, turn, greatest(1, cast(floor((28 + @chars(role) + @chars(text) + @count_of(text|[\"\\\\\\n\\r\\t\\x08\\x0c]) + 5 * @count_of(text|[\\x01-\\x07\\x0b\\x0e-\\x1f])) / 4) AS bigint)) AS units FROM {conversations}",  # E, 28 characters of frame, and what JSON escapes
    "estimate_tokens_cjk": "SELECT doc_id, cast(ceil(1.5 * @count_of(text|[\\x{4e00}-\\x{9fff}]) + 0.25 * (@chars(text) - @count_of(text|[\\x{4e00}-\\x{9fff}]))) AS bigint) AS tokens FROM {documents}",  # L
    "truncate_ratio": "SELECT doc_id, concat(substring(text, 1, cast(floor(n_chars * 0.5 * 0.9) AS int)), '...') AS cut FROM {documents} WHERE n_chars > 2000",  # L
    "truncate_middle": "SELECT doc_id, concat(substring(text, 1, 100), ' [...] ', right(text, 100)) AS cut FROM {documents} WHERE n_chars > 200",  # L
    "chunk_window": "SELECT doc_id, start_at, @chars(substring(text, cast(start_at AS int) + 1, 512)) AS chunk_chars, md5(substring(text, cast(start_at AS int) + 1, 512)) AS chunk FROM (SELECT doc_id, text, i * 448 AS start_at FROM (SELECT doc_id, text, @series(0|cast(floor((n_chars - 1) / 448) AS bigint)) AS i FROM {documents} WHERE n_chars > 0) a) q",  # L
    "chunk_parent_child": "SELECT doc_id, parent, child, md5(substring(text, cast(parent * 1000 + child * 250 + 1 AS int), 250)) AS chunk FROM (SELECT doc_id, text, n_chars, cast(floor(i / 4) AS bigint) AS parent, i % 4 AS child, i FROM (SELECT doc_id, text, n_chars, @series(0|cast(floor((n_chars - 1) / 250) AS bigint)) AS i FROM {documents} WHERE n_chars > 0) a) q",  # P
    "contextual_prefix": "SELECT doc_id, concat('[', source, '/', lang, '] ', substring(text, 1, 200)) AS chunk FROM {documents}",  # L, the prefix is ours
    "detect_format": "SELECT conv_id, turn, (CASE WHEN @matches(text|(?i)question) THEN 1 ELSE 0 END + CASE WHEN @matches(text|(?i)answer) THEN 1 ELSE 0 END + CASE WHEN @matches(text|: ) THEN 1 ELSE 0 END + CASE WHEN @matches(text|[?]) THEN 1 ELSE 0 END + CASE WHEN @matches(text|\\n) THEN 1 ELSE 0 END) >= 2 AS labelled FROM {conversations}",  # L
    "labelled_transcript": "SELECT conv_id, md5(@inorder(turn|concat('[', role, '] ', text)|@blank_line())) AS transcript FROM {conversations} GROUP BY conv_id",  # L
    "trigger_match": "WITH skills AS (SELECT * FROM (VALUES (1, 'that'), (2, 'que'), (3, 'der')) AS s(ord, word)) SELECT c.conv_id, c.turn, min_by(s.word, s.ord) AS skill FROM {conversations} c JOIN skills s ON c.text LIKE concat('%', s.word, '%') GROUP BY c.conv_id, c.turn",  # L
    "fillers": "WITH f AS (SELECT * FROM (VALUES (' the '), (' that '), (' de ')) AS f(word)) SELECT f.word, count(*) AS segments, min(c.conv_id) AS first_conv FROM f JOIN {conversations} c ON c.text LIKE concat('%', f.word, '%') GROUP BY f.word",  # L
    "wpm": "SELECT conv_id, cast(floor(sum(@size(@words(text))) / nullif(count(*) * 0.5, 0) + 0.5) AS bigint) AS wpm FROM {conversations} GROUP BY conv_id",  # L
    "text_pipeline": "SELECT conv_id, turn, @size(@words(text)) AS n_words, CASE WHEN @chars(text) > 50 THEN concat(substring(text, 1, 50), '...') ELSE text END AS summary FROM {conversations}",  # L
    "sentiment_lexicon": "WITH fb AS (SELECT * FROM (VALUES (1, 'great and good service'), (2, 'bad, terrible'), (3, 'good but bad')) AS f(id, t)), s AS (SELECT id, CASE WHEN t LIKE '%great%' THEN 1 ELSE 0 END + CASE WHEN t LIKE '%good%' THEN 1 ELSE 0 END AS pos, CASE WHEN t LIKE '%bad%' THEN 1 ELSE 0 END + CASE WHEN t LIKE '%terrible%' THEN 1 ELSE 0 END AS neg FROM fb) SELECT id, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment FROM s",  # L
    "bmi": "WITH p AS (SELECT * FROM (VALUES ('a', 170.0, 65.0), ('b', 180.0, 100.0), ('c', 160.0, 45.0), ('d', 175.0, 84.0)) AS p(name, h, w)), b AS (SELECT name, round(w / ((h / 100) * (h / 100)), 2) AS bmi FROM p) SELECT name, bmi, CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 24.9 THEN 'normal' WHEN bmi < 29.9 THEN 'overweight' ELSE 'obese' END AS bmi_class FROM b",  # L
    "bmi_class": "WITH p AS (SELECT * FROM (VALUES (18.4), (18.5), (24.9), (29.9), (30.0)) AS p(b)) SELECT cast(b AS double) AS bmi, CASE WHEN b < 18.5 THEN 'underweight' WHEN b < 24.9 THEN 'normal' WHEN b < 29.9 THEN 'overweight' ELSE 'obese' END AS bmi_class FROM p",  # L
    "advice": "WITH p AS (SELECT * FROM (VALUES ('a', 170.0, 65.0), ('b', 180.0, 100.0), ('c', 160.0, 45.0), ('d', 175.0, 84.0), ('e', 0.0, 84.0)) AS p(name, h, w)), b AS (SELECT name, CASE WHEN h > 0 AND h <= 300 AND w > 0 AND w <= 500 THEN round(w / ((h / 100) * (h / 100)), 2) END AS bmi FROM p WHERE h > 0 UNION ALL SELECT name, NULL AS bmi FROM p WHERE h <= 0), m AS (SELECT * FROM (VALUES ('underweight', 'more nutrition and strength training'), ('normal', 'keep the habits, regular check-ups'), ('overweight', '150 minutes of aerobic exercise a week'), ('obese', 'a weight plan with a doctor')) AS m(c, advice)) SELECT b.name, m.c AS category, m.advice FROM b LEFT JOIN m ON m.c = CASE WHEN b.bmi < 18.5 THEN 'underweight' WHEN b.bmi < 24.9 THEN 'normal' WHEN b.bmi < 29.9 THEN 'overweight' WHEN b.bmi IS NOT NULL THEN 'obese' END",  # L, an earlier error leaves the later steps out
    "cricket_levels": "WITH p AS (SELECT * FROM (VALUES ('x', 55.0, 20.0, 9.0), ('y', 30.0, 35.0, 5.0), ('z', 10.0, 50.0, 2.0)) AS p(name, bat, bowl, field)) SELECT name, CASE WHEN bat >= 50 THEN 'top' WHEN bat >= 25 THEN 'mid' ELSE 'low' END AS batting, CASE WHEN bowl <= 25 THEN 'top' WHEN bowl <= 40 THEN 'mid' ELSE 'low' END AS bowling FROM p",  # L
    "cricket_score": "WITH p AS (SELECT * FROM (VALUES ('x', 55.0, 20.0, 9.0), ('y', 30.0, 35.0, 5.0)) AS p(name, bat, bowl, field)) SELECT name, round(0.4 * bat + 0.4 * (100 - bowl) + 0.2 * field * 10, 4) AS score FROM p",  # L
    "outline_gate": "SELECT page_id, @count_of(html|<p>) >= 3 AS enough FROM {pages}",  # L
    "skill_glob_match": "SELECT page_id FROM {pages} WHERE @matches(url|^https?://[^/]*[.]example[.]org/.*[0-9]$)",  # L
    "kb_substring_lookup": "WITH kb AS (SELECT * FROM (VALUES (1, 'tion', 'A'), (2, 'the', 'B'), (3, 'de', 'C')) AS k(ord, needle, answer)) SELECT c.conv_id, c.turn, min_by(k.answer, k.ord) AS answer FROM {conversations} c LEFT JOIN kb k ON c.text LIKE concat('%', k.needle, '%') GROUP BY c.conv_id, c.turn",  # L
    "hash_key16": "SELECT doc_id, substring(@sha256(concat('{\"source\":\"', source, '\",\"lang\":\"', lang, '\",\"n_chars\":', @text(n_chars), '}')), 1, 16) AS cache_key FROM {documents}",  # L
    "ab_bucket": "SELECT user_id, @hash_unit(concat(@text(user_id), ':exp1')) < 0.5 AS in_a FROM (SELECT DISTINCT user_id FROM {events}) u",  # P
    "json_parse_safe": "SELECT event_id, @is_json(raw) AS ok, CASE WHEN @is_json(raw) THEN NULL ELSE 'invalid_json' END AS error, CASE WHEN @is_json(raw) THEN @field(raw|k) END AS k FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substring(props, 1, 4) ELSE props END AS raw FROM {events}) q",  # E
    "json_col_read": "SELECT event_id, cast(@field(props|k) AS bigint) AS k FROM {events} WHERE event_type = 'click'",  # L
    "json_contains": "SELECT event_id FROM {events} WHERE @field(props|k) = '42'",  # L
    "schema_map": "SELECT event_id, upper(event_type) AS kind, cast(@field(props|k) AS bigint) * 10 AS scaled, @day(ts) AS day FROM {events}",  # P
    "append_reduce": "SELECT user_id, @inorder(event_id|concat(substring(event_type, 1, 2), @text(event_id))|',') AS merged FROM {events} GROUP BY user_id",  # L, branches in order of their id
    "profile_merge": "SELECT user_id, @inorder(event_type|concat(event_type, '=', @text(k))|';') AS profile FROM (SELECT user_id, event_type, max_by(cast(@field(props|k) AS bigint), value * 1000000.0 + event_id / 1000000.0) AS k FROM {events} GROUP BY user_id, event_type) q GROUP BY user_id",  # L, of a field the entry of most confidence wins
    "set_append_cap5": "SELECT user_id, @inorder(first_at|@text(k)|',') AS kept FROM (SELECT user_id, k, first_at, row_number() OVER (PARTITION BY user_id ORDER BY first_at DESC) AS r FROM (SELECT user_id, cast(@field(props|k) AS bigint) AS k, min(event_id) AS first_at FROM {events} GROUP BY user_id, cast(@field(props|k) AS bigint)) u) q WHERE r <= 5 GROUP BY user_id",  # L
    "cosine": "SELECT a.vec_id, round(@dot(a.embedding|b.embedding) / nullif(sqrt(@dot(a.embedding|a.embedding)) * sqrt(@dot(b.embedding|b.embedding)), 0), 4) AS cosine FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1",  # L
    "em_f1_rouge": "WITH ans AS (SELECT * FROM (VALUES (1, 'a b c'), (2, 'x y'), (3, 'k')) AS a(id, t)), ref AS (SELECT * FROM (VALUES (1, 'a c d'), (2, 'x y'), (3, 'm n')) AS r(id, t)), o AS (SELECT a.id, count(*) AS n FROM (SELECT id, @each(@words(t)) AS w FROM ans) a JOIN (SELECT id, @each(@words(t)) AS w FROM ref) r ON a.id = r.id AND a.w = r.w GROUP BY a.id) SELECT ans.id, ans.t = ref.t AS em, round(2.0 * coalesce(o.n, 0) / (@size(@words(ans.t)) + @size(@words(ref.t))), 6) AS f1 FROM ans JOIN ref ON ans.id = ref.id LEFT JOIN o ON ans.id = o.id",  # P
    "backoff_delay": "WITH a AS (SELECT @series(0|8) AS attempt) SELECT attempt, least(500 * power(2.0, attempt), 30000.0) AS delay_ms FROM a",  # L
    "cost": "SELECT conv_id, round(sum(CASE WHEN role = 'assistant' THEN @chars(text) * 15.0 ELSE @chars(text) * 3.0 END) / 4000000, 8) AS cost FROM {conversations} GROUP BY conv_id",  # L
    "logprob_conf": "WITH l AS (SELECT * FROM (VALUES (1, -0.5), (2, 0.0), (3, -2.0)) AS l(id, lp)) SELECT id, round(exp(nullif(cast(lp AS double), 0)), 6) AS confidence FROM l",  # L
    "token_demand": "SELECT count(DISTINCT user_id) AS dau, round(count(DISTINCT user_id) * 0.3 * 5 * 800, 2) AS tokens FROM {events}",  # P
    "duration_hours": "SELECT user_id, cast(floor((max(@micros(ts)) - min(@micros(ts))) / 3600000000) AS bigint) AS hours FROM {events} GROUP BY user_id",
}
