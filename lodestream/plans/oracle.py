"""DuckDB SQL for the queries of the core: the same rows by another engine and, where it matters, another plan."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.social import COMPLAINT, NEGATIVE, POSITIVE, query_variants

# Domains and the words that call for them.
DOMAINS = {
    "battery": ("battery", "电池"),
    "audit": ("auditors", "审计"),
    "alarms": ("alarms", "告警"),
    "sensor": ("sensor", "传感器"),
    "batch": ("batch", "批次"),
}


def tok(c: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN regexp_matches(w, '[一-鿿]') THEN regexp_extract_all(w, '[一-鿿]') ELSE [w] END))"


def bm25(docs: str, key: str, k: int, by: str = "") -> str:
    """WITH parts ending in ``ranked`` (query, key, score, rank); docs: SELECT key, body."""
    return f"""
    d{by} AS ({docs}),
    t{by} AS (SELECT {key} AS doc, {tok("coalesce(body, '')")} AS t FROM d{by}),
    n{by} AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t{by}),
    q{by} AS (SELECT query, term, count(*) AS times FROM (SELECT id AS query, unnest({tok("query")}) AS term FROM rag_eval_cases) GROUP BY ALL),
    f{by} AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM t{by}) WHERE term IN (SELECT term FROM q{by}) GROUP BY ALL),
    df{by} AS (SELECT term, count(*) AS df FROM f{by} GROUP BY ALL),
    s{by} AS (SELECT query, doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
            FROM f{by} JOIN df{by} USING (term) JOIN q{by} USING (term), n{by} GROUP BY ALL),
    ranked{by} AS (SELECT query, doc AS {key}, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s{by} WHERE score > 0 QUALIFY rank <= {k})"""


def words(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in terms) + ")"


def vectors(metric: str) -> str:
    d = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    s = {"cosine": "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "ip": d, "l2": "-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"}[metric]
    return f"""SELECT query, vec_id, score, rank FROM (
      SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT b.vec_id AS query, a.vec_id, round({s}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {{k}}"""


def embedded(docs: str, key: str) -> str:
    return rf"""SELECT {key}, pos, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS value FROM (
      SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS pos, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(1 + len(tok)::DOUBLE))) AS v
      FROM (SELECT {key}, tok, sha256(tok) AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}\p{{N}}_]+')) AS tok FROM ({docs})))
      GROUP BY ALL)"""


def shared(q: str, t: str) -> str:
    return f"CASE WHEN len(list_distinct({tok(q)})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct({tok(q)}), {tok(t)}))::DOUBLE / len(list_distinct({tok(q)})) END"


POSTS = "posts AS (SELECT * FROM bulk_mock_posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, coalesce(engagement.views, -1) DESC, coalesce(engagement.likes, -1) DESC) = 1)"
_LIST = "array_to_string(coalesce({0}, []), ' ')"
SIGNALS = f"""{POSTS},
  sig0 AS (SELECT *, lower(concat_ws(' ', coalesce(type, ''), coalesce(platform, ''), coalesce(title, ''), coalesce(content, ''), {_LIST.format("tags")}, {_LIST.format("metadata.keywords")})) AS signal,
     coalesce(engagement.likes, 0) + coalesce(engagement.comments, 0) + coalesce(engagement.shares, 0) + coalesce(engagement.views, 0) AS engagement_total FROM posts),
  sig AS (SELECT *, CASE WHEN lower(coalesce(sentiment, 'unknown')) IN ('negative', 'neg', '负面') THEN 'negative' WHEN lower(coalesce(sentiment, 'unknown')) IN ('positive', 'pos', '正面') THEN 'positive'
     WHEN lower(coalesce(sentiment, 'unknown')) IN ('neutral', 'neu', '中性') THEN 'neutral' WHEN {words("signal", NEGATIVE)} THEN 'negative' WHEN {words("signal", POSITIVE)} THEN 'positive' ELSE 'unknown' END AS sentiment_label,
     {words("signal", COMPLAINT)} AS is_complaint FROM sig0)"""
HAY = f"lower(concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(author, ''), coalesce(platform, ''), {_LIST.format('tags')}, {_LIST.format('metadata.keywords')}))"
FAQ = """faq AS (SELECT faq_id, source, title, coalesce(content, '') AS content FROM media_response_faq QUALIFY row_number() OVER (PARTITION BY faq_id ORDER BY updated_at DESC, coalesce(content, '') DESC) = 1),
  faqs AS (SELECT *, concat_ws('\n', CASE WHEN len(title) > 0 THEN 'title: ' || title END, CASE WHEN len(source) > 0 THEN 'source: ' || source END) AS context, concat_ws('\n', title, content) AS body FROM faq)"""
LISTS = f"""{FAQ}, {bm25("SELECT faq_id, body FROM faqs", "faq_id", 20)},
  ed AS ({embedded("SELECT faq_id, body FROM faqs", "faq_id")}),
  eq AS ({embedded("SELECT id, query AS body FROM rag_eval_cases", "id")}),
  es AS (SELECT id AS query, faq_id, round(coalesce(dot, 0), 6) AS score FROM rag_eval_cases CROSS JOIN faqs LEFT JOIN (SELECT eq.id, faq_id, sum(ed.value * eq.value) AS dot FROM ed JOIN eq USING (pos) GROUP BY ALL) USING (id, faq_id)),
  er AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, faq_id) AS rank FROM es QUALIFY rank <= 20)"""
FUSED = f"""{LISTS},
  fu AS (SELECT query, faq_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query, faq_id, rank FROM ranked UNION ALL SELECT query, faq_id, rank FROM er) GROUP BY ALL),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, faq_id) AS rank FROM fu QUALIFY rank <= 20)"""
BOOSTED = f"""{FUSED},
  hit AS (SELECT f.query, f.faq_id, f.score AS rrf, r.score AS keyword_score, faqs.source, faqs.title, faqs.content, faqs.context, c.query AS query_text
      FROM fused f LEFT JOIN ranked r USING (query, faq_id) JOIN faqs USING (faq_id) JOIN rag_eval_cases c ON c.id = f.query),
  boost AS (SELECT *, {shared("query_text", "context")} AS ss FROM hit)"""
STATUS = """CASE WHEN contains(lower(coalesce(source, '')), 'misleading_archive') THEN CASE WHEN contains(lower(coalesce(title, '')), 'negative misleading notes') OR contains(lower({0}), 'unanswerable_trap') THEN 'unanswerable_trap' ELSE 'misleading' END
  WHEN contains(lower(coalesce(title, '')), 'deprecated') OR contains(lower(coalesce(title, '')), 'retired') OR regexp_matches(lower({0}), '\\[deprecated\\]|\\[retired\\]|\\[do_not_use\\]|\\[misleading\\]|\\[false_claim\\]|do not use this draft|do not use this snippet') THEN 'deprecated' ELSE 'authoritative' END"""
PENALTY = "CASE s WHEN 'authoritative' THEN 0.0 WHEN 'deprecated' THEN -4.0 WHEN 'misleading' THEN -8.0 WHEN 'unanswerable_trap' THEN -10.0 ELSE -1.0 END"
FINAL = f"""{BOOSTED},
  st AS (SELECT *, round(rrf + 0.15 * ss, 6) AS boosted, {shared("query_text", "concat_ws(chr(10), context, content)")} AS rr, {STATUS.format("content")} AS s FROM boost),
  fin AS (SELECT *, round(round(rr, 6) + {PENALTY}, 6) AS score FROM st),
  best AS (SELECT query, faq_id, score, title, source, content, row_number() OVER (PARTITION BY query ORDER BY score DESC, faq_id) AS rank FROM fin
      WHERE s NOT IN ('misleading', 'unanswerable_trap') AND (round(rr, 6) > 0 OR score > 0.10 OR coalesce(keyword_score, 0) > 0) QUALIFY rank <= 5)"""
EXCERPT = r"CASE WHEN len({0}) <= 500 THEN {0} ELSE rtrim(substr({0}, 1, 497)) || '...' END"
TERMS = rf"""m AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, trim(lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_-]+|[一-鿿]+'))), '_-') AS term FROM documents)
      WHERE len(term) >= 2 AND term NOT IN ({", ".join(repr(w) for w in STOPWORDS)})),
  df AS (SELECT term, count(*) AS df FROM m GROUP BY ALL),
  i AS (SELECT term, df, ln(1 + ((SELECT count(*) FROM documents)::DOUBLE - df + 0.5) / (df + 0.5)) AS idf FROM df),
  th AS (SELECT idf AS threshold FROM (SELECT idf, row_number() OVER (ORDER BY idf) AS r, count(*) OVER () AS n FROM i) WHERE r = least(floor(n * 50 / 100)::BIGINT, n - 1) + 1),
  kept AS (SELECT term, df, idf, threshold FROM i, th WHERE idf >= threshold)"""
NEAR = f"""{TERMS}, mk AS (SELECT doc_id, term FROM m JOIN kept USING (term)),
  near AS (SELECT a.doc_id AS seed, b.doc_id, count(*) AS shared FROM mk a JOIN mk b USING (term) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)"""
UPSERTED = "up AS (SELECT memory_id, min(created_at) AS created_at, count(*) AS versions, max(updated_at) AS updated_at, arg_max(index_status, (updated_at, index_status)) AS index_status, any_value(record_type) AS record_type FROM memories GROUP BY memory_id)"
USAGE = "u AS (SELECT event_id, user_id, event_type, value, ts, 1 AS model_calls, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS tool_calls, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS total_tokens FROM events)"
RUN = f"""r AS ({vectors("cosine").format(k=10)}),
  want AS (SELECT a.vec_id AS query, b.vec_id AS item FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  g AS (SELECT r.query, r.vec_id AS item, r.rank, want.item IS NOT NULL AS ok FROM r LEFT JOIN want ON want.query = r.query AND want.item = r.vec_id WHERE rank <= 5),
  n AS (SELECT query, count(*) AS wanted FROM want GROUP BY ALL),
  cm AS (SELECT n.query, CASE WHEN count(DISTINCT item) FILTER (ok) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(count(DISTINCT item) FILTER (ok)::DOUBLE / wanted, 6) AS recall,
      round(coalesce(count(*) FILTER (ok)::DOUBLE / nullif(count(item), 0), 0), 6) AS precision, round(coalesce(1.0::DOUBLE / min(rank) FILTER (ok), 0), 6) AS mrr FROM n LEFT JOIN g USING (query) GROUP BY n.query, wanted)"""

MATCHING = f"""{SIGNALS},
  ma AS (SELECT *, try_cast(nullif(regexp_extract(published_at, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS day FROM sig WHERE contains({HAY}, 'battery')),
  mt AS (SELECT * FROM ma WHERE day IS NULL OR day BETWEEN DATE '2025-10-01' AND DATE '2026-06-30')"""
_WORDS = "SELECT trim(unnest(list_concat(coalesce(tags, []), coalesce(metadata.keywords, [])))) AS name FROM mt WHERE {0}"
_RANKED = "SELECT '{0}' AS section, name, row_number() OVER (ORDER BY value DESC, name) AS position, value FROM ({1}) QUALIFY position <= {2}"
_TOP_WORDS = "SELECT name, count(*)::DOUBLE AS value FROM ({0}) WHERE len(name) > 0 GROUP BY ALL"
REPORT = f"""{MATCHING},
  mg AS (SELECT count(*) AS posts, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (is_complaint) AS complaints, sum(engagement_total)::BIGINT AS total_engagement,
    coalesce(sum(engagement_total) FILTER (sentiment_label = 'negative'), 0)::BIGINT AS negative_engagement FROM mt),
  mr AS (SELECT *, round(negative::DOUBLE / posts, 4) AS negative_ratio FROM mg),
  ms AS (SELECT *, least(100, round_even(negative_ratio * 55 + least(complaints * 8, 25) + least(negative_engagement::DOUBLE / 1000, 15) + CASE WHEN negative_ratio > 0 OR complaints > 0 OR negative_engagement > 0 THEN least(total_engagement::DOUBLE / 2000, 10) ELSE least(total_engagement::DOUBLE / 5000, 5) END, 0))::BIGINT AS score FROM mr WHERE posts > 0),
  rp AS (SELECT 'sentiment' AS section, sentiment_label AS name, NULL::BIGINT AS position, count(*)::DOUBLE AS value FROM mt GROUP BY ALL
    UNION ALL SELECT 'platform', coalesce(platform, 'unknown'), NULL, count(*) FROM mt GROUP BY ALL
    UNION ALL SELECT 'day', day::VARCHAR, NULL, count(*) FROM mt WHERE day IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'total', name, NULL, value FROM (SELECT unnest(['posts', 'negative', 'negative_ratio', 'complaints', 'total_engagement', 'negative_engagement', 'score']) AS name, unnest([posts::DOUBLE, negative, negative_ratio, complaints, total_engagement, negative_engagement, score]) AS value FROM ms)
    UNION ALL SELECT 'level', CASE WHEN negative_ratio >= 0.6 OR complaints >= 10 OR negative_engagement >= 10000 THEN 'critical' WHEN negative_ratio >= 0.45 OR complaints >= 3 OR negative_engagement >= 3000 THEN 'high' WHEN negative_ratio >= 0.25 OR complaints >= 1 OR negative_engagement >= 800 THEN 'medium' ELSE 'low' END, NULL, NULL FROM ms
    UNION ALL SELECT 'heat_level', CASE WHEN total_engagement >= 100000 THEN 'critical' WHEN total_engagement >= 30000 THEN 'high' WHEN total_engagement >= 3000 THEN 'medium' ELSE 'low' END, NULL, NULL FROM ms
    UNION ALL {_RANKED.format("keyword", _TOP_WORDS.format(_WORDS.format("true")), 20)}
    UNION ALL {_RANKED.format("post", "SELECT id AS name, engagement_total::DOUBLE AS value FROM mt", 5)})"""


def graph_of(docs: str, key: str, p: str) -> str:
    """Terms of (key, body) rows: {p}m all, {p}k informative ones."""
    return rf"""{p}m AS (SELECT DISTINCT {key}, term FROM (SELECT {key}, trim(lower(unnest(regexp_extract_all(coalesce(body, ''), '[A-Za-z][A-Za-z0-9_-]+|[一-鿿]+'))), '_-') AS term FROM ({docs}))
      WHERE len(term) >= 2 AND term NOT IN ({", ".join(repr(w) for w in STOPWORDS)})),
  {p}d AS (SELECT term, count(*) AS df FROM {p}m GROUP BY ALL),
  {p}i AS (SELECT term, ln(1 + ((SELECT count(*) FROM ({docs}))::DOUBLE - df + 0.5) / (df + 0.5)) AS idf FROM {p}d),
  {p}t AS (SELECT idf AS threshold FROM (SELECT idf, row_number() OVER (ORDER BY idf) AS r, count(*) OVER () AS n FROM {p}i) WHERE r = least(floor(n * 50 / 100)::BIGINT, n - 1) + 1),
  {p}k AS (SELECT {key}, term FROM {p}m JOIN {p}i USING (term), {p}t WHERE idf >= threshold)"""


EXPANDED = rf"""{FUSED}, {graph_of("SELECT faq_id, body FROM faqs", "faq_id", "g")},
  gco AS (SELECT query, max(n)::DOUBLE / sum(n) AS concentration FROM (SELECT query, source, count(*) AS n FROM fused JOIN faqs USING (faq_id) WHERE rank <= 4 GROUP BY ALL) GROUP BY ALL),
  gn AS (SELECT max(df)::DOUBLE AS n FROM gd),
  gin AS (SELECT query, avg(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(n + 1)) AS informativeness FROM (SELECT DISTINCT query, term FROM fused JOIN gm USING (faq_id) WHERE rank <= 3) JOIN gd USING (term), gn GROUP BY query),
  gw AS (SELECT id AS query, list_filter(regexp_split_to_array(trim(query), '\s+'), lambda x: len(x) > 0) AS w FROM rag_eval_cases),
  gs AS (SELECT query, len(list_filter(w, lambda x: len(x) >= 5 OR (len(x) >= 2 AND regexp_matches(x, '^\p{{Lu}}'))))::DOUBLE / len(w) AS specificity FROM gw),
  go AS (SELECT query FROM gs JOIN gco USING (query) LEFT JOIN gin USING (query) WHERE (specificity >= 0.3)::INT + (concentration >= 0.5)::INT + (coalesce(informativeness, 0) >= 0.3)::INT >= 2),
  gp AS (SELECT a.faq_id AS seed, b.faq_id, count(*) AS shared FROM gk a JOIN gk b USING (term) WHERE a.faq_id <> b.faq_id GROUP BY ALL),
  gc AS (SELECT query, gp.faq_id, round(0.35 * greatest(score, 0.1) * least(1.0::DOUBLE, shared::DOUBLE / 3), 6) AS g, shared FROM fused JOIN go USING (query) JOIN gp ON gp.seed = fused.faq_id WHERE score > 0 AND round(0.5 * least(1.0::DOUBLE, shared::DOUBLE / 3) + 0.5, 4) >= 0.15),
  gb AS (SELECT query, faq_id, g, shared FROM gc QUALIFY row_number() OVER (PARTITION BY query, faq_id ORDER BY g DESC, shared DESC) = 1),
  gbest AS (SELECT query, faq_id, g AS graph_score FROM gb QUALIFY row_number() OVER (PARTITION BY query ORDER BY g DESC, shared DESC, faq_id) <= 4),
  ge AS (SELECT query, faq_id, greatest(f.score, gbest.graph_score) AS score, gbest.graph_score FROM fused f FULL JOIN gbest USING (query, faq_id))"""

SQL: dict[str, str] = {
    "public_report": f"WITH {REPORT} SELECT * FROM rp",
    "opinion_snapshot": f"""WITH {REPORT} SELECT * FROM rp UNION ALL {_RANKED.format("negative_keyword", _TOP_WORDS.format(_WORDS.format("sentiment_label = 'negative' OR is_complaint")), 20)}
      UNION ALL SELECT 'complaint', id, row_number() OVER (ORDER BY day DESC NULLS LAST, id) AS position, NULL FROM mt WHERE sentiment_label = 'negative' OR is_complaint QUALIFY position <= 5""",
    "posts_between": f"WITH {MATCHING} SELECT id, day::VARCHAR AS day FROM mt ORDER BY mt.day DESC NULLS LAST, id LIMIT 20 OFFSET 10",
    "result_cursors": f"""WITH {POSTS}, c AS (SELECT *, CASE WHEN regexp_full_match(cursor, '\\d+') THEN cursor::BIGINT ELSE 0 END AS o FROM (SELECT platform, count(*) AS total, unnest(['0', '40', 'x1', '', '9000000']) AS cursor FROM posts WHERE platform IS NOT NULL GROUP BY platform))
      SELECT platform, cursor, o AS "at", CASE WHEN least(o + 40, total) < total THEN least(o + 40, total)::VARCHAR END AS next FROM c""",
    "author_platforms": f"WITH {SIGNALS} SELECT author_id, coalesce(platform, 'unknown') AS platform, sentiment_label, count(*) AS posts FROM sig WHERE author_id IS NOT NULL GROUP BY ALL",
    "author_first_posts": f"WITH {POSTS} SELECT author_id, id, row_number() OVER (PARTITION BY author_id ORDER BY id) AS rank FROM posts WHERE author_id IS NOT NULL QUALIFY rank <= 5",
    "risk_reasons": f"""WITH {SIGNALS}, g AS (SELECT coalesce(platform, 'unknown') AS platform, round(count(*) FILTER (sentiment_label = 'negative')::DOUBLE / count(*), 4) AS r, count(*) FILTER (is_complaint) AS c, sum(engagement_total)::BIGINT AS e, coalesce(sum(engagement_total) FILTER (sentiment_label = 'negative'), 0)::BIGINT AS ne FROM sig GROUP BY ALL)
      SELECT platform, concat_ws('; ', CASE WHEN r <> 0 THEN 'negative_ratio=' || r END, CASE WHEN e <> 0 THEN 'total_engagement=' || e END, CASE WHEN c <> 0 THEN 'complaint_count=' || c END, CASE WHEN ne <> 0 THEN 'negative_engagement=' || ne END, CASE WHEN e <> 0 AND r = 0 AND c = 0 AND ne = 0 THEN 'high_heat_without_negative_signal' END) AS reasons FROM g""",
    "graph_expand": f"WITH {EXPANDED} SELECT query, faq_id, score, graph_score FROM ge",
    "graph_expand_once": f"""WITH {FUSED}, {graph_of("SELECT faq_id, body FROM faqs", "faq_id", "g")}, a AS (SELECT DISTINCT query, term FROM fused JOIN gk USING (faq_id)), ts AS (SELECT query, max(score) AS s FROM fused GROUP BY ALL),
      nn AS (SELECT query, faq_id, count(*) AS shared FROM a JOIN gk USING (term) GROUP BY ALL)
      SELECT query, faq_id, round(0.35 * greatest(s, 0.1) * least(1.0::DOUBLE, shared::DOUBLE / 3), 6) AS score FROM nn JOIN ts USING (query) ANTI JOIN fused USING (query, faq_id) WHERE round(0.5 * least(1.0::DOUBLE, shared::DOUBLE / 3) + 0.5, 4) >= 0.15 AND s > 0""",
    "hybrid_graph_topk": f"""WITH {EXPANDED},
      hit AS (SELECT g.query, g.faq_id, g.score AS rrf, r.score AS keyword_score, faqs.source, faqs.title, faqs.content, faqs.context, c.query AS query_text FROM ge g LEFT JOIN ranked r USING (query, faq_id) JOIN faqs USING (faq_id) JOIN rag_eval_cases c ON c.id = g.query),
      st AS (SELECT *, round(rrf + 0.15 * {shared("query_text", "context")}, 6) AS boosted, round({shared("query_text", "concat_ws(chr(10), context, content)")}, 6) AS rr, {STATUS.format("content")} AS s FROM hit),
      fin AS (SELECT *, round(rr + {PENALTY}, 6) AS score FROM st)
      SELECT query, faq_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, faq_id) AS rank FROM fin WHERE s NOT IN ('misleading', 'unanswerable_trap') AND (rr > 0 OR score > 0.10 OR coalesce(keyword_score, 0) > 0) QUALIFY rank <= 5""",
    "graph_effect": f"""WITH {LISTS}, want AS (SELECT DISTINCT query, faq_id FROM (SELECT id AS query, unnest(list_distinct({tok("query")})) AS term FROM rag_eval_cases) JOIN (SELECT faq_id, unnest(list_distinct({tok("context")})) AS term FROM faqs) USING (term) WHERE len(term) > 6),
      new AS (SELECT query, max(CASE WHEN w.faq_id IS NOT NULL THEN 1 ELSE 0 END) AS good FROM er ANTI JOIN ranked USING (query, faq_id) LEFT JOIN want w USING (query, faq_id) GROUP BY query),
      j AS (SELECT q.query, r0, r1, good FROM (SELECT DISTINCT query FROM want) q LEFT JOIN (SELECT query, min(rank) AS r0 FROM ranked JOIN want USING (query, faq_id) GROUP BY ALL) USING (query) LEFT JOIN (SELECT query, min(rank) AS r1 FROM er JOIN want USING (query, faq_id) GROUP BY ALL) USING (query) LEFT JOIN new USING (query)),
      b AS (SELECT avg((coalesce(good, 0) = 1 AND r0 IS NULL)::INT::DOUBLE) AS b, avg((coalesce(good, 1) = 0)::INT::DOUBLE) AS n, avg((r0 - r1)::DOUBLE) AS c FROM j)
      SELECT round(b, 6) AS benefit, round(n, 6) AS noise, round(b - n, 6) AS net, round(c, 6) AS rank_change FROM b""",
    "source_neighbours": """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL),
      e AS (SELECT a.doc_id AS x, b.doc_id AS y, round(1 - 0.15 * (b.n - a.n - 1), 4)::DOUBLE AS weight FROM o a JOIN o b ON a.source = b.source AND b.n - a.n BETWEEN 1 AND 2
        UNION ALL SELECT f, doc_id, 0.8 FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY title) AS f FROM documents WHERE len(title) > 0) WHERE doc_id > f)
      SELECT x AS doc_id, y AS neighbour, max(weight) AS weight FROM (SELECT x, y, weight FROM e UNION ALL SELECT y, x, weight FROM e) WHERE x % 100 = 0 AND x <> y GROUP BY ALL""",
    "evidence_metrics": f"""WITH {FAQ}, {bm25("SELECT faq_id, body FROM faqs", "faq_id", 5)},
      c AS (SELECT id AS query, list_concat(expected_sources, ['kb/faq', 'kb/playbooks', 'pr/handbook']) AS sources, list_distinct(list_filter(list_transform(coalesce(expected_keywords, []), lambda w: lower(trim(w))), lambda w: len(w) > 0)) AS words FROM rag_eval_cases),
      h AS (SELECT query, list_contains(sources, source) AS right_source, lower(substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 300)) AS t, words, {STATUS.format("content")} AS s FROM ranked JOIN faqs USING (faq_id) JOIN c USING (query)),
      g AS (SELECT query, count(*) AS n, count(*) FILTER (right_source AND (len(words) = 0 OR len(list_filter(words, lambda w: contains(t, w))) > 0)) AS e, flatten(list(CASE WHEN right_source THEN list_filter(words, lambda w: contains(t, w)) ELSE [] END)) AS f,
        count(*) FILTER (s IN ('deprecated', 'misleading', 'unanswerable_trap')) AS m, count(*) FILTER (s = 'authoritative') AS a FROM h GROUP BY query)
      SELECT c.query, CASE WHEN coalesce(e, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence_hit, round(CASE WHEN len(words) > 0 THEN coalesce(len(list_distinct(f)), 0)::DOUBLE / len(words) WHEN e > 0 THEN 1 ELSE 0 END, 6) AS evidence_recall, round(coalesce(e, 0)::DOUBLE / greatest(1, coalesce(n, 0)), 6) AS evidence_precision,
        round(coalesce(m, 0)::DOUBLE / greatest(1, coalesce(n, 0)), 6) AS misleading_rate, round(coalesce(a, 0)::DOUBLE / greatest(1, coalesce(n, 0)), 6) AS authoritative_rate FROM c LEFT JOIN g USING (query) WHERE len(sources) > 0""",
    "metadata_lines": "SELECT DISTINCT doc_key, concat_ws('; ', CASE WHEN len(title) > 0 THEN 'heading=' || title END, 'page=' || metadata.page_number, CASE WHEN len(metadata.json_text_fields) > 0 THEN 'fields=' || array_to_string(metadata.json_text_fields[1:8], ', ') END, CASE WHEN len(metadata.file_type) > 0 THEN 'file_type=' || metadata.file_type END, CASE WHEN len(metadata.team) > 0 THEN 'team=' || metadata.team END) AS line FROM rag_document",
    "memory_scan": "SELECT memory_id, updated_at FROM (SELECT DISTINCT memory_id, updated_at, index_status, record_type FROM memories) WHERE record_type IN ('chat_raw', 'summary') AND index_status = 'pending' ORDER BY updated_at DESC, memory_id DESC LIMIT 20",
    "memory_by_source": "SELECT DISTINCT memory_id, record_type FROM memories WHERE memory_id IN (SELECT memory_id FROM memories WHERE record_type = 'decision')",
    "transcripts": r"""WITH l AS (SELECT memory_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM (SELECT DISTINCT memory_id, content FROM memories)),
      t AS (SELECT memory_id, n, CASE split_part(line, ':', 1) WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'assistant_output' ELSE 'system' END AS tag, trim(substr(line, strpos(line, ':') + 1)) AS said FROM l WHERE regexp_matches(line, '^(user|assistant|system): '))
      SELECT memory_id, string_agg('<' || tag || '>' || said || '</' || tag || '>', chr(10) ORDER BY n) AS text FROM t GROUP BY memory_id""",
    "budget_calls": f"""WITH {USAGE}, a AS (SELECT *, event_type <> 'click' OR row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY event_id) <= 10 AS can FROM u),
      b AS (SELECT *, can AND row_number() OVER (PARTITION BY user_id, can ORDER BY event_id) <= 40 AS ok FROM a)
      SELECT user_id, count(*) FILTER (ok) AS admitted, count(*) FILTER (NOT ok) AS skipped, max(event_id) FILTER (ok) AS last_call FROM b GROUP BY user_id""",
    "budget_warnings": f"""WITH {USAGE}, m AS (SELECT user_id, sum(model_calls)::BIGINT AS a, sum(tool_calls)::BIGINT AS b FROM u GROUP BY user_id)
      SELECT user_id, concat_ws('; ', CASE WHEN a >= 70 THEN 'model_calls: limit ' || a || '/70' WHEN a >= 56 THEN 'model_calls: near ' || a || '/70' END, CASE WHEN b >= 20 THEN 'tool_calls: limit ' || b || '/20' WHEN b >= 16 THEN 'tool_calls: near ' || b || '/20' END) AS warnings FROM m""",
    "role_evidence": """WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND doc_type IS NOT NULL), r AS (SELECT source, doc_type, doc_id, title FROM d WHERE title IS NOT NULL AND doc_id % 7 = 0),
      w AS (SELECT source, string_agg(title, chr(10) || chr(10) ORDER BY doc_id) AS w FROM r GROUP BY source), n AS (SELECT source, string_agg(title, chr(10) || chr(10) ORDER BY doc_id) AS n FROM r WHERE doc_type IN ('news', 'blog') GROUP BY source)
      SELECT source, section, coalesce(CASE WHEN section = 'news' THEN n END, w, '') AS evidence FROM (SELECT DISTINCT source FROM d) CROSS JOIN (SELECT unnest(['news', 'rest']) AS section) LEFT JOIN w USING (source) LEFT JOIN n USING (source)""",
    "tools_by_domain": "SELECT platform AS domain, count(DISTINCT type) AS tools, string_agg(DISTINCT type, ', ' ORDER BY type) AS names FROM bulk_mock_posts WHERE platform IS NOT NULL AND type IS NOT NULL GROUP BY platform",
    "p4_found": """WITH RECURSIVE links AS (SELECT DISTINCT id, CASE WHEN trim(parent_id) <> '' THEN parent_id END AS parent FROM bulk_mock_posts),
      up AS (SELECT a.id, b.id AS parent FROM links a JOIN (SELECT DISTINCT id FROM bulk_mock_posts) b ON b.id = a.parent),
      most AS (SELECT count(*) AS deep FROM links),
      walk AS (SELECT id, id AS at, 0 AS depth FROM links WHERE parent IS NOT NULL UNION ALL SELECT w.id, up.parent, depth + 1 FROM walk w JOIN up ON up.id = w.at, most WHERE depth < 2 * deep),
      far AS (SELECT id, max(depth) AS depth FROM walk GROUP BY id)
      SELECT f.id, CASE WHEN f.depth > deep THEN (SELECT min(w.at) FROM walk w WHERE w.id = f.id AND w.depth >= deep) ELSE (SELECT w.at FROM walk w WHERE w.id = f.id AND w.depth = f.depth) END AS root_id, CASE WHEN f.depth > deep THEN -1 ELSE f.depth END::BIGINT AS depth FROM far f, most""",
    "bm25_topk": "WITH" + bm25("SELECT doc_id, concat_ws(chr(10), title, text) AS body FROM documents", "doc_id", 5) + " SELECT query, doc_id, score, rank FROM ranked",
    "bm25_content_only": "WITH" + bm25("SELECT doc_key, max(content) AS body FROM rag_document GROUP BY doc_key", "doc_key", 5) + " SELECT query, doc_key, score, rank FROM ranked",
    "term_statistics": f"WITH t AS (SELECT doc_id, {tok("coalesce(text, '')")} AS t FROM documents) SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents)::DOUBLE - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL)",
    **{f"vector_{m}_topk": vectors(m).format(k=10) for m in ("cosine", "ip", "l2")},
    "hash_embedding": f"SELECT doc_id, pos, round(value, 6) AS value FROM ({embedded('SELECT doc_id, text AS body FROM documents', 'doc_id')}) WHERE abs(value) > 1e-10",
    "rrf_fuse": f"WITH {FUSED} SELECT query, faq_id, score, rank FROM fused",
    "metadata_boost": f"WITH {BOOSTED} SELECT query, faq_id, round(ss, 6) AS structured_score, round(rrf + 0.15 * ss, 6) AS score FROM boost",
    "keyword_rerank": f"WITH {FINAL} SELECT query, faq_id, round(rr, 6) AS rerank_score FROM st",
    "hybrid_topk": f"WITH {FINAL} SELECT query, faq_id, score, rank FROM best",
    "cited_context": f"WITH {FINAL}, ex AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS x FROM best) SELECT query, string_agg('--- SOURCE ' || rank || ': ' || coalesce(title, source) || ' ---' || chr(10) || 'SOURCE: ' || source || chr(10) || 'CHUNK ID: ' || faq_id || chr(10) || 'EXCERPT:' || chr(10) || {EXCERPT.format('x')} || chr(10), chr(10) ORDER BY rank) AS context FROM ex GROUP BY query",
    "authority_status": f"SELECT doc_id, s AS source_status, CASE s WHEN 'authoritative' THEN 1.0::DOUBLE WHEN 'deprecated' THEN 0.35 WHEN 'misleading' THEN 0.1 WHEN 'unanswerable_trap' THEN 0.0 ELSE 0.8 END::DOUBLE AS weight, ({PENALTY})::DOUBLE AS penalty FROM (SELECT doc_id, {STATUS.format("coalesce(text, '')")} AS s FROM documents)",
    "graph_terms_idf": f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf, round(threshold, 6) AS threshold FROM kept",
    "graph_neighbors": f"WITH {NEAR}, sc AS (SELECT *, round(0.35 * 0.1 * least(1.0::DOUBLE, shared::DOUBLE / 3), 6) AS score, round(0.5 * least(1.0::DOUBLE, shared::DOUBLE / 3) + 0.5, 4) AS confidence FROM near) SELECT seed, doc_id, shared, score, confidence, row_number() OVER (PARTITION BY seed ORDER BY score DESC, shared DESC, doc_id) AS rank FROM sc QUALIFY rank <= 8",
    "same_source_edges": """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL),
      e AS (SELECT a.doc_id AS "from", b.doc_id AS "to", a.source, round(1 - 0.15 * (b.n - a.n - 1), 4)::DOUBLE AS weight FROM o a JOIN o b ON a.source = b.source AND b.n > a.n WHERE 1 - 0.15 * (b.n - a.n - 1) > 0.2)
      SELECT "from", "to", source, NULL::BIGINT AS place, weight FROM e UNION ALL SELECT doc_id, NULL, source, n, 0.2::DOUBLE FROM o""",
    "adjacent_edges": "SELECT \"from\", \"to\", 1.0::DOUBLE AS weight FROM (SELECT doc_id AS \"from\", lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS \"to\" FROM documents WHERE source IS NOT NULL) WHERE \"to\" IS NOT NULL",
    "shared_title_edges": "SELECT f AS \"from\", doc_id AS \"to\", 0.8::DOUBLE AS weight FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY title) AS f FROM documents WHERE len(title) > 0) WHERE doc_id > f",
    "adaptive_gate": "WITH" + bm25("SELECT doc_id, concat_ws(chr(10), title, text) AS body FROM documents", "doc_id", 5) + r""", co AS (SELECT query, max(n)::DOUBLE / sum(n) AS concentration FROM (SELECT query, source, count(*) AS n FROM ranked JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY ALL) GROUP BY ALL),
      w AS (SELECT id AS query, list_filter(regexp_split_to_array(trim(query), '\s+'), lambda x: len(x) > 0) AS w FROM rag_eval_cases),
      sp AS (SELECT query, len(list_filter(w, lambda x: len(x) >= 5 OR (len(x) >= 2 AND regexp_matches(x, '^\p{Lu}'))))::DOUBLE / len(w) AS specificity FROM w),
      gm AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, trim(lower(unnest(regexp_extract_all(concat_ws(chr(10), title, text), '[A-Za-z][A-Za-z0-9_-]+|[一-鿿]+'))), '_-') AS term FROM documents)
        WHERE len(term) >= 2 AND term NOT IN (""" + ", ".join(repr(w) for w in STOPWORDS) + r""")),
      gd AS (SELECT term, count(*)::DOUBLE AS df FROM gm GROUP BY ALL), gn AS (SELECT max(df) AS n FROM gd),
      inf AS (SELECT query, avg(ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(n + 1)) AS informativeness FROM (SELECT DISTINCT query, term FROM ranked JOIN gm USING (doc_id) WHERE rank <= 3) JOIN gd USING (term), gn GROUP BY query),
      j AS (SELECT query, specificity, concentration, (specificity >= 0.3)::BIGINT + (concentration >= 0.5)::BIGINT + (coalesce(informativeness, 0) >= 0.3)::BIGINT AS favourable FROM sp JOIN co USING (query) LEFT JOIN inf USING (query))
      SELECT query, round(specificity, 4) AS specificity, round(concentration, 4) AS concentration, favourable, favourable >= 2 AS should_expand, round(CASE WHEN favourable >= 2 THEN 0.5::DOUBLE + 0.25 * favourable ELSE 0.5 - 0.1 * (3 - favourable) END, 4)::DOUBLE AS confidence FROM j""",
    "post_signals": f"WITH {SIGNALS} SELECT id, sentiment_label, is_complaint, engagement_total, array_to_string(list_sort(list_filter([{', '.join(repr(w) for w in sorted({*NEGATIVE, *COMPLAINT}))}], lambda w: contains(signal, w))), '|') AS signals FROM sig",
    "sentiment_counts": f"WITH {SIGNALS} SELECT sentiment_label, count(*) AS posts FROM sig GROUP BY ALL",
    "platform_counts": f"WITH {POSTS} SELECT coalesce(platform, 'unknown') AS platform, count(*) AS posts FROM posts GROUP BY ALL",
    "daily_volume": f"WITH {POSTS} SELECT ingested_at::DATE::VARCHAR AS day, count(*) AS posts FROM posts GROUP BY ALL",
    "risk_metrics": f"""WITH {SIGNALS}, g AS (SELECT coalesce(platform, 'unknown') AS platform, count(*) AS posts, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (is_complaint) AS complaints, sum(engagement_total)::BIGINT AS total_engagement,
      coalesce(sum(engagement_total) FILTER (sentiment_label = 'negative'), 0)::BIGINT AS negative_engagement FROM sig GROUP BY ALL),
      r AS (SELECT *, round(negative::DOUBLE / posts, 4) AS negative_ratio FROM g)
      SELECT *, least(100, round_even(negative_ratio * 55 + least(complaints * 8, 25) + least(negative_engagement::DOUBLE / 1000, 15) + CASE WHEN negative_ratio > 0 OR complaints > 0 OR negative_engagement > 0 THEN least(total_engagement::DOUBLE / 2000, 10) ELSE least(total_engagement::DOUBLE / 5000, 5) END, 0))::BIGINT AS score,
      CASE WHEN negative_ratio >= 0.6 OR complaints >= 10 OR negative_engagement >= 10000 THEN 'critical' WHEN negative_ratio >= 0.45 OR complaints >= 3 OR negative_engagement >= 3000 THEN 'high' WHEN negative_ratio >= 0.25 OR complaints >= 1 OR negative_engagement >= 800 THEN 'medium' ELSE 'low' END AS level,
      CASE WHEN total_engagement >= 100000 THEN 'critical' WHEN total_engagement >= 30000 THEN 'high' WHEN total_engagement >= 3000 THEN 'medium' ELSE 'low' END AS heat_level FROM r""",
    "top_keywords": f"WITH {POSTS} SELECT trim(k) AS keyword, count(*) AS posts FROM (SELECT unnest(list_concat(coalesce(tags, []), coalesce(metadata.keywords, []))) AS k FROM posts) WHERE len(trim(k)) > 0 GROUP BY ALL ORDER BY posts DESC, keyword LIMIT 30",
    "representative_posts": f"WITH {SIGNALS} SELECT platform, id, engagement_total, row_number() OVER (PARTITION BY platform ORDER BY engagement_total DESC, id) AS rank FROM sig WHERE platform IS NOT NULL QUALIFY rank <= 5",
    "author_profile": f"WITH {SIGNALS} SELECT author_id, count(*) AS posts, count(DISTINCT platform) AS platforms, count(*) FILTER (sentiment_label = 'negative') AS negative, sum(engagement_total)::BIGINT AS engagement, min(id) AS first_post FROM sig WHERE author_id IS NOT NULL GROUP BY ALL",
    "post_search": f"WITH {POSTS} SELECT id, platform FROM posts WHERE contains({HAY}, 'battery') AND contains({HAY}, 'pack') AND lower(platform) IN ('x', 'forum', 'news_comment')",
    "alias_search": f"WITH {POSTS} SELECT id FROM posts WHERE {words(HAY, ('heat pump', '热泵', 'ヒートポンプ', 'bomba de calor'))}",
    "complaints_expanded": f"WITH {POSTS}, h AS (SELECT id, {HAY} AS hay FROM posts) SELECT id, arg_min(matched_query, n) AS matched_query FROM ({' UNION ALL '.join(f'''SELECT id, {n} AS n, '{v}' AS matched_query FROM h WHERE ''' + ' AND '.join(f"contains(hay, '{w}')" for w in v.split()) for n, v in enumerate(query_variants('nordhay')))}) GROUP BY id",
    "thread_assembly": f"WITH {POSTS}, t AS (SELECT id AS thread FROM posts WHERE try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0) SELECT DISTINCT thread, id FROM t JOIN posts p ON p.thread_id = thread OR p.parent_id = thread OR p.metadata.parent_id = thread",
    "comment_counts": f"WITH {POSTS} SELECT parent_id, count(*) AS comments, min(id) AS first_comment FROM posts WHERE len(parent_id) > 0 GROUP BY ALL",
    "result_page": f"WITH {SIGNALS} SELECT id, engagement_total FROM sig ORDER BY engagement_total DESC, id LIMIT 20 OFFSET 20",
    "post_hashtags": rf"WITH {POSTS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), regexp_extract_all(coalesce(content, ''), '#([\p{{L}}\p{{N}}_-]+)', 1)))), '|') AS tags FROM posts",
    "post_media": f"WITH {POSTS}, i AS (SELECT id, unnest(range(len(images))) AS n, images FROM posts) SELECT id, n, images[n + 1].url AS url, images[n + 1].caption AS caption FROM i WHERE images[n + 1].url IS NOT NULL",
    "dedupe_keep_first": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text",
    "duplicate_probe": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_id",
    "dedupe_keep_last": "SELECT id, count(*) AS versions, max(ingested_at) AS ingested_at FROM bulk_mock_posts GROUP BY id",
    "union_of_sources": "SELECT kind, count(DISTINCT k) AS items, sum(len(content))::BIGINT AS chars FROM (SELECT 'file' AS kind, doc_key AS k, content FROM rag_document UNION ALL SELECT 'faq', faq_id, content FROM media_response_faq UNION ALL SELECT 'memory', memory_id, content FROM memories WHERE record_type IN ('chat_raw', 'summary', 'preference', 'project_fact', 'decision', 'constraint', 'deprecated')) WHERE len(trim(content)) > 0 GROUP BY ALL",
    "text_excerpts": f"WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, {EXCERPT.format('x')} AS excerpt FROM x",
    "token_estimates": "SELECT doc_id, CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, len(text) // 4) END AS tokens, CASE WHEN len(text) <= 200 THEN len(text) ELSE len(rtrim(substr(text, 1, 200), ' ')) END AS cut_length FROM documents WHERE text IS NOT NULL",
    "source_basenames": "SELECT split_part(string_split(replace(source, '\\', '/'), '/')[-1], '#', 1) AS name, count(*) AS docs FROM documents GROUP BY ALL",
    "document_keys": "SELECT DISTINCT doc_key, substr(sha256(source || chr(10) || coalesce(title, '')), 1, 16) AS computed FROM rag_document",
    "line_ranges": "SELECT doc_id, len(substr(text, 1, len(text) // 2)) - len(replace(substr(text, 1, len(text) // 2), chr(10), '')) + 1 AS middle_line, len(text) - len(replace(text, chr(10), '')) + 1 AS last_line FROM documents WHERE len(text) > 0",
    "structured_contexts": "SELECT DISTINCT doc_key, concat_ws(chr(10), CASE WHEN len(title) > 0 THEN 'title: ' || title END, CASE WHEN len(source) > 0 THEN 'source: ' || source END, CASE WHEN len(metadata.file_type) > 0 THEN 'file_type: ' || metadata.file_type END, CASE WHEN len(metadata.language) > 0 THEN 'language: ' || metadata.language END, 'page_number: ' || metadata.page_number::VARCHAR) AS context FROM rag_document",
    "memory_upsert": f"WITH {UPSERTED} SELECT memory_id, versions, index_status, created_at, updated_at FROM up",
    "pending_queue": f"WITH {UPSERTED} SELECT record_type, count(*) AS pending FROM up WHERE index_status = 'pending' GROUP BY ALL",
    "mark_indexed": f"WITH {UPSERTED} SELECT CASE WHEN index_status = 'pending' AND record_type = 'summary' THEN 'indexed' ELSE index_status END AS index_status, count(*) AS records FROM up GROUP BY ALL",
    "memory_documents": "SELECT DISTINCT memory_id AS doc_key, 'memory://' || coalesce(conversation_id, '') || '/' || memory_id AS source, coalesce(title, substr(split_part(content, chr(10), 1), 1, 120)) AS title, CASE WHEN record_type = 'deprecated' THEN 'do_not_adopt' ELSE 'adopt' END AS memory_usage FROM memories WHERE record_type IN ('chat_raw', 'summary', 'preference', 'project_fact', 'decision', 'constraint', 'deprecated') AND len(trim(content)) > 0",
    "memory_ids": "SELECT DISTINCT memory_id, record_type || '-' || substr(sha256(concat_ws(chr(10), coalesce(user_id, ''), coalesce(conversation_id, ''), coalesce(record_type, ''), coalesce(content, ''))), 1, 24) AS stable_id FROM memories",
    "memory_fingerprint": "SELECT count(*) AS records, count(DISTINCT memory_id) AS ids, max(updated_at) AS updated_at FROM memories",
    "memory_turns": "SELECT memory_id, turn, split_part(line, ':', 1) AS role, trim(substr(line, instr(line, ':') + 1), ' ') AS said FROM (SELECT memory_id, unnest(range(len(l))) AS turn, unnest(l) AS line FROM (SELECT memory_id, string_split(content, chr(10)) AS l FROM (SELECT DISTINCT memory_id, content FROM memories))) WHERE regexp_matches(line, '^(user|assistant|system): ')",
    "budget_merge": f"WITH {USAGE} SELECT user_id, sum(model_calls)::BIGINT AS model_calls, sum(tool_calls)::BIGINT AS tool_calls, sum(total_tokens)::BIGINT AS total_tokens, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS event_type FROM u GROUP BY user_id",
    "budget_diff": f"WITH {USAGE} SELECT user_id, greatest(0, count(*) - count(*) FILTER (ts < '2024-01-15'))::BIGINT AS model_calls, greatest(0, sum(total_tokens) - coalesce(sum(total_tokens) FILTER (ts < '2024-01-15'), 0))::BIGINT AS total_tokens FROM u GROUP BY user_id",
    "budget_state": "SELECT user_id, 70 - count(*) AS remaining, count(*) >= 70 AS over, count(*) >= 0.8 * 70 AS warn, greatest(0, floor((70 - 1 - count(*)) / 2))::BIGINT AS slots FROM events GROUP BY user_id",
    "eval_metrics": f"WITH {RUN} SELECT query, hit, recall, precision, mrr FROM cm",
    "eval_by_category": f"WITH {RUN} SELECT label::VARCHAR AS category, count(*) AS cases, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr FROM cm JOIN embeddings ON vec_id = query GROUP BY ROLLUP (label)",
    "run_ablation": f"WITH {LISTS} SELECT coalesce(a.query, b.query) AS query, count(*) FILTER (a.query IS NULL) AS gained, count(*) FILTER (b.query IS NULL) AS lost FROM ranked a FULL JOIN er b ON a.query = b.query AND a.faq_id = b.faq_id GROUP BY 1",
    "pareto_front": "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))",
    "latency_percentiles": "SELECT event_type, count(*) AS n, min(value) AS min, quantile_cont(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "domain_routing": " UNION ".join(["SELECT id, 'core' AS domain FROM rag_eval_cases", "SELECT id, 'web_search' FROM rag_eval_cases", *(f"SELECT id, '{d}' FROM rag_eval_cases WHERE {words('lower(query)', ks)}" for d, ks in DOMAINS.items())]),
    "section_assembly": "WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND doc_type IS NOT NULL), l AS (SELECT source, doc_type, arg_max(title, doc_id) AS content FROM d WHERE title IS NOT NULL GROUP BY ALL) SELECT source, string_agg('## ' || doc_type || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY doc_type) AS report FROM (SELECT DISTINCT source, doc_type FROM d) LEFT JOIN l USING (source, doc_type) GROUP BY source",
    "state_reduction": "WITH l AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events) SELECT user_id::VARCHAR AS thread, string_agg(event_type, '|' ORDER BY event_id) AS value FROM l WHERE f IS NULL OR event_id >= f GROUP BY ALL",
    "private_memories": f"WITH {UPSERTED.replace('any_value(record_type)', 'any_value(user_id) AS user_id, any_value(record_type)')} SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, memory_id) AS rank FROM up WHERE user_id IS NOT NULL QUALIFY rank <= 5",
    "unique_names": "WITH t AS (SELECT DISTINCT platform, unnest(tags) AS tag FROM bulk_mock_posts WHERE platform IS NOT NULL) SELECT platform, tag, CASE WHEN platform = min(platform) OVER (PARTITION BY tag) THEN tag ELSE platform || '__' || tag END AS called FROM t",
    "admitted_units": f"WITH {POSTS}, r AS (SELECT row_number() OVER (PARTITION BY thread_id ORDER BY id) AS n FROM posts WHERE thread_id IS NOT NULL) SELECT CASE WHEN n <= 2 THEN 'run' ELSE 'overflow' END AS state, count(*) AS units FROM r WHERE n <= 5 GROUP BY ALL",
    "run_preference": f"WITH {RUN}, b AS (WITH {RUN.replace(vectors('cosine').format(k=10), vectors('l2').format(k=10))} SELECT query, recall AS other FROM cm) SELECT query, (recall > other)::BIGINT AS first, (recall < other)::BIGINT AS second FROM cm JOIN b USING (query)",
    "events_asof": "SELECT a.event_id, a.user_id, (SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS previous FROM events a WHERE event_type = 'purchase'",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 43200 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL",
    "event_days": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
