"""DuckDB SQL that gives the results of the registered queries by other means."""

from __future__ import annotations

from wiregrid.functions import scoring
from wiregrid.functions.lexicon import DEFAULT_LEXICON, Lexicon
from wiregrid.operators import digest
from wiregrid.plans.catalog import AS_OF, EVENT_WATCHLIST, FIXTURE_LEXICON
from wiregrid.sources.derived import FIRST_PUBLISHED, STEP_SECONDS, WATCHLIST

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_WORD = r"[_\p{N}\p{L}]+"
_RAW_TEXT = r"(?is)^<(script|style)\b[^>]*>"
_RAW_END = r"(?is)</(script|style)[^>]*>$"
_TAG = r"""</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>"""
_MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>|"
    + _TAG + r"|<[a-z/!?][^>]*(?:>|\z)|[^<]+|<"
)
# Named references.
_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "copy": "©",
    "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "hellip": "…", "euro": "€", "trade": "™", "amp": "&",
}
_NOON = f"TIMESTAMP '{AS_OF}'"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, {_q(_SPACE + '+')}, ' ', 'g'))"


def _cut(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} "
        f"ELSE left({text}, {limit - 3}) || '...' END"
    )


def _clean(text: str) -> str:
    visible = f"""array_to_string(list_transform(regexp_extract_all({text}, {_q(_MARKUP)}),
        lambda t: CASE
          WHEN regexp_matches(t, {_q(_RAW_TEXT)})
            THEN replace(regexp_replace(regexp_replace(t, {_q(_RAW_TEXT)}, ''), {_q(_RAW_END)}, ''), '&', chr(64976))
          WHEN regexp_matches(t, {_q('(?i)^<[a-z/!?]')}) THEN '' ELSE t END), ' ')"""
    decoded = f"CASE WHEN contains({text}, '<') THEN {visible} ELSE {text} END"
    for name, value in _NAMED.items():
        if name == "amp":
            decoded = f"regexp_replace({decoded}, '&amp;?', '&', 'g')"
        else:
            decoded = f"replace({decoded}, {_q(f'&{name};')}, {_q(value)})"
    return _flat(f"replace({decoded}, chr(64976), '&')")


_RAW = f"""raw AS (
  SELECT doc_id AS seq, source AS ticker, lang, text,
    CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE text END AS h,
    CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE '' END AS s,
    'doc://' || doc_id AS url, {FIRST_PUBLISHED} + {STEP_SECONDS} * doc_id AS published_ts,
    lang = 'es' AND instr(text, chr(10)) = 0 AS bad
  FROM documents)"""

_ARTICLES = f"""{_RAW},
articles AS MATERIALIZED (
  SELECT seq, substring(sha256(ticker || '|' || url || '|' || published_ts), 1, 16) AS id,
    ticker, {_clean('h')} AS headline, {_clean('s')} AS summary,
    regexp_replace(ticker, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS source, url, published_ts
  FROM raw WHERE NOT bad)"""


def _sum_hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(t, {_q(w)})::INTEGER" for w in words) or "0"


def _scores(lexicon: Lexicon) -> str:
    counted = ", ".join(
        f"{_sum_hits(e.high)} AS h{i}, {_sum_hits(e.medium)} AS m{i}" for i, e in enumerate(lexicon)
    )
    # One number that orders by high, then medium, then place in the lexicon.
    keys = [f"(h{i} * 1000 + m{i}) * 100 + {len(lexicon) - i}" for i in range(len(lexicon))]
    best = f"greatest({', '.join(keys)})"
    names = " ".join(f"WHEN best % 100 = {len(lexicon) - i} THEN {_q(e.event_type)}" for i, e in enumerate(lexicon))
    return f"""counted AS (
  SELECT id, {counted} FROM (SELECT id, lower(headline || ' ' || summary) AS t FROM articles)),
hits AS (
  SELECT id, {' + '.join(f'h{i}' for i in range(len(lexicon)))} AS total_high,
    {' + '.join(f'm{i}' for i in range(len(lexicon)))} AS total_medium, {best} AS best FROM counted),
bests AS (
  SELECT *, (best // 100) // 1000 AS best_high, (best // 100) % 1000 AS best_medium FROM hits),
rated AS (
  SELECT *, least(1.0, (2 * total_high + total_medium) / 10.0::DOUBLE) AS relevance,
    least(100, 20 * best_high + 5 * best_medium)::INTEGER AS importance_score,
    CASE WHEN best // 100 = 0 THEN 'other' {names} END AS event_type,
    CASE WHEN best_high >= 2 THEN 'high' WHEN best_high = 1 OR best_medium >= 2 THEN 'medium'
      ELSE 'low' END AS confidence
  FROM bests),
scores AS MATERIALIZED (
  SELECT id AS article_id, relevance >= {scoring.RELEVANCE_THRESHOLD} AS is_relevant,
    round(relevance, 4)::DOUBLE AS relevance_score, importance_score, event_type, confidence,
    relevance >= {scoring.RELEVANCE_THRESHOLD}
      AND importance_score >= {scoring.IMPORTANCE_THRESHOLD} AS include_in_digest,
    CASE WHEN relevance < {scoring.RELEVANCE_THRESHOLD}
      THEN 'No significant stock-relevant keywords detected.'
      ELSE CASE WHEN importance_score >= {scoring.IMPORTANCE_THRESHOLD}
          THEN 'Material company-specific update.' ELSE 'Relevant but below importance threshold.' END
        || ' Event type: ' || event_type || '. High-signal keywords: ' || best_high
        || ', medium: ' || best_medium || '.' END AS reason
  FROM rated)"""


_WORD_LEXICON = """keywords AS MATERIALIZED (
  SELECT word, (length(word) + 3 * length(replace(word, 'e', ''))) % 7 AS place,
    length(replace(word, 'a', '')) % 3 = 0 AS high
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM conversations)
  WHERE length(word) >= 8),
found AS MATERIALIZED (
  SELECT a.id, k.place, count(*) FILTER (WHERE k.high) AS high, count(*) FILTER (WHERE NOT k.high) AS medium
  FROM (SELECT id, lower(headline || ' ' || summary) AS t FROM articles) a
    JOIN keywords k ON contains(a.t, k.word)
  GROUP BY ALL),
best_types AS (
  SELECT id, (arg_max(struct_pack(place := place, high := high, medium := medium),
      (high * 1000000 + medium) * 100 - place)) AS b,
    sum(high) AS total_high, sum(medium) AS total_medium
  FROM found GROUP BY id),
hits AS (
  SELECT a.id, coalesce(total_high, 0) AS total_high, coalesce(total_medium, 0) AS total_medium,
    coalesce((b.high * 1000 + b.medium) * 100 + 7 - b.place, 0) AS best
  FROM articles a LEFT JOIN best_types USING (id))"""


def _table_scores() -> str:
    """The rules' statements on the hits by the table of words."""
    rules = _scores(FIXTURE_LEXICON)
    return _WORD_LEXICON + ",\n" + rules[rules.index("bests AS (") :]


def _clusters(threshold: float, block: str = "''") -> str:
    """All pairs of distinct headlines, then a walk along those with a similar one before them."""
    return f"""worded AS MATERIALIZED (
  SELECT *, list_sort(list_distinct(regexp_extract_all(lower(headline), {_q(_WORD)}))) AS words,
    {block} AS block FROM articles),
sets AS MATERIALIZED (
  SELECT block, words, len(words) AS n, min(seq) AS first_seq FROM worded
  WHERE len(words) > 0 GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT lo, hi FROM (
    SELECT a.first_seq AS lo, b.first_seq AS hi, a.n + b.n AS n_both,
      len(list_intersect(a.words, b.words)) AS common
    FROM sets a JOIN sets b ON a.block = b.block AND a.first_seq < b.first_seq
      AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 0.000001)
  WHERE common / (n_both - common) >= {threshold}),
nodes AS MATERIALIZED (
  SELECT hi, list(lo) AS lows, row_number() OVER (ORDER BY hi) AS k FROM pairs GROUP BY hi),
walk(k, followers) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT n.k, CASE WHEN len(list_filter(n.lows, lambda x: NOT list_contains(w.followers, x))) > 0
      THEN list_append(w.followers, n.hi) ELSE w.followers END
  FROM walk w JOIN nodes n ON n.k = w.k + 1),
following AS MATERIALIZED (
  SELECT unnest(followers) AS seq FROM walk WHERE k = (SELECT max(k) FROM walk)),
led AS (
  SELECT hi, min(lo) AS leader FROM pairs
  WHERE lo NOT IN (SELECT seq FROM following) GROUP BY hi),
assigned AS MATERIALIZED (
  SELECT w.id, w.ticker, w.headline, w.seq, coalesce(l.leader, s.first_seq, w.seq) AS leader_seq
  FROM worded w LEFT JOIN sets s ON w.words = s.words AND w.block = s.block
    LEFT JOIN led l ON l.hi = s.first_seq),
clusters AS MATERIALIZED (
  SELECT substring(sha256(a.id || '|' || c.n || '|' || a.ticker), 1, 16) AS cluster_id,
    a.seq AS cluster_seq, a.ticker, a.headline AS representative_headline, c.n AS article_count
  FROM (SELECT leader_seq, count(*) AS n FROM assigned GROUP BY 1) c
    JOIN assigned a ON a.seq = c.leader_seq),
members AS MATERIALIZED (
  SELECT c.cluster_id, row_number() OVER (PARTITION BY a.leader_seq ORDER BY a.seq) - 1 AS member_pos,
    a.id AS article_id
  FROM assigned a JOIN clusters c ON c.cluster_seq = a.leader_seq)"""


_SUMMARIES = f"""texts AS (
  SELECT m.cluster_id, m.member_pos, t.place, t.body
  FROM members m JOIN articles a ON a.id = m.article_id,
    (VALUES (0), (1)) AS p(place),
    LATERAL (SELECT p.place AS place, CASE p.place WHEN 0 THEN a.summary ELSE a.headline END AS body) t),
opening AS (
  SELECT cluster_id, article_count, {_cut('representative_headline', 150)} AS head FROM clusters),
fresh AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.cluster_id, lower(body) ORDER BY member_pos, place) AS nth
  FROM texts t JOIN opening o USING (cluster_id) WHERE body <> '' AND lower(body) <> lower(head)),
longest AS (
  SELECT cluster_id, body FROM fresh WHERE nth = 1
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY length(body) DESC, member_pos, place) = 1),
joined AS (
  SELECT o.cluster_id, head
    || CASE WHEN l.body IS NULL THEN '' ELSE ' ' || {_cut('l.body', 150)} END
    || CASE WHEN article_count > 1 THEN ' (' || article_count || ' sources)' ELSE '' END AS whole
  FROM opening o LEFT JOIN longest l USING (cluster_id)),
summaries AS MATERIALIZED (SELECT cluster_id, {_cut('whole', 400)} AS summary FROM joined)"""

_CONTEXT = """best AS (
  SELECT m.cluster_id, s.event_type, s.importance_score
  FROM members m JOIN scores s USING (article_id)
  QUALIFY row_number() OVER (PARTITION BY m.cluster_id ORDER BY s.importance_score DESC, m.member_pos) = 1),
flagged AS (
  SELECT m.cluster_id, bool_or(s.include_in_digest) AS flagged
  FROM members m JOIN scores s USING (article_id) GROUP BY 1),
context AS MATERIALIZED (
  SELECT c.*, u.summary, coalesce(b.event_type, 'other') AS event_type,
    coalesce(b.importance_score, 0) AS importance_score, coalesce(f.flagged, false) AS flagged
  FROM clusters c JOIN summaries u USING (cluster_id) LEFT JOIN best b USING (cluster_id)
    LEFT JOIN flagged f USING (cluster_id))"""


def _watch(tickers: tuple[str, ...]) -> str:
    rows = ", ".join(f"({_q(t)}, {i})" for i, t in enumerate(tickers))
    return f"watchlist AS (SELECT * FROM (VALUES {rows}) AS w(ticker, position))"


def _sections(where: str = "true", limit: int | None = None) -> str:
    cut = f"WHERE rank <= {limit}" if limit else ""
    return f"""{_watch(WATCHLIST)},
kept AS (SELECT * FROM context WHERE {where}),
ranked AS (
  SELECT k.*, w.position, row_number() OVER (
    PARTITION BY k.ticker ORDER BY importance_score DESC, cluster_seq) AS rank
  FROM kept k JOIN watchlist w USING (ticker)),
sections AS (
  SELECT ticker, position, rank, cluster_id, representative_headline, summary, article_count,
    event_type, importance_score, NULL::VARCHAR AS note
  FROM ranked {cut}
  UNION ALL
  SELECT ticker, position, 0, NULL, NULL, NULL, NULL, NULL, NULL, {_q(digest.NO_UPDATES)}
  FROM watchlist WHERE ticker NOT IN (SELECT ticker FROM kept))"""


_TOP = """top AS (
  SELECT *, row_number() OVER (ORDER BY importance_score DESC, cluster_seq) AS rank FROM context
  QUALIFY rank <= 5)"""

_METRICS = """metrics AS (
  SELECT (SELECT coalesce(sum(article_count), 0) FROM context)::BIGINT AS total_articles,
    (SELECT count(*) FROM scores WHERE include_in_digest)::BIGINT AS relevant_articles,
    (SELECT count(*) FROM context)::BIGINT AS total_clusters)"""


_LISTS = """lists AS (
  SELECT 'w' || c_custkey AS watchlist_id, 'src' || ((c_custkey + k) % 25) AS ticker, k AS position
  FROM customer, (SELECT unnest(range(5)) AS k) WHERE k <= c_custkey % 5)"""

_LIST_SECTIONS = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY importance_score DESC, cluster_seq) AS rank
  FROM context),
sections AS (
  SELECT l.watchlist_id, l.ticker, l.position, coalesce(r.rank, 0) AS rank, representative_headline, summary,
    article_count, event_type, CASE WHEN r.ticker IS NULL THEN {_q(digest.NO_UPDATES)} END AS note
  FROM lists l LEFT JOIN ranked r ON r.ticker = l.ticker AND r.rank <= 3)"""


def _text(of: str = "") -> str:
    """The whole text; with `of`, one for every value of that column of the sections."""
    kept = f"{of}, " if of else ""
    rule, thin = _q(digest.RULE), _q(digest.THIN_RULE)
    nl = "chr(10)"
    disclaimer = f" || {nl} || ".join(_q(line) for line in digest.DISCLAIMER)
    day = f"strftime({_NOON}, '%B %d, %Y')"
    return f"""story AS (
  SELECT rank, '[' || ticker || '] [' || upper(event_type) || '] ' || representative_headline
    || {nl} || CASE WHEN summary <> '' THEN '  ' || summary ELSE '' END || {nl} AS body FROM top),
entry AS (
  SELECT {kept}position, rank,
    CASE WHEN rank <= 1 THEN '--- ' || ticker || ' ---' || {nl} ELSE '' END
    || CASE WHEN note IS NOT NULL THEN '  ' || note || {nl} || {nl}
      ELSE '• [' || upper(event_type) || '] ' || representative_headline || {nl}
        || CASE WHEN summary <> '' THEN '  ' || summary ELSE '' END
        || CASE WHEN article_count > 1 THEN '  (' || article_count || ' sources)' ELSE '' END
        || {nl} END AS body
  FROM sections),
bodies AS (
  SELECT {kept}string_agg(body, '' ORDER BY position, rank) AS body
  FROM entry {f"GROUP BY {of}" if of else ""})
SELECT {kept}0::BIGINT AS text_part,
  {rule} || {nl} || 'STOCK NEWS DIGEST — ' || {day} || {nl} || {rule} || {nl}
  || total_articles || ' articles processed · ' || total_clusters || ' events · '
  || relevant_articles || ' relevant' || {nl} || {nl}
  || {thin} || {nl} || '🔥 TOP STORIES' || {nl} || {thin} || {nl}
  || (SELECT string_agg(body, '' ORDER BY rank) FROM story)
  || {rule} || {nl} || 'PER-TICKER UPDATES' || {nl} || {rule} || {nl}
  || bodies.body
  || {rule} || {nl} || 'METRICS & DISCLAIMER' || {nl} || {rule} || {nl}
  || 'Articles fetched : ' || total_articles || {nl} || 'Relevant         : ' || relevant_articles
  || {nl} || 'Clusters         : ' || total_clusters || {nl}
  || 'Generated        : ' || strftime({_NOON}, '%Y-%m-%d %H:%M UTC') || {nl} || {nl}
  || {disclaimer} || {nl} || {rule} AS text
FROM metrics, bodies"""


_DELIVERIES = f"""{_ARTICLES},
sent AS (
  SELECT *, 0 AS delivery FROM articles
  UNION ALL SELECT * REPLACE (source || '#1' AS source), 1 FROM articles WHERE regexp_matches(headline, '[éèê]')
  UNION ALL SELECT * REPLACE (source || '#2' AS source), 2 FROM articles WHERE length(summary) > 1000)"""

_LEDGER = """ledger AS (
  SELECT (o_custkey % 7) || '-' || o_orderdate::DATE AS id, o_orderkey AS version,
    (o_orderdate::DATE)::VARCHAR AS run_date, 'Digest ' || o_orderpriority AS subject,
    CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'P' THEN 'failed' ELSE 'composed' END AS status
  FROM orders),
state AS (
  SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"""

_RUNS = """log AS (
  SELECT user_id || '-' || ts::DATE AS run_id,
    ['fetch', 'normalize', 'score', 'cluster', 'compose'][event_id % 5 + 1] AS step,
    event_type = 'error' AS bad, floor(value * 1000)::BIGINT AS duration_ms, ts FROM events)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    """One statement per registered query."""
    rules, fixture = _scores(DEFAULT_LEXICON), _scores(FIXTURE_LEXICON)
    grouped = (_ARTICLES, fixture, _clusters(0.4), _SUMMARIES, _CONTEXT)
    parts = """articles AS (
  SELECT 'part' || p_partkey AS id, p_brand AS ticker, p_name AS headline, p_partkey AS seq FROM part)"""
    turns = """articles AS (
  SELECT conv_id || '-' || turn AS id, role AS ticker, text AS headline, conv_id * 2147483648 + turn AS seq
  FROM conversations)"""
    return {
        "articles_normalized": _with(_ARTICLES)
        + """SELECT *, strftime(make_timestamp(published_ts * 1000000), '%Y-%m-%d %H:%M:%S') AS published_at
FROM articles""",
        "article_rejects": _with(_RAW)
        + "SELECT ticker, seq AS batch_pos, 'datetime not an integer' AS reason FROM raw WHERE bad",
        "stored_rejects": _with(_RAW)
        + "SELECT ticker, seq AS batch_pos, 'datetime not an integer' AS reason FROM raw WHERE bad",
        "json_ingest": _with(_RAW)
        + """SELECT ticker, CASE WHEN ticker = 'src2' AND seq % 2 = 0 THEN 'not JSON'
    WHEN bad THEN 'datetime not an integer' ELSE 'stored' END AS outcome, count(*) AS records
FROM raw GROUP BY ALL""",
        "single_ticker_scan": "SELECT source AS ticker, doc_id AS batch_pos FROM documents"
        " WHERE source = 'src3'",
        "pages_clean_text": f"""SELECT page_id, {_clean('html')} AS clean_text, {_clean('title')} AS title
FROM (SELECT *, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)""",
        "raw_ingest": _with(_ARTICLES)
        + "SELECT id, ticker, headline, url FROM articles",
        "stream_ingest": _with(_ARTICLES)
        + "SELECT id, ticker, headline, url FROM articles",
        "stream_dedupe": _with(_DELIVERIES) + "SELECT DISTINCT id, ticker FROM sent",
        "stream_state_dedupe": _with(_DELIVERIES)
        + """SELECT id, seq, delivery FROM sent WHERE delivery IN (0, 2)
UNION ALL SELECT id, seq, 3 FROM sent WHERE delivery = 1
  AND id NOT IN (SELECT id FROM sent WHERE delivery = 2)""",
        "trailing_window_counts": _with(_watch(EVENT_WATCHLIST))
        + f"""SELECT w.ticker, w.position, count(e.event_id) AS fetched FROM watchlist w
LEFT JOIN events e ON e.event_type = w.ticker
  AND e.ts BETWEEN {_NOON} - INTERVAL 24 HOURS AND {_NOON}
GROUP BY ALL""",
        "ticker_counts": _with(_watch(WATCHLIST))
        + """SELECT w.ticker, w.position, count(d.doc_id) AS fetched
FROM watchlist w LEFT JOIN documents d ON d.source = w.ticker GROUP BY ALL""",
        "articles_first_wins": _with(_DELIVERIES)
        + """SELECT id, source, delivery FROM sent QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY CASE delivery WHEN 1 THEN -1 ELSE delivery END) = 1""",
        "articles_last_wins": _with(_DELIVERIES)
        + """SELECT id, source, delivery FROM sent
QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery DESC) = 1""",
        "snapshot_merge": _with(_DELIVERIES)
        + """SELECT id, source, delivery FROM sent
QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivery DESC) = 1""",
        "stored_defaults": """SELECT event_id::VARCHAR AS id,
  CASE WHEN event_id % 7 > 0 THEN epoch_us(ts) // 1000000 - CASE event_id % 3 WHEN 2 THEN 7200 ELSE 0 END END
    AS sent_ts,
  event_id % 5 > 0 AND event_id % 2 = 1 AS flagged,
  CASE WHEN event_id % 4 > 0 THEN event_type || ',x' ELSE '' END AS article_ids,
  CASE event_type WHEN 'purchase' THEN 'sent' ELSE 'composed' END AS status, '' AS subject FROM events""",
        "insert_counts": _with(_DELIVERIES)
        + """, others AS (SELECT id FROM sent WHERE delivery <> 1),
fresh AS (SELECT count(DISTINCT id) AS n FROM others
  WHERE id NOT IN (SELECT id FROM sent WHERE delivery = 1))
SELECT n AS inserted, (SELECT count(*) FROM others) - n AS skipped FROM fresh""",
        "keyed_update": """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, d.lang
FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "constraint_report": """SELECT 'documents' AS table_name, 'primary key' AS rule,
  (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'lineitem', 'primary key', (SELECT count(*) FROM (
  SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'events', 'primary key', (SELECT count(*) FROM (
  SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1))
UNION ALL SELECT 'documents', 'not null doc_id', (SELECT count(*) FROM documents WHERE doc_id IS NULL)
UNION ALL SELECT 'documents', 'not null text', (SELECT count(*) FROM documents WHERE text IS NULL)
UNION ALL SELECT 'documents', 'not null source', (SELECT count(*) FROM documents WHERE source IS NULL)
UNION ALL SELECT 'lineitem', 'foreign key l_partkey', (SELECT count(*) FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'labels', 'foreign key doc_id', (SELECT count(*) FROM labels
  WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))""",
        "lexicon_hits": _with(_ARTICLES, rules)
        + """SELECT id, total_high::BIGINT AS total_high, total_medium::BIGINT AS total_medium,
  best_high::BIGINT AS best_high, best_medium::BIGINT AS best_medium FROM bests""",
        "article_scores": _with(_ARTICLES, rules) + "SELECT * FROM scores",
        "article_scores_fixture_lexicon": _with(_ARTICLES, fixture) + "SELECT * FROM scores",
        "lexicon_table_scores": _with(_ARTICLES, _table_scores()) + "SELECT * FROM scores",
        "score_flags": _with(_ARTICLES, fixture)
        + """SELECT count(*) AS scored, count(*) FILTER (WHERE include_in_digest) AS flagged FROM scores""",
        "custom_scorer": """SELECT 'doc' || doc_id AS article_id,
  CASE WHEN bad THEN NULL ELSE (quality / 2)::DOUBLE END AS relevance_score,
  CASE WHEN bad THEN NULL ELSE (40 * quality + 20 * toxic)::INTEGER END AS importance_score,
  CASE WHEN bad THEN NULL WHEN toxic = 1 THEN 'legal' ELSE 'other' END AS event_type,
  CASE WHEN bad THEN NULL ELSE 40 * quality + 20 * toxic >= 30 END AS include_in_digest,
  CASE WHEN bad THEN 'ValueError: unusable' END AS error
FROM (SELECT *, toxic = 1 AND quality = 0 AS bad FROM labels)""",
        "leader_similarity": _with(_ARTICLES, _clusters(0.4))
        + """SELECT a.id, a.leader_seq, CASE WHEN len(a.words) = 0 THEN 0.0::DOUBLE ELSE round(
  len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6)
  END::DOUBLE AS similarity
FROM (SELECT w.*, leader_seq FROM worded w JOIN assigned USING (id)) a JOIN worded b ON b.seq = a.leader_seq""",
        "clusters": _with(_ARTICLES, _clusters(0.4)) + "SELECT * FROM clusters",
        "cluster_members": _with(_ARTICLES, _clusters(0.4)) + "SELECT * FROM members",
        "cluster_id_lists": _with(_ARTICLES, _clusters(0.4))
        + """SELECT cluster_id, 0::BIGINT AS chunk, string_agg(article_id, ',' ORDER BY member_pos) AS article_ids
FROM members GROUP BY cluster_id""",
        "cluster_ids_json": _with(_ARTICLES, _clusters(0.4))
        + """SELECT cluster_id, 0::BIGINT AS chunk,
  '["' || string_agg(article_id, '","' ORDER BY member_pos) || '"]' AS article_ids
FROM members GROUP BY cluster_id""",
        "clusters_within_ticker": _with(_ARTICLES, _clusters(0.4, "ticker"))
        + "SELECT cluster_id, cluster_seq, ticker, article_count FROM clusters",
        "clusters_by_age": _with(_ARTICLES, _clusters(0.4))
        + f"""SELECT row_number() OVER (ORDER BY cluster_seq // 10 DESC, cluster_seq) - 1 AS place, cluster_id,
  cluster_seq, {FIRST_PUBLISHED} + 600 * (cluster_seq // 10) AS created_ts FROM clusters""",
        "part_clusters": _with(parts, _clusters(0.4)) + "SELECT * FROM clusters",
        "turn_clusters": _with(turns, _clusters(0.5))
        + "SELECT cluster_id, cluster_seq, ticker, article_count FROM clusters",
        "cluster_summaries": _with(_ARTICLES, _clusters(0.4), _SUMMARIES) + "SELECT * FROM summaries",
        "cluster_context": _with(*grouped)
        + """SELECT cluster_id, cluster_seq, ticker, summary, article_count, event_type,
  importance_score, '' AS url, '' AS source FROM context""",
        "top_stories": _with(*grouped, _TOP)
        + """SELECT rank::INTEGER AS rank, cluster_id, ticker, event_type, importance_score, summary FROM top""",
        "digest_sections": _with(*grouped, _sections())
        + """SELECT ticker, position, rank, cluster_id, article_count, event_type, importance_score, note
FROM sections""",
        "digest_sections_limited": _with(*grouped, _sections("flagged", 3))
        + "SELECT ticker, position, rank, cluster_id, note FROM sections",
        "digest_metrics": _with(*grouped, _METRICS) + "SELECT * FROM metrics",
        "digest_text": _with(*grouped, _TOP, _sections(), _METRICS, _text()),
        "digest_texts_by_watchlist": _with(
            *grouped, _TOP, _LISTS, _LIST_SECTIONS, _METRICS, _text("watchlist_id")
        ),
        "digest_rows": _with(_LISTS)
        + f"""SELECT DISTINCT substring(sha256(watchlist_id || '|' || {_NOON}::DATE), 1, 16) AS id,
  7::BIGINT AS version, ({_NOON}::DATE)::VARCHAR AS run_date,
  {_q(digest.SUBJECT_PREFIX + ' — ')} || strftime({_NOON}, '%B %d, %Y') AS subject, 'composed' AS status
FROM lists""",
        "compose_from_tables": _with(*grouped, _TOP)
        + """SELECT rank::INTEGER AS rank, cluster_id, article_count, event_type, importance_score FROM top""",
        "latest_digest": _with(_LEDGER)
        + "SELECT * FROM ledger ORDER BY run_date DESC, version DESC LIMIT 1",
        "latest_per_date": _with(_LEDGER)
        + """SELECT * FROM ledger
QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY version DESC) = 1""",
        "ledger_state": _with(_LEDGER) + "SELECT * FROM state",
        "send_decisions": _with(_LEDGER)
        + """SELECT id, run_date, CASE WHEN run_date IN (SELECT run_date FROM ledger WHERE status = 'sent')
  THEN 'skip' ELSE 'send' END AS decision FROM state WHERE status = 'composed'""",
        "status_ledger": _with(_LEDGER)
        + f"""SELECT id, version + 1000000000 AS version, run_date,
  CASE version % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN version % 3 = 0 THEN {_q(AS_OF)} END AS sent_at,
  CASE WHEN version % 3 < 2 THEN 'reader' END AS recipient FROM state""",
        "run_summary": _with(_RUNS)
        + """SELECT run_id, CASE WHEN bool_or(bad AND step IN ('fetch', 'compose')) THEN 'failed'
    WHEN bool_or(bad) THEN 'partial' ELSE 'success' END AS status,
  count(DISTINCT step) AS steps, count(*) AS entries, count(*) FILTER (WHERE bad) AS errors,
  sum(duration_ms)::BIGINT AS busy_ms, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS span_ms
FROM log GROUP BY run_id""",
        "run_counters": _with(_ARTICLES, _clusters(0.4))
        + """SELECT 'fetched' AS counter, count(*) AS value FROM documents
UNION ALL SELECT 'stored', count(*) FROM articles
UNION ALL SELECT 'rejected', count(*) FROM raw WHERE bad
UNION ALL SELECT 'scored', count(*) FROM articles
UNION ALL SELECT 'clusters', count(*) FROM clusters""",
        "quiet_run_digest": _with(*grouped, _TOP)
        + "SELECT 0 AS version, rank::INTEGER AS rank, cluster_id FROM top",
        "run_steps": _with(_RUNS) + "SELECT DISTINCT run_id, step FROM log",
        "slugs": """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(
  regexp_replace(strip_accents(text), '[^\\x00-\\x7f]', '', 'g')),
  '[^a-z0-9_\\x09-\\x0d\\x1c-\\x20-]', '', 'g'), '[\\x09-\\x0d\\x1c-\\x20_]+', '-', 'g'), '-') AS slug
FROM documents""",
        "text_functions": f"""SELECT conv_id, turn, {_cut('text', 60)} AS cut60, left(text, 2) AS cut2,
  {_flat('text')} AS flat, array_to_string(w, ' ') AS words,
  CASE WHEN len(v) = 0 THEN 0.0::DOUBLE ELSE round(
    len(list_intersect(list_distinct(w), v)) / len(v), 6) END::DOUBLE AS similarity
FROM (SELECT *, regexp_extract_all(lower(text), {_q(_WORD)}) AS w,
  list_distinct(regexp_extract_all(lower(role || ' ' || text), {_q(_WORD)})) AS v FROM conversations)""",
        "time_functions": f"""SELECT event_id, epoch_us(ts) // 1000000 AS unix,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS back, strftime(ts, '%B %d, %Y') AS long_date,
  strftime(ts, '%Y-%m-%d %H:%M UTC') AS minute,
  {_q(digest.SUBJECT_PREFIX + ' — ')} || strftime(ts, '%B %d, %Y') AS subject,
  CAST(trunc((epoch_us({_NOON}) - epoch_us(ts)) / 1000) AS BIGINT) AS elapsed_ms
FROM events""",
    }
