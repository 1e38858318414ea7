"""DuckDB SQL for every checked query key, written independently of the
Spark code over the driver's views (region nation customer supplier part
orders lineitem events documents embeddings pages benchmark labels
conversations).  Adapter CTEs mirror FIXTURES.md."""

ACTIONS = """actions AS (
  SELECT event_id AS id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
         ts,
         user_id::VARCHAR AS account,
         CASE event_type WHEN 'purchase' THEN 'comment' WHEN 'error' THEN 'error' ELSE 'like' END AS action_type,
         (props->>'$.k') AS media_id,
         CASE WHEN (props->>'$.k')::INT >= 10 THEN 'tag' || ((props->>'$.k')::INT % 20) END AS hashtag,
         CASE WHEN event_type = 'purchase' THEN 'c' || (props->>'$.k') END AS comment,
         CASE WHEN event_type = 'error' THEN 'code ' || (props->>'$.k') END AS error,
         'https://posts.example/p/' || (props->>'$.k') || '/' AS post_link,
         CAST(ts AS DATE) AS date,
         event_type
  FROM events)"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["actions_scan"] = w(ACTIONS) + """
SELECT id, "timestamp", account, action_type, media_id, hashtag, comment, error, post_link,
       strftime(date, '%Y-%m-%d') AS date
FROM actions"""

SQL["actions_iso_scan"] = w(ACTIONS) + """
SELECT id, CASE WHEN id % 7 = 0 THEN substr("timestamp", 1, 19) ELSE "timestamp" END AS "timestamp",
       CASE WHEN id % 7 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
       account, action_type, media_id, post_link
FROM actions"""

SQL["lookback"] = w(ACTIONS) + f"""
SELECT id, "timestamp", action_type, hashtag FROM actions
WHERE ts >= {AS_OF} - INTERVAL 7 DAY"""

SQL["tagged_actions"] = w(ACTIONS) + """
SELECT id, "timestamp", account, action_type, media_id, hashtag FROM actions WHERE hashtag IS NOT NULL"""

SQL["error_rows"] = w(ACTIONS) + """
SELECT "timestamp", action_type, error FROM actions WHERE action_type = 'error'"""

SQL["type_counts"] = w(ACTIONS) + """
SELECT action_type, count(*) AS count FROM actions GROUP BY action_type"""

SQL["type_counts_total"] = w(ACTIONS) + """
SELECT action_type, count(*) AS count FROM actions GROUP BY ROLLUP (action_type)"""

SQL["headline"] = w(ACTIONS) + """
SELECT count(*) FILTER (WHERE action_type = 'like') AS likes,
       count(*) FILTER (WHERE action_type = 'comment') AS comments
FROM actions"""

SQL["action_history"] = w(ACTIONS) + f"""
SELECT substr("timestamp", 1, 10) AS date, action_type, count(*) AS count
FROM actions WHERE "timestamp" >= strftime({AS_OF} - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%f')
GROUP BY 1, 2 ORDER BY 1, 2"""

SQL["history_pivot"] = w(ACTIONS) + f"""
SELECT substr("timestamp", 1, 10) AS date,
       count(*) FILTER (WHERE action_type = 'like') AS "like",
       count(*) FILTER (WHERE action_type = 'comment') AS comment,
       count(*) FILTER (WHERE action_type = 'error') AS error
FROM actions WHERE "timestamp" >= strftime({AS_OF} - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%f')
GROUP BY 1 ORDER BY 1"""

SQL["tag_stats"] = w(ACTIONS) + """
SELECT hashtag, action_type, count(*) AS count FROM actions WHERE hashtag IS NOT NULL
GROUP BY 1, 2 ORDER BY count DESC, hashtag, action_type"""

SQL["tag_pivot"] = w(ACTIONS) + """
SELECT hashtag,
       count(*) FILTER (WHERE action_type = 'like') AS "like",
       count(*) FILTER (WHERE action_type = 'comment') AS comment,
       count(*) FILTER (WHERE action_type = 'error') AS error
FROM actions WHERE hashtag IS NOT NULL GROUP BY 1"""

SQL["top_tags"] = w(ACTIONS) + """
SELECT hashtag, "like", comment, error FROM (
  SELECT hashtag,
         count(*) FILTER (WHERE action_type = 'like') AS "like",
         count(*) FILTER (WHERE action_type = 'comment') AS comment,
         count(*) FILTER (WHERE action_type = 'error') AS error
  FROM actions WHERE hashtag IS NOT NULL GROUP BY 1)
ORDER BY "like" + comment DESC, hashtag LIMIT 10"""

_RATE = """
  SELECT {key} success, errors, success + errors AS total,
         CASE WHEN success + errors > 0 THEN round(100.0 * success / (success + errors), 1) END AS success_pct,
         CASE WHEN success + errors > 0 THEN round(100.0 * errors / (success + errors), 1) END AS error_pct
  FROM (SELECT {key} count(*) FILTER (WHERE action_type IN ('like', 'comment')) AS success,
               count(*) FILTER (WHERE action_type = 'error') AS errors
        FROM actions {where} {group})"""

SQL["success_rate"] = w(ACTIONS) + _RATE.format(key="", where="", group="")
SQL["tag_success"] = w(ACTIONS) + _RATE.format(key="hashtag,", where="WHERE hashtag IS NOT NULL", group="GROUP BY hashtag")

SQL["latest_errors"] = w(ACTIONS) + """
SELECT id, "timestamp", action_type, error FROM actions WHERE action_type = 'error'
ORDER BY "timestamp" DESC, id DESC LIMIT 10"""

_LOG_COLS = 'id, "timestamp", account, action_type, media_id, hashtag, comment, error'

SQL["append_roundtrip"] = w(ACTIONS) + f"SELECT {_LOG_COLS}, post_link FROM actions"
SQL["evolved_union"] = w(ACTIONS) + f"SELECT {_LOG_COLS}, CASE WHEN id % 2 = 1 THEN post_link END AS post_link FROM actions"
SQL["evolved_scan"] = SQL["evolved_union"]

TAGS = """tags AS (
  SELECT account,
         CASE WHEN id % 4 = 0 THEN 'avoid' ELSE 'hashtags' END AS list_name,
         id AS seq,
         CASE WHEN id % 11 = 0 THEN 'bad-tag'
              ELSE (CASE WHEN id % 3 = 0 THEN '#' ELSE '' END) ||
                   (CASE WHEN id % 5 = 0 THEN upper(hashtag) ELSE hashtag END) END AS raw
  FROM actions WHERE hashtag IS NOT NULL),
norm AS (
  SELECT *, lower(tag) AS key,
         tag <> '' AND regexp_full_match(tag, '[\\p{L}\\p{N}_]+') AND regexp_matches(tag, '[\\p{L}\\p{N}]') AS valid
  FROM (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '^#', '') AS tag FROM tags))"""


def admit(cap: int) -> str:
    return f"""ranked AS (
  SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY account, list_name, valid, key ORDER BY seq) END AS rn
  FROM norm),
keypos AS (
  SELECT account, list_name, key, row_number() OVER (PARTITION BY account, list_name ORDER BY first_seq) AS keypos
  FROM (SELECT account, list_name, key, min(seq) AS first_seq FROM norm WHERE valid GROUP BY ALL)),
admitted AS (
  SELECT account, list_name, seq, raw, tag,
         CASE WHEN tag = '' THEN 'empty' WHEN NOT valid THEN 'invalid'
              WHEN keypos > {cap} THEN 'too_many' WHEN rn > 1 THEN 'duplicate' ELSE 'ok' END AS status
  FROM ranked LEFT JOIN keypos USING (account, list_name, key))"""


SQL["normalize_tags"] = w(ACTIONS, TAGS) + "SELECT account, list_name, seq, raw, tag, valid FROM norm"
SQL["dedupe_tags"] = w(ACTIONS, TAGS) + """
SELECT account, list_name, seq, tag FROM norm WHERE valid
QUALIFY row_number() OVER (PARTITION BY account, list_name, key ORDER BY seq) = 1"""
SQL["admit_tags"] = w(ACTIONS, TAGS, admit(30)) + "SELECT * FROM admitted"
SQL["admit_tags_cap5"] = w(ACTIONS, TAGS, admit(5)) + "SELECT * FROM admitted"
SQL["remove_tags"] = w(ACTIONS, TAGS, admit(30)) + """
SELECT account, list_name, seq, tag FROM admitted
WHERE status = 'ok' AND lower(tag) NOT IN ('tag3', 'tag7')
  AND NOT (account::BIGINT % 10 = 0 AND list_name = 'avoid')"""
SQL["tag_list_size"] = w(ACTIONS, TAGS, admit(30)) + """
SELECT account, list_name, count(*) AS n, count(*)::VARCHAR || '/30' AS label
FROM admitted WHERE status = 'ok' GROUP BY ALL"""

POSTS = """posts AS (
  SELECT doc_id::VARCHAR AS media_id, 'c' || doc_id AS code, doc_id % 150 AS author_id, text AS caption,
         n_chars AS like_count, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 40 END AS comment_count,
         list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS hashtags,
         source AS search_tag,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS taken_at
  FROM documents)"""

VERDICTS = """verdicts AS (
  SELECT doc_id::VARCHAR AS media_id,
         (CASE WHEN toxic = 1 THEN 'Sensitive' ELSE 'safe' END) || chr(10) || 'quality ' || quality AS verdict_text
  FROM labels),
parsed AS (
  SELECT media_id, starts_with(lower(trim(verdict_text)), 'sensitive') AS sensitive,
         trim(CASE WHEN strpos(verdict_text, chr(10)) > 0 THEN substr(verdict_text, strpos(verdict_text, chr(10)) + 1) ELSE '' END) AS description
  FROM verdicts)"""

_KW = """(contains(lower(caption), 'license') OR contains(lower(caption), 'token')
  OR contains(lower(search_tag), 'license') OR contains(lower(search_tag), 'token')
  OR len(list_filter(hashtags, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'token'))) > 0)"""
_AVOID = "list_has_any(list_transform(hashtags, lambda x: lower(x)), ['que', 'dieser', 'whated'])"

SQL["keyword_screen"] = w(POSTS) + f"SELECT media_id, {_KW} AS kw_hit FROM posts"
SQL["avoid_screen"] = w(POSTS) + f"SELECT media_id, coalesce({_AVOID}, false) AS avoid_hit FROM posts"
SQL["own_posts"] = w(POSTS) + "SELECT media_id, author_id = 0 AS own_post FROM posts"
SQL["verdict_parse"] = w(VERDICTS) + "SELECT media_id, sensitive, description FROM parsed"
SQL["safety_gate"] = w(POSTS, VERDICTS) + """
SELECT media_id FROM posts WHERE media_id NOT IN (SELECT media_id FROM parsed WHERE sensitive)"""

DECISIONS = f"""dec AS (
  SELECT p.media_id, p.search_tag,
         NOT EXISTS (SELECT 1 FROM actions a WHERE a.account = '0' AND a.action_type = 'like' AND a.media_id = p.media_id) AS like_eligible,
         CASE WHEN {_KW} THEN 'keyword'
              WHEN {_AVOID} THEN 'avoid_tag'
              WHEN EXISTS (SELECT 1 FROM actions a WHERE a.account = '0' AND a.action_type = 'comment' AND a.media_id = p.media_id) THEN 'already_done'
              WHEN p.author_id = 0 THEN 'own_post'
              WHEN EXISTS (SELECT 1 FROM parsed v WHERE v.media_id = p.media_id AND v.sensitive) THEN 'sensitive'
              ELSE 'ok' END AS reason
  FROM posts p)"""

SQL["decisions"] = w(ACTIONS, POSTS, VERDICTS, DECISIONS) + """
SELECT media_id, search_tag, like_eligible, reason = 'ok' AS comment_eligible, reason FROM dec"""
SQL["funnel"] = w(ACTIONS, POSTS, VERDICTS, DECISIONS) + """
SELECT search_tag, reason, count(*) AS count FROM dec GROUP BY ALL"""

SQL["screening_run"] = w(ACTIONS, POSTS, VERDICTS) + f""", params AS (
  SELECT user_id::VARCHAR AS account, user_id AS viewer, ['src' || (user_id % 20), 'src' || ((user_id + 7) % 20), 'src' || ((user_id + 13) % 20)] AS tags,
         CASE WHEN user_id % 3 = 0 THEN ['que', 'die'] ELSE [] END AS avoid, user_id % 7 AS likes, user_id % 5 AS comments,
         user_id % 2 = 1 AS allowed
  FROM (SELECT DISTINCT user_id FROM events)),
lists AS (SELECT account, unnest(tags) AS tag, unnest(range(0, 3)) AS seq FROM params),
recent AS (SELECT *, row_number() OVER (PARTITION BY search_tag ORDER BY taken_at DESC, media_id) AS rn FROM posts QUALIFY rn <= 10),
walk AS (
  SELECT l.account, l.seq, r.rn, r.media_id, r.search_tag, p.likes, p.comments,
         NOT EXISTS (SELECT 1 FROM actions a WHERE a.account = l.account AND a.media_id = r.media_id AND a.action_type = 'like') AS can_like,
         NOT (EXISTS (SELECT 1 FROM actions a WHERE a.account = l.account AND a.media_id = r.media_id AND a.action_type = 'comment')
              OR r.author_id = p.viewer OR len(list_intersect(r.hashtags, p.avoid)) > 0 OR {_KW}
              OR (NOT p.allowed AND EXISTS (SELECT 1 FROM parsed v WHERE v.media_id = r.media_id AND v.sensitive))) AS can_comment
  FROM lists l JOIN recent r ON r.search_tag = l.tag JOIN params p ON p.account = l.account),
likes AS (SELECT account, 'like' AS action_type, media_id, search_tag, seq, rn, likes FROM walk WHERE can_like
          QUALIFY row_number() OVER (PARTITION BY account, media_id ORDER BY seq, rn) = 1),
comments AS (SELECT account, 'comment' AS action_type, media_id, search_tag, seq, rn, comments FROM walk WHERE can_comment
             QUALIFY row_number() OVER (PARTITION BY account, media_id ORDER BY seq, rn) = 1)
SELECT account, action_type, media_id, search_tag, seq, rn FROM likes
QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq, rn) <= any_value(likes) OVER (PARTITION BY account)
UNION ALL
SELECT account, action_type, media_id, search_tag, seq, rn FROM comments
QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq, rn) <= any_value(comments) OVER (PARTITION BY account)"""

SQL["not_yet_commented"] = w(ACTIONS) + """
SELECT id, account, media_id FROM actions l WHERE action_type = 'like'
  AND NOT EXISTS (SELECT 1 FROM actions c WHERE c.action_type = 'comment' AND c.account = l.account AND c.media_id = l.media_id)"""
SQL["already_commented"] = w(ACTIONS) + """
SELECT id, account, media_id FROM actions l WHERE action_type = 'like'
  AND EXISTS (SELECT 1 FROM actions c WHERE c.action_type = 'comment' AND c.account = l.account AND c.media_id = l.media_id)"""

TERMS = """terms AS (
  SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'avoid' ELSE 'keyword' END AS kind, list_max(words) AS term
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS words
        FROM benchmark)
  WHERE list_max(words) IS NOT NULL)"""

SQL["screen_by_table"] = w(POSTS, TERMS) + """
SELECT media_id,
       EXISTS (SELECT 1 FROM terms t WHERE t.kind = 'keyword' AND (
                 contains(lower(p.caption), t.term) OR contains(lower(p.search_tag), t.term)
                 OR len(list_filter(p.hashtags, lambda x: contains(lower(x), t.term))) > 0)) AS kw_hit,
       EXISTS (SELECT 1 FROM terms t WHERE t.kind = 'avoid' AND list_contains(list_transform(p.hashtags, lambda x: lower(x)), t.term)) AS avoid_hit
FROM posts p"""

SQL["recent_per_tag"] = w(POSTS) + """
SELECT media_id, search_tag, rn FROM (
  SELECT media_id, search_tag, row_number() OVER (PARTITION BY search_tag ORDER BY taken_at DESC, media_id) AS rn
  FROM posts) WHERE rn <= 10"""

SOURCE_TAGS = """stags AS (
  SELECT 'acct' || (doc_id % 7) AS account, 'hashtags' AS list_name, doc_id AS seq,
         CASE WHEN doc_id % 2 = 0 THEN '#' || source ELSE source END AS raw
  FROM documents),
slist AS (
  SELECT account, seq, tag FROM (
    SELECT *, row_number() OVER (PARTITION BY account, lower(tag) ORDER BY seq) AS rn,
           dense_rank() OVER (PARTITION BY account ORDER BY first_seq) AS keypos
    FROM (SELECT *, min(seq) OVER (PARTITION BY account, lower(tag)) AS first_seq
          FROM (SELECT *, regexp_replace(trim(raw), '^#', '') AS tag FROM stags)))
  WHERE rn = 1 AND keypos <= 30)"""

SQL["candidates"] = w(POSTS, SOURCE_TAGS) + """
SELECT s.account, s.seq, r.search_tag, r.media_id FROM slist s JOIN (
  SELECT * FROM (SELECT media_id, search_tag,
                        row_number() OVER (PARTITION BY search_tag ORDER BY taken_at DESC, media_id) AS rn
                 FROM posts) WHERE rn <= 10) r ON r.search_tag = s.tag"""

# the days of an account one after the other; ``seen``: what earlier days accepted
_QUOTA = "WITH RECURSIVE " + ACTIONS + """,
cands AS (
  SELECT id, ts, account, strftime(date, '%Y-%m-%d') AS date, media_id, event_type <> 'error' AS ok,
         (account, media_id) IN (SELECT (account, media_id) FROM actions WHERE ts < TIMESTAMP '2024-01-08' AND event_type <> 'error') AS h
  FROM actions WHERE ts >= TIMESTAMP '2024-01-08'),
f AS (SELECT account, date, media_id, min((ts, id)) AS o FROM cands WHERE ok AND NOT h GROUP BY ALL),
d AS (SELECT account, date, list(media_id ORDER BY o) AS posts, row_number() OVER (PARTITION BY account ORDER BY date) AS j
      FROM f GROUP BY account, date),
walk AS (
  SELECT DISTINCT account, 0::BIGINT AS j, NULL::VARCHAR AS date, []::VARCHAR[] AS now, []::VARCHAR[] AS seen FROM d
  UNION ALL
  SELECT d.account, d.j, d.date, list_filter(d.posts, lambda p: NOT list_contains(list_concat(w.seen, w.now), p))[1:2],
         list_concat(w.seen, w.now)
  FROM walk w JOIN d ON d.account = w.account AND d.j = w.j + 1),
took AS (SELECT t.account, t.date, t.media_id, f.o FROM (SELECT account, date, unnest(now) AS media_id FROM walk) t
         JOIN f USING (account, date, media_id)),
n AS (
  SELECT c.*, NOT h
    AND NOT EXISTS (SELECT 1 FROM took t WHERE t.account = c.account AND t.media_id = c.media_id AND t.o < (c.ts, c.id))
    AND (SELECT count(*) FROM took t WHERE t.account = c.account AND t.date = c.date AND t.o < (c.ts, c.id)) < 2 AS attempted
  FROM cands c)
"""
SQL["quota"] = _QUOTA + "SELECT id, account, date, media_id, attempted, attempted AND ok AS accepted FROM n"

SQL["quota_audit"] = w(ACTIONS) + """
SELECT id, account, strftime(date, '%Y-%m-%d') AS date, action_type FROM actions
QUALIFY row_number() OVER (PARTITION BY account, date, action_type ORDER BY ts, id) > 2"""

SQL["gap_audit"] = w(ACTIONS) + """
SELECT id, account, gap_us, coalesce(gap_us < 1309000000, false) AS too_close FROM (
  SELECT id, account, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY account ORDER BY ts, id) AS gap_us
  FROM actions)"""

_LOCAL_HOUR = "hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Argentina/Buenos_Aires')"
SQL["active_hours"] = w(ACTIONS) + f"""
SELECT id, {_LOCAL_HOUR} AS local_hour FROM actions WHERE {_LOCAL_HOUR} BETWEEN 8 AND 23"""
SQL["hour_profile"] = w(ACTIONS) + f"SELECT {_LOCAL_HOUR} AS hour, count(*) AS count FROM actions GROUP BY 1"

SQL["hash_sample"] = w(ACTIONS) + """
SELECT id, account, action_type FROM actions
WHERE ('0x' || substr(md5(id::VARCHAR || '|' || '7'), 1, 8))::BIGINT % 100 < 10"""
SQL["seeded_order"] = w(ACTIONS) + """
SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY md5(id::VARCHAR || '|7'), id) AS rn FROM actions"""

AUTHORS = """authors AS (
  SELECT c_custkey AS author_id, c_name AS username, c_name || ' ' || c_mktsegment AS full_name FROM customer)"""
FOLLOWS = """follows AS (
  SELECT DISTINCT user_id AS follower_id, (props->>'$.k')::BIGINT AS followee_id FROM events WHERE event_type = 'signup')"""
SHELF = """shelf AS (
  SELECT item_id AS position, text AS title, CASE WHEN item_id % 6 <> 0 THEN (item_id % 6)::INT END AS book_rating,
         CASE WHEN item_id % 3 = 0 THEN NULL ELSE substr(text, 1, 200) END AS book_review
  FROM benchmark),
matched AS (
  SELECT p.media_id, min(s.position) AS position FROM posts p JOIN shelf s
    ON trim(s.title) <> '' AND contains(lower(p.caption), lower(trim(s.title)))
  GROUP BY p.media_id)"""

SQL["post_details"] = w(POSTS, AUTHORS) + """
SELECT media_id, username, full_name, coalesce(caption, '') AS caption, like_count, comment_count
FROM posts LEFT JOIN authors USING (author_id)"""
SQL["following_flag"] = w(POSTS, FOLLOWS) + """
SELECT media_id, author_id,
       EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = 0 AND f.followee_id = p.author_id) AS is_following
FROM posts p"""
SQL["title_match"] = w(POSTS, SHELF) + """
SELECT m.media_id, m.position, s.title AS book_title, s.book_rating, s.book_review
FROM matched m JOIN shelf s USING (position)"""
SQL["title_match_by_reader"] = w(POSTS) + """, shelf AS (
  SELECT 'reader' || (item_id % 2) AS user_id, item_id // 2 AS position, text AS title,
         CASE WHEN item_id % 6 <> 0 THEN (item_id % 6)::INT END AS book_rating,
         CASE WHEN item_id % 3 = 0 THEN NULL ELSE substr(text, 1, 200) END AS book_review
  FROM benchmark)
SELECT media_id, user_id, position, title AS book_title, book_rating, book_review
FROM posts p JOIN shelf s ON s.user_id = 'reader' || ((p.author_id % 150) % 2) AND trim(s.title) <> ''
  AND contains(lower(p.caption), lower(trim(s.title)))
QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY position) = 1"""
SQL["post_links"] = w(POSTS) + "SELECT media_id, 'https://posts.example/p/' || code || '/' AS post_link FROM posts"
SQL["shelf_excerpt"] = w(POSTS, SHELF) + "SELECT position, book_rating, book_review FROM shelf"


def _score(lang_words: str) -> str:
    return f"len(list_filter(words, lambda x: list_contains([{lang_words}], x)))"


_EN = "'the','of','and','to','is','that','it','for','was','with','this','are'"
_ES = "'el','los','las','del','y','por','con','una','para','se','su','al'"
_FR = "'le','les','des','et','du','une','est','qui','pour','dans','sur','pas'"
_DE = "'der','die','und','den','von','zu','das','mit','sich','auf','ist','nicht'"
LANG = f"""lang AS (
  SELECT media_id,
         CASE WHEN greatest(en, es, fr, de) = 0 THEN 'en'
              WHEN en = greatest(en, es, fr, de) THEN 'en'
              WHEN es = greatest(en, es, fr, de) THEN 'es'
              WHEN fr = greatest(en, es, fr, de) THEN 'fr' ELSE 'de' END AS lang
  FROM (SELECT media_id, {_score(_EN)} AS en, {_score(_ES)} AS es, {_score(_FR)} AS fr, {_score(_DE)} AS de
        FROM (SELECT media_id, regexp_split_to_array(lower(coalesce(caption, '')), '[^\\p{{L}}]+') AS words FROM posts)))"""

SQL["detect_language"] = w(POSTS, LANG) + "SELECT media_id, lang FROM lang"
SQL["post_brief"] = w(POSTS, AUTHORS) + """
SELECT media_id, '@' || coalesce(username, '?') || ' (' || coalesce(full_name, '') || ')'
       || ' likes=' || coalesce(like_count::VARCHAR, 'N/A') || ' comments=' || coalesce(comment_count::VARCHAR, 'N/A')
       || ' | ' || coalesce(caption, '') AS brief
FROM posts LEFT JOIN authors USING (author_id)"""
SQL["post_features"] = w(POSTS, AUTHORS, FOLLOWS, SHELF, LANG) + """
SELECT p.media_id, a.username, a.full_name,
       EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = 0 AND f.followee_id = p.author_id) AS is_following,
       CASE WHEN EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = 0 AND f.followee_id = p.author_id)
            THEN 'known' ELSE 'unknown' END AS relation,
       l.lang, CASE WHEN l.lang = 'es' THEN 'es' ELSE 'en' END AS route,
       m.position AS book_position, s.title AS book_title, s.book_rating, s.book_review
FROM posts p LEFT JOIN authors a USING (author_id) JOIN lang l USING (media_id)
LEFT JOIN matched m USING (media_id) LEFT JOIN shelf s ON s.position = m.position"""

# the profile model: trigrams of words between spaces, the 400 most frequent of each language
_CUT = "unnest(regexp_extract_all(lower(coalesce({text}, '')), '\\p{{L}}{{1,64}}')) AS word"
_TRIGRAMS = "unnest([substr(' ' || word || ' ', CAST(i AS BIGINT), 3) FOR i IN range(1, length(word) + 1)]) AS gram"
_LOG = "CAST(floor(1000.0::DOUBLE * ln((n_{0} + 0.5::DOUBLE) / (t_{0} + 1)) + 0.5::DOUBLE) AS BIGINT) AS w_{0}"
_FOUR = ("en", "es", "fr", "de")


def _profiles(where: str = "true") -> str:
    return f"""grams AS (
  SELECT lang, gram, count(*) AS n FROM (SELECT lang, {_TRIGRAMS}
    FROM (SELECT lang, {_CUT.format(text='text')} FROM documents WHERE lang IN ('en', 'es', 'fr', 'de') AND {where})) GROUP BY ALL),
totals AS (SELECT {', '.join(f"coalesce(sum(n) FILTER (lang = '{x}'), 0)::BIGINT AS t_{x}" for x in _FOUR)} FROM grams),
kept AS (SELECT DISTINCT gram FROM (
  SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM grams) WHERE r <= 400),
wide AS (SELECT gram, {', '.join(f"coalesce(sum(n) FILTER (lang = '{x}'), 0)::BIGINT AS n_{x}" for x in _FOUR)}
  FROM grams WHERE gram IN (SELECT gram FROM kept) GROUP BY gram),
model AS (SELECT gram, {', '.join(f"n_{x}" for x in _FOUR)}, {', '.join(_LOG.format(x) for x in _FOUR)} FROM wide, totals)"""


def _by_profile(name: str, source: str, key: str, text: str) -> str:
    """Language and margin per key of ``source``; keys without a known trigram are en."""
    best = "greatest(en, es, fr, de)"
    return f"""{name} AS (
  SELECT {key}, CASE WHEN en IS NULL OR en = {best} THEN 'en' WHEN es = {best} THEN 'es' WHEN fr = {best} THEN 'fr' ELSE 'de' END AS lang,
         coalesce(list_sort([en, es, fr, de], 'DESC')[1] - list_sort([en, es, fr, de], 'DESC')[2], 0)::BIGINT AS margin
  FROM (SELECT DISTINCT {key} FROM {source}) LEFT JOIN (
    SELECT {key}, {', '.join(f"sum(w_{x}) AS {x}" for x in _FOUR)}
    FROM (SELECT {key}, {_TRIGRAMS} FROM (SELECT {key}, {_CUT.format(text=text)} FROM {source})) JOIN model USING (gram)
    GROUP BY {key}) USING ({key}))"""


SQL["language_profiles"] = w(_profiles()) + "SELECT * FROM model"
SQL["detect_language_by_profile"] = w(POSTS, _profiles(), _by_profile("found", "posts", "media_id", "caption")) + "SELECT * FROM found"
SQL["language_agreement"] = w(_profiles("doc_id % 5 <> 0"), r"""cut AS (
  SELECT doc_id, lang AS label, unnest(range(0, len(p))) AS pos, unnest(p) AS caption
  FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[.!?\n]') AS p FROM documents WHERE lang IN ('en', 'es', 'fr', 'de')))""",
    r"""posts AS (SELECT doc_id || '/' || pos AS media_id, doc_id, label, caption FROM cut WHERE regexp_matches(caption, '\p{L}'))""",
    LANG, _by_profile("found", "posts", "media_id", "caption")) + """
SELECT p.label, p.doc_id % 5 = 0 AS held_out, count(*) AS n_pieces,
       count(*) FILTER (f.lang = p.label) AS right_by_profile, count(*) FILTER (l.lang = p.label) AS right_by_words
FROM posts p JOIN found f USING (media_id) JOIN lang l USING (media_id) GROUP BY ALL"""
SQL["post_features_by_profile"] = SQL["post_features"].replace(
    LANG, _profiles() + ",\n" + _by_profile("lang", "posts", "media_id", "caption"))

SQL["shelf_extract"] = """
WITH r AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size, (p_partkey % 3)::VARCHAR AS user_id,
         row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS rk
  FROM part)
SELECT user_id, (rk - 1) // 100 + 1 AS page, (rk - 1) % 100 + 1 AS "row", rk AS position,
       p_name AS title, p_brand AS author, 'https://books.example/book/show/' || p_partkey AS book_url,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size % 6)::INT END AS rating,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS review
FROM r"""

SQL["page_links"] = """
SELECT page_id, pos, href, text FROM (
  SELECT page_id, unnest(generate_series(1, len(h))) AS pos, unnest(h) AS href, unnest(t) AS text
  FROM (SELECT page_id,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t
        FROM pages))"""

SQL["page_elements"] = SQL["page_links"]
SQL["shelf_crawl"] = """
WITH r AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size, (p_partkey % 3)::VARCHAR AS user_id,
         row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS rk
  FROM part),
pages AS (SELECT *, (rk - 1) // 50 + 1 AS page FROM r),
counts AS (SELECT user_id, page, CASE WHEN page % 10 <> 0 THEN n END AS n FROM (SELECT user_id, page, count(*) AS n FROM pages GROUP BY ALL)),
stop AS (SELECT user_id, min(page) AS page FROM counts WHERE n IS NULL OR n < 50 GROUP BY user_id)
SELECT p.user_id, p.page, (rk - 1) % 50 + 1 AS "row", rk AS position,
       p_name AS title, p_brand AS author, 'https://books.example/book/show/' || p_partkey AS book_url,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size % 6)::INT END AS rating,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS review
FROM pages p LEFT JOIN stop s USING (user_id) WHERE p.page % 10 <> 0 AND (s.page IS NULL OR p.page <= s.page)"""

SQL["crawl_prefix"] = """
WITH c AS (
  SELECT l_orderkey::VARCHAR AS user_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page,
         trunc(l_quantity)::INT AS n_rows
  FROM lineitem),
s AS (SELECT user_id, min(page) AS stop FROM c WHERE n_rows IS NULL OR n_rows < 25 GROUP BY user_id)
SELECT c.user_id, c.page, c.n_rows FROM c LEFT JOIN s USING (user_id) WHERE s.stop IS NULL OR c.page <= s.stop"""

_SHELF_JSON = """sj AS (
  SELECT 'reader-' || (item_id // 100) AS user_id,
         row_number() OVER (PARTITION BY item_id // 100 ORDER BY item_id) AS position,
         CASE WHEN item_id % 9 = 0 THEN NULL ELSE text END AS title,
         CASE WHEN item_id % 5 = 0 THEN '' ELSE 'a' || (item_id % 7) END AS author,
         'https://books.example/book/show/' || item_id AS book_url,
         CASE WHEN item_id % 6 = 0 THEN NULL ELSE (item_id % 6)::INT END AS rating,
         CASE WHEN item_id % 3 = 0 THEN NULL ELSE text END AS review
  FROM benchmark)"""
SQL["shelf_json"] = w(_SHELF_JSON) + "SELECT * FROM sj"
SQL["complete_books"] = w(_SHELF_JSON) + "SELECT * FROM sj WHERE coalesce(title, '') <> '' AND coalesce(author, '') <> ''"

SQL["run_params"] = """
SELECT user_id::VARCHAR AS account,
       'tag' || (user_id % 20) || ',' || 'tag' || ((user_id + 7) % 20) AS hashtags,
       CASE WHEN user_id % 2 = 0 THEN 'tag' || ((user_id + 3) % 20) ELSE '' END AS avoid_hashtags,
       CASE WHEN user_id % 7 = 0 OR user_id % 5 = 0 THEN 50 ELSE (user_id % 60)::INT END AS likes_per_day,
       CASE WHEN user_id % 3 = 0 THEN 15 ELSE (user_id % 20)::INT END AS comments_per_day,
       CASE WHEN user_id % 4 = 0 THEN true ELSE user_id % 2 = 1 END AS allow_sensitive,
       CASE WHEN user_id % 6 <> 0 THEN 'g' || user_id END AS shelf_user_id
FROM (SELECT DISTINCT user_id FROM events)"""

SQL["run_log_parse"] = w(ACTIONS) + """, e AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S,') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS log_time,
         CASE WHEN action_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         CASE WHEN event_type = 'view' AND id % 3 = 0 THEN 'skipped_keyword' WHEN event_type = 'view' AND id % 3 = 1 THEN 'skipped_avoid'
              WHEN event_type = 'view' THEN 'skipped_sensitive'
              WHEN action_type = 'like' THEN 'liked' WHEN action_type = 'comment' THEN 'commented'
              WHEN id % 2 = 1 THEN 'like_failed' ELSE 'comment_failed' END AS event,
         CASE WHEN action_type = 'error' THEN NULL ELSE post_link END AS link,
         CASE WHEN action_type = 'comment' THEN comment || (CASE WHEN id % 5 = 0 THEN chr(10) || 'second line' ELSE '' END)
              WHEN action_type = 'error' THEN error END AS detail
  FROM actions)
SELECT log_time, level, event, media_id, CASE WHEN event = 'liked' THEN hashtag END AS hashtag, link, detail,
       log_time || ' ' || level || ':' || CASE event
         WHEN 'liked' THEN 'Liked post ' || media_id || ' (hashtag: ' || coalesce(hashtag, 'None') || ') | Link: ' || link
         WHEN 'commented' THEN 'Commented on post ' || media_id || ': ' || detail || ' | Link: ' || link
         WHEN 'like_failed' THEN 'Failed to like post ' || media_id || ': ' || detail
         WHEN 'comment_failed' THEN 'Failed to comment on post ' || media_id || ': ' || detail
         WHEN 'skipped_keyword' THEN 'Skipped post ' || media_id || ' due to ''giveaway'' in caption or hashtags. | Link: ' || link
         WHEN 'skipped_avoid' THEN 'Skipped commenting on post ' || media_id || ' due to avoid hashtag in hashtags. | Link: ' || link
         ELSE 'Skipped commenting on post ' || media_id || ' due to sensitive image. | Link: ' || link END AS raw
FROM e"""

SQL["stream_daily_counts"] = w(ACTIONS) + """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, action_type, count(*) AS count,
       CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM actions) - INTERVAL 16 DAY AS closed
FROM actions GROUP BY CAST(ts AS DATE), action_type"""

SQL["stream_first_action"] = w(ACTIONS) + """
SELECT account, media_id, action_type, id FROM actions a WHERE ts >= TIMESTAMP '2024-01-08'
  AND NOT EXISTS (SELECT 1 FROM actions b WHERE b.ts < TIMESTAMP '2024-01-08' AND b.account = a.account
                  AND b.media_id = a.media_id AND b.action_type = a.action_type)
QUALIFY row_number() OVER (PARTITION BY account, media_id, action_type ORDER BY ts, id) = 1"""

SQL["stream_quota"] = _QUOTA + "SELECT id, account, date, media_id FROM n WHERE attempted AND ok"

# the stream's files: a week each, every 20th row a week late, every 50th (on time) again a week later
SQL["stream_late_rows"] = w(ACTIONS) + """,
f AS (SELECT id, action_type, ts, day(ts) // 8 + (id % 20 = 0)::INT AS n FROM actions
      UNION ALL SELECT id, action_type, ts, day(ts) // 8 + 1 FROM actions WHERE id % 50 = 0 AND id % 20 <> 0),
m AS (SELECT n, max(ts) AS latest FROM f WHERE n <= 4 GROUP BY n)
SELECT DISTINCT id, action_type FROM f
WHERE n <= 4 AND ts <= (SELECT max(latest) - INTERVAL 1 DAY FROM m WHERE m.n < f.n)"""

SQL["classifier_hook"] = w(POSTS, AUTHORS) + """
SELECT media_id,
       CASE WHEN length(coalesce(caption, '')) < 50 OR contains(caption, '@') THEN NULL
            ELSE username || ':' || length(caption) END AS result,
       length(coalesce(caption, '')) < 50 AS skipped,
       CASE WHEN length(coalesce(caption, '')) >= 50 AND contains(caption, '@')
            THEN 'ValueError: personal data in caption' END AS error
FROM posts LEFT JOIN authors USING (author_id)"""

SQL["append_batches"] = SQL["append_roundtrip"]
SQL["not_yet_indexed"] = SQL["not_yet_commented"]
SQL["classify_once"] = SQL["classifier_hook"]
