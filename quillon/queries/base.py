"""Registration, and SQL that many oracles begin with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


CAT = """cat AS (
  SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 'JM' ELSE 'NH' END) || p_partkey AS id,
    'https://example.org/' || (CASE WHEN p_partkey % 3 = 0 THEN 'album' ELSE 'g' END) || '/' || p_partkey || '/' AS link,
    p_name || ' ' || p_partkey AS file_name, '[' || p_brand || '] ' || p_name AS title,
    p_type || ', ' || replace(p_name, ' ', ', ') || ', size ' || (p_size % 7) || (CASE WHEN p_partkey % 5 = 0 THEN ', , red' ELSE '' END) AS tags,
    p_brand AS author, 'team ' || (p_partkey % 11) AS team,
    (CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE '' END) AS language,
    CAST(p_size AS VARCHAR) AS pages, strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS upload_date, p_name, p_brand
  FROM part)"""
_TAG = "CASE x WHEN 'small' THEN 'little' WHEN 'red' THEN 'crimson' WHEN 'STANDARD' THEN 'regular' WHEN 'size 1' THEN 'tiny' ELSE x END"
_WORD = "CASE x WHEN 'ring' THEN 'band' WHEN 'bolt' THEN 'screw' ELSE x END"
FEAT = CAT + f""", feat AS (
  SELECT *, list_transform(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x NOT IN ('size 3', 'hot')), lambda x: {_TAG}) AS parsed_tags,
    list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> 'old'), lambda x: {_WORD}) AS title_words,
    lower(id || ' ' || title || ' ' || regexp_replace(tags, ' +', ' ', 'g') || ' ' || author || ' ' || team) AS search_text,
    'no local folder' AS local_path
  FROM cat)"""
FREQ = FEAT + """, tagf AS (SELECT feature, count(*) AS freq FROM (SELECT unnest(parsed_tags) AS feature FROM feat) GROUP BY 1),
wordf AS (SELECT feature, count(*) AS freq FROM (SELECT unnest(title_words) AS feature FROM feat) GROUP BY 1),
authf AS (SELECT author AS feature, count(*) AS freq FROM feat GROUP BY 1),
tagw(feature, weight) AS (VALUES ('little', 2.5), ('crimson', -1.5), ('absent', 9.0)),
authw(feature, weight) AS (VALUES ('Brand#2', 7.0)),
wordw(feature, weight) AS (VALUES ('band', 0.5), ('gear', -3.0))"""
OPENS = """opens AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS opened_at, (CASE WHEN event_type = 'click' THEN 'network_link' ELSE 'local_folder' END) AS action,
    (CASE WHEN k % 3 = 0 THEN 'JM' ELSE 'NH' END) || k AS id, user_id, event_id
  FROM (SELECT *, event_id % (SELECT count(*) FROM part) AS k FROM events WHERE event_type IN ('click', 'view')))"""
HIST = FREQ + ", " + OPENS + """, entries AS (
  SELECT o.opened_at, o.action, o.id, f.title, f.author, f.link, f.local_path, o.user_id, o.event_id,
    list_transform(list_sort(list_transform(list_filter(list_distinct(f.parsed_tags), lambda x: x <> ''), lambda x: {'p': list_position(f.parsed_tags, x), 'x': x})), lambda s: s.x) AS tags,
    list_transform(list_sort(list_transform(list_distinct(f.title_words), lambda x: {'p': list_position(f.title_words, x), 'x': x})), lambda s: s.x) AS title_words
  FROM opens o JOIN feat f ON f.id = o.id),
hist AS (SELECT * FROM entries ORDER BY opened_at DESC, event_id DESC LIMIT 50),
hcount AS (
  SELECT facet, feature, count(*) AS n FROM (
    SELECT 'tag' AS facet, unnest(tags) AS feature FROM hist UNION ALL SELECT 'title_word', unnest(title_words) FROM hist UNION ALL SELECT 'author', author FROM hist)
  GROUP BY 1, 2),
bonus AS (
  SELECT h.facet, h.feature, h.n * ln(1 + ((CASE h.facet WHEN 'tag' THEN (SELECT sum(freq) FROM tagf) WHEN 'author' THEN (SELECT sum(freq) FROM authf) ELSE (SELECT sum(freq) FROM wordf) END) + 1)
    / (coalesce(f.freq, 0) + 1)) * (CASE h.facet WHEN 'tag' THEN 1.0 WHEN 'author' THEN 0.5 ELSE 2.0 END) AS bonus
  FROM hcount h LEFT JOIN (SELECT 'tag' AS facet, * FROM tagf UNION ALL SELECT 'author', * FROM authf UNION ALL SELECT 'title_word', * FROM wordf) f
    ON f.facet = h.facet AND f.feature = h.feature)"""
PARTS = """ tagp AS (
  SELECT i.id, sum(ln(1 + f.freq) * 10 * coalesce(w.weight, 1.0)) / any_value(i.norm) * 1.2 * 0.5 AS v, sum(ln(1 + f.freq) * 10 * coalesce(w.weight, 1.0)) / any_value(i.norm) * 1.2 AS old
  FROM (SELECT id, unnest(parsed_tags) AS feature, sqrt(greatest(len(parsed_tags), 1)) AS norm FROM feat) i JOIN tagf f ON f.feature = i.feature LEFT JOIN tagw w ON w.feature = i.feature GROUP BY i.id),
wordp AS (
  SELECT i.id, sum(ln(1 + f.freq) * 10 * coalesce(w.weight, 1.0)) / any_value(i.norm) * 1.1 AS v, sum(f.freq * coalesce(w.weight, 1.0)) / any_value(i.norm) * 0.5 * 1.1 AS old
  FROM (SELECT id, unnest(title_words) AS feature, sqrt(greatest(len(title_words), 1)) AS norm FROM feat) i JOIN wordf f ON f.feature = i.feature LEFT JOIN wordw w ON w.feature = i.feature GROUP BY i.id),
authp AS (
  SELECT i.id, ln(1 + f.freq) * 10 * coalesce(w.weight, 5.0) * 0.8 AS v, f.freq * coalesce(w.weight, 5.0) * 0.8 AS old
  FROM feat i JOIN authf f ON f.feature = i.author LEFT JOIN authw w ON w.feature = i.author)"""
HPARTS = """ histp AS (
  SELECT id, sum(v) AS v FROM (
    SELECT i.id, b.bonus / i.norm * 0.7 AS v FROM (SELECT id, unnest(parsed_tags) AS feature, sqrt(greatest(len(parsed_tags), 1)) AS norm FROM feat) i JOIN bonus b ON b.facet = 'tag' AND b.feature = i.feature
    UNION ALL SELECT i.id, b.bonus / i.norm * 0.7 FROM (SELECT id, unnest(title_words) AS feature, sqrt(greatest(len(title_words), 1)) AS norm FROM feat) i JOIN bonus b ON b.facet = 'title_word' AND b.feature = i.feature
    UNION ALL SELECT i.id, b.bonus * 0.7 FROM feat i JOIN bonus b ON b.facet = 'author' AND b.feature = i.author)
  GROUP BY id)"""
SCORED = HIST + "," + PARTS + "," + HPARTS + """, scored AS (
  SELECT f.*, CAST(trunc(round(coalesce(t.v, 0) + coalesce(a.v, 0) + coalesce(w.v, 0) + coalesce(h.v, 0), 6)) AS INTEGER) AS score
  FROM feat f LEFT JOIN tagp t ON t.id = f.id LEFT JOIN authp a ON a.id = f.id LEFT JOIN wordp w ON w.id = f.id LEFT JOIN histp h ON h.id = f.id)"""
