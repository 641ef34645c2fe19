"""DuckDB SQL for those queries that SQL can express."""

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + 20 AS width FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(width) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP4 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM tokens
), items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN sets p ON p.doc_id = c.a JOIN sets q ON q.doc_id = c.b
  WHERE 100 * c.n >= 80 * (len(p.s) + len(q.s) - c.n)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sets
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""

OP5 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = v.vec_id
"""

#: Leaves, then nodes level by level; crc32 is counted bit by bit over the digits.
OP12 = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: i::BIGINT)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM own
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), low AS (
  SELECT tree, 0 AS level, pos AS idx, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 8, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos AS idx, n, digest FROM subroots
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 8, n
), nodes AS (
  SELECT tree, false AS top, level, idx, n, digest FROM low UNION ALL SELECT s.tree, true, h.level, h.idx, h.n, h.digest FROM high h, subroots s
), path AS (
  SELECT doc_id, tree, pos AS leaf_pos, false AS top, 0 AS level, pos AS idx, n, forged AS digest, '' AS proof, leaf FROM placed
  UNION ALL SELECT doc_id, tree, leaf_pos, up.top, up.level, up.idx, up.n, up.digest, up.proof, leaf FROM (
    SELECT p.doc_id, p.tree, p.leaf_pos, p.top, p.level + 1 AS level, p.idx // 8 AS idx, (p.n + 7) // 8 AS n, p.leaf,
      CASE WHEN any_value(p.digest) IS NOT NULL THEN sha256(string_agg(CASE WHEN x.idx = p.idx THEN p.digest ELSE x.digest END, '' ORDER BY x.idx)) END AS digest,
      any_value(p.proof) || coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (x.idx <> p.idx), '') AS proof
    FROM path p JOIN nodes x ON x.tree = p.tree AND x.top = p.top AND x.level = p.level AND x.idx // 8 = p.idx // 8
    WHERE p.n > 1 GROUP BY p.doc_id, p.tree, p.leaf_pos, p.top, p.level, p.idx, p.n, p.leaf
    UNION ALL
    SELECT p.doc_id, p.tree, p.leaf_pos, true, 0, s.pos, s.n, p.leaf, p.digest, p.proof FROM path p JOIN subroots s ON s.tree = p.tree WHERE p.n = 1 AND NOT p.top
  ) up
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, coalesce(p.digest, r.digest) AS folded_root,
  coalesce(p.digest, r.digest) = r.digest AS verified
FROM path p JOIN subroots s ON s.tree = p.tree, (SELECT digest FROM high WHERE n = 1) r WHERE p.top AND p.n = 1
"""

#: Every window's words by their digest, the smallest document of each, and the words that such windows cover.
OP11 = r"""
WITH tokens AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS first FROM windows) WHERE first < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens
), judged AS (
  SELECT e.doc_id, e.i, e.word, max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM each e LEFT JOIN repeated r ON r.doc_id = e.doc_id AND r.i = e.i
), summed AS (
  SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM judged GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM tokens t LEFT JOIN summed s ON s.doc_id = t.doc_id
"""
