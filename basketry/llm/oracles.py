"""SQL equivalents of the queries that plain SQL can say."""

_LOWERED = "coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _words(separator: str) -> str:
    return f"list_filter(string_split_regex({_LOWERED}, '{separator}'), lambda x: x <> '')"


_ALNUM = _words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

WINNOWING = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN w ELSE w[s:s + 9] END AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
spans AS (
  SELECT r, n, s, w[s:s + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, s, n, item FROM spans JOIN windows USING (g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[\x20\x09-\x0D]+")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[s:s + 4] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

# crc32 is spelled out byte by byte and bit by bit; conversations are lists of turns, prefixes their slices
PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295::bigint) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), seqs AS (
  SELECT c.conv_id, coalesce(list(struct_pack(r := p.r, x := p.x) ORDER BY p.part, p.pos) FILTER (p.part IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id
), mem AS (
  SELECT conv_id, d, seq[1:d] AS prefix, len(seq) AS n FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM mem GROUP BY prefix, d
), kids AS (
  SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), weighed AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * length(n.prefix[n.d].x) ELSE 0 END AS own
  FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.prefix = k.prefix
), sums AS (
  SELECT m.prefix, m.d, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.own)::bigint AS saved_tokens
  FROM weighed w JOIN mem m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY m.prefix, m.d
)
SELECT w.conv_id, w.d::bigint AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM weighed w JOIN sums s ON w.d = s.d AND w.prefix = s.prefix
LEFT JOIN nodes u ON u.d = w.d - 1 AND u.prefix = w.prefix[1:w.d - 1]
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.lab = a.lab AS same, list_dot_product(a.v, r.v)::bigint AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
