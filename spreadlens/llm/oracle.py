"""DuckDB SQL of the operator queries that SQL can express on whole tables."""

from __future__ import annotations

from .chat import END, NEXT, SAYS, TURN
from .collocations import COVERED, LEAST, LONGEST, SCORE, TOP
from .decontaminate import NGRAM
from .embed_dedup import THRESHOLD
from .sharding import BUCKETS, SHARDS
from .url_filter import GLOBS, RULES, by_strength

#: Words, windows and hits by position; items shorter than the window are one window.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least({NGRAM}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ns WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(embedding, 'max') <> list_aggregate(embedding, 'min')),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id)
"""


def rendezvous(shards: int) -> str:
    return f"(SELECT arg_min(s, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s), 1, 12))::BIGINT + 0.5) / 281474976710656.0)) FROM range({shards}) t(s))::INT"


#: The checksum is a table-driven CRC-32 folded over the bytes of the text.
SHARDING = f"""
WITH RECURSIVE c AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
                     UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
x AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                                           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a // 256)), 4294967295) AS text_crc32 FROM x, tab),
p AS (SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, {rendezvous(SHARDS)} AS shard, {rendezvous(SHARDS + 1)} AS grown_shard,
             ('0x' || substr(md5(doc_id || ':' || size || ':' || text_crc32), 1, 12))::BIGINT % {BUCKETS} AS bucket FROM y)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard, bucket
FROM p
"""


def escaped(c: str) -> str:
    return f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({escaped('text')}) + CASE WHEN opens THEN {len(TURN) + len(SAYS) + len(END)} + length({escaped('role')}) ELSE {len(NEXT)} END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""

STRONGEST = [RULES[i] for i in reversed(by_strength(RULES))]


def glob_sql(glob: str) -> str:
    """A glob over host, path and query in SQL; the globs in use have no character that LIKE reads otherwise."""
    parts = zip(("'.' || host", "path", "query"), glob.split("\x00"), strict=True)
    return " AND ".join(f"({c}) LIKE '{p.replace('*', '%')}'" for c, p in parts if p != "*") or "true"


#: Every phrase of up to four words within its piece, its cuts, and the most frequent longer candidate around it.
COLLOCATIONS = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*)::BIGINT AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE f >= {LEAST}),
x AS (SELECT lang, w[i:i + m - 1] AS w, max(f) AS longer
      FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM c CROSS JOIN range(2, {LONGEST}) t(m) WHERE m < k) GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN x USING (lang, w) WHERE c.k >= 2 AND (longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * f::HUGEINT)),
cut AS (SELECT lang, w, f, unnest(range(1, k)) AS h FROM free),
s AS (SELECT cut.lang, cut.w, cut.f AS a, h, l.f AS l, r.f AS r, ({SCORE}::HUGEINT * cut.f // (l.f::HUGEINT + r.f))::BIGINT AS score
      FROM cut JOIN c l ON l.lang = cut.lang AND l.w = cut.w[1:h] JOIN c r ON r.lang = cut.lang AND r.w = cut.w[h + 1:]),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, h) = 1),
ranked AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""

#: Rules by host suffix and path prefix, the longest first; the method's globs as patterns over host, path and query.
URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM u),
j AS (SELECT *, CASE {" ".join(f"WHEN ('.' || host) LIKE '%.{r.host}' AND starts_with(path, '{r.path}') THEN {i}" for i, r in enumerate(STRONGEST))} END AS i FROM p)
SELECT page_id, host, path, {[r.name for r in STRONGEST]}[i + 1] AS rule,
       coalesce({[r.verdict for r in STRONGEST]}[i + 1], CASE WHEN {" OR ".join(f"({glob_sql(g)})" for g in GLOBS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""

SQL: dict[str, str] = {
    "op4_decontamination": DECONTAMINATION,
    "op6_embedding_near_dedup": EMBEDDINGS,
    "op7_sharding": SHARDING,
    "op8_chat_formatting": CHAT,
    "op11_phrase_collocations": COLLOCATIONS,
    "op12_url_filters": URLS,
}
