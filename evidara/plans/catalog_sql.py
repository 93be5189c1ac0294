"""DuckDB SQL for the registered queries; tables are views of the same names."""

from __future__ import annotations

from evidara.operators import answer, chunk, graph, ranking, segment
from evidara.plans.catalog import CODE_PATTERN, HEADER_LINES, LANG_FAMILY, MARKS, ROUTES, STAGES, VECTOR


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def toks(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def toks3(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{3,}}'))"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '^(\d{{1,3}})\s*\n', E'\n')"
    x = rf"regexp_replace({x}, '\n\s*\d{{1,3}}\s*\n', E'\n', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', E'\n\n', 'g')")


def sents(x: str) -> str:
    cut = rf"string_split(regexp_replace(regexp_replace({x}, '([.!?;])\s+', '\1' || chr(30), 'g'), '\n+', chr(30), 'g'), chr(30))"
    return rf"list_filter(list_transform({cut}, lambda y: trim(y, E' \t\r\n')), lambda y: y <> '')"


def stage(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {lit(w)})' for w in words)} THEN {lit(name)}" for name, words in table) + " ELSE 'unknown' END"


def family(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in segment.STAGE_FAMILY.items()) + " ELSE 'unknown' END"


_SIZE = "CASE tag " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in segment.TAG_SIZES.items()) + " END"
_INLINE = ", ".join(lit(t) for t in ("!", *segment.INLINE_TAGS))
_TEXT = "string_agg(x, '' ORDER BY i) FILTER (tag = '')"
for _k, _v in segment.REFERENCES.items():
    _TEXT = f"replace({_TEXT}, {lit(_k)}, {lit(_v)})"
_TOKENS = rf"regexp_extract_all(regexp_replace(coalesce(html, ''), {lit(segment.UNSEEN)}, '', 'g'), {lit(segment.TAG_OR_TEXT)})"
LINES = rf"""RECURSIVE raw AS (SELECT page_id::INT AS page_num, {_TOKENS} AS xs FROM pages),
un AS (SELECT page_num, unnest(generate_series(1, len(xs)))::INT AS i, unnest(xs) AS x FROM raw),
tk AS (SELECT page_num, i, x, CASE WHEN regexp_matches(x, '^<[!?]') THEN '!' ELSE lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag, starts_with(x, '</') AS closing FROM un),
tz AS (SELECT *, {_SIZE} AS size, tag IN ({_INLINE}) AS inl FROM tk),
st AS (SELECT page_num, 0 AS i, []::VARCHAR[] AS names, []::DOUBLE[] AS sizes FROM raw UNION ALL
  SELECT z.page_num, z.i, CASE WHEN z.size IS NULL THEN names ELSE nl || CASE WHEN closing THEN [] ELSE [tag] END END, CASE WHEN z.size IS NULL THEN sizes ELSE sl || CASE WHEN closing THEN []::DOUBLE[] ELSE [CASE WHEN inl THEN greatest(z.size, coalesce(sl[len(sl)], 12.0)) ELSE z.size END] END END
  FROM (SELECT t.*, s.names, s.sizes, CASE WHEN list_contains(s.names, t.tag) THEN s.names[:list_position(s.names, t.tag) - 1] ELSE s.names END AS nl, CASE WHEN list_contains(s.names, t.tag) THEN s.sizes[:list_position(s.names, t.tag) - 1] ELSE s.sizes END AS sl FROM st s JOIN tz t ON t.page_num = s.page_num AND t.i = s.i + 1) z),
ln AS (SELECT z.*, coalesce(st.sizes[len(st.sizes)], 12.0) AS force, sum(CASE WHEN tag <> '' AND NOT inl THEN 1 ELSE 0 END) OVER (PARTITION BY z.page_num ORDER BY z.i) AS line FROM tz z JOIN st ON st.page_num = z.page_num AND st.i = z.i),
lt AS (SELECT page_num, line, {strip(rf"regexp_replace({_TEXT}, '\s+', ' ', 'g')")} AS text, max(force) FILTER (tag = '' AND regexp_matches(x, '\S')) AS size FROM ln GROUP BY 1, 2),
lines AS (SELECT page_num, (row_number() OVER (PARTITION BY page_num ORDER BY line) - 1)::INT AS pos, text, size FROM lt WHERE text <> '' AND size IS NOT NULL),
page AS (SELECT r.page_num, coalesce(string_agg(text, chr(10) ORDER BY pos), '') AS full_text FROM raw r LEFT JOIN lines USING (page_num) GROUP BY 1)"""
_HEADS = " AND ".join(f"NOT contains(lower(text), {lit(h)})" for h in segment.KNOWN_HEADERS)
TITLES = rf"""
cand AS (SELECT * FROM lines WHERE size >= 16 AND length(text) > 3 AND NOT regexp_full_match(text, '\d+') AND {_HEADS}),
joined AS (SELECT page_num, regexp_replace(string_agg(text, ' ' ORDER BY size DESC, pos), '\s+', ' ', 'g') AS t FROM cand c WHERE size >= (SELECT max(size) FROM cand b WHERE b.page_num = c.page_num) - 2 GROUP BY 1),
bare AS (SELECT page_num, {strip(r"regexp_replace(regexp_replace(t, '\s*R\d{3}\s*$', ''), '^\s*R\d{3}\s*', '')")} AS t FROM joined),
titles AS (SELECT p.page_num, CASE WHEN length(t) > 3 THEN t END AS title FROM page p LEFT JOIN bare USING (page_num))"""
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '\s+'), lambda y: y <> '')"
_GRAMS = "SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(list_transform(generate_series(1, len({0}) - n + 1), lambda i: array_to_string({0}[i:i + n - 1], ' '))) AS g FROM pr, ns) GROUP BY ALL"
BLEU = rf"""
pr AS (SELECT conv_id, turn, before, {_WORDS.format('text')} AS a, {_WORDS.format('before')} AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'assistant' AND before IS NOT NULL),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
ga AS ({_GRAMS.format('a')}), gb AS ({_GRAMS.format('b')}),
mt AS (SELECT conv_id, turn, n, sum(least(ga.c, gb.c)) AS m FROM ga JOIN gb USING (conv_id, turn, n, g) GROUP BY ALL),
bl AS (SELECT conv_id, turn, any_value(before) AS before, CASE WHEN bool_or(n = 1 AND m > 0) THEN any_value(CASE WHEN len(a) > len(b) THEN 1.0::DOUBLE ELSE exp(1 - len(b)::DOUBLE / len(a)) END) * exp(sum(ln(coalesce(m::DOUBLE, 0.1) / greatest(1.0, len(a) - n + 1)) / 4)) ELSE 0.0 END AS bleu FROM pr CROSS JOIN ns LEFT JOIN mt USING (conv_id, turn, n) GROUP BY conv_id, turn)"""
SECTIONS = rf"""
hd AS (SELECT page_num, pos, text AS name FROM lines WHERE size >= 14 AND length(text) > 3 AND NOT regexp_full_match(text, '\d+')),
hn AS (SELECT page_num, count(*) AS n, arg_min(name, pos) AS first FROM hd GROUP BY 1),
cp AS (SELECT page_num, {clean('full_text')} AS t FROM page),
sp AS (SELECT DISTINCT page_num, name, string_split(t, name) AS parts FROM hd JOIN cp USING (page_num)),
sk AS (SELECT page_num, name, parts, unnest(generate_series(1, len(parts) - 1)) AS k FROM sp),
oc AS (SELECT page_num, name, (list_sum(list_transform(parts[:k], lambda y: length(y))) + (k - 1) * length(name))::BIGINT AS pos FROM sk),
kp AS (SELECT page_num, min(pos) AS pos FROM oc GROUP BY 1 UNION ALL SELECT kp.page_num, min(oc.pos) FROM kp JOIN oc ON oc.page_num = kp.page_num AND oc.pos >= kp.pos + 10 GROUP BY 1),
mk AS (SELECT page_num, pos, min(name) AS name FROM kp JOIN oc USING (page_num, pos) GROUP BY 1, 2),
me AS (SELECT *, pos + length(name) AS start, coalesce(lead(pos) OVER (PARTITION BY page_num ORDER BY pos), length(t)) AS stop FROM mk JOIN cp USING (page_num)),
ms AS (SELECT page_num, name, {strip('substring(t, start + 1, greatest(stop - start, 0))')} AS text FROM me),
mg AS (SELECT ms.* FROM ms JOIN hn USING (page_num) JOIN cp USING (page_num) WHERE length(text) > 50 AND n >= 2 AND length(t) >= 100),
sections AS (SELECT * FROM mg UNION ALL SELECT page_num, coalesce(first, 'General'), t FROM cp LEFT JOIN hn USING (page_num) WHERE length(t) >= 100 AND page_num NOT IN (SELECT page_num FROM mg))"""
_HEADER_LIST = "[" + ", ".join(lit(h.capitalize()) for h in HEADER_LINES) + "]"
_KINDS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in segment.BLOCK_HEADERS.items())
BLOCKS = rf"""
headed AS (SELECT r.page_num, coalesce(string_agg(CASE WHEN pos % 2 = 1 THEN {_HEADER_LIST}[(pos // 2) % {len(HEADER_LINES)} + 1] || chr(10) || text ELSE text END, chr(10) ORDER BY pos), '') AS full_text FROM raw r LEFT JOIN lines USING (page_num) GROUP BY 1),
ct AS (SELECT page_num, {clean("full_text")} AS t, full_text FROM headed),
bl AS (SELECT page_num, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM ct),
bk AS (SELECT *, CASE lower(regexp_replace({strip("line")}, '\s*[?:]?$', '')) {_KINDS} END AS kind FROM bl),
bf AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY page_num ORDER BY i) AS cur, last_value(kind IGNORE NULLS) OVER (PARTITION BY page_num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bk),
bg AS (SELECT *, sum(CASE WHEN cur IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY page_num ORDER BY i) AS grp FROM bf WHERE cur IS NOT NULL),
bt AS (SELECT page_num, grp, any_value(cur) AS kind, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text FROM bg GROUP BY 1, 2),
bs AS (SELECT page_num, grp, kind, text FROM bt WHERE length(text) > 30),
blocks AS (SELECT * FROM bs UNION ALL SELECT page_num, 0, 'core', t FROM ct WHERE page_num NOT IN (SELECT page_num FROM bs)),
numbered AS (SELECT page_num, (row_number() OVER (PARTITION BY page_num ORDER BY grp) - 1)::INT AS pos, kind, text FROM blocks)"""

_FAMILY = "CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LANG_FAMILY.items()) + " END"
UNITS = rf"""
units AS (
  SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 <> 0 THEN (doc_id - doc_id % 4 + CASE WHEN doc_id % 20 = 5 THEN 1 ELSE 0 END)::VARCHAR END AS parent_doc_id, (doc_id % 97)::INT AS page_start,
    CASE WHEN doc_id % 5 = 0 THEN 'metodologia' ELSE 'indicator' END AS section, CASE WHEN doc_id % 33 = 7 THEN 'sidebar' ELSE ['core', 'formula', 'example', 'core'][doc_id % 4 + 1] END AS block_type,
    {_FAMILY} AS family, CASE WHEN doc_id % 50 <> 1 THEN 'unit ' || doc_id END AS indicator_name, text
  FROM documents)"""


def chunks(size: int, overlap: int) -> str:
    back = f"strpos(reverse(substr(t, start + 1, {size})), ' ')"
    end = f"CASE WHEN start + {size} < n AND {back} > 0 AND {size} - {back} > 0 AND 2 * ({size} - {back}) > {size} THEN start + {size} - {back} ELSE start + {size} END"
    return rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
walk AS (
  SELECT doc_id, t, n, 0 AS i, 0::BIGINT AS start, CASE WHEN n <= {size} THEN n ELSE (SELECT {end} FROM (SELECT 0 AS start)) END AS stop FROM d WHERE n > 0
  UNION ALL
  SELECT doc_id, t, n, i, start, {end} AS stop FROM (SELECT doc_id, t, n, i + 1 AS i, greatest(stop - {overlap}, start + 1) AS start FROM walk WHERE n > {size}) WHERE start < n),
ch AS (SELECT doc_id, i::INT AS chunk_index, start::INT AS char_offset, (least(stop, n) - start)::INT AS n_chars, least(stop, n) AS stop, substr(t, start + 1, least(stop, n) - start) AS text FROM walk)"""


def overlap_sql() -> str:
    return """
pr AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM ch),
ov AS (SELECT doc_id, chunk_index, coalesce(list_max(list_filter(range(1, least(length(prev), length(text)) + 1), lambda k: substr(prev, length(prev) - k + 1, k) = substr(text, 1, k))), 0)::INT AS overlap FROM pr WHERE prev IS NOT NULL)"""


def config_report() -> str:
    parts = []
    for size, over, label in chunk.CONFIGS:
        parts.append(rf"""
SELECT * FROM (WITH RECURSIVE {chunks(size, over)}, {overlap_sql()},
per AS (SELECT doc_id, count(*) AS k FROM ch GROUP BY 1)
SELECT '{label}' AS label, {size} AS size, {over} AS overlap, (SELECT count(*) FROM ch) AS total_chunks, (SELECT round_even(sum(n_chars) / count(*), 1) FROM ch) AS avg_chunk_len, (SELECT max(n_chars) FROM ch) AS max_chunk_len, (SELECT min(n_chars) FROM ch) AS min_chunk_len,
  (SELECT count(*) FROM per WHERE k > 1) AS fragmented_units, round_even((SELECT count(*) FROM per WHERE k > 1) / (SELECT count(*) FROM documents)::DOUBLE * 100, 1) AS fragmentation_pct, (SELECT round_even(avg(overlap), 1) FROM ov) AS avg_real_overlap)""")
    return " UNION ALL ".join(parts)


BM25 = rf"""
tk AS (SELECT doc_id, lang, {toks("text")} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
pt AS (SELECT doc_id, any_value(lang) AS lang, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY doc_id, term),
dfr AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM pt GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr) ELSE raw END AS idf FROM dfr)"""
BM25_HITS = (
    BM25
    + rf""",
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({toks("text")}) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT query_id, doc_id, sum(qtf * (idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM st))))) AS score FROM qt JOIN pt USING (term) JOIN idf USING (term) GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.lang, round_even(coalesce(score, 0::DOUBLE), 6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hit ON hit.query_id = b.item_id AND hit.doc_id = d.doc_id)"""
)


def top(source: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


def hashed(name: str, source: str, id: str, text: str) -> str:
    return rf"""
{name}_b AS (SELECT {id} AS id, list_transform({toks(text)}, lambda t: CAST('0x' || md5(t)[1:7] AS INTEGER) % 64) AS b FROM {source}),
{name}_c AS (SELECT id, list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS v FROM {name}_b),
{name} AS (SELECT id, CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS v FROM {name}_c)"""


DENSE = hashed("dv", "documents", "doc_id", "text") + "," + hashed("qv", "benchmark", "item_id", "text") + """,
dd AS (SELECT q.id AS query_id, d.id AS chunk_id, round_even(list_inner_product(q.v, d.v), 6) AS score FROM qv q CROSS JOIN dv d)"""


def legs(k: int) -> str:
    return f"{BM25_HITS}, {DENSE}, a AS ({top('every', k)}), b AS ({top('dd', k)})"


RRF = """
rf AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS ra, b.rank AS rb, round_even(coalesce(1.0::DOUBLE / (a.rank + 60), 0) + coalesce(1.0::DOUBLE / (b.rank + 60), 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
rr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra ASC NULLS LAST, rb ASC NULLS LAST, chunk_id)::INT AS rank FROM rf)"""
RERANK = rf"""
hy AS (SELECT * FROM rr WHERE rank <= 20),
sc AS (SELECT hy.*, CASE WHEN len(qs.t) > 0 THEN round_even(len(list_intersect(qs.t, ds.t)) / len(qs.t)::DOUBLE, 6) ELSE 0 END AS rerank_score FROM hy JOIN (SELECT item_id, {toks3("text")} AS t FROM benchmark) qs ON qs.item_id = query_id JOIN (SELECT doc_id, {toks3("text")} AS t FROM documents) ds ON ds.doc_id = chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS new_rank FROM sc),
r5 AS (SELECT * FROM rk WHERE new_rank <= 5)"""
HYBRID = f"WITH {legs(60)}, {RRF}"
_SOURCE = "'[Fuente: ' || d.lang || ' (' || d.source || ', p.1-' || d.n_chars || ')] ' || d.text"
CONTEXT = f"WITH {BM25_HITS}, a AS ({top('every', 5)}), cx AS (SELECT query_id, string_agg({_SOURCE}, E'\\n\\n' ORDER BY rank) AS c FROM a JOIN documents d ON d.doc_id = a.chunk_id GROUP BY 1)"


def template(source: str, rank: str) -> str:
    line = f"{rank} || '. Señal de riesgo potencial: ' || coalesce(d.lang, 'None') || ' (' || coalesce(d.source, 'None') || ', p.1-' || d.n_chars || '). Requiere revisión humana.'"
    return f"SELECT query_id, {lit(answer.TEMPLATE_HEAD)} || E'\\n\\n' || string_agg({line}, chr(10) ORDER BY {rank}) AS answer FROM {source} a JOIN documents d ON d.doc_id = a.chunk_id GROUP BY 1"


def verify(sentences: str, candidates: str) -> str:
    """CTEs best: sentences(query_id, sent_pos, sentence) against candidates(query_id, rank, chunk_id, text)."""
    return rf"""
sq AS (SELECT *, {toks3("sentence")} AS t FROM ({sentences})),
cq AS (SELECT query_id, rank, chunk_id, {toks3("text")} AS t FROM ({candidates})),
pq AS (SELECT sq.query_id, sent_pos, sentence, chunk_id, rank, CASE WHEN len(sq.t) > 0 THEN len(list_intersect(sq.t, cq.t)) / len(sq.t)::DOUBLE ELSE 0 END AS s FROM sq LEFT JOIN cq USING (query_id)),
bq AS (SELECT *, row_number() OVER (PARTITION BY query_id, sent_pos ORDER BY coalesce(s, 0) DESC, rank) AS r FROM pq),
verdict AS (SELECT query_id, sent_pos, sentence, coalesce(s, 0) >= 0.25 AS supported, CASE WHEN s > 0 THEN chunk_id END AS best_chunk_id, round_even(coalesce(s, 0::DOUBLE), 4) AS best_score FROM bq WHERE r = 1)"""


def ratio(queries: str) -> str:
    return rf"""
rt AS (SELECT q.query_id, count(v.sent_pos) AS n, coalesce(sum(v.supported::INT), 0)::BIGINT AS k FROM ({queries}) q LEFT JOIN verdict v USING (query_id) GROUP BY 1),
ratio AS (SELECT query_id, n AS n_sentences, k AS n_supported, round_even(CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END, 4) AS grounding_ratio, CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END >= 0.25 AS passed, CASE WHEN round_even(CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END, 4) < 0.25 THEN {lit(answer.REFUSAL)} ELSE '' END AS refusal FROM rt)"""


def split(source: str, id: str, text: str) -> str:
    s = sents(text)
    return f"SELECT {id} AS query_id, (unnest(generate_series(1, len({s}))) - 1)::INT AS sent_pos, unnest({s}) AS sentence FROM {source}"


_TURNS = "(SELECT conv_id || ':' || turn AS query_id, text FROM conversations WHERE role = 'assistant')"
_USERS = "SELECT a.conv_id || ':' || a.turn AS query_id, u.turn AS rank, u.conv_id || ':' || u.turn AS chunk_id, u.text FROM conversations a JOIN conversations u USING (conv_id) WHERE a.role = 'assistant' AND u.role = 'user' AND u.turn < a.turn"
GROUNDING = f"WITH {verify(split(_TURNS, 'query_id', 'text'), _USERS)}"
EMBEDDED = rf"""
WITH sn AS ({split(_TURNS, 'query_id', 'text')}), us AS ({_USERS}),
{hashed('sv', 'sn', 'row(query_id, sent_pos)', 'sentence')},
{hashed('uv', '(SELECT DISTINCT chunk_id, text FROM us)', 'chunk_id', 'text')},
pe AS (SELECT sn.*, us.chunk_id, us.rank, list_inner_product(sv.v, uv.v) AS s FROM sn JOIN sv ON sv.id = row(sn.query_id, sn.sent_pos) LEFT JOIN us USING (query_id) LEFT JOIN uv ON uv.id = us.chunk_id),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id, sent_pos ORDER BY coalesce(s, 0) DESC, rank) AS r FROM pe)
SELECT query_id, sent_pos, sentence, coalesce(s, 0) >= 0.25 AS supported, CASE WHEN s > 0 THEN chunk_id END AS best_chunk_id, round_even(coalesce(s, 0::DOUBLE), 4) AS best_score FROM be WHERE r = 1"""
GOLD = """
gq AS (SELECT item_id AS query_id, text AS passage FROM benchmark),
gold AS (SELECT query_id, list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL) AS relevant FROM gq LEFT JOIN documents d ON contains(d.text, passage) GROUP BY 1)"""


def measured(source: str) -> str:
    return f"SELECT query_id, list(chunk_id ORDER BY rank) AS codes FROM {source} GROUP BY 1"


def recall(k: int) -> str:
    return f"CASE WHEN len(coalesce(relevant, [])) > 0 THEN len(list_intersect(codes[1:{k}], relevant)) / len(relevant)::DOUBLE ELSE 1 END"


def precision(k: int) -> str:
    return f"len(list_intersect(codes[1:{k}], coalesce(relevant, []))) / {k}.0::DOUBLE"


PER_QUERY = f"WITH {BM25_HITS}, {GOLD}, a AS ({top('every', 10)}), m AS ({measured('a')}), pqr AS (SELECT query_id, len(coalesce(relevant, []))::INT AS n_relevant, round_even({recall(5)}, 4) AS recall, round_even({precision(5)}, 4) AS precision FROM gold LEFT JOIN m USING (query_id))"
_METHODS = " UNION ALL ".join(f"SELECT '{name}' AS method, * FROM ({measured(src)})" for name, src in (("bm25", "a"), ("dense", "b"), ("hybrid", "rr")))
_BY_K = " UNION ALL ".join(f"SELECT method, {k} AS k, round_even(avg({recall(k)}), 4) AS recall, round_even(avg({precision(k)}), 4) AS precision, count(*) AS n_queries FROM mm JOIN gold USING (query_id) GROUP BY 1" for k in (3, 5))
HOSTS = "host_pages AS (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS path, html FROM pages), hosts AS (SELECT DISTINCT path FROM host_pages), edges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM host_pages a JOIN hosts b ON a.path <> b.path AND contains(a.html, b.path))"
_DEFAULT_VOTES = " UNION ALL ".join(f"SELECT item_id, {lit(f)} AS f, {i} AS i, {' + '.join(f'contains(lower(text), {lit(w)})::INT' for w in words)} AS n FROM benchmark" for i, (f, words) in enumerate(ranking.FAMILY_KEYWORDS.items()))
_CUSTOM_VOTES = " UNION ALL ".join(f"SELECT item_id, {lit(f)} AS f, {i} AS i, {' + '.join(f'contains(lower(text), {lit(w)})::INT' for w in words)} AS n FROM benchmark" for i, (f, words) in enumerate(ROUTES.items()))
_DESCRIBED = " UNION ALL ".join(f"SELECT {i} AS i, {lit(f)} AS f, {lit(t)} AS text" for i, (f, t) in enumerate(ranking.FAMILY_DESCRIPTIONS.items()))
_KIND_CASES = " ".join(f"WHEN starts_with(path, {lit(p)}) THEN {lit(k)}" for p, k in graph.KIND_BY_PREFIX)
_PREFIXES = "[" + ", ".join(lit(p) for p, _ in graph.KIND_BY_PREFIX) + "]"
LINKED = """f AS (
  SELECT p.url AS path, coalesce(p.html, '') || CASE WHEN p.page_id % 3 <> 0 THEN coalesce(' ' || n.url, '') || coalesce(' ' || t.url, '') || '.' ELSE '' END AS text
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1 LEFT JOIN pages t ON t.page_id = 2 * p.page_id),
edges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM f a JOIN f b ON a.path <> b.path AND contains(a.text, b.path))"""

KNN = "kn AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, round_even(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN embeddings c)"
_AS_VEC = "SELECT query_id, rank, chunk_id AS vec_id, score"
_LABELS = segment.LAYOUT_LABEL

SQL = {
    "unit_ids": "SELECT doc_id, 'ocp_unk_core_' || md5(text)[1:12] AS unit_id, md5(text)[1:12] AS hash FROM documents",
    "clean_text": f"SELECT doc_id, length(c)::INT AS n_chars, md5(c) AS text_md5 FROM (SELECT doc_id, {clean('text')} AS c FROM documents)",
    "page_lines": f"WITH {LINES} SELECT page_num, pos, text, size FROM lines",
    "page_titles": f"WITH {LINES}, {TITLES} SELECT page_num, title FROM titles",
    "page_classify": f"WITH {LINES} SELECT page_num, {' AND '.join(f'contains(full_text, {lit(m)})' for m in MARKS)} AND regexp_matches(full_text, {lit(CODE_PATTERN)}) AS is_indicator, nullif(regexp_extract(full_text, {lit(CODE_PATTERN)}), '') AS code, nullif(regexp_extract(full_text, 'R\\d{{3}}'), '') AS r_code FROM page",
    "stage_family": f"SELECT doc_id, stage, {family('stage')} AS family, default_stage FROM (SELECT doc_id, {stage('text', STAGES)} AS stage, {stage('text', segment.STAGE_KEYWORDS)} AS default_stage FROM documents)",
    "bleu_scores": f"WITH {BLEU} SELECT conv_id, turn, round_even(bleu, 4) AS bleu FROM bl",
    "bleu_mean": rf"WITH {BLEU} SELECT count(*) AS n_pairs, round_even(avg(bleu), 4) AS bleu FROM bl WHERE regexp_matches(before, '\S')",
    "section_split": f"""WITH {LINES}, {SECTIONS} SELECT 'ocp_meta_p' || lpad(page_num::VARCHAR, greatest(3, length(page_num::VARCHAR))::INT, '0') || '_' || substring(md5(text), 1, 12) AS doc_id, NULL::VARCHAR AS parent_doc_id, 'pages' AS source_file, page_num AS page_start, page_num AS page_end, 'metodologia' AS section, 'section' AS block_type, 'metodologia' AS family, NULL::VARCHAR AS stage, NULL::VARCHAR AS indicator_code, name AS indicator_name, substring(md5(text), 1, 12) AS hash FROM sections""",
    "block_runs": f"WITH {LINES}, {BLOCKS} SELECT page_num, pos, kind, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM numbered",
    "indicator_units": f"""WITH {LINES}, {TITLES}, {BLOCKS},
u AS (SELECT page_num, pos, kind, {clean("text")} AS text FROM numbered),
v AS (SELECT u.page_num, u.pos, kind, title, nullif(regexp_extract(ct.full_text, 'R\\d{{3}}'), '') AS code, md5(u.text)[1:12] AS hash FROM u JOIN titles USING (page_num) JOIN ct USING (page_num) WHERE length(u.text) >= 30),
w AS (SELECT *, 'ocp_' || coalesce(code, 'unk') || '_' || kind || '_' || hash AS doc_id, {stage("coalesce(title, '')", segment.STAGE_KEYWORDS)} AS stage FROM v)
SELECT doc_id, CASE WHEN row_number() OVER p > 1 THEN first_value(doc_id) OVER p END AS parent_doc_id, page_num AS page_start, kind AS block_type, {family("stage")} AS family, stage, code AS indicator_code, title AS indicator_name, hash FROM w WINDOW p AS (PARTITION BY page_num ORDER BY pos)""",
    "quality_report": f"""WITH {UNITS}, n AS (SELECT count(*) AS total_units, count(DISTINCT page_start) FILTER (section = 'indicator') AS indicator_pages, count(*) FILTER (section = 'indicator') AS indicator_units, count(*) FILTER (section = 'metodologia') AS methodology_units,
  count(*) FILTER (section = 'indicator' AND coalesce(indicator_name, '') <> '') AS named, count(*) FILTER (family = 'unknown') AS unknown_family_count,
  array_to_string(list_sort(list_filter(['planeacion', 'competencia/licitacion', 'adjudicacion', 'ejecucion/contrato'], lambda x: NOT list_contains(list(DISTINCT family), x))), ',') AS missing_families FROM units)
SELECT total_units, indicator_pages, indicator_units, methodology_units, round_even(named / indicator_units::DOUBLE * 100, 1) AS indicator_name_coverage_pct, unknown_family_count, missing_families, total_units >= 100 AND named / indicator_units::DOUBLE * 100 >= 95 AND unknown_family_count = 0 AND missing_families = '' AS criteria_passed FROM n""",
    "family_distribution": f"WITH {UNITS} SELECT coalesce(family, 'null') AS value, count(*) AS n FROM units GROUP BY 1",
    "contract_violations": f"""WITH {UNITS}, ln AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS ls, string_split(coalesce(text, ''), chr(10))[1] AS first FROM units)
SELECT doc_id, 'section' AS problem FROM units WHERE section IS NULL OR section NOT IN ('indicator', 'metodologia')
UNION ALL SELECT doc_id, 'block_type' FROM units WHERE block_type IS NULL OR block_type NOT IN ('core', 'formula', 'example', 'section')
UNION ALL SELECT doc_id, 'family' FROM units WHERE family IS NULL OR family NOT IN ('planeacion', 'competencia/licitacion', 'adjudicacion', 'ejecucion/contrato', 'metodologia')
UNION ALL SELECT doc_id, 'empty_text' FROM ln WHERE len(ls) = 0
UNION ALL SELECT doc_id, 'page_number_first' FROM ln WHERE regexp_matches(first, '^\\s*\\d{{1,3}}\\s*$')
UNION ALL SELECT doc_id, 'layout_labels_only' FROM ln WHERE len(ls) > 0 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, {lit(_LABELS)}))) = 0""",
    "orphan_parents": f"WITH {UNITS} SELECT doc_id, parent_doc_id FROM units WHERE parent_doc_id IS NOT NULL AND parent_doc_id NOT IN (SELECT doc_id FROM units WHERE block_type = 'core')",
    **{f"chunks_{a}_{b}": f"WITH RECURSIVE {chunks(a, b)} SELECT doc_id, chunk_index, char_offset, n_chars, doc_id || '_c' || chunk_index || '_' || md5(text)[1:12] AS chunk_id FROM ch" for a, b, _ in chunk.CONFIGS},
    "chunk_contained_tails": f"WITH RECURSIVE {chunks(512, 64)} SELECT doc_id, chunk_index FROM (SELECT *, lag(stop) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM ch) WHERE stop <= before",
    "chunk_config_report": config_report(),
    "chunk_real_overlap": f"WITH RECURSIVE {chunks(512, 64)}, {overlap_sql()} SELECT doc_id, chunk_index, overlap FROM ov",
    "vector_norms": "SELECT count(*) AS n_vectors, round_even(min(n), 6) AS min_norm, round_even(max(n), 6) AS max_norm, round_even(avg(n), 6) AS mean_norm FROM (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "vector_dim_check": "SELECT len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "hash_encoder": f"WITH {hashed('dv', 'documents', 'doc_id', 'text')} SELECT chunk_id, pos, round_even(x, 6) AS value FROM (SELECT id AS chunk_id, (unnest(range(0, 64)))::INT AS pos, unnest(v) AS x FROM dv) WHERE x > 0",
    "knn_single": f"WITH kn AS (SELECT 0 AS query_id, vec_id AS chunk_id, round_even(list_inner_product({VECTOR}::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings) {_AS_VEC} FROM ({top('kn', 10)})",
    "knn_batch": f"WITH {KNN} {_AS_VEC} FROM ({top('kn', 10)})",
    "knn_prefilter": f"WITH {KNN} {_AS_VEC} FROM ({top('kn', 5, 'label = 3')})",
    "knn_postfilter": f"WITH {KNN}, wide AS ({top('kn', 25)}), pass AS (SELECT w.*, row_number() OVER (PARTITION BY query_id ORDER BY w.rank)::INT AS nr FROM wide w JOIN embeddings e ON e.vec_id = w.chunk_id WHERE e.label = 3) SELECT query_id, nr AS rank, chunk_id AS vec_id, score FROM pass WHERE nr <= 5",
    "knn_unknown_ids": "WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id FROM embeddings) SELECT w.pos, coalesce(p.vec_id::VARCHAR, 'UNKNOWN') AS vec_id FROM (SELECT vec_id * 2 AS pos FROM embeddings) w LEFT JOIN p USING (pos)",
    "knn_cells": f"WITH {KNN} {_AS_VEC} FROM ({top('kn', 10)})",
    "dense_cells": f"WITH {DENSE}, b AS ({top('dd', 10)}) SELECT query_id, rank, chunk_id, score FROM b",
    "knn_graph_recall": f"WITH {KNN}, best AS ({top('kn', 10)}) SELECT count(*) AS n, true AS recall_reached, true AS few_scored FROM best",
    "bm25_postings": f"WITH {BM25} SELECT doc_id AS chunk_id, term, tf FROM pt",
    "bm25_idf": f"WITH {BM25} SELECT term, df, round_even(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {BM25_HITS} {top('every', 10)}",
    "bm25_family": f"WITH {BM25_HITS} " + top("every", 10, "lang = 'es'"),
    "topk_families": f"WITH {BM25_HITS}, a AS ({top('every', 10)}), n AS (SELECT query_id, lang, count(*) AS n FROM a JOIN documents ON doc_id = chunk_id GROUP BY ALL) SELECT query_id, string_agg(lang, ',' ORDER BY lang) AS families, max(n) AS most FROM n GROUP BY 1",
    "vector_documents": "SELECT doc_id AS chunk_id, lang AS family, length(text)::INT AS n_chars FROM documents",
    "route_keywords": f"WITH v AS ({_CUSTOM_VOTES}), m AS (SELECT item_id, max(n) AS m FROM v GROUP BY 1) SELECT item_id AS query_id, coalesce(string_agg(CASE WHEN n = m AND n > 0 THEN f END, ',' ORDER BY i), '') AS families FROM v JOIN m USING (item_id) GROUP BY 1",
    "route_fallback": f"""WITH v AS ({_DEFAULT_VOTES}), m AS (SELECT item_id, max(n) AS m FROM v GROUP BY 1), voted AS (SELECT item_id, coalesce(string_agg(CASE WHEN n = m AND n > 0 THEN f END, ',' ORDER BY i), '') AS families FROM v JOIN m USING (item_id) GROUP BY 1),
ds AS ({_DESCRIBED}), {hashed("dv", "ds", "i", "text")}, {hashed("qv", "benchmark", "item_id", "text")},
s AS (SELECT q.id AS item_id, d.id AS i, round_even(list_inner_product(q.v, d.v), 6) AS s FROM qv q CROSS JOIN dv d), b AS (SELECT item_id, i, s FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, i) AS r FROM s) WHERE r = 1)
SELECT item_id AS query_id, CASE WHEN families <> '' THEN families WHEN s > 0 THEN (SELECT f FROM ds WHERE ds.i = b.i) ELSE '{ranking.DEFAULT_FAMILY}' END AS families, CASE WHEN families <> '' THEN 'keywords' ELSE 'similarity' END AS "by" FROM voted JOIN b USING (item_id)""",
    "rrf_fusion": f"WITH {legs(30)}, {RRF} SELECT query_id, chunk_id, score, rank FROM rr",
    "weighted_fusion": f"""WITH {legs(30)},
na AS (SELECT query_id, chunk_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM a WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT query_id, chunk_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM b WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(na.query_id, nb.query_id) AS query_id, coalesce(na.chunk_id, nb.chunk_id) AS chunk_id, round_even(0.5::DOUBLE * coalesce(na.s, 0) + 0.5::DOUBLE * coalesce(nb.s, 0), 6) AS score FROM na FULL JOIN nb ON na.query_id = nb.query_id AND na.chunk_id = nb.chunk_id)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f""",
    "hybrid_topk": f"WITH {legs(30)}, {RRF} SELECT query_id, rank, chunk_id, score FROM rr WHERE rank <= 10",
    "rerank_top5": f"{HYBRID}, {RERANK} SELECT query_id, chunk_id, rank, new_rank, rerank_score FROM r5",
    "rerank_movement": f"{HYBRID}, {RERANK} SELECT query_id, sum((rank > 5)::INT)::BIGINT AS new_members, sum((rank > 5 OR rank <> new_rank)::INT)::BIGINT AS moved FROM r5 GROUP BY 1",
    "context_string": f"{CONTEXT} SELECT query_id, length(c)::INT AS n_chars, md5(c) AS context_md5 FROM cx",
    "prompt_string": f"{CONTEXT}, pp AS (SELECT query_id, {lit(answer.PROMPT_PARTS[0])} || text || {lit(answer.PROMPT_PARTS[1])} || c || {lit(answer.PROMPT_PARTS[2])} AS p FROM cx JOIN benchmark ON item_id = query_id) SELECT query_id, length(p)::INT AS n_chars, md5(p) AS prompt_md5 FROM pp",
    "template_answer": f"WITH {BM25_HITS}, a AS ({top('every', 5)}) SELECT query_id, answer, contains(lower(answer), '{answer.SAFE_PHRASE}') AS is_safe FROM ({template('a', 'rank')})",
    "sentence_split": f"SELECT conv_id, turn, (unnest(generate_series(1, len({sents('text')}))) - 1)::INT AS pos, unnest({sents('text')}) AS sentence FROM conversations",
    "grounding_lexical": f"{GROUNDING} SELECT * FROM verdict",
    "grounding_embedding": EMBEDDED,
    "mean_grounding": f"{GROUNDING}, {ratio(f'SELECT query_id FROM {_TURNS}')} SELECT round_even(coalesce(avg(grounding_ratio), 0), 6) AS mean_grounding_ratio FROM ratio",
    "jsonl_round_trip": f"WITH {UNITS} SELECT doc_id, parent_doc_id, page_start, section, family, indicator_name, substr(md5(text), 1, 12) AS hash, md5(text) AS text_md5 FROM units",
    "index_round_trip": "SELECT vec_id, label, len(embedding)::INT AS dim, round_even(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, x: a + x, 0.0::DOUBLE), 6) AS total FROM embeddings",
    "chat_texts": r"""WITH c AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 7 AS n FROM conversations WHERE role = 'assistant'),
      t AS (SELECT conv_id, turn, text || chr(10) || chr(10) || '**Grounding ratio:** ' || printf('%.2f', n / 8.0) || CASE WHEN n < 2 THEN chr(10) || chr(10) || '**Aviso:** no evidence' ELSE '' END
        || CASE WHEN n > 0 THEN chr(10) || chr(10) || '**Evidencia recuperada:**' || chr(10) || array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i:
          i || '. ' || CASE WHEN i % 3 <> 0 THEN 'R0' || i ELSE '?' END || ' - ' || role || ' | pag. ' || (i * 10) || chr(10) || '   - Frase soportada: ' || substr(text, 1, 200)), chr(10)) ELSE '' END AS chat FROM c)
      SELECT conv_id, turn, length(chat)::INT AS n_chars, md5(chat) AS chat_md5 FROM t""",
    "askable_messages": f"SELECT conv_id, turn, length({strip('coalesce(text, chr(32))')}) >= 20 AS askable FROM conversations",
    "store_quick_query": f"WITH {DENSE}, b AS ({top('dd', 5)}) SELECT b.query_id, b.rank, b.chunk_id, lang AS family, length(coalesce(text, ''))::INT AS n_chars FROM b JOIN documents ON doc_id = b.chunk_id",
    "grounding_ratio": f"{GROUNDING}, {ratio(f'SELECT query_id FROM {_TURNS}')} SELECT * FROM ratio",
    "grounding_summary": f"{GROUNDING}, {ratio(f'SELECT query_id FROM {_TURNS}')} SELECT count(*) AS n_queries, sum(n_sentences)::BIGINT AS n_sentences, sum(n_supported)::BIGINT AS n_supported, count(*) FILTER (refusal <> '') AS n_refused FROM ratio",
    "citations": f"WITH {BM25_HITS}, a AS ({top('every', 5)}), {verify(split('benchmark', 'item_id', 'text'), 'SELECT query_id, rank, chunk_id, text FROM a JOIN documents ON doc_id = chunk_id')} SELECT query_id, sent_pos, best_chunk_id::VARCHAR AS chunk_id, best_score, source AS indicator_code, n_chars::INT AS page_end FROM verdict LEFT JOIN documents ON doc_id = best_chunk_id WHERE supported",
    "analyze_batch": f"{HYBRID}, {RERANK}, an AS ({template('r5', 'new_rank')}), {verify(split('an', 'query_id', 'answer'), 'SELECT query_id, new_rank AS rank, chunk_id, text FROM r5 JOIN documents ON doc_id = chunk_id')}, {ratio('SELECT item_id AS query_id FROM benchmark')} SELECT ratio.*, md5(answer) AS answer_md5 FROM ratio JOIN an USING (query_id)",
    "compare_methods": f"WITH {legs(10)}, {RRF}, {GOLD}, mm AS ({_METHODS}) {_BY_K}",
    "recall_precision": f"{PER_QUERY} SELECT * FROM pqr",
    "best_worst": f"{PER_QUERY} SELECT * FROM (SELECT 'best' AS kind, query_id, recall AS score FROM pqr ORDER BY recall DESC, query_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'worst' AS kind, query_id, recall AS score FROM pqr ORDER BY recall, query_id LIMIT 1)",
    "gold_validity": f"WITH {GOLD} SELECT query_id, code FROM (SELECT query_id, unnest(relevant) AS code FROM gold) WHERE code NOT IN (SELECT doc_id FROM labels)",
    "ref_graph_edges": f"WITH {HOSTS} SELECT src, dst FROM edges",
    "ref_graph_orphans": f"WITH {HOSTS} SELECT path FROM hosts WHERE path NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "ref_page_edges": f"WITH {LINKED} SELECT src, dst FROM edges",
    "ref_page_orphans": f"WITH {LINKED} SELECT path FROM f WHERE path NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "file_kinds": f"SELECT CASE {_KIND_CASES} ELSE 'root' END AS kind, count(*) AS n FROM (SELECT {_PREFIXES}[page_id % {len(graph.KIND_BY_PREFIX)} + 1] || url AS path FROM pages) GROUP BY 1",
    "ready_tasks": "SELECT n.n_name AS id, n.n_nationkey AS pos, r.r_name AS owner_cli FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN nation p ON p.n_nationkey = n.n_nationkey - 1 WHERE n.n_nationkey % 3 <> 0 AND (p.n_nationkey IS NULL OR p.n_nationkey % 3 = 0)",
}
