"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.byte_bpe import encode_decode
from evidara.llm.common import spread, table
from evidara.llm.hard_negatives import mine
from evidara.llm.html_extract import extract_main_text
from evidara.llm.license_scan import PART_OF, SENTENCES, known_sentences, scan_licenses
from evidara.llm.license_scan import RULES as LICENSE_RULES
from evidara.llm.merkle import fold, leaf_of, manifest, proof_digest
from evidara.llm.mixing import mix
from evidara.llm.multiset_hash import fingerprint_with_next
from evidara.llm.quality_classifier import quality_scores
from evidara.llm.quality_rules import ALPHA, DELTA, GRID, MIN_WORDS, SCALES, quality_verdicts
from evidara.llm.sharding import balanced_shards
from evidara.llm.simhash import simhash_components
from evidara.llm.token_counts import count_tokens
from evidara.llm.url_filters import RULES as URL_RULES
from evidara.llm.url_filters import filter_urls


def vocabulary(name: str) -> bytes:
    """Bytes of a public tokenizer's file; tasks get the bytes, not the path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, stratum, cutoff and kept of every document."""
    out = quality_verdicts(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum", "cutoff", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    return mix(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses of every document."""
    return scan_licenses(spread(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under byte_bpe_50k.json."""
    return count_tokens(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash_components(spread(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return balanced_shards(table(spark, sf_dir, "documents"))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next of every document."""
    return fingerprint_with_next(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document under the rank file."""
    return encode_decode(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_multi_50k.tiktoken"), bpe_pattern(), keep=["doc_id"])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_main_text(spread(table(spark, sf_dir, "pages")), keep=["page_id", "url"])


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; every seventh copy is tampered with."""
    marked = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    changed = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in LEAF]
    found = manifest(spread(table(spark, sf_dir, "documents")), LEAF, keep={"tampered": F.when(marked, leaf_of(changed))})
    folded = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; a seventh of the labels are shifted first."""
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spread(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, label=shifted)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_mixing, op3_url_filters, op4_license_scan, op5_token_counts, op6_simhash, op7_sharding, op8_multiset_hash, op9_byte_bpe, op10_html_extraction]
    found += [op11_merkle_manifest, op12_hard_negatives, op13_quality_classifier]
    return {f.__name__: f for f in found}


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs
  FROM w LEFT JOIN cov USING (rid)),
s AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    greatest(CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END / {SCALES["symbol_rate"]}::DOUBLE,
      CASE WHEN word_chars > 0 THEN n_capitals::DOUBLE / word_chars ELSE 0 END / {SCALES["capital_rate"]}::DOUBLE,
      CASE WHEN n_words > 0 THEN n_bangs::DOUBLE / n_words ELSE 0 END / {SCALES["bang_rate"]}::DOUBLE,
      CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END / {SCALES["dup_line_rate"]}::DOUBLE,
      CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END / {SCALES["repeat_rate"]}::DOUBLE) AS score
  FROM m),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT s.stratum, s.score, g.good FROM s LEFT JOIN g USING (doc_id) WHERE NOT base_failed),
c AS (SELECT unnest({[float(x) for x in sorted(GRID, reverse=True)]}::DOUBLE[]) AS cutoff),
k AS (
  SELECT stratum, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND score > cutoff) AS lost, count(*) FILTER (good = 0 AND score > cutoff) AS caught
  FROM h, c GROUP BY ALL),
p AS (
  SELECT *, n > 0 AND lost < n * {ALPHA}::DOUBLE AND list_sum(list_transform(range(0, lost + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}::DOUBLE) + (n - j) * ln(1 - {ALPHA}::DOUBLE))))
    <= {DELTA}::DOUBLE / (SELECT count(DISTINCT coalesce('s' || stratum, '')) FROM h) AS passed
  FROM k),
f AS (SELECT * FROM p WHERE cutoff > coalesce((SELECT max(q.cutoff) FROM p q WHERE NOT q.passed AND q.stratum IS NOT DISTINCT FROM p.stratum), -1) AND caught > 0),
b AS (SELECT stratum, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, cutoff DESC) AS r FROM f) WHERE r = 1)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, s.stratum, b.cutoff,
  NOT base_failed AND (b.cutoff IS NULL OR score <= b.cutoff) AS kept
FROM s LEFT JOIN b ON b.stratum IS NOT DISTINCT FROM s.stratum
"""


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_cases(host: str, path: str, rules, value) -> str:
    """CASE over URL rules, longest first."""
    longest = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = {_sql(h)} OR {host} LIKE {_sql('%.' + h)}) AND starts_with({path}, {_sql(p)}) THEN {_sql(value(v, h, p))}" for v, h, p in longest) + " END"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
_PART = lambda url, i: f"regexp_extract({url}, '{_URL}', {i})"
_NODE = lambda url: f"translate({_PART(url, 1)}, '{_UP}', '{_LOW}') || '://' || translate({_PART(url, 2)}, '{_UP}', '{_LOW}') || {_PART(url, 3)} || {_PART(url, 4)}"

#: Canonical links and refreshes to absolute addresses; relative ones are left to the small tests.
OP3_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(translate({_PART("url", 2)}, '{_UP}', '{_LOW}'), '') AS host, coalesce({_PART("url", 3)}, '') AS path,
    CASE WHEN contains(url, '://') THEN {_NODE("url")} END AS node, html
  FROM pages),
tags AS (SELECT node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE node IS NOT NULL),
e AS (
  SELECT node AS src, CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)url\s*=\s*([^"''>]+)', 1) END AS dst
  FROM tags),
g AS (SELECT src, {_NODE("dst")} AS dst FROM e WHERE contains(dst, '://')),
u AS (SELECT src AS a, dst AS b FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst),
reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
bad AS (SELECT DISTINCT a AS node FROM reach WHERE {_rule_cases(_PART("b", 2), _PART("b", 3), URL_RULES, lambda v, h, p: v)} = 'block'),
j AS (SELECT p.*, {_rule_cases("p.host", "path", URL_RULES, lambda v, h, p: h + p)} AS rule, {_rule_cases("p.host", "path", URL_RULES, lambda v, h, p: v)} AS own, bad.node IS NOT NULL AS aliased FROM p LEFT JOIN bad ON p.node = bad.node)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN aliased THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


def _op4_sql() -> str:
    """Identifiers as ' id ' one after the other, 0 for unknown sentences, so that neighbours can be told."""
    known, cut = known_sentences(SENTENCES)
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    row = lambda ids: "".join(f" {i} " for i in ids)
    line = "line"
    for number, ids in cut.items():
        line = f"replace({line}, {_sql(row(ids))}, {_sql(row([number, *(i for i in ids[1:] if i > 0)]))})"
    seqs = {n: [row(seq) for m, seq in LICENSE_RULES if m == n] for n in sorted({n for n, _ in LICENSE_RULES})}

    def hit(name: str) -> str:
        wholes = sorted((x for p, w in PART_OF if p == name for x in seqs[w]), key=lambda x: (-len(x), x))
        rest = f"regexp_replace(line, {_sql('|'.join(wholes))}, '|', 'g')" if wholes else "line"
        return " OR ".join(f"contains({rest}, {_sql(x)})" for x in seqs[name])

    found = ", ".join(f"CASE WHEN {hit(n)} THEN {_sql(n)} END" for n in seqs)
    return rf"""
WITH known(sentence, id) AS (VALUES {", ".join(f"({_sql(s)}, {i})" for s, i in known.items())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
-- a sentence ends at punctuation before white space; chr(1) marks the cut, as RE2 has no lookahead
cut AS (SELECT rid, regexp_replace(regexp_replace(regexp_replace(t, '[.;:!?]+(\s)', chr(1) || '\1', 'g'), '[.;:!?]+$', chr(1)), '\n\s*\n', chr(1), 'g') AS t FROM d),
seg AS (SELECT rid, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM cut),
whole AS (SELECT rid, i, s, k.id FROM seg LEFT JOIN known k ON k.sentence = {normal("s")}),
part AS (SELECT rid, i, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM whole WHERE id IS NULL AND contains(s, chr(10))),
ids AS (
  SELECT rid, i, 0 AS j, coalesce(id, 0) AS id FROM whole WHERE id IS NOT NULL OR NOT contains(s, chr(10))
  UNION ALL SELECT rid, i, j, coalesce(k.id, 0) FROM part LEFT JOIN known k ON k.sentence = {normal("s")}),
raw AS (SELECT rid, string_agg(' ' || id || ' ', '' ORDER BY i, j) AS line FROM ids GROUP BY rid HAVING max(id) > 0 OR min(id) < 0),
line AS (SELECT rid, regexp_replace({line}, ' (0|-[0-9]+) ', '', 'g') AS line FROM raw)
SELECT doc_id, (CASE WHEN coalesce(line, '') = '' THEN 0 ELSE len(string_split(trim(line), '  ')) END)::BIGINT AS n_sentences,
  replace(trim(coalesce(line, '')), '  ', ',') AS sentence_ids,
  coalesce(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ','), '') AS licenses
FROM d LEFT JOIN line USING (rid)
"""


def _op7_sql() -> str:
    """Prefix sums as one window; the CRC goes over the bytes' hex digits, the low one of a byte first."""
    table = _crc32_table()
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), '') AS h FROM documents),
c AS (
  SELECT rid, doc_id, size, xor(list_reduce(list_transform(list_filter(h, lambda x: x <> ''), lambda x: instr('0123456789ABCDEF', x) - 1), lambda a, x: xor(a >> 4, ({table}::BIGINT[])[(xor(a, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM d),
s AS (
  SELECT *, (sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, rid) - size)::HUGEINT AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, rid) AS nth
  FROM c),
k AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INT AS grown_shard FROM k
"""


def _crc32_table() -> list[int]:
    """CRC-32 of the sixteen values of a half byte."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        table.append(x)
    return table


def _op11_sql() -> str:
    """Levels by recursion; every proof as a join of a row's places with the nodes beside them."""
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"
    leaf = lambda n_chars: "sha256(" + " || ".join(value(n_chars if c == "n_chars" else c) for c in LEAF) + ")"
    digits = "list_filter(string_split(regexp_replace(hex(encode(doc_id::VARCHAR)), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: x <> '')"
    step = f"lambda a, x: xor(a >> 4, ({_crc32_table()}::BIGINT[])[(xor(a, x) & 15) + 1])"
    crc = f"xor(list_reduce(list_transform({digits}, lambda x: instr('0123456789ABCDEF', x) - 1), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
    up = "SELECT g, lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 1) // 2"
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, '') AS g, {leaf("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("(n_chars::HUGEINT + 1)")} END AS tampered
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lvl, place AS idx, leaf AS digest, n FROM p UNION ALL {up} FROM t WHERE n > 1 GROUP BY g, lvl, idx // 2),
sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
s AS (SELECT '' AS g, 0 AS lvl, place AS idx, subroot AS digest, n FROM sub UNION ALL {up} FROM s WHERE n > 1 GROUP BY g, lvl, idx // 2),
every AS (
  SELECT p.rid, 0 AS tree, l.lvl, (p.place >> l.lvl) & 1 AS side, b.digest FROM p JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1) l USING (g) LEFT JOIN t b ON b.g = p.g AND b.lvl = l.lvl AND b.idx = xor(p.place >> l.lvl, 1)
  UNION ALL
  SELECT p.rid, 1, l.lvl, (sub.place >> l.lvl) & 1, b.digest FROM p JOIN sub USING (g) CROSS JOIN (SELECT DISTINCT lvl FROM s WHERE n > 1) l LEFT JOIN s b ON b.lvl = l.lvl AND b.idx = xor(sub.place >> l.lvl, 1)),
proof AS (SELECT rid, list({{'side': side, 'digest': coalesce(digest, '')}} ORDER BY tree, lvl) AS levels FROM every GROUP BY rid),
whole AS (
  SELECT p.rid, p.doc_id, p.leaf, sub.subroot, (SELECT digest FROM s WHERE n = 1) AS root, coalesce(levels, []) AS levels, coalesce(tampered, leaf) AS start
  FROM p JOIN sub USING (g) LEFT JOIN proof USING (rid)),
f AS (
  SELECT rid, 0 AS i, start AS node FROM whole
  UNION ALL
  SELECT rid, i + 1, sha256(CASE WHEN levels[i + 1].side = 1 THEN levels[i + 1].digest || node ELSE node || levels[i + 1].digest END) FROM f JOIN whole USING (rid) WHERE i < len(levels)),
folded AS (SELECT rid, node AS folded_root FROM f JOIN whole USING (rid) WHERE i = len(levels))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(levels, lambda x: x.digest), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM whole JOIN folded USING (rid)
"""


#: Scores are sums of whole numbers, exact as doubles; equal rows stay rows of their own.
OP12_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS nth FROM pairs WHERE same),
neg AS (
  SELECT p.a, p.nth, p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.nth ORDER BY n.score DESC, n.id NULLS LAST) AS rank
  FROM pos p JOIN pairs n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_url_filters": OP3_SQL, "op4_license_scan": _op4_sql(), "op7_sharding": _op7_sql(), "op11_merkle_manifest": _op11_sql(), "op12_hard_negatives": OP12_SQL}
