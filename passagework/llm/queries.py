"""The driver's queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, hard_negatives, html_text, merkle, mixing, packing, pii, quality, sharding, simhash, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_read(spark, sf_dir, "pages"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op6_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op7_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_read(spark, sf_dir, "documents"))


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op10_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op11_radix_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(_read(spark, sf_dir, "embeddings"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(_read(spark, sf_dir, "documents"))


def op13_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: The checksum's table from its polynomial, then one step a byte.
CRC_SQL = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""
OP1_SQL = f"""
WITH {CRC_SQL},
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
         list_transform(range(17), lambda i:
           1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496::DOUBLE)) AS scores
  FROM documents),
placed AS (
  SELECT *, list_position(scores[1:16], list_max(scores[1:16])) - 1 AS shard, list_position(scores, list_max(scores)) - 1 AS grown_shard FROM docs)
SELECT doc_id, size::BIGINT AS size,
       xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32,
       'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed, crc
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: The patterns in their plain forms; pairs of gap and match as in the operator.
OP5_SQL = rf"""
WITH kinds AS (SELECT * FROM (VALUES
    (0, 'email', 1.0, '', ''), (1, 'ip', 1.0, '', ''), (2, 'card', 1.0, '', ''), (3, 'phone', 1.0, '', ''),
    (4, 'iban', 0.8, 'iban|account|bank|transfer', '{pii.KINDS[4].against}'), (5, 'secret', 0.4, 'token|key|secret|password', '{pii.KINDS[5].against}')) k(no, kind, base, context, against)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {" UNION ALL ".join(f"""SELECT r, {no} AS no, regexp_extract_all(text, '(?s)(.*?)(?:({pattern})|{chr(92)}z)', 1) AS gaps,
    regexp_extract_all(text, '(?s)(.*?)(?:({pattern})|{chr(92)}z)', 2) AS matches FROM docs""" for no, pattern in enumerate((
      r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", r"[0-9](?:[ -]?[0-9])+", r"[+][0-9][ ().0-9-]+[0-9]",
      rf"\b{pii.IBAN}\b", r"\b[0-9A-Fa-f]{32,}\b")))}),
pairs AS (SELECT r, no, unnest(gaps) AS gap, unnest(matches) AS m, generate_subscripts(gaps, 1) AS i FROM found),
placed AS (
  SELECT r, no, m, right(gap, 40) AS tail, lead(left(gap, 40)) OVER w AS head,
         (sum(length(gap) + length(m)) OVER w)::BIGINT AS stop FROM pairs WINDOW w AS (PARTITION BY r, no ORDER BY i)),
spans AS (
  SELECT r, no, kind, stop - length(m) AS start, stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits, m,
         lower(concat_ws(' ', tail, head)) AS near, k.* EXCLUDE (no, kind) FROM placed JOIN kinds k USING (no) WHERE m <> ''),
valid AS (
  SELECT r, no, start, stop, kind || ':' || start || ':' || stop AS shown FROM spans WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(right(p, 3) AS INT), 0) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''),
      lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    ELSE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]') END
  AND (no < 4 OR base + CASE WHEN regexp_matches(near, context) THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(near, against) THEN 0.25 ELSE 0 END >= 0.6)),
by_doc AS (
  SELECT r, count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card, count(*) FILTER (no = 3) AS n_phone,
         string_agg(shown, ',' ORDER BY no, start) FILTER (no < 4) AS base, string_agg(shown, ',' ORDER BY no, start) AS spans FROM valid GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN by_doc USING (r)
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no, 2 * source_size AS full_size FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) * 1.5::DOUBLE FROM sizes)
             - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_size / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
chosen AS (SELECT max(level) AS level FROM levels WHERE level * weight <= full_size),
targets AS (SELECT source, source_no, source_size, least(full_size::DOUBLE, c.level * weight) AS target FROM levels, chosen c),
queued AS (
  SELECT d.*, row_number() OVER () AS r, t.source_no, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT r, source_no, start + pass * source_size + k AS start, least(256, size - k) AS words, (start + pass * source_size + k + least(256, size - k)) / target AS finish
  FROM (SELECT *, unnest(range(0, size, 256)) AS k FROM (SELECT *, unnest([0, 1]) AS pass FROM queued))),
served AS (
  SELECT r, greatest(0, least(words, (SELECT sum(floor(target)) FROM targets) - (sum(words) OVER (ORDER BY finish, source_no, start ROWS UNBOUNDED PRECEDING) - words))) AS taken FROM packets)
SELECT doc_id, size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN (SELECT r, sum(taken) AS taken FROM served GROUP BY r) t USING (r)
"""

OP11_SQL = """
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), embedding IS NOT NULL)),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vecs a JOIN vecs r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

#: Levels that the SQL goes up: 8 ** 6 documents of a language, 8 ** 2 languages.
LEVELS, TOP_LEVELS = 6, 2


def _level_sql(name: str, k: int) -> str:
    """Level k + 1 of the trees in `name`; a tree of one node stays."""
    return f"""{name}{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN idx // 8 ELSE idx END AS idx, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE max(h) END AS h FROM {name}{k} GROUP BY tree, CASE WHEN n > 1 THEN idx // 8 ELSE idx END, n)"""


def _fold_sql(name: str, nodes: str, k: int) -> str:
    """One step up: the digest with its siblings' on level k, and the proof so far."""
    own = f"f.pos // {8**k}"
    return f"""{name}{k + 1} AS (
  SELECT r, f.tree, pos, CASE WHEN count(o.idx) = 0 THEN cur ELSE sha256(coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < {own}), '') || cur
           || coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > {own}), '')) END AS cur,
         proof || coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx <> {own}), '') AS proof
  FROM {name}{k} f LEFT JOIN {nodes}{k} o ON o.tree = f.tree AND o.n > 1 AND o.idx // 8 = f.pos // {8 ** (k + 1)} GROUP BY r, f.tree, pos, cur, proof)"""


def _encoded_sql(text: str) -> str:
    """A row's encoded fields, with this text."""
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields)


OP12_SQL = f"""
WITH {CRC_SQL},
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, sha256({_encoded_sql("text")}) AS leaf,
         sha256({_encoded_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered,
         list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS digits
  FROM documents),
leaves AS (
  SELECT r, doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
         CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, digits), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 3 = 0 THEN lowered ELSE leaf END AS now
  FROM docs, crc),
l0 AS (SELECT tree, pos AS idx, n, leaf AS h FROM leaves), {", ".join(_level_sql("l", k) for k in range(LEVELS))},
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{LEVELS}),
t0 AS (SELECT '' AS tree, pos AS idx, n, h FROM subroots), {", ".join(_level_sql("t", k) for k in range(TOP_LEVELS))},
f0 AS (SELECT r, tree, pos, now AS cur, '' AS proof FROM leaves), {", ".join(_fold_sql("f", "l", k) for k in range(LEVELS))},
g0 AS (SELECT r, '' AS tree, s.pos, cur, proof FROM f{LEVELS} f JOIN subroots s USING (tree)), {", ".join(_fold_sql("g", "t", k) for k in range(TOP_LEVELS))}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = t.h AS verified
FROM leaves JOIN g{TOP_LEVELS} g USING (r) JOIN subroots s ON s.tree = leaves.tree, t{TOP_LEVELS} t
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding, op2_simhash_pivots, op3_compression_quality, op4_html_crf, op5_pii_spans, op6_consistent_sampling, op7_fair_queue_mixing,
        op8_vector_best_fit, op9_path_templates, op10_lsm_exact_dedup, op11_radix_hard_negatives, op12_merkle_proofs,
        op13_levenshtein_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_rendezvous_sharding": OP1_SQL, "op5_pii_spans": OP5_SQL, "op7_fair_queue_mixing": OP7_SQL, "op10_lsm_exact_dedup": OP10_SQL, "op11_radix_hard_negatives": OP11_SQL, "op12_merkle_proofs": OP12_SQL}
