"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import annsearch, bpe, langid, packing, pii, quality, secrets, simhash, urlfilter, warc
from papyrine.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_annsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def url_sql() -> str:
    """The rules and the rounds of op8_urlfilter, each round a common table expression."""
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", kind, h + p) for kind, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))]
    rule, ruled = (f"CASE {' '.join(f'WHEN {f[0]} THEN {chr(39)}{f[i]}{chr(39)}' for f in fits)} END" for i in (2, 1))
    upper, lower, link = urlfilter.UPPER, urlfilter.LOWER, urlfilter.LINK.replace("'", "''")
    steps = []
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        steps.append(f"{name}_seed AS (SELECT host, 1.0::DOUBLE AS seed FROM ruled WHERE {seed} >= 0.5)")
        steps.append(f"{name}_share AS (SELECT {a} AS a, {b} AS b, weight / sum(weight) OVER (PARTITION BY {a}) AS share FROM edges)")
        steps.append(f"{name}_0 AS (SELECT * FROM {name}_seed)")
        for i in range(urlfilter.ROUNDS):
            sent = f"SELECT b AS host, {urlfilter.DAMPING} * x.seed * share AS seed FROM {name}_{i} x JOIN {name}_share ON x.host = a"
            restart = f"SELECT host, {1 - urlfilter.DAMPING} * seed AS seed FROM {name}_seed"
            steps.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT host, sum(seed) AS seed FROM ({sent} UNION ALL {restart}) GROUP BY host)")
    last = urlfilter.ROUNDS
    return f"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT page_id, html, host, path, {rule} AS rule, {ruled} AS ruled FROM parts
), ruled AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM judged GROUP BY host
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{upper}', '{lower}') AS dst FROM parts
), edges AS (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), {", ".join(steps)}
SELECT page_id, j.host, path, rule,
  CASE WHEN ruled IS NOT NULL THEN ruled WHEN j.host <> '' AND coalesce(d.seed, 0) >= {urlfilter.THRESHOLD} AND coalesce(d.seed, 0) > coalesce(t.seed, 0) THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN t_{last} t ON t.host = j.host LEFT JOIN d_{last} d ON d.host = j.host
"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secrets, op3_pii, op4_packing, op5_annsearch, op6_simhash, op7_warc, op8_urlfilter, op9_langid, op10_quality)}
ORACLES: dict[str, str] = {
    "op8_urlfilter": url_sql(),
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
""",
    "op10_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), windows AS (
  SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS x FROM w WHERE len(w) >= 8
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(8) AS r(j) GROUP BY doc_id
), failing AS (
  SELECT doc_id, list_filter(l, lambda x: (2 * (length(x) - length(regexp_replace(x, '[#*$%&|<>!]+', '', 'g'))) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 1)
    OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {quality.LONG_LINE} AND NOT regexp_matches(x, '{quality.SENTENCE_END.replace("'", "''")}'))
    OR regexp_matches(x, '{quality.NAVIGATION}') OR regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE).replace("'", "''")}')) AS f FROM w
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(f)::BIGINT AS n_failed_lines, length(regexp_replace(array_to_string(f, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS lost_chars
  FROM w LEFT JOIN covered c USING (doc_id) JOIN failing USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.6 * word_chars AS kept, n_failed_lines, lost_chars FROM m
""",
}
