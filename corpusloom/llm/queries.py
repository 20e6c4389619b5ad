"""The registered queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import collocations, compression_quality, exact_dedup, filter_audit, itq, langid, mixing, ngram_join, packing, token_counts, token_file, toxicity, warc
from corpusloom.llm.common import crc_fold, new_folder
from corpusloom.llm.samples import with_some_labels

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "tokens")
    token_file.write_tokens(_read(spark, sf_dir, "documents"), out, f"{TOKENIZERS}/byte_bpe_50k.json", end_id=2)
    return token_file.read_tokens(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_embeddings(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1, capacity=2048).drop("ids")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    labelled = with_some_labels(docs, _read(spark, sf_dir, "labels").where(~held_out), "quality", 2500)
    model = compression_quality.fit_quality(labelled)
    return compression_quality.score_quality(docs, model, held_out.alias("held_out")).select("doc_id", "held_out", "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    labelled = with_some_labels(docs, _read(spark, sf_dir, "labels").where(~held_out), "toxic", 4000)
    model = toxicity.fit_toxicity(labelled)
    return toxicity.score_toxicity(docs, model, held_out.alias("held_out")).select("doc_id", "held_out", "score", "predicted", "grade", "expected_severity")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_read(spark, sf_dir, "documents"), threshold=0.8, k=5).select("doc_id", "class_id", "n_links", "kept")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 0
    model = langid.fit_languages(docs.select("doc_id", "text", "lang").where(~held_out))
    return langid.predict_language(docs, model, held_out.alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, exact_dedup.earlier_half(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), top=2000, least=30)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", limit=2048)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_file, op3_itq, op4_mixing, op5_packing, op6_quality, op7_toxicity, op8_ngram_join, op9_langid, op10_exact_dedup, op11_collocations, op12_token_counts, op13_filter_audit)}

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, body,
        list_transform(range(0, 40, 1), lambda i: strpos('0123456789abcdef', substr(sha1(body), i + 1, 1)) - 1) AS nibbles FROM p),
b AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY body) AS winner,
        list_transform(range(0, 32, 1), lambda i: list_sum(list_transform(range(0, 5, 1), lambda j:
            ((nibbles[(5 * i + j) // 4 + 1] >> (3 - (5 * i + j) % 4)) & 1) << (4 - j)))) AS fives FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM b""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS ratio, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS nth,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lam
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(CASE WHEN ratio <= l THEN 3.0 * source_size ELSE l * w END, 6) AS target
  FROM r, (SELECT coalesce(arg_min(lam, nth) FILTER (ratio > lam), max(ratio)) AS l FROM r)),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS routed,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST((routed // CAST(source_size AS BIGINT)) * size
    + greatest(0, least(size, routed % CAST(source_size AS BIGINT) - before)) AS BIGINT) END AS taken
FROM c""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i : i + len - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS len)),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY lang, len, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 30),
k AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT lang, len AS size, phrase, a, w, unnest(range(1, len)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : size], ' ')),
s AS (SELECT lang, phrase, a, arg_min(l, score * 4 + k) AS l, arg_min(r, score * 4 + k) AS r, min(score) AS score FROM k GROUP BY lang, phrase, a),
x AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, unnest(range(2, len)) AS m FROM c WHERE len > 2)) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN x USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a
QUALIFY rank <= 2000""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT w.doc_id, part, 0
    + CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least < w.doc_id THEN 16 ELSE 0 END AS bits, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS before,
    1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN bits & (coalesce(CAST(before AS INTEGER), 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & coalesce(CAST(before AS INTEGER), 0) = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & coalesce(CAST(before AS INTEGER), 0) <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & coalesce(CAST(before AS INTEGER), 0) = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & coalesce(CAST(before AS INTEGER), 0) = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r""",
}
