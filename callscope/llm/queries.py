"""Registered queries of the operators in this folder, each over its whole table, and the SQL that some must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, cotrain, language, lines, mixing, pii, ranked, secrets, simhash, spelling, toxicity, vectors, warc

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    files = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.archived_pages(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near-duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views, learnt from labels."""
    docs = table(spark, sf_dir, "documents")
    return cotrain.score_quality(docs, cotrain.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    profiles = language.learn_profiles(docs.where(remainder != 0))
    found = language.identify(docs, profiles)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.secrets(docs, secrets.train_models(docs))
    base = F.filter("spans", lambda x: x.kind != "random")
    return found.select(
        F.col("id").alias("doc_id"), *map(_count, ("assign", "access", "hex")), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every document."""
    found = lines.judge(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_words").cast("long").alias("n_removed_words")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x.base)
    return found.select(
        F.col("id").alias("doc_id"), *map(_count, ("email", "ip", "card", "phone")), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit_toxicity(docs, labels.where(~held))
    found = toxicity.score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the near words of each, and the form and root it stands for."""
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    index = ranked.build_index(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_simhash, op3_quality, op4_mixing, op5_language, op6_bpe, op7_vectors, op8_secrets, op9_lines, op10_pii, op11_toxicity, op12_spelling, op13_ranked, pipeline)
    return {f.__name__: f for f in own}


OP1 = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), first AS (SELECT payload_digest, min(page_id) AS first_id FROM own WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM own LEFT JOIN first USING (payload_digest)
"""

OP4 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), light AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS number FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS size, count(*) AS documents, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM light GROUP BY source
), total AS (SELECT sum(size)::DOUBLE AS n FROM sources
), levels AS (  -- each round clamps what was above at the level before
  SELECT 0 AS round, total.n AS num, (SELECT sum(weight) FROM sources)::DOUBLE AS den FROM total
  UNION ALL
  SELECT round + 1, num, den FROM (
    SELECT l.round, total.n - s.capped AS num, s.free AS den, l.den AS was
    FROM levels l, total, LATERAL (
      SELECT sum(CASE WHEN weight * l.num / l.den > size * 3.0::DOUBLE THEN size * 3.0::DOUBLE ELSE 0 END) AS capped,
        sum(CASE WHEN weight * l.num / l.den > size * 3.0::DOUBLE THEN 0 ELSE weight END)::DOUBLE AS free FROM sources) s)
  WHERE den <> was AND den > 0
), level AS (SELECT num, den FROM levels ORDER BY round DESC LIMIT 1
), targets AS (
  SELECT source, size AS source_size, least(size * 3.0::DOUBLE, weight * num / den) AS target, ceil(sqrt(documents)) AS buckets FROM sources, level
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), dealt AS (
  SELECT l.doc_id, l.size, s.*, round(target - whole * source_size)::BIGINT AS rest, md5('42:' || coalesce(l.doc_id::VARCHAR, 'null') || CASE WHEN number > 1 THEN ':' || number ELSE '' END) AS key FROM light l JOIN split s ON l.source IS NOT DISTINCT FROM s.source
), bucketed AS (SELECT *, floor(('0x' || key[1:12])::BIGINT::DOUBLE / 281474976710656.0::DOUBLE * buckets)::BIGINT AS bucket FROM dealt
), buckets AS (
  SELECT source, bucket, sum(size)::BIGINT AS bucket_size, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_before
  FROM bucketed GROUP BY source, bucket
), placed AS (
  SELECT b.*, k.bucket_size, b.rest - k.left_before AS room, sum(size) OVER (PARTITION BY b.source, b.bucket ORDER BY size DESC, key) AS from_large, sum(size) OVER (PARTITION BY b.source, b.bucket ORDER BY size, key) AS from_small
  FROM bucketed b JOIN buckets k ON b.source IS NOT DISTINCT FROM k.source AND b.bucket = k.bucket
), filled AS (SELECT *, coalesce(max(CASE WHEN from_large <= room THEN from_large END) OVER (PARTITION BY source, bucket), 0) AS large FROM placed)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (room >= bucket_size OR (room > 0 AND (from_large <= room OR from_small <= room - large))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM filled
"""

OP9 = r"""
WITH own AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM own)
), repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1
), covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY row
), single AS (
  SELECT row, source, text, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT row, source, text, unnest(lines) AS line FROM own)
), hosts AS (SELECT source, count(DISTINCT text) AS n FROM own GROUP BY source
), common AS (
  SELECT c.source, c.key FROM (SELECT source, key, count(DISTINCT text) AS n FROM single GROUP BY source, key) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > 20 AND c.n > 0.01 * h.n
), removed AS (SELECT row, sum(words) AS n FROM single s JOIN common c ON s.key = c.key AND s.source IS NOT DISTINCT FROM c.source GROUP BY row
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS n_removed_words
  FROM own LEFT JOIN covered c USING (row) LEFT JOIN removed r USING (row)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND n_removed_words <= 0.6 * n_words AS kept FROM failed
"""

OP12 = r"""
WITH RECURSIVE shifted AS (  -- the table of CRC-32: each byte, eight times shifted
  SELECT unnest(range(256))::BIGINT AS byte, unnest(range(256))::BIGINT AS c, 0 AS k
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM shifted WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS crc_table FROM shifted WHERE k = 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1])), 4294967295::BIGINT) AS h FROM coded, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), dropped AS (SELECT word, n, spot, left(word, spot - 1) || substr(word, spot + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS spot FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM dropped a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM dropped a JOIN words w ON a.rest = w.word
), best AS (SELECT word, n, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near
), formed AS (SELECT word, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM best WHERE place = 1
), led AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT l.word, f.form, l.step + 1 FROM led l JOIN formed f ON l.root = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, max_by(root, step) AS root FROM led GROUP BY word)
SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, form, form_n, coalesce(root, word) AS root FROM words LEFT JOIN formed USING (word) LEFT JOIN roots USING (word)
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), lengths AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
), weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, n_docs
), items AS (
  SELECT DISTINCT item, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark)
), scored AS (
  SELECT i.item, i.item_id, p.row, l.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items i JOIN postings p USING (term) JOIN weights USING (term) JOIN lengths l ON l.row = p.row, total GROUP BY i.item, i.item_id, p.row, l.doc_id
), placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op4_mixing": OP4, "op9_lines": OP9, "op12_spelling": OP12, "op13_ranked": OP13}
