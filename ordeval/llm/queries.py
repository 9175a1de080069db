"""The registered query of each operator, over its whole table with production parameters, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.llm import (
    chat, language, licenses, media, mixing, neardup, packing, pii, quality, structure, substrings, toxicity, vectorcodes,
)
from ordeval.llm.common import documents, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.systematic_mix(documents(spark, sf_dir))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media_digest(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=3, threshold=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat.with_control_case(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(conversations))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.personal_data(documents(spark, sf_dir)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_digest(structure.repair(structure.damaged(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_mixing, op2_packing, op3_media, op4_near_duplicates, op5_quality, op6_language, op7_chat, op8_pii,
        op9_licenses, op10_toxicity, op11_substrings, op12_vector_codes, op13_structure,
    )
    return {f.__name__: f for f in own}


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 8))::UBIGINT AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size,
         [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight
  FROM sources
), leveled AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM leveled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source
                            ORDER BY d.size DESC, d.key, d.doc_id) AS place
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, least(floor(rate * place + u) - floor(rate * (place - 1) + u), ceil(rate))::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""


def _op9_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))
    step = licenses.STEP
    words = "list_filter(string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return f"""
WITH templates AS (
  SELECT license_id, {words.format("statement")} AS w FROM (VALUES {values}) v(license_id, statement)
), known AS (
  SELECT license_id, ceil(len(w) / {step}.0)::BIGINT * {step} AS class,
         list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS shingles
  FROM templates
), siblings AS (
  SELECT a.license_id, list_filter(a.shingles, lambda x: NOT list_contains(b.shingles, x)) AS telling
  FROM known a JOIN known b ON a.license_id <> b.license_id AND 2 * len(list_intersect(a.shingles, b.shingles)) >= len(a.shingles)
), wanted AS (
  SELECT license_id, class, len(shingles) AS n, unnest(shingles) AS shingle FROM known
), texts AS (
  SELECT doc_id, md5(text) AS h, {words.format("text")} AS w FROM documents
), positions AS (
  SELECT doc_id, h, unnest(list_zip(w, w[2:], w[3:])) AS x, unnest(range(0, len(w))) AS p FROM texts WHERE len(w) >= 3
), hits AS (
  SELECT doc_id, h, license_id, class, n, shingle, p
  FROM (SELECT doc_id, h, p, x[1] || ' ' || x[2] || ' ' || x[3] AS shingle FROM positions) JOIN wanted USING (shingle)
), placed AS (
  SELECT doc_id, h, license_id, class, n, shingle, p // class - back AS win, p
  FROM hits, (VALUES (0), (1)) b(back)
), matched AS (
  SELECT doc_id, h, license_id, class, win, count(DISTINCT shingle) / any_value(n)::DOUBLE AS containment, list(DISTINCT shingle) AS own
  FROM placed WHERE win >= 0 AND p < win * class + 2 * class - 2
  GROUP BY doc_id, h, license_id, class, win
)
SELECT doc_id, license_id, count(DISTINCT win) AS n_windows, max(containment) AS containment, min(win * class) AS first_word
FROM matched m WHERE containment >= {licenses.THRESHOLD} AND NOT EXISTS (
  SELECT 1 FROM siblings s WHERE s.license_id = m.license_id AND len(s.telling) > 0 AND len(list_intersect(s.telling, m.own)) = 0
) GROUP BY doc_id, h, license_id
"""


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, any_value(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, count(*) AS copies
  FROM documents GROUP BY doc_id, md5(coalesce(text, ''))
), starts AS (
  SELECT doc_id, h, w, unnest(range(0, greatest(0, len(w) - 49))) AS p FROM texts
), windows AS (
  SELECT doc_id, h, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS win FROM starts
), found AS (
  SELECT doc_id, h, p, min(doc_id) OVER (PARTITION BY win) AS least FROM windows
), gone AS (
  SELECT DISTINCT doc_id, h, unnest(range(p, p + 50)) AS i FROM found WHERE least < doc_id
), words AS (
  SELECT doc_id, h, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts
), kept AS (
  SELECT s.doc_id, s.h, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY s.i) FILTER (WHERE g.i IS NULL) AS left_over
  FROM words s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.h = g.h AND s.i = g.i GROUP BY s.doc_id, s.h
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id IS NOT DISTINCT FROM k.doc_id AND t.h = k.h, range(copies) r(i)
"""


def _op12_sql() -> str:
    parts, entries, scale = vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.SCALE
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rounds = ""
    for k in range(vectorcodes.ROUNDS):
        rounds += f"""
), near{k} AS (
  SELECT r, p, x, min({far} * {entries} + e) % {entries} AS e FROM parts JOIN book{k} USING (p) GROUP BY r, p, x
), mean{k} AS (
  SELECT p, e, j, floor(sum(x[j])::HUGEINT / count(*))::BIGINT AS approx, sum(x[j])::HUGEINT AS total, count(*)::HUGEINT AS n
  FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j) GROUP BY p, e, j
), exact{k} AS (
  SELECT p, e, list((approx - (approx * n > total)::BIGINT + ((approx + 1) * n <= total)::BIGINT)::BIGINT ORDER BY j) AS c FROM mean{k} GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN exact{k} m USING (p, e)"""
    last = vectorcodes.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)
), book0 AS (
  SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries}{rounds}
), last_near AS (
  SELECT r, p, min({far} * {entries} + e) AS best FROM parts JOIN book{last} USING (p) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(lower(printf('%02x', (best % {entries})::INTEGER)), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM last_near GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other operators are held against brute force, round trips or held-out accuracy in tests/llm."""
    return {"op1_mixing": OP1_SQL, "op9_licenses": _op9_sql(), "op11_substrings": OP11_SQL, "op12_vector_codes": _op12_sql()}
