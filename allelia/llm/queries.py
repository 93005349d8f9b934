"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from allelia.llm import centroids, decontaminate, divergence, exact_dedup, html_extract, jaccard_join, langid, license_scan, packing, pii, quality, quality_rules, sentencepiece
from allelia.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket", "row_mark", "first")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("policy")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


EXACT_DEDUP_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size, sha256(norm) AS text_sha256 FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN c u ON u.doc_id = x JOIN c v ON v.doc_id = y WHERE 100 * n_both >= 85 * (u.n + v.n - n_both)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN c USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, c.n
"""


DIVERGENCE_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT x.lang, count(v.term) AS v, coalesce(sum(v.total), 0) AS n FROM (SELECT DISTINCT lang FROM d) x LEFT JOIN v ON v.lang = x.lang GROUP BY x.lang),
s AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(sum(o.n), 0) AS n FROM s LEFT JOIN o ON o.lang = s.lang AND o.source = s.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000 * (v.total + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = v.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _clustering_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Each round's assignment and centroids as common table expressions; v and c are lists of integers."""
    nearest = """a{r} AS (
  SELECT id, v, arg_min(c, (distance, c)) AS cluster, min(distance) AS distance
  FROM (SELECT id, v, c, list_sum(list_transform(range(1, {dim} + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS distance FROM x, c{r}) GROUP BY id, v
)"""
    moved = """m{r} AS (
  SELECT cluster, list(s ORDER BY i) AS w FROM (
    SELECT cluster, i, CAST(floor_of(sum(v[i]), count(*)) AS BIGINT) AS s FROM a{r}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY cluster, i) GROUP BY cluster
), c{n} AS (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c)"""
    parts = [
        f"""x AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {k})
)"""
    ]
    for r in range(rounds):
        parts += [nearest.format(r=r, dim=dim), moved.format(r=r, n=r + 1, dim=dim)]
    parts.append(nearest.format(r=rounds, dim=dim))
    sql = f"""WITH {", ".join(parts)}
SELECT x.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x ON x.id = a.id JOIN c{rounds} c ON c.c = a.cluster"""
    return sql.replace("floor_of(sum(v[i]), count(*))", "(sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*)")


QUALITY_RULES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8
), v AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i + 7]) AS times FROM w),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM v, (SELECT unnest(range(0, 8)) AS j) WHERE times > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(octet_length(encode(text)) - length(text) AS BIGINT) AS n_wide,
         CAST(length(text) - length(regexp_replace(text, '[\\p{L}\\p{M}]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS BIGINT) AS n_bullets,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipses
  FROM d LEFT JOIN again USING (r)
), b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT *, failed & {base} <> 0 AS base_failed, failed & {all} = 0 AS kept FROM b
"""


def _quality_rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(quality_rules.RULES))
    policy = quality_rules.POLICIES[quality_rules.LATEST]
    return QUALITY_RULES_SQL.replace("{bits}", bits).replace("{base}", str(quality_rules.BASE)).replace("{all}", str(policy | quality_rules.BASE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_html_extraction, op2_license_scan, op3_decontamination, op4_exact_dedup, op5_pii_surrogates, op6_sentencepiece, op7_quality, op8_packing, op9_language, op10_jaccard_join, op11_source_divergence, op12_centroid_clustering, op13_quality_rules, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_DEDUP_SQL, "op10_jaccard_join": JACCARD_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_centroid_clustering": _clustering_sql(), "op13_quality_rules": _quality_rules_sql()}
