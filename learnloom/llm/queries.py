"""The operators bound to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, language_id, lexical_search, merkle, mixing, packing, pii, quality, simhash, substring_dedup, token_files, vector_search
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [_count_of(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_span_text("base"), 256).alias("base_sha256"), _span_text("spans").alias("spans"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    field = quality.fit(docs, labels.where(~held_out))
    scores = quality.document_scores(docs, field)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_mix(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_products(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_personal_data, op3_line_quality, op4_source_mix, op5_substring_dedup,
        op6_packing, op7_embedding_dedup, op8_simhash, op9_token_files, op10_language_id,
        op11_merkle_manifest, op12_vector_search, op13_lexical_search, pipeline,
    )
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
f AS (SELECT *, (SELECT sum(source_size) FROM w) AS total,
             coalesce(sum(3 * source_size) OVER o, 0) AS capped, sum(weight) OVER r AS weights
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    r AS (ORDER BY 3 * source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT arg_min(CAST(total - capped AS DOUBLE) / weights, (3 * source_size / weight, n)) AS level FROM f WHERE 3 * source_size / weight > CAST(total - capped AS DOUBLE) / weights),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR 3 * source_size / weight <= level THEN 3.0::DOUBLE * source_size ELSE weight * level END AS target
      FROM f, level),
a AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0 ELSE 0.5::DOUBLE END AS slope FROM t),
p AS (SELECT source, source_size, target, slope - coalesce((SELECT sum(target * slope) / nullif(sum(target), 0) FROM a), 0) AS slope,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM a),
q AS (SELECT d.*, p.source_size, p.target, p.slope, p.passes,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, CASE WHEN target > 0 THEN (before + size / 2) / target END AS x,
             coalesce(CASE WHEN target > 0 THEN (passes * source_size + before + size / 2) / target END <= 1, false) AS chosen FROM q),
g AS (SELECT source, target - passes * source_size - coalesce(sum(size) FILTER (chosen), 0) AS gap FROM c GROUP BY source, target, passes, source_size),
y AS (SELECT c.source, arg_min(before, (abs(abs(gap) - size), before)) AS turned
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
      WHERE size > 0 AND chosen = (gap < 0) AND abs(abs(gap) - size) < abs(gap) GROUP BY c.source),
n AS (SELECT c.*, CAST(passes + CASE WHEN chosen <> (size > 0 AND before = coalesce(turned, -1)) THEN 1 ELSE 0 END AS INT) AS copies
      FROM c LEFT JOIN y ON c.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN copies ELSE 0 END AS copies,
       round(CASE WHEN target = 0 OR copies = 0 THEN NULL WHEN passes = 0 AND x > 1 THEN 1.0
                  ELSE least(1.0, 2 * x / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * x))) END, 9) AS position
FROM n
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS window_text FROM d, unnest(generate_series(1, len(words) - 19)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM r, unnest(generate_series(0, 19)) AS u(k)),
x AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (doc_id)),
k AS (SELECT doc_id, gone, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM e),
j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM k WHERE NOT list_contains(gone, pos) GROUP BY doc_id)
SELECT e.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM e LEFT JOIN j USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, min(reached) AS component_id, v.vec_id = min(reached) AS kept
FROM v JOIN r ON r.node = v.vec_id GROUP BY v.vec_id
"""

OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         -- CRC-32 bit by bit: the polynomial 0xEDB88320, reflected
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
  FROM documents),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
             CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[i + 1 : i + 2], ''))) FROM top WHERE len(nodes) > 1),
k AS (SELECT p.*, s.subroot, s.height, s.pos AS lang_pos, row_number() OVER () AS row_no, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root
      FROM p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT row_no, level, (pos >> level) & 1 AS odd, coalesce(nodes[xor(pos >> level, 1) + 1], '') AS beside
  FROM k JOIN tree ON k.lang IS NOT DISTINCT FROM tree.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT row_no, height + level, (lang_pos >> level) & 1, coalesce(nodes[xor(lang_pos >> level, 1) + 1], '') FROM k, top WHERE len(nodes) > 1),
listed AS (SELECT row_no, list(struct_pack(odd, beside) ORDER BY level) AS path FROM steps GROUP BY row_no),
fold AS (
  SELECT row_no, 0 AS level, coalesce(tampered, leaf) AS node, coalesce(path, []) AS path FROM k LEFT JOIN listed USING (row_no)
  UNION ALL
  SELECT row_no, level + 1, sha256(CASE WHEN path[level + 1].odd = 1 THEN path[level + 1].beside || node ELSE node || path[level + 1].beside END), path FROM fold WHERE level < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.beside), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM k JOIN fold USING (row_no) WHERE level = len(path)
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL, "op4_source_mix": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL,
        "op12_vector_search": OP12_SQL, "op13_lexical_search": OP13_SQL,
    }
