"""The thin queries over the training-data operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, chat_format, decontaminate, hard_negatives, jaccard_join, language_id, line_dedup, minhash, periodic_runs, substring_dedup, token_counts, toxicity
from .common import crc_bucket, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(documents, labels.select("doc_id", "toxic").filter(crc_bucket("doc_id", 5) != 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity_model(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.select("doc_id", "text", "lang").filter(crc_bucket("doc_id", 4) != 2))
    found = language_id.identify(documents, model)
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=2048)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(line_dedup.page_lines(table(spark, sf_dir, "pages")), distinct=True)
    return kept.select(F.col("key").alias("page_id"), "host", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), length=50)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, n_positives=5, n_negatives=10)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(table(spark, sf_dir, "documents"), n=5, percent=85)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic_runs.periodic)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_decontamination, op2_nearest_neighbours, op3_chat_format, op4_toxicity, op5_language_id, op6_token_counts, op7_bpe_round_trip, op8_ngram_jaccard_join, op9_line_dedup, op10_substring_dedup, op11_hard_negatives, op12_minhash_dedup, op13_periodic_runs)
    return {f.__name__: f for f in named}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, len(w[s:s+9]) AS n, array_to_string(w[s:s+9], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'user' THEN 'User' WHEN 'system' THEN 'System' ELSE '=' || replace(regexp_replace(role, '\\|###|</turn>', '\\\0', 'g'), ': ', '\: ') END || ': ' || regexp_replace(text, '\\|###|</turn>', '\\\0', 'g') || '</turn>' || chr(10) AS shown FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '')) AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gis'),
    '</?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|tr|td|th|table|title|body|html|head|main|aside)([ /][^>]*)?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM pages),
different AS (SELECT DISTINCT host, lines FROM p), hosts AS (SELECT host, count(*) AS host_pages FROM different GROUP BY host),
counted AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM different) GROUP BY host, line),
boiler AS (SELECT host, list(line) AS dropped FROM counted JOIN hosts USING (host) WHERE n >= 2 AND n > 0.1 * host_pages GROUP BY host),
k AS (SELECT page_id, p.host, coalesce(lines, []) AS lines, list_filter(coalesce(lines, []), lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept FROM p LEFT JOIN boiler USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, CAST(2 * s - 1 AS BIGINT), 100) AS x FROM (SELECT doc_id, h, unnest(generate_series(1, n - 49)) AS s FROM d WHERE n >= 50)),
first AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x),
hit AS (SELECT doc_id, s FROM w JOIN first USING (x) WHERE doc_id > least),
ranged AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -100) > 50 AS opens FROM hit),
numbered AS (SELECT doc_id, s, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM ranged),
spans AS (SELECT doc_id, k, min(s) AS b, max(s) + 50 AS e FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, b, substr(h, CAST(2 * coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) - 1 AS BIGINT), CAST(2 * (b - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1)) AS BIGINT)) AS kept FROM spans JOIN d USING (doc_id)),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last FROM spans GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(kept, '' ORDER BY b) AS kept FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(heads.kept, '') || substr(h, CAST(2 * coalesce(last, 1) - 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN heads USING (doc_id)
"""


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
WHERE rank <= 10
"""

OP12_SQL = OP8_SQL.replace("100 * shared >= 75 *", "100 * shared >= 85 *").replace("c.component_id FROM d", "c.component_id, d.doc_id = c.component_id AS kept FROM d")


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_chat_format": OP3_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_minhash_dedup": OP12_SQL}
