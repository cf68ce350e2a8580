"""The operators' queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, counts, decontam, divergence, jaccard, langid, lm, negatives, quality, suffix, toxicity, warc
from .common import is_held_out, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", codec).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scored(docs.select("doc_id", "text"), "text", toxicity.fit(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_segments"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").drop("text", "kept")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.Index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return index.search(index.rows.filter("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scored(docs, "text", lm.fit(docs), keep_text=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.scored(docs.select("doc_id", "text"), "text", quality.fit(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(docs.select("doc_id", "text"), "text", langid.fit(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archived(table(spark, sf_dir, "pages"))
    return warc.salvaged(archives).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=90).withColumnRenamed("id", "doc_id")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved)
    return negatives.mined(rows, lambda r: r.filter("id % 100 = 0"))


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = counts.counted(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_bpe, op2_decontamination, op3_toxicity, op4_suffix, op5_neighbours, op6_lm, op7_quality, op8_langid, op9_warc, op10_jaccard, op11_negatives, op12_counts, op13_divergence]
    return {f.__name__: f for f in every}


_NIBBLES = "[" + ", ".join(f"'{k:04b}'" for k in range(16)) + "]"
_BITS = f"list_aggregate(list_transform(range(1, 41), lambda i: ({_NIBBLES})[instr('0123456789abcdef', substr(h, i, 1))]), 'string_agg', '')"
_FIVE = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))

WARC_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS x FROM s), m AS (SELECT e.doc_id, x, n FROM e JOIN n ON e.doc_id = n.doc_id),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM m a JOIN m b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
 l AS (SELECT a, b FROM i WHERE 100 * k >= 90 * (na + nb - k)), d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""


NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS s FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
 p AS (SELECT a, c, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.s DESC, s.c) AS INT) AS rank, s.c AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s QUALIFY rank <= 5"""

DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 e AS (SELECT r, lang, source, unnest(w) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d),
 k AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
 c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2), m AS (SELECT lang, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
 q AS (SELECT t.lang, t.term, 1 + (CAST(1000000000 AS HUGEINT) * (t.n + 5)) // (m.n + 5 * v.v) AS q FROM t JOIN m USING (lang) JOIN v USING (lang)),
 x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT f.lang, f.source, 'term', f.term, CAST(f.p - q.q AS BIGINT) FROM f JOIN q ON f.lang = q.lang AND f.term = q.term WHERE f.n > 0 AND f.p > q.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM o QUALIFY part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenize or compare every byte string: tests hold them against plain versions, the library, or rows kept out."""
    return {"op9_warc": WARC_SQL, "op10_jaccard": JACCARD_SQL, "op11_negatives": NEGATIVES_SQL, "op13_divergence": DIVERGENCE_SQL}
