"""The queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, hardnegatives, htmltext, linededup, lmscore, neardup, phrases, quality, sharding, toxicity, warc
from .shared import fold, shared_folder

SHARDS = [f"shard-{i:03d}" for i in range(100)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)


def _held_out(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), *scored.columns[1:])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _held_out(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir))))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs.select("doc_id"), ["doc_id"], SHARDS)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = lmscore.score_texts(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), *scored.columns[1:])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path)).drop("uri", "file", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _held_out(quality.score_quality(docs, quality.fit_voter(docs, _labels(spark, sf_dir))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0, scale=256)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract_text(pages, htmltext.learn_weights(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_decontamination, op4_sharding, op5_neighbours, op6_lm_scoring, op7_warc, op8_quality, op9_near_duplicates, op10_line_dedup, op11_phrases, op12_hard_negatives, op13_html_extraction)}


def oracle_sql() -> dict[str, str]:
    claimed = ",".join(map(str, sharding.fill_table(SHARDS)))
    return {
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
                 h AS (SELECT *, sha1(body) AS hexed FROM p),
                 b AS (SELECT *, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(hexed, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS fives FROM h)
            SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
                   list_aggregate(list_transform(fives, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(f AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
            FROM b""",
        "op11_phrases": r"""
            WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
                 p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM d),
                 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang HAVING sum(len(w)) > 0),
                 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
                 f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
                 c AS (SELECT * FROM f WHERE k > 1),
                 longer AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS part, f FROM c WHERE k = 3) GROUP BY ALL),
                 kept AS (SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.g = longer.part WHERE longer.f IS NULL OR 100 * longer.f < 50 * c.f),
                 cuts AS (SELECT lang, g, f AS a, unnest(range(1, k)) AS j FROM kept),
                 s AS (SELECT c.lang, c.g, c.a, c.j, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                       FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.j] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.j + 1:]),
                 lowest AS (SELECT lang, g, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
                 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, score FROM lowest)
            SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
        "op12_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
                 p AS (SELECT a, b AS p, s AS ps FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
                 r AS (SELECT p.a, p.p, p.ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND s.la <> s.lb AND 30 * p.ps <= 100 * s.s AND 100 * s.s <= 90 * p.ps)
            SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM r WHERE rank <= 10""",
        "op4_sharding": f"""
            WITH t AS (SELECT string_split('{claimed}', ',') AS claimed),
                 d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
            SELECT doc_id, slot, CAST(claimed[slot + 1] AS INTEGER) AS shard_id, 'shard-' || lpad(claimed[slot + 1], 3, '0') AS shard FROM d, t""",
    }
