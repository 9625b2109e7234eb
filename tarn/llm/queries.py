"""The queries of the operators in this subpackage and, where SQL can express one, the SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.embedding_dedup import join_embeddings

    return join_embeddings(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.pii import detect

    return detect(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import chroma

    media = chroma.render(_table(spark, sf_dir, "embeddings"))
    return chroma.align(chroma.fingerprints(media, "vec_id", "audio"), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import chat

    trap = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(trap))
    rows = rows.unionAll(extra)
    out = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content")))
    read = out.withColumn("read", chat.read_chats(F.col("formatted"), F.col("turns")))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("read", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.withColumn("learnt", learnt).select(
        "conv_id",
        "n_turns",
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.weak_quality import classify

    return classify(_table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "kept")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.jaccard_join import join_ngrams

    return join_ngrams(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import common, warc

    archive, index = common.fresh_path(spark, "archive"), common.fresh_path(spark, "index")
    pages = _table(spark, sf_dir, "pages")
    warc.write_archive(pages, archive)
    warc.build_index(spark, archive, index)
    lines = warc.lookup(index, pages.select(warc.written_url(F.col("url")).alias("url")).distinct())
    read = warc.read_records(spark, lines, payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.bpe import encode

    return encode(_table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {
    "op3_token_counts": op3_token_counts,
    "op5_chroma_alignment": op5_chroma_alignment,
    "op1_epsilon_grid": op1_epsilon_grid,
    "op9_warc_index": op9_warc_index,
    "op6_chat_parts": op6_chat_parts,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op4_pii_crf": op4_pii_crf,
    "op7_weak_label_quality": op7_weak_label_quality,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op10_bpe": op10_bpe,
}

SQL: dict[str, str] = {
    "op1_epsilon_grid": r"""
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        reach AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.seen)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
        FROM embeddings e JOIN (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id) r USING (vec_id)""",
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) i
            JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * i.c >= 80 * (p.n + q.n - i.c)),
        reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen),
        same AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS key FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, coalesce(min(d.doc_id) FILTER (WHERE same.key IS NOT NULL) OVER (PARTITION BY same.key), d.doc_id) AS class_id
        FROM documents d JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id)""",
    "op9_warc_index": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - (i % 4) * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op6_chat_parts": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body, replace(replace(role, '\', '\\'), '<|', '<\|') AS head FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
