"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import table

SHARD_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.warc import capture_histories

    return capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.toxicity import CATEGORIES, score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.vector_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.exact_dedup import decide

    return decide(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.part_enum import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


def op8_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.token_counts import section_counts

    return section_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.wordbpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_extendible_shards": f"""
            WITH docs AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                          CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16)) AS UBIGINT) AS h FROM documents),
            bits AS (SELECT *, lpad(bin(h), 64, '0') AS b FROM docs),
            nodes AS (SELECT d.depth, substr(b, 1, d.depth) AS node, sum(n_bytes) AS total, count(*) AS n
                      FROM bits, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY ALL),
            large AS (SELECT depth, node FROM nodes WHERE total > {SHARD_BYTES} AND n > 1),
            leaf AS (SELECT bits.doc_id, bits.b, bits.n_bytes, coalesce(max(large.depth) + 1, 0) AS depth
                     FROM bits LEFT JOIN large ON large.node = substr(bits.b, 1, large.depth) GROUP BY ALL)
            SELECT doc_id, 's' || substr(b, 1, depth) AS shard_id, CAST(depth AS INTEGER) AS local_depth, n_bytes FROM leaf""",
        "op6_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
            FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    }
