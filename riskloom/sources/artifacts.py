"""Artifacts of a run as JSON files: documents with their blocks, registries and graphs.

Files are read by Spark's readers, one record per file or line, so any store that Spark reads will do.
Writers put a new folder beside the old one and then swap names, so that a reader sees one or the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "block_id string, evidence_id string, block_type string, document_id string, source_url string, text string, start_char int, end_char int"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, record: whole JSON files; what is no JSON object has a null record."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    return files.select("path", F.when(F.startswith("value", F.lit("{")) & F.try_parse_json("value").isNotNull(), F.col("value")).alias("record"))


def blocks_of(documents: DataFrame, record: str = "record") -> DataFrame:
    """The blocks of documents, in order: place and the fields that every block may have."""
    listed = F.from_json(F.get_json_object(record, "$.blocks"), f"array<struct<{BLOCK.replace(' string', ':string').replace(' int', ':int')}>>")
    return documents.select(F.posexplode(listed).alias("place", "b")).select("place", "b.*")


def of_kind(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.filter(F.col("block_type") == kind)


def document_records(blocks: DataFrame, order: str) -> DataFrame:
    """document_id, record: each document's blocks as one JSON object."""
    names = [c for c in blocks.columns if c not in (order,)]
    rows = blocks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*names).alias("b")))), lambda x: x["b"]).alias("blocks"))
    return rows.select("document_id", F.to_json(F.struct("document_id", "blocks")).alias("record"))


def replace(df: DataFrame, path: str) -> None:
    """Write df as JSON lines to path, in place of what is there, by a swap of names at the end."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.json(fresh)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = store.exists(target)
    if there:
        store.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    store.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    if there:
        store.delete(jvm.org.apache.hadoop.fs.Path(old), True)
