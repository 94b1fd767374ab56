"""Readers and writers of files. Column types are declared or texts: nothing is inferred from a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.blocks import clean_cell

KINDS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "txt": "text", "md": "text", "html": "html", "htm": "html", "pdf": "pdf", "parquet": "parquet"}
MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("source_id", T.StringType()), ("source_kind", T.StringType()), ("canonical_source", T.StringType()), ("local_path", T.StringType()), ("corpus_id", T.StringType()), ("branch_id", T.StringType()), ("tags", T.ArrayType(T.StringType())), ("acquisition_status", T.StringType()), ("metadata", T.MapType(T.StringType(), T.StringType())))])
LEDGER = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("run_id", T.StringType()), ("source_id", T.StringType()), ("stage", T.StringType()), ("operation", T.StringType()), ("model", T.StringType()), ("cache_status", T.StringType()), ("estimated_input_tokens", T.LongType()), ("estimated_output_tokens", T.LongType()), ("estimated_cost_usd", T.DoubleType()), ("runtime_seconds", T.DoubleType()), ("error", T.StringType()), ("created_at", T.StringType()))])


def kind_of(path: str) -> str:
    kind = KINDS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if kind is None:
        raise ValueError(f"unknown kind of source: {path}")
    return kind


def unique_columns(names: list[str]) -> list[str]:
    """Blanks to underscores, column_i for empty names, _2, _3 ... for repeated ones."""
    out, seen = [], {}
    for i, name in enumerate(names, 1):
        base = "_".join(str(name).split()) or f"column_{i}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All cells as text, null tokens as null; the header gives the columns."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=separator or ("\t" if path.endswith(".tsv") else ","), multiLine=True, escape='"')
    df = df.toDF(*unique_columns([c.removeprefix("﻿") for c in df.columns]))
    return df.select(*(clean_cell(F.col(f"`{c}`")).alias(c) for c in df.columns)).dropna("all")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of JSON files: an array, lines, or an object that holds them under a usual name."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path, multiLine=not path.endswith(".jsonl"))
    for name in ("records", "data", "observations", "results", "items"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, content, content_hash of a tree of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("content_hash"))


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without blanks and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("source")).filter((F.col("source") != "") & ~F.col("source").startswith("#"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, mode="FAILFAST")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)
