"""The source registry: identity, duplicates, planning and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import stable_id
from riskloom.functions.web import canonicalize_url, domain, is_url

# Statuses that block processing, kinds by suffix.
BLOCKING = ["blocked", "paywalled", "not_found", "fetch_failed", "unsupported"]
KINDS = {"pdf": "pdf", "csv": "csv", "tsv": "csv", "json": "json", "html": "html", "htm": "html", "txt": "text", "md": "text", "xlsx": "spreadsheet", "xls": "spreadsheet"}
KNOWN_STATUSES = ["success", "failed", "skipped", "running", "pending"]


def source_kind(source: Column) -> Column:
    suffix = F.lower(F.regexp_extract(F.regexp_replace(source, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(is_url(source), F.lit("url")).otherwise(F.lit("file"))
    for end, kind in KINDS.items():
        out = F.when(suffix == end, F.lit(kind)).otherwise(out)
    return out


def register(sources: DataFrame, source: str, content: str, order: str) -> DataFrame:
    """source_id, source, canonical_source, domain, source_kind, content_hash, seq: one row per input row."""
    canonical = F.coalesce(canonicalize_url(F.col(source)), F.trim(F.col(source)))
    return sources.select(
        stable_id("src_", canonical, F.col(order)).alias("source_id"),
        F.col(source).alias("source"),
        canonical.alias("canonical_source"),
        domain(F.col(source)).alias("domain"),
        source_kind(F.col(source)).alias("source_kind"),
        F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"),
        F.col(order).alias("seq"),
    )


def find_duplicates(registered: DataFrame) -> DataFrame:
    """registered with duplicate_of: the first source with equal content, else with the same canonical source.

    Both firsts come from partial aggregation; what points to a duplicate is resolved to its first.
    """
    by_hash = registered.groupBy("content_hash").agg(F.min("seq").alias("hash_first"))
    by_name = registered.groupBy("canonical_source").agg(F.min("seq").alias("name_first"))
    rows = registered.join(by_hash, "content_hash").join(by_name, "canonical_source")
    first = F.when(F.col("hash_first") < F.col("seq"), F.col("hash_first")).when(F.col("name_first") < F.col("seq"), F.col("name_first"))
    return rows.select(*registered.columns, first.alias("duplicate_of"))


def plan(sources: DataFrame, resume: bool = True, force: bool = False, dedupe: bool = True, retry_failed: bool = False, allow_blocked: bool = False) -> DataFrame:
    """sources with action and reason. Expects duplicate_of, acquisition_status, last_status (null for a new source)."""
    ladder = [
        (F.lit(force), "force_reprocess", "force=True"),
        (F.lit(dedupe) & F.col("duplicate_of").isNotNull(), "skip_duplicate", "duplicate content_hash or canonical_source"),
        (F.lit(not allow_blocked) & F.col("acquisition_status").isin(BLOCKING), "blocked", "acquisition_status"),
        (F.col("last_status").isNull(), "process", "new source"),
        (F.lit(resume) & (F.col("last_status") == "success"), "skip_cached", "previously succeeded and resume=True"),
        (F.lit(retry_failed) & (F.col("last_status") == "failed"), "retry_failed", "previously failed and retry_failed=True"),
    ]
    action, reason = F.lit("process"), F.lit("no skip rule matched")
    for when, a, r in reversed(ladder):
        when = F.coalesce(when, F.lit(False))
        action, reason = F.when(when, F.lit(a)).otherwise(action), F.when(when, F.lit(r)).otherwise(reason)
    return sources.withColumns({"action": action, "reason": reason})


def summary(sources: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n: counts along each column in one pass."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions))
    return sources.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def manifest(sources: DataFrame, include_blocked: bool = False, include_duplicates: bool = False, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Manifest rows of the sources that the flags let through."""
    rows = sources
    if not include_blocked:
        rows = rows.filter(~F.col("acquisition_status").isin(BLOCKING))
    if not include_duplicates:
        rows = rows.filter("duplicate_of IS NULL")
    if kinds:
        rows = rows.filter(F.col("source_kind").isin(kinds))
    return rows.orderBy("source_id", "source").limit(limit) if limit else rows


def upsert(stored: DataFrame, incoming: DataFrame, key: str, replace: list[str], keep: list[str]) -> DataFrame:
    """Full outer merge: `replace` columns take the incoming value if there is a row, `keep` columns the stored one if any."""
    rows = stored.alias("a").join(incoming.withColumn("__new", F.lit(True)).alias("b"), key, "full_outer")
    new = F.coalesce(F.col("b.__new"), F.lit(False))
    return rows.select(key, *(F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in replace), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in keep))


def latest(events: DataFrame, key: str, order: str, n: int = 100) -> DataFrame:
    """The last n events of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
