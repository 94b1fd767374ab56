"""Row contracts as quarantine filters: what is wrong with each row, and good rows apart from bad ones.

A contract is a list of rules; a rule gives a message for a bad row and null for a good one. Rows
are never dropped or raised on: `checked` adds all messages, `split` parts the rows by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ids import is_id_part
from riskloom.operators.graph import signature_is_valid

# The allowed values of each field.
STAGES = ["discover", "acquire", "ingest", "extract", "postrag", "neo4j_fusion", "kg_irag", "sarg"]
SOURCE_KINDS = ["url", "file", "manual", "pdf", "html", "csv", "spreadsheet", "json", "text", "markdown", "unknown"]
STATUSES = ["pending", "success", "failed", "skipped_duplicate", "skipped_cached", "blocked", "dry_run"]
ACQUISITION = ["not_acquired", "acquired", "cached", "manual", "blocked", "paywalled", "not_found", "fetch_failed", "unsupported"]
CACHE = ["not_applicable", "hit", "miss", "write", "bypass", "error"]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def required(name: str) -> Column:
    return F.when(blank(F.col(name)), F.lit(f"{name} is empty"))


def choice(name: str, allowed: list[str]) -> Column:
    value = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.when(~value.isin(allowed), F.concat(F.lit(f"{name} is not known: "), value))


def id_part(name: str, optional: bool = False) -> Column:
    bad = ~is_id_part(F.col(name))
    return F.when(F.col(name).isNotNull() & bad if optional else bad, F.lit(f"{name} is not an id"))


def stage_list(name: str) -> Column:
    """Every element of the array is a known stage."""
    stages = F.coalesce(F.col(name), F.array().cast("array<string>"))
    known = F.forall(stages, lambda s: F.coalesce(F.trim(s).isin(STAGES), F.lit(False)))
    return F.when(~known, F.lit(f"{name} has an unknown stage"))


def tags(c: Column) -> Column:
    """The tags that are more than blanks, trimmed."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))


def source_rules() -> list[Column]:
    return [
        id_part("source_id"), choice("source_kind", SOURCE_KINDS), choice("acquisition_status", ACQUISITION), id_part("corpus_id"), id_part("branch_id"),
        required("source"), required("canonical_source"), id_part("duplicate_of", optional=True),
    ]


def manifest_rules() -> list[Column]:
    return [required("source"), id_part("source_id"), choice("source_kind", SOURCE_KINDS), id_part("corpus_id"), id_part("branch_id"), choice("acquisition_status", ACQUISITION), required("canonical_source")]


def status_rules() -> list[Column]:
    failed = F.when(F.col("failed_stage").isNotNull() & ~F.trim("failed_stage").isin(STAGES), F.lit("failed_stage is not known"))
    return [id_part("source_id"), choice("status", STATUSES), stage_list("completed_stages"), stage_list("skipped_stages"), failed] + [id_part(c, optional=True) for c in ("run_id", "corpus_id", "branch_id", "duplicate_of")]


def ledger_rules() -> list[Column]:
    return [id_part("event_id"), id_part("run_id"), choice("stage", STAGES), choice("cache_status", CACHE), id_part("source_id", optional=True), required("operation")]


def acquisition_rules() -> list[Column]:
    return [required("source"), choice("acquisition_status", ACQUISITION)]


def entity_rules() -> list[Column]:
    """A name and a type; an event also says which kind of event it is."""
    return [required("canonical_name"), required("entity_type"), F.when((F.col("entity_type") == "event") & blank(F.col("event_type")), F.lit("event_type is empty"))]


def relation_rules() -> list[Column]:
    """Subject and object types must suit the relation."""
    fits = signature_is_valid(F.col("subject_type"), F.col("relation"), F.col("object_type"))
    return [F.when(~F.coalesce(fits, F.lit(False)), F.lit("subject and object do not suit the relation"))]


CONTRACTS = {
    "source": source_rules,
    "manifest": manifest_rules,
    "status": status_rules,
    "ledger": ledger_rules,
    "acquisition": acquisition_rules,
    "entity": entity_rules,
    "relation": relation_rules,
}


def checked(rows: DataFrame, contract: str) -> DataFrame:
    """rows with `problems`: the messages of all rules that a row breaks, in the order of the rules."""
    return rows.withColumn("problems", F.filter(F.array(*CONTRACTS[contract]()), lambda p: p.isNotNull()))


def split(rows: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """Good rows without, bad rows with their problems."""
    every = checked(rows, contract)
    return every.filter(F.size("problems") == 0).drop("problems"), every.filter(F.size("problems") > 0)
