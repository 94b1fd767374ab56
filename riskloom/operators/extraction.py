"""Raw candidates of an extraction made sound: entities and relations renumbered, deduplicated and tied to evidence.

Input rows are (document, place, record): a record is one JSON object as text, its place the order
in which it was extracted. Documents are independent, and each is as large as one extraction's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.records import clean_text, elements, first_of, raw

TEMPORAL = ["event_date", "valid_from", "valid_to"]


def evidence_refs(record: Column) -> Column:
    """Distinct (evidence_id, quote) of a record's evidence: an id alone, or an object with one."""
    def one(e):
        inside = F.startswith(e, F.lit("{"))
        return F.struct(F.when(inside, clean_text(F.get_json_object(e, "$.evidence_id"))).otherwise(clean_text(e)).alias("evidence_id"), F.when(inside, clean_text(F.get_json_object(e, "$.quote"))).alias("quote"))

    refs = F.transform(F.filter(elements(record, "evidence"), lambda e: e.isNotNull()), one)
    return F.array_distinct(F.filter(refs, lambda r: r["evidence_id"].isNotNull()))


def _with_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows with `refs`, those of the document's evidence (document, evidence_id); rows without any are left out."""
    refs = rows.select("document", "place", F.posexplode(evidence_refs(F.col("record"))).alias("at", "ref")).withColumn("evidence_id", F.col("ref.evidence_id"))
    known = refs.join(evidence.select("document", "evidence_id").distinct(), ["document", "evidence_id"], "left_semi")
    kept = known.groupBy("document", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("refs"))
    return rows.join(kept, ["document", "place"])


def _first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the least place of each key."""
    best = rows.groupBy("document", *keys).agg(F.min("place").alias("place"))
    return rows.join(best.select("document", "place"), ["document", "place"], "left_semi")


def _numbered(rows: DataFrame, prefix: str) -> DataFrame:
    """rows with new_id: prefix and the row's number in its document."""
    return rows.withColumn("new_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("document").orderBy("place"))))


def entities(raw_rows: DataFrame, evidence: DataFrame, types: list[str] | None = None) -> DataFrame:
    """document, entity_id (e1, e2 ...), old_id, canonical_name, entity_type, aliases, description, attributes, three dates, refs.

    Left out: records without id, name, known type or evidence of their document, and repeats of a name and type.
    """
    r = F.col("record")
    rows = raw_rows.select(
        "document", "place", "record", clean_text(raw(r, "entity_id")).alias("old_id"), clean_text(first_of(r, "canonical_name", "name")).alias("canonical_name"), clean_text(first_of(r, "entity_type", "type")).alias("entity_type"),
    ).filter("old_id IS NOT NULL AND canonical_name IS NOT NULL AND entity_type IS NOT NULL")
    if types:
        rows = rows.filter(F.col("entity_type").isin(types))
    rows = _with_evidence(rows, evidence).withColumns({"k1": F.lower("canonical_name"), "k2": F.lower("entity_type")})
    rows = _numbered(_first_of(rows, "k1", "k2"), "e")
    aliases = F.filter(F.transform(elements(r, "aliases"), clean_text), lambda a: a.isNotNull())
    attributes = F.when(F.startswith(raw(r, "attributes"), F.lit("{")), raw(r, "attributes")).otherwise(F.lit("{}"))
    dates = [clean_text(raw(r, f"temporal.{t}")).alias(t) for t in TEMPORAL]
    return rows.select("document", F.col("new_id").alias("entity_id"), "old_id", "canonical_name", "entity_type", aliases.alias("aliases"), clean_text(raw(r, "description")).alias("description"), attributes.alias("attributes"), *dates, "refs")


def relations(raw_rows: DataFrame, known: DataFrame, evidence: DataFrame, types: list[str] | None = None) -> DataFrame:
    """document, relation_id (r1, r2 ...), subject_id, subject, relation_type, object_id, object, description, three dates, confidence, refs.

    Ends are old or new ids of the document's entities. Left out: records without both ends, known
    type or evidence, and repeats of a triple with the same dates.
    """
    r = F.col("record")
    rows = raw_rows.select(
        "document", "place", "record", clean_text(raw(r, "subject_id")).alias("s"), clean_text(raw(r, "object_id")).alias("o"), clean_text(first_of(r, "relation_type", "type")).alias("relation_type"),
        *(clean_text(raw(r, f"temporal.{t}")).alias(t) for t in TEMPORAL),
    ).filter("s IS NOT NULL AND o IS NOT NULL AND relation_type IS NOT NULL")
    if types:
        rows = rows.filter(F.col("relation_type").isin(types))
    # an old id names the entity extracted last under it; a new id stands where no old one is spelt so
    spelt = F.explode(F.array(F.struct(F.lit(1).alias("old"), F.col("old_id").alias("spelt")), F.struct(F.lit(0).alias("old"), F.col("entity_id").alias("spelt"))))
    named = known.select("document", "entity_id", "canonical_name", F.substring("entity_id", 2, 20).cast("int").alias("k"), spelt.alias("x"))
    found = named.groupBy("document", F.col("x.spelt").alias("spelt")).agg(F.max(F.struct("x.old", "k", "entity_id", "canonical_name")).alias("e")).select("document", "spelt", "e.entity_id", "e.canonical_name")
    for end, name, column in (("subject_id", "subject", "s"), ("object_id", "object", "o")):
        rows = rows.join(found.select("document", F.col("spelt").alias(column), F.col("entity_id").alias(end), F.col("canonical_name").alias(name)), ["document", column])
    rows = _with_evidence(rows, evidence)
    rows = _numbered(_first_of(rows, "subject_id", "relation_type", "object_id", *TEMPORAL), "r")
    confidence = first_of(r, "extraction_confidence", "confidence").try_cast("double")
    return rows.select("document", F.col("new_id").alias("relation_id"), "subject_id", "subject", "relation_type", "object_id", "object", clean_text(raw(r, "description")).alias("description"), *TEMPORAL, confidence.alias("confidence"), "refs")
