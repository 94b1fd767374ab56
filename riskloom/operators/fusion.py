"""Validated records merged into the graph: sources, evidence, entities and claims with their lineage.

Versions of one thing come in with the run, corpus, branch and source that saw them and a seq that
orders them; a merge gives one row per key. What a rule keeps first or last is decided by seq, and
lists of lineage hold distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAGE = ["run_id", "corpus_id", "branch_id", "source_id"]


def first_given(c: str) -> Column:
    """The first value that is given."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)


def last(c: str) -> Column:
    """The value of the last version, given or not."""
    return F.max_by(F.struct(c), "seq")[c].alias(c)


def lineage() -> list[Column]:
    """Distinct values of each kind, and those of the last version."""
    lists = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in LINEAGE]
    return lists + [F.max_by(c, "seq").alias(f"latest_{c}") for c in LINEAGE]


def merge(versions: DataFrame, key: str, keep_first: list[str], take_last: list[str]) -> DataFrame:
    """One row per key: first given values, last values, lineage and how many versions there were."""
    return versions.groupBy(key).agg(*(first_given(c) for c in keep_first), *(last(c) for c in take_last), *lineage(), F.count("*").alias("versions"))


def merge_sources(versions: DataFrame) -> DataFrame:
    """By URL, or by source id where there is none: the first id stays, the last document's fields count."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("id:"), "source_id"))
    rows = versions.withColumns({"source_key": key, "first_source_id": F.col("source_id")})
    return merge(rows, "source_key", ["first_source_id"], ["title", "publisher", "published_at", "document_id"])


def merge_evidence(versions: DataFrame) -> DataFrame:
    return merge(versions, "evidence_id", [], ["text", "block_type", "document_id", "source_url"])


def merge_entities(versions: DataFrame) -> DataFrame:
    """The first name, type and description stay; the decision and score are those of the last version."""
    return merge(versions, "key", ["canonical_name", "entity_type", "description"], ["postrag_decision", "grounding_score"])


def merge_claims(versions: DataFrame) -> DataFrame:
    return merge(versions, "claim_key", ["subject_key", "relation_type", "object_key"], ["description", "postrag_decision", "grounding_score"])


def scopes(versions: DataFrame) -> DataFrame:
    """kind, key, parent: the corpora, branches (by corpus) and runs (by branch) that versions name."""
    branch = F.concat_ws("::", "corpus_id", "branch_id")
    rows = versions.select("corpus_id", branch.alias("branch_key"), "run_id").distinct()
    parts = [
        rows.select(F.lit("corpus").alias("kind"), F.col("corpus_id").alias("key"), F.lit(None).cast("string").alias("parent")),
        rows.select(F.lit("branch").alias("kind"), F.col("branch_key").alias("key"), F.col("corpus_id").alias("parent")),
        rows.select(F.lit("run").alias("kind"), F.col("run_id").alias("key"), F.col("branch_key").alias("parent")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def resolve(entities: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """entities with resolved_key, decision and reason.

    candidates: incoming_key, key (its nearest neighbours); decisions: incoming_key, decision, merge_key, reason, as a
    judge gave them. Only a merge into a candidate that was shown counts; anything else makes a new entity.
    """
    shown = candidates.select("incoming_key", F.col("key").alias("merge_key")).distinct().withColumn("shown", F.lit(True))
    any_ = candidates.groupBy("incoming_key").agg(F.count("*").alias("candidates"))
    rows = entities.join(any_, "incoming_key", "left").join(decisions, "incoming_key", "left").join(shown, ["incoming_key", "merge_key"], "left")
    merged = (F.col("decision") == "merge_with_existing") & F.coalesce("shown", F.lit(False))
    why = F.when(F.col("candidates").isNull(), F.lit("no candidates")).when(F.coalesce(merged, F.lit(False)), F.col("reason")).otherwise(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("no valid candidate chosen")))
    chosen = F.coalesce(merged, F.lit(False))
    return rows.select(*entities.columns, F.when(chosen, F.col("merge_key")).otherwise(F.col("incoming_key")).alias("resolved_key"), F.when(chosen, "merge_with_existing").otherwise("create_new").alias("merge_decision"), why.alias("merge_reason"))


def links(rows: DataFrame, key: str, evidence: DataFrame) -> DataFrame:
    """key, evidence_id with lineage: each pair once; rows has key, evidence_ids (an array), seq and lineage."""
    pairs = rows.select(key, "seq", *LINEAGE, F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    known = pairs.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return known.groupBy(key, "evidence_id").agg(*lineage())


def counts(**tables: DataFrame) -> DataFrame:
    """kind, n."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in tables.items()))


# ---------------------------------------------------------------- validation


def block_index(candidates: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence_id, kind, candidate_id) for each pointer into the evidence, and the candidates without any.

    candidates: kind, candidate_id, evidence_ids.
    """
    pointers = candidates.select("kind", "candidate_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    usable = pointers.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi").select("evidence_id", "kind", "candidate_id").distinct()
    return usable, candidates.select("kind", "candidate_id").distinct().join(usable, ["kind", "candidate_id"], "left_anti")


def batches(index: DataFrame, size: int) -> DataFrame:
    """index with `batch`: candidates of a block and kind in groups of at most size, by id; one group if size is 0."""
    place = F.row_number().over(Window.partitionBy("evidence_id", "kind").orderBy("candidate_id")) - 1
    return index.withColumn("batch", F.floor(place / size).cast("int") if size > 0 else F.lit(0))


def expected_verdicts(index: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts on candidates that were asked about a block; of several on one, the last. verdicts: evidence_id, kind, candidate_id, seq, ..."""
    rest = [c for c in verdicts.columns if c not in ("evidence_id", "kind", "candidate_id")]
    asked = verdicts.join(index, ["evidence_id", "kind", "candidate_id"], "left_semi")
    return asked.groupBy("evidence_id", "kind", "candidate_id").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("evidence_id", "kind", "candidate_id", "v.*")


def unresolved(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates that no verdict on any of their blocks speaks of."""
    return candidates.select("kind", "candidate_id").distinct().join(judged.select("kind", "candidate_id").distinct(), ["kind", "candidate_id"], "left_anti")
