"""Fields of records kept as JSON texts: candidates, usage, answers, judgements.

A record column holds one JSON object as text. Fields that are absent, null, empty or of another
shape read as null, so each function gives a defined result for any text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.answers import clean_title
from riskloom.functions.ids import json_string
from riskloom.functions.text import normalize

# Keys in the order in which they are tried, and scores and bars of named levels.
ANSWER_KEYS = ["answer", "final_answer", "response", "content", "message", "text", "summary", "synthesis", "output"]
USAGE_KEYS = ["usage", "token_usage", "tokens", "cost", "ledger"]
NAME_KEYS = ["canonical_name", "name", "label"]
TYPE_KEYS = ["entity_type", "type"]
RELATION_KEYS = ["relation_type", "type", "predicate"]
SUBJECT_KEYS = ["subject_id", "source_id", "head_id", "subject_entity_id"]
OBJECT_KEYS = ["object_id", "target_id", "tail_id", "object_entity_id"]
TEMPORAL = ["event_date", "valid_from", "valid_to"]
BARS = {"critical": (95.0, "high"), "very high": (95.0, "high"), "high": (85.0, "high"), "medium": (55.0, "medium"), "moderate": (55.0, "medium"), "low": (25.0, "low")}
TITLE_PATHS = [
    "document.title", "document.name", "document.filename", "document.publisher", "extraction.pipeline_metadata.title", "extraction.pipeline_metadata.source_name",
    "extraction.pipeline_metadata.canonical_source", "source_url", "document.source_url", "document.canonical_url",
]
DATE_PATHS = ["document.published_at", "document.date", "extraction.pipeline_metadata.published_at"]
TAG_PATHS = ["document.credibility.tier", "document.source_type", "extraction.pipeline_metadata.source_type"]


def raw(record: Column, path: str) -> Column:
    return F.get_json_object(record, f"$.{path}")


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(filled(v) for v in values))


def first_text(*values: Column) -> Column:
    """The first text that is more than blanks, trimmed; '' if there is none."""
    return F.coalesce(*(filled(F.trim(v)) for v in values), F.lit(""))


def first_of(record: Column, *paths: str) -> Column:
    return first_nonempty(*(raw(record, p) for p in paths))


def first_text_of(record: Column, *paths: str) -> Column:
    return filled(first_text(*(raw(record, p) for p in paths)))


def clean_text(c: Column) -> Column:
    return filled(F.trim(c.cast("string")))


def to_number(c: Column) -> Column:
    """Blank and unreadable texts are null."""
    return F.trim(c.cast("string")).try_cast("double")


# ---------------------------------------------------------------- candidates


def entity_name(record: Column) -> Column:
    return F.coalesce(first_of(record, *NAME_KEYS), F.lit(""))


def entity_type(record: Column) -> Column:
    return F.coalesce(first_of(record, *TYPE_KEYS), F.lit("unknown"))


def entity_key(record: Column) -> Column:
    return F.concat(normalize(entity_type(record)), F.lit("::"), normalize(entity_name(record)))


def relation_type(record: Column) -> Column:
    return F.coalesce(first_of(record, *RELATION_KEYS), F.lit("related_to"))


def relation_ends(record: Column) -> tuple[Column, Column]:
    """Ids of subject and object; '' where none is given."""
    return F.coalesce(first_of(record, *SUBJECT_KEYS), F.lit("")), F.coalesce(first_of(record, *OBJECT_KEYS), F.lit(""))


def temporal(record: Column, inner: str = "temporal.") -> dict[str, Column]:
    """The three dates of a relation: those inside, else those at the top."""
    return {k: first_of(record, inner + k, k) for k in TEMPORAL}


def clean_temporal(record: Column) -> dict[str, Column]:
    return {k: clean_text(raw(record, k)) for k in TEMPORAL}


def elements(record: Column, path: str) -> Column:
    """The elements of an array as JSON texts; empty for what is none."""
    return F.coalesce(F.from_json(raw(record, path), "array<string>"), F.array().cast("array<string>"))


def _each(record: Column, path: str, field: str) -> Column:
    return F.filter(F.transform(elements(record, path), lambda e: filled(F.get_json_object(e, f"$.{field}"))), lambda x: x.isNotNull())


def evidence_ids(record: Column) -> Column:
    """Distinct ids of validated evidence, provenance and what a verdict used, in that order."""
    used = F.filter(elements(record, "postrag.used_evidence_ids"), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.concat(_each(record, "postrag_evidence", "evidence_id"), _each(record, "provenance", "evidence_id"), used))


def candidate_evidence_ids(record: Column) -> Column:
    return F.array_distinct(F.concat(_each(record, "postrag_evidence", "evidence_id"), _each(record, "provenance", "evidence_id")))


def provenance_quotes(record: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.transform(_each(record, "provenance", "quote"), lambda q: F.trim(q)), lambda q: q != ""), 1, most)


def candidate_id(record: Column, kind: str) -> Column:
    """The id or name given, else a hash of the whole record."""
    keys = ["entity_id", "id", "canonical_name", "name"] if kind == "entity" else ["relation_id", "id", "claim_id"]
    return F.coalesce(filled(F.trim(first_of(record, *keys))), F.sha2(record, 256))


def compact_candidate(record: Column, kind: str) -> Column:
    """What a prompt shows of a candidate."""
    text = lambda p: raw(record, p)
    shape = lambda p: F.when(F.startswith(raw(record, p), F.lit("{")), raw(record, p)).otherwise(F.lit("{}"))
    shared = [text("description").alias("description"), shape("attributes").alias("attributes"), shape("temporal").alias("temporal"), provenance_quotes(record, 3).alias("provenance_quotes")]
    if kind == "entity":
        own = [first_of(record, "canonical_name", "name").alias("canonical_name"), first_of(record, *TYPE_KEYS).alias("entity_type"), F.slice(elements(record, "aliases"), 1, 5).alias("aliases")]
    else:
        triple = F.struct(text("subject").alias("subject"), first_of(record, "relation_type", "type").alias("relation_type"), text("object").alias("object"))
        own = [triple.alias("triple"), text("subject_id").alias("subject_id"), text("object_id").alias("object_id"), text("confidence").alias("confidence")]
    return F.struct(candidate_id(record, kind).alias("candidate_id"), *own, *shared)


def candidate_query(record: Column, kind: str) -> Column:
    """What is searched for to find a candidate's evidence, as JSON with sorted keys."""
    quotes = provenance_quotes(record)
    field = lambda n, c: c.alias(n)
    if kind == "entity":
        parts = {"kind": F.lit("entity"), "canonical_name": first_of(record, "canonical_name", "name"), "entity_type": first_of(record, *TYPE_KEYS), "aliases": raw(record, "aliases")}
    else:
        parts = {"kind": F.lit("relation"), "relation_type": first_of(record, "relation_type", "type"), **{k: raw(record, k) for k in ("subject", "subject_id", "object", "object_id")}}
    parts |= {k: raw(record, k) for k in ("description", "attributes", "temporal")} | {"evidence_quotes": quotes}
    return F.to_json(F.struct(*(field(k, parts[k]) for k in sorted(parts))), {"ignoreNullFields": "false"})


def _lines(**parts: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(""))) for k, c in parts.items()))


def _quotes(record: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_each(record, "provenance", "quote"), lambda q: json_string(q)), ", "), F.lit("]"))


def entity_text(record: Column) -> Column:
    """Seven lines that stand for an entity when it is embedded."""
    shape = lambda p, empty: F.coalesce(raw(record, p), F.lit(empty))
    return _lines(
        name=entity_name(record), type=entity_type(record), aliases=shape("aliases", "[]"), description=raw(record, "description"),
        attributes=shape("attributes", "{}"), temporal=shape("temporal", "{}"), provenance_quotes=_quotes(record),
    )


def claim_text(record: Column, subject: Column, obj: Column) -> Column:
    dates = temporal(record)
    when = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), json_string(dates[k])) for k in TEMPORAL)), F.lit("}"))
    return _lines(
        subject=subject, relation_type=relation_type(record), object=obj, description=raw(record, "description"),
        attributes=F.coalesce(raw(record, "attributes"), F.lit("{}")), temporal=when, provenance_quotes=_quotes(record),
    )


def evidence_text(kind: Column, metadata: Column, text: Column) -> Column:
    return _lines(block_type=kind, metadata=F.coalesce(metadata, F.lit("{}")), text=text)


# ---------------------------------------------------------------- answers, usage, judgements


def json_object(c: Column) -> Column:
    """The text from the first { to the last }, or null."""
    return filled(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0))


def fenced_json(c: Column) -> Column:
    """A text without the code fence around it."""
    text = F.trim(F.coalesce(c, F.lit("")))
    inside = F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n?", ""), r"\n```[ \t]*\z", "")
    return F.when(F.startswith(text, F.lit("```")), F.trim(inside)).otherwise(text)


def parsed(c: Column) -> Column:
    """The text if it is JSON, else its fenced or braced part if that is; null otherwise."""
    def ok(x):
        alone = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))  # in a list nothing may follow the value
        return F.when((x != "") & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "string").isNull(), x)

    return F.coalesce(ok(F.trim(c)), ok(fenced_json(c)), ok(json_object(c)))


def answer_text(c: Column) -> Column:
    """The first answer field with text; a record without one, a list and a plain text stand for themselves."""
    text = lambda k: F.when(F.trim(raw(c, k)) != "", raw(c, k))
    record = F.startswith(F.ltrim(c), F.lit("{"))
    return F.when(record, F.coalesce(*(text(k) for k in ANSWER_KEYS), c)).otherwise(c)


def usage_record(c: Column) -> Column:
    """The first of the usage fields that holds an object; {} if none does."""
    return F.coalesce(*(F.when(F.startswith(raw(c, k), F.lit("{")), raw(c, k)) for k in USAGE_KEYS), F.lit("{}"))


def estimated_tokens(c: Column) -> Column:
    """1.3 tokens a word, one at least."""
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(13) / F.lit(10))).cast("long")


def estimated_text_tokens(c: Column) -> Column:
    """Four characters a token, one at least; for where no tokenizer is at hand."""
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def _count(usage: Column, *keys: str) -> Column:
    """The first of the counts that is a number other than zero."""
    return F.coalesce(*(F.nullif(raw(usage, k).try_cast("long"), F.lit(0)) for k in keys))


def usage_counts(usage: Column, question: Column, answer: Column) -> dict[str, Column]:
    """Input, output and total tokens under any naming, estimated from the texts where they are missing."""
    given = F.coalesce(_count(usage, "input_tokens", "prompt_tokens", "estimated_input_tokens"), estimated_tokens(question))
    made = F.coalesce(_count(usage, "output_tokens", "completion_tokens", "estimated_output_tokens"), estimated_tokens(answer))
    return {"input_tokens": given, "output_tokens": made, "total_tokens": F.coalesce(_count(usage, "total_tokens", "estimated_total_tokens"), given + made)}


def response_usage(response: Column) -> dict[str, Column]:
    """Whole-number counts of a response's usage; later names win over earlier ones."""
    whole = lambda k: F.when(raw(response, f"usage.{k}").rlike(r"^-?\d+$"), raw(response, f"usage.{k}").try_cast("long"))
    return {"input_tokens": F.coalesce(whole("input_tokens"), whole("prompt_tokens")), "output_tokens": F.coalesce(whole("output_tokens"), whole("completion_tokens")), "total_tokens": whole("total_tokens")}


def judgement(c: Column, metrics: list[str]) -> tuple[dict[str, Column], Column]:
    """A judge's scores by metric, and what is wrong with them: null if all are whole numbers from 1 to 5."""
    record = parsed(c)
    scores = {m: F.trim(raw(record, f"scores.{m}")).try_cast("double").cast("int") for m in metrics}
    problem = F.when(record.isNull(), F.lit("no JSON object")).when(raw(record, "scores").isNull(), F.lit("no scores"))
    for m in metrics:
        problem = problem.when(scores[m].isNull(), F.lit(f"no whole number for {m}")).when(~scores[m].between(1, 5), F.lit(f"{m} out of range"))
    return scores, problem


def filled_template(template: Column, values: dict[str, Column]) -> Column:
    """{key} becomes the value quoted for a shell, {key_raw} the value as it is."""
    for key, value in values.items():
        value = F.coalesce(value, F.lit(""))
        safe = F.when(value.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
        template = F.replace(F.replace(template, F.lit("{" + key + "}"), safe), F.lit("{" + key + "_raw}"), value)
    return template


def listed(c: Column) -> Column:
    """Distinct non-empty items of a text with commas, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def unique_strings(values: Column) -> Column:
    """Distinct texts that are more than blanks, trimmed, in order; for an array."""
    texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit(""))))
    return F.array_distinct(F.filter(texts, lambda v: v != ""))


def risk_bar(c: Column) -> tuple[Column, Column]:
    """A level's name or number as a bar of 0..100 and a tone; numbers up to 5 count as fifths."""
    text = F.lower(F.trim(c))
    number = text.try_cast("double")
    value = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(number <= 5, number * 20).otherwise(number)))
    tone = F.when(value >= 70, F.lit("high")).when(value >= 40, F.lit("medium")).otherwise(F.lit("low"))
    bar, name = F.lit(50.0), F.lit("medium")
    for key, (level, label) in BARS.items():
        bar, name = F.when(text == key, F.lit(level)).otherwise(bar), F.when(text == key, F.lit(label)).otherwise(name)
    return F.when(number.isNotNull(), F.round(value, 1)).otherwise(bar), F.when(number.isNotNull(), tone).otherwise(name)


def source_card(record: Column, index: Column) -> Column:
    """id, logo, title, date and tag of a record's source, each from the first field that has one."""
    titles = [filled(clean_title(raw(record, p), "")) for p in TITLE_PATHS]
    return F.struct(
        F.concat(F.lit("artifact_source_"), index).alias("id"),
        F.when(index > 9, F.lit("S")).otherwise(index.cast("string")).alias("logo"),
        F.coalesce(*titles, F.concat(F.lit("Source "), index)).alias("title"),
        F.coalesce(first_text_of(record, *DATE_PATHS), F.lit("Date unavailable")).alias("date"),
        F.coalesce(first_text_of(record, *TAG_PATHS), F.lit("Source")).alias("tag"),
    )
