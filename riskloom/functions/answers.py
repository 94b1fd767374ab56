"""Cleaning and cutting of answers, stories and titles. Column functions without Python workers."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import compact, squeeze

# Openings that are no content, patterns that an answer begins with, names of internal files, empty scopes.
BOILERPLATE = [
    "based on the selected reasoning paths",
    "based on the available evidence",
    "the current investigation",
    "the disruption in kachin rare-earth mining can affect",
]
OPENINGS = [
    r"(?i)^(?:based on .*?|the .*? is as follows)\s*:?\s*",
    r"(?i)^(?:summary(?:\s+and\s+limitation)?|summary\s+of\s+risk\s+assessment|risk\s+assessment|limitation|limitations)\s*[-:]?\s*",
    r"(?i)^\s*(?:and\s+)?(?:limitation|risk\s+assessment)\s*[-:]?\s*",
]
SUMMARY = r"(?is)(?:summary(?:\s+and\s+limitation)?|summary\s+of\s+risk\s+assessment)\s*:?\s*(.*)"
HEADING_AHEAD = r"(?=(?:\*\*)?[A-Z][A-Za-z0-9 /&,\-]{2,90}(?:\*\*)?\s*:|\z)"
INTERNAL = ["extract.json", "postrag.json", "sarg_demo.json", "risk_demo.json", "forecast_demo.json", "kg_irag_demo.json", "run_summary.json", "cost_ledger.jsonl", "manifest.jsonl"]
INTERNAL_FOLDERS = ["/runs/", "\\runs\\", "/ui_state/", "\\ui_state\\"]
PLACEHOLDERS = ["", "none", "null", "undefined", "pending", "corpus-pending", "workspace", "demo", "unknown"]


def strip_markdown(c: Column) -> Column:
    """Without emphasis marks and a leading bullet, blanks squeezed."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\*\*(.*?)\*\*", "$1")
    text = F.regexp_replace(text, r"__([^_]+)__", "$1")
    return squeeze(F.regexp_replace(text, r"^\s*[-*]\s+", ""))


def clean_answer(c: Column) -> Column:
    """Without markdown and without an opening that only announces the answer."""
    text = strip_markdown(c)
    for pattern in OPENINGS:
        text = F.regexp_replace(text, pattern, "")
    return squeeze(text)


def sentences(c: Column) -> Column:
    """Non-empty sentences, cut after . ! ? and white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def first_sentences(c: Column, count: int = 2, most: int = 520) -> Column:
    """The first sentences of the answer, or of its summary where one is named."""
    plain = strip_markdown(c)
    text = F.when(plain.rlike(SUMMARY), clean_answer(F.regexp_extract(plain, SUMMARY, 1))).otherwise(clean_answer(c))
    whole = clean_answer(c)
    found = sentences(text)
    return F.when(whole == "", F.lit("")).otherwise(compact(F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, count), " ")).otherwise(text), most))


def cut(c: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis if something is left out."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def story_text(c: Column, most: int = 700) -> Column:
    text = squeeze(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\*\*(.*?)\*\*", "$1"))
    return cut(F.trim(F.regexp_replace(text, r"^\d+\.\s+", "")), most)


def story_sentences(c: Column) -> Column:
    """Sentences that do not open with boilerplate; all of them if none is left."""
    every = sentences(story_text(c, 5000))
    opens = lambda s: reduce(or_, (F.startswith(F.lower(s), F.lit(b)) for b in BOILERPLATE))
    kept = F.filter(every, lambda s: ~opens(s))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def answer_section(c: Column, heading: str, most: int = 900) -> Column:
    """The text under a heading, up to the next one."""
    name = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", heading)
    pattern = rf"(?is)(?:\*\*)?{name}(?:\*\*)?\s*:?\s*(.*?){HEADING_AHEAD}"
    return story_text(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), most)


def is_internal(c: Column) -> Column:
    """Whether a title is the name or path of one of the engine's own files."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.regexp_extract(text, "([^/]*)/*$", 1).isin(INTERNAL)
    for folder in INTERNAL_FOLDERS:
        out = out | F.contains(text, F.lit(folder))
    return (text != "") & out


def clean_title(c: Column, fallback: str = "Source") -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    name = F.regexp_replace(text, r"file://", "")
    name = F.when(name.rlike(r"[/\\]"), F.regexp_extract(name, "([^/]*)/*$", 1)).otherwise(name)
    name = F.trim(F.regexp_replace(name, "[_-]+", " "))
    return F.when((text == "") | is_internal(c) | (name == ""), F.lit(fallback)).otherwise(name)


def human_date(c: Column) -> Column:
    """An ISO time to the minute; a text that is none as it is; 'Just now' for nothing."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$")
    day = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))
    clock = F.when(F.length(c) >= 16, F.substring(c, 12, 5)).otherwise(F.lit("00:00"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Just now")).when(iso & day.isNotNull(), F.concat(F.substring(c, 1, 10), F.lit(" "), clock, F.lit(" UTC"))).otherwise(c)


def short_text(c: Column, most: int = 420) -> Column:
    text = squeeze(c)
    return F.when(text == "", F.lit("No text available.")).otherwise(cut(text, most))


def article_text(c: Column) -> Column:
    """Line ends unified, blanks squeezed, at most one empty line."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(PLACEHOLDERS)
