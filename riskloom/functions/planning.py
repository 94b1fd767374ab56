"""What a question asks for, without a model: terms of start, bridge and target, direction, concepts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import compact, content_tokens, lexical_score, normalize

# Words that are no terms of a plan and no concepts, and words that tell a direction.
PLAN_STOP = "the and for with what which how why does did could would should from into about between through affect impact explain".split()
CONCEPT_STOP = "the and for with what which how why does did give find show tell between relation then that this from into could would affect impact risk supply".split()
BACKWARD = ["why", "cause", "explain", "driver"]
FORWARD = ["how", "affect", "impact", "lead", "propagate"]
CLASSIFY_BACKWARD = ["why", "cause", "explain", "source of", "drivers of"]
CLASSIFY_FORWARD = ["impact", "affect", "lead to", "consequence", "downstream"]
DIRECTIONS = ["forward", "backward", "bidirectional"]


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]+)"), 1)


def _any(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def salient(question: Column) -> Column:
    """Up to 12 distinct words of a question that may name something."""
    plain = lambda t: F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    kept = F.filter(_tokens(question), lambda t: (F.length(t) >= 3) & ~plain(t).isin(PLAN_STOP))
    return F.slice(F.array_distinct(kept), 1, 12)


def plan(question: Column) -> dict[str, Column]:
    """Terms of start, bridge and target, the direction, and whether several hops are needed.

    The first third of the salient words (three at most) starts, the last third is the target, and up
    to four others are the bridge; of two words or fewer, the first starts and the rest is the target.
    """
    terms, n = salient(question), F.size(salient(question))
    edge = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(n / 3).cast("int")))
    whole = F.array(compact(question, 80))
    start = F.when(n > 2, F.slice(terms, F.lit(1), edge)).when(n > 0, F.slice(terms, 1, 1)).otherwise(whole)
    target = F.when(n > 2, F.slice(terms, n - edge + 1, edge)).when(n > 1, F.slice(terms, 2, 1)).otherwise(whole)
    bridge = F.when(n > 2, F.slice(F.array_except(F.array_except(terms, start), target), 1, 4)).otherwise(F.array().cast("array<string>"))
    text = normalize(question)
    direction = F.when(_any(text, BACKWARD), "backward").when(_any(text, FORWARD), "forward").otherwise("bidirectional")
    return {"start": start, "bridge": bridge, "terminal": target, "direction": direction, "multi_hop": n >= 4}


def concepts(question: Column, memory: Column) -> Column:
    """Up to 12 distinct words of a question and of what is remembered of it."""
    text = F.lower(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(memory, F.lit(""))))
    kept = F.filter(_tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(CONCEPT_STOP))
    return F.slice(F.array_distinct(kept), 1, 12)


def direction(question: Column) -> Column:
    """From cause to effect, from effect to cause, or both."""
    text = normalize(question)
    return F.when(_any(text, CLASSIFY_BACKWARD), "backward").when(_any(text, CLASSIFY_FORWARD), "forward").otherwise("bidirectional")


def known_direction(c: Column) -> Column:
    return F.when(c.isin(DIRECTIONS), c).otherwise(F.lit("bidirectional"))


def is_distinctive(c: Column) -> Column:
    """Whether a term has a word that is not too general to prove anything."""
    return F.size(content_tokens(c)) > 0


def objective_terms(terms: Column, description: Column) -> Column:
    """The distinctive terms of an objective; without any, its description if that is distinctive."""
    shortened = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: compact(t, 160))
    kept = F.array_distinct(F.filter(shortened, lambda t: (t != "") & is_distinctive(t)))
    own = compact(description, 160)
    rest = F.when((own != "") & is_distinctive(own), F.array(own)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, kept).otherwise(rest)


def distinct_targets(targets: Column, others: Column) -> Column:
    """Target terms that start and bridge terms do not say already; all of them if none is left."""
    told = F.array_join(others, " ")
    kept = F.filter(targets, lambda t: lexical_score(t, told) < 0.45)
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(targets), 1, 8)
