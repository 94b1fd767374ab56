"""Text normalisation and lexical matching as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no focus in a question, and words too general for an objective.
FOCUS_STOP_WORDS = "the a an and or of to in on for with what which how why is are was were does do did give find show tell me about then if so that this between relation".split()
GENERIC_WORDS = (
    "the and for with from into onto about between through what which how why when where who does did could would should can may might must need needs needed "
    "identify understand determine establish explain assess evaluate analyze analyse show tell find retrieve investigate answer "
    "impact effect affect affects affected consequence consequences outcome outcomes role nature extent availability available production produce produces produced "
    "supply chain connection connections dependency dependencies risk risks issue issues event events condition conditions target source bridge"
).split()


def normalize(c: Column) -> Column:
    """Lower case, possessives off, everything but a-z and 0-9 to single blanks."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    text = F.regexp_replace(text, "['’]s\\b", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\s+", " "))


def compact(c: Column, most: int, ellipsis: str = "...") -> Column:
    text = squeeze(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, most - len(ellipsis))), F.lit(ellipsis))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def word_list(words: list[str]) -> Column:
    """Words without blanks as an array: two calls and one literal, where a literal for each word takes milliseconds apiece."""
    return F.split(F.lit(" ".join(words)), " ")


def tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct normalised tokens of at least `least` characters, in order, without stop words."""
    words = F.split(normalize(c), " ")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= least)), word_list(stop))


def focus_terms(question: Column) -> Column:
    return tokens(question, FOCUS_STOP_WORDS)


def content_tokens(c: Column) -> Column:
    return tokens(c, GENERIC_WORDS)


def hits(terms: Column, text: Column) -> Column:
    """How many terms stand in the text, as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def bound(c: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it (Catalyst would repeat the expression)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normal_score(q: Column, t: Column) -> Column:
    """`lexical_score` of texts that are normalised already."""
    terms = F.filter(F.split(q, " "), lambda w: F.length(w) >= 3)
    return (
        F.when((q == "") | (t == ""), F.lit(0.0))
        .when(q == t, F.lit(1.0))
        .when(F.contains(t, q) | F.contains(q, t), F.lit(0.9))
        .when(F.size(terms) == 0, F.lit(0.0))
        .otherwise(hits(terms, t) / F.size(terms))
    )


def lexical_score(query: Column, text: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the share of longer query terms found in the text."""
    both = F.struct(normalize(query).alias("q"), normalize(text).alias("t"))
    return bound(both, lambda x: normal_score(x["q"], x["t"]))


def objective_score(text: Column, terms: Column) -> Column:
    """The best of lexical score and token overlap over an objective's distinctive terms."""

    def of(x):
        def one(term):
            def scored(y):
                overlap = F.size(F.array_intersect(y["words"], x["own"])) / F.greatest(F.lit(1), F.size(y["words"]))
                return F.when(F.size(y["words"]) == 0, F.lit(0.0)).otherwise(F.greatest(normal_score(y["q"], x["t"]), overlap))

            return bound(F.struct(content_tokens(term).alias("words"), normalize(term).alias("q")), scored)

        return F.when(x["t"] == "", F.lit(0.0)).otherwise(F.coalesce(F.array_max(F.transform(terms, one)), F.lit(0.0)))

    return bound(F.struct(normalize(text).alias("t"), content_tokens(text).alias("own")), of)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """A prefixed hash of the parts, which are kept apart and may be null."""
    joined = F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))
