"""Similarities and match tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import normalise, squeeze, tokens


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the share of letters to change, in lower case; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise((longest - F.levenshtein(F.lower(a), F.lower(b))).cast("double") / F.nullif(longest, F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """0 if either has no tokens. Without branches, so that both lists of tokens are made once."""
    a, b = tokens(F.lower(a)), tokens(F.lower(b))
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def best_similarity(mention: Column, label: Column, aliases: Column | None = None) -> Column:
    best = F.greatest(levenshtein_similarity(mention, label), token_jaccard(mention, label))
    if aliases is None:
        return best
    return F.greatest(best, F.coalesce(F.array_max(F.transform(aliases, lambda a: levenshtein_similarity(mention, a))), F.lit(0.0)))


def quality_score(quality: Column) -> Column:
    return F.when(quality > 0, F.lit(1.0) / F.nullif(quality, F.lit(0))).otherwise(F.lit(0.0))


def context_overlap(terms: Column, text: Column) -> Column:
    """The share of terms that are words of the text."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, tokens(F.lower(text)))).cast("double") / F.nullif(F.size(terms), F.lit(0))).otherwise(F.lit(0.0))


def to_number(x: Column) -> Column:
    return squeeze(F.replace(x, F.lit(","), F.lit(""))).try_cast("double")


def numbers_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.5), 0.02 * F.greatest(F.abs(a), F.abs(b)))


def years_match(number: Column, time: Column) -> Column:
    year = F.regexp_extract(time, r"[+-]?\d{4}", 0).try_cast("int")
    return F.coalesce(number.between(1000, 2100) & (number == year), F.lit(False))


def texts_match(a: Column, b: Column) -> Column:
    return normalise(a) == normalise(b)


def is_numeric(x: Column) -> Column:
    return squeeze(x).rlike(r"\A[-+]?\d[\d,]*\.?\d*\z")


def candidate_text(label: Column, description: Column | None = None, aliases: Column | None = None) -> Column:
    """What row terms are looked for in: label, description and aliases, where there are any."""
    return F.concat_ws(" ", label, *[x for x in (description, aliases) if x is not None])
