"""Text cleaning and parsing as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that the CSV reader of the data frames library takes as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: How an answer says that there is no match, and how it labels its choice.
NIL = r"(?i)\bnil\b|\bnone of (?:the|these|them)\b|\bno match\b|\bnot (?:in|among) the candidates\b|\bidk\b|\bi don'?t know\b"
LABELLED = r"(?i)(?:answer|final|winning\s*qid|qid)\s*[:\-]?\s*(Q\d+|NIL)"
#: Words of five languages that are not counted.
STOP_WORDS = """
the of and in to a an for on at by as is are was with from that this it its or be
de la le les des du et en un une au aux pour par dans sur avec se sa son ses qui ne
der die das und von zu im mit den dem ein eine ist
el los las y por con para del al una su lo
da do dos das no na em uma
""".split()
SPACE = r"(?U)[\s\x1c-\x1f]+"


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def unwrap(x: Column) -> Column:
    """Without one pair of triple quotes around it, then one pair of double asterisks."""
    for mark in ('"""', "**"):
        n = len(mark)
        x = F.when(x.startswith(mark) & x.endswith(mark), F.substring(x, F.lit(n + 1), F.greatest(F.length(x) - 2 * n, F.lit(0)))).otherwise(x)
    return x


def clean(x: Column) -> Column:
    return unwrap(squeeze(strip_tags(x)))


def missing_to_null(x: Column) -> Column:
    return F.when(x.isin(MISSING), None).otherwise(x)


def clean_query(x: Column) -> Column:
    """What is looked up for a cell: no quotes or double asterisks, and no full stop at the end unless there are two."""
    raw = F.trim(x)
    bare = F.trim(F.replace(F.replace(raw, F.lit('"'), F.lit("")), F.lit("**"), F.lit("")))
    return F.when(bare.endswith(".") & ~raw.endswith(".."), F.trim(F.substring(bare, F.lit(1), F.length(bare) - 1))).otherwise(bare)


def fuzzy_variants(x: Column) -> Column:
    """Other spellings of a name, in the order of these rules, each once and none equal to the name.

    All but the first are made of the name without double quotes and asterisks.
    """
    bare = F.trim(F.regexp_replace(x, r'["*]', ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    first, none = F.get(words, F.lit(0)), F.array().cast("array<string>")
    comma = F.transform(F.split(bare, ",", 2), lambda p: F.trim(p))
    swapped = F.when((F.size(comma) == 2) & F.forall(comma, lambda p: p != ""), F.array(F.concat(F.get(comma, F.lit(1)), F.lit(" "), F.get(comma, F.lit(0))), F.get(comma, F.lit(0)))).otherwise(none)
    unlike = lambda v: F.when(v != bare, F.array(v)).otherwise(none)
    rules = [
        F.array(bare),
        unlike(F.trim(F.regexp_replace(bare, r"\s*\(.*?\)\s*", " "))),
        F.regexp_extract_all(bare, F.lit(r"\(([^)]+)\)"), F.lit(1)),
        unlike(F.trim(F.regexp_replace(bare, r"^(?i:the|a|an)\s+", ""))),
        swapped,
        *[F.when(bare.contains(mark), F.split(bare, mark)).otherwise(none) for mark in (" - ", " – ", " / ")],
        F.when(~F.lower(first).isin("the", "a", "an") & (first != bare), F.array(first)).otherwise(none),
        F.when(F.size(words) >= 3, F.array(F.concat_ws(" ", F.slice(words, 1, 2)))).otherwise(none),
    ]
    return F.filter(F.array_distinct(F.transform(F.concat(*[F.coalesce(r, none) for r in rules]), lambda v: F.trim(v))), lambda v: (v != "") & (v != x))


def tokens(x: Column) -> Column:
    """Split at single spaces, as Spark compiles any other pattern of split() again for each row."""
    return F.array_remove(F.split(F.regexp_replace(x, SPACE, " "), " "), "")


def row_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3))


def normalise(x: Column) -> Column:
    return F.lower(squeeze(x))


def change(before: Column, after: Column) -> Column:
    """same, case (only letters' case or white space differ) or real."""
    return F.when(before.eqNullSafe(after), "same").when(normalise(before).eqNullSafe(normalise(after)), "case").otherwise("real")


def split_list(x: Column) -> Column:
    return F.filter(F.split(x, "[|]"), lambda v: v != "")


def llm_terms(x: Column) -> Column:
    """Suggested terms: what follows the last marker of the first kind that is there, split at semicolons, without numbering; line breaks are spaces."""
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    after = reduce(lambda rest, mark: F.when(x.contains(mark), F.substring_index(x, mark, -1)).otherwise(rest), ["Answer:", "Candidates:", "FINAL:"], x)
    return F.array_distinct(F.filter(F.transform(F.split(after, ";"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^\d+[.)]\s*", ""))), lambda t: t != ""))


def entity_id(x: Column) -> Column:
    return F.regexp_extract(x, r"\bQ\d+\b", 0)


def property_id(x: Column) -> Column:
    return F.regexp_extract(x, r"\bP\d+\b", 0)


def final_answer(x: Column, ids: Column | None = None, allow_nil: bool = True) -> Column:
    """The choice an answer ends in: the id or NIL after a label such as `answer:`, else the last id, else NIL if it says so, else null.

    With ids, only those count; a labelled id that isn't among them is passed over. A labelled NIL that isn't allowed is null.
    """
    labelled = F.regexp_extract(x, LABELLED, 1)
    every = F.regexp_extract_all(x, F.lit(r"Q\d+"), F.lit(0))
    known = every if ids is None else F.filter(every, lambda q: F.array_contains(ids, q))
    nil = F.when(F.lit(allow_nil), F.lit("NIL"))
    good = labelled.rlike(r"^Q\d+$") if ids is None else F.array_contains(ids, labelled)
    return F.when(F.upper(labelled) == "NIL", nil).when((labelled != "") & good, labelled).when(F.size(known) > 0, F.try_element_at(known, F.lit(-1))).when(is_nil(x), nil)


def is_nil(x: Column) -> Column:
    return x.rlike(NIL)


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def render(template: str, **values: Column) -> Column:
    """A template with ${name} for each value; names without a value stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def guard_correction(before: Column, after: Column) -> Column:
    """A corrected text, or the one before it if the correction is empty or over three times as long."""
    out = F.trim(F.regexp_replace(F.replace(after, F.lit("\n"), F.lit(" ")), "^[\"']+|[\"']+$", ""))
    out = F.when(out.endswith(".") & ~before.endswith("."), F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out)
    return F.when((out == "") | (F.length(out) > 3 * F.length(before)), before).otherwise(out)


def strip_signs(x: Column) -> Column:
    """Without punctuation and symbols at the ends."""
    return F.regexp_replace(x, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def counts_as_token(token: Column) -> Column:
    """Whether a token is counted: two characters or more, no stop word and no number."""
    return (F.length(token) >= 2) & ~token.isin(sorted(set(STOP_WORDS))) & ~token.rlike(r"^\p{N}+$")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """In Unicode's compatibility form, for which there is no built-in function; a null stays one."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def uri(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), x).otherwise(F.concat(F.lit(prefix), x))


def uri_tail(x: Column) -> Column:
    return F.regexp_extract(x, "([^/]+)/*$", 1)
