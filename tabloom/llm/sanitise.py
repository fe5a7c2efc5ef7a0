"""Personal data, and the terms of a corpus that give it away, in DataFrame operations only.

The protected entities are the e-mail and IP addresses, card and phone numbers that patterns find. A term is a word
in lower case, outside of e-mail addresses. Over all documents, a term t tells log2(n(t,e) N / (n(t) n(e))) bits about entity e, of the log2(N / n(e))
bits that e itself has, where each n counts documents and n(t,e) those that have both anywhere. A term that tells at
least the share THRESHOLD of them is generalised wherever it occurs. Copies of a document or a passage are no evidence:
the texts with both must be CONTEXTS or more, the words around the term and each of three min-hashes of the texts (over shingles) must
differ among them, and the first of the min-hashes and the words around the term must do so in the share DIVERSE of them.

Matches are leftmost and do not overlap within a kind. Null and empty texts have no spans. Repeated rows each get their
row; an empty table gives an empty one. Terms that overlap other spans aren't listed. Scripts without spaces have no
words other than whole runs of letters. Other columns are ignored by spans() and kept by redact(). Time is linear in a
text, but for pairs of its words and of its entities that are in other texts too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BROADCAST_ROWS, cut, few, fold, let, small, table, unpacked, with_marks
from tabloom.llm.contamination import text_key

# Possessive, as no shorter match could do; a match starts at the end of the last one or not inside a run that it could have taken.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words on either side of a term whose hash is its context.
NEAR = 5
SHINGLE = 5
CONTEXTS = 2
DIVERSE = 0.75
THRESHOLD = 0.9
WORD = r"\p{L}+"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, k: total + value(k)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _places(text: Column, pattern: str) -> Column:
    """Structs of start and value of all matches: one fold over what is between and the matches."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def step(done: Column, p: Column) -> tuple[Column, dict[str, Column]]:
        start = done["end"] + F.length(p["between"])
        out = F.when(p["value"].isNotNull(), F.array(F.struct(start.alias("start"), p["value"].alias("value")))).otherwise(F.array().cast("array<struct<start:int,value:string>>"))
        return out, {"end": start + F.coalesce(F.length(p["value"]), F.lit(0))}

    return fold(pairs, {"end": F.lit(0)}, "struct<start:int,value:string>", step)


def base_spans(text: Column) -> Column:
    """Structs of start, number and name of the kind, end, and the entity, by start and kind."""

    def of(number: int, kind: str) -> Column:
        def span(s: Column) -> Column:
            value = F.lower(s["value"]) if kind in ("email", "ip") else _digits(s["value"])
            return F.struct(s["start"].alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["value"])).alias("end"), F.concat(F.lit(f"{kind}:"), value).alias("entity"))

        found = F.transform(F.filter(_places(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])), lambda s: span(s))
        return F.when(text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast("array<struct<start:int,number:int,kind:string,end:int,entity:string>>"))

    return F.array_sort(F.concat(*[of(number, kind) for number, kind in enumerate(PATTERNS)]))


def _lines(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    """The words of a text in lower case, and in their places its e-mail addresses, whose parts are no words."""
    text = F.coalesce(text, F.lit(""))
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(f"{EMAIL}|{WORD}"), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.transform(found, F.lower)


def _tells(n_te: Column, n_t: Column, n_e: Column, n: int, threshold: float) -> Column:
    return F.log2(n_te * n / (n_t * n_e)) >= threshold * F.log2(F.lit(float(max(n, 1))) / n_e)


def _least(hashes: Column, i: int) -> Column:
    """The i-th min-hash."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(i), h)))


def candidate_terms(found: DataFrame, n: int, threshold: float = THRESHOLD, contexts: int = CONTEXTS, diverse: float = DIVERSE) -> DataFrame:
    """(term, entity, n_te, n_e) of what tells enough if no other document has the term, of the texts with entities (h1, h2, copies, entities, tokens)."""
    each = found.select("h1", "h2", "copies", F.explode("entities").alias("entity"))
    # an entity of one text tells nothing about others
    entities = cut(each.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= contexts) & (F.col("n_e") < n)).drop("texts"))
    of = cut(each.join(small(entities.select("entity")), "entity", "left_semi").select("h1", "h2", "entity"))
    texts = found.join(small(of.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi")
    size = F.size("tokens")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(size - (SHINGLE - 1), F.lit(1))), lambda k: F.xxhash64(F.slice("tokens", k, SHINGLE)))
    texts = cut(texts.where(size > 0).withColumn("shingles", shingles).select("h1", "h2", "copies", "tokens", *[_least(F.col("shingles"), i).alias(f"s{i}") for i in (1, 2, 3)]))
    around = F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(F.get("tokens", k - 1).alias("term"), F.xxhash64(F.slice("tokens", F.greatest(k - NEAR, F.lit(1)), F.least(k, F.lit(NEAR + 1)) + NEAR)).alias("context")))
    words = texts.select("h1", "h2", "copies", "s1", "s2", "s3", F.explode(around).alias("w")).groupBy("h1", "h2", "copies", "s1", "s2", "s3", "w.term").agg(F.min("w.context").alias("context"))
    words = cut(words)
    differ = ("context", "s1", "s2", "s3")
    pairs = words.join(of, ["h1", "h2"]).groupBy("term", "entity").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts"), *[(F.min(c) < F.max(c)).alias(c) for c in differ])
    pairs = pairs.where(reduce(lambda a, b: a & b, [F.col("texts") >= contexts, *map(F.col, differ)])).drop(*differ)
    # a term is in at least the documents with entities that have it: what tells too little at that count tells less at its own
    least = words.groupBy("term").agg(F.sum("copies").alias("least"))
    pairs = cut(pairs.join(small(entities), "entity").join(least, "term").where(_tells(F.col("n_te"), F.col("least"), F.col("n_e"), n, threshold)).select("term", "entity", "n_te", "n_e", "texts"))
    # distinct values by summing in two steps, so that no task holds all texts of a pair
    those = cut(words.join(small(pairs.select("term").distinct()), "term", "left_semi").join(of, ["h1", "h2"]).join(small(pairs.select("term", "entity")), ["term", "entity"], "left_semi").select("term", "entity", "context", "s1"))
    for c in ("context", "s1"):
        distinct = those.groupBy("term", "entity", c).agg(F.lit(1).alias("one")).groupBy("term", "entity").agg(F.count("one").alias("distinct"))
        pairs = pairs.join(distinct, ["term", "entity"]).where(F.col("distinct") >= diverse * F.col("texts")).drop("distinct")
    return cut(pairs.drop("texts"))


def told(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, contexts: int = CONTEXTS, diverse: float = DIVERSE) -> DataFrame:
    """(h1, h2, rep, at) of the texts with terms that tell too much: the least doc_id of each and which of its words they are."""
    n = docs.count()
    pairs = candidate_terms(found, n, threshold, contexts, diverse)
    # every word is counted, and summed before it is shuffled: places are listed of those terms alone that tell enough
    counts = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    good = cut(counts.join(small(pairs), "term").where(_tells(F.col("n_te"), F.col("n_t"), F.col("n_e"), n, threshold)).select("term").distinct())
    rows = docs.select("doc_id", *text_key(F.col("text")), F.posexplode(_words(F.col("text"))).alias("at", "term"))
    # of a text, at most its words
    return cut(rows.join(small(good), "term", "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.array_sort(F.collect_set("at")).alias("at")))


def _merged(base: Column, terms: Column) -> Column:
    """Structs of start, number and name of the kind, and end, in order, without terms that overlap others."""
    kind = "struct<start:int,number:int,kind:string,end:int>"
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column) -> Column:
        return F.when(s.isNotNull(), F.array(s)).otherwise(none)

    def step(acc: Column, s: Column) -> tuple[Column, dict[str, Column]]:
        term, held = s["number"] == len(PATTERNS), acc["held"]
        # a term is held until it is known that no span begins inside it
        before = F.when(~term & held.isNotNull() & (s["start"] < held["end"]), none).otherwise(one(held))
        out = F.when(term, before).otherwise(F.concat(before, F.array(s)))
        return out, {"end": F.when(term, acc["end"]).otherwise(F.greatest(acc["end"], s["end"])), "held": F.when(term & (s["start"] >= acc["end"]), s)}

    return fold(F.array_sort(F.concat(base, terms)), {"end": F.lit(0), "held": F.lit(None).cast(kind)}, kind, step, lambda acc: one(acc["held"]))


def spans(docs: DataFrame, **how) -> DataFrame:
    """(h1, h2, base, spans) of the texts with spans: structs of start, number and name of the kind, and end, in order."""
    docs = docs.select("doc_id", "text")
    h1, h2 = text_key(F.col("text"))
    some = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in PATTERNS.values()])
    rows = docs.where(some).select(h1, h2, base_spans(F.col("text")).alias("base"), F.filter(_words(F.col("text")), lambda w: ~w.contains("@")).alias("tokens"))
    found = cut(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first("base").alias("base"), F.first("tokens").alias("tokens")).where("size(base) > 0").withColumn("entities", F.array_distinct("base.entity")))
    marks = told(docs, found, **how).select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "rep", "at")
    one = (h1 == F.col("t1")) & (h2 == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    picked = let(_places(F.col("text"), f"{EMAIL}|{WORD}"), lambda all_: F.transform("at", lambda k: F.get(all_, k)))
    term = F.transform(picked, lambda s: F.struct(s["start"].alias("start"), F.lit(len(PATTERNS)).alias("number"), F.lit("term").alias("kind"), (s["start"] + F.length(s["value"])).alias("end")))
    added = docs.join(F.broadcast(marks) if few(marks, "at", BROADCAST_ROWS) else marks, one).select("t1", "t2", term.alias("terms")).dropDuplicates(["t1", "t2"])
    base = F.transform("base", lambda s: F.struct(s["start"], s["number"], s["kind"], s["end"]))
    both = found.select("h1", "h2", base.alias("base")).join(added, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "full_outer")
    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    both = both.select(F.coalesce("h1", "t1").alias("h1"), F.coalesce("h2", "t2").alias("h2"), F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))
    return both.select("h1", "h2", "base", F.when(F.size("terms") == 0, F.col("base")).otherwise(_merged(F.col("base"), F.col("terms"))).alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with each span generalised to its kind in brackets; of spans that overlap the first names the kind. n_chars, if there, follows."""
    found = spans(docs, **how).select(F.col("h1").alias("__1"), F.col("h2").alias("__2"), F.col("spans").alias("__spans"))
    rows = with_marks(docs, text_key(F.col("text")), found, ["__1", "__2"], "__spans")

    def gap(acc: Column, s: Column) -> tuple[Column, dict[str, Column]]:
        ahead = s["start"] >= acc["at"]
        out = F.when(ahead, F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))).otherwise(F.array().cast("array<struct<from:int,to:int,kind:string>>"))
        return out, {"at": F.greatest(acc["at"], s["end"])}

    length = F.length("text")
    gaps = fold(F.col("__spans"), {"at": F.lit(0)}, "struct<from:int,to:int,kind:string>", gap, lambda acc: F.array(F.struct(acc["at"].alias("from"), length.alias("to"), F.lit(None).cast("string").alias("kind"))))

    def stretch(block: Column) -> Column:
        """The new text of a block of gaps: they are taken from the piece of text that they span, as each look-up reads from its start."""
        first, end = F.get(block, F.lit(0))["from"], F.element_at(block, F.lit(-1))["to"]
        new = lambda piece: F.array_join(F.transform(block, lambda g: F.concat(F.substring(piece, g["from"] - first + 1, g["to"] - g["from"]), F.when(g["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(g["kind"]), F.lit("]"))))), "")
        return let(F.substring("text", first + 1, end - first), new)

    whole = let(gaps, lambda g: F.array_join(F.transform(F.transform(F.sequence(F.lit(1), F.size(g), F.lit(64)), lambda k: F.slice(g, k, 64)), stretch), ""))
    rows = rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(whole))
    return unpacked(rows, docs)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of = cut(spans(docs).select("h1", "h2", *[count(kind) for kind in PATTERNS], F.sha2(_lines(F.col("base")), 256).alias("base_sha256"), _lines(F.col("spans")).alias("spans")))
    rows = docs.select("doc_id", *text_key(F.col("text"))).join(small(of), ["h1", "h2"], "left")
    return rows.select("doc_id", *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in PATTERNS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
