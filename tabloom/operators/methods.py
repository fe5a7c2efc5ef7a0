"""The ways to decide a cell: by score, by row context, by what a model answered, or as not in the knowledge base.

A model's answers are a table, so each method is one plan: asked() tells which cells to ask about, decide() takes the
answers; debate_rounds() are the two questions of the `full` method, whose second depends on the answer to the first. Both see a cell's shortlist only, which is as long as the method's topk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import final_answer, is_nil
from tabloom.operators.assembly import candidate_line
from tabloom.operators.prompts import Round, addressed, block, filled, follow, voted
from tabloom.operators.ranking import CELL, ranked

NIL = "NIL"


@dataclass(frozen=True)
class Method:
    """margin: a smaller lead is uncertain; gate: ask about `uncertain` cells, or `all` with several candidates, or `every` cell."""

    margin: float
    topk: int
    gate: str = "uncertain"
    #: a cell with one candidate is never asked about
    one_is_sure: bool = False
    #: cells may be found to be not in the knowledge base by their score
    by_score: bool = True


METHODS = {"limited": Method(0.05, 5, one_is_sure=True), "context": Method(0.10, 10), "full": Method(0.0, 10, gate="every", by_score=False)}


def shortlists(scored: DataFrame, method: Method) -> DataFrame:
    """(cell, first, score, gap, ids): the first candidate, its score and lead (null: it is alone), and the shortlist by rank; scored can be ranked_cells()."""
    if "of" in scored.columns:
        one, head = F.get("of", F.lit(0)), F.transform(F.slice("of", 1, method.topk), lambda c: c["qid"])
        return scored.where(F.size("of") > 0).select(*CELL, one["qid"].alias("first"), one["score"].alias("score"), one["gap"].alias("gap"), head.alias("ids"))
    rows = ranked(scored).where(F.col("rank") <= method.topk)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "qid"))), lambda s: s["qid"])
    return rows.groupBy(*CELL).agg(first("qid").alias("first"), first("score").alias("score"), first("gap").alias("gap"), ids.alias("ids"))


def asked(method: Method, review: float = 0.0) -> Column:
    """Whether a model is asked, over shortlists(); a score under `review` (0: none) is a reason too."""
    if method.gate == "every":
        return F.lit(True)
    several = F.col("gap").isNotNull()
    gate = several & (F.lit(method.gate == "all") | (F.col("gap") < method.margin))
    doubtful = F.lit(review > 0) & (F.col("score") < review)
    return several & (gate | doubtful) if method.one_is_sure else gate | doubtful


def picked(response: Column, ids: Column, allow_nil: bool, strict: bool = False) -> Column:
    """The first id of the shortlist that the answer contains, else NIL if it says so, else null; strict: only as a whole word, so that Q5 isn't found in Q57."""
    words = F.regexp_extract_all(response, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    found = F.get(F.filter(ids, lambda q: F.array_contains(words, q) if strict else response.contains(q)), F.lit(0))
    return F.coalesce(found, F.when(F.lit(allow_nil) & is_nil(response), F.lit(NIL)))


def decide(cells: DataFrame, scored: DataFrame, answers: DataFrame, method: Method, allow_nil: bool = True, threshold: float = 0.0, review: float = 0.0, switched: DataFrame | None = None) -> DataFrame:
    """(cell, qid, source) of every cell that is decided.

    cells: the cells to decide, each once; answers: cell, response, at most one of each; switched: cell, qid where the row
    context decides, which leaves nothing to ask. source is `none` (no candidate), `context`, `model`, `threshold` or `score`.
    Cells without candidates are left out unless NIL is allowed and the method decides it.
    """
    rows = cells.select(*CELL).join(shortlists(scored, method), CELL, "left").join(answers.select(*CELL, "response"), CELL, "left")
    if switched is not None:
        rows = rows.join(switched.select(*CELL, F.col("qid").alias("by_context")), CELL, "left")
    else:
        rows = rows.withColumn("by_context", F.lit(None).cast("string"))
    nil = allow_nil and method.by_score
    answer = F.when(asked(method, review if allow_nil else 0.0), picked(F.col("response"), F.col("ids"), allow_nil))
    choice = (
        F.when(F.col("first").isNull(), F.when(F.lit(nil), F.struct(F.lit(NIL).alias("qid"), F.lit("none").alias("source"))))
        .when(F.col("by_context").isNotNull() & F.col("gap").isNotNull(), F.struct(F.col("by_context").alias("qid"), F.lit("context").alias("source")))
        .when(answer.isNotNull(), F.struct(answer.alias("qid"), F.lit("model").alias("source")))
        .when(F.lit(nil) & (F.col("score") < threshold), F.struct(F.lit(NIL).alias("qid"), F.lit("threshold").alias("source")))
        .otherwise(F.struct(F.col("first").alias("qid"), F.lit("score").alias("source")))
    )
    return rows.select(*CELL, choice.alias("c")).where("c is not null").select(*CELL, "c.qid", "c.source")


DEBATE = "Cell: ${mention}\n${row}Candidates:\n${candidates}\nName the QID of the best one and give three short reasons."
VERIFY = "Cell: ${mention}\n${row}Chosen: ${chosen}\nAll candidates:\n${candidates}\nDoes the choice fit the cell and its row? Name the winning QID, or NIL if none fits."
CONTEXT = "Cell: ${mention}\n${row}Candidates:\n${candidates}\nThink first, then end with `Answer: <QID>`${nil}."


def questions(scored: DataFrame, method: Method, context: DataFrame | None = None) -> DataFrame:
    """shortlists() with mention, lines, a text with a line for each candidate, and row, the cell's row as a line of text or nothing.

    scored, or ranked_cells() with mention, has label and description, and may have aliases and types, an array of labels; context: tab_id, row_id, context.
    """
    if "of" in scored.columns:
        names = scored.schema["of"].dataType.elementType.names
        line = lambda c: F.concat(F.lit("- "), candidate_line(*[c[n] if n in names else None for n in ("aliases", "types")], of=c))
        text = F.array_join(F.transform(F.slice("of", 1, method.topk), line), "\n")
        one, head = F.get("of", F.lit(0)), F.transform(F.slice("of", 1, method.topk), lambda c: c["qid"])
        both = scored.where(F.size("of") > 0).select(*CELL, one["qid"].alias("first"), one["score"].alias("score"), one["gap"].alias("gap"), head.alias("ids"), "mention", text.alias("lines"))
    else:
        line = candidate_line(*[F.col(c) if c in scored.columns else None for c in ("aliases", "types")])
        rows = ranked(scored).where(F.col("rank") <= method.topk)
        text = rows.groupBy(*CELL).agg(F.max(F.when(F.col("rank") == 1, F.col("mention"))).alias("mention"), F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), line).alias("line")))).alias("of"))
        text = text.select(*CELL, "mention", F.array_join(F.transform("of", lambda r: r["line"]), "\n").alias("lines"))
        both = shortlists(scored, method).join(text, CELL)
    if context is None:
        return both.withColumn("row", F.lit(""))
    return both.join(context.select("tab_id", "row_id", "context"), ["tab_id", "row_id"], "left").withColumn("row", block("Row", F.col("context"))).drop("context")


def debate_rounds(verify: bool = True, templates: tuple[str, str] = (DEBATE, VERIFY)) -> list[Round]:
    """Over questions(): a choice is argued for, then checked. The check may overturn it, or find that none fits, which is null; an answer that names none lets it stand."""
    known = {"mention": F.col("mention"), "row": F.col("row"), "candidates": F.col("lines")}
    named = picked(F.col("response"), F.col("ids"), False)
    rounds = [Round("debate", F.lit(True), filled(templates[0], **known), named)]
    checked = F.when(~F.upper("response").contains("NIL") | F.col("response").isNull(), F.coalesce(named, F.col("debate")))
    return [*rounds, Round("verify", F.col("debate").isNotNull(), filled(templates[1], **known, chosen=F.col("debate")), checked)] if verify else rounds


def decide_by_debate(cells: DataFrame, responses: DataFrame, verify: bool = True) -> DataFrame:
    """(cell, qid, source, debate, verify) of all of questions(): what the last round chose, source `model`, else the first by score, source `score`."""
    rounds = debate_rounds(verify)
    rows = follow(cells, rounds, responses)
    if not verify:
        rows = rows.withColumn("verify", F.lit(None).cast("string"))
    return chosen_by_debate(rows, CELL, rounds[-1].name)


def chosen_by_debate(rows: DataFrame, keys: list[str], last: str) -> DataFrame:
    """(keys, qid, source, debate, verify) of followed rounds, of which `last` decides."""
    chosen = F.col(last)
    return rows.select(*keys, F.coalesce(chosen, "first").alias("qid"), F.when(chosen.isNotNull(), "model").otherwise("score").alias("source"), "debate", "verify")


def context_questions(cells: DataFrame, method: Method, allow_nil: bool = True, review: float = 0.0) -> DataFrame:
    """Of questions() the cells that a model is asked about, addressed with a prompt that asks for thoughts and an answer."""
    cells = cells.where(asked(method, review if allow_nil else 0.0))
    return addressed(cells, context_prompt(allow_nil))


def context_prompt(allow_nil: bool = True) -> Column:
    tail = F.lit(", or `Answer: NIL` if none fits" if allow_nil else "")
    return filled(CONTEXT, mention=F.col("mention"), row=F.col("row"), candidates=F.col("lines"), nil=tail)


def context_votes(items: DataFrame, responses: DataFrame, allow_nil: bool = True) -> DataFrame:
    """(cell, choice, votes) of context_questions(): what most of several answers end in."""
    return voted(items.select(*CELL, "ids", "prompt_hash"), responses, CELL, final_answer(F.col("response"), F.col("ids"), allow_nil))


def votes_of_each(items: DataFrame, keys: list[str], samples: int, model: Callable[[Column, Column], Column], allow_nil: bool = True) -> DataFrame:
    """(keys, choice, votes): context_votes() of addressed items with different prompts, where the model is a function of a prompt's text and a sample: counted in the row."""
    choice = lambda r: final_answer(r, F.col("ids"), allow_nil)
    said = items.select(*keys, "ids", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: model(F.col("prompt"), s)).alias("said"))
    chosen = said.select(*keys, F.transform("said", choice).alias("chosen"))
    one = lambda c: F.struct(F.size(F.filter("chosen", lambda x: x == c)).cast("long").alias("votes"), (-F.array_position("chosen", c)).alias("early"), c.alias("choice"))
    best = F.array_max(F.transform(F.array_distinct(F.array_compact("chosen")), one))
    # outer, and filtered after it, as Spark else asks once more to leave out items without votes
    return chosen.select(*keys, F.inline_outer(F.array(best))).where("choice is not null").select(*keys, "choice", "votes")


def vote(samples: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, term, votes, rank): the terms that most of several answers to one question suggest, from (keys, sample, pos, term).

    A sample votes once for a term, in whatever case it is written; the form seen first is given, and of equal votes the term seen first leads.
    """
    seen = F.struct("sample", "pos")
    votes = samples.where("term is not null").groupBy(*keys, F.lower("term").alias("__folded")).agg(F.count_distinct("sample").alias("votes"), F.min(seen).alias("__first"), F.min_by("term", seen).alias("term"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "__first"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "term", "votes", "rank")
