"""Prompts as a table: each different text is asked once, under its hash, and its answers go to all items that asked.

items are any rows; a null prompt asks nothing. responses: prompt_hash, sample, response, at most one row of each hash and
sample. Items without an answer get a null one; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import render

PROMPTS = "prompt_hash string, sample int, text string"
RESPONSES = "prompt_hash string, sample int, response string"


def addressed(items: DataFrame, text: Column) -> DataFrame:
    """items with prompt and prompt_hash."""
    return items.withColumn("prompt", text).withColumn("prompt_hash", F.sha2("prompt", 256))


def prompt_table(*frames: DataFrame, samples: int = 1) -> DataFrame:
    """(prompt_hash, sample, text) of all different prompts of addressed() items, once for each sample from 0."""
    rows = reduce(DataFrame.union, [f.select("prompt_hash", "prompt") for f in frames]).where("prompt_hash is not null")
    each = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    return rows.groupBy("prompt_hash").agg(F.first("prompt").alias("text")).select("prompt_hash", each, "text")


def unanswered(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """The prompts that still have to be asked."""
    return prompts.join(responses.select("prompt_hash", "sample"), ["prompt_hash", "sample"], "left_anti")


def answered(items: DataFrame, responses: DataFrame, sample: int = 0) -> DataFrame:
    """items with the response of one sample."""
    return items.join(responses.where(F.col("sample") == sample).select("prompt_hash", "response"), "prompt_hash", "left")


def voted(items: DataFrame, responses: DataFrame, keys: list[str], choice: Column) -> DataFrame:
    """(keys, choice, votes): what most samples choose, over the columns of items and `response`; of equal votes the one chosen first.

    Samples whose choice is null have no vote; an item without votes is left out.
    """
    each = items.join(responses, "prompt_hash").withColumn("choice", choice).where("choice is not null")
    votes = each.groupBy(*keys, "choice").agg(F.count(F.lit(1)).alias("votes"), F.min("sample").alias("at"))
    best = F.max(F.struct("votes", (-F.col("at")).alias("early"), "choice"))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.choice", "b.votes")


@dataclass(frozen=True)
class Round:
    """One question in a row of them. asked and prompt see the items and what earlier rounds chose, by their names; choice also `response`."""

    name: str
    asked: Column
    prompt: Column
    choice: Column


def follow(items: DataFrame, rounds: list[Round], responses: DataFrame) -> DataFrame:
    """items with, for each round, <name>_hash, <name>_response and <name>, the choice; null where the round wasn't asked.

    A prompt of a later round is made of the choices of earlier ones, so its answer is found only under the right choice.
    """
    rows = items
    for r in rounds:
        asked = addressed(rows, F.when(r.asked, r.prompt))
        names = {"prompt_hash": f"{r.name}_hash", "response": f"{r.name}_response"}
        rows = answered(asked, responses).withColumn(r.name, F.when(F.col("prompt_hash").isNotNull(), r.choice)).drop("prompt").withColumnsRenamed(names)
    return rows


def converse(items: DataFrame, rounds: list[Round], model: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """(prompt_hash, sample, response) of all that the rounds ask: each round's new prompts go to the model when the rounds before it are answered.

    model: a function of PROMPTS to RESPONSES, such as mapInPandas with a model loaded once a task; keep: writes a table
    and reads it again, so that nothing is asked twice; known: answers of earlier runs, which aren't asked again.
    """
    spark = items.sparkSession
    answers = known if known is not None else spark.createDataFrame([], RESPONSES)
    for k, r in enumerate(rounds):
        asked = addressed(follow(items, rounds[:k], answers), F.when(r.asked, r.prompt))
        answers = answers.unionByName(keep(model(unanswered(prompt_table(asked), answers))))
    return answers


def ask_each(items: DataFrame, rounds: list[Round], model: Callable[[Column], Column]) -> DataFrame:
    """items with each round's choice by its name, where the model is a function of a prompt's text: each item is asked in its row, and no text is shuffled.

    Items should have different prompts, as those of once_each() do; see follow() for a model that takes a table.
    """
    rows = items
    for r in rounds:
        rows = rows.withColumn("prompt", F.when(r.asked, r.prompt)).withColumn("response", F.when(F.col("prompt").isNotNull(), model(F.col("prompt"))))
        rows = rows.withColumn(r.name, F.when(F.col("prompt").isNotNull(), r.choice)).drop("prompt", "response")
    return rows


def once_each(items: DataFrame, by: list[str], keep: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keep, and what made() gives but `by`) of each item: made() gets the different values of `by`, what a prompt is made of, none of it null, and gives each with what was found, once.

    So texts are made and asked once for all items that ask alike; items are shuffled once, with `by`, which should be short.
    """
    n = max(items.sparkSession.sparkContext.defaultParallelism, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.select(*keep, *by).repartition(n, *by)
    return dealt.join(made(dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).drop("__n")), by).drop(*by)


def block(label: str, value: Column) -> Column:
    """A line `label: value`, or nothing where there is no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise("")


def filled(template: str, **values: Column) -> Column:
    return render(template, **values)
