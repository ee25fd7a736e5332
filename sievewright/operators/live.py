"""Live models: an embedder and the prompts that a language model answers. Each model is made once a worker.

Offline functions elsewhere stand in for all of them; what is here takes `make`, a function that makes the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index

QUESTION, PASSAGE, ANSWER, STATEMENT = (f"\n\n{name}:\n" for name in ("Question", "Passage", "Answer", "Statement"))
YES_OR_NO = "\n\nReply with yes or no only."
ONE_A_LINE = "\n\nReply with one on each line and nothing else."


def model_embedding(text: Column, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Unit vectors by a model that takes texts and returns vectors. Null text is empty text; a zero vector stays."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            vectors = model(["" if t is None else t for t in texts])
            sizes = [sum(x * x for x in v) ** 0.5 or 1.0 for v in vectors]
            yield pd.Series([[float(x) / n for x in v] for v, n in zip(vectors, sizes, strict=True)])

    return embed(text)


def embedding(text: Column, name: str, dim: int, makers: dict[str, Callable] | None = None) -> Column:
    """By the embedder of this name: "hashing", or one of makers. Another name is an error, so that what is recorded of an
    index is what made it."""
    if name == "hashing":
        return index.hashed_embedding(text, dim)
    if not makers or name not in makers:
        raise ValueError(f"no embedder {name!r}; there is 'hashing', and what is passed as makers")
    return model_embedding(text, makers[name])


def ask(prompt: Column, make: Callable[[], Callable[[str], str]]) -> Column:
    """What a language model replies."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            yield pd.Series([model(p) for p in prompts], dtype=object)

    return reply(prompt)


def said(*parts: Column) -> Column:
    """The parts after each other; null is empty."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def grade_prompt(query: Column, passage: Column) -> Column:
    return said(F.lit("Does the passage help to answer the question?"), F.lit(QUESTION), query, F.lit(PASSAGE), passage, F.lit(YES_OR_NO))


def rewrite_prompt(query: Column) -> Column:
    return said(F.lit("Put this question so that a search finds better passages. Keep its meaning, and reply with the new question only."), F.lit(QUESTION), query)


def judge_prompt(query: Column, reference: Column, answer: Column) -> Column:
    return said(
        F.lit("Does the answer say the same as the reference, as far as the question asks?"), F.lit(QUESTION), query, F.lit("\n\nReference:\n"), reference, F.lit(ANSWER), answer, F.lit(YES_OR_NO)
    )


def decompose_prompt(query: Column, answer: Column) -> Column:
    return said(F.lit("Split the answer into statements that can each be checked alone."), F.lit(QUESTION), query, F.lit(ANSWER), answer, F.lit(ONE_A_LINE))


def verify_prompt(statement: Column, context: Column) -> Column:
    return said(F.lit("Does the statement follow from the passage alone?"), F.lit(PASSAGE), context, F.lit(STATEMENT), statement, F.lit(YES_OR_NO))


def question_prompt(answer: Column, n: int) -> Column:
    return said(F.lit(f"Write {n} questions that this answer would be an answer to. If it avoids an answer, reply with the word noncommittal."), F.lit(ANSWER), answer, F.lit(ONE_A_LINE))


def is_yes(reply: Column) -> Column:
    """Whether the first word is yes; a null or empty reply isn't."""
    return F.coalesce(F.lower(F.trim(reply)).rlike(r"^yes\b"), F.lit(False))


def lines(reply: Column) -> Column:
    """Lines that aren't empty, without bullets or numbers in front."""
    bare = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.filter(bare, lambda x: x != "")


def graded(rows: DataFrame, make: Callable) -> DataFrame:
    """query, text with relevant."""
    return rows.withColumn("relevant", is_yes(ask(grade_prompt(F.col("query"), F.col("text")), make)))


def rewritten(rows: DataFrame, make: Callable) -> DataFrame:
    """query with the model's; an empty reply leaves it as it was."""
    new = F.trim(ask(rewrite_prompt(F.col("query")), make))
    return rows.withColumn("_new", new).withColumn("query", F.when(F.coalesce("_new", F.lit("")) != "", F.col("_new")).otherwise(F.col("query"))).drop("_new")


def judged(rows: DataFrame, make: Callable) -> DataFrame:
    """query, reference_answer, answer with correct."""
    return rows.withColumn("correct", is_yes(ask(judge_prompt(F.col("query"), F.col("reference_answer"), F.col("answer")), make)))


def faithfulness(rows: DataFrame, make: Callable) -> DataFrame:
    """query_id, n_statements, n_supported, faithfulness: the model splits answers and checks each statement against the
    context. rows: query_id, query, answer, context. An answer without statements abstains, with faithfulness 0."""
    split = rows.select("query_id", "context", lines(ask(decompose_prompt(F.col("query"), F.col("answer")), make)).alias("found"))
    each = split.select("query_id", "context", F.explode_outer("found").alias("statement"))
    told = each.withColumn("ok", F.when(F.col("statement").isNotNull(), is_yes(ask(verify_prompt(F.coalesce("statement", F.lit("")), F.col("context")), make))))
    sums = told.groupBy("query_id").agg(F.count("statement").alias("n_statements"), F.count_if("ok").alias("n_supported"))
    return sums.withColumn("faithfulness", F.when(F.col("n_statements") > 0, F.col("n_supported") / F.col("n_statements")).otherwise(0.0))


def questions(rows: DataFrame, n: int, make: Callable) -> DataFrame:
    """query_id, questions (n at most), noncommittal. rows: query_id, answer."""
    out = rows.withColumn("_r", ask(question_prompt(F.col("answer"), n), make))
    avoids = F.lower(F.trim(F.coalesce("_r", F.lit("")))).rlike(r"^noncommittal\W*$")
    return out.select("query_id", F.when(avoids, F.array().cast("array<string>")).otherwise(F.slice(lines(F.col("_r")), 1, n)).alias("questions"), avoids.alias("noncommittal"))
