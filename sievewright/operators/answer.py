"""Prompts and answers. Live models are plugged in; the offline ones are columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The prompt's wording, the offline answers, and the length of their quotes.
PREAMBLE = (
    "You are a careful retrieval-augmented assistant. Answer the user's question using "
    "ONLY the provided context passages below. Follow these rules exactly:\n"
    "1. If the context does not contain the answer, say so explicitly and do not guess.\n"
    "2. For every claim you make, cite the passage it comes from by its chunk_id, and "
    "include the exact supporting quote copied verbatim from that passage's text.\n"
    "3. Cite ONLY the chunk_ids listed below. Never invent or guess a chunk_id.\n"
    "4. You may add inline markers like [1] in your answer text that correspond to the "
    "numbered passages, but the authoritative attribution is the chunk_id on each citation."
)
NO_ANSWER = "The provided context does not contain an answer to this question."
FABRICATED = "zzqxv totally fabricated unsupported claim wzzqxv"
QUOTE = 60
CITATIONS = "array<struct<chunk_id:string,rel_path:string,supporting_quote:string>>"


def contexts(results: DataFrame) -> DataFrame:
    """query_id, contexts: the ranked passages of a query as one array. Their number is bounded by the ranking's k."""
    passage = F.struct("rank", "chunk_id", "rel_path", "heading_path", "text")
    return results.groupBy("query_id").agg(F.sort_array(F.collect_list(passage)).alias("contexts"))


def prompt(query: Column, passages: Column) -> Column:
    def block(p: Column, i: Column) -> Column:
        heading = F.when(F.size(p["heading_path"]) > 0, F.concat(F.lit(" heading="), F.array_join(p["heading_path"], " > "))).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] chunk_id="), p["chunk_id"], F.lit(" rel_path="), p["rel_path"], heading, F.lit("\n"), p["text"])

    shown = F.when(F.size(passages) > 0, F.array_join(F.transform(passages, block), "\n\n")).otherwise("(none provided)")
    return F.concat(
        F.lit(f"{PREAMBLE}\n\nContext passages:\n\n"), shown, F.lit("\n\nQuestion: "), query, F.lit("\n\nProduce a grounded, cited answer now.")
    )


def offline(rows: DataFrame, fabricate: bool = False) -> DataFrame:
    """Adds answer and citations to rows (query_id, query, contexts): a quote from the first passage, or a made-up one."""
    top = F.element_at("contexts", 1)
    quote = F.lit(FABRICATED) if fabricate else F.substring(top["text"], 1, QUOTE)
    cited = F.array(F.struct(top["chunk_id"].alias("chunk_id"), top["rel_path"].alias("rel_path"), quote.alias("supporting_quote")))
    some = F.size("contexts") > 0
    return rows.withColumns(
        {
            "answer": F.when(some, F.concat(F.lit("Based on [1] ("), top["chunk_id"], F.lit("): "), quote)).otherwise(NO_ANSWER),
            "citations": F.when(some, cited).otherwise(F.array().cast(CITATIONS)),
        }
    )


def with_client(rows: DataFrame, make: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """The same with a live client: make() builds it once a worker; it takes a prompt and returns text and citations."""

    @F.pandas_udf(f"struct<text:string,citations:{CITATIONS}>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for prompts in batches:
            yield pd.DataFrame([client(p) for p in prompts], columns=["text", "citations"])

    asked = rows.withColumn("_a", ask(prompt(F.col("query"), F.col("contexts"))))
    return asked.withColumns({"answer": F.col("_a.text"), "citations": F.col("_a.citations")}).drop("_a")


def events(answers: DataFrame) -> DataFrame:
    """query_id, seq, event, data: the three events of a streamed answer."""
    parts = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("meta").alias("event"), F.to_json(F.struct("query_id")).alias("data")),
        F.struct(F.lit(1).alias("seq"), F.lit("answer").alias("event"), F.to_json(F.struct("answer", "citations")).alias("data")),
        F.struct(F.lit(2).alias("seq"), F.lit("done").alias("event"), F.lit("{}").alias("data")),
    )
    return answers.select("query_id", F.explode(parts).alias("e")).select("query_id", "e.*")


def rewritten(rows: DataFrame) -> DataFrame:
    """query_id, new_query: the query and the commonest word of its contexts that it lacks.

    rows: query_id, current_query, contexts. Ties go to the word that is last when read backwards; a query whose
    contexts have nothing new stays.
    """
    from ..functions import text as T

    words = rows.select("query_id", "current_query", F.explode_outer(F.transform("contexts", lambda c: c["text"])).alias("text"))
    words = words.select("query_id", "current_query", F.explode_outer(T.tokens(F.coalesce("text", F.lit("")))).alias("t"))
    new = F.col("t").isNotNull() & ~F.array_contains(T.tokens(F.col("current_query")), F.coalesce("t", F.lit("")))
    counts = words.groupBy("query_id", "current_query", "t").agg(F.sum(F.when(new, 1).otherwise(0)).alias("n"))
    best = counts.groupBy("query_id", "current_query").agg(F.max_by(F.when(F.col("n") > 0, F.col("t")), F.struct("n", F.reverse("t"))).alias("best"))
    return best.select("query_id", F.when(F.col("best").isNull(), F.col("current_query")).otherwise(F.concat_ws(" ", "current_query", "best")).alias("new_query"))


def grades(results: DataFrame) -> DataFrame:
    """query_id, chunk_id, relevant, reason: whether a passage shares a word with the query."""
    from ..functions import text as T

    n = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("query"))), T.tokens(F.col("text"))))
    return results.select("query_id", "chunk_id", (n >= 1).alias("relevant"), F.concat(F.lit("lexical overlap with query = "), n.cast("string")).alias("reason"))


def keep_relevant(results: DataFrame, graded: DataFrame) -> DataFrame:
    """Passages graded irrelevant go; those without a grade stay."""
    return results.join(graded.select("query_id", "chunk_id", "relevant"), ["query_id", "chunk_id"], "left").filter(F.coalesce("relevant", F.lit(True))).drop("relevant")


def first_per(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_r = 1").drop("_r")
