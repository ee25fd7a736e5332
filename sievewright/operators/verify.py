"""Whether the quotes of answers stand in the passages they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def checks(answers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """query_id, pos, chunk_id, grounded, method, reason of each citation. answers: query_id, citations, contexts.

    A citation of a passage that isn't among the answer's contexts is kept, as ungrounded. With ascii_only the texts
    are normalized in the JVM.
    """
    cited = answers.select("query_id", "contexts", F.posexplode("citations").alias("pos", "c"))
    passage = F.try_element_at(F.filter("contexts", lambda p: p["chunk_id"] == F.col("c.chunk_id")), F.lit(-1))
    quote = F.coalesce("c.supporting_quote", F.lit(""))
    rows = cited.select("query_id", "pos", F.col("c.chunk_id").alias("chunk_id"), quote.alias("quote"), passage["text"].alias("chunk"))
    return verdicts(rows, ascii_only).select("query_id", "pos", "chunk_id", "verdict.*")


def verdicts(rows: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Adds verdict (grounded, method, reason) to rows with quote and chunk (null: not in the context)."""
    normal = T.normalize_ascii if ascii_only else T.normalize
    rows = rows.withColumns({"_nq": normal(F.col("quote")), "_nc": normal(F.col("chunk"))})
    # Normalizing changes white space only after folding, so it leaves the words as they are; lists of words stay in the JVM.
    rows = rows.withColumns({"_tq": T.tokens(F.col("_nq")), "_tc": T.tokens(F.col("_nc"))})
    cols = [F.col(c) for c in ("quote", "chunk", "_nq", "_nc", "_tq", "_tc")]
    return rows.withColumn("verdict", T.grounding(*cols)).drop("_nq", "_nc", "_tq", "_tc")


def tally(checked: DataFrame) -> DataFrame:
    """query_id, n_citations, n_grounded, attribution_rate, unsupported ids in order, of answers with citations."""
    sums = checked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_citations"),
        F.count_if("grounded").alias("n_grounded"),
        F.sort_array(F.collect_list(F.when(~F.col("grounded"), F.struct("pos", "chunk_id")))).alias("_u"),
    )
    rate = F.col("n_grounded").cast("double") / F.col("n_citations")
    return sums.select("query_id", "n_citations", "n_grounded", rate.alias("attribution_rate"), F.transform("_u", lambda x: x["chunk_id"]).alias("unsupported"))


def report(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """tally() of all answers; the rate is 0 without citations."""
    none = {"n_citations": F.lit(0), "n_grounded": F.lit(0), "attribution_rate": F.lit(0.0), "unsupported": F.array().cast("array<string>")}
    return answers.select("query_id").join(tally(checked), "query_id", "left").select("query_id", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def rollup(reports: DataFrame) -> DataFrame:
    """One row: the pooled rate, the mean over queries, the mean over those with citations, and how many had none."""
    rate, some = F.col("attribution_rate"), F.col("n_citations") > 0
    return reports.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.sum("n_citations"), F.lit(0)).alias("n_citations"),
        F.coalesce(F.sum("n_grounded"), F.lit(0)).alias("n_grounded"),
        F.coalesce(F.try_divide(F.sum("n_grounded").cast("double"), F.sum("n_citations")), F.lit(0.0)).alias("micro"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("macro"),
        F.coalesce(F.avg(F.when(some, rate)), F.lit(0.0)).alias("macro_answered"),
        F.count_if(~some).alias("n_abstained"),
    )
