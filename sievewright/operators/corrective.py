"""Bounded corrective answering of many queries.

Queries move through rounds together: retrieve, grade, rewrite what found too little; then answer, verify, and answer
anew what isn't grounded. Both loops are bounded by the settings' budgets, and a limit of steps a query stands behind
them. Each round works on the queries that are still open only, and its state is checkpointed, so plans don't grow with
the rounds.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from . import answer as A
from . import verify as V


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the folder that spark.checkpoint.dir names; on one machine a temporary one will do."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def route_after_grade(n_relevant: Column, n_rewrites: Column, s: Settings) -> Column:
    return F.when((n_relevant >= s.min_relevant_docs) | (n_rewrites >= s.max_query_rewrites), F.lit("generate")).otherwise("rewrite_query")


def route_after_verify(n_citations: Column, rate: Column, n_regenerations: Column, s: Settings) -> Column:
    """No citations is an honest abstention, whatever the rate; it is told apart first."""
    return (
        F.when(n_citations == 0, F.lit("accept_abstained"))
        .when(rate >= s.min_attribution_rate, F.lit("accept_grounded"))
        .when(n_regenerations < s.max_regenerations, F.lit("regenerate"))
        .otherwise("exhaust_regenerate")
    )


REASONS = {"accept_abstained": "abstained", "accept_grounded": "grounded", "exhaust_regenerate": "regenerate_budget_exhausted"}


def extra_calls(n_rewrites: Column, n_regenerations: Column) -> Column:
    return 2 * n_rewrites + n_regenerations + 1


def steps(n_rewrites: Column, n_regenerations: Column) -> Column:
    """Steps that a query has taken once its answer is verified: retrieve, grade and rewrite, then answer and verify."""
    return 3 * n_rewrites + 3 * n_regenerations + 4


def run(
    queries: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    settings: Settings,
    *,
    generate: Callable[[DataFrame], DataFrame] = A.offline,
    grade: Callable[[DataFrame], DataFrame] = A.grades,
    rewrite: Callable[[DataFrame], DataFrame] = A.rewritten,
    ascii_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """One row per query: answer, citations, contexts, the report's figures, the counters and why it ended.

    limit: steps that a query may take, the settings' if not given. Queries that would pass it end as they are, without
    an answer if they have none. retrieve takes rows (query_id, query) and returns ranked passages with query_id, chunk_id, rank, text, rel_path,
    heading_path.
    """
    limit = settings.recursion_limit if limit is None else limit
    passage = F.struct("rank", "chunk_id", "rel_path", "heading_path", "text")
    none = F.array().cast("array<struct<rank:int,chunk_id:string,rel_path:string,heading_path:array<string>,text:string>>")
    state = queries.select("query_id", "query", F.col("query").alias("current_query"), F.lit(0).alias("n_rewrites"))
    finished: list[DataFrame] = []
    for _ in range(settings.max_query_rewrites + 1):
        found = cut(retrieve(state.select("query_id", F.col("current_query").alias("query"))))  # it is read twice
        found = found.drop("query").join(state.select("query_id", F.col("current_query").alias("query")), "query_id")
        graded = found.join(grade(found).select("query_id", "chunk_id", "relevant"), ["query_id", "chunk_id"], "left")
        keep = F.coalesce("relevant", F.lit(True))
        lists = graded.groupBy("query_id").agg(
            F.sort_array(F.collect_list(passage)).alias("retrieved"), F.sort_array(F.collect_list(F.when(keep, passage))).alias("relevant")
        )
        state = state.join(lists, "query_id", "left").withColumns({c: F.coalesce(c, none) for c in ("retrieved", "relevant")})
        n = F.size("relevant")
        state = cut(state.withColumn("route", route_after_grade(n, F.col("n_rewrites"), settings)))
        finished.append(state.filter("route = 'generate'"))
        state = state.filter("route = 'rewrite_query'")
        beyond = steps(F.col("n_rewrites") + 1, F.lit(0)) > limit
        finished.append(state.filter(beyond))
        state = state.filter(~beyond)
        if state.isEmpty():
            break
        # A live client may put a query differently each time it is asked.
        asked = cut(rewrite(state.select("query_id", "current_query", F.col("retrieved").alias("contexts"))))
        state = state.select("query_id", "query", "n_rewrites").join(asked, "query_id")
        state = state.select("query_id", "query", F.col("new_query").alias("current_query"), (F.col("n_rewrites") + 1).alias("n_rewrites"))
    ready = finished[0]
    for part in finished[1:]:
        ready = ready.unionByName(part)
    state = ready.select(
        "query_id",
        "query",
        F.col("current_query").alias("final_query"),
        "n_rewrites",
        ((F.size("relevant") < settings.min_relevant_docs) & (F.col("n_rewrites") >= settings.max_query_rewrites)).alias("rewrite_budget_exhausted"),
        F.when(F.size("relevant") > 0, F.col("relevant")).otherwise(F.col("retrieved")).alias("contexts"),
        F.lit(0).alias("n_regenerations"),
        ((F.col("route") == "rewrite_query") | (steps(F.col("n_rewrites"), F.lit(0)) > limit)).alias("stopped"),
    )
    nothing = {"answer": F.lit(""), "citations": F.array().cast(A.CITATIONS), "n_citations": F.lit(0).cast("long"), "n_grounded": F.lit(0).cast("long"), "attribution_rate": F.lit(0.0)}
    nothing |= {"unsupported": F.array().cast("array<string>"), "route": F.lit("stopped")}
    done = [state.filter("stopped").drop("stopped").withColumns(nothing)]
    state = state.filter("not stopped").drop("stopped")
    for _ in range(settings.max_regenerations + 1):
        # A live client may answer differently each time, so the answers are kept before anything is read off them.
        answered = cut(generate(state))
        reports = V.report(answered, V.checks(answered, ascii_only))
        route = route_after_verify(F.col("n_citations"), F.col("attribution_rate"), F.col("n_regenerations"), settings)
        route = F.when((route == "regenerate") & (steps(F.col("n_rewrites"), F.col("n_regenerations") + 1) > limit), "stopped").otherwise(route)
        judged = cut(answered.join(reports, "query_id").withColumn("route", route))
        done.append(judged.filter("route <> 'regenerate'"))
        state = judged.filter("route = 'regenerate'").drop("answer", "citations", "route", "n_citations", "n_grounded", "attribution_rate", "unsupported")
        if state.isEmpty():
            break
        state = state.withColumn("n_regenerations", F.col("n_regenerations") + 1)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    reason = F.lit("recursion_limit")
    for name, value in REASONS.items():
        reason = F.when(F.col("route") == name, F.lit(value)).otherwise(reason)
    return out.withColumn("terminated_reason", reason).drop("route")


def trace(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {
            "activated": (F.col("n_rewrites") > 0) | (F.col("n_regenerations") > 0),
            "final_query_changed": F.col("final_query") != F.col("query"),
            "extra_llm_calls": extra_calls(F.col("n_rewrites"), F.col("n_regenerations")),
        }
    )


def once(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame] = A.offline, ascii_only: bool = False) -> DataFrame:
    """The plain arm: retrieve, answer, verify, once each."""
    found = A.contexts(retrieve(queries.select("query_id", "query")))
    none = F.array().cast(found.schema["contexts"].dataType)
    rows = queries.select("query_id", "query").join(found, "query_id", "left").withColumn("contexts", F.coalesce("contexts", none))
    answered = cut(generate(rows))
    return answered.join(V.report(answered, V.checks(answered, ascii_only)), "query_id")
