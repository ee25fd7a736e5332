"""Retrieval metrics, paired bootstrap, and the reports built on them."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterable
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CUTOFFS = (1, 3, 5, 10)
PAIRS = (("dense", "hybrid"), ("sparse", "hybrid"), ("hybrid", "hybrid_rerank"), ("dense", "hybrid_rerank"))
METRICS = (("ndcg", 10), ("recall", 5))
#: Places that resampling holds at once.
PLACES = 4_000_000


class GuardError(ValueError):
    """An evaluation would not mean what it says."""


class LeakageError(GuardError):
    """Labels could be indexed, or a private corpus scored."""


class CoverageError(GuardError):
    """Labels name what isn't indexed."""


def dedup_ranking(ranking: DataFrame, key: str = "chunk_id", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A repeated id keeps its best place, and those behind move up."""
    best = ranking.groupBy(*by, key).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank", key)))


def metrics(ranking: DataFrame, qrels: DataFrame, cutoffs: Iterable[int] = CUTOFFS, key: str = "chunk_id") -> DataFrame:
    """config, query_id, k, recall, ndcg, rr for every labelled query, also those that found nothing.

    ranking: config, query_id, key, rank; qrels: query_id, key. rr is over the whole ranking, at any k.
    """
    cutoffs = sorted(set(cutoffs))
    if not cutoffs or cutoffs[0] <= 0:
        raise ValueError(f"cutoffs must be positive, got {cutoffs}")
    spark = ranking.sparkSession
    labels = qrels.select("query_id", key).distinct()
    wanted = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = dedup_ranking(ranking, key, ("config", "query_id")).join(labels, ["query_id", key]).select("config", "query_id", "rank")
    configs = ranking.select("config").distinct()
    grid = wanted.crossJoin(F.broadcast(configs.crossJoin(spark.createDataFrame([(k,) for k in cutoffs], "k int"))))
    per = hits.groupBy("config", "query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    rows = grid.join(per, ["config", "query_id"], "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    top = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = F.aggregate(top, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.col("k").cast("long")).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return rows.select(
        "config",
        "query_id",
        "k",
        (F.size(top).cast("double") / F.col("n_rel")).alias("recall"),
        (gain / ideal).alias("ndcg"),
        F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0)).alias("rr"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("config", "k").agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def mrr(values: DataFrame, column: str = "rr") -> float:
    r = values.agg(F.avg(column).alias("m"), F.count_if(F.isnan(column) | (F.abs(column) == float("inf"))).alias("bad")).first()
    if r["bad"]:
        raise ValueError("reciprocal ranks must be finite")
    return r["m"] or 0.0


def paired_bootstrap(baseline, treatment, *, n_resamples: int = 10_000, seed: int = 12345, ci: float = 0.95) -> dict:
    """Percentile interval of the difference of means; one matrix of resampled places serves both arms."""
    a, b = np.asarray(baseline, float), np.asarray(treatment, float)
    if a.ndim != 1 or b.ndim != 1 or not a.size or a.size != b.size:
        raise ValueError(f"both arms must be vectors of one length, not empty; got {a.shape} and {b.shape}")
    if a.size < 2:
        raise ValueError("a paired bootstrap takes two pairs at least")
    if n_resamples < 1000:
        raise ValueError(f"at least 1000 resamples are needed, got {n_resamples}")
    if not 0 < ci < 1:
        raise ValueError(f"the level must lie between 0 and 1, got {ci}")
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("values must be finite")
    # Portions of the resamples are drawn one after the other, which gives the same numbers as all at once.
    rng, rows, spread = np.random.default_rng(seed), max(1, PLACES // a.size), np.empty(n_resamples)
    for at in range(0, n_resamples, rows):
        places = rng.integers(0, a.size, size=(min(rows, n_resamples - at), a.size))
        spread[at : at + rows] = b[places].mean(axis=1) - a[places].mean(axis=1)
    tail = 100 * (1 - ci) / 2
    low, high = np.percentile(spread, [tail, 100 - tail]).tolist()
    return {
        "baseline_mean": float(a.mean()), "treatment_mean": float(b.mean()), "diff": float(b.mean() - a.mean()), "ci_low": low, "ci_high": high,
        "ci_level": ci, "n_resamples": n_resamples, "seed": seed, "n_queries": int(a.size), "significant": not low <= 0 <= high,
    }


COMPARISON = (
    "baseline string, treatment string, metric string, baseline_mean double, treatment_mean double, diff double, ci_low double, ci_high double, "
    "ci_level double, n_resamples int, seed int, n_queries int, significant boolean"
)


def comparisons(per_query: DataFrame, pairs=PAIRS, wanted=METRICS, *, n_resamples: int = 10_000, seed: int = 12345, ci: float = 0.95, order: str = "query_id") -> DataFrame:
    """One row for each pair of configs and metric; each is resampled in a task of its own."""
    spark = per_query.sparkSession
    tall = None
    for name, k in wanted:
        part = per_query.filter(F.col("k") == k).select("config", order, F.lit(f"{name}@{k}").alias("metric"), F.col(name).alias("value"))
        tall = part if tall is None else tall.unionByName(part)
    table = F.broadcast(spark.createDataFrame(list(pairs), "baseline string, treatment string"))
    left = tall.withColumnRenamed("config", "baseline").withColumnRenamed("value", "b").join(table, "baseline")
    both = left.join(tall.withColumnRenamed("config", "treatment").withColumnRenamed("value", "t"), ["treatment", order, "metric"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        found = paired_bootstrap(group["b"], group["t"], n_resamples=n_resamples, seed=seed, ci=ci)
        return pd.DataFrame([{"baseline": group["baseline"].iat[0], "treatment": group["treatment"].iat[0], "metric": group["metric"].iat[0], **found}])

    return both.select("baseline", "treatment", "metric", order, "b", "t").groupBy("baseline", "treatment", "metric").applyInPandas(one, COMPARISON)


# Guards


def missing_labels(qrels: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return qrels.select(key).distinct().join(chunks.select(key), key, "left_anti")


def check_coverage(qrels: DataFrame, chunks: DataFrame, key: str = "chunk_id", shown: int = 20) -> None:
    lost = [r[0] for r in missing_labels(qrels, chunks, key).orderBy(key).limit(shown).collect()]
    if lost:
        raise CoverageError(f"labels name what isn't indexed: {lost}")


def plain_path(path: str) -> PurePosixPath:
    """Without links and detours where it is on this machine."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return PurePosixPath(path if "://" in local else os.path.realpath(local))


def check_outside(golden: str, corpus: str) -> None:
    if plain_path(golden).is_relative_to(plain_path(corpus)):
        raise LeakageError(f"labels at {golden} lie under the corpus {corpus}")


def check_public(corpus: str, private: str) -> None:
    if plain_path(corpus) == plain_path(private):
        raise LeakageError(f"{corpus} is the private corpus")


def publishable(*offline: bool) -> bool:
    """Whether no part of a run was an offline stand-in."""
    return not any(offline)


# Quality of answers


def faithfulness(answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query_id, n_statements, n_supported, faithfulness. answers: query_id, answer, context (the passages joined)."""
    own = answers.select("query_id", F.explode_outer(T.statements(F.col("answer"))).alias("s"), T.tokens(F.col("context")).alias("c"))
    good = F.col("s").isNotNull() & (T.overlap_fraction(F.col("s"), F.col("c")) >= threshold)
    sums = own.groupBy("query_id").agg(F.count("s").alias("n_statements"), F.count_if(good).alias("n_supported"))
    return sums.withColumn("faithfulness", T.faithfulness(F.col("n_supported"), F.col("n_statements")))


def relevancy(answers: DataFrame, n: int = 3, dim: int = 256, questions: DataFrame | None = None, embedded: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, relevancy, noncommittal, n_questions: mean cosine of the query and questions that its answer would answer.

    questions: query_id, questions, noncommittal as a model gives them; without them they are templated from the answer.
    embedded: the vector of a text, by feature hashing if not given.
    """
    from .index import hashed_embedding

    vector = embedded or (lambda text: hashed_embedding(text, dim))
    if questions is None:
        rows = answers.select("query_id", "query", T.noncommittal(F.col("answer")).alias("noncommittal"), T.templated_questions(F.col("answer"), n).alias("q"))
    else:
        rows = answers.select("query_id", "query").join(questions.select("query_id", "noncommittal", F.col("questions").alias("q")), "query_id")
    rows = rows.withColumn("q", F.when(F.col("noncommittal"), F.array().cast("array<string>")).otherwise(F.col("q"))).withColumn("v", vector(F.col("query")))
    asked = rows.select("query_id", "v", F.explode("q").alias("q")).select("query_id", T.cosine(F.col("v"), vector(F.col("q"))).alias("c"))
    means = asked.groupBy("query_id").agg(F.avg("c").alias("c"))
    return rows.join(means, "query_id", "left").select("query_id", F.coalesce("c", F.lit(0.0)).alias("relevancy"), "noncommittal", F.size("q").alias("n_questions"))


def quality_rollup(faith: DataFrame, relevance: DataFrame) -> DataFrame:
    """One row. Answers without statements are left out of the pooled rate; noncommittal ones count as 0 in the mean."""
    both = faith.join(relevance, "query_id")
    some, plain = F.col("n_statements") > 0, ~F.col("noncommittal")
    zero = F.lit(0.0)
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.try_divide(F.sum("n_supported").cast("double"), F.sum("n_statements")), zero).alias("micro_faithfulness"),
        F.coalesce(F.avg("faithfulness"), zero).alias("macro_faithfulness"),
        F.coalesce(F.avg(F.when(some, F.col("faithfulness"))), zero).alias("macro_faithfulness_answered"),
        F.count_if(~some).alias("n_faith_abstained"),
        F.coalesce(F.avg("relevancy"), zero).alias("macro_relevancy"),
        F.coalesce(F.avg(F.when(plain, F.col("relevancy"))), zero).alias("committal_relevancy"),
        F.count_if(~plain).alias("n_noncommittal"),
    )


def judged(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds lexical_f1 and correct to rows (reference, candidate); without a reference they are null."""
    some = F.coalesce(F.trim("reference"), F.lit("")) != ""
    f1 = F.when(some, T.lexical_f1(F.col("reference"), F.col("candidate")))
    return rows.withColumn("lexical_f1", f1).withColumn("correct", F.col("lexical_f1") >= threshold)


def recall_of_contexts(results: DataFrame, qrels: DataFrame, cutoffs: Iterable[int] = (1, 3, 5)) -> DataFrame:
    ranking = results.select("query_id", F.lit("a").alias("config"), F.posexplode("contexts").alias("i", "c")).select("config", "query_id", (F.col("i") + 1).alias("rank"), F.col("c.chunk_id").alias("chunk_id"))
    return metrics(ranking, qrels, cutoffs).select("query_id", "k", "recall")


def corrective_ab(plain: DataFrame, corrected: DataFrame, references: DataFrame, judge: Callable | None = None) -> DataFrame:
    """One row per query with both arms side by side. references: query_id, reference (or null).

    judge makes a model that says whether an answer is correct; it isn't told which arm an answer is of. Without it the
    words that answer and reference share decide.
    """
    from . import live
    from .corrective import trace

    ids = F.transform("contexts", lambda c: c["chunk_id"])
    a = plain.select("query_id", "query", ids.alias("a_ids"), F.col("answer").alias("a_answer"), F.col("attribution_rate").alias("a_rate"), F.col("n_citations").alias("a_n"), F.col("n_grounded").alias("a_good"))
    b = trace(corrected).select(
        "query_id", ids.alias("b_ids"), F.col("answer").alias("b_answer"), F.col("attribution_rate").alias("b_rate"), F.col("n_citations").alias("b_n"), F.col("n_grounded").alias("b_good"),
        "activated", "n_rewrites", "n_regenerations", "final_query_changed", "terminated_reason", "rewrite_budget_exhausted", "extra_llm_calls",
    )
    rows = a.join(b, "query_id").join(references, "query_id", "left").withColumn("contexts_identical", F.col("a_ids") == F.col("b_ids"))
    for arm in "ab":
        rows = judged(rows.withColumn("candidate", F.col(f"{arm}_answer")))
        if judge:
            told = live.is_yes(live.ask(live.judge_prompt(F.col("query"), F.col("reference"), F.col("candidate")), judge))
            rows = rows.withColumn("correct", F.when(F.col("lexical_f1").isNotNull(), told))
        rows = rows.withColumnRenamed("lexical_f1", f"{arm}_f1").withColumnRenamed("correct", f"{arm}_correct").drop("candidate")
    return rows.drop("query")


def corrective_rollup(ab: DataFrame) -> DataFrame:
    """One row of shares and means over the queries; answers are judged only where there is a reference."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    pooled = lambda arm: F.coalesce(F.try_divide(F.sum(f"{arm}_good").cast("double"), F.sum(f"{arm}_n")), F.lit(0.0))
    return ab.agg(
        F.count(F.lit(1)).alias("n_queries"),
        share("activated").alias("activation_rate"),
        F.count_if(F.col("n_rewrites") > 0).alias("n_rewrite_activated"),
        F.count_if(F.col("n_regenerations") > 0).alias("n_regenerate_activated"),
        F.count_if("final_query_changed").alias("n_final_query_changed"),
        share("contexts_identical").alias("contexts_identical_rate"),
        share("extra_llm_calls").alias("mean_extra_llm_calls"),
        pooled("a").alias("baseline_micro_attribution"),
        pooled("b").alias("corrective_micro_attribution"),
        F.count("a_correct").alias("n_judged"),
        share("a_correct").alias("baseline_correctness"),
        share("b_correct").alias("corrective_correctness"),
        share("a_f1").alias("baseline_lexical_f1"),
        share("b_f1").alias("corrective_lexical_f1"),
    )


def reasons(results: DataFrame) -> DataFrame:
    return results.groupBy("terminated_reason").agg(F.count(F.lit(1)).alias("n"))


# Reports


def report_json(sections: dict[str, DataFrame | dict], limit: int = 100_000) -> str:
    """Sorted JSON of small result tables and headers; the same results give the same bytes."""
    out = {}
    for name, part in sections.items():
        if isinstance(part, dict):
            out[name] = part
            continue
        rows = part.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has over {limit} rows, too many for a report")
        out[name] = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def render(title: str, table: DataFrame, limit: int = 200) -> str:
    """A small table as aligned text."""
    rows = table.limit(limit).collect()
    cells = [[*table.columns], *[[f"{x:.4f}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(table.columns))]
    return "\n".join([title, "=" * len(title), *("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)])
