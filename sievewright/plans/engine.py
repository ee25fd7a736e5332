"""The engine as one object: build the indexes, answer queries, evaluate."""

from __future__ import annotations

import datetime as dt
import importlib.metadata
import json
import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import chunking, corrective, evaluate, index, live, reports, retrieve
from ..operators import verify as V
from ..settings import Settings
from ..sources import files

LIBRARIES = ("pyspark", "numpy", "pandas", "pyarrow")
CHUNK = "chunk_id string, rel_path string, text string, heading_path array<string>, corpus_idx struct<path:array<string>,ordinal:int>"


def git_sha() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def versions() -> dict[str, str | None]:
    out = {}
    for name in LIBRARIES:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = None
    return out


class Engine:
    """Reads what build() stored last. Each build goes to a folder of its own, and a pointer is switched at the end."""

    def __init__(
        self,
        spark: SparkSession,
        settings: Settings | None = None,
        generate: Callable[[DataFrame], DataFrame] = A.offline,
        embedders: dict[str, Callable] | None = None,
        reranker: str | Callable = "lexical",
        models: dict[str, Callable] | None = None,
    ):
        """embedders: makers of models by the names that settings.embedding_model may have; reranker: see retrieve.hybrid.

        models: makers of language models by what they do: "corrector" (grades passages and rewrites queries), "judge",
        "scorer" (of faithfulness and relevancy). Offline stand-ins do what isn't there.
        """
        self.spark, self.settings, self.generate = spark, settings or Settings(), generate
        self.embedders, self.reranker, self.models = embedders, reranker, models or {}
        unknown = set(self.models) - {"corrector", "judge", "scorer"}
        if unknown:
            raise ValueError(f"no such part of the work: {', '.join(sorted(unknown))}")
        self._loaded: tuple[DataFrame, DataFrame, index.Bm25] | None = None

    def embedded(self, text: Column) -> Column:
        """The vector of a text by the embedder that the settings name, which must be there."""
        return live.embedding(text, self.settings.embedding_model, self.settings.embedding_dim, self.embedders)

    # Building

    def build(self, docs: DataFrame | None = None) -> dict:
        s, spark = self.settings, self.spark
        docs = files.read_corpus(spark, s.corpus_dir) if docs is None else docs
        folder = f"{s.index_dir}/{uuid.uuid4().hex}"
        found = chunking.chunk(docs, s.chunk_strategy, s.chunk_size, s.chunk_overlap)
        files.with_corpus_index(found).write.parquet(f"{folder}/chunks")
        chunks = spark.read.parquet(f"{folder}/chunks")
        index.write_vectors(index.embed(chunks, s.embedding_dim, embedding=self.embedded(F.col("text"))), f"{folder}/vectors")
        fitted = index.bm25_index(chunks, k1=s.bm25_k1, b=s.bm25_b, epsilon=s.bm25_epsilon)
        index.write_bm25(fitted, f"{folder}/bm25")
        fitted.postings.unpersist()
        meta = self.meta(docs, chunks)
        files.put(spark, f"{folder}/meta.json", json.dumps(meta, ensure_ascii=False, indent=2, sort_keys=True))
        files.put(spark, f"{s.index_dir}/current", folder)
        self._loaded = None
        return meta

    def meta(self, docs: DataFrame, chunks: DataFrame) -> dict:
        s = self.settings
        return {
            "schema_version": index.SCHEMA_VERSION,
            "created_at": dt.datetime.now(dt.UTC).isoformat(),
            "git_sha": git_sha(),
            "corpus_sha256": index.fingerprint(chunks),
            "counts": {"n_documents": docs.count(), "n_chunks": chunks.count()},
            "embedding": {"model": s.embedding_model, "dim": s.embedding_dim},
            "chunking": {"strategy": s.chunk_strategy, "chunk_size": s.chunk_size, "chunk_overlap": s.chunk_overlap},
            "vector_store": {"collection": s.index_dir, "distance": "cosine"},
            "retrieval": {"rrf_k": s.rrf_k, "top_k_dense": s.top_k_dense, "top_k_sparse": s.top_k_sparse},
            "library_versions": versions(),
        }

    def current(self) -> str | None:
        return files.get(self.spark, f"{self.settings.index_dir}/current")

    def recorded(self) -> dict:
        """What the last build recorded; nothing before the first."""
        folder = self.current()
        return json.loads(files.get(self.spark, f"{folder}/meta.json")) if folder else {}

    # Answering

    def load(self) -> tuple[DataFrame, DataFrame, index.Bm25]:
        """chunks, vectors and BM25 index of the last build; empty ones before the first."""
        if self._loaded is None:
            folder = self.current()
            if folder:
                parts = [self.spark.read.parquet(f"{folder}/{p}") for p in ("chunks", "vectors")]
                self._loaded = parts[0], parts[1], index.read_bm25(self.spark, f"{folder}/bm25")
            else:
                chunks = self.spark.createDataFrame([], CHUNK)
                self._loaded = chunks, index.embed(chunks, self.settings.embedding_dim), index.bm25_index(chunks)
        return self._loaded

    def retrieve(self, queries: DataFrame, k: int | None = None, reranker: str | None = "default") -> DataFrame:
        """queries: query_id, query."""
        s = self.settings
        chunks, vectors, bm25 = self.load()
        vectors = vectors.join(chunks.select("chunk_id", "corpus_idx"), "chunk_id").withColumn("corpus_idx", F.to_json("corpus_idx"))
        asked = queries.select("query_id", "query", self.embedded(F.col("query")).alias("embedding"))
        chosen = (self.reranker if s.use_reranker else None) if reranker == "default" else reranker
        return retrieve.hybrid(
            asked, chunks, vectors, bm25, k=s.top_k_rerank if k is None else k, top_k_dense=s.top_k_dense, top_k_sparse=s.top_k_sparse,
            rrf_k=s.rrf_k, pool_factor=s.rerank_pool_factor, reranker=chosen, order="corpus_idx",
        )

    def answer(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, query, answer, citations, contexts, and the figures of the check of its citations."""
        return corrective.once(queries, lambda q: self.retrieve(q, k), self.generate)

    def ask(self, query: str, k: int | None = None) -> DataFrame:
        query = query.strip()
        if not query:
            raise ValueError("the query is blank")
        if k is not None and not 0 < k <= 100:
            raise ValueError(f"k must be from 1 to 100, got {k}")
        return self.answer(self.spark.createDataFrame([("q", query)], "query_id string, query string"), k)

    def stream(self, query: str, k: int | None = None) -> DataFrame:
        return A.events(self.ask(query, k)).orderBy("seq")

    def correct(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        make = self.models.get("corrector")
        if make is None:
            return corrective.run(queries, lambda q: self.retrieve(q, k), self.settings, generate=self.generate)

        def rewrite(rows: DataFrame) -> DataFrame:
            asked = rows.select("query_id", F.col("current_query").alias("query"))
            return live.rewritten(asked, make).select("query_id", F.col("query").alias("new_query"))

        return corrective.run(queries, lambda q: self.retrieve(q, k), self.settings, generate=self.generate, grade=lambda found: live.graded(found, make), rewrite=rewrite)

    def health(self) -> dict:
        return {"status": "ok", "index": self.current()}

    # Evaluating

    def four_ways(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """config, query_id, chunk_id, rank of dense, sparse, hybrid and reranked retrieval."""
        s = self.settings
        chunks, vectors, bm25 = self.load()
        vectors = vectors.join(chunks.select("chunk_id", "corpus_idx"), "chunk_id").withColumn("corpus_idx", F.to_json("corpus_idx"))
        asked = queries.select("query_id", "query", self.embedded(F.col("query")).alias("embedding"))
        runs = {
            "dense": retrieve.dense_topk(asked, vectors, k, order="corpus_idx"),
            "sparse": retrieve.bm25_topk(asked, bm25, k),
            "hybrid": self.retrieve(queries, k, None),
            "hybrid_rerank": self.retrieve(queries, k, self.reranker),
        }
        out = None
        for config, found in runs.items():
            part = found.select(F.lit(config).alias("config"), "query_id", "chunk_id", "rank")
            out = part if out is None else out.unionByName(part)
        return out

    def evaluate(self, golden: DataFrame) -> dict[str, DataFrame]:
        """per_query, macro and comparisons. golden as read_golden() gives it."""
        s = self.settings
        evaluate.check_coverage(golden.select(F.explode("relevant_chunk_ids").alias("chunk_id")), self.load()[0])
        qrels = golden.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
        per_query = corrective.cut(evaluate.metrics(self.four_ways(golden.select("query_id", "query")), qrels))
        ordered = per_query.join(golden.select("query_id", "golden_idx"), "query_id")
        return {
            "per_query": per_query,
            "macro": evaluate.macro(per_query),
            "comparisons": evaluate.comparisons(ordered, n_resamples=s.resamples, seed=s.seed, order="golden_idx"),
        }

    def attributed(self, queries: DataFrame) -> DataFrame:
        """The report on the citations of each query's answer."""
        return corrective.cut(self.answer(queries).select("query_id", "n_citations", "n_grounded", "attribution_rate", "unsupported"))

    def evaluate_attribution(self, queries: DataFrame) -> DataFrame:
        return V.rollup(self.attributed(queries))

    def quality(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Faithfulness and relevancy by query, by the scorer if there is one."""
        s, make = self.settings, self.models.get("scorer")
        answers = corrective.cut(self.answer(queries).withColumn("context", F.array_join(F.transform("contexts", lambda c: c["text"]), "\n\n")))
        asked = corrective.cut(live.questions(answers, s.n_questions, make)) if make else None
        faith = live.faithfulness(answers, make) if make else evaluate.faithfulness(answers)
        relevance = evaluate.relevancy(answers, s.n_questions, s.embedding_dim, asked, self.embedded)
        return corrective.cut(faith), corrective.cut(relevance)

    def evaluate_quality(self, queries: DataFrame) -> DataFrame:
        return evaluate.quality_rollup(*self.quality(queries))

    def evaluate_corrective(self, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both arms by query, and their summary."""
        queries = golden.select("query_id", "query")
        references = golden.select("query_id", F.col("reference_answer").alias("reference"))
        plain, better = corrective.cut(self.answer(queries)), corrective.cut(self.correct(queries))
        ab = corrective.cut(evaluate.corrective_ab(plain, better, references, self.models.get("judge")))
        return ab, evaluate.corrective_rollup(ab)

    # Reporting

    def backends(self) -> dict[str, reports.Backend]:
        """What does each part of the work. A stand-in with other arguments is a stand-in still."""
        s = self.settings
        made_by = getattr(self.generate, "func", self.generate)
        chosen = self.reranker if s.use_reranker else "identity"
        found = {
            "generator": reports.Backend(getattr(made_by, "__name__", type(made_by).__name__), made_by is not A.offline),
            "embedder": reports.Backend(s.embedding_model, s.embedding_model != "hashing"),
            "reranker": reports.Backend(getattr(chosen, "__name__", str(chosen)), callable(chosen)),
        }
        for part in ("corrector", "judge", "scorer"):
            make = self.models.get(part)
            found[part] = reports.Backend(getattr(make, "__name__", str(make)) if make else "offline", make is not None)
        return found

    def report(self, kind: str, golden_path: str) -> reports.Report:
        """An evaluation of one kind (retrieval, attribution, quality, corrective) with where its figures come from.

        The labels must lie outside of the corpus and name what is indexed, and the corpus must not be the private one.
        """
        if kind not in reports.FILES:
            raise ValueError(f"unknown kind of report {kind!r}; there are {', '.join(reports.FILES)}")
        s = self.settings
        evaluate.check_outside(golden_path, s.corpus_dir)
        if s.private_corpus_dir:
            evaluate.check_public(s.corpus_dir, s.private_corpus_dir)
        golden = files.read_golden(self.spark, golden_path)
        qrels = golden.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
        evaluate.check_coverage(qrels, self.load()[0])
        queries = golden.select("query_id", "query")
        if kind == "retrieval":
            found = self.evaluate(golden)
            sections = {"macro": found["macro"], "comparisons": found["comparisons"], "per_query": found["per_query"]}
        elif kind == "attribution":
            each = self.attributed(queries)
            sections = {"summary": V.rollup(each), "per_query": each}
        elif kind == "quality":
            faith, relevance = self.quality(queries)
            sections = {"summary": evaluate.quality_rollup(faith, relevance), "per_query": faith.join(relevance, "query_id")}
        else:
            ab, summary = self.evaluate_corrective(golden)
            recalls = None
            for arm in "ab":
                contexts = ab.select("query_id", F.transform(f"{arm}_ids", lambda i: F.struct(i.alias("chunk_id"))).alias("contexts"))
                part = evaluate.recall_of_contexts(contexts, qrels).groupBy("k").agg(F.avg("recall").alias(f"{arm}_recall"))
                recalls = part if recalls is None else recalls.join(part, "k")
            sections = {"summary": summary, "recall": recalls, "reasons": evaluate.reasons(ab), "per_query": ab.drop("reference")}
        header = reports.provenance(kind, s, self.recorded(), self.backends(), golden.count())
        return reports.Report(kind, header, sections)

    def write_report(self, kind: str, golden_path: str) -> str:
        return self.report(kind, golden_path).write(self.spark, self.settings.eval_dir)
