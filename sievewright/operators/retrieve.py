"""Ranked retrieval for many queries at once: every function takes and returns rows with query_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import Bm25

#: Queries whose vectors are sent to all tasks at once; more go in as many passes.
QUERY_BLOCK = 4096
#: Numbers of a matrix that a task makes of a part of its rows.
CELLS = 2_000_000
#: Queries whose words are made one matrix.
SPARSE_BLOCK = 512
#: Scores are ranked on so many digits, so that the order of adding up can't change a rank.
DIGITS = 9


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """rank from 1, of the first k of each query. The comparison becomes a limit ahead of the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """query_id, key, score, rank by cosine. queries: query_id, embedding; vectors: key, embedding[, order].

    Vectors are never moved: each batch of them meets a block of queries as one matrix product and keeps its own
    best k a query. Null and zero vectors have score 0; without queries or vectors there are no rows.
    """
    order = order or key
    kind = vectors.schema[key].dataType.simpleString()
    order_kind = vectors.schema[order].dataType.simpleString()
    id_kind = queries.schema["query_id"].dataType.simpleString()
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = [(r["query_id"], r["embedding"]) for r in part.select("query_id", "embedding").collect()]
        found = _dense_block(held, vectors, k, key, order, f"query_id {id_kind}, {key} {kind}, corpus_idx {order_kind}, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, [F.desc(F.round("score", DIGITS)), F.asc("corpus_idx")], k).select("query_id", key, "score", "rank")


def _dense_block(held: list, vectors: DataFrame, k: int, key: str, order: str, schema: str) -> DataFrame:
    ids = [q for q, _ in held]
    width = max((len(v) for _, v in held if v), default=0)
    matrix = np.zeros((len(held), width))
    for row, (_, v) in zip(matrix, held, strict=True):
        row[: len(v or ())] = [0.0 if x is None else x for x in v or ()]  # a null vector is like nothing
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(64, CELLS // max(1, len(ids)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            if not ids:
                continue
            column = batch.column(2)
            sizes = column.value_lengths().fill_null(0).to_numpy()
            if not np.isin(sizes, (0, width)).all():
                raise ValueError(f"vectors must have {width} numbers, as the queries have")
            x = np.zeros((batch.num_rows, width))
            x[sizes > 0] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, width)
            size = np.linalg.norm(x, axis=1)
            scores = np.clip(np.divide(matrix @ x.T, size, out=np.zeros((len(ids), len(x))), where=size > 0), -1, 1)
            q, at = _best(scores, batch.column(1), k)
            yield _picked(ids, q, batch.column(0), batch.column(1), at, scores, schema, key)

    return vectors.select(F.col(key), F.col(order).alias("corpus_idx"), F.col("embedding").cast("array<double>")).mapInArrow(run, schema)


def _best(scores: np.ndarray, place: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row; of equal ones those whose place comes first."""
    if pa.types.is_struct(place.type):
        rows = [tuple((v is not None, v) for v in x.values()) for x in place.to_pylist()]
        order = np.array(sorted(range(len(rows)), key=rows.__getitem__), int)
    else:
        order = pc.sort_indices(place, null_placement="at_start").to_numpy()
    if len(order) <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    found = np.round(scores[:, order], DIGITS) + 0.0
    least = np.partition(found, len(order) - k, axis=1)[:, len(order) - k, None]
    above, equal = found > least, found == least
    q, at = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))
    return q, order[at]


def _picked(ids: list, q: np.ndarray, keys: pa.Array, places: pa.Array, at: np.ndarray, scores: np.ndarray, schema: str, key: str) -> pa.RecordBatch:
    picked = pa.array(at)
    arrays = [pa.array([ids[i] for i in q], _arrow(schema)), keys.take(picked), places.take(picked), pa.array(scores[q, at])]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", key, "corpus_idx", "score"])


def _arrow(schema: str) -> pa.DataType:
    return {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32()}.get(schema.split()[1].rstrip(","), pa.string())


def bm25_topk(queries: DataFrame, index: Bm25, k: int) -> DataFrame:
    """query_id, key, score, rank. All chunks count, those without a shared term with score 0; ties in corpus order.

    A term counts as often as the query has it. The postings of the queries' terms are dealt out by chunk, and each
    task keeps its own best k a query: what is moved doesn't grow with the queries, and pairs of a query and a chunk are
    never rows. Chunks with null keys are left out.
    """
    key = index.key
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        found = _sparse_block(part, index, k)
        out = found if out is None else out.unionByName(found)
    return ranked(out, [F.desc(F.round("score", DIGITS)), F.asc("corpus_idx")], k).select("query_id", key, "score", "rank")


def _sparse_block(queries: DataFrame, index: Bm25, k: int) -> DataFrame:
    key = index.key
    ids = [r["query_id"] for r in queries.select("query_id").distinct().collect()]
    at = {q: i for i, q in enumerate(ids)}
    terms = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    rows = F.broadcast(terms).join(index.idf.select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")).collect()
    numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    triples = np.array([(at[r["query_id"]], numbers[r["term"]], r["w"]) for r in rows], float).reshape(-1, 3)
    spark = queries.sparkSession
    asked = F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, no int"))
    # A chunk's row of lengths comes before its postings.
    places = index.lengths.select(key, F.lit(-1).alias("no"), F.coalesce(F.col("dl").cast("long"), F.lit(0)).alias("n"), "corpus_idx")
    posted = index.postings.join(asked, "term").select(key, "no", F.col("tf").cast("long").alias("n"), F.lit(None).cast(places.schema["corpus_idx"].dataType).alias("corpus_idx"))
    by_chunk = places.unionByName(posted).filter(F.col(key).isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, "no")
    k1, b, avgdl = index.k1, index.b, index.avgdl or 1.0
    kinds = {c: index.lengths.schema[c].dataType.simpleString() for c in (key, "corpus_idx")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kinds[key]}, corpus_idx {kinds['corpus_idx']}, score double"

    def matrices() -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, column of each term or -1, weights by column and query) of each block of queries."""
        out = []
        for first in range(0, len(ids), SPARSE_BLOCK):
            own = triples[(triples[:, 0] >= first) & (triples[:, 0] < first + SPARSE_BLOCK)]
            used, column = np.unique(own[:, 1].astype(int), return_inverse=True)
            weights = np.zeros((len(used), min(SPARSE_BLOCK, len(ids) - first)))
            weights[column, own[:, 0].astype(int) - first] = own[:, 2]
            places = np.full(len(numbers), -1)
            places[used] = np.arange(len(used))
            out.append((first, places, weights))
        return out

    def scored(chunks: pa.RecordBatch, made: list) -> Iterator[pa.RecordBatch]:
        """chunks: whole chunks, each its rows of lengths (several if its key repeats) and then its postings."""
        no, n = chunks.column(1).to_numpy(), chunks.column(2).to_numpy().astype(float)
        heads = np.flatnonzero(no < 0)
        if not len(heads):
            return
        fresh = np.append(True, np.diff(heads) > 1) | np.append(True, ~pc.equal(chunks.column(0).take(pa.array(heads[1:])), chunks.column(0).take(pa.array(heads[:-1]))).to_numpy(zero_copy_only=False))
        group = np.cumsum(fresh) - 1
        last = np.append(heads[1:], len(no))
        ends = last[np.append(np.flatnonzero(fresh)[1:] - 1, len(heads) - 1)]
        starts = heads[np.append(np.flatnonzero(fresh)[1:] - 1, len(heads) - 1)] + 1
        long = (ends - starts)[group]
        # Each row of lengths with all postings of its chunk.
        row = np.repeat(np.arange(len(heads)), long)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(starts[group], long)
        tf = n[entry]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[heads[row]] / avgdl))
        keys, places = chunks.column(0).take(pa.array(heads)), chunks.column(3).take(pa.array(heads))
        for first, column, weights in made:
            at = column[no[entry]] if len(entry) else np.zeros(0, int)
            x = np.zeros((len(heads), len(weights)))
            x[row[at >= 0], at[at >= 0]] = part[at >= 0]
            scores = x @ weights
            if not fresh.all():
                scores = np.add.reduceat(scores, np.flatnonzero(fresh), axis=0)[group]
            q, best = _best(scores.T, places, k)
            yield _picked(ids[first : first + SPARSE_BLOCK], q, keys, places, best, scores.T, schema, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = matrices()
        step = max(64, CELLS // max(1, *(max(w.shape) for _, _, w in made))) if made else 1
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest = [pa.concat_batches([*rest, batch])]
            heads = np.flatnonzero(rest[0].column(1).to_numpy() < 0)
            if len(heads) <= step:
                continue
            keys = rest[0].column(0).take(pa.array(heads))
            fresh = np.append(True, ~pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
            cuts = heads[fresh][:-1:step].tolist() + [int(heads[fresh][-1])]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield from scored(rest[0].slice(start, end - start), made)
            rest = [rest[0].slice(cuts[-1])]
        for part in rest:
            heads = np.flatnonzero(part.column(1).to_numpy() < 0)
            yield from scored(part.slice(int(heads[0])) if len(heads) else part, made)

    return by_chunk.mapInArrow(run, schema)


def rrf(rankings: list[DataFrame], key: str = "chunk_id", k: int = 60) -> DataFrame:
    """query_id, key, score, ranks (of each list, or null), rank, fused by reciprocal ranks. rankings: query_id, key, rank.

    An id that a list has twice counts at its better rank. Ties fall to what the lists show first.
    """
    if k <= 0:
        raise ValueError(f"the constant must be positive, got {k}")
    parts = [r.select("query_id", key, F.lit(i).alias("list"), F.col("rank").cast("int").alias("rank")) for i, r in enumerate(rankings)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    per_list = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(rankings))]
    wide = rows.groupBy("query_id", key).agg(*per_list)
    score = F.lit(0.0)
    for i in range(len(rankings)):
        score = score + F.coalesce(1.0 / (k + F.col(f"r{i}")), F.lit(0.0))
    wide = wide.withColumn("score", score)
    order = [F.desc(F.round("score", 12)), *[F.asc_nulls_last(f"r{i}") for i in range(len(rankings))], F.asc(key)]
    return wide.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def sources(dense: Column, sparse: Column) -> Column:
    return F.filter(F.array(F.when(dense.isNotNull(), F.lit("dense")), F.when(sparse.isNotNull(), F.lit("sparse"))), lambda x: x.isNotNull())


def hydrate(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Adds the chunks' columns; ids that aren't there go."""
    return hits.join(chunks, key)


def rerank_lexical(pool: DataFrame, k: int) -> DataFrame:
    """By how many distinct words of the query the text has; ties keep their order. pool: query_id, query, text, rank."""
    overlap = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("query"))), T.tokens(F.col("text"))))
    scored = pool.withColumn("score", overlap.cast("double")).withColumnRenamed("rank", "_in")
    return ranked(scored, [F.desc("score"), F.asc("_in")], k).drop("_in")


def rerank_identity(pool: DataFrame, k: int) -> DataFrame:
    scored = pool.withColumnRenamed("rank", "_in")
    return ranked(scored, [F.asc("_in")], k).drop("_in")


def rerank_model(pool: DataFrame, k: int, score) -> DataFrame:
    """By a model: score() makes, once a worker, a function from lists of queries and texts to scores."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple]) -> Iterator:
        import pandas as pd

        model = score()
        for queries, texts in batches:
            yield pd.Series(model(list(queries), list(texts)))

    rows = pool.withColumn("score", scored("query", "text")).withColumnRenamed("rank", "_in")
    return ranked(rows, [F.desc("score"), F.asc("_in")], k).drop("_in")


RERANKERS = {"lexical": rerank_lexical, "identity": rerank_identity}


def hybrid(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    index: Bm25,
    *,
    k: int = 5,
    top_k_dense: int = 20,
    top_k_sparse: int = 20,
    rrf_k: int = 60,
    pool_factor: int = 4,
    reranker: str | Callable | None = "lexical",
    key: str = "chunk_id",
    order: str | None = None,
) -> DataFrame:
    """query_id, key, score, rank, sources and the chunks' columns. queries: query_id, query, embedding."""
    if k <= 0:
        return hydrate(queries.limit(0).select("query_id").crossJoin(chunks.limit(0).select(key)), chunks, key)
    dense = dense_topk(queries, vectors, top_k_dense, key, order)
    sparse = bm25_topk(queries, index, top_k_sparse)
    fused = rrf([dense, sparse], key, rrf_k).filter(F.col("rank") <= max(k, pool_factor * k))
    fused = fused.withColumn("sources", sources(F.col("r0"), F.col("r1"))).drop("r0", "r1")
    # The hits of a block of queries are few: they are sent to the chunks, which then aren't moved.
    few = queries.select("query_id").limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    pool = hydrate(F.broadcast(fused) if few else fused, chunks, key)
    if reranker is None:
        return rerank_identity(pool, k)
    if callable(reranker):  # makes a model, see rerank_model
        return rerank_model(pool.join(queries.select("query_id", "query"), "query_id"), k, reranker).drop("query")
    if reranker not in RERANKERS:
        raise ValueError(f"unknown reranker {reranker!r}")
    return RERANKERS[reranker](pool.join(queries.select("query_id", "query"), "query_id"), k).drop("query")
