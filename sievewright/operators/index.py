"""Dense vectors and BM25 statistics of chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import text as T

#: Name and version of the tokenizer and of the layout that stored indexes carry.
TOKENIZER, SCHEMA_VERSION = "lower_alnum_v1", 1


def token_slot(token: Column, dim: int) -> tuple[Column, Column]:
    """Bucket and sign of a token, from its SHA-256."""
    h = F.sha2(token, 256)
    bucket = (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % dim).cast("int")
    odd = F.conv(F.substring(h, 18, 1), 16, 10).cast("int") % 2 == 1
    return bucket, F.when(odd, F.lit(1)).otherwise(F.lit(-1))


def hashed_sparse(rows: DataFrame, key: str, text: str = "text", dim: int = 256) -> DataFrame:
    """key, bucket, weight of the L2-normalized signed feature hash: the vector's non-zero places as rows."""
    counts = rows.select(key, F.explode(T.tokens(F.col(text))).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))
    bucket, sign = token_slot(F.col("t"), dim)
    sums = counts.select(key, bucket.alias("bucket"), (sign * F.col("n")).alias("w")).groupBy(key, "bucket").agg(F.sum("w").alias("w")).filter("w <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def hashed_embedding(text: Column, dim: int = 256) -> Column:
    """The same as an array, row by row; the slot of each token is worked out once a worker."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots: dict[str, tuple[int, int]] = {}

        def slot(token: str) -> tuple[int, int]:
            if token not in slots:
                h = hashlib.sha256(token.encode()).digest()
                if len(slots) > 500_000:
                    slots.clear()
                slots[token] = (int.from_bytes(h[:8], "big") % dim, 1 if h[8] % 2 else -1)
            return slots[token]

        for words in batches:
            n = len(words)
            coded = words.flatten().dictionary_encode()
            found = np.array([slot(t) for t in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(n), words.value_lengths().fill_null(0).to_numpy())
            v = np.bincount(row * dim + found[:, 0], weights=found[:, 1], minlength=n * dim).astype(float).reshape(n, dim)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=v, where=norm > 0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.ravel()))

    return embed(T.tokens(text))


def embed(chunks: DataFrame, dim: int = 256, key: str = "chunk_id", text: str = "text", embedding: Column | None = None) -> DataFrame:
    """key, point_id, embedding: by feature hashing, or as given."""
    vector = hashed_embedding(F.col(text), dim) if embedding is None else embedding
    return chunks.select(key, T.point_id(F.col(key).cast("string")).alias("point_id"), vector.alias("embedding"))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Bm25:
    """Postings and statistics; lengths has every chunk, also those without tokens, with its place in the corpus."""

    postings: DataFrame
    lengths: DataFrame
    idf: DataFrame
    n: int
    avgdl: float
    floor: float
    key: str = "chunk_id"
    k1: float = 1.5
    b: float = 0.75


def bm25_index(chunks: DataFrame, key: str = "chunk_id", order: str = "corpus_idx", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Bm25:
    """Fits the statistics. Terms in over half of the chunks get epsilon times the mean idf in place of a negative one.

    The postings and lengths are kept, spilling to disk, since scoring reads them once more.
    """
    found = postings(chunks, key).persist(StorageLevel.MEMORY_AND_DISK)
    lengths = chunks.select(key, F.col(order).alias("corpus_idx"), F.size(T.tokens(F.col("text"))).cast("long").alias("dl")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n = stats["n"]
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * mean)).otherwise(F.col("raw")).alias("idf"))
    return Bm25(found, lengths, idf, n, stats["avgdl"] or 0.0, epsilon * mean, key, k1, b)


def write_bm25(index: Bm25, folder: str) -> None:
    index.postings.write.mode("overwrite").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    index.idf.write.mode("overwrite").parquet(f"{folder}/idf")
    row = (SCHEMA_VERSION, TOKENIZER, index.n, index.avgdl, index.floor, index.key, index.k1, index.b)
    names = "schema_version int, tokenizer string, n long, avgdl double, floor double, key string, k1 double, b double"
    index.postings.sparkSession.createDataFrame([row], names).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def read_bm25(spark, folder: str) -> Bm25:
    names = "schema_version int, tokenizer string, n long, avgdl double, floor double, key string, k1 double, b double"
    meta = spark.read.schema(names).json(f"{folder}/meta").first()
    if meta["schema_version"] != SCHEMA_VERSION or meta["tokenizer"] != TOKENIZER:
        raise ValueError(f"index at {folder} has layout {meta['schema_version']} and tokenizer {meta['tokenizer']}")
    parts = [spark.read.parquet(f"{folder}/{p}") for p in ("postings", "lengths", "idf")]
    return Bm25(*parts, meta["n"], meta["avgdl"], meta["floor"], meta["key"], meta["k1"], meta["b"])


def fingerprint(chunks: DataFrame) -> str:
    """SHA-256 over (chunk_id, text) in order; one running hash, so rows are streamed to it, never gathered."""
    total = hashlib.sha256()
    rows = chunks.select("chunk_id", F.length("text").alias("n"), "text").orderBy("chunk_id", F.col("text").cast("binary"))
    for r in rows.toLocalIterator(prefetchPartitions=True):
        total.update(f"{r['chunk_id']}\x00{r['n']}\x00{r['text']}\x01".encode())
    return total.hexdigest()


# Stores


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Makes the store anew; whatever was there goes, also when nothing comes."""
    vectors.write.mode("overwrite").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Stored rows whose key isn't among the new ones, and the new ones, once each."""
    fresh = new.dropDuplicates([key])
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)
