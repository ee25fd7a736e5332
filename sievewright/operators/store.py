"""A store of passages and their vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files
from . import index, retrieve
from .corrective import cut

#: What a point holds beside its id and its vector.
PAYLOAD = "chunk_id string, doc_id string, rel_path string, ordinal int, heading_path array<string>, text string, metadata map<string,string>"
POINT = f"point_id string, {PAYLOAD}, embedding array<double>"


class VectorStore:
    """Points in exactly one place: `path`, a folder that all machines reach, or `view`, a temporary view of the session.

    In a folder each change writes a version of its own and then switches a pointer to it, so that readers never see half
    of one; the version before stays for those who still read it, and older ones go.
    """

    def __init__(self, spark: SparkSession, *, path: str | None = None, view: str | None = None):
        given = [name for name, place in (("path", path), ("view", view)) if place]
        if len(given) != 1:
            raise ValueError(f"a store takes either a path or a view, got {' and '.join(given) or 'neither'}")
        self.spark, self.path, self.view = spark, path, view

    @classmethod
    def in_memory(cls, spark: SparkSession) -> VectorStore:
        return cls(spark, view=f"points_{uuid.uuid4().hex}")

    def _folder(self) -> str | None:
        return files.get(self.spark, f"{self.path}/current")

    def points(self) -> DataFrame:
        if self.view:
            return self.spark.table(self.view)
        folder = self._folder()
        if folder is None:
            raise ValueError(f"no store at {self.path} yet; ensure() makes one")
        return self.spark.read.parquet(folder)

    def _replace(self, points: DataFrame) -> None:
        if self.view:
            cut(points).createOrReplaceTempView(self.view)
            return
        before, folder = self._folder(), f"{self.path}/{uuid.uuid4().hex}"
        points.write.parquet(folder)
        files.put(self.spark, f"{self.path}/current", folder)
        files.delete_others(self.spark, self.path, {folder, before})

    def ensure(self) -> None:
        """An empty store; points that were there go."""
        self._replace(self.spark.createDataFrame([], POINT))

    def upsert(self, passages: DataFrame) -> None:
        """Passages (chunk_id, embedding, and any of the payload's columns) replace those of their ids.

        Ids come from chunk_id, so that the same passages again change nothing. Vectors must all be of one length.
        """
        have = {f.name for f in passages.schema}
        payload = [(f.name, f.dataType) for f in self.spark.createDataFrame([], PAYLOAD).schema]
        columns = [(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in payload]
        fresh = passages.select(T.point_id(F.col("chunk_id")).alias("point_id"), *columns, F.col("embedding").cast("array<double>").alias("embedding"))
        stored = self.points()
        sizes = stored.select("embedding").unionByName(fresh.select("embedding")).agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if sizes["a"] != sizes["b"]:
            raise ValueError(f"vectors of {sizes['a']} and of {sizes['b']} numbers don't go into one store")
        self._replace(index.upsert(stored, fresh))

    def count(self) -> int:
        return self.points().count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, score, rank. queries: query_id, embedding."""
        return retrieve.dense_topk(queries, self.points().select("chunk_id", "embedding"), k)

    def payloads(self, ids: DataFrame) -> DataFrame:
        """The payloads of ids (chunk_id); those that aren't there go."""
        return ids.select("chunk_id").distinct().join(self.points().drop("point_id", "embedding"), "chunk_id")
