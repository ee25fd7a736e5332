"""A corpus from documents to packed sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the
columns of documents; the last returns the pieces of the packed sequences. A stage's output is deleted when the next
one's is written, except for the last.

Defined cases: null text is empty text; of a null or repeated doc_id each text is a document, and rows that repeat both
stay or go together; other columns than those of documents are dropped; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import line_dedup, mixing, order_minhash, packing, toxicity
from sievewright.llm.common import cut_lineage, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.fold() != 0).select("doc_id", "toxic")
    return toxicity.score(docs.select(*COLUMNS), labels).filter(F.col("score") < 0.5).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents of which no line is left go."""
    done = line_dedup.dedup(docs.select(*COLUMNS), carry=("lang", "source"))
    some = F.forall("lines", lambda x: x["dropped"]) & (F.size("lines") > 0)
    return done.filter(~some).select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("long").alias("n_chars"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies stays."""
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"))
    kept = order_minhash.near_duplicates(own).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("copy").alias("kept_copy"))
    return own.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("copy") == F.col("kept_copy")), "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens match the target shares of sources, languages and topics."""
    return mixing.sample(mixing.described(docs.select(*COLUMNS)).select(*COLUMNS, "topic", "tokens")).filter("sampled").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens of near-equal length."""
    import public_tokenizers

    return packing.pack(cut_lineage(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
