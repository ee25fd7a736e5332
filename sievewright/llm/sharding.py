"""Operator 9: proportional stratified interleaving, with DataFrame functions only.

Rows of a stratum (their source) are put in a seeded random order; the row of rank r among n gets
the fractional rank (r - 1/2) / n. All rows sorted by fractional rank, cut into equal slices, give
shards that each hold every stratum in its share of the corpus, and row counts at most one apart.

Neither order needs a global sort or one window over a whole stratum. The shuffle key is a uniform
hash, so a stratum is split by hash prefix, and the merged order by fractional rank, into buckets of
bounded expected size; only bucket counts (a table whose size is set by parameters and the number of
strata) are summed up to turn positions within a bucket into global ones.

Defined cases: a null stratum is a stratum of its own; a null text has size 8 and the CRC of no
bytes; rows of a null or repeated id are ranked one after another, by a hash of all their columns (any order
among equal rows gives the same result up to their exchange); texts of any length count as one row; other
columns pass through, but for `shard` and `slot`, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
SEED = "interleave-1"
#: Hex digits of the shuffle key that split a stratum; 2 digits give 256 buckets a stratum.
PREFIX = 2
#: Buckets of the merged order.
SLICES = 4096


def shuffle_key(row_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit(""))))


def interleave(
    df: DataFrame,
    row_id: str = "doc_id",
    stratum: str = "source",
    shards: int = SHARDS,
    seed: str = SEED,
    prefix: int = PREFIX,
    slices: int = SLICES,
) -> DataFrame:
    """Adds `shard` int and `slot` long (gapless from 0 within a shard) to the rows of df."""
    rows = df.drop("shard", "slot").withColumns(
        {
            "_il_key": shuffle_key(F.col(row_id), seed),
            "_il_tie": F.xxhash64(*[f.name for f in df.drop("shard", "slot").schema if "map<" not in f.dataType.simpleString()]),
            "_il_stratum": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")),
        }
    ).withColumn("_il_bucket", F.substring("_il_key", 1, prefix))
    counts = rows.groupBy("_il_stratum", "_il_bucket").agg(F.count(F.lit(1)).alias("_il_n"))
    upto = Window.partitionBy("_il_stratum").orderBy("_il_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns(
        {
            "_il_before": F.coalesce(F.sum("_il_n").over(upto), F.lit(0)),
            "_il_total": F.sum("_il_n").over(Window.partitionBy("_il_stratum")),
        }
    ).drop("_il_n")
    within = Window.partitionBy("_il_stratum", "_il_bucket").orderBy("_il_key", row_id, "_il_tie")
    ranked = rows.withColumn("_il_r", F.row_number().over(within)).join(starts, ["_il_stratum", "_il_bucket"])
    # 2r - 1 over 2n as an exact order: equal doubles fall back on the shuffle key.
    ranked = ranked.withColumn(
        "_il_share", (2 * (F.col("_il_before") + F.col("_il_r")) - 1).cast("double") / (2 * F.col("_il_total")).cast("double")
    ).withColumn("_il_slice", F.floor(F.col("_il_share") * slices).cast("int"))
    sizes = ranked.groupBy("_il_slice").agg(F.count(F.lit(1)).alias("_il_n"))
    # One row for each slice: the number of slices is a parameter, so this window stays small.
    ahead = Window.partitionBy(F.lit(0)).orderBy("_il_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_il_slice",
        F.coalesce(F.sum("_il_n").over(ahead), F.lit(0)).alias("_il_offset"),
        F.sum("_il_n").over(Window.partitionBy(F.lit(0))).alias("_il_rows"),
    )
    order = Window.partitionBy("_il_slice").orderBy("_il_share", "_il_key", row_id, "_il_tie")
    placed = (
        ranked.withColumn("_il_at", F.row_number().over(order) - 1)
        .join(F.broadcast(offsets), "_il_slice")  # at most `slices` + 1 rows
        .withColumn("_il_at", F.col("_il_at") + F.col("_il_offset"))
    )
    # Shard s holds the positions from ceil(s * rows / shards) on.
    first = F.expr(f"(shard * _il_rows + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", F.expr(f"cast((_il_at * {shards}) div _il_rows as int)"))
    return placed.withColumn("slot", F.col("_il_at") - first).drop(
        "_il_key", "_il_tie", "_il_stratum", "_il_bucket", "_il_before", "_il_total", "_il_r", "_il_share", "_il_slice", "_il_offset", "_il_rows", "_il_at"
    )


def op9_interleave(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
