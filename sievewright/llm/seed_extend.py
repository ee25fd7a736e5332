"""Operator 4: repeated word sequences across documents, by seed and extend.

A word goes if a window of `length` consecutive words covers it whose sequence also starts in a document
of smaller id. Windows are judged on the input.

1. Seeds: each window is winnowed to one anchor, the k-gram of words of least hash in it (see anchors), so
   documents that share a window share its anchor. One exchange by anchor hash joins them. Where the whole
   stretch around an anchor is the same, all but the smallest document are settled at once, first within a
   block of text and then after the exchange; no pairs are made.
2. Extension: where documents share an anchor with different surroundings, each carries the hashes of the
   words to both sides. For every offset of the anchor in a window, documents whose words agree on the left
   and on the right by that much form a class, and all but its smallest document lose the window. That is
   the extension of all pairs both ways, up to the first difference, in time linear in the documents.
3. Overlapping windows join to maximal repeats.

Defined cases: null text has no words; texts under `length` words lose nothing, and texts of any length are worked on
in blocks that overlap; a sequence that repeats in one document alone stays; rows that repeat a doc_id with its text get
the same result; of an id (or null) with several texts each text is a document, in the order of their hashes; a null
doc_id counts as the largest; only the named columns are read, so others may have any names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import LAST_ID, cut_lineage, identified, partitions, with_node
from .suffix_dedup import MERGE, RUNS, blocks, flat, pack_place, run_batch, settle_runs, window_ranges

LENGTH = 50
GRAM = 8
#: Bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of data; bounds: where a document begins, and the end of the last."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= space[1:] | edge[1:-1]
    ends = np.flatnonzero(stops) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    longest = int((ends - starts).max())
    values = anchors.BYTES[data] * anchors.powers(longest + 1)[0][np.where(inside, at, 0)]
    values[space] = 0
    # Long stretches are summed part by part by numpy itself; no word is cut.
    return starts, ends, anchors.mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def word_blocks(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, word bounds, word hashes) of whole documents, about a block of bytes at a time."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + anchors.BLOCK, side="right")) - 1)
        base = offsets[row]
        bounds = offsets[row : last + 1] - base
        starts, _, hashes = words(data[base : offsets[last]], bounds)
        yield np.arange(row, last), np.searchsorted(starts, bounds), hashes
        row = last


def word_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(1))
            for rows, own, hashes in word_blocks(offsets, data):
                for which, bounds in blocks(own, anchors.BLOCK, length - 1):
                    base = bounds[0]
                    found = anchors.anchor_runs(hashes[base : bounds[-1]], bounds - base, length, gram)
                    if not len(found["at"]):
                        continue
                    row = which[found["seq"]]
                    shift = base - own[row]
                    place = pack_place(found["at"] + shift, found["first"] + shift, found["last"] + shift)
                    yield run_batch(found["anchor"], found["span"], ids[rows[row]], place, whole_doc=True)

    return docs.mapInArrow(run, RUNS)


def contexts(open_docs: DataFrame, length: int) -> DataFrame:
    """Open anchors with the 64-bit hashes of the words to their right (from the anchor on) and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            data, offsets = flat(batch.column(1))
            for rows, own, hashes in word_blocks(offsets, data):
                full = hashes.astype("<u8")
                cols: list[list] = [[] for _ in range(5)]
                for i, row in enumerate(rows.tolist()):
                    here = full[own[i] : own[i + 1]]
                    found = lists[row].values
                    for anchor, place in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                        at, low, high = place >> 16, (place >> 8) & 255, place & 255
                        right, left = here[at : at + length - low], here[at - high : at][::-1]
                        for col, value in zip(cols, (anchor, ids[row], place, right.tobytes(), left.tobytes()), strict=True):
                            col.append(value)
                kinds = [pa.int64()] * 3 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "doc_id", "place", "right", "left"]
                )

    return open_docs.mapInArrow(run, "anchor long, doc_id long, place long, right binary, left binary")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """64-bit numbers of each value, zeros after the last."""
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in column.to_pylist()), "<u8").reshape(-1, width)


def extended(seeds: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(doc_id, first, last): windows that also start in a smaller document."""

    def run(group: pa.Table) -> pa.Table:
        right, left = matrix(group["right"], length), matrix(group["left"], length - gram)
        doc, place = group["doc_id"].to_numpy(), group["place"].to_numpy()
        low, high = (place >> 8) & 255, place & 255
        # Hashes of the anchor and ever more words to its right, for the lengths that windows can need.
        ahead, onward = np.ascontiguousarray(group["anchor"].to_numpy()).view(np.uint64).copy(), {}
        for i in range(length):
            ahead = anchors.mix(ahead * np.uint64(anchors.BASE) + right[:, i])
            if i + 1 >= gram:
                onward[i + 1] = ahead
        rank = np.unique(doc, return_inverse=True)[1]
        hit, offset = anchors.settle(lambda i: onward[length - i], lambda i: left[:, i - 1], low, high, rank)
        ids, which = np.unique(doc[hit], return_inverse=True)
        key, first, last = anchors.ranges(which, (place[hit] >> 16) - offset)
        return pa.table({"doc_id": pa.array(ids[key], pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})

    return (
        seeds.withColumn("part", F.pmod("anchor", F.lit(parts))).groupBy("part").applyInArrow(run, "doc_id long, first long, last long")
    )


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, places (settled runs) and found (ranges of window starts)."""
    if not gram <= length <= gram + 255:
        raise ValueError("length must be from gram to gram + 255")
    marks = cut_lineage(settle_runs(word_runs(docs, length, gram), whole_doc=True))
    n = marks.agg(F.sum(F.size("open"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-n // (MERGE // 4)))
    # All columns, so that the exchange of the texts is the one that strip() reads again.
    open_docs = marks.filter(F.size("open") > 0).select("doc_id", "open").join(docs, "doc_id").select("doc_id", "data", "open", *docs.columns[2:])
    found = extended(contexts(open_docs, length), length, gram, parts)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return marks.select("doc_id", "places").join(per_doc, "doc_id", "full")


def strip(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, spans (maximal removed runs of words) and kept (other words, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            kept, spans, sizes = [], [], []
            for row in range(batch.num_rows):
                own = data[offsets[row] : offsets[row + 1]].tobytes().split()
                sizes.append(len(own))
                first, last = window_ranges(batch.column(2)[row], batch.column(3)[row])
                if len(first):
                    gone = anchors.covered(len(own), first, last, length)
                    spans.append(anchors.spans(gone))
                    own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    spans.append([])
                kept.append(b" ".join(own))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "spans", "kept"],
            )

    joined = docs.join(marks, "doc_id", "left").select("own_id", "data", "places", "found")
    return joined.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept binary")


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    own = with_node(identified(docs, row_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")))
    own = own.select(F.col("node").alias("doc_id"), "data", F.col("doc_id").alias("own_id"))
    out = strip(own, repeats(own, length), length)
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))


def op4_seed_extend(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0)).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
