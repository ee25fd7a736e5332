"""Operator 2: repeated byte strings, by a distributed merge sort of sampled suffixes.

A byte goes if a string of `length` bytes covers it that also starts earlier: in a document of smaller
id, or in the same document further ahead. Strings are judged on the input.

1. Every window of `length` bytes has an anchor (see anchors). Windows of one anchor in one place form a
   run; a run is known by the hashes of its anchor and of its whole content. Of equal runs only the
   earliest can stay, so all others are settled at once, first within a block of text and then by one
   exchange of some 30 bytes for about every 40 bytes of text. An anchor that is met in one content only
   needs no more work.
2. For the rest, the suffix of the text at the anchor is taken, with what stands before it. Each task
   sorts its suffixes into a run by (anchor hash, suffix), front-codes it, and cuts it at fixed points
   of the hash's range, which is even by construction, so no sample is needed for splitters.
3. The task of a range merges its runs with a loser tree that carries common-prefix lengths: two heads
   are compared from the prefix on that both are known to share with the last output, and not at all
   where those prefixes differ. The merge yields the prefix length between neighbours, from which the
   windows that stand earlier elsewhere are found offset by offset, with no pairs of suffixes.

Defined cases: null text is empty; texts under `length` bytes lose nothing, and texts of any length are worked on in
blocks that overlap; rows that repeat a doc_id with its text are the same document given again and get the same result;
of an id (or null) with several texts each text is a document, in the order of their hashes; a null doc_id counts as
the largest; only the named columns are read, so others may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors
from .common import LAST_ID, cut_lineage, identified, partitions, with_node

LENGTH = 100
GRAM = 24
#: Suffixes of one merge task, about.
MERGE = 200_000
#: Suffixes of one sorted run.
RUN = 100_000


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a binary or string column, and where each begins."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, size: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, from) of sequences and their bounds, contiguous and about `size` elements together.

    A longer row is cut into parts that overlap, so that each window lies in exactly one as a start.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] > size + overlap:
            for at in range(int(offsets[row]), int(offsets[row + 1]) - overlap, size):
                stop = min(at + size + overlap, int(offsets[row + 1]))
                yield np.array([row]), np.array([at, stop])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        long = np.flatnonzero(np.diff(offsets[row : last + 1]) > size + overlap)
        last = row + int(long[0]) if len(long) else last
        yield np.arange(row, last), offsets[row : last + 1]
        row = last


def pack_place(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 16) | ((at - last) << 8) | (at - first)


def collapse(anchor: np.ndarray, span: np.ndarray, doc: np.ndarray, place: np.ndarray, whole_doc: bool = False) -> np.ndarray:
    """Whether a run has an equal one that is earlier (with whole_doc: in an earlier document)."""
    order = np.lexsort((place, doc, span, anchor))
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[order[1:]] == anchor[order[:-1]]) & (span[order[1:]] == span[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = doc[order] != doc[order[head]]
    if not whole_doc:
        later |= place[order] != place[order[head]]
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


RUNS = "anchor long, span long, doc_id long, place long, settled boolean"


def run_batch(anchor, span, doc, place, whole_doc=False) -> pa.RecordBatch:
    settled = collapse(anchor, span, doc, place, whole_doc)
    # Settled runs only travel along; a key of their own keeps them from crowding one task.
    anchor = np.where(settled, anchors.mix(doc.astype(np.uint64) ^ (place.astype(np.uint64) << np.uint64(20))), anchor)
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc), pa.array(place), pa.array(settled)],
        names=["anchor", "span", "doc_id", "place", "settled"],
    )


def byte_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(1))
            for rows, bounds in blocks(offsets, anchors.BLOCK, length - 1):
                base = bounds[0]
                values = anchors.BYTES[data[base : bounds[-1]]]
                found = anchors.anchor_runs(values, bounds - base, length, gram)
                if not len(found["at"]):
                    continue
                row = rows[found["seq"]]
                shift = base - offsets[row]
                place = pack_place(found["at"] + shift, found["first"] + shift, found["last"] + shift)
                yield run_batch(found["anchor"], found["span"], ids[row], place)

    return docs.mapInArrow(run, RUNS)


def settle_runs(runs: DataFrame, whole_doc: bool = False) -> DataFrame:
    """For each document its settled runs (places), and the anchors whose runs differ from each other."""
    group = Window.partitionBy("anchor")
    order = ["doc_id"] if whole_doc else ["doc_id", "place"]
    ranked = (
        runs.repartition("anchor")
        .withColumn("_rank", F.rank().over(Window.partitionBy("anchor", "span").orderBy(*order)))
        .withColumn("settled", F.col("settled") | (F.col("_rank") > 1))
        .withColumn("_spans", F.sum(F.when(~F.col("settled"), 1).otherwise(0)).over(group))
    )
    if whole_doc:  # one document alone has nothing to give to another
        ranked = ranked.withColumn("_docs", F.max("doc_id").over(group) > F.min("doc_id").over(group))
    keep = F.col("settled") | ((F.col("_spans") > 1) & (F.col("_docs") if whole_doc else F.lit(True)))
    return (
        ranked.filter(keep)
        .groupBy("doc_id")
        .agg(
            F.collect_list(F.when(F.col("settled"), F.col("place"))).alias("places"),
            F.collect_list(F.when(~F.col("settled"), F.struct("anchor", "place"))).alias("open"),
        )
    )


def lcp(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which share `start` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - ((differ.bit_length() + 7) >> 3) if differ else n


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, tails, before = [], [], b""
    for key in keys:
        n = lcp(before, key, 0)
        shared.append(n)
        tails.append(key[n:])
        before = key
    return shared, tails


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, shared) in key order; shared: bytes in common with the key before.

    A loser tree. Each run's head has the length of its common prefix with the last output; a longer one
    wins unread, equal ones are compared from there on, and the loser keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [tails[0] if tails else None for _, tails in runs] + [None] * (k - len(runs))
    known, index = [0] * k, [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = lcp(x, y, known[a])
        if x[n:] <= y[n:]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    win = build(1)
    while (head := heads[win]) is not None:
        i = index[win]
        yield win, i, known[win]
        shared, tails = runs[win]
        i += 1
        index[win] = i
        if i < len(tails):
            known[win] = shared[i]
            heads[win] = head[: shared[i]] + tails[i]
        else:
            heads[win] = None
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


SORTED = "part long, shared binary, sizes binary, tails binary, left_sizes binary, lefts binary, docs binary, places binary"


def sorted_runs(open_docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at open anchors, cut by part."""

    def emit(records: list) -> pa.RecordBatch:
        records.sort(key=lambda r: r[0])
        cols: list[list] = [[] for _ in range(8)]
        part = [(int.from_bytes(r[0][:8], "big") * parts) >> 64 for r in records]
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = records[a:b]
            shared, tails = front_code([r[0] for r in own])
            row = (
                part[a],
                np.array(shared, "<u2").tobytes(),
                np.array(list(map(len, tails)), "<u2").tobytes(),
                b"".join(tails),
                np.array([len(r[1]) for r in own], "<u2").tobytes(),
                b"".join(r[1] for r in own),
                np.array([r[2] for r in own], "<i8").tobytes(),
                np.array([r[3] for r in own], "<i8").tobytes(),
            )
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
            names=["part", "shared", "sizes", "tails", "left_sizes", "lefts", "docs", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list = []
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for row, doc in enumerate(ids):
                text = texts[row].as_py()
                found = lists[row].values
                hashes = found.field(0).to_numpy(zero_copy_only=False).view(np.uint64).astype(">u8").tobytes()
                for i, place in enumerate(found.field(1).to_pylist()):
                    at, low, high = place >> 16, (place >> 8) & 255, place & 255
                    key = hashes[8 * i : 8 * i + 8] + text[at : at + length - low]
                    records.append((key, text[at - high : at][::-1], doc, place))
                if len(records) >= RUN:
                    yield emit(records)
                    records = []
        if records:
            yield emit(records)

    return open_docs.mapInArrow(run, SORTED)


def cut(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def merged(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, first, last): windows that also start earlier."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        coded = [(np.frombuffer(r["shared"], "<u2").tolist(), cut(r["sizes"], r["tails"])) for r in rows]
        base = np.cumsum([0, *(len(t) for _, t in coded)])
        order, shared = [], []
        for which, i, n in merge(coded):
            order.append(base[which] + i)
            shared.append(n)
        order = np.array(order, np.int64)
        depth = np.array(shared, np.int64) - 8
        doc = np.concatenate([np.frombuffer(r["docs"], "<i8") for r in rows])[order]
        place = np.concatenate([np.frombuffer(r["places"], "<i8") for r in rows])[order]
        lefts = [x for r in rows for x in cut(r["left_sizes"], r["lefts"])]
        width = length - gram
        left = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in lefts), np.uint8).reshape(-1, width)[order]
        times = np.unique(np.rec.fromarrays([doc, place >> 16], names="d,p"), return_inverse=True)[1]
        hit, offset = anchors.settle(
            lambda i: np.cumsum(depth < length - i), lambda i: anchors.BYTES[left[:, i - 1]], (place >> 8) & 255, place & 255, times
        )
        # Places of one document, in the order of documents: a run never crosses to the next.
        ids, which = np.unique(doc[hit], return_inverse=True)
        key, first, last = anchors.ranges(which, (place[hit] >> 16) - offset)
        return pa.table({"doc_id": pa.array(ids[key], pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})

    return runs.groupBy("part").applyInArrow(run, "doc_id long, first long, last long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, places (settled runs) and found (ranges of window starts): what also starts earlier.

    docs: doc_id long without nulls, one for each document, and data binary without nulls.
    """
    if not gram <= length <= gram + 255:
        raise ValueError("length must be from gram to gram + 255")
    marks = cut_lineage(settle_runs(byte_runs(docs, length, gram)))
    n = marks.agg(F.sum(F.size("open"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-n // MERGE))
    # All columns, so that the exchange of the texts is the one that strip() reads again.
    open_docs = marks.filter(F.size("open") > 0).select("doc_id", "open").join(docs, "doc_id").select("doc_id", "data", "open", *docs.columns[2:])
    found = merged(sorted_runs(open_docs, length, parts), length, gram)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return marks.select("doc_id", "places").join(per_doc, "doc_id", "full")


def window_ranges(places: pa.ListScalar, found: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the windows that settled runs and found ranges hold."""
    place = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64)
    first, last = [(place >> 16) - (place & 255)], [(place >> 16) - ((place >> 8) & 255)]
    if found.is_valid:
        first.append(found.values.field(0).to_numpy())
        last.append(found.values.field(1).to_numpy())
    return np.concatenate(first), np.concatenate(last)


def strip(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs) and kept (the remaining bytes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = flat(batch.column(1))
            kept, spans, sizes = [], [], []
            for row in range(batch.num_rows):
                own = data[offsets[row] : offsets[row + 1]]
                places, found = batch.column(2)[row], batch.column(3)[row]
                first, last = window_ranges(places, found)
                sizes.append(len(own))
                if not len(first):
                    kept.append(own.tobytes())
                    spans.append([])
                    continue
                gone = anchors.covered(len(own), first, last, length)
                kept.append(own[~gone].tobytes())
                spans.append(anchors.spans(gone))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = docs.join(marks, "doc_id", "left").select("own_id", "data", "places", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    own = with_node(identified(docs, row_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")))
    own = own.select(F.col("node").alias("doc_id"), "data", F.col("doc_id").alias("own_id"))
    out = strip(own, repeats(own, length), length)
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))


def op2_suffix_merge(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
