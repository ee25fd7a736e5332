"""Operator 6: near-duplicates by Order MinHash, verified by banded alignment.

Shingles are runs of five words, labelled by their occurrence in the text (the second "a b c d e" differs from
the first), so a text is a set of them without losing repeats. A sketch takes, under each of SKETCHES random
orders, the two least shingles and hashes them in the order in which they stand in the text: two texts agree on
it with the probability that they share both, in the same order. Two sketches side by side make a band; texts
that share a band are candidates.

1. Equal texts are one class, kept by a 128-bit hash; only classes go on, under numbers in the order of their first
   documents.
2. In each bucket of a band the classes are compared by their sketches, a block at a time, and each is paired
   with a hub, the member whose sketch agrees best with the bucket's commonest values, if they agree in FLOOR
   sketches at least; this round never yields more than a pair a member and joins most copies. A second round pairs
   members of different components with the NEAREST most alike. The last round compares all pairs of a bucket, across
   its blocks, that no links join yet, and yields those that agree in FLOOR sketches, but for those that the numbers of
   their shingles, or the parities of shingle counts by slot, keep under the threshold. Both are sure bounds, and close
   ones, so alike texts that aren't near-duplicates are compared but yield next to no pairs.
3. Pairs are verified on the whole texts: shared labelled shingles are aligned in order, within a band around the
   diagonal that any pair over the threshold keeps to; the aligned share is the similarity.

Two texts of similarity s share a band with probability about 1 - (1 - s**4)**12 (0.998 at 0.8).

Defined cases: null text is empty text; empty texts are equal; texts of under five words have one shingle, all their
words, so only equal word sequences link; texts of any length are compared whole; rows that repeat a doc_id with its text
are the same document; of an id (or null) with several texts each text is a document; a null doc_id counts as the
largest; only the named columns are read, so others may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors
from .common import LAST_ID, cut_lineage, identified, numbered, tidy
from .graph import components
from .seed_extend import word_blocks
from .suffix_dedup import flat

K = 5
SKETCHES = 24
ROWS = 2
THRESHOLD = 0.8
#: Equal sketches of SKETCHES that a pair needs to be verified; 15 are expected at similarity 0.8.
FLOOR = 7
NEAREST = 2
#: Members of a bucket that are compared at once; later rounds compare two such blocks.
BLOCK = 2048
#: Bytes of text of one side of a tile of pairs, about, and sides at least.
TILE, SIDE = 1 << 24, 12
#: Texts to be read again whose ids may be broadcast.
BROADCAST = 500_000
SEEDS = anchors.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of texts (bounds of their words), and bounds of those."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], counts)
    ends = np.minimum(starts + k, np.repeat(bounds[1:], counts))
    total, inverse = anchors.sums(hashes), anchors.powers(len(hashes) + 1)[1]
    grams = anchors.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((np.arange(len(grams)), grams, text))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[order[1:]] != grams[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    times = np.arange(len(grams)) - np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    label = np.empty(len(grams), np.uint64)
    label[order] = times.astype(np.uint64)
    return np.where(label > 0, anchors.mix(grams + label * np.uint64(anchors.BASE)), grams), out


def sketch(labelled: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) 32-bit values; every text has a shingle at least."""
    out = np.empty((len(bounds) - 1, SKETCHES), np.uint32)
    heads, sizes = bounds[:-1], np.diff(bounds)
    single = sizes == 1
    for s in range(SKETCHES):
        ranks = (labelled ^ SEEDS[s]) * np.uint64(anchors.BASE)
        ranks ^= ranks >> np.uint64(32)
        first = np.flatnonzero(ranks == np.repeat(np.minimum.reduceat(ranks, heads), sizes))
        least = ranks[first]
        ranks[first] = np.uint64(2**64 - 1)
        second = np.minimum.reduceat(ranks, heads)
        at = np.flatnonzero(ranks == np.repeat(second, sizes))
        # One place a text: of a text of one shingle the masked one.
        at = at[np.append(True, np.searchsorted(bounds, at[1:], side="right") != np.searchsorted(bounds, at[:-1], side="right"))]
        a, b = np.where(first < at, least, second), np.where(first < at, second, least)
        both = anchors.mix(a * np.uint64(anchors.BASE) + b)
        out[:, s] = (np.where(single, anchors.mix(least), both) >> np.uint64(32)).astype(np.uint32)
    return out


def parities(labelled: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each text how many of its shingles fall into each slot, modulo 2, a bit a slot; slots: a power of two, 4 to 8
    times its shingles. Bits in which two texts differ are at most the shingles that only one of them has."""
    sizes = np.diff(bounds)
    slots = np.int64(64) << np.ceil(np.log2(np.maximum(1, sizes / 16))).astype(np.int64)
    starts = np.append(0, np.cumsum(slots))
    at = (labelled >> np.uint64(7)).astype(np.int64) & np.repeat(slots - 1, sizes)
    odd = np.bincount(at + np.repeat(starts[:-1], sizes), minlength=starts[-1]).astype(np.uint8) & 1
    packed, ends = np.packbits(odd, bitorder="little").tobytes(), (starts // 8).tolist()
    return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def differing(parity: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which parities i and j differ, the longer folded to the shorter."""
    out = np.zeros(len(i), np.int64)
    sizes = np.array(list(map(len, parity)))
    width = np.minimum(sizes[i], sizes[j])
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        used = np.unique(np.concatenate([i[own], j[own]]))
        folded = np.empty((len(used), w // 8), np.uint64)
        for k, row in enumerate(used.tolist()):
            folded[k] = np.bitwise_xor.reduce(np.frombuffer(parity[row], np.uint64).reshape(-1, w // 8), axis=0)
        a, b = np.searchsorted(used, i[own]), np.searchsorted(used, j[own])
        step = max(1, (1 << 22) // w)
        for at in range(0, len(own), step):
            part = slice(at, at + step)
            out[own[part]] = np.bitwise_count(folded[a[part]] ^ folded[b[part]]).sum(1)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """key (128-bit hash of the text), doc_id, copy, sketch (none if the text has no words), size (its shingles), parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(3))
            for rows, own, hashes in word_blocks(offsets, data):
                full = np.flatnonzero(np.diff(own) > 0)
                values: list[bytes | None] = [None] * len(rows)
                parity: list[bytes | None] = [None] * len(rows)
                sizes = np.zeros(len(rows), np.int64)
                if len(full):
                    labelled, bounds = shingles(hashes, own)
                    sizes = np.diff(bounds)
                    filled = bounds[np.append(full, len(own) - 1)]
                    for i, value, bits in zip(full.tolist(), sketch(labelled, filled), parities(labelled, filled), strict=True):
                        values[i], parity[i] = value.astype("<u4").tobytes(), bits
                part = batch.slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(values, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parity, pa.binary())],
                    names=["key", "doc_id", "copy", "sketch", "size", "parity"],
                )

    keyed = docs.select(F.unhex(F.md5("data")).alias("key"), "doc_id", "copy", "data")
    return keyed.mapInArrow(tidy(run), "key binary, doc_id long, copy long, sketch binary, size long, parity binary")


BANDS = SKETCHES // ROWS


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) equal sketches."""
    out = np.zeros((len(a), len(b)), np.int8)
    for s in range(SKETCHES):
        out += a[:, s, None] == b[None, :, s]
    return out


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b) of members and hubs to verify, from rows (bucket, node, sketch) of buckets of several nodes."""

    def hub(values: np.ndarray) -> int:
        """The member that agrees most with each sketch's commonest value."""
        score = np.zeros(len(values), np.int64)
        for s in range(SKETCHES):
            _, which, count = np.unique(values[:, s], return_inverse=True, return_counts=True)
            score += count[which] == count.max()
        return int(np.argmax(score))

    def pairs(nodes: np.ndarray, values: np.ndarray, state: dict) -> Iterator[tuple[int, int]]:
        """Of one block of a bucket. state: what earlier blocks of the bucket leave to later ones."""
        if "hub" not in state:
            i = hub(values)
            state |= {"hub": nodes[i], "value": values[i : i + 1]}
        rest = [(state["hub"], state["value"])]
        # Members that the first hub is unlike get hubs of their own, a few in a block.
        open_rows = np.arange(len(nodes))
        for _ in range(4):
            centre, value = rest[-1]
            near = alike(values[open_rows], value)[:, 0] >= FLOOR
            for i in open_rows[near].tolist():
                if nodes[i] != centre:
                    yield centre, nodes[i]
            open_rows = open_rows[~near]
            if len(open_rows) < 2:
                break
            i = open_rows[hub(values[open_rows])]
            rest.append((nodes[i], values[i : i + 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state, out = None, [], {}, []

        def flush(state: dict) -> None:
            if len(held) > 1 or state and held:
                nodes = np.array([h[0] for h in held], np.int64)
                values = np.frombuffer(b"".join(h[1] for h in held), "<u4").reshape(-1, SKETCHES)
                out.extend(pairs(nodes, values, state))
            held.clear()

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([int(min(p)) for p in rows], pa.int64()), pa.array([int(max(p)) for p in rows], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            for bucket, node, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != current:
                    flush(state)
                    current, state = bucket, {}
                elif len(held) >= BLOCK:
                    flush(state)
                held.append((node, value))
            if out:
                yield batch_of(out)
                out.clear()
        flush(state)
        if out:
            yield batch_of(out)

    ordered = buckets.repartition("bucket").sortWithinPartitions("bucket", "node").select("bucket", "node", "sketch")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def open_pairs(buckets: DataFrame, threshold: float, nearest: int | None, size: int = BLOCK) -> DataFrame:
    """(a, b) to verify, a < b: all pairs of a bucket in different components that may reach the threshold.

    With nearest, only so many of the most alike of each member in a pair of blocks; without, all whose parities don't
    rule it out. buckets: rows (bucket, node, sketch, size, component, parity). Each pair of blocks of a bucket is
    compared at once.
    """

    def pairs(held: list) -> pa.RecordBatch:
        block, i, j, parity = np.array([h[0] for h in held]), held[0][5], held[0][6], [h[7] for h in held]
        nodes, sizes, comps = (np.array([h[c] for h in held], np.int64) for c in (1, 3, 4))
        values = np.frombuffer(b"".join(h[2] for h in held), "<u4").reshape(-1, SKETCHES)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(a), 512):
            own = a[at : at + 512]
            good = comps[own, None] != comps[None, b]
            # As in aligned, of which this is the first test.
            need = threshold / (1 + threshold) * (sizes[own, None] + sizes[None, b])
            good &= np.minimum(sizes[own, None], sizes[None, b]) >= need
            if good.any():
                same = np.where(good, alike(values[own], values[b]), 0)
                if nearest is None or nearest >= len(b):
                    x, y = np.nonzero(same >= FLOOR)
                    if nearest is None:
                        bound = (1 - threshold) / (1 + threshold) * (sizes[own[x]] + sizes[b[y]]) + 1e-6
                        some = differing(parity, own[x], b[y]) <= bound
                        x, y = x[some], y[some]
                else:
                    y = np.argpartition(-same, nearest, axis=1)[:, :nearest].ravel()
                    x = np.repeat(np.arange(len(own)), nearest)
                    x, y = x[same[x, y] >= FLOOR], y[same[x, y] >= FLOOR]
                us.append(nodes[own[x]])
                vs.append(nodes[b[y]])
        u, v = np.concatenate(us), np.concatenate(vs)
        found = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if (bucket, *row[5:7]) != current:
                    if len(held) > 1:
                        yield pairs(held)
                    current, held = (bucket, *row[5:7]), []
                held.append(row)
        if len(held) > 1:
            yield pairs(held)

    counts = buckets.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    own = buckets.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "block", "node", "sketch", "size", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "parity")
    key = ["bucket", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two sequences of distinct values: the longest common subsequence over the rest and it.

    Only places within a band around the diagonal count; with a similarity of threshold or more, no aligned
    place is further off it than the values that stay unmatched.
    """
    need = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < need:
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < need:
        return 0.0
    order = np.argsort(at)
    at, to = at[order], to[order]
    band = max(len(a), len(b)) - need + 1
    to = to[np.abs(at - to) <= band]
    if len(to) and np.all(to[1:] > to[:-1]):
        n = len(to)
    else:
        tails: list[int] = []
        for x in to.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        n = len(tails)
    return n / (len(a) + len(b) - n)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose aligned similarity reaches the threshold; texts: node, data.

    Pairs are dealt to tiles by hashes of both ends, so that many pairs of the same texts need each text once a tile.
    """

    def run(own: pa.Table, needed: pa.Table) -> pa.Table:
        a, b = own["a"].to_numpy(), own["b"].to_numpy()
        values: list[np.ndarray] = []
        data, offsets = flat(needed["data"].combine_chunks())
        for _, bounds, hashes in word_blocks(offsets, data):
            labelled, bounds = shingles(hashes, bounds)
            values += [labelled[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        where = {node: k for k, node in enumerate(needed["node"].to_pylist())}
        good = np.zeros(len(a), bool)
        order = np.argsort(a, kind="stable")
        heads = np.flatnonzero(np.append(True, a[order[1:]] != a[order[:-1]]))
        for rows in np.split(order, heads[1:]):
            x = values[where[int(a[rows[0]])]]
            sorted_x = np.sort(x)
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                others = [values[where[int(v)]] for v in b[some]]
                sizes = np.array(list(map(len, others)))
                flat_others = np.concatenate(others)
                found = sorted_x[np.minimum(np.searchsorted(sorted_x, flat_others), len(x) - 1)] == flat_others
                shared = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
                # The shared shingles bound the aligned ones.
                for k in np.flatnonzero(shared >= threshold / (1 + threshold) * (len(x) + sizes)).tolist():
                    good[some[k]] = aligned(x, others[k], threshold) >= threshold
        return pa.table({"a": a[good], "b": b[good]})

    held = texts.agg(F.sum(F.length("data"))).first()[0] or 0
    side = max(SIDE, -(-held // TILE))
    tiled = pairs.select("a", "b", *(F.pmod(F.xxhash64(c), F.lit(side)).alias(t) for c, t in (("a", "i"), ("b", "j"))))
    ends = tiled.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = ends.join(texts, "node").select("ti", "tj", "node", "data")
    return tiled.groupBy("i", "j").cogroup(needed.groupBy("ti", "tj")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, copy (a hash of the text), class_id (the least doc_id that links reach), kept (whether it is that document)."""
    own = identified(docs, row_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    found = cut_lineage(sketches(own))
    first = F.min(F.struct("doc_id", "copy")).alias("f")
    classes = found.groupBy("key").agg(first, F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("parity").alias("parity"))
    classes = cut_lineage(numbered(classes.select("key", "f.*", "sketch", "size", "parity"), "doc_id", "key"))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.expr("sketch").substr(i * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    )
    spread = classes.filter(F.col("sketch").isNotNull()).select("node", F.explode(bands).alias("bucket"))
    crowded = spread.groupBy("bucket").agg((F.min("node") < F.max("node")).alias("many")).filter("many").select("bucket")
    members = cut_lineage(spread.join(crowded, "bucket").join(classes.select("node", "sketch", "size"), "node").select("bucket", "node", "sketch", "size"))
    nodes = cut_lineage(members.select("node").distinct().join(classes.select("node", "doc_id", "copy"), "node"))
    if nodes.limit(BROADCAST + 1).count() <= BROADCAST:
        nodes = F.broadcast(nodes)
    texts = own.join(nodes, ["doc_id", "copy"]).select("node", "data").dropDuplicates(["node"])
    texts = cut_lineage(texts)

    tried = cut_lineage(hub_pairs(members))
    labels = components(verify(tried, texts, threshold))
    group = Window.partitionBy("bucket")
    for nearest in (NEAREST, None):
        joined = members.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c")
        apart = joined.withColumn("open", F.min("component").over(group) < F.max("component").over(group)).filter("open").drop("open")
        apart = apart.join(classes.select("node", "parity"), "node") if nearest is None else apart.withColumn("parity", F.lit(None).cast("binary"))
        pairs = cut_lineage(open_pairs(apart, threshold, nearest, block).join(tried, ["a", "b"], "left_anti"))
        links = cut_lineage(verify(pairs, texts, threshold))
        if not links.isEmpty():
            labels = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        tried = tried.unionByName(pairs)

    roots = classes.select(F.col("node").alias("component"), F.col("key").alias("root"), F.col("doc_id").alias("class_id"))
    by_key = classes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component")).join(roots, "component")
    kept = (F.col("key") == F.col("root")) & (F.col("doc_id") == F.col("class_id"))
    out = found.select("key", "doc_id", "copy").join(by_key, "key").select("doc_id", "copy", "class_id", kept.alias("kept"))
    return out.withColumns({c: F.when(F.col(c) < LAST_ID, F.col(c)) for c in ("doc_id", "class_id")})


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
