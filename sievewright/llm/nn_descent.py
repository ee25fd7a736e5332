"""Operator 8: near-duplicate vectors of one label, by NN-descent.

1. Exact copies within a label are one representative, with a count, kept by a 128-bit hash.
2. Every representative starts with neighbours that stand next to it, within its label and a random-hyperplane
   bucket, in the order of a random projection, for several such orders.
3. Rounds of local joins: the neighbours of a vector, in either direction, are compared with each other, and
   each takes over those that are better than its worst. A list whose last entry is still a link is saturated
   and is enlarged. Rounds end when few lists change.
4. The links among the lists give groups, by which each label is ordered and cut into blocks. A pair of blocks is
   compared in full if a list leads from one to the other with a neighbour that lies within two links' angle, but
   for those whose centres and radii rule a link out; so is each block with itself. So links that lists had no room
   for are counted too, and the work grows with the lists, not with the square of a label.
5. AUDIT vectors chosen by a hash are compared with all rows of their labels. If less than GOAL of their links were
   found, further random orders join the lists, and what the audit found is compared as well; other vectors are
   audited then. If ATTEMPTS rounds of this don't reach GOAL, all pairs of blocks that may hold links are compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and those of a null label,
link with nothing; vectors of different sizes don't link; rows that repeat a vec_id with its vector are one vector, and
of an id (or null) with several each is a vector; a null vec_id counts as the largest, and a component of such alone has
a null id; only the named columns are read, so others may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut_lineage, numbered
from .graph import components

log = logging.getLogger(__name__)
THRESHOLD = 0.98
LIST, LARGEST = 12, 48
TABLES, BITS, NEXT = 5, 6, 2
ROUNDS, SETTLED = 5, 0.01
BLOCK = 1024
AUDIT, GOAL, ATTEMPTS = 1000, 0.99, 2
#: Angle by which rounding may be off.
SLACK = 1e-6


def vectors(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """id, label and vec (doubles as binary) of every row; both null where it can't link."""
    own = df.select(
        F.coalesce(F.col(row_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull(), F.lit(False))
    own = own.select("id", F.when(fine, F.concat_ws(":", F.size("v").cast("string"), "label")).alias("label"), F.when(fine, F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.asarray(v.values, "<f8").tobytes() if v.is_valid else None for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    return own.mapInArrow(run, "id long, label string, vec binary")


def unit(values: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def starts(vecs: DataFrame, seed: int) -> DataFrame:
    """(u, v): vectors that are next to each other in random orders of their label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_size.setdefault(len(r["vec"]), []).append(i)
            for size, own in by_size.items():
                x = unit([rows[i]["vec"] for i in own])
                for t in range(TABLES):
                    planes = np.random.default_rng([seed, t, size]).standard_normal((size // 8, BITS + 1))
                    y = x @ planes
                    code = (y[:, :BITS] > 0) @ (1 << np.arange(BITS)) + (t << BITS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[i]["node"] for i in own], pa.int64()), pa.array([rows[i]["label"] for i in own]), pa.array(code, pa.int64()), pa.array(y[:, BITS])],
                        names=["node", "label", "code", "at"],
                    )

    order = Window.partitionBy("label", "code").orderBy("at", "node")
    placed = vecs.mapInArrow(run, "node long, label string, code long, at double")
    near = F.array(*[F.lead("node", i).over(order) for i in range(1, NEXT + 1)])
    placed = placed.withColumn("near", near)
    return placed.select(F.col("node").alias("u"), F.explode("near").alias("v")).filter(F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()


def cosines(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = np.array(list(map(len, a)))
            sim = np.zeros(len(a))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                sim[own] = np.einsum("ij,ij->i", unit([a[i] for i in own]), unit([b[i] for i in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["u", "v", "sim"])

    left = vecs.select(F.col("node").alias("u"), F.col("vec").alias("a"))
    right = vecs.select(F.col("node").alias("v"), F.col("vec").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, sim double")


def best(edges: DataFrame, threshold: float) -> DataFrame:
    """The lists: LIST entries, or up to LARGEST as long as they are links."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(order))
    return ranked.filter((F.col("r") <= LIST) | ((F.col("r") <= LARGEST) & (F.col("sim") >= threshold))).drop("r")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))


def local_join(lists: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim): what neighbours of a vector find in each other that is better than their worst."""
    worst = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("w"))
    bar = F.when(F.col("n") < LIST, F.lit(-2.0)).when((F.col("w") >= threshold) & (F.col("n") < LARGEST), F.lit(threshold)).otherwise(F.col("w"))
    held = vecs.join(worst, vecs["node"] == worst["u"], "left").select("node", "vec", F.coalesce(bar, F.lit(-2.0)).alias("bar"))
    centre = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"))
    around = both_ways(lists).select("u", "v").distinct().withColumn("r", F.row_number().over(centre)).filter(F.col("r") <= 2 * LIST).drop("r")
    groups = around.join(held, around["v"] == held["node"]).groupBy("u").agg(F.collect_list(F.struct("node", "bar", "vec")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for members in batch.column(1):
                own = members.values
                if len(own) < 2:
                    continue
                ids, bars = own.field(0).to_numpy(zero_copy_only=False), own.field(1).to_numpy(zero_copy_only=False)
                x = unit(own.field(2).to_pylist())
                s = x @ x.T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > bars[:, None])
                # The best few of each are enough for a round.
                if len(i) > 6 * len(ids):
                    top = np.argpartition(-s, min(5, len(ids) - 1), axis=1)[:, :6]
                    i, j = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
                    good = s[i, j] > bars[i]
                    i, j = i[good], j[good]
                us.append(ids[i])
                vs.append(ids[j])
                sims.append(s[i, j])
            arrays = [pa.array(np.concatenate(c)) for c in (us, vs, sims)]
            yield pa.RecordBatch.from_arrays(arrays, names=["u", "v", "sim"])

    found = groups.mapInArrow(run, "u long, v long, sim double").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return found.join(lists.select("u", "v"), ["u", "v"], "left_anti")


def descend(edges: DataFrame, vecs: DataFrame, n: int, threshold: float) -> DataFrame:
    lists = cut_lineage(best(both_ways(edges), threshold))
    for _ in range(ROUNDS):
        # What is new comes in once and is counted there.
        fresh = cut_lineage(local_join(lists, vecs, threshold))
        changed = fresh.count()
        lists = cut_lineage(best(both_ways(fresh).unionByName(lists), threshold))
        if changed <= SETTLED * n * LIST:
            break
    return lists


PLACED = "block long, label string, node long, copies long, vec binary, centre binary, radius double"


def placed(reps: DataFrame, groups: DataFrame, n: int, size: int) -> DataFrame:
    """reps in blocks of one label and up to `size` rows, in the order of groups; a block's first row has its centre and radius."""

    def emit(block: int, rows: list[tuple]) -> pa.RecordBatch:
        x = unit([r[3] for r in rows])
        centre = x.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 0.001 * len(x) else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        rest = [None] * (len(rows) - 1)
        cols = [[block] * len(rows), *([r[i] for r in rows] for i in range(4)), [centre.astype("<f8").tobytes(), *rest], [radius, *rest]]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "label", "node", "copies", "vec", "centre", "radius"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and (len(rows) >= size or rows[0][0] != row[0]):
                    yield emit(block, rows)
                    block, rows = block + 1, []
                rows.append(row)
        if rows:
            yield emit(block, rows)

    own = reps.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    order = ["label", "group", "node"]
    own = own.repartitionByRange(max(1, -(-n // (4 * size))), *order).sortWithinPartitions(*order)
    return own.select("label", "node", "copies", "vec").mapInArrow(run, PLACED)


def every_pair(blocks: DataFrame) -> DataFrame:
    """(i, j), i <= j: all blocks of one label."""
    heads = blocks.filter(F.col("centre").isNotNull())
    left, right = heads.select("label", F.col("block").alias("i")), heads.select("label", F.col("block").alias("j"))
    return left.join(right, "label").filter("i <= j").select("i", "j")


def pairs_of(lists: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j: blocks between which lists lead, and each block with itself."""
    twice = float(np.cos(min(2 * np.arccos(np.clip(threshold, -1, 1)) + SLACK, np.pi)))
    own = blocks.select(F.col("node").alias("u"), F.col("block").alias("bu"))
    other = blocks.select(F.col("node").alias("v"), F.col("block").alias("bv"))
    led = lists.filter(F.col("sim") >= twice).select("u", "v").join(own, "u").join(other, "v")
    itself = blocks.filter(F.col("centre").isNotNull()).select(F.col("block").alias("i"), F.col("block").alias("j"))
    return led.select(F.least("bu", "bv").alias("i"), F.greatest("bu", "bv").alias("j")).unionByName(itself).distinct()


def bounded(pairs: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """The pairs of blocks between which links may be."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f8").reshape(batch.num_rows, -1) for c in (2, 3))
                apart = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["i", "j"]).filter(
                    pa.array(apart - batch.column(4).to_numpy() <= reach)
                )

    def run_by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(c) for c in batch.column(2).to_pylist()])
            yield from run(batch.filter(pa.array(sizes == size)) for size in np.unique(sizes))

    heads = blocks.filter(F.col("centre").isNotNull())
    left = heads.select(F.col("block").alias("i"), F.col("centre").alias("a"), F.col("radius").alias("ra"))
    right = heads.select(F.col("block").alias("j"), F.col("centre").alias("b"), F.col("radius").alias("rb"))
    both = pairs.join(left, "i").join(right, "j").select("i", "j", "a", "b", (F.col("ra") + F.col("rb")).alias("r"))
    return both.mapInArrow(run_by_size, "i long, j long")


def audit(blocks: DataFrame, threshold: float, seed: int, size: int = AUDIT) -> DataFrame:
    """(u, i, j, n): how many links `size` vectors u, of block i, have to the rows of block j. Those vectors are sent to all tasks."""
    chosen = blocks.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(size).select("node", "block", "label", "vec").collect()
    by_label: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for label in {r["label"] for r in chosen}:
        own = [r for r in chosen if r["label"] == label]
        by_label[label] = np.array([r["node"] for r in own]), np.array([r["block"] for r in own]), unit([r["vec"] for r in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, block = np.array(batch.column(1).to_pylist(), object), batch.column(0).to_numpy()
            nodes, copies, vecs = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist()
            for label in set(labels) & set(by_label):
                us, at, x = by_label[label]
                own = np.flatnonzero(labels == label)
                for j in np.unique(block[own]):
                    rows = own[block[own] == j]
                    links = x @ unit([vecs[r] for r in rows]).T >= threshold
                    links &= us[:, None] != nodes[rows]
                    n = links @ copies[rows]
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(us[some]), pa.array(at[some]), pa.array(np.full(len(some), j)), pa.array(n[some])], names=["u", "i", "j", "n"])

    rows = blocks.select("block", "label", "node", "copies", "vec").mapInArrow(run, "u long, i long, j long, n long")
    return rows.groupBy("u", "i", "j").agg(F.sum("n").alias("n"))


def share_found(found: DataFrame, truth: DataFrame) -> float:
    """Of the links that an audit found, the share that is among those found before."""
    true = truth.groupBy("u").agg(F.sum("n").alias("true"))
    own = found.filter(F.col("v").isNull()).groupBy("u").agg(F.sum("n").alias("own"))
    sums = true.join(own, "u", "left").agg(F.sum("true").alias("true"), F.sum(F.least("own", "true")).alias("own")).first()
    return (sums["own"] or 0) / sums["true"] if sums["true"] else 1.0


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of links that connect all rows and columns which the links connect."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows_open, cols_open = links.any(1), np.ones(links.shape[1], bool)
    for root in np.flatnonzero(rows_open):
        if not rows_open[root]:
            continue
        rows_open[root] = False
        front = np.array([root])
        while len(front):
            new = links[front] & cols_open
            cols = np.flatnonzero(new.any(0))
            us.append(front[new[:, cols].argmax(0)])
            vs.append(cols)
            cols_open[cols] = False
            new = links[:, cols] & rows_open[:, None]
            front = np.flatnonzero(new.any(1))
            if len(front):
                us.append(front)
                vs.append(cols[new[front].argmax(1)])
            rows_open[front] = False
    return np.concatenate(us), np.concatenate(vs)


def compared(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (u, null, n): n links of u to rows of a block; and rows (u, v, 0): links that connect what all links connect."""

    def run(group: pa.Table) -> pa.Table:
        block, ids, copies = (group[c].to_numpy() for c in ("block", "node", "copies"))
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        x = unit(group["vec"].to_pylist())
        n = np.zeros(len(ids), np.int64)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(links, False)
        else:
            n[b] = copies[a] @ links
        n[a] = links @ copies[b]
        rows, cols = forest(links)
        some = np.flatnonzero(n)
        u, v = np.concatenate([ids[some], ids[a[rows]]]), np.concatenate([np.zeros(len(some), np.int64), ids[b[cols]]])
        counts = np.concatenate([n[some], np.zeros(len(rows), np.int64)])
        return pa.table({"u": u, "v": pa.array(v, mask=np.arange(len(v)) < len(some)), "n": counts})

    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = blocks.select("block", "node", "copies", "vec").join(sides, "block")
    return dealt.groupBy("i", "j").applyInArrow(run, "u long, v long, n long")


def near_vectors(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    vecs = cut_lineage(vectors(df, row_id, vector, label).withColumn("key", F.unhex(F.md5("vec"))))
    each = vecs.filter(F.col("key").isNotNull()).groupBy("label", "key", "id").agg(F.first("vec").alias("vec"))
    reps = each.groupBy("label", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    reps = cut_lineage(numbered(reps, "id", "label", "key"))
    n = reps.count()
    own = reps.select("node", "vec")
    lists = descend(cosines(starts(reps, 1), reps), own, n, threshold)
    linked = lists.filter(F.col("sim") >= threshold)
    groups = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")))
    blocks = cut_lineage(placed(reps, groups, n, block))
    done = cut_lineage(bounded(pairs_of(lists, blocks, threshold), blocks, threshold))
    found = cut_lineage(compared(blocks, done, threshold))
    for attempt in range(1, ATTEMPTS + 2):
        truth = cut_lineage(audit(blocks, threshold, attempt))
        share = share_found(found, truth)
        log.info("NN-descent found %.4f of the links of the audited vectors", share)
        if share >= GOAL:
            break
        if attempt <= ATTEMPTS:
            lists = descend(cosines(starts(reps, attempt + 1), reps).unionByName(lists), own, n, threshold)
            pairs = pairs_of(lists, blocks, threshold).unionByName(truth.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))).distinct()
        else:
            pairs = every_pair(blocks)
        fresh = cut_lineage(bounded(pairs.join(done, ["i", "j"], "left_anti"), blocks, threshold))
        found, done = found.unionByName(cut_lineage(compared(blocks, fresh, threshold))), done.unionByName(fresh)
    comps = components(found.filter(F.col("v").isNotNull()).select(F.col("u").alias("a"), F.col("v").alias("b")))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    results = reps.join(counts, "node", "left").join(comps, "node", "left").select(
        "label", "key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    roots = reps.select(F.col("node").alias("component"), F.col("id").alias("root"))
    out = vecs.select("id", "label", "key").join(results.join(roots, "component"), ["label", "key"], "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.when(F.col("id") < LAST_ID, F.col("id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component < LAST_ID, component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op8_nn_descent(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_vectors(table(spark, sf_dir, "embeddings"))
