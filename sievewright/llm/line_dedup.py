"""Operator 7: near-equal lines, by a segment-partition edit join.

Lines, without the white space around them, are compared by edit distance over code points. Two link if it is at
most the edits allowed to the shorter: one for each EACH code points, EDITS at most. A line of length l that allows e
edits is cut into e + 1 even segments. If another line of length L >= l is within the distance, some segment stands in
it unchanged, at a place that the lengths and the segment's number narrow down to a few starts. So each line is indexed
under (l, number, segment) and probed under the substrings at those starts, for each l from L - EDITS to L. A line's own
index keys are among its probes, so one row with a flag serves both sides.

1. Hashes of lines, segments and substrings come from prefix sums, for a block of text at once. Each task sorts its
   keys, keeps each (key, line) once, and writes them as delta-coded runs by range of the key, so that the exchange
   carries some 14 bytes a key and no row for each.
2. The task of a range passes on only what lines of different content share; of a key it remembers one line until a
   second comes, so a key that very many lines share takes no memory. Only the few lines that are left are read from
   the texts again.
3. Index and probe sides of a key meet a block at a time, with each pair of blocks of a hot key in a group of its own.
   A signature is compared first: neighbouring characters are counted into slots, and EDITS edits change few counts.
   So lines that share long stretches and differ elsewhere make no pairs, and no row is written for them.
4. Pairs are verified by a bit-parallel edit automaton of one bit a diagonal of the band.

Links give classes of lines. The first line of a class (smallest doc_id, then text hash, then place) stays; its other
occurrences go. Blank lines are not compared, and stay. Lines under EACH code points allow no edit: only equal ones
link.

Defined cases: null text has no lines; rows that repeat a doc_id with its text are the same document, and of an id (or
null) with several texts each text is a document; a null doc_id counts as the largest; lines and texts of any length
are compared whole; only the named columns are read, so others may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import LAST_ID, cut_lineage, identified, partitions, tidy
from .graph import components

EDITS = 2
#: Code points of the shorter line for each edit that a pair may have.
EACH = 10
SLOTS = 32
ONE = np.uint64(1)
#: By how much EDITS edits can change the counts in all slots: each puts at most two pairs in place of two.
CHANGED = 4 * EDITS
#: Code points that are hashed at once.
BLOCK = 1 << 18
#: Pairs of a group that are generated together with those of others.
FEW = 64
#: Keys that a task sorts at once, and keys of a range, about.
SORTED, RANGE = 1 << 20, 1 << 20
#: Lines of a key that are compared at once.
GROUP = 4096
#: Places that may be broadcast to the texts.
BROADCAST = 500_000


def allowed(size):
    """Edits that lines of this size (a number or an array) allow."""
    return np.minimum(EDITS, size // EACH)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row, number, line) of whole documents, about a block at a time; the text is the batch's last column."""
    rows, numbers, lines, size = [], [], [], 0
    for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        for i, line in lines_of(text):
            rows.append(row)
            numbers.append(i)
            lines.append(line)
            size += len(line)
        if size >= BLOCK:
            yield rows, numbers, lines
            rows, numbers, lines, size = [], [], [], 0
    if lines:
        yield rows, numbers, lines


class Hashed:
    """Substring hashes of lines."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.size) - self.size
        self.points = points
        self.total = anchors.sums(anchors.mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(anchors.BASE)))
        self.inverse = anchors.powers(len(points) + 1)[1]

    def part(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return anchors.mix((self.total[begin + size] - self.total[begin]) * self.inverse[begin] + size.astype(np.uint64))

    def lines(self) -> np.ndarray:
        return self.part(self.start, self.size)

    def signatures(self) -> list[bytes]:
        """How often pairs of neighbouring code points fall into each slot, modulo 256."""
        pairs = anchors.mix((self.points[:-1].astype(np.uint64) << np.uint64(32)) | self.points[1:])
        line = np.repeat(np.arange(len(self.size)), self.size)
        inner = line[1:] == line[:-1]
        where = line[:-1][inner] * SLOTS + ((pairs[inner] >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)
        counts = np.bincount(where, minlength=len(self.size) * SLOTS)
        return [c.tobytes() for c in counts.astype(np.uint8).reshape(-1, SLOTS)]


def segments(size: np.ndarray, parts: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the segment of this number (from 0), of so many parts of lines of a size; the last are longer."""
    base, longer = size // parts, size % parts
    extra = np.maximum(0, number - (parts - longer))
    return number * base + extra, base + (number >= parts - longer)


def keys_of(h: Hashed, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of the lines of h; the key's lowest bit tells that the line is indexed under it too."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for edits in range(1, EDITS + 1):
        for shorter in range(edits + 1):
            indexed = h.size - shorter
            own = np.flatnonzero((indexed > 0) & (allowed(indexed) == edits))
            if not len(own):
                continue
            size, indexed = h.size[own], indexed[own]
            for number in range(edits + 1):
                place, length = segments(indexed, edits + 1, number)
                left = np.maximum.reduce([place - number, place + shorter - (edits - number), np.zeros_like(place)])
                right = np.minimum.reduce([place + number, place + shorter + (edits - number), size - length])
                for step in range(2 * edits + 1):
                    at = left + step
                    on = np.flatnonzero(at <= right)
                    if len(on):
                        what = h.part(h.start[own[on]] + at[on], length[on])
                        key = anchors.mix(what ^ ((indexed[on].astype(np.uint64) * np.uint64(8) + np.uint64(number)) * np.uint64(anchors.BASE)))
                        both = (at[on] == place[on]) & (shorter == 0)
                        out.append((key & ~ONE | both.astype(np.uint64), ids[own[on]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, copy, number, line (hash) of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, lines in chunks(batch):
                ids, copies = (batch.column(i).take(pa.array(row, pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, copies, pa.array(number, pa.int32()), signed(Hashed(lines).lines())], names=["doc_id", "copy", "number", "line"]
                )

    return docs.mapInArrow(tidy(run), "doc_id long, copy long, number int, line long")


def once(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by key and line, each once; of rows that differ in the flag alone, the flagged one."""
    order = np.lexsort((key, line, key >> ONE))
    key, line = key[order], line[order]
    last = np.append((key[1:] >> ONE != key[:-1] >> ONE) | (line[1:] != line[:-1]), np.ones(min(1, len(key)), bool))
    return key[last], line[last]


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted keys by the bytes of their differences, the high ones, mostly zero, together."""
    return np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def join_keys(docs: DataFrame, parts: int) -> DataFrame:
    """(part, keys, lines): sorted runs of (key, line) by range of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            key, line = once(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rows = [(int(part[a]), pack_keys(key[a:b]), line[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "lines"])

        for batch in batches:
            for _, _, lines in chunks(batch):
                h = Hashed(list(dict.fromkeys(lines)))
                held.append(keys_of(h, h.lines()))
                if sum(len(k) for k, _ in held) >= SORTED:
                    yield emit()
        if held:
            yield emit()

    return docs.select("text").mapInArrow(tidy(run), "part int, keys binary, lines binary")


def shared_keys(runs: DataFrame) -> DataFrame:
    """(key, line, indexed) of the keys that several lines have, perhaps more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        none = np.zeros(0, np.uint64)
        # Keys that one line has had so far, with it; and keys that several have.
        single, several = (none, none), none

        def step() -> pa.RecordBatch:
            nonlocal single, several
            key, line = once(*(np.concatenate(x) for x in zip(single, *held, strict=True)))
            held.clear()
            if not len(key):
                return pa.RecordBatch.from_arrays([signed(none), signed(none), pa.array([], pa.bool_())], names=["key", "line", "indexed"])
            heads = np.flatnonzero(np.append(True, key[1:] >> ONE != key[:-1] >> ONE))
            sizes, names = np.diff(np.append(heads, len(key))), key[heads] >> ONE
            many = (sizes > 1) | np.isin(names, several)
            several = np.union1d(several, names[many])
            out = np.repeat(many, sizes)
            single = key[~out], line[~out]
            return pa.RecordBatch.from_arrays([signed(key[out] >> ONE), signed(line[out]), pa.array((key[out] & ONE).astype(bool))], names=["key", "line", "indexed"])

        for batch in batches:
            for part, keys, lines in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != current:
                    if held:
                        yield step()
                    current, single, several = part, (none, none), none
                held.append((unpack_keys(keys), np.frombuffer(lines, np.uint64)))
                if sum(len(k) for k, _ in held) >= RANGE:
                    yield step()
        if held:
            yield step()

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), "key long, line long, indexed boolean")


def candidates(members: DataFrame, size: int = GROUP) -> DataFrame:
    """(a, b): lines that share a key and have like signatures. members: key, line, indexed, signature.

    Each pair of blocks of up to `size` lines of a key is a group of its own.
    """

    def pairs(line: np.ndarray, block: np.ndarray, indexed: np.ndarray, values: np.ndarray, bounds: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bounds: of the groups; in each the indexed lines come first. one: groups of one block."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def sift(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), 1 << 17):
                a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                apart = np.abs((values[a] - values[b]).view(np.int8).astype(np.int16)).sum(1)
                good = (line[a] != line[b]) & (apart <= CHANGED)
                left.append(line[a[good]])
                right.append(line[b[good]])

        def across(own: np.ndarray, other: np.ndarray) -> None:
            step = max(1, (1 << 17) // max(1, len(other)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                sift(np.repeat(part, len(other)), np.tile(other, len(part)))

        sizes = np.diff(bounds)
        index = np.add.reduceat(indexed.astype(np.int64), bounds[:-1])
        many = index * sizes
        small = np.flatnonzero((many > 0) & (many <= FEW) & one)
        n = many[small]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width, base = np.repeat(sizes[small], n), np.repeat(bounds[small], n)
        sift(base + rank // width, base + rank % width)
        for g in np.flatnonzero((many > FEW) & one).tolist():
            across(np.arange(bounds[g], bounds[g] + index[g]), np.arange(bounds[g], bounds[g + 1]))
        for g in np.flatnonzero(~one & (many > 0)).tolist():
            own = np.arange(bounds[g], bounds[g + 1])
            first = block[own] == block[own].min()
            a, b = own[first], own[~first]
            across(a[indexed[a]], b)
            across(b[indexed[b]], a[~indexed[a]])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, i, j = (rows[c].to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            stop = len(key) if last else new[-1]
            held[:] = rows.slice(stop).to_batches()
            if stop:
                part, bounds = rows.slice(0, stop), np.append(new[new < stop], stop)
                values = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint8).reshape(-1, SLOTS)
                one = (i == j)[bounds[:-1]]
                a, b = pairs(part["line"].to_numpy(), part["block"].to_numpy(), part["indexed"].to_numpy(), values, bounds, one)
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                # Groups are bounded, so what is held is.
                if sum(b.num_rows for b in held) >= 4 * size:
                    yield from flush(False)
        if held:
            yield from flush(True)

    counts = members.groupBy("key").agg(F.max("indexed").alias("some"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")).filter("some")
    own = members.join(counts.drop("some"), "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "line", "indexed", "signature")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("indexed"))
    return ordered.mapInArrow(run, "a long, b long").distinct()


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most `edits`: one bit for each diagonal of the band."""
    if abs(len(a) - len(b)) > edits:
        return False
    n, m = 0, min(len(a), len(b))
    while n < m and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    m = min(len(a), len(b))
    n = 0
    while n < m and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    full = (1 << (2 * edits + 1)) - 1
    # Bit d + edits of state e: with e errors, d more characters of a than of b are read.
    states = [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    for j, c in enumerate(b):
        match = 0
        for d in range(max(-edits, -j), min(edits, len(a) - j - 1) + 1):
            if a[j + d] == c:
                match |= 1 << (d + edits)
        before, last = 0, 0
        for e, state in enumerate(states):
            now = state & match
            if e:
                now |= before | (before >> 1) | ((last << 1) & full)
            before, last, states[e] = state, now, now
        if not states[-1]:
            return False
    return bool(states[-1] >> (len(a) - len(b) + edits) & 1)


def line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(line, text, signature) of wanted (line, doc_id, copy, number)."""
    per_doc = wanted.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("number", "line")).alias("w"))
    if wanted.limit(BROADCAST + 1).count() <= BROADCAST:
        per_doc = F.broadcast(per_doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = text.split("\n")
                for w in want:
                    ids.append(w["line"])
                    texts.append(split[w["number"]].strip())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(Hashed(texts).signatures(), pa.binary())], names=["line", "text", "signature"]
                )

    found = docs.join(per_doc, ["doc_id", "copy"]).select("text", "w").mapInArrow(run, "line long, text string, signature binary")
    return found.dropDuplicates(["line"])


def links_of(docs: DataFrame, first: DataFrame, lines: int) -> DataFrame:
    """(a, b): different lines near enough to each other, once each. first: line, doc_id, copy, number; lines: how many."""
    parts = max(partitions(docs.sparkSession), -(-12 * lines // RANGE))
    shared = shared_keys(join_keys(docs, parts)).groupBy("key", "line").agg(F.max("indexed").alias("indexed"))
    shared = cut_lineage(shared)
    wanted = cut_lineage(shared.select("line").distinct().join(first, "line"))
    texts = cut_lineage(line_texts(wanted, docs))
    pairs = candidates(shared.join(texts.select("line", "signature"), "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = [within(x, y, int(allowed(min(len(x), len(y))))) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("line").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lines (number, class_id, n_links, dropped of each line that isn't blank), kept (the other text), and
    carried, a struct of the columns named in carry."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    whole = identified(docs, row_id, F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("carried"))
    own, place = whole.select("doc_id", "copy", "text"), ("doc_id", "copy", "number")
    places = cut_lineage(occurrences(own))
    first = cut_lineage(places.groupBy("line").agg(F.min(F.struct(*place)).alias("p")).select("line", "p.*"))
    links = cut_lineage(links_of(own, first, first.count()))
    counts = links.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n_links"))
    classes = first.join(components(links).withColumnRenamed("node", "line"), "line", "left").join(counts, "line", "left")
    classes = classes.withColumns({"class_id": F.coalesce("component", "line"), "n_links": F.coalesce("n_links", F.lit(0))})
    stays = classes.groupBy("class_id").agg(F.min(F.struct(*place)).alias("stay"))
    table = classes.select("line", "class_id", "n_links").join(stays, "class_id")
    marked = places.join(table, "line").select(
        "doc_id", "copy", F.struct("number", "class_id", "n_links", (F.struct(*place) != F.col("stay")).alias("dropped")).alias("m")
    )
    per_doc = marked.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("m")).alias("lines"))
    shape = "array<struct<number:int,class_id:long,n_links:long,dropped:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, lines in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gone = {x["number"] for x in lines or () if x["dropped"]}
                kept.append("\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone) if gone else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.string())], names=["doc_id", "lines", "carried", "kept"])

    out = whole.join(per_doc, ["doc_id", "copy"], "left").select("doc_id", F.coalesce("lines", F.array().cast(shape)).alias("lines"), "carried", "text")
    kind = out.schema["carried"].dataType.simpleString()
    return out.mapInArrow(tidy(run), f"doc_id long, lines {shape}, carried {kind}, kept string").withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))


def op7_edit_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["dropped"])).cast("long").alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.transform("lines", lambda x: x["class_id"]).alias("class_ids"),
        F.transform("lines", lambda x: x["n_links"]).alias("n_links"),
    )
