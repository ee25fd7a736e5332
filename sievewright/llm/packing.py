"""Operator 10: packing by Karmarkar-Karp multiway differencing.

A document's ids are cut by its own length alone: whole windows of the capacity, then pieces of at
most `grain` ids. Pieces go, by a hash, to groups of about `windows` windows each, so no group grows
with the corpus or with a hot key, and each group is packed in one task. A group starts with the
fewest windows that could hold its pieces; differencing merges the two partial partitions of largest
spread, putting the fullest bins of one on the emptiest of the other, until one is left. Where its
fullest window exceeds the capacity the number of windows rises and the group is packed again.

Defined cases: null text is empty text, which still has its closing id; equal rows are packed each, and so are rows
of a null or repeated doc_id; a text of any length is cut and spread over groups; of other columns none is read, so
their names may clash with any; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, trim

CAPACITY = 2048
GRAIN = 512
WINDOWS = 128
END_ID = 1
#: Distinct words that a Python worker remembers the ids of; beyond it the memory starts anew.
MEMO = 300_000
#: Bytes of text that are encoded together.
PORTION = 1 << 23
#: Letters whose lower case and composition are the same for each character alone, so that chunks
#: between white space can be encoded apart from each other.
PLAIN = r"\A[\t-\r -~¡-įĲ-ňŊ-ž‐-‧‰-⁞]*\z"


def differencing(sizes: list[int], bins: int) -> list[list[int]]:
    """Items of each of `bins` bins (indexes into sizes), by multiway differencing."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, size in enumerate(sizes):
        heap.append((-size if bins > 1 else 0, i, [(size, [i])]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a and b hold their non-zero bins in falling order; what overlaps is added crosswise.
        over = max(0, len(a) + len(b) - bins)
        merged = a[: len(a) - over] + b[: len(b) - over]
        for (x, own), (y, other) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
            merged.append((x + y, own + other))
        merged.sort(key=lambda t: -t[0])
        low = merged[-1][0] if len(merged) == bins else 0
        if low:  # only differences matter from here on
            merged = [(x - low, own) for x, own in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    out = [own for _, own in heap[0][2]] if heap else []
    return out + [[] for _ in range(bins - len(out))]


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of indexes) of one group, none over capacity."""
    total = sum(sizes)
    bins = max(1, math.ceil(total / capacity))
    while True:
        packed = differencing(sizes, bins)
        if max((sum(sizes[i] for i in own) for own in packed), default=0) <= capacity:
            return [own for own in packed if own]
        bins += 1


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their ids, one text after another, and where each begins; special tokens not added.

    Texts of plain letters are encoded by their distinct chunks between white space, and these by their distinct
    words, of which those seen are remembered; all others go to the tokenizer whole. The two agree because the
    tokenizer drops white space and never merges across a word's end.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole: list[Tokenizer] = []  # made when a text needs it
    with open(path) as file:
        spec = json.load(file)
    pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    # The same model on words that are split already, one a line.
    model = Tokenizer.from_file(path)
    model.normalizer = normalizers.Sequence([])
    lines = pre_tokenizers.Split("\n", "removed")
    model.pre_tokenizer = pre_tokenizers.Sequence([lines, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    suffix = spec["model"]["end_of_word_suffix"]
    last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
    last[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
    words = Memory()

    def learn(fresh: list[str]) -> None:
        parts = ["\n".join(fresh[at : at + 512]) for at in range(0, len(fresh), 512)]
        found = [np.array(e.ids, np.uint32) for e in model.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        words.add(fresh, ids, np.flatnonzero(last[ids]) + 1)

    def chunk_ids(seen: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one chunk after another, and where each begins."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(seen, f"({pattern})", r"\1 "))
        coded = pc.list_flatten(split).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(words.at) + len(names) > MEMO:
            words.clear()
        learn([w for w in names if w and w not in words.at])
        ids, ends = words.gather(words.find(names)[coded.indices.to_numpy()])
        return ids, np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(texts, PLAIN)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        split = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(plain, texts, "")))
        coded = pc.list_flatten(split).dictionary_encode()
        own, bounds = chunk_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        ids, ends = gather(own, bounds, which)
        heads = np.append(0, np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy())])
        if len(odd):
            lists = [ids[a:b] for a, b in zip(heads[:-1], heads[1:], strict=True)]
            if not whole:
                whole.append(Tokenizer.from_file(path))
            found = whole[0].encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
            for i, encoding in zip(odd.tolist(), found, strict=True):
                lists[i] = np.array(encoding.ids, np.uint32)
            ids, heads = np.concatenate(lists), np.append(0, np.cumsum(list(map(len, lists))))
        return ids, heads

    return encode


def gather(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of flat, one after another (none for -1), and where each ends."""
    sizes = np.where(which < 0, 0, bounds[which + 1] - bounds[which])
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(bounds[which] - ends + sizes, sizes)], ends


class Memory:
    """Ids of strings, kept side by side."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def clear(self) -> None:
        self.at.clear()

    def add(self, fresh: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, used = len(self.at), int(self.bounds[len(self.at)])
        while n + len(fresh) >= len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros_like(self.bounds))
        while used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(fresh)] = used + ends
        self.at.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def find(self, names: list[str]) -> np.ndarray:
        """Where the names are; -1 for the empty one."""
        return np.fromiter((self.at.get(x, -1) for x in names), np.int64, len(names))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one entry after another, and where each ends."""
        return gather(self.flat, self.bounds, which)


_ENCODERS: dict[str, Callable] = {}


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch (id, text) of about PORTION bytes of text together; a longer text alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + PORTION, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < n:
        step = min(grain, n - at)
        out.append((at, step))
        at += step
    return out


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = word_encoder(path)
        encode, end = _ENCODERS[path], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in portions(batch):
                cols: list[list] = [[], [], [], [], [], []]
                found, heads = encode(part.column(1).fill_null(""))
                raw = found.astype("<u4").tobytes()
                for doc, head, stop in zip(part.column(0).to_pylist(), heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                    ids = raw[4 * head : 4 * stop] + end
                    n = len(ids) // 4
                    for start, length in cuts(n, capacity, grain):
                        own = ids[4 * start : 4 * (start + length)]
                        for col, value in zip(cols, (doc, start, length, zlib.crc32(own), n, own), strict=True):
                            col.append(value)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                del found, raw, cols
                trim()  # or the many strings of a portion keep memory from the next
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)


def pack(found: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, groups: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...)."""
    if groups is None:
        total = found.agg(F.sum("length")).first()[0] or 0
        groups = max(1, round(total / (capacity * windows)))
    names = [c for c in found.columns if c not in ("sequence_id", "offset", "packing_group")]
    dealt = found.select(*names).withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        sizes = group["length"].to_pylist()
        base = group["packing_group"][0].as_py() << 24
        window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        small = [i for i, x in enumerate(sizes) if x < capacity]
        full = [[i] for i, x in enumerate(sizes) if x >= capacity]
        packed = pack_group([sizes[i] for i in small], capacity) if small else []
        for w, own in enumerate([*full, *([small[i] for i in sorted(x)] for x in packed)]):
            at = 0
            for i in own:
                window[i], offset[i] = base + w, at
                at += sizes[i]
        return group.select(names).append_column("sequence_id", pa.array(window)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*names).schema)
    return dealt.groupBy("packing_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def op10_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import cut_lineage, table

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    # Kept, so that counting the tokens and packing them tokenize once.
    found = cut_lineage(found)
    return pack(found).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
