"""Operator 5: toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Words that look disguised (digits or signs among letters, letters drawn out, letters set apart) become
   lattices: each sign may stand for itself or for letters it is used for, a star for any letter, a letter
   drawn out for one or two of it, a sign drawn out for up to three letters, and what sets letters apart for nothing.
   Viterbi decoding, over all states, finds the most likely plain word under the trigram model and the costs of the
   channel.
3. The restored text is scored by a logistic model on which words, and beginnings of words, it has. It is
   fitted on at most SAMPLE labelled rows of each label, chosen by a hash of their ids; everything else
   covers all documents.

Defined cases: null and empty text have the score of a text without known words; labels that are null are
left out, of several labels of a document the highest counts, of several texts of an id the first in order is learnt
from; without any labelled rows of both kinds every score is 0; rows that repeat, or have a null id, are each scored;
texts of any length are scored whole; other columns pass through, but for `score`, which is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SAMPLE = {1: 6000, 0: 12000}
FEATURES = 1024
#: Rows of the sample that a feature must be in.
LEAST = 3
PREFIXES = (4, 5)
#: Letters that signs are used for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "abcdefghijklmnopqrstuvwxyz",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = 64
EDGES = ".,;:?!\"'()[]{}<>%&*#~^=/\\-_"
APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+*])(?:[ ._\-/]{1,2}(?:[^\W_]|[@$!|+*])){3,}(?![^\W_])")
DRAWN = re.compile(r"([^\W\d_])\1\1")
#: Costs of the channel, in nats.
SUBSTITUTE, WILD, KEEP_SIGN, DOUBLE = 0.7, 3.0, 9.0, 1.0


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams of all texts; 0 stands for what is between words. The table's size is fixed."""
    table = np.zeros(0x250, np.int64)
    for c, i in INDEX.items():
        table[ord(c)] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                text = "\n\n".join(t for t in batch.column(0).slice(at, 200).to_pylist() if t)
                points = np.frombuffer(f"\n\n{text}\n\n".lower().encode("utf-32-le", "surrogatepass"), "<u4")
                codes = table[np.where(points < len(table), points, 0)]
                total += np.bincount((codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:], minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["code", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3, np.float64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), trigrams interpolated with bigrams and a uniform part."""
    pairs = counts.sum(0)
    bigram = (pairs + 0.1) / (pairs + 0.1).sum(1, keepdims=True)
    weight = 5.0
    smooth = (counts + weight * bigram[None]) / (counts.sum(2, keepdims=True) + weight)
    return -np.log(0.999 * smooth + 0.001 / SIZE).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place the strings it may stand for, with their costs."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        c, n = word[at], 1
        while at + n < len(word) and word[at + n] == c:
            n += 1
        signs = LEET.get(c)
        if c in INDEX:
            out.append([(c, 0.0)] if n == 1 else [(c, 2 * DOUBLE if n == 2 else 0.0), (c * 2, 0.0 if n == 2 else DOUBLE)])
        elif signs:
            cost = WILD if len(signs) > 3 else SUBSTITUTE
            out.extend([*((s, cost) for s in signs), ("", KEEP_SIGN)] for _ in range(min(n, 3)))
        elif c in " ._-/'":
            out.append([("", 0.0)])
        else:
            out.append([("", KEEP_SIGN)])
        at += n
    return out


def decoder(model: np.ndarray) -> Callable[[str], str]:
    memo: dict[str, str] = {}
    costs = model.tolist()

    def decode(word: str) -> str:
        if word in memo:
            return memo[word]
        best = {(0, 0): (0.0, "")}
        for options in lattice(word):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, done) in best.items():
                for letters, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in letters:
                        i = INDEX[c]
                        total += costs[x][y][i]
                        x, y = y, i
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, done + letters)
            best = after
        found = min((cost + costs[a][b][0], done) for (a, b), (cost, done) in best.items())[1]
        if len(memo) > 200_000:
            memo.clear()
        memo[word] = found
        return found

    return decode


def restore(text: str, decode: Callable[[str], str]) -> set[str]:
    """Distinct words of the restored text."""
    lower = text.lower()
    words: set[str] = set()
    for w in set(lower.split()):
        if not w.isalpha():
            core = w.strip(EDGES)
            if not core.isalpha():
                if core and any(c.isalpha() for c in core):
                    words.add(decode(w.strip(".,;:?\"'()[]{}")))
                continue
            if w[0] in LEET or w[-1] in "$@":
                words.add(decode(w))
            w = core
        words.add(w)
    joined = " ".join(words)
    for m in DRAWN.finditer(joined):
        start, stop = joined.rfind(" ", 0, m.start()) + 1, joined.find(" ", m.end())
        words.add(decode(joined[start : stop if stop >= 0 else len(joined)]))
    for m in APART.finditer(lower):
        words.add(decode(m.group()))
    return words


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings, marked by their length."""
    out = {f"={w}" for w in words}
    for n in PREFIXES:
        out |= {f"{n}{w[:n]}" for w in words if len(w) >= n}
    return out


def fit(rows: list[tuple[int, list[int]]], size: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on rows (label, features it has)."""
    x = np.zeros((len(rows), size), np.float32)
    for i, (_, own) in enumerate(rows):
        x[i, own] = 1
    y = np.array([label for label, _ in rows], np.float32)
    share = y.mean()
    each = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    w, b = np.zeros(size, np.float32), np.float32(-1.0)
    m, v = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    for step in range(1, steps + 1):
        gap = (1 / (1 + np.exp(-(x @ w + b))) - y) * each
        g = np.append(x.T @ gap + ridge * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> tuple[dict[str, float], float] | None:
    """Weight of each feature, and the bias. labels: doc_id, toxic of the rows that may be learnt from."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    sample = parts[0].unionByName(parts[1])
    # One text an id, so at most the sample's rows.
    own = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    shared = spark.sparkContext.broadcast(model)

    def bags(batches: Iterator[pa.RecordBatch], only: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
        decode = decoder(shared.value)
        for batch in batches:
            found = [features(restore(t or "", decode)) for t in batch.column(1).to_pylist()]
            if only is not None:
                found = [[only[f] for f in own if f in only] for own in found]
            kind = pa.list_(pa.int32() if only is not None else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(list, found), kind)], names=["toxic", "found"])

    seen = own.mapInArrow(tidy(bags), "toxic int, found array<string>").select("toxic", F.explode("found").alias("f"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    counts = seen.groupBy("f").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    bad, good = (F.col("bad") + 0.5) / (sizes[1] + 1), (F.col("n") - F.col("bad") + 0.5) / (sizes[0] + 1)
    strength = F.abs(F.log(bad / good)) * F.sqrt(F.greatest("bad", F.col("n") - F.col("bad")).cast("double"))
    best = [r["f"] for r in counts.select("f", strength.alias("s")).orderBy(F.desc("s"), "f").limit(FEATURES).collect()]
    at = {f: i for i, f in enumerate(best)}
    rows = own.mapInArrow(lambda batches: bags(batches, at), "toxic int, found array<int>").collect()
    rows = sorted((r["toxic"], sorted(r["found"])) for r in rows)
    weights, bias = fit(rows, len(best))
    return {f: float(w) for f, w in zip(best, weights, strict=True)}, bias


def score(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a score from 0 to 1. labels: doc_id and toxic of the rows to learn from."""
    spark = docs.sparkSession
    own = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    model = language_model(trigrams(own))
    fitted = train(own, labels, model)
    shared = spark.sparkContext.broadcast((model, fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted = shared.value
        decode = decoder(model)
        weights, bias = fitted or ({}, -math.inf)
        by_start: dict[str, list[tuple[str, float]]] = {}
        for f, w in weights.items():
            by_start.setdefault(f[1:5], []).append((f, w))

        def of(t: str) -> float:
            total, words = bias, restore(t, decode)
            near = {w[:4] for w in words} & by_start.keys()
            if near:
                here = features({w for w in words if w[:4] in near})
                total += sum(weights[f] for f in here if f in weights)
            return 1 / (1 + math.exp(-total)) if total > -700 else 0.0

        for batch in batches:
            scores = pa.array([of(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    keep = [c for c in docs.columns if c != "score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col(text).alias("_scored")).mapInArrow(tidy(run), f"{fields}, score double")


def fold(row_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def op5_deobfuscate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    labels = table(spark, sf_dir, "labels").filter(fold() != 0).select("doc_id", "toxic")
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
