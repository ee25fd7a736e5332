"""Cutting documents into chunks: spans first, then ids and texts by built-in functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What texts are split at, in this order; a separator stays with what is before it.
SEPARATORS = ("\n\n", "\n", ". ", " ")
STRATEGIES = ("fixed", "recursive", "semantic")
Span = tuple[int, int]


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be from 0 to below the size {size}, got {overlap}")


def pieces(text: str, base: int, target: int, level: int = 0) -> list[Span]:
    """Contiguous spans of at most target characters, split at the first separator that is fine enough."""
    n = len(text)
    if n <= target:
        return [(base, base + n)] if n else []
    if level == len(SEPARATORS):
        return [(base + i, base + min(i + target, n)) for i in range(0, n, target)]
    out: list[Span] = []
    mark, at = SEPARATORS[level], 0
    while at < n:
        found = text.find(mark, at)
        stop = n if found < 0 else found + len(mark)
        out += pieces(text[at:stop], base + at, target, level + 1)
        at = stop
    return out


def packed(parts: list[Span], target: int) -> list[Span]:
    """Neighbours joined as long as they fit."""
    out: list[Span] = []
    for start, end in parts:
        if out and end - out[-1][0] <= target:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def overlapped(spans: list[Span], size: int, overlap: int) -> list[Span]:
    """Each span reaches back, but not to where the one before it (as it is by then) begins, nor beyond the size."""
    out: list[Span] = []
    for start, end in spans:
        back = min(overlap, start - out[-1][0] - 1, size - (end - start)) if out else 0
        out.append((start - max(0, back), end))
    return out


def recursive_spans(text: str, size: int, overlap: int, base: int = 0) -> list[Span]:
    target = max(1, size - overlap)
    return overlapped(packed(pieces(text, base, target), target), size, overlap)


def short_spans(text: str, size: int) -> list[Span] | None:
    """Spans of blank and short texts, None for others."""
    if not text.strip():
        return []
    return [(0, len(text))] if len(text) <= size else None


def level_of(line: str) -> int:
    bare = line.lstrip(" ")
    marks = len(bare) - len(bare.lstrip("#"))
    return marks if len(line) - len(bare) <= 3 and 1 <= marks <= 6 and bare[marks : marks + 1] in (" ", "\t") and bare[marks:] else 0


def sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, headings above and of it) of the parts between headings; headings in code fences don't count."""
    out: list[tuple[int, int, list[str]]] = []
    stack: list[tuple[int, str]] = []
    start, at, fenced = 0, 0, False
    path: list[str] = []
    for line in text.split("\n"):
        bare = line.lstrip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (level := level_of(line)):
            if at > start:
                out.append((start, at, path))
            stack = [s for s in stack if s[0] < level]
            stack.append((level, bare.lstrip("#").strip()))
            start, path = at, [name for _, name in stack]
        at += len(line) + 1
    if len(text) > start:
        out.append((start, len(text), path))
    return out


def spans_of(text: str, strategy: str, size: int, overlap: int) -> list[dict]:
    if strategy == "semantic":
        if not text.strip():
            return []
        out = []
        for start, end, path in sections(text):
            own = [(start, end)] if end - start <= size else recursive_spans(text[start:end], size, overlap, start)
            out += [{"start": a, "end": b, "heading_path": path} for a, b in own]
        return out
    short = short_spans(text, size)
    found = recursive_spans(text, size, overlap) if short is None else short
    return [{"start": a, "end": b, "heading_path": []} for a, b in found]


SPANS = "array<struct<start:int,end:int,heading_path:array<string>>>"


def fixed_spans(text: Column, size: int, overlap: int) -> Column:
    """Windows at a stride of size - overlap, as a column."""
    n, stride = F.length(text), size - overlap
    last = F.ceil((n - size) / F.lit(stride)).cast("int")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: i * stride))
    spans = F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), F.array().cast("array<string>").alias("heading_path")),
    )
    return F.when(F.regexp_replace(text, r"(?U)\s+", "") == "", F.array().cast(SPANS)).otherwise(spans)


def spans(text: Column, strategy: str, size: int, overlap: int) -> Column:
    check(size, overlap)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy == "fixed":
        return fixed_spans(text, size, overlap)

    @F.pandas_udf(SPANS)
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda t: spans_of(t or "", strategy, size, overlap))

    return folded(text)


def chunk(docs: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of documents (rel_path, text, ...). Only spans cross over to Python; ids and texts are cut in the JVM."""
    found = docs.select("*", F.posexplode(spans(F.col("text"), strategy, size, overlap)).alias("ordinal", "span"))
    start, end = F.col("span.start"), F.col("span.end")
    return found.select(
        T.chunk_id(F.col("rel_path"), start, end).alias("chunk_id"),
        T.doc_id(F.col("rel_path")).alias("doc_id"),
        *[F.col(c) for c in docs.columns if c not in ("text", "chunk_id", "doc_id", "ordinal", "start", "end", "heading_path")],
        "ordinal",
        F.substring(F.col("text"), start + 1, end - start).alias("text"),
        start.alias("start"),
        end.alias("end"),
        F.col("span.heading_path").alias("heading_path"),
        F.lit(strategy).alias("strategy"),
    )
