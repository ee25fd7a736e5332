"""Folders of documents, labelled queries, and stored indexes as DataFrames."""

from __future__ import annotations

import io
import json
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import frontmatter

log = logging.getLogger(__name__)
#: What is read, by suffix, and which folders aren't.
MARKDOWN, PLAIN, PDF, DOCX = ("md", "markdown"), ("txt",), ("pdf",), ("docx",)
HIDDEN = (".obsidian", ".trash", ".git")
DESCRIBED = "struct<body:string,frontmatter:string,title:string,tags:array<string>>"


def accepted(rel_path: Column) -> Column:
    """Known suffixes outside hidden folders; the file's own name may begin with a dot."""
    folders = F.slice(F.split(rel_path, "/"), 1, F.size(F.split(rel_path, "/")) - 1)
    return F.lower(F.regexp_extract(rel_path, r"[^/.][^/]*\.([^./]+)$", 1)).isin(*MARKDOWN, *PLAIN, *PDF, *DOCX) & ~F.exists(folders, lambda p: p.startswith("."))


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that aren't become U+FFFD, line ends become newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def _binary_text(kinds: pd.Series, contents: pd.Series) -> pd.Series:
    def one(kind: str, content: bytes) -> str | None:
        try:
            if kind == "pdf":
                from pypdf import PdfReader

                return "\n\n".join((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages)
            if kind == "docx":
                from docx import Document

                return "\n\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs if p.text.strip())
        except Exception as fault:  # no reader, or any of what readers raise at damaged files
            log.warning("skipped a %s file: %r", kind, fault)
        return None

    return pd.Series([one(k, c) for k, c in zip(kinds, contents, strict=True)], dtype=object)


def binary_text(kind: str, content: str) -> Column:
    """Text of PDF and DOCX files, or null where there is no reader for them or they are damaged."""
    return F.pandas_udf(_binary_text, "string")(kind, content)


def _described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([frontmatter.describe(t or "") for t in s], columns=["body", "frontmatter", "title", "tags"])


def described(text: str) -> Column:
    """Front matter split off and read."""
    return F.pandas_udf(_described, DESCRIBED)(text)


def _first_heading(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: frontmatter.first_heading(b or ""))


def first_heading(body: str) -> Column:
    return F.pandas_udf(_first_heading, "string")(body)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source_path, rel_path, title, text, folder, tags, wikilinks, frontmatter, source_format of a folder's files.

    Rows come in no order; order_by_path() gives the order of the corpus. Files are filtered by path before they are
    read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # The path is cut behind the folder's own, however it was written.
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    rows = files.select("path", F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("plain"), "content")
    plain_root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file:///") else root
    cut = F.when(F.startswith("plain", F.lit(plain_root)), F.substring(F.col("plain"), F.lit(len(plain_root) + 1), F.length("plain")))
    rows = rows.withColumn("rel_path", F.coalesce(cut, F.substring(F.col("plain"), F.lit(len(root) + 1), F.length("plain"))))
    rows = rows.filter(accepted(F.col("rel_path"))).withColumn("kind", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
    stem = F.regexp_replace(F.regexp_extract("rel_path", "([^/]+)$", 1), r"\.[^.]+$", "")
    is_text = F.col("kind").isin(*MARKDOWN, *PLAIN)
    rows = rows.select("plain", "rel_path", "kind", stem.alias("stem"), is_text.alias("is_text"), "content")
    text = rows.filter("is_text").withColumn("raw", decoded(F.col("content"))).drop("content")
    other = rows.filter("not is_text").withColumn("raw", binary_text("kind", "content")).drop("content").filter(F.col("raw").isNotNull())
    markdown = text.filter(F.col("kind").isin(*MARKDOWN)).withColumn("d", described("raw"))
    markdown = markdown.withColumns({"body": T.render_links(F.col("d.body")), "links": T.link_targets(F.col("d.body"))})
    md = markdown.select(
        *_common("markdown"),
        F.coalesce("d.title", first_heading("body"), "stem").alias("title"),
        F.col("body").alias("text"),
        F.array_sort(F.array_distinct(F.filter(F.concat("d.tags", T.inline_tags(F.col("body"))), lambda t: (t != "") & ~t.rlike("^[0-9]+$")))).alias("tags"),
        F.col("links").alias("wikilinks"),
        F.col("d.frontmatter").alias("frontmatter"),
    )
    bare = text.filter(F.col("kind").isin(*PLAIN)).unionByName(other)
    none = F.array().cast("array<string>")
    rest = bare.select(*_common(None), F.col("stem").alias("title"), F.col("raw").alias("text"), none.alias("tags"), none.alias("wikilinks"), F.lit("{}").alias("frontmatter"))
    return md.unionByName(rest)


def _common(kind: str | None) -> list[Column]:
    fmt = F.lit(kind) if kind else F.when(F.col("kind") == "txt", F.lit("text")).otherwise(F.col("kind"))
    return [T.doc_id(F.col("rel_path")).alias("doc_id"), F.col("plain").alias("source_path"), "rel_path", T.folder(F.col("rel_path")).alias("folder"), fmt.alias("source_format")]


def order_by_path(df: DataFrame) -> DataFrame:
    """In the order of path components, which isn't that of the paths as strings."""
    return df.orderBy(F.split("rel_path", "/"))


def with_corpus_index(chunks: DataFrame) -> DataFrame:
    """Adds corpus_idx: the order of the corpus as a value that sorts, without ranking all rows in one task."""
    return chunks.withColumn("corpus_idx", F.struct(F.split("rel_path", "/").alias("path"), F.col("ordinal")))


GOLDEN = "golden_idx int, query_id string, query string, relevant_chunk_ids array<string>, reference_answer string"


def parse_golden(text: str) -> tuple[list[tuple], list[str]]:
    """The rows without faults, and all faults by line."""
    rows, faults, seen = [], [], {}
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        try:
            item = json.loads(line)
            ids = item["relevant_chunk_ids"]
            row = (len(rows), str(item["query_id"]), str(item["query"]), [str(x) for x in ids], item.get("reference_answer"))
        except (ValueError, KeyError, TypeError) as fault:
            faults.append(f"line {number}: {fault!r}")
            continue
        if not ids or len(set(ids)) < len(ids):
            faults.append(f"line {number}: relevant ids must be some, and each once")
        elif row[1] in seen:
            faults.append(f"line {number}: query {row[1]} is on line {seen[row[1]]} already")
        else:
            seen[row[1]] = number
            rows.append(row)
    if not rows and not faults:
        faults.append("no queries")
    return rows, faults


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """golden_idx, query_id, query, relevant_chunk_ids, reference_answer, in the file's order. Any fault is an error.

    A golden set is a small hand-made file, so it is read whole, and errors name the line.
    """
    rows, faults = parse_golden(get(spark, path) or "")
    if faults:
        raise ValueError(f"{path}, {faults[0]}")
    return spark.createDataFrame(rows, GOLDEN)


def golden_faults(spark: SparkSession, path: str, chunks: DataFrame) -> list[str]:
    """Every fault of a golden set: of its lines, then labels that name no chunk. None means that it is valid."""
    rows, faults = parse_golden(get(spark, path) or "")
    labels = spark.createDataFrame(rows, GOLDEN).select("golden_idx", "query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    lost = labels.join(chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("golden_idx", "query_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    return faults + [f"query {r['query_id']}: no chunk {', '.join(r['ids'])}" for r in lost.orderBy("golden_idx").collect()]


def review_golden(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """golden_idx, query_id, query, reference_answer, pos, chunk_id, rel_path, snippet of each label, to be read by eye.

    The snippet is the whole passage on one line; it and rel_path are null where there is no such chunk.
    """
    labels = golden.select("golden_idx", "query_id", "query", "reference_answer", F.posexplode("relevant_chunk_ids").alias("pos", "chunk_id"))
    snippet = F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("snippet")
    return labels.join(chunks.select("chunk_id", "rel_path", snippet), "chunk_id", "left").select(*labels.columns, "rel_path", "snippet")


# Small files


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put(spark: SparkSession, path: str, content: str) -> None:
    fs, place = _at(spark, path)
    stream = fs.create(place, True)
    stream.write(bytearray(content.encode()))
    stream.close()


def get(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def delete_others(spark: SparkSession, folder: str, kept: set[str | None]) -> None:
    """Deletes the folders within a folder, but for those kept."""
    fs, place = _at(spark, folder)
    names = {k.rstrip("/").rsplit("/", 1)[-1] for k in kept if k}
    for status in fs.listStatus(place):
        if status.isDirectory() and status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("nothing stored at %s", path)
        return spark.createDataFrame([], schema)
