"""Text functions as columns; all but normalize() stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of point ids.
POINT_NAMESPACE = "6f9619ff8b86d011b42d00cf4fc964ff"
#: Words that don't count for a shared run.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "in", "is", "it", "its",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
)
#: Phrases of an answer that declines to answer.
REFUSALS = (
    "does not contain", "does not answer", "not contain an answer", "cannot answer", "can't answer", "no answer",
    "i don't know", "i do not know", "unable to answer", "not provide", "no information",
)
#: Beginnings of templated questions.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which", "who")
OVERLAP = 0.6
RUN = 2


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def short_sha(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def doc_id(rel_path: Column) -> Column:
    return short_sha(rel_path)


def chunk_id(rel_path: Column, start: Column, end: Column) -> Column:
    return short_sha(F.concat_ws(":", rel_path, start.cast("string"), end.cast("string")))


def point_id(chunk: Column) -> Column:
    """UUID version 5 of a chunk id in the fixed namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(chunk, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def _normal(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).casefold()).strip()


def _normal_batches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(_normal, na_action="ignore")


def normalize(text: Column) -> Column:
    """Composed, case-folded, white space collapsed. Neither of the first two has a built-in."""
    return F.pandas_udf(_normal_batches, "string")(text)


def normalize_ascii(text: Column) -> Column:
    """The same for ASCII text, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_shingles(words: Column, n: int = RUN) -> Column:
    """Distinct runs of n words once stop words are dropped, each joined by a blank."""
    content = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    out = content
    # Zipped with itself shifted; a slice within a lambda would work out the words anew for each of them.
    for shift in range(1, n):
        rest = F.greatest(F.size(content) - shift, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), rest), F.slice(content, F.lit(shift + 1), rest), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(out)


def statements(text: Column) -> Column:
    """Parts between full stops, exclamation and question marks."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def overlap_fraction(statement: Column, context_tokens: Column) -> Column:
    own = F.array_distinct(tokens(statement))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, context_tokens)), F.size(own)), F.lit(0.0))


def noncommittal(answer: Column) -> Column:
    plain = F.lower(F.regexp_replace(answer, r"(?U)^\s+|\s+$", ""))
    return (plain == "") | F.exists(F.array(*[F.lit(r) for r in REFUSALS]), lambda r: F.contains(plain, r))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; 0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def lexical_f1(reference: Column, candidate: Column) -> Column:
    """F1 of the token sets."""
    a, b = F.array_distinct(tokens(reference)), F.array_distinct(tokens(candidate))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(2.0 * both, F.size(a) + F.size(b)), F.lit(0.0))


def templated_questions(answer: Column, n: int) -> Column:
    words = tokens(answer)
    heads = F.array(*[F.lit(QUESTION_WORDS[i % len(QUESTION_WORDS)]) for i in range(n)])
    asked = F.transform(heads, lambda h: F.concat_ws(" ", h, F.array_join(words, " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(asked)


def faithfulness(supported: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(supported.cast("double"), total), F.lit(0.0))


def grounding(quote: Column, chunk: Column, norm_quote: Column, norm_chunk: Column, quote_tokens: Column, chunk_tokens: Column) -> Column:
    """Struct (grounded, method, reason) of a quote in a chunk; a null chunk isn't in the context."""
    own = F.array_distinct(quote_tokens)
    present = F.size(F.array_intersect(own, chunk_tokens))
    ratio = F.try_divide(present, F.size(own))
    shown = F.format_string("%.2f (%d/%d)", ratio, present, F.size(own))
    shared_run = F.coalesce(F.arrays_overlap(content_shingles(quote_tokens), content_shingles(chunk_tokens)), F.lit(False))

    def verdict(grounded: bool, method: str, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(grounded).alias("grounded"), F.lit(method).alias("method"), reason.alias("reason"))

    return (
        F.when(chunk.isNull(), verdict(False, "chunk_not_in_context", "cited chunk not in context"))
        .when(norm_quote == "", verdict(False, "no_overlap", "empty supporting quote"))
        .when(F.contains(norm_chunk, norm_quote), verdict(True, "normalized_substring", "quote is a normalized substring of the chunk"))
        .when(F.size(own) == 0, verdict(False, "no_overlap", "quote has no comparable tokens"))
        .when(ratio < OVERLAP, verdict(False, "no_overlap", F.concat(F.lit("token overlap "), F.format_string("%.2f", ratio), F.lit(f" < {OVERLAP} ("), shown, F.lit(")"))))
        .when(
            ~shared_run,
            verdict(
                False,
                "no_overlap",
                F.concat(
                    F.lit("token overlap "), shown, F.lit(f" >= {OVERLAP} but no shared contiguous run of {RUN}+ content tokens (likely stop-word padding)")
                ),
            ),
        )
        .otherwise(verdict(True, "token_overlap", F.concat(F.lit("token overlap "), shown, F.lit(f" >= {OVERLAP} with a shared contiguous content run"))))
    )


# Markdown

TAG = r"(?U)(?<!\w)#([A-Za-z0-9_/-]+)"
LINK = r"!?\[\[([^\]]+)\]\]"


def inline_tags(body: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(TAG), 1))
    return F.array_sort(F.filter(found, lambda t: ~t.rlike("^[0-9]+$")))


def link_targets(body: Column) -> Column:
    """Targets of wiki links, without section and block marks."""
    inner = F.regexp_extract_all(body, F.lit(LINK), 1)
    names = F.transform(inner, lambda x: F.trim(F.regexp_extract(F.split(x, r"\|", 2)[0], r"^([^#^]*)", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda t: t != "")))


def render_links(body: Column) -> Column:
    """The alias of a link, or what it points to."""
    aliased = F.regexp_replace(body, r"!?\[\[[^\]|]*\|\s*([^\]\s](?:[^\]]*[^\]\s])?)\s*\]\]", "$1")
    blank_alias = F.regexp_replace(aliased, r"!?\[\[\s*([^\]|]*?)\s*\|\s+\]\]", "")
    return F.regexp_replace(blank_alias, r"!?\[\[\s*([^\]|]*?)\s*\|?\]\]", "$1")


def folder(rel_path: Column) -> Column:
    return F.regexp_extract(rel_path, "^(.*)/[^/]*$", 1)


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 if the line is no heading."""
    return F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})[ \t]", 1))


def judge_model(generator: Column) -> Column:
    """A model of the other kind than the generator's."""
    return F.when(F.contains(F.lower(generator), F.lit("opus")), F.lit("claude-sonnet-4-6")).otherwise(F.lit("claude-opus-4-8"))
