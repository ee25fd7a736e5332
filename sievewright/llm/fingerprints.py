"""Operator 3: I-Match fingerprints, with DataFrame functions only.

A text's terms are its distinct lower-case words whose document frequency lies in a band, a fixed share of
the corpus on both sides, which leaves out rare words and the commonest. The terms are sorted, and for each
of several randomised subsets of the lexicon those that are in it are hashed together. Equal hashes for any
subset mean likely near-copies; the share of equal hashes among the subsets that either text has terms in is
the likeness of two texts. Subsets are of three densities, so that both short and long texts have some with
few of their terms.

Document frequencies are counted over all documents. The lexicon's size is bounded whatever the corpus: at
most (distinct words of a mean document) / LOW terms are that frequent. It is broadcast after its size is
checked, else joined by a shuffle.

Defined cases: null text is empty text; a text of any length that has under MIN_TERMS terms in the band uses its
LEAST words of lowest hash in their place, so near-copies agree on most of them; a text without words has no terms in any
subset; equal rows are documents of their own; null ids sort last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions

#: The band of inverse document frequency, ln(1/HIGH) to ln(1/LOW), as shares of the documents.
LOW, HIGH = 0.002, 0.05
MIN_TERMS = 4
#: Words of lowest hash that stand in where the band has too few.
LEAST = 32
#: (subsets, halvings): a term is in a subset of so many halvings with probability 2 to that power, inverse.
SUBSETS = ((8, 4), (24, 6), (32, 8))
TOTAL = sum(n for n, _ in SUBSETS)
#: Subsets whose terms are sifted together first.
GROUP = 8
#: Terms that may be broadcast.
BROADCAST = 2_000_000
#: Bounds of the order of documents, in groups of COARSE.
BOUNDS, COARSE = 4096, 64
NO_TERMS = "...."


def terms(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def membership(h: Column) -> Column:
    """64 bits, one a subset: whether the term of this hash is in it."""
    out, at, mask, used = F.lit(0).cast("long"), 0, F.lit(-1).cast("long"), 0
    for count, halvings in SUBSETS:
        while used < halvings:
            mask, used = mask.bitwiseAND(F.xxhash64(h, F.lit(used))), used + 1
        field = ((1 << count) - 1) << at
        out = out.bitwiseOR(mask.bitwiseAND(F.lit(field - (1 << 64) if field >> 63 else field).cast("long")))
        at += count
    return out


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term_hash and membership of the terms in the band, over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("term_hash")).agg(F.count(F.lit(1)).alias("df"))
    kept = counts.filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return cut_lineage(kept.select("term_hash", membership(F.col("term_hash")).alias("member")))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text of the next document in falling order of doc_id (after the last, the first), the row's
    place (part, row) in that order, and the next row's place. The order is cut at quantiles of doc_id, so each
    part is one window partition of bounded size; the first row of each part is given to the part before too.
    """
    spark = docs.sparkSession
    many = max(1, min(BOUNDS, partitions(spark) * 2))
    shares = [i / many for i in range(1, many)]
    bounds = sorted(set(docs.agg(F.percentile_approx("_id", shares, 20_000)).first()[0] or [])) if shares else []
    # Falling order: the part is the number of bounds above the id, found in two steps.
    falling = bounds[::-1]
    groups = [falling[i : i + COARSE] for i in range(0, len(falling), COARSE)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups]) if groups else F.array().cast("array<long>")
    passed = F.size(F.filter(heads, lambda b: b > F.col("_id")))
    if groups:
        fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        inner = F.size(F.filter(F.element_at(fine, F.greatest(passed, F.lit(1))), lambda b: b > F.col("_id")))
        part = F.when(passed == 0, F.lit(0)).otherwise((passed - 1) * COARSE + inner)
    else:
        part = F.lit(0)
    placed = docs.withColumn("part", part)
    # At most one row a part comes to the driver.
    sizes = {r["part"]: (r["n"], r["first"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("first")).collect()}
    parts = sorted(sizes)
    after = dict(zip(parts, [*parts[1:], *parts[:1]], strict=True))
    before = {b: a for a, b in after.items()}
    given = {sizes[p][1]: before[p] for p in parts}

    def look(table: dict[int, int], size: int) -> Column:
        return F.array(*[F.lit(table.get(i, 0)).cast("int") for i in range(size)])

    top = (parts[-1] + 1) if parts else 1
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(look(before, top), F.col("part") + 1).alias("part"), F.lit(True).alias("guest"))
    spots = F.when(F.col("_id").isin(list(given)), F.array(own, guest)).otherwise(F.array(own)) if given else F.array(own)
    dealt = placed.withColumn("_spot", F.explode(spots)).withColumns({"part": F.col("_spot.part"), "guest": F.col("_spot.guest")}).drop("_spot")
    order = Window.partitionBy("part").orderBy("guest", F.desc("_id"), F.xxhash64("text"))
    counts = F.element_at(look({p: n for p, (n, _) in sizes.items()}, top), F.col("part") + 1)
    ranked = dealt.withColumns({"row": F.row_number().over(order), "next_text": F.lead("text").over(order)}).filter(~F.col("guest"))
    last = F.col("row") == counts
    return ranked.withColumns(
        {
            "next_part": F.when(last, F.element_at(look(after, top), F.col("part") + 1)).otherwise(F.col("part")),
            "next_row": F.when(last, F.lit(1)).otherwise(F.col("row") + 1),
        }
    ).drop("guest")


def least_words(words: Column) -> Column:
    """(h, term) of the LEAST distinct words of lowest hash."""
    return F.slice(F.sort_array(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("term")))), 1, LEAST)


def used_terms(banded: Column, least: Column) -> Column:
    """The sorted (term, member) that are hashed."""
    stand_in = F.transform(least, lambda x: F.struct(x["term"].alias("term"), membership(x["h"]).alias("member")))
    return F.sort_array(F.when(F.size(banded) >= MIN_TERMS, banded).otherwise(stand_in))


def hash_field(h: Column) -> Column:
    return F.right(F.concat(F.lit("000"), F.lower(F.hex(h))), F.lit(4))


def group_hashes(terms_of_group: Column, group: int) -> Column:
    """Hashes of the subsets of one group of GROUP; terms_of_group: a column of those in any of them."""

    def one(k: Column) -> Column:
        own = F.array_join(F.transform(F.filter(terms_of_group, lambda t: F.getbit(t["member"], k) == 1), lambda t: t["term"]), " ")
        return F.when(own == "", F.lit(NO_TERMS)).otherwise(hash_field(F.xxhash64(own, k)))

    none = F.array(*[F.lit(NO_TERMS)] * GROUP)
    subsets = F.sequence(F.lit(group * GROUP), F.lit(group * GROUP + GROUP - 1))
    return F.when(F.size(terms_of_group) == 0, none).otherwise(F.transform(subsets, one))


def of_group(used: Column, group: int) -> Column:
    mask = ((1 << GROUP) - 1) << (group * GROUP)
    mask = mask - (1 << 64) if mask >> 63 else mask
    return F.filter(used, lambda t: t["member"].bitwiseAND(F.lit(mask).cast("long")) != 0)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda p: (p["a"] != NO_TERMS) | (p["b"] != NO_TERMS))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same.cast("double") / F.size(pairs))


def fingerprint(rows: DataFrame, keys: list[str], texts: list[str], lex: DataFrame) -> DataFrame:
    """Adds `<text>_hashes`, the array of subset hashes, for each text column; keys tell rows apart."""
    keep = [c for c in rows.columns if c not in texts]
    rows = rows.withColumns({f"{t}_words": terms(F.col(t)) for t in texts})
    kind = "array<struct<h:bigint,term:string>>"

    def element(side: int, term: Column, least: list[Column]) -> Column:
        return F.struct(F.lit(side).alias("side"), term.alias("term"), *[c.cast(kind).alias(f"least{i}") for i, c in enumerate(least)])

    # A mark of each row, which alone carries its words of lowest hash, and one element for each word.
    mark = F.array(element(-1, F.lit(""), [least_words(F.col(f"{t}_words")) for t in texts]))
    nothing = [F.lit(None)] * len(texts)

    def of_words(side: int, words: Column) -> Column:
        return F.transform(words, lambda w: element(side, w, nothing))

    sides = [of_words(s, F.col(f"{t}_words")) for s, t in enumerate(texts)]
    long = rows.select(*keep, F.explode(F.concat(mark, *sides)).alias("t")).withColumn("term_hash", F.xxhash64("t.term"))
    lex = lex.withColumn("hit", F.lit(True))
    small = lex.limit(BROADCAST + 1).count() <= BROADCAST
    joined = long.join(F.broadcast(lex) if small else lex, "term_hash", "left").filter(F.col("hit") | (F.col("t.side") == -1))
    item = F.struct(F.col("t.side").alias("side"), F.col("t.term").alias("term"), F.col("member"))
    gathered = joined.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("t.side") >= 0, item)).alias("_found"),
        *[F.first(f"t.least{i}", ignorenulls=True).alias(f"{t}_least") for i, t in enumerate(texts)],
        *[F.first(c).alias(c) for c in keep if c not in keys],
    )

    def of_side(s: int) -> Column:
        own = F.filter("_found", lambda x: x["side"] == s)
        return F.transform(own, lambda x: F.struct(x["term"].alias("term"), x["member"].alias("member")))

    # Each step is a column of its own, so that no lambda works one out anew for each element.
    gathered = gathered.withColumns({f"{t}_own": of_side(s) for s, t in enumerate(texts)})
    gathered = gathered.withColumns({f"{t}_used": used_terms(F.col(f"{t}_own"), F.col(f"{t}_least")) for t in texts})
    groups = range(TOTAL // GROUP)
    parts = {f"{t}_group{i}": of_group(F.col(f"{t}_used"), i) for t in texts for i in groups}
    gathered = gathered.withColumns(parts)
    hashes = {f"{t}_hashes": F.concat(*[group_hashes(F.col(f"{t}_group{i}"), i) for i in groups]) for t in texts}
    return gathered.withColumns(hashes).drop("_found", *parts, *(f"{t}_{x}" for t in texts for x in ("own", "used", "least")))


def op3_i_match(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    lex = lexicon(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.expr("substring(text, 1, length(text) - length(text) div 2)")
    rows = (
        with_next(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(kept, F.when(half > 0, F.expr("substring(next_text, 1, cast(length(text) div 2 as int))")).otherwise(F.lit(""))))
        .drop("next_text", "_id")
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    done = fingerprint(rows, ["part", "row"], ["text", "edited"], lex)
    done = cut_lineage(done)
    following = done.select(F.col("part").alias("next_part"), F.col("row").alias("next_row"), F.col("text_hashes").alias("next_hashes"))
    return done.join(following, ["next_part", "next_row"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("text_hashes", "").alias("fingerprint"),
        F.array_join("edited_hashes", "").alias("edited_fingerprint"),
        likeness(F.col("text_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("text_hashes"), F.col("next_hashes")).alias("near_next"),
    )
