"""Operator 1: mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells by source, language and topic. Token weights of the cells are raked until their sums
over each of the three match the targets; then each document is sampled with a probability proportional to its
cell's weight per token, calibrated so that the expected tokens meet the budget with no probability over 1.

Targets may be given; by default they are the corpus's own shares raised to a power per dimension and scaled to
sum to 1, which lifts small sources, languages and topics. Given targets of values that the corpus lacks are
spread over the others; values without a target get none.

Cells are few (sources x languages x topics that occur). Up to CELLS of them the raking runs on the driver's
copy of their sums; beyond, the same steps, with the same test of convergence, are aggregations and joins on the table
of cells. Documents themselves are only read once for counting and once for sampling.

A document's topic is the nearest of TOPICS clusters by the words it has, of LEAST bytes or more, hashed to SLOTS and
weighted by the logarithm of their counts. The clusters are fitted on all documents: their hashed words are written
once, and each step of the fit is a pass over them that adds up whole numbers, so that the clusters don't depend on how
rows are dealt out. Texts without such words have topic -1.

Defined cases: null source or language is a value of its own; null text is empty text, with no words, which is
kept only if the budget covers the corpus; rows that repeat a doc_id are kept or left together, and so are all of a null
one; texts of any length are counted whole; other columns pass through, but for such as have the names of what is added,
which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import cut_lineage, shared_folder, tidy
from .seed_extend import words
from .suffix_dedup import flat

DIMENSIONS = ("source", "lang", "topic")
#: Powers of the corpus's shares that make the default targets.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOPICS, SLOTS, LEAST = 16, 256, 4
#: Rounds of fitting, fewer if a round changes nothing.
ROUNDS = 20
#: Vectors of length 1 are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Vectors that a step of the fit takes at a time.
STEP = 2048
#: Share of the corpus's tokens that is sampled.
BUDGET = 0.5
CELLS = 200_000
STEPS, CLOSE = 200, 1e-9
SEED = "mixture-1"


def term_counts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, weights of hashed words, numbers of words) of the last column's texts, a block at a time. The weights
    are whole numbers, so that what is computed of them doesn't depend on an order of sums."""
    data, offsets = flat(pc.utf8_lower(batch.column(batch.num_columns - 1).fill_null("")))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + anchors.BLOCK, side="right")) - 1)
        base, bounds = offsets[row], offsets[row : last + 1] - offsets[row]
        starts, ends, hashes = words(data[base : offsets[last]], bounds)
        own = np.searchsorted(starts, bounds)
        which = np.repeat(np.arange(last - row), np.diff(own))
        long = ends - starts >= LEAST
        at = which[long] * SLOTS + (hashes[long] >> np.uint64(40)).astype(np.int64) % SLOTS
        counts = np.bincount(at, minlength=(last - row) * SLOTS).reshape(-1, SLOTS)
        yield row, np.rint(16 * np.log1p(counts)), np.diff(own)
        row = last


def nearest(weights: np.ndarray, centres: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The topic of each row of weights, -1 for zeros. Whole numbers under 2**53: exact, so it is the same wherever it is worked out."""
    size = np.rint(np.linalg.norm(weights, axis=1))
    best = np.argmax(1000 * (weights @ centres.T) - size[:, None] * offsets[None, :], axis=1)
    return np.where(size > 0, best, -1)


def units(weights: np.ndarray) -> np.ndarray:
    return np.rint(UNIT * weights / np.linalg.norm(weights, axis=1, keepdims=True))


def passed(vectors: DataFrame, step: Callable[[list, np.ndarray], list]) -> list[list]:
    """What step makes of each task's vectors: it takes what it returned for those before, at first an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
                data = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u2").reshape(-1, SLOTS)
                state = step(state, data.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    return [x for x in (pickle.loads(r["state"]) for r in vectors.mapInArrow(tidy(run), "state binary").collect()) if x]


def topic_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered centres and offsets of TOPICS clusters of all texts, by spherical k-means.

    docs: the texts as the last column.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, weights, _ in term_counts(batch):
                some = weights[weights.any(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in some.astype("<u2")], pa.binary())], names=["x"])

    folder = f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    docs.select(docs.columns[-1]).mapInArrow(tidy(run), "x binary").write.parquet(folder)
    try:
        return fitted(spark.read.parquet(folder))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fitted(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of vectors (x: SLOTS whole numbers, none all zero)."""

    def start(state: list, weights: np.ndarray) -> list:
        """Number, sum, and the first by its numbers."""
        own = [len(weights), units(weights).sum(axis=0), min(map(tuple, weights[np.lexsort(weights.T[::-1])[:1]]))] if len(weights) else []
        return [state[0] + own[0], state[1] + own[1], min(state[2], own[2])] if state and own else state or own

    parts = passed(vectors, start)
    if not parts:
        return np.zeros((1, SLOTS)), np.zeros(1)
    mean = sum(p[1] for p in parts) / sum(p[0] for p in parts) / UNIT
    chosen = np.array([min(p[2] for p in parts)])
    while len(chosen) < TOPICS:  # each next centre is the text that is furthest from those before
        held = units(chosen)

        def furthest(state: list, weights: np.ndarray, held: np.ndarray = held) -> list:
            """Squared distance, and of those as far the first by its numbers."""
            own = units(weights)
            far = ((own**2).sum(axis=1)[:, None] + (held**2).sum(axis=1) - 2 * own @ held.T).min(axis=1)
            at = np.flatnonzero(far == far.max(initial=-1))
            return min([*([state] if state else []), *([-far[i], tuple(weights[i])] for i in at[np.lexsort(weights[at].T[::-1])[:1]])], default=[])

        far, following = min(passed(vectors, furthest))
        if far >= 0:  # no other text is left
            break
        chosen = np.append(chosen, [following], axis=0)
    centres, offsets = rounded(units(chosen) / UNIT - mean, mean)
    for _ in range(ROUNDS):

        def sums(state: list, weights: np.ndarray, centres: np.ndarray = centres, offsets: np.ndarray = offsets) -> list:
            topic, own = nearest(weights, centres, offsets), units(weights)
            member = (topic == np.arange(len(centres))[:, None]).astype(float)
            new = [member.sum(axis=1), member @ own]
            return [a + b for a, b in zip(state, new, strict=True)] if state else new

        parts = passed(vectors, sums)
        n, total = sum(p[0] for p in parts)[:, None], sum(p[1] for p in parts)
        before = centres
        centres, offsets = rounded(np.where(n > 0, total / UNIT - n * mean, centres), mean)
        if np.array_equal(before, centres):
            break
    return centres, offsets


def rounded(centres: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.rint(np.divide(1000 * centres, size, out=np.zeros_like(centres), where=size > 0))
    return centres, np.rint(1000 * centres @ mean)


def described(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Adds topic int and tokens long (words between white space)."""
    keep = [c for c in docs.columns if c not in ("topic", "tokens")]
    shared = docs.sparkSession.sparkContext.broadcast(topic_model(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_described"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, offsets = shared.value
        for batch in batches:
            topics, tokens = [], []
            for _, weights, n in term_counts(batch):
                topics.append(nearest(weights, centres, offsets))
                tokens.append(n)
            if topics:
                arrays = [*batch.columns[:-1], pa.array(np.concatenate(topics).astype(np.int32)), pa.array(np.concatenate(tokens).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "topic", "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_described")).mapInArrow(tidy(run), f"{fields}, topic int, tokens long")


def target_shares(sums: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    wanted = {k: max(0.0, given.get(k, 0.0)) for k in sums} if given else {k: v**power if v > 0 else 0.0 for k, v in sums.items()}
    wanted = {k: v if sums[k] > 0 else 0.0 for k, v in wanted.items()}
    total = sum(wanted.values())
    return {k: v / total for k, v in wanted.items()} if total else wanted


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Weights of cells (summing to 1) whose sums over each dimension match its targets, as near as they can."""
    weights = tokens / max(tokens.sum(), 1)
    for _ in range(steps):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weights, len(target))
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            worst = max(worst, float(np.abs(have - target).max(initial=0)))
            weights = weights * factor[code]
        if worst < CLOSE:
            break
    return weights


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight per token), with c such that the expected tokens are the budget."""
    rate = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    budget = min(budget, float(tokens[rate > 0].sum()))
    order = np.argsort(-rate, kind="stable")
    sure, rest = np.append(0.0, np.cumsum(tokens[order])), np.append(np.cumsum(weights[order][::-1])[::-1], 0.0)
    for i in range(len(order) + 1):  # the first i cells are taken whole
        c = (budget - sure[i]) / rest[i] if i < len(order) and rest[i] > 0 else np.inf
        if i == len(order) or not np.isfinite(c) or c * rate[order[i]] <= 1:
            break
    scale = 0.0 if not np.isfinite(c) else max(c, 0.0)
    out = np.minimum(1.0, scale * rate)
    out[order[:i]] = np.where(rate[order[:i]] > 0, 1.0, 0.0)
    return out


def rake_table(cells: DataFrame, targets: dict[str, DataFrame], steps: int = STEPS) -> DataFrame:
    """rake() for tables of cells too large for the driver: columns of DIMENSIONS, tokens; adds weight."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cut_lineage(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))))
    for _ in range(steps):
        worst = 0.0
        for d in DIMENSIONS:
            # Sums over one dimension are kept, so that each plan is one aggregation and one join deep.
            have = cut_lineage(out.groupBy(d).agg(F.sum("weight").alias("_have")).join(targets[d], d))
            worst = max(worst, have.agg(F.max(F.abs(F.col("_have") - F.col("share")))).first()[0] or 0.0)
            factor = have.select(d, F.when(F.col("_have") > 0, F.col("share") / F.col("_have")).otherwise(0.0).alias("_factor"))
            out = out.join(factor, d).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
        out = cut_lineage(out)
        if worst < CLOSE:
            break
    return out


def cell_rates(cells: DataFrame, budget: float, targets: dict[str, dict[str, float]] | None, limit: int = CELLS) -> DataFrame:
    """cells (DIMENSIONS as strings, tokens) with weight and probability."""
    spark = cells.sparkSession
    targets = targets or {}
    rows = cells.limit(limit + 1).collect()
    if len(rows) > limit:
        return _large_rates(cells, budget, targets)
    tokens = np.array([float(r["tokens"]) for r in rows])
    codes, shares = [], []
    for d in DIMENSIONS:
        names = sorted({r[d] for r in rows})
        at = {x: i for i, x in enumerate(names)}
        code = np.array([at[r[d]] for r in rows], np.int64)
        have = dict(zip(names, np.bincount(code, tokens, len(names)).tolist(), strict=True))
        wanted = target_shares(have, TEMPER[d], targets.get(d))
        codes.append(code)
        shares.append(np.array([wanted[x] for x in names]))
    weights = rake(tokens, codes, shares)
    odds = calibrate(tokens, weights, budget * tokens.sum())
    if budget >= 1 and not targets:
        odds = np.ones(len(rows))
    made = [(*(r[d] for d in DIMENSIONS), float(w), float(p)) for r, w, p in zip(rows, weights, odds, strict=True)]
    return spark.createDataFrame(made, "source string, lang string, topic string, weight double, probability double").coalesce(1)


def _large_rates(cells: DataFrame, budget: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """As cell_rates, with tables in place of arrays."""
    shares = {}
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("n"))
        if d in targets:
            given = cells.sparkSession.createDataFrame(list(targets[d].items()) or [("", 0.0)], f"{d} string, wanted double")
            have = have.join(given, d, "left").withColumn("wanted", F.when(F.col("n") > 0, F.coalesce("wanted", F.lit(0.0))))
        else:
            have = have.withColumn("wanted", F.pow(F.col("n").cast("double"), F.lit(TEMPER[d])))
        total = have.agg(F.sum("wanted")).first()[0] or 1.0
        shares[d] = cut_lineage(have.select(d, (F.col("wanted") / total).alias("share")))
    raked = rake_table(cells, shares)
    if budget >= 1 and not targets:
        return raked.select(*DIMENSIONS, "weight", F.lit(1.0).alias("probability"))
    raked = raked.withColumn("rate", F.coalesce(F.col("weight") / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0)))
    wanted = budget * (raked.agg(F.sum("tokens")).first()[0] or 0)
    low, high = 0.0, 1.0
    expected = lambda c: raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("rate") * c))).first()[0] or 0.0
    most = expected(1e300)
    while expected(high) < min(wanted, most) * (1 - 1e-9) and high < 1e300:
        high *= 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < wanted else (low, middle)
    return raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("rate") * high).alias("probability"))


def sample(
    docs: DataFrame,
    budget: float = BUDGET,
    targets: dict[str, dict[str, float]] | None = None,
    row_id: str = "doc_id",
    seed: str = SEED,
    limit: int = CELLS,
) -> DataFrame:
    """docs (with topic and tokens) with weight (of the row's cell), probability and sampled."""
    named = {d: F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")) for d in DIMENSIONS}
    cells = docs.select(*(c.alias(d) for d, c in named.items()), "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    own = {d: {f"={k}": v for k, v in t.items()} for d, t in (targets or {}).items()}
    rates = cell_rates(cut_lineage(cells), budget, own, limit).select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "weight", "probability")
    small = rates.limit(limit + 1).count() <= limit
    keyed = docs.drop("weight", "probability", "sampled").withColumns({f"_{d}": c for d, c in named.items()})
    joined = keyed.join(F.broadcast(rates) if small else rates, [f"_{d}" for d in DIMENSIONS]).drop(*(f"_{d}" for d in DIMENSIONS))
    # A uniform number from the id alone, so that a lost task samples the same rows again.
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(row_id).cast("string"), F.lit("")))), 1, 12), 16, 10)
    return joined.withColumn("sampled", digits.cast("double") / float(16**12) < F.col("probability"))


def op1_raking(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = described(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    # Counting and sampling both need the words; the texts themselves are read once.
    return sample(cut_lineage(docs.drop("text")))
