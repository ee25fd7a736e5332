import math

import pytest
from pyspark.sql import functions as F

from sievewright.operators import evaluate as E
from sievewright.operators import index, retrieve


def lists(spark, *rankings):
    return [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(r)], "query_id int, chunk_id string, rank int") for r in rankings]


def test_rrf_order_and_repeats(spark):
    out = retrieve.rrf(lists(spark, ["c", "d"], ["b"])).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["c", "b", "d"]
    out = {r["chunk_id"]: r["score"] for r in retrieve.rrf(lists(spark, ["a", "a", "b"])).collect()}
    assert out == {"a": 1 / 61, "b": 1 / 63}
    with pytest.raises(ValueError):
        retrieve.rrf(lists(spark, ["a"]), k=0)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("c0", "apple pie"), ("c1", "apple pie"), ("c2", "banana split"), ("c3", "zzz rare word here"), ("c4", "plain text")]
    return spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(rows)], "chunk_id string, text string, corpus_idx int")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_ties_zeros_and_repeats(spark, corpus):
    fitted = index.bm25_index(corpus)
    rows = retrieve.bm25_topk(ask(spark, "apple", "apple apple", "nothing"), fitted, 4).orderBy("query_id", "rank").collect()
    got = {q: [(r["chunk_id"], r["score"]) for r in rows if r["query_id"] == q] for q in range(3)}
    assert [c for c, _ in got[0]] == ["c0", "c1", "c2", "c3"]
    assert [s for _, s in got[0]][2:] == [0, 0]
    assert got[1][0][1] == pytest.approx(2 * got[0][0][1])
    assert [c for c, _ in got[2]] == ["c0", "c1", "c2", "c3"]
    avgdl, n = 12 / 5, 5
    idf = math.log(n - 2 + 0.5) - math.log(2.5)
    assert got[0][0][1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avgdl)))


def test_bm25_floor(spark):
    docs = spark.createDataFrame([("a", "x common", 0), ("b", "y common", 1), ("c", "common", 2)], "chunk_id string, text string, corpus_idx int")
    idf = {r["term"]: r["idf"] for r in index.bm25_index(docs).idf.collect()}
    raw = {"x": math.log(2.5) - math.log(1.5), "y": math.log(2.5) - math.log(1.5), "common": math.log(0.5) - math.log(3.5)}
    assert idf["common"] == pytest.approx(0.25 * sum(raw.values()) / 3)


def test_index_round_trip(spark, corpus, tmp_path):
    index.write_bm25(index.bm25_index(corpus), str(tmp_path / "i"))
    again = index.read_bm25(spark, str(tmp_path / "i"))
    assert retrieve.bm25_topk(ask(spark, "rare"), again, 1).first()["chunk_id"] == "c3"


def test_dense_and_hybrid(spark, corpus):
    queries = ask(spark, "rare banana", "").withColumn("embedding", index.hashed_embedding(F.col("query")))
    vectors = index.embed(corpus)
    top = retrieve.dense_topk(queries, vectors, 2).orderBy("query_id", "rank").collect()
    assert len(top) == 4
    assert [r["chunk_id"] for r in top[2:]] == ["c0", "c1"]
    out = retrieve.hybrid(queries, corpus, vectors, index.bm25_index(corpus), k=2).orderBy("query_id", "rank").collect()
    assert {r["chunk_id"] for r in out[:2]} == {"c2", "c3"}
    assert out[0]["score"] == 1.0


def test_sparse_and_array_embeddings_agree(spark, corpus):
    tall = index.hashed_sparse(corpus, "chunk_id").collect()
    arrays = {r["chunk_id"]: r["embedding"] for r in index.embed(corpus).collect()}
    assert all(arrays[r["chunk_id"]][r["bucket"]] == pytest.approx(r["weight"]) for r in tall)


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("c", "q", x, i + 1) for i, x in enumerate(["r1", "r1", "x", "r2", "z"])], "config string, query_id string, chunk_id string, rank int")
    qrels = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("q", "r3"), ("lost", "r9")], "query_id string, chunk_id string")
    out = {(r["query_id"], r["k"]): r for r in E.metrics(ranking, qrels, (1, 3)).collect()}
    assert out["q", 1]["recall"] == 1 / 3
    assert out["q", 3]["recall"] == 2 / 3
    assert out["q", 3]["ndcg"] == pytest.approx(1.5 / (1 + 1 / math.log2(3) + 0.5))
    assert (out["lost", 3]["recall"], out["lost", 3]["ndcg"], out["lost", 3]["rr"]) == (0, 0, 0)
    with pytest.raises(ValueError):
        E.metrics(ranking, qrels, (0,))


def test_bootstrap():
    up = E.paired_bootstrap([0.1, 0.2, 0.3], [0.3, 0.4, 0.5])
    assert up["significant"] and up["ci_low"] == pytest.approx(0.2) and up["ci_high"] == pytest.approx(0.2)
    there, back = E.paired_bootstrap([0, 1, 0.5, 0.2], [1, 0, 0.7, 0.9]), E.paired_bootstrap([1, 0, 0.7, 0.9], [0, 1, 0.5, 0.2])
    assert (there["ci_low"], there["ci_high"]) == pytest.approx((-back["ci_high"], -back["ci_low"]))
    for bad in (dict(n_resamples=10), dict(ci=1.0)):
        with pytest.raises(ValueError):
            E.paired_bootstrap([0, 1], [1, 0], **bad)
    for a, b in (([], []), ([1], [1]), ([1, 2], [1]), ([float("nan"), 1], [1, 1])):
        with pytest.raises(ValueError):
            E.paired_bootstrap(a, b)


def test_guards(spark):
    with pytest.raises(E.CoverageError):
        E.check_coverage(spark.createDataFrame([("x",)], "chunk_id string"), spark.createDataFrame([("y",)], "chunk_id string"))
    with pytest.raises(E.LeakageError):
        E.check_outside("/c/eval/golden.jsonl", "/c")
    E.check_outside("/d/golden.jsonl", "/c")
    with pytest.raises(E.LeakageError):
        E.check_public("/p/", "/p")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "point_id string, v int")
    once = index.upsert(old, new)
    assert sorted(map(tuple, index.upsert(once, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_odd_vectors_and_queries(spark):
    from sievewright.operators import retrieve

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 2.0]), (5, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [0.0, 1.0]), (11, None)], "query_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 6)) for r in retrieve.dense_topk(queries, vectors, 2).collect()}
    assert got == {(10, 1): (4, 1.0), (10, 2): (5, 0.707107), (11, 1): (1, 0.0), (11, 2): (2, 0.0)}
    assert retrieve.dense_topk(queries.limit(0), vectors, 2).count() == 0
    assert retrieve.dense_topk(queries, vectors.limit(0), 2).count() == 0


def test_live_models(spark):
    from pyspark.sql import functions as F

    from sievewright.operators import live

    def embedder():
        return lambda texts: [[float(len(t)), 3.0] for t in texts]

    def model():
        def reply(prompt):
            if "Split the answer" in prompt:
                return "1. it is red\n- it is big\n\n"
            if "follow from the passage" in prompt:
                return "Yes." if prompt.count("red") > 1 else "no"
            if "Write 2 questions" in prompt:
                return "noncommittal" if "don't know" in prompt else "what?\nwhich?\nwho?"
            return "" if "search finds" in prompt else "YES, it does"

        return reply

    rows = spark.createDataFrame([(1, "q", "a", "it is red", "ref", "it"), (2, "q", "I don't know", None, "ref", "it")], "query_id long, query string, answer string, context string, reference_answer string, text string")
    assert [r["v"] for r in rows.select(live.embedding(F.lit("four"), "own", 2, {"own": embedder}).alias("v")).limit(1).collect()] == [[0.8, 0.6]]
    with pytest.raises(ValueError):
        live.embedding(F.lit("x"), "unknown", 2)
    assert {r["relevant"] for r in live.graded(rows, model).collect()} == {True} == {r["correct"] for r in live.judged(rows, model).collect()}
    assert {r["query"] for r in live.rewritten(rows, model).collect()} == {"q"}
    faith = {r["query_id"]: (r["n_statements"], r["n_supported"], r["faithfulness"]) for r in live.faithfulness(rows, model).collect()}
    assert faith[1] == (2, 1, 0.5) and faith[2][0] == 2
    asked = {r["query_id"]: (r["questions"], r["noncommittal"]) for r in live.questions(rows, 2, model).collect()}
    assert asked == {1: (["what?", "which?"], False), 2: ([], True)}


def test_sparse_search_makes_no_rows_of_pairs(spark, corpus):
    fitted = index.bm25_index(corpus)
    found = retrieve.bm25_topk(ask(spark, "apple banana", "rare"), fitted, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "query_id" not in plan.split("RepartitionByExpression", 1)[1]
    assert [(r["query_id"], r["chunk_id"]) for r in found.orderBy("query_id", "rank").collect()][::2] == [(0, "c2"), (1, "c3")]
    queries = ask(spark, "apple").withColumn("embedding", index.hashed_embedding(F.col("query")))
    assert "strategy=broadcast" in retrieve.hybrid(queries, corpus, index.embed(corpus), fitted, k=2)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_answers_are_worked_out_once(spark):
    from sievewright.operators import corrective

    passage = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit("p").alias("rel_path"), F.array().cast("array<string>").alias("heading_path"), F.uuid().alias("text"))
    done = corrective.once(ask(spark, "alpha"), passage)
    assert "uuid" not in done._jdf.queryExecution().optimizedPlan().toString().lower()
    assert done.first()["n_grounded"] == 1
