"""Stores, reports, guards, golden sets, and live models in the engine."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.operators import answer as A
from sievewright.operators import corrective as R
from sievewright.operators import evaluate
from sievewright.operators.store import VectorStore
from sievewright.plans.engine import Engine
from sievewright.settings import Settings
from sievewright.sources import files


@pytest.mark.parametrize("kind", ["path", "view"])
def test_store(spark, tmp_path, kind):
    store = VectorStore.in_memory(spark) if kind == "view" else VectorStore(spark, path=str(tmp_path / "s"))
    store.ensure()
    assert store.count() == 0
    rows = spark.createDataFrame([("a", "one", [1.0, 0.0]), ("b", "two", [0.0, 1.0])], "chunk_id string, text string, embedding array<double>")
    for _ in range(2):
        store.upsert(rows)
    store.upsert(rows.filter("chunk_id = 'a'").withColumn("text", F.lit("new")))
    assert store.count() == 2
    found = store.search(spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<double>"), 1).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in found] == [("q", "b", 1)]
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "chunk_id string")
    assert [(r["chunk_id"], r["text"], r["ordinal"]) for r in store.payloads(ids).collect()] == [("a", "new", None)]
    with pytest.raises(ValueError):
        store.upsert(rows.withColumn("embedding", F.array(F.lit(1.0))))
    store.ensure()
    assert store.count() == 0


def test_store_is_in_one_place(spark, tmp_path):
    for places in ({}, {"path": "a", "view": "b"}):
        with pytest.raises(ValueError):
            VectorStore(spark, **places)
    with pytest.raises(ValueError):
        VectorStore(spark, path=str(tmp_path / "none")).count()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")
    (top / "corpus").mkdir()
    for name, body in {"a.md": "Zebras eat grass in the wide plains.", "b.md": "Lions hunt zebras at night.", "c.txt": "Whales sing long songs."}.items():
        (top / "corpus" / name).write_text(body)
    settings = Settings(corpus_dir=str(top / "corpus"), index_dir=str(top / "index"), eval_dir=str(top / "eval"), resamples=1000)
    engine = Engine(spark, settings)
    engine.build()
    chunks = {r["rel_path"]: r["chunk_id"] for r in engine.load()[0].collect()}
    asked = [("q1", "what do zebras eat", "a.md", "Zebras eat grass."), ("q2", "what do whales sing", "c.txt", None)]
    golden = [json.dumps({"query_id": i, "query": q, "relevant_chunk_ids": [chunks[p]], "reference_answer": r}) for i, q, p, r in asked]
    (top / "golden.jsonl").write_text("\n".join(golden))
    return engine, top


@pytest.mark.parametrize("kind", ["retrieval", "attribution", "quality", "corrective"])
def test_report(spark, built, kind):
    engine, top = built
    report = engine.report(kind, str(top / "golden.jsonl"))
    path = report.write(spark, engine.settings.eval_dir)
    written = json.loads(files.get(spark, path))
    assert written["provenance"]["n_queries"] == 2 and not written["provenance"]["publishable"] and not written["provenance"]["single_run"]
    assert written["provenance"]["corpus_sha256"] == engine.recorded()["corpus_sha256"]
    assert report.json() == files.get(spark, path)
    assert len(written["per_query"]) == {"retrieval": 32}.get(kind, 2)
    assert "Not for publication" in report.render()
    if kind == "attribution":
        assert written["summary"][0]["micro"] == 1.0
    if kind == "corrective":
        assert [r["a_recall"] for r in written["recall"]] == [1.0] * 3 and written["summary"][0]["n_judged"] == 1


def test_guards(spark, built):
    engine, top = built
    golden = str(top / "golden.jsonl")
    inside = top / "corpus" / "golden.jsonl"
    inside.write_text((top / "golden.jsonl").read_text())
    try:
        with pytest.raises(evaluate.LeakageError):
            engine.report("retrieval", str(top / "corpus" / ".." / "corpus" / "golden.jsonl"))
    finally:
        inside.unlink()
    private = Engine(spark, engine.settings.but(private_corpus_dir=str(top / "index" / ".." / "corpus")))
    with pytest.raises(evaluate.LeakageError):
        private.report("retrieval", golden)
    (top / "lost.jsonl").write_text('{"query_id": "q", "query": "x", "relevant_chunk_ids": ["nowhere"]}')
    with pytest.raises(evaluate.CoverageError):
        engine.report("attribution", str(top / "lost.jsonl"))
    with pytest.raises(ValueError):
        engine.report("speed", golden)


def test_live_models_are_recorded(spark, built):
    engine, top = built

    def corrector():
        return lambda prompt: "yes" if "Does the passage" in prompt else "zebras"

    def judge():
        return lambda prompt: "Yes." if "eat grass" in prompt else "no"

    def scorer():
        return lambda prompt: "yes" if "follow from" in prompt else "what do zebras eat" if "questions" in prompt else "- Zebras eat.\n2. Whales sing."

    live = Engine(spark, engine.settings, models={"corrector": corrector, "judge": judge, "scorer": scorer})
    both = live.report("corrective", str(top / "golden.jsonl"))
    assert both.provenance["backends"]["judge"] == "judge" and both.provenance["single_run"] and not both.provenance["publishable"]
    assert both.sections["summary"].first()["corrective_correctness"] == 1.0
    quality = live.report("quality", str(top / "golden.jsonl")).sections
    assert quality["summary"].first()["micro_faithfulness"] == 1.0
    relevance = {r["query_id"]: r["relevancy"] for r in quality["per_query"].collect()}
    assert relevance["q1"] == pytest.approx(1.0) and relevance["q2"] < 1
    with pytest.raises(ValueError):
        Engine(spark, models={"juge": judge})


def test_golden_faults_and_review(spark, built):
    engine, top = built
    chunks = engine.load()[0]
    assert files.golden_faults(spark, str(top / "golden.jsonl"), chunks) == []
    good = (top / "golden.jsonl").read_text().splitlines()
    (top / "bad.jsonl").write_text("\n".join([good[0], "{", good[0], '{"query_id": "q9", "query": "x", "relevant_chunk_ids": ["y", "x"]}']))
    faults = files.golden_faults(spark, str(top / "bad.jsonl"), chunks)
    assert [f.split(":")[0] for f in faults] == ["line 2", "line 3", "query q9"] and faults[2].endswith("no chunk x, y")
    assert files.golden_faults(spark, str(top / "missing.jsonl"), chunks) == ["no queries"]
    golden = spark.createDataFrame([(0, "q", "x", [chunks.filter("rel_path = 'c.txt'").first()["chunk_id"], "gone"], None)], files.GOLDEN)
    seen = files.review_golden(golden, chunks).orderBy("pos").collect()
    assert [(r["rel_path"], r["snippet"]) for r in seen] == [("c.txt", "Whales sing long songs."), (None, None)]


@pytest.mark.parametrize(("limit", "wanted"), [(3, ("", 0, 0)), (4, ("", 0, 0)), (10, ("some", 2, 0)), (13, ("some", 2, 1))])
def test_limit_of_steps(spark, limit, wanted):
    """The worst case takes 3 steps for each of two rewrites and one regeneration, and 4 more."""
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    passage = spark.createDataFrame([(1, "c", "p", [], "beta gamma beta")], "rank int, chunk_id string, rel_path string, heading_path array<string>, text string")
    never = lambda found: found.select("query_id", "chunk_id", F.lit(False).alias("relevant"))
    done = R.run(asked, lambda q: q.select("query_id").crossJoin(passage), Settings(), grade=never, generate=lambda rows: A.offline(rows, fabricate=True), limit=limit).collect()
    assert len(done) == 1
    assert ("some" if done[0]["answer"] else "", done[0]["n_rewrites"], done[0]["n_regenerations"]) == wanted
    assert done[0]["terminated_reason"] == ("regenerate_budget_exhausted" if limit == 13 else "recursion_limit")


def test_damaged_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("kept")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    assert [r["rel_path"] for r in files.read_corpus(spark, str(tmp_path)).collect()] == ["a.txt"]
