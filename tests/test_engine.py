import pytest
from pyspark.sql import functions as F

from sievewright.operators import answer as A
from sievewright.operators import corrective as R
from sievewright.plans.engine import Engine
from sievewright.settings import Settings
from sievewright.sources import files, frontmatter


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    notes = {
        "note.md": "---\ntitle: My Note\ntags: [alpha, beta]\ncreated: 2024-01-15\n---\nBody #gamma with [[Target#x|shown]].\n",
        "sub/nested.md": "```\n# not this\n```\n# Real Title\n\nText about zebras and lions.\r\nMore.",
        "weird.md": "---\nnever: closed\nbody",
        "plain.txt": "plain words",
        ".obsidian/app.md": "hidden",
        "data.jsonl": "{}",
        "a file.md": "blank in name",
    }
    for name, body in notes.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body.encode())
    return top


def test_corpus(spark, vault):
    rows = {r["rel_path"]: r for r in files.order_by_path(files.read_corpus(spark, str(vault))).collect()}
    assert list(rows) == ["a file.md", "note.md", "plain.txt", "sub/nested.md", "weird.md"]
    assert (rows["note.md"]["title"], rows["note.md"]["tags"], rows["note.md"]["wikilinks"]) == ("My Note", ["alpha", "beta", "gamma"], ["Target"])
    assert rows["note.md"]["text"] == "Body #gamma with shown.\n"
    assert "2024-01-15" in rows["note.md"]["frontmatter"]
    assert rows["sub/nested.md"]["title"] == "Real Title" and rows["sub/nested.md"]["folder"] == "sub"
    assert "\r" not in rows["sub/nested.md"]["text"]
    assert rows["weird.md"]["text"].startswith("---") and rows["weird.md"]["title"] == "weird"


def test_simple_front_matter():
    assert frontmatter.simple("a: 'x'\nl: [p, \"q\"]\nm:\n- one\n- two\nn: 1") == {"a": "x", "l": ["p", "q"], "m": ["one", "two"], "n": "1"}
    assert frontmatter.tags({"a": 1, "#b": 2}) == ["a", "b"]


def test_golden_errors_name_the_line(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    good = '{"query_id": "q1", "query": "x", "relevant_chunk_ids": ["a"]}'
    path.write_text(good + "\n\n" + good.replace("q1", "q2") + "\n")
    assert [r["query_id"] for r in files.read_golden(spark, str(path)).orderBy("golden_idx").collect()] == ["q1", "q2"]
    for bad in (good + "\n" + good, "{", good.replace('["a"]', "[]"), good.replace('["a"]', '["a","a"]'), ""):
        path.write_text(bad)
        with pytest.raises(ValueError):
            files.read_golden(spark, str(path)).collect()


def test_build_ask_and_rebuild(spark, vault, tmp_path):
    engine = Engine(spark, Settings(corpus_dir=str(vault), index_dir=str(tmp_path / "index")))
    assert engine.ask("zebras").first()["n_citations"] == 0
    first = engine.build()
    assert first["counts"] == {"n_documents": 5, "n_chunks": 5}
    answer = engine.ask("zebras and lions", 2).first()
    assert answer["attribution_rate"] == 1.0 and "Real Title" in answer["contexts"][0]["text"]
    assert [r["event"] for r in engine.stream("zebras").collect()] == ["meta", "answer", "done"]
    assert engine.build()["corpus_sha256"] == first["corpus_sha256"]
    for query, k in (("  ", 3), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            engine.ask(query, k)


def test_settings():
    s = Settings.from_env(env={"SIEVEWRIGHT_CHUNK_SIZE": "99", "SIEVEWRIGHT_USE_RERANKER": "false", "SIEVEWRIGHT_OTHER": "1"})
    assert (s.chunk_size, s.use_reranker, s.rrf_k, Settings().recursion_limit) == (99, False, 60, 20)


def rows_for(spark, texts):
    base = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    none = F.array().cast("array<string>")

    def find(q):
        ranked = base.select((F.col("i") + 1).alias("rank"), F.col("i").cast("string").alias("chunk_id"), F.lit("p").alias("rel_path"), none.alias("heading_path"), "text")
        return q.select("query_id").crossJoin(ranked)

    return find


def test_corrective_worst_case_ends(spark):
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    find = rows_for(spark, ["beta gamma beta", "delta"])
    never = lambda found: found.select("query_id", "chunk_id", F.lit(False).alias("relevant"))
    done = R.trace(R.run(asked, find, Settings(), grade=never, generate=lambda rows: A.offline(rows, fabricate=True))).first()
    assert (done["n_rewrites"], done["n_regenerations"], done["terminated_reason"]) == (2, 1, "regenerate_budget_exhausted")
    assert done["rewrite_budget_exhausted"] and done["extra_llm_calls"] == 6 and done["final_query"] == "alpha beta delta"


def test_corrective_plain_cases(spark):
    asked = spark.createDataFrame([("q", "beta")], "query_id string, query string")
    done = R.run(asked, rows_for(spark, ["beta gamma", "delta"]), Settings()).first()
    assert (done["terminated_reason"], done["n_rewrites"], len(done["contexts"])) == ("grounded", 0, 1)
    empty = R.run(asked, rows_for(spark, []), Settings(max_query_rewrites=0)).first()
    assert (empty["terminated_reason"], empty["answer"]) == ("abstained", A.NO_ANSWER)


def test_ingest_adds_each_chunk_once(spark, tmp_path):
    from sievewright.streaming.ingest import ingest

    docs = spark.createDataFrame([("a", "some text here"), ("b", "other text")], "rel_path string, text string")
    docs.write.parquet(str(tmp_path / "landing"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        docs.write.mode("append").parquet(str(tmp_path / "landing"))
    assert spark.read.parquet(str(tmp_path / "store/vectors")).count() == 2
