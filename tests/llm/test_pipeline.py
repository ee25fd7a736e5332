"""The pipeline's stages on small tables, each judged on its own input."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    words = [f"word{i}" for i in range(300)]
    texts = {i: " ".join(words[(i * 7 + j * (i + 1)) % 300] for j in range(40)) + "\n" + " ".join(words[(i * 11 + j * 37) % 300] for j in range(9)) for i in range(40)}
    texts[40] = texts[3]
    texts[41] = texts[5].split("\n")[0] + "\nanother line that is only here, with words"
    texts[42] = "you moron idiot " * 5
    texts[43] = ""
    rows = [(i, t, "en", "a" if i % 2 else "b", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i == 42)) for i in range(43)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return tmp_path, texts


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    lines = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, docs, str(path)).collect()}
    assert 40 not in lines and lines[41] == "another line that is only here, with words"
    assert lines[3] == texts[3] and lines[43] == ""
    near = {r["doc_id"] for r in stages["near dedup"](spark, docs, str(path)).collect()}
    assert 3 in near and 40 not in near and {0, 1, 2, 42, 43} <= near
    kept = stages["mixing"](spark, docs, str(path))
    assert kept.columns == list(pipeline.COLUMNS) and {r["doc_id"] for r in kept.collect()} <= set(texts)
    packed = stages["packing"](spark, docs, str(path)).collect()
    assert {r["doc_id"] for r in packed} == set(texts)


def test_run_writes_each_stage(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, str(folder[0]))
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    ends = {}
    for r in out.collect():
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 for own in ends.values())
