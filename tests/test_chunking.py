import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.operators import chunking as C

TEXTS = st.text(alphabet="ab. \n#üé😀", max_size=400)


@given(TEXTS, st.integers(1, 60), st.integers(0, 59))
@settings(max_examples=200, deadline=None)
def test_recursive_spans_cover_and_fit(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = [(s["start"], s["end"]) for s in C.spans_of(text, "recursive", size, overlap)]
    if not text.strip():
        assert spans == []
        return
    assert all(0 < b - a <= size for a, b in spans)
    assert set().union(*(range(a, b) for a, b in spans)) == set(range(len(text)))
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_hard_slices_without_separators():
    spans = C.spans_of("a" * 3000, "recursive", 512, 64)
    assert spans[0]["end"] == 448
    assert [s["start"] for s in spans[1:3]] == [384, 832]


def test_headings():
    text = "pre\n# A\nx\n## B\n```\n# no\n```\n    # code\n   ### C\ny\n# D"
    assert [p for _, _, p in C.sections(text)] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["D"]]
    assert C.level_of("####### x") == 0
    assert C.level_of("#x") == 0


def test_fixed_is_the_same_as_a_loop(spark):
    texts = ["", "  \n", "x" * 10, "abc " * 30, "é😀" * 41]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "rel_path string, text string")
    rows = C.chunk(docs, "fixed", 20, 6).orderBy("rel_path", "ordinal").collect()
    wanted = []
    for i, t in enumerate(texts):
        at = 0
        while t.strip():
            wanted.append((f"d{i}", t[at : at + 20]))
            if at + 20 >= len(t):
                break
            at += 14
    assert [(r["rel_path"], r["text"]) for r in rows] == wanted


def test_arguments_are_checked(spark):
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            C.check(size, overlap)
    with pytest.raises(ValueError):
        C.chunk(spark.createDataFrame([("a", "b")], "rel_path string, text string"), "other")
