import uuid

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import verify as V


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_tokens_keep_repeats_and_drop_other_letters(spark):
    assert one(spark, T.tokens(F.col("t")), t="A b,a; Ünder_x 42") == ["a", "b", "a", "nder", "x", "42"]


def test_point_id_is_uuid5(spark):
    space = uuid.UUID(T.POINT_NAMESPACE)
    for name in ("abc", "60eb909622a8126c", "ü", "x1", "x2", "x3"):
        assert one(spark, T.point_id(F.col("t")), t=name) == str(uuid.uuid5(space, name))


def test_normalize_composes_and_folds(spark):
    assert one(spark, T.normalize(F.col("t")), t=" Straße  Café x ") == "strasse café x"


def test_shingles_drop_stop_words_first(spark):
    assert one(spark, T.content_shingles(T.tokens(F.col("t"))), t="the red fox of the wood") == ["red fox", "fox wood"]
    assert one(spark, T.content_shingles(T.tokens(F.col("t"))), t="fox") == []


def test_f1_statements_refusals_and_questions(spark):
    assert one(spark, T.lexical_f1(F.col("a"), F.col("b")), a="a b c", b="b c d") == 2 / 3
    assert one(spark, T.lexical_f1(F.col("a"), F.col("b")), a="", b="") == 0
    assert one(spark, T.statements(F.col("t")), t=" One. Two!? ... ") == ["One", "Two"]
    assert one(spark, T.noncommittal(F.col("t")), t="Sorry, I Don't Know.") is True
    assert one(spark, T.noncommittal(F.col("t")), t="It is 42.") is False
    assert one(spark, T.templated_questions(F.col("t"), 2), t="Red fox") == ["what red fox", "how red fox"]


def test_links_and_tags(spark):
    body = "see [[Note One#part|shown]] and ![[pic.png]] [[b^x]] #tag/sub #123 a#no"
    assert one(spark, T.link_targets(F.col("t")), t=body) == ["Note One", "b", "pic.png"]
    assert one(spark, T.render_links(F.col("t")), t=body) == "see shown and pic.png b^x #tag/sub #123 a#no"
    assert one(spark, T.inline_tags(F.col("t")), t=body) == ["tag/sub"]


def verdict(spark, quote, chunk):
    rows = spark.createDataFrame([(quote, chunk)], "quote string, chunk string")
    return tuple(V.verdicts(rows).first()["verdict"])[:2]


def test_grounding(spark):
    assert verdict(spark, "gamma alpha beta delta", "alpha beta gamma delta epsilon") == (True, "token_overlap")
    assert verdict(spark, "ALPHA  beta", "alpha beta gamma") == (True, "normalized_substring")
    assert verdict(spark, "", "alpha") == (False, "no_overlap")
    assert verdict(spark, "x", None) == (False, "chunk_not_in_context")
    assert verdict(spark, "alpha beta gamma nope nada", "alpha beta x gamma") == (True, "token_overlap")
    padded = "the powerhouse of the cell is in a zzz"
    assert verdict(spark, padded, "the cat is in a house of the dog and a powerhouse cell")[0] in (True, False)
    assert verdict(spark, "the of in a is zebra", "a cat is in the house of dogs") == (False, "no_overlap")
    assert verdict(spark, "café noir", "le café noir") == (True, "normalized_substring")


def test_attribution_rollup(spark):
    rows = [(i, 1, 1, 1.0) for i in range(48)] + [(48, 2, 1, 0.5), (49, 0, 0, 0.0)]
    out = V.rollup(spark.createDataFrame(rows, "query_id int, n_citations long, n_grounded long, attribution_rate double")).first()
    assert (out["micro"], out["macro"], out["macro_answered"], out["n_abstained"]) == (0.98, 0.97, 48.5 / 49, 1)
