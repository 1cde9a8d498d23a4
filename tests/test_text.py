import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.functions import text as T


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize("raw, clean", [("  a \t b\n", "a b"), ("a  b", "a b"), ("", ""), (None, None)])
def test_white_space(spark, raw, clean):
    assert one(spark, raw, T.normalize_whitespace("x")) == clean


@pytest.mark.parametrize("raw, clean", [(" N/A ", ""), ("none", ""), (None, ""), ("Null", ""), ("Nao", "Nao"), (" red  shoe ", "red shoe")])
def test_values(spark, raw, clean):
    assert one(spark, raw, T.normalize_value("x")) == clean


@pytest.mark.parametrize("raw, clean", [("<p>Big <b>red</b><br/>bag</p>", "Big red bag"), ("a &lt;b&gt; c", "a c"), ("x<!-- no -->y", "x y"), ("<script>keep()</script>", "keep()"), ("plain  text", "plain text"), (None, ""), ("5 &amp; 6", "5 & 6")])
def test_markup(spark, raw, clean):
    assert one(spark, raw, T.clean_html("x")) == clean


def test_slug(spark):
    rows = spark.createDataFrame([("Élan -- Vital!",), ("***",), (None,)], "x string").select(T.safe_slug("x")).collect()
    assert [r[0] for r in rows] == ["lan-vital", "unknown", "unknown"]


def test_canonical_text_and_maps(spark):
    m = F.create_map(*[F.lit(x) for x in ("Fit", "Slim", "Care", None, "Neck", "n/a")])  # in this order
    df = spark.createDataFrame([("Red  Bag", None, "NA")], "a string, b string, c string").withColumn("m", m)
    assert df.select(T.canonical_text(["a", "b", "c"], "m")).first()[0] == "Red Bag Fit Slim Care Neck"
    assert df.select(T.category_map({"x": "a", "y": "b", "z": "c"}).alias("m")).first()["m"] == {"x": "Red Bag"}
    assert one(spark, None, T.flatten_attributes("x"), "map<string,string>") == []


def test_tokens_and_stopwords(spark):
    assert one(spark, "The men's café RUN 2x", T.tokens("x")) == ["the", "men's", "caf", "run", "2x"]
    assert one(spark, "Men's RUN", T.tokens("x", lowercase=False)) == ["en's"]
    assert one(spark, "the red the bag", T.without_stopwords(T.tokens("x"))) == ["red", "bag"]
    assert one(spark, None, T.tokens("x")) == []


@pytest.mark.parametrize(
    "word, stem",
    [("running", "run"), ("shoes", "shoe"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas"), ("is", "is")],
)
def test_porter(word, stem):
    assert T.porter(word) == stem


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789'", max_size=12))
def test_porter_never_grows(word):
    assert len(T.porter(word)) <= len(word) + 1


def test_split_words_of_blank(spark):
    assert one(spark, "  ", T.split_words("x")) == []
    assert one(spark, None, T.split_words("x")) == []


def test_digest(spark):
    d = "ab" * 32
    rows = [(f" sha256:{d.upper()}\n",), (d + "0",), ("none",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(T.digest(F.col("x"))).collect()] == [d, None, None, None]
