from pyspark.sql import functions as F

from evidentia.functions import location
from evidentia.functions.profile import SAMPLE, Vocabulary, with_profile
from evidentia.functions.text import normalize, significant_tokens
from evidentia.operators import citations


def test_locations(spark):
    cases = [
        ("section", "2.1", None, "Section 2.1", True), ("section", "2.1", None, "§2.1", True), ("stephanus", "82b", None, "82b-85b", True), ("stephanus", "82b", None, "83b-85b", False),
        ("bekker", "1094a1", "1094a20", "1094a5", True), ("bekker", "1094a1", "1094a20", "1094b1", False), ("page", "149", "150", "p. 149", True), ("page", "149", "150", "151", False),
        ("stephanus", "86b", None, "86B", True), ("stephanus", "86b", None, "86c", False), ("line", "x", None, "x", True), ("chapter", "3", None, "Chapter 3", True),
    ]
    df = spark.createDataFrame(cases, "system string, value string, range_end string, location string, hit boolean")
    place = location.range_form(F.col("system"), F.col("value"), F.col("range_end"))
    cited = location.of_system(location.cited_forms(F.col("location")), F.col("system"))
    got = df.withColumn("place", place).withColumn("cited", cited).withColumn("score", citations.location_score(F.col("place"), F.col("cited"))).collect()
    for r in got:
        assert (r.score is not None) == r.hit, r
    exact = {r.location: r.score for r in got}
    assert exact["Section 2.1"] == 150 and exact["82b-85b"] == 135 and exact["1094a5"] == 150


def test_keys_order_as_locations_do(spark):
    values = ["1.a", "1.b", "1.z", "1.aa", "2", "10"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", "v", location.key(F.lit("section"), F.col("v")).alias("k"))
    assert [r.v for r in df.orderBy("k").collect()] == values
    shown = df.select(location.display_with_prefix(F.lit("page"), F.lit("1"), F.lit("2")).alias("a"), location.display_with_prefix(F.lit("section"), F.lit("2.1"), F.lit(None).cast("string")).alias("b")).first()
    assert shown.a == "pp. 1–2" and shown.b == "§2.1"


def test_names_and_titles(spark):
    rows = [("Plato", "Plato", 90), ("J. Smith", "John Smith", 75), ("Smith", "John Smith", 75), ("Smith John", "John Smith", 70), ("John Smith", "Smith", 62), ("Kant", "Hume", 0), (None, "x", 0)]
    df = spark.createDataFrame(rows, "a string, b string, s int")
    for r in df.withColumn("got", citations.name_score(citations.normalize_name(F.col("a")), citations.normalize_name(F.col("b")))).collect():
        assert r.got == r.s, r
    rows = [("Ménon", "menon", 100), ("Physics", "Physics Book IV", 100), ("Meno", "The Meno", 85), ("The Meno", "Meno", 75), ("nature of things", "Things nature of old", 70), ("a", "b", 0)]
    df = spark.createDataFrame(rows, "a string, b string, s int")
    for r in df.withColumn("got", citations.title_score(citations.normalize_title(F.col("a")), citations.normalize_title(F.col("b")))).collect():
        assert r.got == r.s, r


def test_text(spark):
    r = spark.createDataFrame([("  Straße, ÉTÉ—self-made!  ",)], "t string").select(normalize(F.col("t")).alias("n")).withColumn("k", significant_tokens(F.col("n"))).first()
    assert r.n == "strasse ete self-made" and r.k == ["strasse", "self-made"]


def test_profiles(spark):
    v = Vocabulary(topics={"mind": ("consciousness", "mental causation")}, traditions={"ancient": ("plato",)}, periods={}, philosophers={"kant": (("traditions", "modern"),)})
    df = spark.createDataFrame([("On self-consciousness in Kant and mental causation",), ("nothing",), (None,)], "t string")
    a, b, c = with_profile(df, ["t"], "p_", v).collect()
    assert a.p_topics == ["mind"] and a.p_traditions == ["modern"] and b.p_topics == [] and c.p_tokens == []
    only = Vocabulary(topics={"m": ("mental causation",)}, traditions={"x": ("qq",)}, periods={"y": ("zz",)})
    assert with_profile(df, ["t"], "p_", only).first().p_topics == []  # several words: looked up as they are written, with underscores
    strict = Vocabulary(topics=only.topics, traditions=only.traditions, periods=only.periods, strict_phrases=True)
    assert with_profile(df, ["t"], "p_", strict).first().p_topics == ["m"]
    assert SAMPLE.penalties
