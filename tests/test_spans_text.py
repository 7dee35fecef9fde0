"""C1, A1-A4, T7 on the hand-made cases of FIXTURES §C."""

from pyspark.sql import functions as F

from trellis.functions.text import clean_label, find0, rfind0
from trellis.operators import qa


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def test_clean_label(spark):
    assert one(spark, clean_label("s"), s=" a;b\tc\n") == "a b c"
    assert one(spark, clean_label("s"), s=";") is None


def test_exact_span_and_prefix_shift(spark):
    assert one(spark, qa.exact_span("q", "m"), q="who is Ann Lee", m="ann lee") == [7, 14]
    assert one(spark, qa.mention_span("q", "m"), q="who is Ann Lee", m="ann lee") == [17, 24]
    assert one(spark, qa.exact_span("q", "m"), q="abc", m="") == [0, 0]


def test_word_window_and_fallback(spark):
    assert one(spark, qa.word_window_span("q", "m"), q="the annual leeway here", m="ann  lee") == [4, 11]
    assert one(spark, qa.mention_span("q", "m"), q="abc", m="zzzz") == [10, 14]
    # a blank mention falls back to [0, len] instead of the legacy [0, -1]
    assert one(spark, qa.word_window_span("q", "m"), q="abc", m="  ") is None
    assert one(spark, qa.mention_span("q", "m"), q="abc", m="  ") == [10, 12]


def test_token_id_span(spark):
    df = spark.createDataFrame([("who is ann", [2]), ("who is ann", [9])], "s string, ids array<int>")
    rows = df.select(qa.token_id_span("s", "ids").alias("f"),
                     qa.token_id_span("s", "ids", legacy=True).alias("l")).collect()
    assert rows[0]["f"] == [7, 10] and rows[0]["l"] == [6, 9]
    assert rows[1]["f"] is None and rows[1]["l"] is None


def test_find_rfind(spark):
    assert one(spark, find0("h", "n"), h="abcabc", n="bc") == 1
    assert one(spark, rfind0("h", "n"), h="abcabc", n="bc") == 4
    assert one(spark, rfind0("h", "n"), h="abc", n="zz") == -1
    assert one(spark, rfind0("h", "n"), h="abc", n="") == 3
