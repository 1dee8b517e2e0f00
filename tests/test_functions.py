"""Rules of the text, decision and order functions on hand-written cases."""

from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import text as T
from docsafe.operators import order


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, ["1.Điều 2/3 a-b c.", "", None], T.retry_tokens) == [["1", "Điều", "2/3", "a-b", "c"], [], None]


def test_accentless(spark):
    assert values(spark, ["Đường", "Straße", "é"], T.accentless) == ["duong", "strasse", "e"]


def test_markdown(spark):
    md = "<!-- Page 2 -->\n# Head\n\n\n\n- **a** [b](c)\n| x | y |\n|---|:-:|\n```py\nz\n```"
    assert values(spark, [md, ""], T.markdown_to_text) == ["Head\na b\nx\ty\nz", ""]


def test_char_loop(spark):
    texts = ["tong cong aaaaaaa", "tong cong 0000000", "a aaaaaaa", "none"]
    assert values(spark, texts, T.char_loop_start) == [11, 11, 3, 0]
    assert values(spark, texts, T.trim_char_loop) == ["tong cong", "tong cong 0000000", "", "none"]


def test_ngram_loop(spark):
    texts = ["xin chao a b a b a b", "a b a b", "a a a a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.posexplode(F.split("t", " ")).alias("pos", "tok"))
    got = {r["i"]: (r["repeats"], r["ngram"], r["start"]) for r in order.ngram_loops(rows, ["i"]).collect()}
    assert got == {0: (3, 2, 2), 2: (4, 1, 0)}


def test_seam(spark):
    rows = spark.createDataFrame([("ben an", "An toan"), ("a b", "c")], "l string, r string")
    got = [r[0] for r in rows.select(T.seam_overlap(T.simple_tokens(F.col("l")), T.simple_tokens(F.col("r")))).collect()]
    assert got == [1, 0]


def test_safe_line(spark):
    row = spark.range(1).select(D.safe_line(F.lit("t"), F.lit("high"), F.lit(1), F.lit(2), F.array(F.lit("a"), F.lit("b"))).alias("s")).first()
    assert row["s"] == "[OCR_SEMANTIC_RISK page=2 line=3 reasons=a,b]"


def test_row_groups(spark):
    rows = [(1, 1, 50.0, 0.0, 60.0, 10.0, 1.0), (1, 2, 0.0, 2.0, 10.0, 12.0, 1.0), (1, 3, 0.0, 40.0, 10.0, 50.0, 1.0)]
    boxes = spark.createDataFrame(rows, "page long, line long, x0 double, y0 double, x1 double, y1 double, conf double")
    assert order.row_groups(boxes).first()["rows"] == [[2, 1], [3]]
