from pyspark.sql import functions as F

from kbspark.functions import tables
from kbspark.functions import text as tx


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_canonical_key(spark):
    keys = {one(spark, tx.canonical_key("n"), n=n) for n in ("hak180 烫金机", "HAK 180 烫金机", " hak-180_烫金机 ")}
    assert keys == {"hak180烫金机"} and one(spark, tx.canonical_key(F.lit(None).cast("string"))) == ""


def test_cache_key_ignores_order_and_blanks(spark):
    a = one(spark, tx.cache_key("q", "n"), q=" how  to ", n=["b ", "a", " "])
    assert a == one(spark, tx.cache_key("q", "n"), q="how to", n=["a", "b"]) and a.startswith("hyde:") and len(a) == 69


def test_strip_item_names(spark):
    assert one(spark, tx.strip_item_names("q", "n"), q="How does HAK 180(x) heat", n=["hak180(X)"]) == "How does heat"


def test_selection(spark):
    options = ["华为擎云 G740", "other-one"]
    for reply, want in {"2": options[1], "第二个": options[1], "选2": options[1], "g740": options[0], "OTHER ONE": options[1], "o": options[1], "是的": None, "9": None, "": None}.items():
        assert one(spark, tx.parse_selection("r", "o"), r=reply, o=options) == want, reply


def test_image_urls(spark):
    text = "see http://a/x.png\n【图片】\nhttp://a/b c.png\nalso (http://a/d.JPG), http://a/e.txt\nhttp://a/b c.png"
    assert one(spark, tx.extract_image_urls("t"), t=text) == ["http://a/b%20c.png", "http://a/d.JPG"]
    assert one(spark, tx.extract_image_urls("t"), t="no marker http://a/x.png") == []
    assert one(spark, tx.extract_image_urls("t", loose=True), t="no marker http://a/x.png,") == ["http://a/x.png"]


def test_image_info(spark):
    info = one(spark, tx.parse_image_info("t"), t='```json\n{"image_type": "", "detail": "d d"}\n```')
    assert tuple(info) == ("other", "d d", "d d")
    assert tuple(one(spark, tx.parse_image_info("t"), t="just words")) == ("unknown", "just words", "just words")


def test_table_sentences():
    spans = "<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td rowspan=2>x</td><td>1</td><td>-</td></tr><tr><td colspan=2>2</td></tr></table>"
    assert tables.linearize_html(spans).strip() == "- 【x】(对应A)：B为1。\n- 【x】(对应A)：B为2，C为2。"
    assert tables.linearize_html("<table><tr><td>k</td><td>v</td></tr><tr><td></td><td>w</td></tr></table>").strip() == "- 【k】：v。\n- 【未知属性】：w。"
    assert tables.linearize_html("<table><tr><td></td><td>v</td></tr><tr><td>r</td><td>w</td></tr></table>").strip() == "- 【r】：v为w。"
    assert tables.linearize_pipes("a\n| k | v |\n|---|:-:|\n| x | 1 |\nb").split() == ["a", "-", "【x】(对应k)：v为1。", "b"]
    assert tables.linearize_html("no table") == "no table"
