import html as pyhtml
import re

import pytest
from pyspark.sql import functions as F

from listwright.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


JS_SPACE = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
SAMPLES = [
    "<style>p{}</style><p>A &amp; B</p><SCRIPT x=1>var a='<b>';</SCRIPT> c&nbsp;d",
    f"a{JS_SPACE}b {JS_SPACE}", "  x  ", "", "<div>\n\n<b>x</b>\t</div>", "a\u0085b​c", "&lt;b&gt; 1 < 2",
]


def py_strip(s):
    s = re.sub(r"(?is)<style[^>]*>.*?</style>", " ", s)
    s = re.sub(r"(?is)<script[^>]*>.*?</script>", " ", s)
    s = re.sub(r"<[^>]+>", " ", s)
    for a, b in X.NAMED:
        s = s.replace(a, b)
    return re.sub(f"[{re.escape(JS_SPACE)}]+", " ", s).strip(" ")


@pytest.mark.parametrize("sample", SAMPLES)
def test_strip_tags(spark, sample):
    assert one(spark, sample, X.strip_tags) == py_strip(sample)


def test_text_lines_keep_blocks(spark):
    got = one(spark, "<h1>T</h1><p>Turnover: <b>$5</b></p><dl><dt>Net Profit:</dt><dd>x</dd></dl>tail", X.text_lines)
    assert got.split("\n") == ["T", "Turnover: $5", "Net Profit:", "x", "tail"]


def test_entities(spark):
    raw = "&quot;caf&#233;&#39;s&quot; &#8211; &#38;amp; &#233;"
    assert one(spark, raw, X.decode_entities) == '"café\'s" – &amp; é'
    assert pyhtml.unescape("&#8211;") == "–"


@pytest.mark.parametrize(
    "value,want",
    [("$1,250,000", 1250000), (" $ 40 000 ", 40000), ("POA", None), ("1.9m", 1), ("-5", -5), ("", None),
     ("99999999999999999999", None)],
)
def test_money(spark, value, want):
    assert one(spark, value, X.parse_money) == want


@pytest.mark.parametrize("value,want", [("12abc", 12), ("1,200", 1), ("3.9", 3), ("-3.9", -3), ("x", None), ("1000000.0", 1000000)])
def test_leading_int(spark, value, want):
    assert one(spark, value, X.leading_int) == want


@pytest.mark.parametrize("value,want", [("Victoria", "VIC"), ("nsw", "NSW"), ("Auckland", "AUCKLAND"), (None, None)])
def test_state(spark, value, want):
    assert one(spark, value, X.normalise_state) == want


@pytest.mark.parametrize(
    "amount,want",
    [(None, None), (0, None), (450_400, "450k"), (999_999, "1000k"), (1_000_000, "1.0m"), (1_250_000, "1.3m"), (12_340_000, "12.3m")],
)
def test_short_money(spark, amount, want):
    got = spark.createDataFrame([(amount,)], "v bigint").select(X.short_money(F.col("v")).alias("r")).first()["r"]
    assert got == want


def test_slug(spark):
    df = spark.createDataFrame([("joe's-barber-shop-vic-42", "42"), ("plain", "9"), ("a-sa-b-vic-c-1", "1")], "s string, n string")
    got = [(r.t, r.st) for r in df.select(X.slug_title(F.col("s"), F.col("n")).alias("t"), X.slug_state(F.col("s"), F.lit("nsw")).alias("st")).collect()]
    assert got == [("Joe'S Barber Shop Vic", "VIC"), ("Plain", "NSW"), ("A Sa B Vic C", "VIC")]


def test_urls(spark):
    rows = [("https://m.shop.com.au/a-12/", "12", True), ("http://X.COM/b-7", "7", True), ("https://a.org/c-1", "1", False), ("not a url", None, False), (None, None, False)]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "u string")
    got = [(r.n, r.m) for r in df.select(X.url_number(F.col("u")).alias("n"), X.is_market_url(F.col("u")).alias("m")).collect()]
    assert got == [(n, m) for _, n, m in rows]


def test_lists(spark):
    assert one(spark, '["a","b"]', X.decode_list) == ["a", "b"]
    assert one(spark, "[broken", X.decode_list) == [] and one(spark, None, X.decode_list) == []
    row = spark.createDataFrame([(["x", "Missing: y", "x", "z not confirmed"],)], "v array<string>").select(*X.split_reasons(F.col("v"))).first()
    assert list(row) == [["x", "x"], ["Missing: y", "z not confirmed"]]


def test_local_date_follows_daylight_saving(spark):
    df = spark.createDataFrame([("2025-12-31 20:00:00",), ("2025-07-01 20:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [(r.d, r.h) for r in df.select(X.local_date(F.col("t")).alias("d"), F.hour(X.local_time(F.col("t"))).alias("h")).collect()]
    assert got == [("2026-01-01", 7), ("2025-07-02", 6)]


def test_outcome_label(spark):
    assert one(spark, "needs_information", X.outcome_label) == "NEEDS INFORMATION"
    assert one(spark, None, X.outcome_label) == "UNCLASSIFIED"
