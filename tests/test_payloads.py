"""Payload parsers and HTML references on hand-made inputs, against the standard library where it has the same."""

import csv
import html
import io

import pytest
from pyspark.sql import functions as F

from quantloom.functions import payloads, text


def rows(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "k int, payload string")


HTML = [
    None, "", "plain", "&amp;lt;", "caf&eacute; &Eacute &eacuteX", "&#8217;&#x2019;&#X2019&#39 ;", "&notit; &notin; &not;", "&;&&amp;&", "&#;&#x;&#xg;&# 5;", "&#0;&#128;&#150;&#159;&#129;&#13;&#1;&#11;&#127;",
    "&#55296;&#x110000;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;&#x0000000041;", "&#xFDD0;&#x1FFFE;&#x1F600;", "&nosuch; &amp", "a&lt;b&gt;c&quot;&apos;&nbsp;d", "&CounterClockwiseContourIntegral;&NotEqualTilde;&fjlig;", "&amp#38;", "x &copy 2024 &copycat;", "&hearts", "é&é;", "&#32;&#x20", "&ampamp;",
]


def test_every_kind_of_html_reference(spark):
    got = rows(spark, *HTML).select("k", text.unescape_html(F.col("payload")).alias("x")).collect()
    assert {r["k"]: r["x"] for r in got} == {k: None if v is None else html.unescape(v) for k, v in enumerate(HTML)}


def test_every_html_name(spark):
    from html.entities import html5

    names = [f"<{n}>&{n}z" for n in sorted(html5)] + [f"&{n};" for n in sorted(html5) if not n.endswith(";")]
    got = rows(spark, *names).repartition(4).select("k", text.unescape_html(F.col("payload")).alias("x")).collect()
    assert [r["x"] for r in sorted(got)] == [html.unescape(n) for n in names]


def test_visible_text_collapses_blanks_of_any_kind(spark):
    got = rows(spark, "<p>a&nbsp;&ensp;b</p> c&#10;d", "x<!-- SC_OFF -->in &lt;b&gt;<i>side</i><!-- SC_ON -->y", None).select(text.strip_html(F.col("payload")).alias("x")).collect()
    assert [r["x"] for r in got] == ["a b c d", "in <b> side", ""]


CSV = ['a,b,c\n1,"x, y","say ""no"""\r\n,,\n"two\nlines",3,\n', "", "one", '"open,2\n3,4', "a,,b\n\n\nc,d,e,f"]


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_csv_records(spark, k):
    got = rows(spark, CSV[k]).select(payloads.csv_records(F.col("payload")).alias("x")).first()["x"]
    assert got == [r for r in csv.reader(io.StringIO(CSV[k], newline="")) if r]


def test_csv_periods_and_latest(spark):
    statement = "# a comment, with a comma\nbefore,1\n,2024-12-31 00:00,2023-12-31,\nTotal Revenue,1.5B,\"1,200\",7\nRevenue,,\n ,5\nTotal Revenue,2K\nShares,n/a,-3\n"
    frame = rows(spark, statement, None, "no head,1\nx,2", "")
    got = {(r["k"], r["label"], r["period"], r["value"]) for r in payloads.csv_periods(frame, ["k"]).collect()}
    assert got == {(0, "Total Revenue", "2024-12-31", 2000.0), (0, "Shares", "2023-12-31", -3.0)}
    got = {(r["k"], r["label"], r["value"]) for r in payloads.csv_latest(frame, ["k"]).collect()}
    assert got == {(0, "before", 1.0), (0, "Total Revenue", 2000.0), (0, "Revenue", None), (0, "", 5.0), (0, "Shares", -3.0), (2, "x", 2.0)}


def test_markdown_periods(spark):
    several = "intro\n|Early|3|\n### 2023/FY\r\n| Item | Value | YoY |\n| --- | --- | --- |\n|Revenue|1.2M|5%|--|\n| Revenue | 2M |\n||4|\n  ### 2024/FY  \n|Revenue|3M|-1.5%|2%|\n|Only a label|\n|Margin|none|\n|| Odd |6|\n### 2022/Q1\n### no year\n| A | 1 | -- | 2% |"
    frame = rows(spark, several, None, "", "### 2024\nno table", "| X | 5 |")
    got = {(r["k"], r["place"], r["period"], r["year"], r["label"], round(r["value"], 9)) for r in payloads.markdown_periods(frame, ["k"]).collect()}
    assert got == {
        (0, 0, "2024/FY", 2024, "Revenue", 3e6), (0, 0, "2024/FY", 2024, "Revenue YoY", -0.015), (0, 0, "2024/FY", 2024, "Odd", 6.0), (0, 1, "2023/FY", 2023, "Revenue", 2e6), (0, 1, "2023/FY", 2023, "Revenue YoY", 0.05),
        (0, 2, "", -1, "Early", 3.0), (0, 3, "no year", -1, "A", 1.0), (4, 0, "", -1, "X", 5.0),
    }
    assert {(r["k"], r["label"]) for r in payloads.markdown_latest(frame, ["k"]).collect()} == {(0, "Revenue"), (0, "Revenue YoY"), (0, "Odd"), (4, "X")}


def test_json_statements(spark):
    first = '{"sector": " Tech ", "annualReports": [{"fiscalDateEnding": "2024", "a": "1K", "x_y": 5, "deep": {"z": 1}, "n": null, "reportedCurrency": "USD"}, {"fiscalDateEnding": "2023", "a": 2, "b": -3.5, "x_y": "6"}]}'
    frame = rows(spark, first, '{"annualReports": [], "quarterlyReports": [{"q": 1}]}', "[1, 2]", "{broken", None, '{"annualReports": 5}', "{}")
    got = {(r["k"], r["place"], r["period"], r["key"], r["value"]) for r in payloads.json_periods(frame, ["k"]).where("key <> 'deep'").collect()}
    assert got == {(0, 0, "2024", "a", 1000.0), (0, 0, "2024", "x_y", 5.0), (0, 1, "2023", "a", 2.0), (0, 1, "2023", "b", -3.5), (0, 1, "2023", "x_y", 6.0), (1, 0, None, "q", 1.0)}
    got = {(r["k"], r["label"], r["value"], r["text"]) for r in payloads.json_latest(frame, ["k"]).where("label <> 'deep'").collect()}
    assert got == {(0, "a", 1000.0, None), (0, "x y", 6.0, None), (0, "b", -3.5, None), (0, "Sector", None, "Tech"), (1, "q", 1.0, None)}


def test_posts(spark):
    entry = lambda i: f"<entry><title>t{i} &amp;lt;</title><published>2024-01-0{i}T01:00:00Z</published><content type='html'>&lt;p&gt;b{i}&lt;/p&gt;</content></entry>"
    feed = f"<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'>{''.join(map(entry, range(1, 8)))}<entry/></feed>"
    got = payloads.atom_posts(rows(spark, feed, "<feed/>", "no xml <", None, "<feed xmlns='http://www.w3.org/2005/Atom'><entry><published>soon</published></entry></feed>"), ["k"]).orderBy("k", "place").collect()
    assert [(r["k"], r["place"], r["title"], r["selftext"], r["score"], r["source"]) for r in got] == [(0, i, f"t{i + 1} &lt;", f"b{i + 1}", None, "rss") for i in range(5)] + [(4, 0, "", "", None, "rss")]
    assert got[0]["created_utc"] == 1704070800.0 and got[-1]["created_utc"] is None
    listing = '{"data": {"children": [{"data": {"title": "x", "score": 3, "num_comments": 1, "created_utc": 5.0}}, {"data": {"selftext": "s"}}]}}'
    got = payloads.json_posts(rows(spark, listing, "{", None), ["k"]).collect()
    assert [(r["title"], r["score"], r["selftext"], r["source"]) for r in got] == [("x", 3, "", "json"), ("", None, "s", "json")]
