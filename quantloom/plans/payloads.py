"""Queries that read vendor payloads kept as text: statements in markdown, CSV and JSON, and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as pl
from ..sources import warehouse as wh
from . import sql as S
from .registry import query

_F = "f AS (SELECT ticker, year + 20 AS year, CAST(round(revenue) AS BIGINT) AS rev, CAST(shares AS BIGINT) AS shares, (ticker * 7 + year + 20) % 50 AS up FROM fin)"


def _statements(spark, sf) -> DataFrame:
    """Statements twenty years later: period labels name years from 2000 on."""
    f = wh.fundamentals(spark, sf).withColumn("year", F.col("year") + 20)
    return f.select(F.col("ticker").cast("long").alias("ticker"), F.col("year").cast("int").alias("year"), F.round("revenue").cast("long").alias("rev"), F.col("shares").cast("long").alias("shares"), ((F.col("ticker") * 7 + F.col("year")) % 50).alias("up"))


def _joined(rows: DataFrame, text: Column, head: Column, by: str = "year") -> DataFrame:
    """A payload a ticker: the head, then the text of each year (a few a ticker)."""
    parts = F.sort_array(F.collect_list(F.struct(by, text.alias("text"))), asc=False)
    return rows.groupBy("ticker").agg(F.concat(head, F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("payload"))


_S = lambda c: F.col(c).cast("string")


@query(S.with_(S.FIN, _F, "SELECT ticker, year || '/FY' AS period, CAST(year AS INT) AS year, unnest(['Total Revenue', 'Total Revenue YoY', 'Shares']) AS label, unnest([rev * 1000e0, (up + 0.5e0) / 100e0, CAST(shares AS DOUBLE)]) AS value FROM f WHERE year % 3 <> 0 UNION ALL SELECT ticker, '', -1, 'Sector rank', CAST(ticker % 11 AS DOUBLE) FROM f GROUP BY ticker"))
def markdown_periods(spark, sf):
    """Tables newest first with repeated heads, a ragged row, a repeated label, and years without a table."""
    cells = F.concat(
        F.lit("### "), _S("year"), F.lit("/FY\n| Item | Value | YoY | QoQ |\r\n| --- | --- | --- | --- |\n| Shares | 1 |\n| Total Revenue | "), _S("rev"), F.lit("K | "), _S("up"), F.lit(".5% | -- |\n| Note |\n| Margin | n/a | 3% | -- |\nfree text\n | Shares | "), _S("shares"), F.lit(" | -- | -- |\n"),
    )
    table = F.when(F.col("year") % 3 != 0, cells).otherwise(F.concat(F.lit("### "), _S("year"), F.lit("/FY\n| Item | Value |\n\n")))
    return pl.markdown_periods(_joined(_statements(spark, sf), table, F.concat(F.lit("# Statement\n| Sector rank | "), F.first(F.col("ticker") % 11).cast("string"), F.lit(" |\n"))), ["ticker"]).drop("place")


@query(S.with_(S.FIN, _F, "SELECT ticker, arg_max(rev, year) * 1000e0 AS revenue, (arg_max(up, year) + 0.5e0) / 100e0 AS growth FROM f GROUP BY 1"))
def markdown_latest(spark, sf):
    """The newest table of each ticker, whose statements stand oldest first."""
    table = F.concat(F.lit("### FY "), _S("year"), F.lit("\n| Total Revenue | "), _S("rev"), F.lit("K | "), _S("up"), F.lit(".5% | 1% |\n"))
    rows = _statements(spark, sf).withColumn("_turn", -F.col("year"))
    latest = pl.markdown_latest(_joined(rows, table, F.lit(""), "_turn"), ["ticker"])
    value = lambda name: F.max(F.when(F.col("label") == name, F.col("value")))
    return latest.groupBy("ticker").agg(value("Total Revenue").alias("revenue"), value("Total Revenue YoY").alias("growth"))


def _csv(spark, sf) -> DataFrame:
    """A comment, a head whose first cell is empty, quoted cells with commas and quotes, and a cell too many."""
    years = F.sort_array(F.collect_list(F.struct("year", "rev", "shares")), asc=False)
    rows = _statements(spark, sf).groupBy("ticker").agg(years.alias("y"))
    line = lambda label, cell: F.concat(F.lit(label), F.array_join(F.transform("y", cell), ""), F.lit("\n"))
    return rows.select("ticker", F.concat(
        F.lit("# Income statement, yearly\n"), line("", lambda y: F.concat(F.lit(","), y["year"].cast("string"), F.lit("-12-31 00:00:00"))), line("Total Revenue", lambda y: F.concat(F.lit(',"'), F.format_number(y["rev"], 0), F.lit('"'))),
        line('"Basic, ""diluted"" shares"', lambda y: F.concat(F.lit(","), F.when(y["year"] % 2 == 0, y["shares"].cast("string")).otherwise(""))), F.lit("Odd,,n/a\n\n"), line("Extra,", lambda y: F.lit(",7")),
    ).alias("payload"))


@query(S.with_(S.FIN, _F, "e AS (SELECT ticker, year, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS p FROM f)", "SELECT ticker, 'Total Revenue' AS label, year || '-12-31' AS period, CAST(rev AS DOUBLE) AS value FROM f UNION ALL SELECT ticker, 'Basic, \"diluted\" shares', year || '-12-31', shares FROM f WHERE year % 2 = 0 UNION ALL SELECT ticker, 'Extra', year || '-12-31', 7 FROM e WHERE p > 1"))
def csv_statements(spark, sf):
    return pl.csv_periods(_csv(spark, sf), ["ticker"])


@query(S.with_(S.FIN, _F, "SELECT ticker, 'Total Revenue' AS label, CAST(arg_min(rev, year) AS DOUBLE) AS value FROM f GROUP BY 1 UNION ALL SELECT ticker, 'Basic, \"diluted\" shares', arg_min(shares, year) FILTER (year % 2 = 0) FROM f GROUP BY 1 UNION ALL SELECT DISTINCT ticker, 'Odd', CAST(NULL AS DOUBLE) FROM f UNION ALL SELECT DISTINCT ticker, 'Extra', 7 FROM f"))
def csv_latest(spark, sf):
    """The rightmost number of each record, as the vendor's statements are read where no date is asked for."""
    return pl.csv_latest(_csv(spark, sf), ["ticker"])


def _json(spark, sf) -> DataFrame:
    report = F.concat(F.lit('{"fiscalDateEnding": "'), _S("year"), F.lit('-12-31", "reportedCurrency": "USD", "totalRevenue": "'), _S("rev"), F.lit('", "shares_out": '), _S("shares"), F.lit(', "note": "none", "empty": null'), F.when(F.col("year") % 2 == 0, F.concat(F.lit(', "key'), (F.col("year") % 4).cast("string"), F.lit('": 1.5'))).otherwise(""), F.lit("},"))
    kind = F.when(F.first(F.col("ticker") % 2) == 0, '"annualReports": [], "quarterlyReports": [').otherwise('"annualReports": [')
    rows = _joined(_statements(spark, sf), report, F.concat(F.lit('{"Sector": " Tech ", '), kind))
    return rows.select("ticker", F.concat(F.regexp_replace("payload", ",$", ""), F.lit("]}")).alias("payload"))


@query(S.with_(S.FIN, _F, "SELECT ticker, year || '-12-31' AS period, 'totalRevenue' AS key, CAST(rev AS DOUBLE) AS value FROM f UNION ALL SELECT ticker, year || '-12-31', 'shares_out', shares FROM f UNION ALL SELECT ticker, year || '-12-31', 'key' || year % 4, 1.5e0 FROM f WHERE year % 2 = 0"))
def json_statements(spark, sf):
    """Reports of any keys: keys that not every report has are kept."""
    return pl.json_periods(_json(spark, sf), ["ticker"]).drop("place")


@query(S.with_(S.FIN, _F, "SELECT ticker, 'totalRevenue' AS label, CAST(arg_max(rev, year) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM f GROUP BY 1 UNION ALL SELECT ticker, 'shares out', arg_min(shares, year), NULL FROM f GROUP BY 1 UNION ALL SELECT ticker, 'key' || year % 4, 1.5e0, NULL FROM f WHERE year % 2 = 0 GROUP BY ticker, year % 4 UNION ALL SELECT DISTINCT ticker, 'Sector', CAST(NULL AS DOUBLE), 'Tech' FROM f"))
def json_latest(spark, sf):
    return pl.json_latest(_json(spark, sf), ["ticker"])


@query("WITH p AS (SELECT o_custkey AS ticker, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT ticker, CAST(place AS INT) AS place, 'Order ' || o_orderkey || ' <up> & away' AS title, k.source, CASE WHEN k.source = 'json' THEN o_orderkey % 100 END AS score, CAST(epoch(CAST(day AS TIMESTAMP)) AS DOUBLE) AS created_utc, 'Café No ' || o_orderkey || ' is 5 < 6' AS selftext FROM p, (SELECT unnest(['rss', 'json']) AS source) AS k WHERE place < 5")
def social_posts(spark, sf):
    """A customer's orders as the entries of an Atom feed and as those of a JSON listing: the same posts."""
    o = wh.table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("day"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("key", "day"))), 1, 8)
    held = o.groupBy("ticker").agg(first.alias("posts"))
    body = lambda k: F.concat(F.lit("<div><!-- SC_OFF --><p>Caf&eacute; <b>No "), k, F.lit("</b> is&nbsp;5 &#60; 6</p><!-- SC_ON --> by u/x</div>"))
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = lambda k: F.concat(F.lit("Order "), k, F.lit(" <up> & away"))
    entry = lambda p: F.concat(F.lit('<entry><author><name>x</name></author><title>'), escaped(title(p["key"].cast("string"))), F.lit("</title><published>"), p["day"].cast("string"), F.lit('T00:00:00+00:00</published><content type="html">'), escaped(body(p["key"].cast("string"))), F.lit("</content></entry>"))
    atom = held.select("ticker", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>search</title>'), F.array_join(F.transform("posts", entry), ""), F.lit("</feed>")).alias("payload"))
    child = lambda p: F.struct(F.struct(title(p["key"].cast("string")).alias("title"), (p["key"] % 100).alias("score"), F.lit(1).alias("num_comments"), F.unix_timestamp(p["day"].cast("timestamp")).cast("double").alias("created_utc"), F.concat(F.lit("Café No "), p["key"].cast("string"), F.lit(" is 5 < 6")).alias("selftext")).alias("data"))
    listing = held.select("ticker", F.to_json(F.struct(F.struct(F.transform("posts", child).alias("children")).alias("data"))).alias("payload"))
    both = pl.atom_posts(atom, ["ticker"]).unionByName(pl.json_posts(listing, ["ticker"]))
    return both.select("ticker", "place", "title", "source", "score", "created_utc", "selftext")
