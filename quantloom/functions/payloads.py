"""Vendor payloads kept as text columns -> rows: markdown tables, CSV and JSON statements, Atom and JSON posts.

Every function takes rows of key columns and a text column, `payload`; the keys identify a payload. What can't be
read gives no rows, what is not known is kept under its own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dates import period_year
from .text import first_number, percent_fraction, strip_html

#: First cells of head and rule lines in markdown tables.
HEADS = ("Item", "Items", "---")
#: Keys of a JSON report that are no line items.
NOT_ITEMS = ("fiscalDateEnding", "reportedCurrency")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markdown_periods(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, period, year, label, value of statement tables in markdown.

    A line "### period" begins a table, what stands before the first one is a table without a period. Rows read
    | label | value | change | ... |; rows without a label or a number are left out, a change in per cent is a row
    "label YoY". Ragged rows are read as far as they go; of repeated labels in a table the last counts. Tables
    without rows are none; place 0 is the table of the latest year, equal years stay in their order.
    """
    block = lambda b, i: F.struct(
        (-period_year(F.when(i > 0, F.split_part(b, F.lit("\n"), F.lit(1))).otherwise(F.lit("")))).alias("y"), i.alias("i"),
        F.when(i > 0, _stripped(F.split_part(b, F.lit("\n"), F.lit(1)))).otherwise(F.lit("")).alias("period"),
        F.filter(F.transform(F.split(b, "\n"), _row), lambda r: (F.size(r) >= 2) & ~F.coalesce(r[0], F.lit("")).isin("", *HEADS) & first_number(r[1]).isNotNull()).alias("rows"),
    )
    whole = F.regexp_replace(F.coalesce("payload", F.lit("")), r"\r\n|\r", "\n")
    tables = F.transform(F.split(whole, r"(?:^|(?<=\n))[ \t]*### "), block)
    tables = F.array_sort(F.filter(tables, lambda t: F.size(t["rows"]) > 0))
    rows = payloads.select(*keys, F.posexplode(tables).alias("place", "t")).select(*keys, "place", "t.period", (-F.col("t.y")).alias("year"), F.posexplode("t.rows").alias("_i", "_r"))
    change = F.when((F.size("_r") >= 4) & ~F.get("_r", F.lit(2)).isin("--", ""), percent_fraction(F.get("_r", F.lit(2))))
    both = F.array(F.struct(F.col("_r")[0].alias("label"), first_number(F.col("_r")[1]).alias("value")), F.struct(F.concat(F.col("_r")[0], F.lit(" YoY")).alias("label"), change.alias("value")))
    rows = rows.select(*keys, "place", "period", "year", "_i", F.explode(F.filter(both, lambda x: x["value"].isNotNull())).alias("x"))
    return rows.groupBy(*keys, "place", "period", "year", F.col("x.label").alias("label")).agg(F.max_by("x.value", "_i").alias("value"))


def _row(line: Column) -> Column:
    """The cells of a line that begins with a bar; of other lines none."""
    text = _stripped(line)
    return F.when(text.startswith("|"), F.transform(F.split(F.regexp_replace(text, r"^\|+|\|+$", ""), r"\|"), _stripped)).otherwise(F.array().cast("array<string>"))


def markdown_latest(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, value of the table of the latest year."""
    return markdown_periods(payloads, keys).where("place = 0").select(*keys, "label", "value")


def csv_records(payload: Column) -> Column:
    """The records of a CSV text as arrays of cells; quoted cells may hold commas, quotes and line ends."""
    records = F.regexp_extract_all(payload, F.lit(r'((?:"(?:[^"]++|"")*+"|[^"\r\n]++)++)'), 1)

    def cells(record: Column) -> Column:
        found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(r'("(?:[^"]++|"")*+"[^,]*+|[^,]*+),'), 1)
        return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"[^"]*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))

    return F.transform(records, cells)


def csv_periods(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, period, value of a CSV statement whose head is the first record with an empty first cell.

    Records that begin with # are comments, those before the head are none. A period is the first ten characters
    of its head cell. Cells without a number and cells beyond the head are left out; of repeated labels the last counts.
    """
    records = F.filter(csv_records(F.col("payload")), lambda r: ~r[0].startswith("#"))
    rows = payloads.select(*keys, F.posexplode(records).alias("_at", "_r")).withColumn("_blank", F.trim(F.col("_r")[0]) == "")
    head = F.min_by(F.when(F.col("_blank"), F.struct("_at", "_r")), F.when(F.col("_blank"), F.col("_at"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_head", head).where("not _blank and _at > _head._at")
    rows = rows.withColumn("_last", F.max("_at").over(Window.partitionBy(*keys, F.trim(F.col("_r")[0])))).where("_at = _last")
    cells = rows.select(*keys, F.trim(F.col("_r")[0]).alias("label"), "_head", F.posexplode(F.slice("_r", 2, 2**30)).alias("_i", "_cell"))
    out = cells.select(*keys, "label", F.left(F.get("_head._r", F.col("_i") + 1), F.lit(10)).alias("period"), first_number(F.col("_cell")).alias("value"), "_i")
    return out.where("value is not null and period is not null").groupBy(*keys, "label", "period").agg(F.max_by("value", "_i").alias("value"))


def csv_latest(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, value of a CSV statement: the rightmost number of each record after the first, null where it has none."""
    rows = payloads.select(*keys, F.posexplode(csv_records(F.col("payload"))).alias("_at", "_r")).where((F.col("_at") > 0) & (F.col("_r")[0] != ""))
    numbers = F.filter(F.transform(F.slice("_r", 2, 2**30), first_number), lambda x: x.isNotNull())
    rows = rows.select(*keys, F.trim(F.col("_r")[0]).alias("label"), "_at", F.try_element_at(numbers, F.lit(-1)).alias("value"))
    return rows.groupBy(*keys, "label").agg(F.max_by(F.struct("value"), "_at").alias("_v")).select(*keys, "label", "_v.value")


def json_periods(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, period, key, value of the reports in a JSON statement: the annual ones, else the quarterly ones.

    A report is an object of any keys; values are read as numbers where they have one. Payloads that are no JSON
    objects, and values that are no numbers, give no rows.
    """
    reports = lambda kind: F.try_variant_get("_v", f"$.{kind}", "array<variant>")
    annual = reports("annualReports")
    rows = payloads.select(*keys, F.try_parse_json(F.col("payload")).alias("_v"))
    rows = rows.select(*keys, F.posexplode(F.when(F.size(annual) > 0, annual).otherwise(reports("quarterlyReports"))).alias("place", "_report"))
    rows = rows.select(*keys, "place", F.try_variant_get("_report", "$.fiscalDateEnding", "string").alias("period"), F.explode(F.try_variant_get("_report", "$", "map<string, variant>")).alias("key", "_value"))
    out = rows.select(*keys, "place", "period", "key", first_number(F.try_variant_get("_value", "$", "string")).alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.col("key").isin(*NOT_ITEMS))


def json_latest(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, value, text: each key's first number over the reports in their order, with blanks for
    underscores in its name, and the overview's sector as text. Of a key with underscores the last number counts."""
    rows = json_periods(payloads, keys).withColumn("_turn", F.when(F.contains("key", F.lit("_")), -F.col("place")).otherwise(F.col("place")))
    items = rows.groupBy(*keys, F.replace("key", F.lit("_"), F.lit(" ")).alias("label")).agg(F.min_by("value", F.struct("_turn", "key")).alias("value"))
    sector = payloads.select(*keys, F.explode(F.try_variant_get(F.try_parse_json(F.col("payload")), "$", "map<string, variant>")).alias("_k", "_v")).where(F.lower("_k") == "sector")
    sector = sector.select(*keys, F.lit("Sector").alias("label"), F.lit(None).cast("double").alias("value"), F.trim(F.try_variant_get("_v", "$", "string")).alias("text"))
    return items.withColumn("text", F.lit(None).cast("string")).unionByName(sector.where(F.col("text") != ""))


POST = "title: string, score: bigint, num_comments: bigint, created_utc: double, selftext: string"


def atom_posts(payloads: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """keys, place, title, score, num_comments, created_utc, selftext, source of the first entries of an Atom feed.

    Feeds carry no scores. Names are read without their name spaces, a body's markup as its visible text.
    """
    feed = F.from_xml(F.col("payload"), "entry array<struct<title: string, published: string, content: struct<_type: string, _VALUE: string>>>", {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"})
    rows = payloads.where("payload is not null").select(*keys, F.posexplode(F.slice(feed["entry"], 1, most)).alias("place", "e"))
    at = F.unix_micros(F.try_to_timestamp("e.published")) / 1e6
    return rows.select(*keys, "place", F.coalesce("e.title", F.lit("")).alias("title"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("num_comments"), at.alias("created_utc"), strip_html(F.col("e.content._VALUE")).alias("selftext"), F.lit("rss").alias("source"))


def json_posts(payloads: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The same columns of the first children of a JSON listing."""
    listing = F.from_json("payload", f"data struct<children: array<struct<data: struct<{POST}>>>>")
    rows = payloads.select(*keys, F.posexplode(F.slice(listing["data"]["children"]["data"], 1, most)).alias("place", "e"))
    return rows.select(*keys, "place", F.coalesce("e.title", F.lit("")).alias("title"), "e.score", "e.num_comments", "e.created_utc", F.coalesce("e.selftext", F.lit("")).alias("selftext"), F.lit("json").alias("source"))
