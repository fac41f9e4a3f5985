"""Readers for the file formats that market data arrives in; explicit schemas throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.dates import from_nanos, parse_date
from ..functions.text import first_number


def flat_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of every ticker from bulk flat CSV files; rows without a close or a time are left out, other
    missing fields are null. `file` names the file a row came from."""
    raw = spark.read.schema(schemas.FLAT_FILE).option("header", True).csv(path)
    out = raw.select(F.upper("ticker").alias("ticker"), from_nanos(F.col("window_start")).alias("date"), "open", "high", "low", "close", "volume", F.input_file_name().alias("file"))
    return out.where("close is not null and date is not null")


def longest_history(bars: DataFrame) -> DataFrame:
    """Of the files that hold a ticker, the rows of the one with most closes (the first by name of equals)."""
    counts = bars.groupBy("ticker", "file").agg(F.count("close").alias("_n"))
    best = counts.groupBy("ticker").agg(F.max("_n").alias("_n")).join(counts, ["ticker", "_n"]).groupBy("ticker").agg(F.min("file").alias("file"))
    return bars.join(best, ["ticker", "file"], "left_semi")


def vendor_csv(spark: SparkSession, path: str, start: str, end: str, ticker: str | None = None) -> DataFrame:
    """One ticker's CSV of daily bars (comment lines start with #), within a range of dates, both included; without
    a ticker those of a folder, whose files have a column ticker or stand in a folder ticker=... for each."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    raw = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    day = next(c for c in raw.columns if c in ("date", "timestamp", "datetime", "time", "index"))
    number = lambda c: F.round(F.col(c).try_cast("double"), 2).alias(c)
    out = raw.select(F.col("ticker") if ticker is None else F.lit(ticker).alias("ticker"), parse_date(F.col(day)).alias("date"), *map(number, ("open", "high", "low", "close")), F.col("volume").try_cast("double").alias("volume"))
    return out.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def json_bars(spark: SparkSession, path: str) -> DataFrame:
    """REST bars: one object a line with symbol and an array of bars {t, o, h, l, c, v, vw}."""
    raw = spark.read.schema("symbol string, bars array<struct<t: string, o: double, h: double, l: double, c: double, v: double, vw: double>>").json(path)
    return raw.select(F.upper("symbol").alias("ticker"), F.explode("bars").alias("b")).select("ticker", F.try_to_timestamp("b.t").alias("ts"), "b.o", "b.h", "b.l", "b.c", "b.v", "b.vw")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Latest price of each symbol: trade, else bid, else ask, else daily close; 0 counts as missing."""
    raw = spark.read.schema("symbol string, trade double, bid double, ask double, day_close double").json(path)
    return raw.select(F.upper("symbol").alias("ticker"), F.coalesce(*(F.nullif(F.col(c), F.lit(0.0)) for c in ("trade", "bid", "ask", "day_close"))).alias("price"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """ticker, period, label, ord, value from text lines "ticker|period|label: value"; values may carry K, M, B, T."""
    lines = spark.read.text(path).select(F.split("value", r"\|", 3).alias("p")).where("size(p) = 3")
    body = F.split(F.col("p")[2], r":\s*", 2)
    out = lines.select(F.col("p")[0].alias("ticker"), F.col("p")[1].alias("period"), body[0].alias("label"), F.try_element_at(body, F.lit(2)).alias("text"))
    return out.select("ticker", "period", "label", F.monotonically_increasing_id().alias("ord"), first_number(F.col("text")).alias("value"))


def json_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Decisions from the marked text log: entries end with <!-- ENTRY_END -->, tags read
    [date | ticker | rating | raw | alpha | Nd], or [date | ticker | rating | pending]."""
    blocks = spark.read.option("lineSep", "<!-- ENTRY_END -->").text(path)
    tag = F.regexp_extract("value", r"(?m)^\[([^\]\n]*)\]", 1)
    parts = F.transform(F.split(tag, r"\s*\|\s*"), lambda p: F.trim(p))
    rows = blocks.select("value", parts.alias("p")).where("size(p) >= 4")
    pct = lambda i: F.regexp_replace(F.try_element_at("p", F.lit(i)), "%$", "").try_cast("double") / 100
    section = lambda name: F.trim(F.regexp_extract("value", rf"(?s){name}:\s*\n?(.*?)(?:\n[A-Z]+:|$)", 1))
    return rows.select(
        parse_date(F.col("p")[0]).alias("date"), F.col("p")[1].alias("ticker"), F.col("p")[2].alias("rating"), (F.lower(F.col("p")[3]) == "pending").alias("pending"),
        pct(4).alias("raw"), pct(5).alias("alpha"), F.regexp_extract(F.coalesce(F.try_element_at("p", F.lit(6)), F.lit("")), "^([0-9]+)d$", 1).try_cast("int").alias("holding_days"),
        section("DECISION").alias("decision"), section("REFLECTION").alias("reflection"),
    ).where("date is not null")


def filings(raw: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K"), limit: int = 10) -> DataFrame:
    """raw (ticker, form array, filed array, url array; parallel) -> the latest filings of the listed forms."""
    zipped = raw.select("ticker", F.posexplode(F.arrays_zip("form", "filed", "url")).alias("ord", "z")).select("ticker", "ord", "z.form", "z.filed", "z.url").where(F.col("form").isin(*forms))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("ord"))
    return zipped.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p", "ord")
