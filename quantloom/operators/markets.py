"""Vendor tables at scale: statements, ownership, options, movers, macro series, flows, news, prediction markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each key. Spark keeps n rows a key in every task before the exchange
    (a window group limit), so a hot key shrinks first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)


def statement_growth(items: DataFrame, lag: int = 1) -> DataFrame:
    """items (ticker, item, period_end, value) -> with growth against the period `lag` before."""
    before = F.lag("value", lag).over(Window.partitionBy("ticker", "item").orderBy("period_end"))
    return items.withColumn("growth", F.when(before != 0, (F.col("value") - before) / F.abs(before)))


def insider_summary(trades: DataFrame) -> DataFrame:
    """ticker, buys, sells, buy_value, sell_value, net_value: codes P and S only."""
    v = lambda code: F.coalesce(F.sum(F.when(F.col("code") == code, F.col("value"))), F.lit(0.0))
    return trades.groupBy("ticker").agg(F.count_if(F.col("code") == "P").alias("buys"), F.count_if(F.col("code") == "S").alias("sells"), v("P").alias("buy_value"), v("S").alias("sell_value"), (v("P") - v("S")).alias("net_value"))


def half_trend(rows: DataFrame) -> DataFrame:
    """ticker, n, recent, earlier, trend: sums of `change` over the newer half of the rows (one at least) and the rest.

    Days are counted first; only the rows of the day on which the half ends are ranked, by ord.
    """
    days = rows.groupBy("ticker", "date").agg(F.count("*").alias("_n"), F.sum("change").alias("_sum"))
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"_after": F.coalesce(F.sum("_n").over(later), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("ticker"))})
    days = days.withColumn("_left", F.greatest(F.lit(1), F.floor(F.col("_all") / 2)) - F.col("_after"))  # of the half, from this day on
    cut = days.where("_left > 0 and _left < _n").select("ticker", "date", "_left")
    place = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("ord")))
    split = rows.join(cut, ["ticker", "date"]).withColumn("_new", place <= F.col("_left")).groupBy("ticker", "_new").agg(F.sum("change").alias("_sum"))
    whole = days.where("not (_left > 0 and _left < _n)").select("ticker", (F.col("_left") > 0).alias("_new"), "_sum")
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("_sum"))), F.lit(0.0))
    sums = whole.unionByName(split).groupBy("ticker").agg(part(F.col("_new")).alias("recent"), part(~F.col("_new")).alias("earlier"))
    out = days.groupBy("ticker").agg(F.sum("_n").alias("n")).join(sums, "ticker")
    return out.withColumn("trend", F.when(F.col("recent") > F.col("earlier"), "rising").when(F.col("recent") < F.col("earlier"), "falling").otherwise("flat"))


def holdings_change(holdings: DataFrame) -> DataFrame:
    """holdings (ticker, period, pct) -> latest_pp, two_q_pp, accumulate: points gained in the last and the last two periods."""
    by = Window.partitionBy("ticker")
    rows = holdings.withColumns({"_d": F.col("pct") - F.lag("pct").over(by.orderBy("period")), "_p": F.row_number().over(by.orderBy(F.desc("period")))})
    out = rows.groupBy("ticker").agg(F.max(F.when(F.col("_p") == 1, F.col("_d"))).alias("latest_pp"), F.sum(F.when(F.col("_p") <= 2, F.col("_d"))).alias("two_q_pp"))
    return out.withColumn("accumulate", F.col("two_q_pp") > 0)


def revision_counts(actions: DataFrame) -> DataFrame:
    """ticker, up, down, net: an action that says both counts as up."""
    text = F.lower("action")
    up, down = text.contains("up"), text.contains("down") & ~text.contains("up")
    out = actions.groupBy("ticker").agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"))
    return out.withColumn("net", F.col("up") - F.col("down"))


def nearest_expiry(chain: DataFrame, as_of: str, least_days: int = 3) -> DataFrame:
    """ticker, expiry: the first at least three days off, else the last there is."""
    cut = F.date_add(F.to_date(F.lit(as_of)), least_days)
    return chain.groupBy("ticker").agg(F.coalesce(F.min(F.when(F.col("expiry") >= cut, F.col("expiry"))), F.max("expiry")).alias("expiry"))


def option_chain(chain: DataFrame, as_of: str) -> DataFrame:
    """Per ticker and its nearest expiry: mean IV by side, skew label at two points, open interest, volume, both ratios."""
    near = chain.join(nearest_expiry(chain, as_of), ["ticker", "expiry"], "left_semi")
    side = lambda s, c, f: f(F.when(F.col("side") == s, F.col(c)))
    iv = F.nanvl("iv", F.lit(None).cast("double"))
    near = near.withColumn("iv", iv)
    out = near.groupBy("ticker", "expiry").agg(side("CALL", "iv", F.avg).alias("call_iv"), side("PUT", "iv", F.avg).alias("put_iv"), side("CALL", "oi", F.sum).alias("call_oi"), side("PUT", "oi", F.sum).alias("put_oi"))
    gap = F.round(F.col("put_iv") - F.col("call_iv"), 6)  # a gap of two points exactly is balanced
    return out.withColumns({
        "skew": F.when(gap.isNull(), "unknown").when(gap > 0.02, "put-skew").when(gap < -0.02, "call-skew").otherwise("balanced"),
        "call_put_oi_ratio": F.when(F.col("put_oi") != 0, F.col("call_oi") / F.col("put_oi")), "put_call_oi_ratio": F.when(F.col("call_oi") != 0, F.col("put_oi") / F.col("call_oi")),
    })


def movers(quotes: DataFrame, n: int, rising: bool = False, min_cap: float = 0.0) -> DataFrame:
    """The n largest losers or gainers; changes beyond 1.5 in size are percentages."""
    change = F.when(F.abs("change") > 1.5, F.col("change") / 100).otherwise(F.col("change"))
    rows = quotes.where(F.col("market_cap") >= min_cap).withColumn("change", change)
    return rows.orderBy(F.desc("change") if rising else F.asc("change"), "ticker").limit(n)


def hot_movers(quotes: DataFrame, n: int) -> DataFrame:
    """Gainers and losers, each ticker once, by the size of the change."""
    from ..sources.routing import union_first

    both = union_first([movers(quotes, n, True), movers(quotes, n, False)], ["ticker"])
    return both.orderBy(F.abs("change").desc(), "ticker")


def macro_window(series: DataFrame, as_of: str, days: int) -> DataFrame:
    """series_id, first, last, delta, pct over the days up to a date; "." and other non-numbers are missing."""
    end = F.to_date(F.lit(as_of))
    rows = series.withColumn("value", F.col("value").cast("string").try_cast("double")).where(F.col("value").isNotNull() & F.col("date").between(F.date_sub(end, days), end))
    out = rows.groupBy("series_id").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.count("*").alias("n"))
    return out.withColumns({"delta": F.col("last") - F.col("first"), "pct": F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100)})


def breadth(changes: DataFrame, width: float = 0.02) -> DataFrame:
    """bucket, n: histogram of changes in steps of `width`."""
    return changes.where("change is not null").groupBy(F.floor(F.col("change") / width).alias("bucket")).agg(F.count("*").alias("n"))


def weekly_flow(rows: DataFrame) -> DataFrame:
    """ticker, week, net: sums per calendar week."""
    return rows.groupBy("ticker", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.sum("net").alias("net"))


def prediction_markets(events: DataFrame, now: str, top: int = 6) -> DataFrame:
    """Open markets that end in the future, by volume: title, question, volume, outcome, price of the first outcome.

    events: title, markets (array of structs; outcomes and prices are JSON arrays inside strings).
    """
    flat = events.select("title", F.explode("markets").alias("m")).select("title", "m.*")
    ends = F.try_to_timestamp("endDate")
    live = flat.where(~F.coalesce("closed", F.lit(False)) & (ends.isNull() | (ends > F.to_timestamp(F.lit(now)))))
    first = lambda c: F.try_element_at(F.from_json(c, "array<string>"), F.lit(1))
    best = live.orderBy(F.col("volumeNum").desc_nulls_last(), "title", "question").limit(top)
    return best.select("title", "question", F.col("volumeNum").alias("volume"), first("outcomes").alias("outcome"), first("outcomePrices").try_cast("double").alias("price"))


def title_dedup(news: DataFrame, limit: int) -> DataFrame:
    """Articles by query and position, each title once (the first), the first `limit` of them: the limit
    comes before any window on dates."""
    first = news.groupBy("title").agg(F.min_by(F.struct(*[c for c in news.columns if c != "title"]), F.struct("query_ord", "pos")).alias("_r")).select("title", "_r.*")
    return first.orderBy("query_ord", "pos").limit(limit)


def short_volume(rows: DataFrame) -> DataFrame:
    return rows.withColumn("short_ratio", F.try_divide("short_volume", "total_volume"))


def pivot_statement(items: DataFrame, periods: list[str]) -> DataFrame:
    """Line items as rows, the given periods as columns: a pivot with a stated list reads the data once."""
    return items.groupBy("ticker", "item").pivot("period", periods).agg(F.first("value"))


def named_fields(items: DataFrame, names: DataFrame) -> DataFrame:
    """items (field_id, ...) -> with field: the display name of the id, or the id itself. names is a fixed list."""
    return items.join(names.select("field_id", "name"), "field_id", "left").withColumn("field", F.coalesce("name", F.col("field_id").cast("string"))).drop("name")


def revenue_breakdown(reports: DataFrame) -> DataFrame:
    """reports (ticker, breakdown_list array<struct<kind, item_list array<struct<name, value>>>>) -> a row for each item."""
    kinds = reports.select("ticker", F.explode("breakdown_list").alias("b"))
    return kinds.select("ticker", "b.kind", F.explode("b.item_list").alias("i")).select("ticker", "kind", "i.name", "i.value")


def corporate_actions(dividends: DataFrame, splits: DataFrame, each: int = 5) -> DataFrame:
    """The latest actions of both kinds, up to `each` of a kind per ticker; columns that one kind lacks are null."""
    newest = [F.desc("date"), F.desc("ord")]
    last = lambda df, kind: top_per(df, ["ticker"], newest, each).withColumn("kind", F.lit(kind))
    return last(dividends, "dividend").unionByName(last(splits, "split"), allowMissingColumns=True)


def first_known(*values: Column) -> Column:
    """The first value that is not null, empty or "none"."""
    return F.coalesce(*(F.when(~F.lower(F.trim(v)).isin("", "none"), v) for v in values))


def net_side(net: Column) -> Column:
    return F.when(net > 0, "BUY").when(net < 0, "SELL").otherwise("flat")


def first_number_by_date(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """key, value: the latest row's value among those that are numbers."""
    number = value.try_cast("double")
    return rows.withColumn("_v", number).where("_v is not null").groupBy(key).agg(F.max_by("_v", "date").alias("value"))


def surprise_history(prints: DataFrame, bars: DataFrame) -> DataFrame:
    """Distinct prints (ticker, period, date) with surprise in percent and the move of the bar of the same date, if any."""
    first = prints.groupBy("ticker", "period", "date").agg(F.min_by(F.struct("eps_actual", "eps_estimate"), "ord").alias("e"))
    move = bars.select("ticker", "date", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("day_move"))
    pct = F.when(F.col("e.eps_estimate") != 0, (F.col("e.eps_actual") - F.col("e.eps_estimate")) / F.abs("e.eps_estimate") * 100)
    return first.join(move, ["ticker", "date"], "left").select("ticker", "period", "date", pct.alias("surprise_pct"), "day_move")


def expected_move(history: DataFrame, closes: DataFrame) -> DataFrame:
    """ticker, move, low, high: the current row's implied move, else the first row's, about the last close."""
    current = F.max_by("move", F.when(F.col("is_current"), -F.col("ord")))
    best = history.groupBy("ticker").agg(F.coalesce(current, F.min_by("move", "ord")).alias("move"))
    out = best.join(closes.groupBy("ticker").agg(F.max_by("close", "date").alias("close")), "ticker")
    return out.select("ticker", "move", (F.col("close") * (1 - F.col("move"))).alias("low"), (F.col("close") * (1 + F.col("move"))).alias("high"))


def contract_walk(levels: list[DataFrame], limits: tuple[int, ...] = (2, 3, 2, 20)) -> DataFrame:
    """Category, series, event, contract: each level (id, parent, ord, ...) keeps its first rows per parent and
    meets the level above; contracts priced strictly between 0 and 1 stay."""
    out = None
    for i, (level, n) in enumerate(zip(levels, limits)):
        kept = top_per(level, ["parent"], [F.col("ord").asc()], n).drop("place", "ord")
        if out is None:
            out = kept.select(F.col("id").alias("id0"))
        else:
            rest = [c for c in kept.columns if c not in ("id", "parent")]
            out = out.join(kept.withColumnRenamed("parent", f"id{i - 1}").withColumnRenamed("id", f"id{i}"), f"id{i - 1}").select(*out.columns, f"id{i}", *rest)
    return out.where("price > 0 and price < 1")


def trading_days(bars: DataFrame, start: str, end: str) -> DataFrame:
    """date, n_tickers of every session between two dates, both included."""
    return bars.where(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).groupBy("date").agg(F.count("*").alias("n_tickers"))


def ipos(rows: DataFrame, status: str = "pending", limit: int = 10) -> DataFrame:
    """The newest listings of a status, ties by ticker and ord: a partial top-k in every task, then one merge."""
    return rows.where(F.col("status") == status).orderBy(F.desc("updated"), "ticker", "ord").limit(limit)


def peers(rows: DataFrame, most: int = 24) -> DataFrame:
    """ticker, peers: the first `most` peers by ord as one text; ord tells the rows of a ticker apart."""
    first = top_per(rows.where("peer is not null"), ["ticker"], [F.col("ord")], most)
    held = F.sort_array(F.collect_list(F.struct("ord", "peer")))  # `most` rows a ticker
    return first.groupBy("ticker").agg(F.array_join(F.transform(held, lambda x: x["peer"]), ", ").alias("peers"))


def of_security(rows: DataFrame, code: str) -> DataFrame:
    """Rows whose security names the code, in upper case."""
    return rows.where(F.upper("security").contains(code.upper()))


def net_of_cost(r: Column, bps: float = 10.0) -> Column:
    return r - bps / 1e4


def ticker_news(articles: DataFrame, requested: DataFrame) -> DataFrame:
    """requested (ticker) -> each with the articles that name it, in any case, among their tickers or insights.

    articles: id, title, tickers array<string>, insights array<struct<ticker, sentiment, reasoning>>. sentiment and
    reasoning are those of the article's first insight on that very ticker, null where it has none.
    """
    named = F.array_distinct(F.concat(F.transform(F.coalesce("tickers", F.array().cast("array<string>")), lambda t: F.lower(t)), F.coalesce(F.transform("insights", lambda i: F.lower(F.coalesce(i["ticker"], F.lit("")))), F.array().cast("array<string>"))))
    rows = articles.withColumn("_t", F.explode(named)).join(requested.select("ticker", F.lower("ticker").alias("_t")).distinct(), "_t")
    own = F.try_element_at(F.filter("insights", lambda i: F.lower(i["ticker"]) == F.col("_t")), F.lit(1))
    return rows.withColumn("_own", own).select("ticker", "id", "title", "_own.sentiment", "_own.reasoning")


def session_clock(instants: DataFrame, sessions: DataFrame) -> DataFrame:
    """instants (ts, others) with is_open, next_open and next_close, null after the calendar's end.

    sessions: date, open and close as timestamps, a row a trading day; they span some thousand days, to which the
    instants are joined by date, so no instants are sorted.
    """
    span = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    later = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    days = span.join(sessions, "date", "left").withColumns({"_next_open": F.min("open").over(later), "_next_close": F.min("close").over(later)})
    before = sessions.agg(F.min("date").alias("_first"), F.min("open").alias("_open1"), F.min("close").alias("_close1"))
    rows = instants.withColumn("_day", F.to_date("ts")).join(days.withColumnRenamed("date", "_day"), "_day", "left").crossJoin(F.broadcast(before))  # one row
    early, ts = F.col("_day") < F.col("_first"), F.col("ts")
    return rows.select(
        *instants.columns, F.coalesce((ts >= F.col("open")) & (ts < F.col("close")), F.lit(False)).alias("is_open"),
        F.when(early, F.col("_open1")).when(ts < F.col("open"), F.col("open")).otherwise(F.col("_next_open")).alias("next_open"),
        F.when(early, F.col("_close1")).when(ts < F.col("close"), F.col("close")).otherwise(F.col("_next_close")).alias("next_close"),
    )


def float_shares() -> Column:
    """The public float: the profile's, else the fallback's; 0 counts as missing."""
    return F.coalesce(*(F.nullif(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("profile_float", "fallback_float")))
