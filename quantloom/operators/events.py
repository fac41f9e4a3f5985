"""Earnings events, catalysts, macro backdrop, regimes and order flow."""

from __future__ import annotations

import math
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp
from ..sources.warehouse import shared_dir
from . import indicators as ind
from .windows import by, trail, with_far


def surprise(actual: Column, estimate: Column) -> Column:
    return F.when(estimate != 0, (actual - estimate) / F.abs(estimate))


def drift_side(value: Column) -> Column:
    return F.when(value.isNull() | (F.abs(value) < 1e-9), "flat").when(value > 0, "beat").otherwise("miss")


def side_multiple(side: Column, catalyst: float = 1.0, cap: float = 1.5) -> Column:
    scale = max(1.0, catalyst)
    return F.when(side == "flat", 0.0).when(side == "beat", min(scale, cap)).otherwise(min(0.5 * scale, cap))


def risk_penalty(expected: Column, baseline: float = 0.02) -> Column:
    """1 / (1 + 3 * expected / baseline); a half where the move is not known."""
    return F.when(expected > 0, 1 / (1 + expected / baseline * 3)).otherwise(0.5)


def asof_forward(events: DataFrame, bars: DataFrame, columns: tuple[str, ...] = ("date", "bar", "close")) -> DataFrame:
    """Each event (ticker, event_date, ...) with the first bar on or after its date, as bar_<column>; null without.

    The distinct dates of a ticker's events, bounded by the calendar however many the events, and its
    bars are read backwards once in one series; the events then join by ticker and date. No range
    join, and a ticker with most of the events does not sort them in one task.
    """
    days = events.select("ticker", F.col("event_date").alias("_at")).distinct().withColumn("_day", F.lit(True))
    right = bars.select("ticker", F.col("date").alias("_at"), F.struct(*columns).alias("_bar"))
    both = days.unionByName(right, allowMissingColumns=True)
    # bars come first among equals when read backwards from the event
    order = Window.partitionBy("ticker").orderBy("_at", F.col("_bar").isNotNull().cast("int")).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_next", F.first("_bar", ignorenulls=True).over(order)).where("_day")
    found = found.select("ticker", F.col("_at").alias("event_date"), *(F.col(f"_next.{c}").alias(f"bar_{c}") for c in columns))
    return events.join(found, ["ticker", "event_date"], "left")


def with_drift_window(bars: DataFrame, hold: int = 4) -> DataFrame:
    """Per bar as day 0: day0_return, volume_ratio to 20 bars before, highs and closes of the next `hold` bars."""
    ahead = by().rowsBetween(1, hold)
    base = F.avg("volume").over(by().rowsBetween(-20, -1))
    last = F.last("close").over(ahead)
    early = F.max("high").over(by().rowsBetween(1, hold - 1))
    return bars.withColumns({
        "day0_return": F.col("close") / F.lag("close").over(by()) - 1, "volume_ratio": F.when(base > 0, F.col("volume") / base), "post_n": F.count("close").over(ahead),
        "range_high": F.max("high").over(ahead), "range_low": F.min("close").over(ahead), "last_close": last, "prior_high": early,
    })


def post_earnings(df: DataFrame, vol_min: float = 2.5, gap_min: float | None = None) -> DataFrame:
    """Verdict no-data, no-gap, consolidating or setup.

    The breakout compares the last close with the high of the whole run, its own bar included;
    breakout_prior leaves that bar out.
    """
    c = F.col
    gap = F.coalesce((c("day0_return") > 0) & (c("volume_ratio") >= vol_min), F.lit(False))
    if gap_min is not None:
        gap = gap & (c("day0_return") >= gap_min)
    out = F.when(c("post_n") >= 2, c("last_close") > c("range_high"))
    verdict = F.when(c("day0_return").isNull() | c("volume_ratio").isNull() | (c("post_n") == 0), "no-data").when(~gap, "no-gap").when(F.coalesce(out, F.lit(False)), "setup").otherwise("consolidating")
    return df.withColumns({"gap": gap, "breakout": out, "breakout_prior": F.when(c("post_n") >= 2, c("last_close") > c("prior_high")), "verdict": verdict})


def next_event(rows: DataFrame, days: list[str], lookahead: int = 60) -> DataFrame:
    """rows (ticker, date, ord, ...) -> trade_date, ticker, days_until and the rest of the nearest row within
    0 to lookahead days of each trade date, first by ord among equals. One aggregate per date and ticker."""
    rest = [c for c in rows.columns if c not in ("ticker", "date")]
    each = rows.withColumn("trade_date", F.explode(F.array(*(F.to_date(F.lit(d)) for d in days)))).withColumn("days_until", F.datediff("date", "trade_date"))
    near = each.where(F.col("days_until").between(0, lookahead))
    best = near.groupBy("trade_date", "ticker").agg(F.min_by(F.struct("date", "days_until", *rest), F.struct("days_until", "ord")).alias("_b"))
    return best.select("trade_date", "ticker", "_b.*")


def last_surprise(rows: DataFrame, day: str | None = None) -> DataFrame:
    """ticker, date, surprise, side of the latest row with a surprise (ties: the first by ord); no later than `day` if given."""
    rows = rows.withColumn("surprise", surprise(F.col("eps_actual"), F.col("eps_estimate"))).where("surprise is not null")
    if day is not None:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(day)))
    best = rows.groupBy("ticker").agg(F.max_by(F.struct("date", "surprise"), F.struct("date", -F.col("ord"))).alias("_b"))
    return best.select("ticker", "_b.date", "_b.surprise", drift_side(F.col("_b.surprise")).alias("side"))


def macro_imminence(events: DataFrame, days: list[str], window: int = 3) -> DataFrame:
    """trade_date, count_high, min_days: HIGH events within `window` days from each trade date."""
    dates = events.sparkSession.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("trade_date"))
    high = events.where("star = 'HIGH'").withColumn("trade_date", F.explode(F.array(*(F.to_date(F.lit(d)) for d in days)))).withColumn("_in", F.datediff("date", "trade_date")).where(F.col("_in").between(0, window))
    found = high.groupBy("trade_date").agg(F.count("*").alias("count_high"), F.min("_in").alias("min_days"))
    return dates.join(F.broadcast(found), "trade_date", "left").select("trade_date", F.coalesce("count_high", F.lit(0)).alias("count_high"), "min_days")


def fed_imminence(rows: DataFrame, days: list[str], window: int = 14) -> DataFrame:
    """trade_date, days_until, modal_prob: the earliest meeting within the window and its largest probability."""
    each = rows.withColumn("trade_date", F.explode(F.array(*(F.to_date(F.lit(d)) for d in days)))).withColumn("days_until", F.datediff("meeting_date", "trade_date"))
    near = each.where(F.col("days_until").between(0, window) & F.col("probability").isNotNull()).groupBy("trade_date", "days_until").agg(F.max("probability").alias("p"))
    return near.groupBy("trade_date").agg(F.min("days_until").alias("days_until"), F.min_by("p", "days_until").alias("modal_prob"))


def catalyst_scale(df: DataFrame, window: int = 5, baseline: float = 0.02, macro: float = 0.6, fed: float = 0.6, miss: float = 0.5, floor: float = 0.25, block_days: int = 0) -> DataFrame:
    """Add scale, verdict, hard_block. Wants days_until, implied_move, last_side, macro_count, fed_days, backdrop_scale.

    Scales multiply and stay within floor and 1; the first cause names the verdict, a hard block overrides it.
    """
    c, no = F.col, F.lit(False)
    near = F.coalesce(c("days_until").between(0, window), no)
    block = F.coalesce(c("days_until").between(0, block_days), no) if block_days > 0 else no
    has_macro, has_fed = F.coalesce(c("macro_count") > 0, no), c("fed_days").isNotNull()
    back = c("backdrop_scale").isNotNull() & ~has_macro & ~has_fed
    factors = [
        F.when(near, risk_penalty(c("implied_move"), baseline)).otherwise(1.0),
        F.when(near & F.coalesce(c("last_side") == "miss", no), miss).otherwise(1.0),
        F.when(has_macro, macro).otherwise(1.0),
        F.when(has_fed, fed).otherwise(1.0),
        F.when(back, c("backdrop_scale")).otherwise(1.0),
    ]
    scale = factors[0]
    for f in factors[1:]:
        scale = scale * f
    verdict = F.when(block, "earnings-hard-block").when(near, "earnings-window").when(has_macro, "macro-catalyst").when(has_fed, "fed-catalyst").when(back, "macro-backdrop").otherwise("no-imminent-catalyst")
    return df.withColumns({"scale": clamp(scale, floor, 1.0), "verdict": verdict, "hard_block": block})


def macro_backdrop(ten: Column, two: Column, breakeven: Column) -> Column:
    """Scale 0.7 under an inverted curve, times 0.75 with a breakeven above 3."""
    return F.when(F.coalesce(ten < two, F.lit(False)), 0.7).otherwise(1.0) * F.when(F.coalesce(breakeven > 3, F.lit(False)), 0.75).otherwise(1.0)


def spread_band(value: Column, low: float, mid: float, high: float) -> Column:
    """0 low, 1 moderate, 2 high, 3 severe; null where unknown."""
    return F.when(value < low, 0).when(value < mid, 1).when(value <= high, 2).when(value.isNotNull(), 3)


#: Bounds of the bands of high-yield (and BB) and of CCC spreads; names and scales by band.
HY_BANDS, CCC_BANDS = (3.0, 4.5, 5.5), (8.0, 11.0, 15.0)
LEVELS, SCALES = ("low", "moderate", "high", "severe"), (1.0, 0.85, 0.7, 0.5)


def credit_stress(hy: Column, ccc: Column, bb: Column) -> dict[str, Column]:
    """The worst band of the spreads known: its level and scale."""
    worst = F.greatest(spread_band(hy, *HY_BANDS), spread_band(ccc, *CCC_BANDS), spread_band(bb, *HY_BANDS))

    def pick(values: tuple, none) -> Column:
        out = F.when(worst == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(worst == i, v)
        return out.otherwise(none)

    return {"level": pick(LEVELS, "unknown"), "scale": pick(SCALES, 1.0)}


def regime_label(vol_pct: Column, trend: Column, chop: Column) -> Column:
    side = F.when(trend > 0, "bull").otherwise("bear")
    return F.when(vol_pct >= 0.75, "high_vol").when((vol_pct <= 0.25) & (F.abs(trend) >= 0.02), side).when(chop <= 0.3, side).otherwise("neutral")


def overlays(bars: DataFrame, target_vol: float = 0.15) -> DataFrame:
    """Regime overlay on every bar from the 60th: vol_pct, trend, regime, position_scale, momentum60, high_distance.

    vol_pct compares root mean square returns of 21 and 252 bars; the trend mean covers half the
    history, 200 bars at most.
    """
    df = ind.with_vol_scale(ind.with_steps(bars), target_vol)
    square = F.col("log_return") * F.col("log_return")
    df = df.withColumns({"_now": F.sqrt(F.avg(square).over(trail(21))), "_square": square, "_one": F.when(square.isNotNull(), 1.0)})
    df = with_far(df, {"_sum": "_square", "_n": "_one"}, "sum", 12, 21)
    df = df.withColumn("_all", F.when((F.col("bar") > 252) & (F.col("_n") > 0), F.sqrt(F.col("_sum") / F.col("_n")))).drop("_square", "_one", "_sum", "_n")
    # the closes' running sum now and `half` bars ago: up to bar 400 that is among the first 200, which stand in one array
    half = F.least(F.lit(200), F.floor(F.col("bar") / 2)).cast("int")
    df = df.withColumn("_cum", F.sum("close").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    firsts = F.collect_list(F.when(F.col("bar") <= 200, F.col("_cum"))).over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns({"_firsts": firsts, "_before": F.lag("_cum", 200).over(by())})
    mean = (F.col("_cum") - F.when(F.col("bar") > 400, F.col("_before")).otherwise(F.try_element_at("_firsts", F.col("bar") - half))) / half
    df = df.withColumn("_mean", mean).drop("_firsts", "_before", "_cum")
    mean = F.col("_mean")
    vol_pct = F.when((F.col("_now") > 0) & (F.col("_all") > 0) & (F.col("_now") > 1.5 * F.col("_all")), 0.9).when((F.col("_all") > 0) & (F.col("_now") < 0.5 * F.col("_all")), 0.1).otherwise(0.5)
    df = df.where("bar >= 30").withColumns({"vol_pct": vol_pct, "trend": (F.col("close") - mean) / mean, "momentum60": ind.momentum(60, 0), "high_distance": ind.high_distance(252)})
    scale = F.when(F.col("vol_scale") <= 0, 1.0).otherwise(F.round(F.least("vol_scale", F.lit(1.5)), 2))
    return df.where("bar >= 60").withColumns({"regime": regime_label(F.col("vol_pct"), F.col("trend"), F.lit(0.4)), "position_scale": scale}).drop("_now", "_all", "_mean")


def fold_flow(position_scale: Column, distribution: Column) -> Column:
    return position_scale * F.coalesce(clamp(1 - distribution, 0.0, 1.0), F.lit(1.0))


def two_state_regime(returns: DataFrame, steps: int = 50, least: int = 20, whole: int = 50_000, block: int = 512) -> DataFrame:
    """ticker, regime: bull or bear by a two-state Gaussian hidden Markov model of each ticker's returns;
    unknown with too few or constant returns. Fitted by `steps` rounds of expectation maximisation.

    Series of up to `whole` returns (daily bars: some thousand) pass through tasks in order and are fitted side by
    side, CELLS returns at a time: a step of numpy serves a place of all of them. Longer ones are
    cut into blocks of `block` returns, which stay where they are: a block's part of the forward and backward
    passes is a product of 2 x 2 matrices, so the passes are scans over one matrix a block, and every round
    adds up sums from all blocks at once. Their first quantiles are within a millionth of the exact ranks.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    r = F.col("r").cast("double")
    rows = returns.select("ticker", "date", F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r).alias("r"))
    kind = returns.schema["ticker"].dataType.simpleString()
    in_order = rows.repartition("ticker").sortWithinPartitions("ticker", "date")
    fitted = _written(in_order.mapInArrow(_fit_short(steps, least, whole), f"ticker {kind}, regime string"), "regimes")
    long = fitted.where("regime is null").select("ticker")  # left to the blocks
    if long.isEmpty():
        return fitted
    cut = _fit_blocks(rows.where("r is not null").join(long, "ticker"), steps, block)
    later = long.join(cut, "ticker", "left").select("ticker", F.coalesce("regime", F.lit("unknown")).alias("regime"))
    return fitted.where("regime is not null").unionByName(later)


#: Returns that a task fits at once (less than 100 MB with all that a round holds), unless one series has more.
CELLS = 1 << 19


def _fit_short(steps: int, least: int, whole: int):
    """(ticker, date, r) in order -> (ticker, regime); the regime of series with over `whole` returns is null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind, names, series, longest, key, held, size = None, [], [], 0, None, [], 0

        def fitted():
            short = [x for x in series if x is not None]
            labels = iter(_fit_together(short, steps, least))
            return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([None if x is None else next(labels) for x in series], pa.string())], names=["ticker", "regime"])

        def closed():
            names.append(key)
            series.append(np.concatenate(held) if size <= whole else None)
            return max(longest, size if size <= whole else 0)

        for batch in batches:
            kind = batch.column(0).type
            tickers = batch.column(0).dictionary_encode()
            code = tickers.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
            r = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(code)]):
                own = tickers.dictionary[int(code[a])].as_py() if code[a] >= 0 else None
                if held and own != key:
                    longest = closed()
                    held, size = [], 0
                    if len(series) * longest > CELLS or len(series) >= CELLS >> 6:
                        yield fitted()
                        names, series, longest = [], [], 0
                part = r[a:b][~np.isnan(r[a:b])]
                key, size = own, size + len(part)
                held.append(part if size <= whole else part[:0])
        if held:
            longest = closed()
            yield fitted()

    return run


def _fit_together(series, steps: int, least: int) -> list[str]:
    """A label for each series of returns (arrays): all are fitted side by side, the longest first."""
    import numpy as np

    labels = ["unknown"] * len(series)
    own = sorted((i for i, x in enumerate(series) if len(x) >= least and np.ptp(x) > 0), key=lambda i: -len(series[i]))
    if not own:
        return labels
    n = np.array([len(series[i]) for i in own])
    width, places = len(own), int(n[0])
    r = np.zeros((places, width))
    for k, i in enumerate(own):
        r[: n[k], k] = series[i]
    live = np.arange(places)[:, None] < n
    left = live.sum(1).tolist()  # series that have a place t: the first ones
    mean = np.array([np.quantile(series[i], [0.25, 0.75]) for i in own]).T
    var = np.tile([series[i].var() for i in own], (2, 1))
    move = np.tile(np.array([[0.95, 0.05], [0.05, 0.95]])[:, :, None], width)
    start = np.full((2, width), 0.5)
    for _ in range(steps):
        like = np.exp(-((r - mean[:, None]) ** 2) / (2 * var[:, None])) / np.sqrt(2 * math.pi * var[:, None]) + 1e-300
        like *= live
        fwd, bwd, norm = np.zeros_like(like), np.ones_like(like), np.ones_like(r)
        for t, k in enumerate(left):
            p = start if t == 0 else (fwd[:, None, t - 1, :k] * move[:, :, :k]).sum(0)
            p = p * like[:, t, :k]
            norm[t, :k] = p[0] + p[1]
            fwd[:, t, :k] = p / norm[t, :k]
        for t in range(places - 2, -1, -1):
            k = left[t + 1]
            bwd[:, t, :k] = (move[:, :, :k] * (like[:, t + 1, :k] * bwd[:, t + 1, :k])).sum(1) / norm[t + 1, :k]
        post = fwd * bwd
        post /= np.where(live, post.sum(0), 1.0)
        ahead = like[:, 1:] * bwd[:, 1:] / norm[1:]  # 0 past the end of a series
        pair = np.einsum("its,jts->ijs", fwd[:, :-1], ahead) * move
        move, start = pair / pair.sum(1, keepdims=True), post[:, 0]
        weight = post.sum(1)
        mean = (post * r).sum(1) / weight
        var = (post * (r - mean[:, None]) ** 2).sum(1) / weight + 1e-12
    state = post[:, n - 1, np.arange(width)].argmax(0)
    for k, i in enumerate(own):
        labels[i] = "bull" if mean[state[k], k] == mean[:, k].max() else "bear"
    return labels


#: A model: means, variances, move (row by row) and start.
_MODEL = "array<double>"


def _likelihood(r, model):
    """Of returns (blocks, places) under each block's model: (blocks, places, 2)."""
    import numpy as np

    mean, var = model[:, None, 0:2], model[:, None, 2:4]
    return np.exp(-((r[:, :, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var) + 1e-300


def _read_blocks(batch):
    """Returns padded to one length, their numbers, whether a block is its series' first, and the models."""
    import numpy as np

    held = batch.column(batch.schema.get_field_index("r")).to_pylist()
    n = np.array([len(x) for x in held])
    r = np.zeros((len(n), n.max(initial=0)))
    for i, x in enumerate(held):
        r[i, : len(x)] = x
    model = np.array(batch.column(batch.schema.get_field_index("model")).to_pylist()).reshape(-1, 10)
    return r, n, batch.column(batch.schema.get_field_index("block")).to_numpy() == 0, model


def _block_matrix(batches):
    """(ticker, block, r, model) -> (ticker, block, model, matrix): what a block does to the forward pass, scaled."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        r, n, first, model = _read_blocks(batch)
        like, move = _likelihood(r, model), model[:, 4:8].reshape(-1, 2, 2)
        out = np.tile(np.eye(2), (len(n), 1, 1))
        for t in range(r.shape[1]):
            step = np.where((first & (t == 0))[:, None, None], np.eye(2), move) * like[:, t, None, :]
            out = np.where((t < n)[:, None, None], out @ step, out)
            out /= out.sum((1, 2), keepdims=True)
        names = ("ticker", "block", "model")
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out.reshape(-1, 4).tolist(), pa.list_(pa.float64()))], names=[*names, "matrix"])


def _scan(kind):
    """A series' block matrices -> the forward state before each block and the backward one after it."""

    def run(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by("block")
        matrix = np.array(group.column("matrix").to_pylist()).reshape(-1, 2, 2)
        start = np.array(group.column("model")[0].as_py())[8:10]
        before, after = np.empty((len(matrix), 2)), np.empty((len(matrix), 2))
        state = start
        for i, m in enumerate(matrix):
            before[i] = state
            state = state @ m
            state = state / state.sum()
        state = np.ones(2)
        for i in range(len(matrix) - 1, -1, -1):
            after[i] = state
            state = matrix[i] @ state
            state = state / state.sum()
        return pa.table({"ticker": group.column("ticker"), "block": group.column("block"), "before": pa.array(before.tolist(), pa.list_(pa.float64())), "after": pa.array(after.tolist(), pa.list_(pa.float64()))})

    return run


def _block_sums(batches):
    """(ticker, block, r, model, before, after) -> each block's sums: state weights, first and second moments about the
    old means, moves between states, and the states at its first and last return."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        r, n, first, model = _read_blocks(batch)
        before, after = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist()).reshape(-1, 2) for c in ("before", "after"))
        like, move = _likelihood(r, model), model[:, 4:8].reshape(-1, 2, 2)
        fwd, bwd = np.empty_like(like), np.empty_like(like)
        state = before
        for t in range(r.shape[1]):
            p = np.where((first & (t == 0))[:, None], state, np.einsum("bi,bij->bj", state, move)) * like[:, t]
            state = np.where((t < n)[:, None], p / p.sum(1, keepdims=True), state)
            fwd[:, t] = state
        state = after
        for t in range(r.shape[1] - 1, -1, -1):
            inside = (t < n)[:, None]
            bwd[:, t] = state
            b = np.einsum("bij,bj->bi", move, like[:, t] * state)
            state = np.where(inside, b / b.sum(1, keepdims=True), state)
        live = (np.arange(r.shape[1]) < n[:, None])[:, :, None]
        post = fwd * bwd
        post = np.where(live, post / post.sum(2, keepdims=True), 0)
        prior = np.concatenate([before[:, None], fwd[:, :-1]], 1)  # the state before each return
        pair = prior[:, :, :, None] * move[:, None] * (like * bwd)[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        pair = np.where(live[..., None], pair, 0)
        pair[first, 0] = 0  # nothing moves into a series' first return
        off = r[:, :, None] - model[:, None, 0:2]
        last = post[np.arange(len(n)), n - 1]
        sums = np.concatenate([post.sum(1), (post * off).sum(1), (post * off**2).sum(1), pair.sum(1).reshape(-1, 4), np.where(first[:, None], post[:, 0], 0)], 1)
        names = ("ticker", "block", "model")
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(last.tolist(), pa.list_(pa.float64()))], names=[*names, "sums", "last"])


def _fit_blocks(rows: DataFrame, steps: int, block: int) -> DataFrame:
    """Regimes of long series: a few small jobs a round over blocks that are cut and written once."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    kind = rows.schema["ticker"].dataType.simpleString()
    bar = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    cut = rows.withColumn("_bar", bar).groupBy("ticker", F.floor(F.col("_bar") / block).alias("block"))
    blocks = _written(cut.agg(F.transform(F.sort_array(F.collect_list(F.struct("_bar", "r"))), lambda x: x["r"]).alias("r")), "regime-blocks")
    quartiles = F.percentile_approx("r", [0.25, 0.75], 1_000_000)
    first = rows.groupBy("ticker").agg(quartiles.alias("_q"), F.var_pop("r").alias("_v"), F.min("r").alias("_low"), F.max("r").alias("_high")).where("_low < _high")
    models = first.select("ticker", F.array(F.col("_q")[0], F.col("_q")[1], "_v", "_v", *map(F.lit, (0.95, 0.05, 0.05, 0.95, 0.5, 0.5))).alias("model"))
    models = _written(models, "regime-model")
    parts = f"ticker {kind}, block long, model {_MODEL}"
    for _ in range(steps):
        own = blocks.join(models, "ticker")
        matrices = own.mapInArrow(_block_matrix, f"{parts}, matrix array<double>")
        ends = matrices.groupBy("ticker").applyInArrow(_scan(kind), f"ticker {kind}, block long, before array<double>, after array<double>")
        sums = own.join(ends, ["ticker", "block"]).mapInArrow(_block_sums, f"{parts}, sums array<double>, last array<double>")
        total = sums.groupBy("ticker").agg(F.first("model").alias("model"), F.max_by("last", "block").alias("last"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(12)))
        c, old = lambda i: F.col(f"s{i}"), lambda i: F.col("model")[i]
        means, shifts = [old(i) + c(2 + i) / c(i) for i in (0, 1)], [c(2 + i) / c(i) for i in (0, 1)]
        var = [c(4 + i) / c(i) - shifts[i] * shifts[i] + 1e-12 for i in (0, 1)]
        move = [c(6 + 2 * i + j) / (c(6 + 2 * i) + c(7 + 2 * i)) for i in (0, 1) for j in (0, 1)]
        models = _written(total.select("ticker", F.array(*means, *var, *move, c(10), c(11)).alias("model"), "last"), "regime-model")
        last, models = models, models.drop("last")
    state = F.when(F.col("last")[0] >= F.col("last")[1], F.col("model")[0]).otherwise(F.col("model")[1])
    return last.select("ticker", F.when(state == F.greatest(F.col("model")[0], F.col("model")[1]), "bull").otherwise("bear").alias("regime"))


def _written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: rounds don't pile up, and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TIERS = ("super", "big", "mid", "small")


def flow_summary(df: DataFrame, super_weight: float = 0.6, threshold: float = 0.7) -> DataFrame:
    """Order-flow read: nets, distribution_score, divergence, alignment, exhaustion, flag.

    Wants <tier>_in and <tier>_out (null as 0), direction, prior_nets (array of the last weekly nets, oldest first).
    """
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    nets = {t: zero(f"{t}_in") - zero(f"{t}_out") for t in TIERS}
    out_share = lambda t: F.when(zero(f"{t}_in") + zero(f"{t}_out") > 0, zero(f"{t}_out") / F.nullif(zero(f"{t}_in") + zero(f"{t}_out"), F.lit(0.0))).otherwise(0.5)
    df = df.withColumns({"institutional_net": nets["super"] + nets["big"], "retail_net": nets["mid"] + nets["small"], "distribution_score": F.round(out_share("super") * super_weight + out_share("big") * (1 - super_weight), 4)})
    side = F.lower(F.trim(F.coalesce("direction", F.lit(""))))
    inst = c("institutional_net")
    diverge = F.when(inst > 1e-9, F.when(side != "up", "silent_accumulation").otherwise("aligned")).when(inst < -1e-9, F.when(side != "down", "distribution_into_strength").otherwise("aligned")).otherwise("neutral_flow")
    low = sum((F.when(n < -1e-9, 1).otherwise(0) for n in nets.values()), F.lit(0))
    high = sum((F.when(n > 1e-9, 1).otherwise(0) for n in nets.values()), F.lit(0))
    align = F.when(low == 4, "all_four_negative").when(high == 4, "all_four_positive").otherwise("mixed")
    last = F.slice("prior_nets", F.greatest(F.lit(1), F.size("prior_nets") - 2), F.lit(3))
    mean = F.when(F.size("prior_nets") > 0, F.aggregate(last, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(last))
    tired = F.when(F.coalesce(mean > 0, F.lit(False)), F.when(F.abs(inst) <= 0.5 * mean, "exhaustion_candidate").otherwise("active")).otherwise("unknown")
    df = df.withColumns({"divergence": diverge, "alignment": align, "exhaustion": tired})
    bad = (c("distribution_score") >= threshold) | (c("divergence") == "distribution_into_strength") | (c("alignment") == "all_four_negative")
    return df.withColumn("flag", F.when(bad, "distribution").otherwise("ok"))

