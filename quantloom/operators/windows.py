"""Trailing windows over a ticker's bars, and decayed sums for recursive smoothers."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(*parts: str) -> WindowSpec:
    """A ticker's bars by date; with `parts`, those that also agree in these columns."""
    return Window.partitionBy("ticker", *parts).orderBy("date")


def trail(n: int, *parts: str) -> WindowSpec:
    """The last n bars, the current one included."""
    return by(*parts).rowsBetween(1 - n, 0)


def prior(first: int, last: int = 1, *parts: str) -> WindowSpec:
    """Bars from `first` to `last` places before the current one."""
    return by(*parts).rowsBetween(-first, -last)


def full(n: int, value: Column) -> Column:
    """Null before bar n."""
    return F.when(F.col("bar") >= n, value)


def sma(c: str | Column, n: int) -> Column:
    return full(n, F.avg(c).over(trail(n)))


def decayed_sums(df: DataFrame, sums: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add for each name (term, q) the sum over bars up to the current one of q^(bars ago) * term.

    In three rounds: each adds up `wide` sums of the round before, `wide` times as many bars apart. What is older
    than the last round reaches weighs less than a double can hold (q^reach < 1e-17). All rounds lag rows in a
    ticker's order of dates, so that one sort serves them and every other window over the ticker's bars.
    """
    reach = math.ceil(40 / min(-math.log(q) for _, q in sums.values()))
    wide, apart = math.ceil(reach ** (1 / 3)), 1
    at = df.withColumns({f"_s{i}": F.coalesce(term, F.lit(0.0)) for i, (term, _) in enumerate(sums.values())})
    for _ in range(3):
        part = lambda i, q, n: F.lag(f"_s{i}", n, 0.0).over(by()) * q**n if n else F.col(f"_s{i}")
        total = lambda i, q: sum_of([part(i, q, k * apart) for k in reversed(range(wide)) if q ** (k * apart) > 1e-20])
        at = at.withColumns({f"_s{i}": total(i, q) for i, (_, q) in enumerate(sums.values())})
        apart *= wide
    return at.withColumns({name: F.col(f"_s{i}") for i, name in enumerate(sums)}).drop(*(f"_s{i}" for i in range(len(sums))))


def sum_of(parts: list[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def with_far(df: DataFrame, columns: dict[str, str], combine: str, few: int, many: int, skip: int = 0, *parts: str) -> DataFrame:
    """Add for each name the sum or maximum (combine) of a column over few * many bars that end `skip` bars before
    the current one: over the last `few` bars first, then over `many` of those, so that a bar costs few + many
    steps. Bars before the first and nulls don't count; a sum without any is 0."""
    own = F.sum if combine == "sum" else F.max
    df = df.withColumns({f"_f{i}": own(c).over(trail(few, *parts)) for i, c in enumerate(columns.values())})
    lags = lambda i: [F.lag(f"_f{i}", skip + few * k).over(by(*parts)) if skip + k else F.col(f"_f{i}") for k in range(many)]
    total = lambda i: sum_of([F.coalesce(x, F.lit(0.0)) for x in lags(i)]) if combine == "sum" else F.greatest(*lags(i))
    return df.withColumns({name: total(i) for i, name in enumerate(columns)}).drop(*(f"_f{i}" for i in range(len(columns))))


def decayed_sum(df: DataFrame, term: Column, q: float, name: str) -> DataFrame:
    return decayed_sums(df, {name: (term, q)})


def emas(df: DataFrame, means: dict[str, tuple[str, int]], first: int = 1) -> DataFrame:
    """Add for each name (column, n) the exponential mean with k = 2 / (n + 1), seeded with the plain mean of the first n values.

    `first` is the bar at which the columns start; a result is null before first + n - 1.
    """
    bar, sums = F.col("bar"), {}
    run = by().rowsBetween(Window.unboundedPreceding, 0)  # at the seed's bar it holds just the first n values
    df = df.withColumns({f"_m{i}": F.avg(F.when(bar >= first, F.col(c))).over(run) for i, (c, _) in enumerate(means.values())})
    for i, (name, (c, n)) in enumerate(means.items()):
        k, seed = 2.0 / (n + 1), first + n - 1
        sums[name] = (F.when(bar > seed, k * F.col(c)).when(bar == seed, F.col(f"_m{i}")), 1 - k)
    out = decayed_sums(df, sums)
    return out.withColumns({name: F.when(bar >= first + n - 1, F.col(name)) for name, (_, n) in means.items()}).drop(*(f"_m{i}" for i in range(len(means))))


def ema(df: DataFrame, c: str, n: int, name: str, first: int = 1) -> DataFrame:
    return emas(df, {name: (c, n)}, first)


def block_sums(df: DataFrame, sums: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add for each name (term, q) the sum over bars up to the current one of q^(bars ago) * term.

    The powers are taken inside blocks of bars short enough for doubles; a block starts from the sum
    at the end of the one before. What is older weighs less than a double can hold (q^block < 1e-17).
    All sums of a call share their blocks, and so one sort of each ticker's bars.
    """
    rates = [-math.log(q) for _, q in sums.values()]
    block = math.ceil(40 / min(rates))
    if block * max(rates) > 600:  # powers would leave the range of doubles: the slowest on its own
        slow = max(sums, key=lambda n: sums[n][1])
        return block_sums(block_sums(df, {slow: sums[slow]}), {n: x for n, x in sums.items() if n != slow})
    at = df.withColumns({f"_t{i}": F.coalesce(term, F.lit(0.0)) for i, (term, _) in enumerate(sums.values())})
    at = at.withColumns({"_b": F.floor((F.col("bar") - 1) / block), "_r": (F.col("bar") - 1) % block})
    inner = Window.partitionBy("ticker", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda q, e: F.pow(F.lit(q), e)
    at = at.withColumns({f"_s{i}": F.sum(F.col(f"_t{i}") * power(q, -F.col("_r"))).over(inner) * power(q, F.col("_r")) for i, (_, q) in enumerate(sums.values())})
    before = Window.partitionBy("ticker").orderBy("_b").rangeBetween(-1, -1)
    last = F.max_by(F.struct(*(f"_s{i}" for i in range(len(sums)))), "_r").over(before)
    at = at.withColumn("_last", last)
    out = {name: F.col(f"_s{i}") + F.coalesce(F.col(f"_last._s{i}"), F.lit(0.0)) * power(q, F.col("_r") + 1) for i, (name, (_, q)) in enumerate(sums.items())}
    return at.withColumns(out).drop("_b", "_r", "_last", *(f"_{x}{i}" for i in range(len(sums)) for x in "ts"))


def weighted_means(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Add for each name (column, q) the exponential mean whose weights q^i are normalised by their sum over the values that are not null."""
    sums = {}
    for name, (c, q) in means.items():
        sums |= {f"_{name}_top": (F.col(c), q), f"_{name}_all": (F.when(F.col(c).isNotNull(), 1.0), q)}
    out = block_sums(df, sums)
    return out.withColumns({name: F.try_divide(f"_{name}_top", f"_{name}_all") for name in means}).drop(*sums)


def latest(df: DataFrame) -> DataFrame:
    """Each ticker's last row: one aggregate with partial maxima, no sort."""
    columns = [c for c in df.columns if c != "ticker"]
    return df.groupBy("ticker").agg(F.max_by(F.struct(*columns), "date").alias("_last")).select("ticker", *(F.col(f"_last.{c}").alias(c) for c in columns))
