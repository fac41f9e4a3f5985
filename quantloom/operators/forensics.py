"""Forensic and valuation scores as column expressions over statement items.

Item columns have plain names, their values a year before end in _prior. A missing input gives null,
never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import or_default, ratio, sample_z

#: Constant and weights of the manipulation score.
M_CONSTANT = -4.84
M_WEIGHTS = {"dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
#: Thresholds of the trap evidence.
TRAP = {"z_floor": 1.78, "m_suspect": -1.78, "mom_floor": 0.0, "accrual_cap": 0.02, "f_floor": 4}


def _pair(c: str) -> tuple[Column, Column]:
    return F.col(c), F.col(f"{c}_prior")


def beneish_indices(textbook: bool = False) -> dict[str, Column]:
    """The eight indices. Asset quality and leverage follow the engine's stated forms (one minus the soft
    share of assets; current liabilities less debt); `textbook` gives the published ones."""
    (rev, rev0), (rec, rec0), (cogs, cogs0) = _pair("revenue"), _pair("receivables"), _pair("cogs")
    (ca, ca0), (ppe, ppe0), (sec, sec0), (ta, ta0) = _pair("current_assets"), _pair("ppe"), _pair("securities"), _pair("total_assets")
    (dep, dep0), (sga, sga0), (cl, cl0), (debt, debt0) = _pair("depreciation"), _pair("sga"), _pair("current_liabilities"), _pair("total_debt")
    soft, soft0 = ratio(ta - ca - ppe - sec, ta), ratio(ta0 - ca0 - ppe0 - sec0, ta0)
    sign = 1 if textbook else -1
    return {
        "dsri": ratio(ratio(rec, rev), ratio(rec0, rev0)),
        "gmi": ratio(ratio(rev0 - cogs0, rev0), ratio(rev - cogs, rev)),
        "aqi": ratio(soft, soft0) if textbook else ratio(1 - soft, 1 - soft0),
        "sgi": ratio(rev, rev0),
        "depi": ratio(ratio(dep0, ppe0 + sign * dep0), ratio(dep, ppe + sign * dep)),
        "sgai": ratio(ratio(sga, rev), ratio(sga0, rev0)),
        "lvgi": ratio(ratio(cl + sign * debt, ta), ratio(cl0 + sign * debt0, ta0)),
        "tata": ratio(F.col("net_income") - F.col("cfo"), ta),
    }


def beneish_m(textbook: bool = False) -> Column:
    """Above -1.78 suspect, below -2.22 clean."""
    total = F.lit(M_CONSTANT)
    for name, index in beneish_indices(textbook).items():
        total = total + M_WEIGHTS[name] * index
    return total


def altman_z() -> Column:
    ta = F.col("total_assets")
    x = [ratio(F.col(c), ta) for c in ("working_capital", "retained_earnings", "operating_income")]
    return 1.2 * x[0] + 1.4 * x[1] + 3.3 * x[2] + 0.6 * ratio(F.col("market_cap"), F.col("total_liabilities")) + ratio(F.col("revenue"), ta)


def piotroski_f() -> Column:
    """Nine checks; a check whose inputs are missing scores 0. The first counts any return on assets but 0.

    Wants roa, leverage, current_ratio, gross_margin, asset_turnover with priors, and shares_issued.
    """
    one = lambda test: F.when(test, 1).otherwise(0)
    rises = lambda c: one(F.col(c) > F.col(f"{c}_prior"))
    cfo, income = F.col("cfo"), F.col("net_income")
    checks = [one(F.coalesce(F.col("roa"), F.lit(0.0)) != 0), one(cfo > 0), one(cfo - income > 0), rises("roa"), one(F.col("leverage") < F.col("leverage_prior")), rises("current_ratio"), one(F.col("shares_issued") <= 0), rises("gross_margin"), rises("asset_turnover")]
    total = checks[0]
    for c in checks[1:]:
        total = total + c
    return F.when(cfo.isNotNull() & income.isNotNull(), total)


def with_piotroski_inputs(fin: DataFrame) -> DataFrame:
    """Derive the ratios that the nine checks compare; priors come from prior items."""
    def of(p: str) -> dict[str, Column]:
        c = lambda name: F.col(name + p)
        return {f"roa{p}": ratio(c("net_income"), c("total_assets")), f"leverage{p}": ratio(c("total_debt"), c("total_assets")), f"current_ratio{p}": ratio(c("current_assets"), c("current_liabilities")), f"gross_margin{p}": ratio(c("revenue") - c("cogs"), c("revenue")), f"asset_turnover{p}": ratio(c("revenue"), c("total_assets"))}

    return fin.withColumns(of("") | of("_prior"))


def enterprise_value() -> Column:
    return F.col("market_cap") + F.col("total_debt") - F.col("cash")


def earnings_yield() -> Column:
    return ratio(F.col("operating_income"), enterprise_value())


def acquirers_multiple() -> Column:
    return ratio(enterprise_value(), F.col("operating_income"))


def accruals_ratio() -> Column:
    ta = F.col("total_assets")
    return F.when(F.abs(ta) >= 1e-9, ratio(F.col("net_income") - F.col("cfo"), ta))


def margin_of_safety(price: Column, intrinsic: Column) -> Column:
    return F.when(intrinsic > 0, (intrinsic - price) / intrinsic)


def net_net() -> Column:
    """Market value under two thirds of current assets less all liabilities."""
    return F.coalesce(F.col("market_cap") < (2.0 / 3.0) * (F.col("current_assets") - F.col("total_liabilities")), F.lit(False))


def trap_evidence(f: Column | None = None, m: Column | None = None, z: Column | None = None, mom12: Column | None = None, accrual: Column | None = None) -> Column:
    """array<string> of the warnings that hold; unmeasured ones are left out."""
    tests = []
    for value, name, test in ((z, "altman_z", lambda v: v < TRAP["z_floor"]), (m, "beneish_m", lambda v: v > TRAP["m_suspect"]), (mom12, "momentum", lambda v: v < TRAP["mom_floor"]), (accrual, "accruals", lambda v: v > TRAP["accrual_cap"]), (f, "f_score", lambda v: v < TRAP["f_floor"])):
        if value is not None:
            tests.append(F.when(test(value), F.lit(name)))
    return F.array_compact(F.array(*tests))


def trap_level(evidence: Column) -> Column:
    return F.when(F.size(evidence) == 0, "LOW").when(F.size(evidence) == 1, "MEDIUM").otherwise("HIGH")


def usd_consistent(currency: Column) -> Column:
    """Currency unset or USD, and total assets not a thousand times the market value."""
    named = F.coalesce(currency.isin("", "USD"), F.lit(True))
    apart = F.coalesce(ratio(F.col("total_assets"), F.when(F.col("market_cap") != 0, F.col("market_cap"))) > 1000, F.lit(False))
    return named & ~apart


def screen(fin: DataFrame, currency: str | None = None) -> DataFrame:
    """Every screen per row: EV family and Z only where the figures are in dollars throughout."""
    df = with_piotroski_inputs(fin)
    usd = usd_consistent(F.col(currency) if currency else F.lit(None).cast("string"))
    df = df.withColumns({
        "usd": usd, "ev": F.when(usd, enterprise_value()), "ev_ebit": F.when(usd, acquirers_multiple()), "earnings_yield": F.when(usd, earnings_yield()),
        "beneish_m": beneish_m(), "altman_z": F.when(usd, altman_z()), "f_score": piotroski_f(), "net_net": usd & net_net(), "accrual": accruals_ratio(),
        "roe": F.when(F.col("total_equity") > 0, F.col("net_income") / F.col("total_equity")),
    })
    evidence = trap_evidence(F.col("f_score"), F.col("beneish_m"), F.col("altman_z"))
    measured = F.col("f_score").isNotNull() | F.col("beneish_m").isNotNull() | F.col("altman_z").isNotNull()
    return df.withColumn("trap", F.when(measured, trap_level(evidence)).otherwise("n/a"))


def decline_driver(trap: Column, accrual: Column, mom12: Column, fcf: Column, roe: Column, eps_yoy: Column) -> Column:
    """clean, caution (one warning) or structural (two, or a high trap level)."""
    flags = [trap == "HIGH", accrual > 0.06, mom12 < -0.2, fcf <= 0, roe <= 0, eps_yoy < -0.3]
    n = sum((F.when(x, 1).otherwise(0) for x in flags), F.lit(0))
    return F.when(F.coalesce(trap == "HIGH", F.lit(False)) | (n >= 2), "structural").when((n == 1) | F.coalesce(trap == "MEDIUM", F.lit(False)), "caution").otherwise("clean")


def fcf(strict_sign: bool = True) -> Column:
    """Operating cash flow less capital spending; with strict_sign whatever sign the spending is given in."""
    spent = F.abs("capex") if strict_sign else F.col("capex")
    return F.col("cfo") - spent


def fcf_yield() -> Column:
    return F.when(F.col("market_cap") > 0, fcf() / F.col("market_cap"))


def dcf(history: Column, rf: Column, beta: Column, shares: Column, cash: Column, debt: Column, erp: float = 0.05, growth: float = 0.025, years: int = 5, grown_tv: bool = False) -> Column:
    """struct(wacc, pv_explicit, pv_tv, ev, equity, price) of a discounted cash flow, or null.

    The base flow is the largest of the history. The terminal value grows that base by a year; with
    grown_tv it grows the last projected flow.
    """
    base = F.array_max(history)
    wacc = F.when(beta >= 0, rf + beta * erp)
    usable = (base > 0) & (shares > 0) & (wacc > growth)
    at = lambda y: F.pow(1 + wacc, y.cast("double"))
    explicit = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda acc, y: acc + base * F.pow(F.lit(1 + growth), y.cast("double")) / at(y))
    flow = base * (1 + growth) ** years if grown_tv else base
    terminal = flow * (1 + growth) / (wacc - growth) / at(F.lit(years))
    value = explicit + terminal
    equity = value + cash - debt
    out = F.struct(wacc.alias("wacc"), explicit.alias("pv_explicit"), terminal.alias("pv_tv"), value.alias("ev"), equity.alias("equity"), (equity / shares).alias("price"))
    return F.when(usable & (equity > 0), out)


def norm_ebit(margins: Column, sales: Column, years: int = 5) -> Column:
    """The upper median of the last margins (an array, oldest first) times current sales."""
    kept = F.filter(margins, lambda m: m.isNotNull())
    last = F.array_sort(F.slice(kept, F.greatest(F.lit(1), F.size(kept) - years + 1), F.lit(years)))
    return F.when((sales > 0) & (F.size(kept) > 0), F.element_at(last, (F.floor(F.size(last) / 2) + 1).cast("int")) * sales)


def valuation_z(current: Column, n: Column, mean: Column, sd: Column, least: int = 4) -> dict[str, Column]:
    """z of a multiple against its history (given as count, mean, sample deviation) and its verdict."""
    z = F.when(n >= least, sample_z(current, mean, sd))
    return {"z": z, "z_verdict": F.when(z.isNull(), "unknown").when(z <= -1.5, "cheap").when(z >= 1.5, "rich").otherwise("fair")}


def sheet_health(debt_to_equity: Column, current_ratio: Column) -> Column:
    no = F.lit(False)
    return F.when(debt_to_equity.isNotNull() | current_ratio.isNotNull(), F.coalesce(debt_to_equity < 1, no) | F.coalesce(current_ratio > 1.5, no))


def profitability(fcf: Column, fcf_yield: Column, roe: Column) -> Column:
    """Free cash flow above 0 (its yield where it is not measured) and return on equity above 15 %, over what
    is measured; null where nothing is."""
    cash = F.coalesce(fcf > 0, fcf_yield > 0)
    return F.when(cash.isNotNull() | roe.isNotNull(), F.coalesce(cash, F.lit(True)) & F.coalesce(roe > 0.15, F.lit(True)))


def period_multiple(price: Column, per_share: Column) -> Column:
    """Today's price over a period's value a share; null unless both are above 0."""
    return F.when((price > 0) & (per_share > 0), price / per_share)


def cost_of_goods(cogs: Column, cost_of_revenue: Column) -> Column:
    """A cost of 0 counts as missing."""
    return or_default(cogs, cost_of_revenue)


def yield_band(value: Column, floor: float = 0.06) -> Column:
    return F.when(value >= floor, "floor-pass").when(value < floor, "below-floor")
