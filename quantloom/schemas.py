"""Schemas of the engine's inputs. Missing values are null throughout; money and prices are doubles."""

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, vwap double"
#: Bulk flat file: one CSV row per ticker and session, times in nanoseconds.
FLAT_FILE = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
STATEMENT_ITEMS = "ticker string, period_end date, statement string, label string, value double"
REFLECTION_LEDGER = "analyst string, ticker string, trade_date date, delta_r double, ts double"
CALIBRATION_LEDGER = "analyst string, ticker string, trade_date date, confidence double, won boolean, ts double"
TRADE_JOURNAL = (
    "ts double, ticker string, date date, price double, pillars map<string, boolean>, "
    "pullback struct<candidate: boolean, rr: double, stop: double>, session map<string, boolean>, "
    "exit_class string, fomo boolean, note string"
)
DECISIONS = "date date, ticker string, rating string, pending boolean, raw double, alpha double, holding_days int, decision string, reflection string"
#: Imbalance frames have keys that differ only in case (T, t), so they are read as maps.
NOI_FRAME = "map<string, string>"
PREDICTION_EVENTS = "title string, markets array<struct<question: string, outcomes: string, outcomePrices: string, volumeNum: double, endDate: string, closed: boolean>>"
