"""Limits and defaults, passed explicitly; nothing here is read inside executors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_position_pct: float = 0.30
    max_book_position_pct: float = 0.45
    cvar_budget_pct: float = 0.03
    max_drawdown_pct: float = 0.10
    sector_cap: float = 0.35
    max_name_weight: float = 0.25
    min_names: int = 10
    risk_per_trade: float = 0.01
    atr_mult: float = 2.0
    target_vol: float = 0.15
    position_odds: float = 1.0
    kelly_fraction: float = 0.25
    cost_bps: float = 10.0
    stale_days: int = 10
    #: Dimension tables up to so many rows are broadcast; larger ones are joined by shuffle.
    broadcast_rows: int = 100_000
