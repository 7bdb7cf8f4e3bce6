"""Thresholds of the market rules. Fixed values, all overridable per job."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SAFE, INSUFFICIENT, ADJUST, UNAVAILABLE = "safe", "insufficient_history", "requires_adjustment", "unavailable"


@dataclass(frozen=True)
class Rules:
    liquid_turnover: float = 100.0
    rows_movers: int = 50
    rows_active: int = 100
    rows_volume: int = 50
    rows_extremes: int = 50
    near_pct: float = 2.0
    vol_period: int = 20
    vol_multiple: float = 2.0
    gain_pct: float = 3.0
    loss_pct: float = -3.0
    extreme_rows: int = 252
    extreme_span: int = 400
    sma_span_factor: float = 2.0
    vol_span: int = 45
    event_threshold: float = 0.05
    # file and day gates
    min_eq_rows: int = 500
    min_universe: int = 1000
    max_universe_change: float = 0.10
    max_invalid_share: float = 0.05
    max_conflict_share: float = 0.01
    max_stale_days: int = 5
    extreme_change_pct: float = 50.0
    # sectors
    min_sector_members: int = 5
    min_counted_share: float = 0.8
    min_coverage: float = 0.8
    min_fresh_share: float = 0.9
    label_max_age: int = 60
    min_eligible_sectors: int = 3
    sector_rows: int = 5
    # ticks
    max_price: float = 1e7
    future_ms: int = 60_000
    jump_ratio: float = 0.25
    jump_confirm: float = 0.05
    live_rows: int = 10
    live_extreme_pct: float = 40.0
    frame_gap_ms: int = 10_000
    index_stale_ms: int = 20_000
    live_coverage: float = 0.90
    max_age_ms: int = 20_000
    skew_ms: int = 5_000

    def but(self, **changes) -> "Rules":
        return replace(self, **changes)


# Spans wide enough for series that trade about once in five days.
WIDE = Rules(extreme_span=3000, sma_span_factor=20.0, vol_span=400)
