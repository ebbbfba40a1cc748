"""Every threshold in one place. Operators take a ``Params`` and never hard-code a number twice."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # ingest and change capture
    min_fraction_of_previous: float = 0.90
    max_fail_fraction: float = 0.25
    overlap_days: int = 14
    max_stale_days: int = 30
    fx_margin_days: int = 10
    fx_start: str = "1999-01-01"
    refresh_days: int = 20
    recheck_days: int = 180
    # price cleaning
    spike_ratio: float = 1.3
    jump_ratio: float = 1.3
    clean_window: int = 21
    clean_passes: int = 2
    min_clean_obs: int = 5
    # returns
    stale_days: int = 7
    month_slack_days: int = 3
    gap_days: int = 10
    return_scale: int = 10000
    periods: tuple = (1, 3, 5, 10)
    # tracking error and clusters
    te_smooth_days: int = 5
    te_window_periods: int = 60
    te_threshold: float = 0.01
    te_thresholds_report: tuple = (0.005, 0.0075, 0.01, 0.0125)
    min_overlap: int = 12
    robust_clip_sigma: float = 4.0
    robust_prefilter_te: float = 0.25
    # representative choice
    min_history_years: float = 5.0
    dist_fee_penalty: float = 0.10
    hysteresis_fee_pp: float = 0.05
    listing_currency_preference: tuple = ("NOK", "EUR", "SEK", "DKK", "USD")
    # ticker candidates
    max_candidates: int = 8
    per_suffix: int = 2
    start_slack_days: int = 120
    history_floor: str = "2008-01-01"
    # share class check
    tol_1y_pp: float = 2.0
    tol_3y_pp: float = 5.0
    price_ratio_tol: float = 0.03
    usable_years: int = 3
    # portfolio model
    market_risk_premium: float = 0.045
    history_weight: float = 0.25
    estimation_years: int = 5
    trading_cost: float = 0.0025
    narrow_cap: float = 0.25
    twin_reg: float = 0.90
    twin_sec: float = 0.85
    twin_top: float = 0.60
    twin_ast: float = 0.90
    twin_cheaper: float = 0.05
    min_alloc: float = 0.05


DEFAULTS = Params()
