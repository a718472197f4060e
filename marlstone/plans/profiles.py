"""Ranking profiles as declarations: gates, snapshot metrics, score layers, horizons. Weights and thresholds are fixed values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from marlstone.functions.sqlexpr import band, clamp, count_of, div, ladder, ln, penalties, percentile, tag, weighted


@dataclass(frozen=True)
class Profile:
    """rule: how the as-of date follows from the run's (features.calendar). snapshot and layers map names to expressions; an expression may use features (f_...), and what came in layers before."""

    profile_id: str
    rule: str
    gates: list[str]
    snapshot: dict[str, str]
    layers: list[dict[str, str]]
    ranking_keys: list[str]
    horizons: dict[str, str]

    @property
    def keep(self) -> int:
        """How many of a ticker's last bars are looked at: the history that it must have."""
        return int(re.fullmatch(r"f_bars >= (\d+)", self.gates[0])[1])


def by_market(tw: float, us: float) -> str:
    return f"CASE WHEN market = 'TW' THEN {tw:.6f} ELSE {us:.6f} END"


PRICE_FLOOR = by_market(10.0, 5.0)
LOW_LIQUIDITY, HIGH_LIQUIDITY = by_market(20e6, 5e6), by_market(50e6, 10e6)


def history(n: int, unique: bool = False, on: str = "as_of") -> list[str]:
    """At least n bars, the last of them on the as-of date (or on the run's: run_date)."""
    out = [f"f_bars >= {n}", f"f_last_date = {on}"]
    return out + (["f_repeated_dates = 0"] if unique else [])


def retained(n: int, ordered: bool = True) -> list[str]:
    return [f"f_fine_{n} = {n}"] + ([f"f_ordered_{n} = {n}"] if ordered else [])


def tradable(floor: str = HIGH_LIQUIDITY, stale: bool = True) -> list[str]:
    out = [
        f"f_close >= {PRICE_FLOOR}", f"f_avg_tv_20d >= {floor}", f"f_active_days_60d >= {by_market(50, 55)}", f"f_zero_days_20d <= {by_market(3, 1)}",
    ]
    return out + (["f_stale_both_20d < 5.0"] if stale else [])


MOMENTUM_GATES = [
    *history(274), "f_fine_cav_274 = 274", f"f_close >= {PRICE_FLOOR}", f"f_avg_tv_20d >= {LOW_LIQUIDITY}", "f_active_days_274d >= 230", "f_zero_days_20d <= 2",
    "f_volatility_12_1 > 0.001", "f_volatility_6_1 > 0.001",
]
NORMAL_VOLATILITY = ["f_volatility_60d > 0.0001", "f_volatility_20d > 0.0"]
AS_OF_NUMBER = "CAST(year(as_of) * 10000 + month(as_of) * 100 + day(as_of) AS DOUBLE)"
RATIO_5_20 = div("f_avg_tv_5d", "f_avg_tv_20d")


def over(a: str, b: str) -> str:
    return f"({div(a, b)} - 1.0)"


def same(*names: str) -> dict[str, str]:
    return {n: f"f_{n}" for n in names}


SAMPLE_PRICE_TREND = Profile(
    "sample_price_trend_v1",
    "A",
    [*history(121), "f_used_121 = 144", f"f_close >= {PRICE_FLOOR}", f"f_avg_tv_20d >= {LOW_LIQUIDITY}"],
    {"avg_traded_value_20d_local": "f_avg_tv_20d", **same("return_60d", "return_120d")},
    [{"score_return_60d": "return_60d", "score_return_120d": "return_120d"}],
    ["score_return_60d", "score_return_120d"],
    {"midterm": "return_60d", "longterm": "return_120d"},
)

_MOMENTUM = {
    "avg_traded_value_20d_local": "f_avg_tv_20d",
    **same("momentum_return_12_1", "momentum_return_6_1", "volatility_12_1", "volatility_6_1"),
    "risk_adjusted_momentum_12_1": div("f_momentum_return_12_1", "f_volatility_12_1"),
    "risk_adjusted_momentum_6_1": div("f_momentum_return_6_1", "f_volatility_6_1"),
    "short_term_strength_20d": "f_return_20d",
}
_MOMENTUM_SCORES = {
    "score_risk_adjusted_momentum_12_1": "risk_adjusted_momentum_12_1",
    "score_risk_adjusted_momentum_6_1": "risk_adjusted_momentum_6_1",
    "score_short_term_strength_20d": div("short_term_strength_20d", "volatility_6_1"),
}
MOMENTUM = Profile(
    "momentum_v1",
    "A",
    MOMENTUM_GATES,
    _MOMENTUM,
    [_MOMENTUM_SCORES],
    list(_MOMENTUM_SCORES),
    {
        "swing": weighted((0.5, "score_risk_adjusted_momentum_6_1"), (0.3, "score_risk_adjusted_momentum_12_1"), (0.2, "score_short_term_strength_20d")),
        "midterm": weighted((0.5, "score_risk_adjusted_momentum_12_1"), (0.5, "score_risk_adjusted_momentum_6_1")),
    },
)

_MQ_LAYERS = [
    {
        **_MOMENTUM_SCORES,
        "score_short_term_extension_20d": "short_term_extension_20d", "score_distance_from_ma20": "distance_from_ma20",
        "score_volatility_12_1": "volatility_12_1", "score_volatility_6_1": "volatility_6_1",
        "moving_average_structure_score": "moving_average_structure_raw_score / 100.0", "drawdown_control_score": "1.0 + max_drawdown_252d",
        "uptrend_consistency_score": "uptrend_consistency_raw_score / 100.0",
    },
    {
        "trend_quality_score": weighted((0.4, "moving_average_structure_score"), (0.3, "drawdown_control_score"), (0.3, "uptrend_consistency_score")),
        "momentum_blend_score": weighted((0.55, "score_risk_adjusted_momentum_12_1"), (0.35, "score_risk_adjusted_momentum_6_1"), (0.1, "score_short_term_strength_20d")),
        "overheat_score": weighted((0.6, "score_short_term_extension_20d"), (0.4, "score_distance_from_ma20")),
        "overheat_penalty_score": "greatest(0.0, (score_short_term_extension_20d - 0.25) * 20.0) + greatest(0.0, (score_distance_from_ma20 - 0.20) * 20.0)",
        "tag_risk_overheated": tag("score_short_term_extension_20d >= 0.30 OR score_distance_from_ma20 >= 0.25"),
        "tag_risk_extended_from_ma20": tag("score_distance_from_ma20 >= 0.15"),
        "tag_risk_high_volatility": tag("score_volatility_12_1 >= 0.06 OR score_volatility_6_1 >= 0.06"),
        "tag_risk_large_drawdown": tag("max_drawdown_252d <= -0.30"),
        "tag_risk_thin_recent_volume": tag(f"{div('avg_traded_value_5d_local', 'avg_traded_value_20d_local')} < 0.50"),
        "tag_risk_data_quality_warning": tag("data_quality_extreme_return_flag = 1.0"),
    },
    {
        "tag_risk_weak_trend_quality": tag("momentum_blend_score >= 7.0 AND trend_quality_score <= 0.45"),
        "tag_positive_strong_momentum": tag("momentum_blend_score >= 7.0"),
        "tag_positive_stable_uptrend": tag("trend_quality_score >= 0.80 AND tag_risk_large_drawdown = 0.0"),
        "tag_positive_early_breakout": tag("adjusted_close >= prior_60d_high_adjusted_close AND momentum_blend_score >= 5.0 AND momentum_blend_score <= 20.0 AND overheat_score < 0.20 AND tag_risk_overheated = 0.0"),
    },
]
MOMENTUM_QUALITY = Profile(
    "momentum_quality_v1",
    "A",
    MOMENTUM_GATES,
    {
        "profile_metrics_version": "2.0",
        **_MOMENTUM,
        "avg_traded_value_5d_local": "f_avg_tv_5d",
        "ma20": "f_sma_20d", "ma60": "f_sma_60d", "ma120": "f_sma_120d", "ma200": "f_sma_200d",
        "moving_average_structure_raw_score": penalties(
            ("f_adjusted_close > f_sma_20d", 15), ("f_sma_20d > f_sma_60d", 20), ("f_sma_60d > f_sma_120d", 20), ("f_sma_120d > f_sma_200d", 20),
            ("f_sma_60d > f_sma_60d_before", 10), ("f_sma_120d > f_sma_120d_before", 10), ("f_sma_200d > f_sma_200d_before", 5),
        ),
        "max_drawdown_252d": "f_max_drawdown_252d", "above_ma60_ratio_126d": "f_above_ma60", "positive_21d_return_ratio_126d": "f_positive_blocks",
        "uptrend_consistency_raw_score": "100.0 * (0.70 * f_above_ma60 + 0.30 * f_positive_blocks)",
        "short_term_extension_20d": "f_return_20d", "distance_from_ma20": over("f_adjusted_close", "f_sma_20d"), "prior_60d_high_adjusted_close": "f_prior_high_60d",
        "data_quality_extreme_return_flag": tag("f_extreme_273 > 0.80"),
    },
    _MQ_LAYERS,
    [k for layer in _MQ_LAYERS for k in layer],
    {
        "composite": "momentum_blend_score + 0.50 * trend_quality_score - 0.40 * overheat_penalty_score",
        "swing": weighted((0.45, "score_risk_adjusted_momentum_6_1"), (0.25, "score_risk_adjusted_momentum_12_1"), (0.2, "score_short_term_strength_20d"), (0.1, "trend_quality_score")) + " - 0.60 * overheat_penalty_score",
        "midterm": weighted((0.45, "score_risk_adjusted_momentum_12_1"), (0.35, "score_risk_adjusted_momentum_6_1"), (0.2, "trend_quality_score")),
    },
)

_VQ_LAYERS = [
    {
        "score_low_volatility_20d": percentile("volatility_20d", "low"), "score_low_volatility_60d": percentile("volatility_60d", "low"),
        "score_downside_volatility_60d": percentile("downside_volatility_60d", "low"), "score_drawdown_control_120d": percentile("max_drawdown_120d"),
        "score_range_tightness_20d": percentile("median_range_pct_20d", "low"), "score_range_tightness_60d": percentile("median_range_pct_60d", "low"),
        "score_volatility_stability_60d": percentile("volatility_stability_60d", "low"),
    },
    {
        "volatility_control_score": weighted((0.45, "score_low_volatility_60d"), (0.35, "score_low_volatility_20d"), (0.2, "score_downside_volatility_60d")),
        "trading_smoothness_score": weighted((0.5, "score_range_tightness_20d"), (0.3, "score_range_tightness_60d"), (0.2, "score_volatility_stability_60d")),
        "drawdown_quality_score": "score_drawdown_control_120d",
        "penalty_score": penalties(("data_quality_extreme_return_flag = 1.0", 0.15), ("stale_close_days_20d >= 3.0", 0.1), (f"volatility_stability_60d > {ln('2.0')}", 0.1)),
    },
]
VOLATILITY_QUALITY = Profile(
    "volatility_quality_v1",
    "A",
    [*history(126), *retained(126), *tradable(stale=False), *NORMAL_VOLATILITY],
    {
        "profile_metrics_version": "1.0", "avg_traded_value_20d_local": "f_avg_tv_20d", **same("volatility_20d", "volatility_60d"),
        "downside_volatility_60d": "f_downside_rms_60d", "volatility_20d_to_60d_ratio": div("f_volatility_20d", "f_volatility_60d"),
        "volatility_stability_60d": f"round(abs({ln(div('f_volatility_20d', 'f_volatility_60d'))}), 10)",
        **same("max_drawdown_120d", "median_range_pct_20d", "median_range_pct_60d"),
        "zero_volume_days_20d": "f_zero_days_20d", "active_trading_days_60d": "f_active_days_60d", "stale_close_days_20d": "f_stale_adjusted_20d",
        "data_quality_extreme_return_flag": tag("f_extreme_60 > 0.80"),
    },
    _VQ_LAYERS,
    [k for layer in _VQ_LAYERS for k in layer],
    {
        "composite": weighted((0.45, "volatility_control_score"), (0.3, "drawdown_quality_score"), (0.25, "trading_smoothness_score")) + " - penalty_score",
        "shortterm": weighted((0.45, "score_low_volatility_20d"), (0.35, "score_range_tightness_20d"), (0.2, "score_volatility_stability_60d")) + " - penalty_score",
        "stable": weighted((0.4, "score_low_volatility_60d"), (0.25, "score_downside_volatility_60d"), (0.25, "score_drawdown_control_120d"), (0.1, "score_range_tightness_60d")) + " - penalty_score",
    },
)

_LQ_LAYERS = [
    {
        "log_tv_20": "round(ln(1.0 + avg_traded_value_20d_local), 10)", "log_tv_60": "round(ln(1.0 + avg_traded_value_60d_local), 10)",
        "log_amihud_20": "round(ln(greatest(amihud_illiquidity_20d, 1.0e-300)), 8)", "log_amihud_60": "round(ln(greatest(amihud_illiquidity_60d, 1.0e-300)), 8)",
    },
    {
        "score_log_traded_value_20d": percentile("log_tv_20"), "score_log_traded_value_60d": percentile("log_tv_60"),
        "score_amihud_20d": percentile("log_amihud_20", "low"), "score_amihud_60d": percentile("log_amihud_60", "low"),
        "score_traded_value_stability_60d": percentile("traded_value_cv_60d", "low"), "score_traded_value_concentration_60d": percentile("traded_value_concentration_60d", "low"),
        "score_range_tightness_20d": percentile("median_range_pct_20d", "low"), "score_range_tightness_60d": percentile("median_range_pct_60d", "low"),
        "score_recent_traded_value_ratio": clamp("traded_value_5d_to_20d_ratio", 0.0, 2.0) + " / 2.0",
        "score_trading_continuity_60d": clamp("(active_trading_days_60d / 60.0 - zero_volume_days_60d / 60.0 - stale_close_days_60d / 60.0)", 0.0, 1.0),
    },
    {
        "depth_score": weighted((0.55, "score_log_traded_value_20d"), (0.35, "score_log_traded_value_60d"), (0.1, "score_recent_traded_value_ratio")),
        "friction_score": weighted((0.55, "score_amihud_60d"), (0.3, "score_range_tightness_60d"), (0.15, "score_trading_continuity_60d")),
        "stability_score": weighted((0.45, "score_traded_value_stability_60d"), (0.3, "score_traded_value_concentration_60d"), (0.25, "score_recent_traded_value_ratio")),
        "penalty_score": penalties(
            ("traded_value_5d_to_20d_ratio < 0.75", 0.1), ("traded_value_5d_to_20d_ratio > 3.00", 0.05), ("zero_volume_days_20d > 0.0", 0.05), ("traded_value_concentration_60d > 0.20", 0.05),
            ("score_amihud_60d <= 0.20", 0.05), ("score_range_tightness_60d <= 0.20", 0.05), ("stale_close_days_20d >= 5.0", 0.1), ("data_quality_extreme_return_flag = 1.0", 0.2),
        ),
        "tag_risk_thin_liquidity": tag(f"avg_traded_value_20d_local <= {by_market(62.5e6, 12.5e6)}"), "tag_risk_recent_liquidity_fade": tag("traded_value_5d_to_20d_ratio < 0.75"),
        "tag_risk_traded_value_spike": tag("traded_value_concentration_60d > 0.20"), "tag_risk_high_impact": tag("score_amihud_60d <= 0.20"),
        "tag_risk_wide_range": tag("score_range_tightness_60d <= 0.20"), "tag_risk_stale_trading": tag("stale_close_days_60d > 0.0"),
        "tag_risk_data_quality_warning": tag("data_quality_extreme_return_flag = 1.0"),
    },
    {"tag_positive_deep_liquidity": tag("depth_score >= 0.80"), "tag_positive_stable_liquidity": tag("stability_score >= 0.75")},
]
LIQUIDITY_QUALITY = Profile(
    "liquidity_quality_v1",
    "A",
    [*history(63), *retained(63, ordered=False), *tradable(stale=False), f"f_avg_tv_5d >= 0.50 * {HIGH_LIQUIDITY}", "f_amihud_20d IS NOT NULL", "f_amihud_60d IS NOT NULL"],
    {
        "profile_metrics_version": "1.0", "avg_traded_value_5d_local": "f_avg_tv_5d", "avg_traded_value_20d_local": "f_avg_tv_20d", "avg_traded_value_60d_local": "f_avg_tv_60d",
        "median_traded_value_20d_local": "f_median_tv_20d", "median_traded_value_60d_local": "f_median_tv_60d", "amihud_illiquidity_20d": "f_amihud_20d", "amihud_illiquidity_60d": "f_amihud_60d",
        **same("traded_value_cv_60d", "traded_value_concentration_60d", "median_range_pct_20d", "median_range_pct_60d"),
        "traded_value_5d_to_20d_ratio": RATIO_5_20, "zero_volume_days_20d": "f_zero_days_20d", "zero_volume_days_60d": "f_zero_days_60d", "active_trading_days_60d": "f_active_days_60d",
        "stale_close_days_20d": "f_stale_close_19", "stale_close_days_60d": "f_stale_close_59", "data_quality_extreme_return_flag": tag("f_extreme_59 > 0.80"),
    },
    _LQ_LAYERS,
    [k for layer in _LQ_LAYERS[1:] for k in layer],
    {
        "composite": weighted((0.45, "depth_score"), (0.35, "friction_score"), (0.2, "stability_score")) + " - penalty_score",
        "shortterm": weighted((0.45, "score_log_traded_value_20d"), (0.25, "score_recent_traded_value_ratio"), (0.2, "score_amihud_20d"), (0.1, "score_range_tightness_20d")) + " - penalty_score",
        "stable": weighted((0.35, "score_log_traded_value_60d"), (0.25, "score_traded_value_stability_60d"), (0.2, "score_traded_value_concentration_60d"), (0.2, "score_trading_continuity_60d")) + " - penalty_score",
    },
)

UPTREND_R2 = "CASE WHEN f_slope_60d > 0.0 THEN f_r2_60d ELSE 0.0 END"
_FAILS = ["trend_slope_60d <= 0.0", "return_60d < 0.0", "price_vs_sma_50d < 0.0", "price_vs_sma_200d < 0.0", "sma_50d_vs_sma_200d < 0.0"]
_WEAK = [
    "trend_slope_60d > 0.0 AND trend_slope_60d < 0.0002", "return_60d >= 0.0 AND return_60d < 0.02", "price_vs_sma_50d >= 0.0 AND price_vs_sma_50d < 0.01",
    "price_vs_sma_200d >= 0.0 AND price_vs_sma_200d < 0.02", "sma_50d_vs_sma_200d >= 0.0 AND sma_50d_vs_sma_200d < 0.01",
]
# What failures of the structure cap a score at, with a large drawdown and without.
HARD_CAPS_LARGE = ((0, 0.65), (1, 0.35), (2, 0.30), (3, 0.25), (4, 0.20), (5, 0.15))
HARD_CAPS = ((1, 0.40), (2, 0.35), (3, 0.30), (4, 0.25), (5, 0.20))

_SEVERE, _MODERATE, _LARGE = "return_20d > 0.50 OR price_vs_sma_50d > 0.30", "return_20d > 0.30 OR price_vs_sma_50d > 0.20", "max_drawdown_120d <= -0.25"
_TQ_LAYERS = [
    {
        **{f"score_{x}": percentile(x) for x in ("return_20d", "return_60d", "return_120d", "trend_consistency_60d", "price_vs_sma_50d", "price_vs_sma_200d", "sma_50d_vs_sma_200d", "pct_below_120d_high")},
        "score_trend_slope_60d": percentile("trend_slope_60d", "positive"), "score_drawdown_control_120d": percentile("max_drawdown_120d"),
        "score_uptrend_r2_60d": "CASE WHEN trend_slope_60d > 0.0 THEN uptrend_r2_60d ELSE 0.0 END",
        "trend_cleanliness_cap_score": ladder(("trend_slope_60d <= 0.0", 0.35), ("uptrend_r2_60d < 0.10", 0.45), ("uptrend_r2_60d < 0.25", 0.65), ("uptrend_r2_60d < 0.50", 0.7)),
        "weak_structure_fail_count": count_of(*_FAILS), "weak_positive_structure_count": count_of(*_WEAK),
        "overextension_cap_score": ladder((_SEVERE, 0.6), (_MODERATE, 0.75)),
        "tag_structure_uptrend": tag("trend_slope_60d > 0.0 AND return_60d > 0.0 AND price_vs_sma_50d > 0.0 AND sma_50d_vs_sma_200d > 0.0"),
        "tag_structure_breakout_proximity": tag("pct_below_120d_high >= -0.03"),
        "tag_structure_consistent_uptrend": tag("trend_slope_60d > 0.0 AND return_60d > 0.0 AND trend_r2_60d >= 0.50 AND trend_consistency_60d >= 0.55"),
        **{f"tag_structure_{n}": tag(c) for n, c in zip(("nonpositive_60d_slope", "negative_60d_return", "below_sma_50d", "below_sma_200d", "sma_50d_below_sma_200d"), _FAILS)},
        "tag_structure_large_drawdown": tag(_LARGE), "tag_structure_overextended": tag(_MODERATE), "tag_data_stale_trading": tag("stale_close_days_20d >= 3.0"),
    },
    {
        "trend_strength_score": weighted((0.35, "score_return_120d"), (0.25, "score_return_60d"), (0.25, "score_trend_slope_60d"), (0.15, "score_price_vs_sma_200d")),
        "trend_cleanliness_score": "least(" + weighted((0.35, "score_uptrend_r2_60d"), (0.25, "score_trend_consistency_60d"), (0.25, "score_sma_50d_vs_sma_200d"), (0.15, "score_drawdown_control_120d")) + ", trend_cleanliness_cap_score)",
        "breakout_position_score": weighted((0.4, "score_pct_below_120d_high"), (0.25, "score_return_20d"), (0.2, "score_price_vs_sma_50d"), (0.15, "score_sma_50d_vs_sma_200d")),
        "drawdown_control_score": "score_drawdown_control_120d",
        "hard_structure_cap_score": ladder(*[(f"({_LARGE}) AND weak_structure_fail_count = {n}.0", v) for n, v in HARD_CAPS_LARGE], *[(f"weak_structure_fail_count = {n}.0", v) for n, v in HARD_CAPS]),
        "trend_magnitude_cap_score": ladder(("weak_structure_fail_count <> 0.0", 1.0), ("weak_positive_structure_count >= 3.0", 0.45), ("weak_positive_structure_count = 2.0", 0.6), ("weak_positive_structure_count = 1.0", 0.75)),
        "penalty_score": penalties(("stale_close_days_20d >= 3.0", 0.1), (_SEVERE, 0.15), (f"NOT ({_SEVERE}) AND ({_MODERATE})", 0.1), *[(c, 0.1) for c in _FAILS])
        + " + CASE WHEN weak_structure_fail_count = 0.0 THEN 0.05 * weak_positive_structure_count ELSE 0.0 END + CASE WHEN trend_slope_60d > 0.0 AND uptrend_r2_60d < 0.50 THEN 0.05 ELSE 0.0 END"
        + f" + CASE WHEN {_LARGE} THEN 0.10 ELSE 0.0 END",
        "tag_structure_weak_trend_component": tag("weak_structure_fail_count > 0.0"),
    },
    {"structure_cap_score": "least(hard_structure_cap_score, trend_magnitude_cap_score, trend_cleanliness_cap_score, overextension_cap_score)"},
    {"tag_structure_cap_active": tag("structure_cap_score < 1.0")},
]


def _capped(raw: str, *caps: str) -> str:
    return f"least({raw} - penalty_score, {', '.join(caps)})"


TREND_QUALITY = Profile(
    "trend_quality_v1",
    "B",
    [*history(252, unique=True), *retained(252), *tradable(), *NORMAL_VOLATILITY, "f_extreme_200 <= 0.80"],
    {
        "profile_metrics_version": "1.0", "asof_bar_date_yyyymmdd": AS_OF_NUMBER, "avg_traded_value_20d_local": "f_avg_tv_20d",
        **same("return_20d", "return_60d", "return_120d", "volatility_60d"), "trend_slope_60d": "f_slope_60d", "trend_r2_60d": "f_r2_60d", "uptrend_r2_60d": UPTREND_R2,
        "trend_consistency_60d": "f_positive_days_60d", "price_vs_sma_50d": over("f_adjusted_close", "f_sma_50d"), "price_vs_sma_200d": over("f_adjusted_close", "f_sma_200d"),
        "sma_50d_vs_sma_200d": over("f_sma_50d", "f_sma_200d"), "pct_below_120d_high": over("f_adjusted_close", "f_high_120d"), "max_drawdown_120d": "f_max_drawdown_120d",
        "zero_volume_days_20d": "f_zero_days_20d", "active_trading_days_60d": "f_active_days_60d", "stale_close_days_20d": "f_stale_both_20d",
    },
    _TQ_LAYERS,
    [k for layer in _TQ_LAYERS for k in layer],
    {
        "composite": _capped(weighted((0.4, "trend_strength_score"), (0.3, "trend_cleanliness_score"), (0.2, "breakout_position_score"), (0.1, "drawdown_control_score")), "structure_cap_score"),
        "shortterm": _capped(
            weighted(
                (0.2, "score_return_20d"), (0.15, "score_return_60d"), (0.15, "score_pct_below_120d_high"), (0.15, "score_price_vs_sma_50d"), (0.1, "score_sma_50d_vs_sma_200d"),
                (0.1, "score_trend_slope_60d"), (0.05, "score_uptrend_r2_60d"), (0.05, "score_trend_consistency_60d"), (0.05, "score_drawdown_control_120d"),
            ), "structure_cap_score",
        ),
        "midterm": _capped(
            weighted(
                (0.25, "score_return_120d"), (0.2, "score_trend_slope_60d"), (0.15, "score_sma_50d_vs_sma_200d"), (0.15, "score_drawdown_control_120d"), (0.1, "score_trend_consistency_60d"),
                (0.1, "trend_cleanliness_score"), (0.05, "score_uptrend_r2_60d"),
            ), "structure_cap_score",
        ),
    },
)

_TP_CAPS = ("structure_cap_score", "pullback_depth_cap_score", "overheat_cap_score", "breakdown_cap_score")
_P120 = "pullback_from_120d_high"
_BREAK = "price_vs_sma_50d < -0.03 OR low_10d_vs_sma_50d < -0.06 OR position_20d < 0.25"
_TP_TAGS = {
    "tag_setup_healthy_pullback": tag(f"{_P120} >= -0.15 AND {_P120} <= -0.03 AND return_120d_ex_recent_20d > 0.0 AND trend_slope_60d > 0.0 AND sma_50d_vs_sma_200d > 0.0 AND price_vs_sma_200d > 0.0"),
    "tag_setup_near_sma50": tag("price_vs_sma_50d >= -0.02 AND price_vs_sma_50d <= 0.05"),
    "tag_risk_false_pullback": tag(f"{_P120} > -0.03 OR return_120d_ex_recent_20d <= 0.05"),
    "tag_risk_breakdown": tag(_BREAK),
    "tag_risk_deep_drawdown": tag(f"{_P120} <= -0.20 OR max_drawdown_120d <= -0.25"),
    "tag_risk_liquidity_fade": tag("traded_value_5d_to_20d_ratio < 0.75"),
    "tag_risk_still_overheated": tag(f"{_P120} > -0.03 OR price_vs_sma_20d > 0.10 OR price_vs_sma_50d > 0.12"),
    "tag_risk_volatility_spike": tag("volatility_20d_to_60d_ratio > 1.75"),
    "tag_risk_data_quality_warning": tag("data_quality_extreme_return_flag = 1.0"),
}
_TP_LAYERS = [
    {
        "position_20d": clamp("close_position_20d_range", 0.0, 1.0),
        **{f"pct_{x}": percentile(x) for x in ("return_120d_ex_recent_20d", "return_60d", "risk_adjusted_return_120d_ex_recent_20d", "sma_50d_vs_sma_200d", "price_vs_sma_200d", "trend_consistency_60d", "max_drawdown_120d")},
        "pct_slope": percentile("trend_slope_60d", "positive"), "pct_ratio": percentile("volatility_20d_to_60d_ratio", "low"), "pct_stale": percentile("stale_close_days_20d", "low"),
        "tp_failures": count_of("trend_slope_60d <= 0.0", "price_vs_sma_200d <= 0.0", "sma_50d_vs_sma_200d <= 0.0", "return_120d_ex_recent_20d <= 0.0"),
        "band_sma20": band("price_vs_sma_20d", (-0.03, 0.04), (-0.12, 0.16)), "band_low10": band("low_10d_vs_sma_50d", (-0.03, 0.03), (-0.12, 0.12)),
    },
    {
        "score_prior_strength": "pct_return_120d_ex_recent_20d",
        "trend_intact_score": weighted((0.25, "pct_slope"), (0.2, "uptrend_r2_60d"), (0.2, "pct_sma_50d_vs_sma_200d"), (0.2, "pct_price_vs_sma_200d"), (0.15, "pct_trend_consistency_60d")),
        "score_pullback_depth": band(_P120, (-0.15, -0.05), (-0.30, 0.0)), "score_volatility_adjusted_pullback": band("volatility_adjusted_pullback_120d", (0.8, 1.8), (0.0, 3.2)),
        "score_support_proximity": band("price_vs_sma_50d", (-0.02, 0.05), (-0.10, 0.18)), "score_pullback_stability": band("days_since_60d_high", (3.0, 30.0), (0.0, 60.0)),
        "score_liquidity_continuity": clamp(f"({clamp('traded_value_5d_to_20d_ratio', 0.0, 1.0)} - 0.50 * {clamp('stale_close_days_20d / 5.0', 0.0, 1.0)})", 0.0, 1.0),
        "prior_strength_score": weighted((0.5, "pct_return_120d_ex_recent_20d"), (0.3, "pct_return_60d"), (0.2, "pct_risk_adjusted_return_120d_ex_recent_20d")),
        "structure_cap_score": ladder(("tp_failures >= 3.0", 0.25), ("tp_failures = 2.0", 0.4), ("tp_failures = 1.0", 0.6), ("uptrend_r2_60d < 0.20 OR trend_consistency_60d < 0.45", 0.75)),
        "pullback_depth_cap_score": ladder((f"{_P120} > -0.01", 0.45), (f"{_P120} > -0.03", 0.65), (f"{_P120} < -0.25", 0.55), (f"{_P120} < -0.20", 0.7), (f"{_P120} < -0.18", 0.85)),
        "overheat_cap_score": ladder((f"{_P120} > -0.01 OR price_vs_sma_20d > 0.14 OR price_vs_sma_50d > 0.18", 0.45), (f"{_P120} > -0.03 OR price_vs_sma_20d > 0.10 OR price_vs_sma_50d > 0.12", 0.6), ("price_vs_sma_20d > 0.08 OR price_vs_sma_50d > 0.10", 0.75)),
        "breakdown_cap_score": ladder(("price_vs_sma_50d < -0.08 OR low_10d_vs_sma_50d < -0.10 OR position_20d < 0.10", 0.4), (_BREAK, 0.6), ("max_drawdown_120d <= -0.25", 0.75)),
        **_TP_TAGS,
    },
    {
        "score_trend_intact": "trend_intact_score",
        "pullback_setup_score": weighted((0.55, "score_pullback_depth"), (0.25, "score_volatility_adjusted_pullback"), (0.2, "score_pullback_stability")),
        "support_quality_score": weighted((0.45, "score_support_proximity"), (0.25, "band_sma20"), (0.2, "position_20d"), (0.1, "band_low10")),
        "risk_control_score": weighted((0.35, "pct_max_drawdown_120d"), (0.25, "pct_ratio"), (0.25, "score_liquidity_continuity"), (0.15, "pct_stale")),
        "penalty_score": weighted((0.12, "tag_risk_false_pullback"), (0.15, "tag_risk_breakdown"), (0.12, "tag_risk_deep_drawdown"), (0.08, "tag_risk_liquidity_fade"), (0.1, "tag_risk_still_overheated"), (0.08, "tag_risk_volatility_spike"), (0.2, "tag_risk_data_quality_warning")),
        "tag_setup_trend_resume": tag("tag_setup_healthy_pullback = 1.0 AND position_20d >= 0.50 AND price_vs_sma_20d >= -0.05"),
    },
]
_TP_PARTS = ("prior_strength_score", "trend_intact_score", "pullback_setup_score", "support_quality_score", "risk_control_score")
TREND_PULLBACK_QUALITY = Profile(
    "trend_pullback_quality_v1",
    "B",
    [
        *history(252, unique=True), *retained(252), *tradable(), *NORMAL_VOLATILITY, "f_extreme_251 <= 0.80", "f_slope_60d > 0.0", "f_sma_50d > f_sma_200d", "f_adjusted_close > f_sma_200d",
        f"{over('f_adjusted_close', 'f_high_120d')} >= -0.30",
    ],
    {
        "profile_metrics_version": "1.0", "asof_bar_date_yyyymmdd": AS_OF_NUMBER, "avg_traded_value_20d_local": "f_avg_tv_20d", "avg_traded_value_5d_local": "f_avg_tv_5d",
        "median_traded_value_20d_local": "f_median_tv_20d", "traded_value_5d_to_20d_ratio": RATIO_5_20,
        **same("return_20d", "return_60d", "return_120d", "return_120d_ex_recent_20d", "volatility_20d", "volatility_60d", "sma_20d", "sma_50d", "sma_200d", "days_since_60d_high", "days_since_120d_high", "max_drawdown_120d"),
        "risk_adjusted_return_120d_ex_recent_20d": div("f_return_120d_ex_recent_20d", "f_volatility_60d"), "volatility_20d_to_60d_ratio": div("f_volatility_20d", "f_volatility_60d"),
        "trend_slope_60d": "f_slope_60d", "uptrend_r2_60d": UPTREND_R2, "trend_consistency_60d": "f_positive_days_60d",
        "price_vs_sma_20d": over("f_adjusted_close", "f_sma_20d"), "price_vs_sma_50d": over("f_adjusted_close", "f_sma_50d"), "price_vs_sma_200d": over("f_adjusted_close", "f_sma_200d"),
        "sma_20d_vs_sma_50d": over("f_sma_20d", "f_sma_50d"), "sma_50d_vs_sma_200d": over("f_sma_50d", "f_sma_200d"),
        "pullback_from_60d_high": over("f_adjusted_close", "f_high_60d"), "pullback_from_120d_high": over("f_adjusted_close", "f_high_120d"),
        "volatility_adjusted_pullback_120d": f"round({div('abs' + over('f_adjusted_close', 'f_high_120d'), 'f_volatility_60d * sqrt(20.0)')}, 10)",
        "close_position_20d_range": f"CASE WHEN f_top_20d = f_bottom_20d THEN 0.5 ELSE {div('f_adjusted_close - f_bottom_20d', 'f_top_20d - f_bottom_20d')} END",
        "low_10d_vs_sma_50d": over("f_low_10d", "f_sma_50d"), "zero_volume_days_20d": "f_zero_days_20d", "active_trading_days_60d": "f_active_days_60d", "stale_close_days_20d": "f_stale_both_20d",
        "data_quality_extreme_return_flag": "0.0",
    },
    _TP_LAYERS,
    [k for layer in _TP_LAYERS[1:] for k in layer],
    {
        h: _capped(weighted(*zip(w, _TP_PARTS)), *_TP_CAPS)
        for h, w in {"composite": (0.25, 0.25, 0.25, 0.15, 0.1), "near_support": (0.2, 0.2, 0.25, 0.25, 0.1), "trend_resume": (0.25, 0.3, 0.15, 0.2, 0.1)}.items()
    },
)

PROFILES = {p.profile_id: p for p in (SAMPLE_PRICE_TREND, MOMENTUM, MOMENTUM_QUALITY, VOLATILITY_QUALITY, LIQUIDITY_QUALITY, TREND_QUALITY, TREND_PULLBACK_QUALITY)}
