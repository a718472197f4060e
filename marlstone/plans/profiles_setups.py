"""Four more profiles: base breakouts, relative strength, mean reversion, defensive compounding."""

from __future__ import annotations

from marlstone.functions.sqlexpr import band, clamp, count_of, div, ladder, penalties, percentile, tag, weighted

from .profiles import AS_OF_NUMBER, NORMAL_VOLATILITY, RATIO_5_20, UPTREND_R2, Profile, _capped, history, over, retained, same, tradable

RATIO, FADE = "traded_value_5d_to_20d_ratio", "traded_value_5d_to_20d_ratio < 0.75"
WARNING = {"tag_risk_data_quality_warning": tag("data_quality_extreme_return_flag = 1.0")}
EXTREME = tag("f_extreme_60 > 0.50")
POSITION = f"CASE WHEN f_top_20d = f_bottom_20d THEN 0.5 ELSE {div('f_adjusted_close - f_bottom_20d', 'f_top_20d - f_bottom_20d')} END"
P20, P50, P200 = (over("f_adjusted_close", f"f_sma_{n}d") for n in (20, 50, 200))
S50 = over("f_sma_50d", "f_sma_200d")
HEAD = {
    "profile_metrics_version": "1.0", "asof_bar_date_yyyymmdd": AS_OF_NUMBER, "avg_traded_value_20d_local": "f_avg_tv_20d", "avg_traded_value_5d_local": "f_avg_tv_5d",
    "median_traded_value_20d_local": "f_median_tv_20d", RATIO: RATIO_5_20, **same("volatility_20d", "volatility_60d"), "volatility_20d_to_60d_ratio": div("f_volatility_20d", "f_volatility_60d"),
    "zero_volume_days_20d": "f_zero_days_20d", "active_trading_days_60d": "f_active_days_60d", "stale_close_days_20d": "f_stale_both_20d", "data_quality_extreme_return_flag": EXTREME,
}
AVERAGES = {**same("sma_20d", "sma_50d", "sma_200d"), "price_vs_sma_20d": P20, "price_vs_sma_50d": P50, "price_vs_sma_200d": P200, "sma_50d_vs_sma_200d": S50}
TREND = {"trend_slope_60d": "f_slope_60d", "uptrend_r2_60d": UPTREND_R2, "trend_consistency_60d": "f_positive_days_60d"}


def tightness(high: str, low: str, width: float) -> str:
    return f"1.0 - {clamp(f'(({div(high, low)} - 1.0) / {width:.6f})', 0.0, 1.0)}"


def tags_penalty(**weights: float) -> str:
    return weighted(*[(w, f"tag_risk_{n}") for n, w in weights.items()])


def keys(layers: list[dict[str, str]], *helpers: str) -> list[str]:
    return [k for layer in layers for k in layer if k.startswith(("score_", "tag_")) or k.endswith("_score") if k not in helpers]


# ---------------------------------------------------------------- base breakout
_NEAR = "pct_below_120d_high >= -0.15 AND pct_below_120d_high <= 0.08"
_CONFIRMED = "pct_below_120d_high >= -0.005 AND pct_below_120d_high <= 0.08 AND {p} >= 0.70 AND traded_value_5d_to_20d_ratio >= 0.90"
_VALID = (
    "base_depth_120d >= -0.30 AND base_depth_120d <= -0.02 AND base_depth_60d <= 0.0 AND base_tightness_20d >= 0.30 AND base_tightness_60d >= 0.25 AND trend_slope_60d > 0.0"
    " AND price_vs_sma_200d >= 0.05 AND sma_50d_vs_sma_200d >= 0.0 AND return_120d >= 0.08 AND (return_60d >= 0.0 OR return_120d >= 0.12)"
)
_BB_SNAPSHOT = {
    **HEAD, **same("return_20d", "return_60d", "return_120d"), **TREND, **AVERAGES, "sma_20d_vs_sma_50d": over("f_sma_20d", "f_sma_50d"),
    "pct_below_60d_high": over("f_adjusted_close", "f_prior_high_60d"), "pct_below_120d_high": over("f_adjusted_close", "f_prior_high_120d"),
    "base_depth_60d": over("f_low_60d", "f_prior_high_60d"), "base_depth_120d": over("f_low_120d", "f_prior_high_120d"),
    "base_tightness_20d": tightness("f_top_20d", "f_bottom_20d", 0.20), "base_tightness_60d": tightness("f_high_60d", "f_low_60d", 0.35), "close_position_20d_range": POSITION,
}


def _with(expr: str, parts: dict[str, str]) -> str:
    """An expression on metrics as one on features: gates come before the metrics have names."""
    for name in sorted(parts, key=len, reverse=True):
        expr = expr.replace(f" {name} ", f" ({parts[name]}) ")
    return expr.strip()


def gate(expr: str, snapshot: dict[str, str]) -> str:
    return _with(" " + expr.replace("(", "( ") + " ", snapshot)


_BB_LAYERS = [
    {
        "position_20d": clamp("close_position_20d_range", 0.0, 1.0), "pct_slope": percentile("trend_slope_60d", "positive"),
        **{f"pct_{x}": percentile(x) for x in ("sma_50d_vs_sma_200d", "price_vs_sma_200d", "trend_consistency_60d", "base_depth_120d")},
        "pct_return_60d": percentile("return_60d", "positive"), "pct_return_120d": percentile("return_120d", "positive"), "pct_ratio": percentile("volatility_20d_to_60d_ratio", "low"),
        "bb_failures": count_of("trend_slope_60d <= 0.0", "price_vs_sma_200d <= 0.0", "sma_50d_vs_sma_200d < 0.0"),
    },
    {
        "score_base_tightness": weighted((0.6, "base_tightness_20d"), (0.4, "base_tightness_60d")),
        "score_base_depth": band("base_depth_120d", (-0.20, -0.06), (-0.35, 0.02)),
        "score_breakout_proximity": band("pct_below_120d_high", (-0.05, 0.03), (-0.15, 0.08)),
        "score_volume_confirmation": band(RATIO, (0.90, 2.00), (0.45, 3.50)),
        "score_prior_strength": weighted((0.45, "pct_return_60d"), (0.55, "pct_return_120d")),
        "score_risk_control": weighted((0.4, "pct_base_depth_120d"), (0.35, "pct_ratio"), (0.25, clamp(RATIO, 0.0, 1.0))),
        "tag_setup_valid_base": tag(_VALID),
        "tag_risk_false_breakout": tag(f"pct_below_120d_high >= -0.01 AND (position_20d < 0.45 OR {FADE})"),
        "tag_risk_overextended_breakout": tag("return_20d > 0.35 OR price_vs_sma_50d > 0.20 OR pct_below_120d_high > 0.08"),
        "tag_risk_weak_base": tag("base_depth_120d < -0.30 OR base_depth_120d > -0.02 OR base_depth_60d > 0.0 OR base_tightness_20d < 0.25 OR base_tightness_60d < 0.20 OR return_120d < 0.08 OR price_vs_sma_200d < 0.05"),
        "tag_risk_breakdown": tag("price_vs_sma_20d < -0.08 OR price_vs_sma_50d < -0.03 OR price_vs_sma_200d <= 0.0 OR sma_50d_vs_sma_200d < 0.0 OR trend_slope_60d <= 0.0"),
        "tag_risk_liquidity_fade": tag(FADE), **WARNING,
        "structure_cap_score": ladder(("bb_failures >= 2.0", 0.35), ("bb_failures = 1.0", 0.55), ("return_120d < 0.08 OR price_vs_sma_200d < 0.05", 0.45), ("return_60d < 0.0 AND return_120d < 0.12", 0.7), ("uptrend_r2_60d < 0.15 OR trend_consistency_60d < 0.45", 0.75)),
        "breakout_extension_cap_score": ladder(*[(f"return_20d > {r:.2f} OR price_vs_sma_50d > {p:.2f} OR pct_below_120d_high > {h:.2f}", c) for r, p, h, c in ((0.5, 0.3, 0.15, 0.45), (0.35, 0.2, 0.08, 0.65), (0.25, 0.15, 0.05, 0.8))]),
        "base_depth_cap_score": ladder(
            ("base_depth_120d > -0.02 OR base_depth_60d > -0.01", 0.5), ("base_depth_120d > -0.04 OR base_depth_60d > -0.02", 0.7), ("base_depth_120d < -0.30 OR base_tightness_20d < 0.20", 0.55),
            ("base_depth_120d < -0.25 OR base_tightness_60d < 0.25", 0.7), ("base_depth_120d < -0.20 OR base_tightness_20d < 0.35", 0.85),
        ),
        "false_breakout_cap_score": ladder((f"position_20d < 0.20 OR {RATIO} < 0.50", 0.55), ("position_20d < 0.35 OR volatility_20d_to_60d_ratio > 2.0", 0.7), ("position_20d < 0.45 OR volatility_20d_to_60d_ratio > 1.60", 0.85)),
    },
    {
        "score_trend_structure": weighted((0.2, "pct_slope"), (0.15, "uptrend_r2_60d"), (0.15, "pct_sma_50d_vs_sma_200d"), (0.15, "pct_price_vs_sma_200d"), (0.1, "pct_trend_consistency_60d"), (0.25, "score_prior_strength")),
        "base_quality_score": weighted((0.5, "score_base_tightness"), (0.35, "score_base_depth"), (0.15, "position_20d")),
        "breakout_setup_score": weighted((0.55, "score_breakout_proximity"), (0.25, "position_20d"), (0.2, "score_volume_confirmation")),
        "volume_confirmation_score": "score_volume_confirmation", "risk_control_score": "score_risk_control", "prior_strength_score": "score_prior_strength",
        "tag_setup_near_breakout": tag(f"tag_setup_valid_base = 1.0 AND {_NEAR}"), "tag_setup_confirmed_breakout": tag(f"tag_setup_valid_base = 1.0 AND {_CONFIRMED.format(p='position_20d')}"),
        "penalty_score": tags_penalty(false_breakout=0.14, overextended_breakout=0.12, weak_base=0.14, breakdown=0.16, liquidity_fade=0.08, data_quality_warning=0.2) + " + " + penalties(("stale_close_days_20d > 0.0", 0.03)),
    },
    {"trend_structure_score": "score_trend_structure"},
]
_BB_PARTS = ("base_quality_score", "breakout_setup_score", "trend_structure_score", "volume_confirmation_score", "risk_control_score")
BASE_BREAKOUT_QUALITY = Profile(
    "base_breakout_quality_v1",
    "C",
    [
        *history(252, unique=True), *retained(252), *tradable(), *NORMAL_VOLATILITY, "f_extreme_251 <= 0.80", "f_slope_60d > 0.0", "f_adjusted_close > f_sma_200d", "f_sma_50d >= f_sma_200d", "f_max_drawdown_120d > -0.35",
        gate(_NEAR, _BB_SNAPSHOT), gate(_VALID, _BB_SNAPSHOT), f"{RATIO_5_20} >= 0.50",
    ],
    _BB_SNAPSHOT,
    _BB_LAYERS,
    keys(_BB_LAYERS),
    {
        h: _capped(weighted(*zip(w, _BB_PARTS)), "structure_cap_score", "breakout_extension_cap_score", "base_depth_cap_score", "false_breakout_cap_score")
        for h, w in {"composite": (0.25, 0.25, 0.2, 0.15, 0.15), "near_breakout": (0.35, 0.35, 0.15, 0.1, 0.05), "breakout_readiness": (0.1, 0.35, 0.25, 0.2, 0.1)}.items()
    },
)

# ---------------------------------------------------------------- relative strength
_RS = ("score_relative_strength_20d", "score_relative_strength_60d", "score_relative_strength_120d")
_CHASE = "return_20d > {:.2f} OR price_vs_sma_50d > {:.2f} OR pct_below_120d_high > {:.2f} OR largest_daily_return_60d > {:.2f} OR gain_concentration_60d > {:.2f}"
_VOLATILE = "volatility_60d > {:.2f} OR volatility_20d > {:.2f} OR volatility_20d_to_60d_ratio > {:.2f}"
_RS_FAILS = ("trend_slope_60d <= 0.0", "price_vs_sma_50d < 0.0", "price_vs_sma_200d <= 0.0", "sma_50d_vs_sma_200d < 0.0")
_RS_LAYERS = [
    {
        **{f"score_relative_strength_{n}d": percentile(f"return_{n}d", "positive") for n in (20, 60, 120)},
        "pct_6_1": percentile("risk_adjusted_momentum_6_1", "positive"), "pct_12_1": percentile("risk_adjusted_momentum_12_1", "positive"), "pct_slope": percentile("trend_slope_60d", "positive"),
        **{f"pct_{x}": percentile(x) for x in ("sma_50d_vs_sma_200d", "price_vs_sma_200d", "trend_consistency_60d")},
        "score_new_high_proximity": band("pct_below_120d_high", (-0.05, 0.04), (-0.20, 0.20)), "score_drawdown_control": percentile("max_drawdown_120d"), "score_volatility_control": percentile("volatility_60d", "low"),
        "score_liquidity_confirmation": band(RATIO, (0.80, 2.00), (0.45, 3.50)), "rs_failures": count_of(*_RS_FAILS),
        "overheat_cap_score": ladder((_CHASE.format(0.55, 0.35, 0.2, 0.3, 0.65), 0.45), (_CHASE.format(0.35, 0.25, 0.12, 0.2, 0.45), 0.65), ("return_20d > 0.25 OR price_vs_sma_50d > 0.18 OR gain_concentration_60d > 0.35", 0.82)),
        "volatility_cap_score": ladder((_VOLATILE.format(0.1, 0.14, 2.2), 0.45), (_VOLATILE.format(0.06, 0.08, 1.6), 0.65), (_VOLATILE.format(0.04, 0.06, 1.3), 0.82)),
        "drawdown_cap_score": ladder(("max_drawdown_120d < -0.35", 0.45), ("max_drawdown_120d < -0.25", 0.65), ("max_drawdown_120d < -0.18", 0.82)),
        "concentration_cap_score": ladder(*[(f"largest_daily_return_60d > {a:.2f} OR gain_concentration_60d > {b:.2f}", c) for a, b, c in ((0.3, 0.7, 0.45), (0.2, 0.45, 0.65), (0.14, 0.35, 0.82))]),
        "tag_positive_new_high_leader": tag("pct_below_60d_high >= -0.03 AND pct_below_120d_high >= -0.03"), "tag_risk_chasing_extension": tag(_CHASE.format(0.35, 0.25, 0.12, 0.2, 0.45)),
        "tag_risk_large_drawdown": tag("max_drawdown_120d < -0.25"), "tag_risk_weak_trend_structure": tag(" OR ".join(_RS_FAILS)), "tag_risk_liquidity_fade": tag(FADE), **WARNING,
    },
    {
        "score_risk_adjusted_momentum": weighted((0.45, "pct_6_1"), (0.55, "pct_12_1")),
        "score_relative_strength_persistence": f"0.40 * least({', '.join(_RS)}) + 0.60 * (({' + '.join(_RS)}) / 3.0)",
        "score_trend_quality": weighted((0.22, "pct_slope"), (0.18, "uptrend_r2_60d"), (0.2, "pct_sma_50d_vs_sma_200d"), (0.2, "pct_price_vs_sma_200d"), (0.2, "pct_trend_consistency_60d")),
        "risk_control_score": weighted((0.45, "score_drawdown_control"), (0.35, "score_volatility_control"), (0.2, "score_liquidity_confirmation")),
        "trend_structure_cap_score": ladder(("rs_failures >= 2.0", 0.35), ("rs_failures = 1.0", 0.55), ("trend_consistency_60d < 0.45", 0.75)),
        "tag_risk_recent_rs_fade": tag("return_20d < 0.0 OR (score_relative_strength_20d < 0.30 AND score_relative_strength_60d >= 0.65)"),
        "tag_risk_high_volatility": tag(_VOLATILE.format(0.06, 0.08, 1.6) + " OR score_volatility_control < 0.25"),
    },
    {
        "leader_quality_score": weighted((0.25, _RS[0]), (0.25, _RS[1]), (0.25, _RS[2]), (0.15, "score_risk_adjusted_momentum"), (0.1, "score_new_high_proximity")),
        "relative_strength_persistence_score": "score_relative_strength_persistence", "trend_durability_score": "score_trend_quality",
        "tag_positive_rs_leader": tag(
            "score_relative_strength_20d >= 0.40 AND score_relative_strength_60d >= 0.65 AND score_relative_strength_120d >= 0.65 AND score_risk_adjusted_momentum >= 0.50"
            " AND return_20d > 0.0 AND return_60d > 0.0 AND return_120d > 0.0 AND risk_adjusted_momentum_6_1 > 0.0 AND risk_adjusted_momentum_12_1 > 0.0"
        ),
        "tag_positive_persistent_leader": tag("score_relative_strength_persistence >= 0.65"),
        "penalty_score": tags_penalty(chasing_extension=0.14, recent_rs_fade=0.12, high_volatility=0.1, large_drawdown=0.14, weak_trend_structure=0.16, liquidity_fade=0.08, data_quality_warning=0.2),
    },
]
_RS_CAPS = ("overheat_cap_score", "volatility_cap_score", "trend_structure_cap_score", "drawdown_cap_score", "concentration_cap_score")
RELATIVE_STRENGTH_LEADER = Profile(
    "relative_strength_leader_v1",
    "C",
    [
        *history(274, unique=True, on="run_date"), *retained(274), *tradable(), *NORMAL_VOLATILITY, "f_volatility_126d > 0.0001", "f_volatility_6_1 > 0.0001", "f_volatility_12_1 > 0.0001", "f_extreme_273 <= 0.80",
        "f_return_60d > 0.0 OR f_return_120d > 0.0", f"{P50} > -0.03", "f_adjusted_close > f_sma_200d", f"{S50} >= -0.03", "f_max_drawdown_120d > -0.40",
    ],
    {
        **HEAD, **same("return_20d", "return_60d", "return_120d", "momentum_return_6_1", "momentum_return_12_1", "volatility_126d", "max_drawdown_120d"),
        "risk_adjusted_return_60d": div("f_return_60d", "f_volatility_60d"), "risk_adjusted_return_120d": div("f_return_120d", "f_volatility_126d"),
        "risk_adjusted_momentum_6_1": div("f_momentum_return_6_1", "f_volatility_6_1"), "risk_adjusted_momentum_12_1": div("f_momentum_return_12_1", "f_volatility_12_1"),
        **TREND, **AVERAGES, "sma_20d_vs_sma_50d": over("f_sma_20d", "f_sma_50d"),
        "pct_below_60d_high": over("f_adjusted_close", "f_prior_high_60d"), "pct_below_120d_high": over("f_adjusted_close", "f_prior_high_120d"), "largest_daily_return_60d": "f_largest_return_60d",
        "gain_concentration_60d": f"CASE WHEN f_return_60d > 0.0 THEN {clamp(div('greatest(f_largest_return_60d, 0.0)', 'f_return_60d'), 0.0, 1.0)} ELSE 0.0 END",
    },
    _RS_LAYERS,
    keys(_RS_LAYERS),
    {
        "composite": _capped(weighted((0.35, "leader_quality_score"), (0.25, "relative_strength_persistence_score"), (0.2, "trend_durability_score"), (0.15, "risk_control_score"), (0.05, "score_new_high_proximity")), *_RS_CAPS),
        "shortterm_leader": _capped(weighted((0.35, _RS[0]), (0.25, _RS[1]), (0.15, "relative_strength_persistence_score"), (0.1, "trend_durability_score"), (0.1, "score_new_high_proximity"), (0.05, "risk_control_score")), *_RS_CAPS),
        "midterm_leader": _capped(weighted((0.3, _RS[2]), (0.25, _RS[1]), (0.2, "score_risk_adjusted_momentum"), (0.15, "relative_strength_persistence_score"), (0.1, "trend_durability_score")), *_RS_CAPS),
    },
)

# ---------------------------------------------------------------- mean reversion
_LIQUIDITY_BAND = ((0.80, 2.00), (0.45, 3.50))
_MR_LAYERS = [
    {
        "position_20d": clamp("close_position_20d_range", 0.0, 1.0), "score_drawdown_control": percentile("max_drawdown_120d"), "pct_ratio": percentile("volatility_20d_to_60d_ratio", "low"),
        "pct_downside": percentile("downside_volatility_20d", "low"), "pct_price": percentile("price_vs_sma_200d"),
        "score_support_proximity": "support_proximity_score_raw", "score_rebound_confirmation": "rebound_confirmation_score_raw", "score_liquidity_continuity": "liquidity_continuity_score_raw",
    },
    {
        "score_oversold_depth": f"greatest({band('return_20d', (-0.18, -0.04), (-0.35, 0.04))}, {band('distance_from_sma_20d', (-0.12, -0.02), (-0.25, 0.04))}, {band('position_20d', (0.10, 0.40), (0.0, 0.75))})",
        "score_volatility_control": weighted((0.55, "pct_ratio"), (0.45, "pct_downside")),
        "score_trend_preservation": weighted((0.35, "pct_price"), (0.25, clamp("((price_vs_sma_200d + 0.25) / 0.50)", 0.0, 1.0)), (0.2, clamp("((sma_50d_vs_sma_200d + 0.08) / 0.28)", 0.0, 1.0)), (0.2, clamp("((uptrend_r2_60d + 0.10) / 1.10)", 0.0, 1.0))),
        "structure_cap_score": ladder(("price_vs_sma_200d < -0.25 OR (trend_slope_60d <= 0.0 AND sma_50d_vs_sma_200d < 0.0)", 0.4), ("price_vs_sma_50d < -0.16 OR sma_50d_vs_sma_200d < -0.04", 0.6), ("price_vs_sma_50d < -0.10 OR trend_slope_60d < 0.0", 0.8)),
        "falling_knife_cap_score": ladder(("return_5d < -0.08 OR (return_20d < -0.28 AND position_20d < 0.12)", 0.35), ("return_5d < -0.04 OR position_20d < 0.12 OR score_rebound_confirmation < 0.25", 0.55), ("return_20d < -0.22 OR position_20d < 0.20", 0.75)),
        "volatility_cap_score": ladder(("volatility_20d_to_60d_ratio > 2.30", 0.4), ("volatility_20d_to_60d_ratio > 1.80", 0.65), ("volatility_20d_to_60d_ratio > 1.45", 0.82)),
        "drawdown_cap_score": ladder(*[(f"max_drawdown_120d < -{a:.2f} OR max_drawdown_252d < -{b:.2f}", c) for a, b, c in ((0.38, 0.48, 0.4), (0.3, 0.4, 0.65), (0.24, 0.34, 0.82))]),
        "tag_setup_near_support": tag("score_support_proximity >= 0.65"), "tag_setup_rebound_confirmation": tag("score_rebound_confirmation >= 0.75 AND return_5d > 0.0"),
        "tag_risk_falling_knife": tag("return_5d < -0.04 OR position_20d < 0.12 OR (return_20d < -0.22 AND score_rebound_confirmation < 0.35)"),
        "tag_risk_breakdown": tag("price_vs_sma_200d < -0.25 OR (trend_slope_60d <= 0.0 AND sma_50d_vs_sma_200d < 0.0) OR price_vs_sma_50d < -0.16"),
        "tag_risk_deep_drawdown": tag("max_drawdown_120d < -0.30 OR max_drawdown_252d < -0.40"), "tag_risk_volatility_spike": tag("volatility_20d_to_60d_ratio > 1.80"), "tag_risk_liquidity_fade": tag(FADE),
        "tag_risk_no_reversion_setup": tag("return_20d >= 0.0 AND distance_from_sma_20d >= 0.0 AND position_20d > 0.35"), **WARNING,
    },
    {
        "oversold_quality_score": weighted((0.45, "score_oversold_depth"), (0.25, "score_support_proximity"), (0.15, "score_rebound_confirmation"), (0.15, "score_trend_preservation")),
        "support_reversion_score": weighted((0.45, "score_support_proximity"), (0.25, "score_oversold_depth"), (0.15, "score_rebound_confirmation"), (0.15, "score_trend_preservation")),
        "rebound_quality_score": weighted((0.45, "score_rebound_confirmation"), (0.25, "score_oversold_depth"), (0.15, "score_support_proximity"), (0.15, "score_liquidity_continuity")),
        "risk_control_score": weighted((0.35, "score_drawdown_control"), (0.3, "score_volatility_control"), (0.2, "score_liquidity_continuity"), (0.15, "score_trend_preservation")),
        "tag_setup_oversold_quality": tag("score_oversold_depth >= 0.65 AND score_trend_preservation >= 0.45 AND max_drawdown_120d > -0.30"),
        "penalty_score": tags_penalty(falling_knife=0.18, breakdown=0.18, deep_drawdown=0.12, volatility_spike=0.12, liquidity_fade=0.08, no_reversion_setup=0.12, data_quality_warning=0.2),
    },
]
_RATIO_F, _POS_F = f"({RATIO_5_20})", f"({POSITION})"
MEAN_REVERSION_QUALITY = Profile(
    "mean_reversion_quality_v1",
    "C",
    [
        *history(252, unique=True), *retained(252), *tradable(), *NORMAL_VOLATILITY, "f_extreme_251 <= 0.80", "f_downside_std_20d IS NOT NULL",
        f"f_return_20d < 0.0 OR {P20} < 0.0 OR {_POS_F} <= 0.35", "f_max_drawdown_120d > -0.40 AND f_max_drawdown_252d > -0.50", f"NOT ({P200} < -0.25 AND f_slope_60d <= 0.0)",
        f"NOT ({div('f_volatility_20d', 'f_volatility_60d')} > 2.50 AND {_POS_F} <= 0.20)",
    ],
    {
        **HEAD, **same("return_5d", "return_20d", "return_60d", "max_drawdown_120d", "max_drawdown_252d"), "distance_from_sma_20d": P20, "distance_from_sma_50d": P50, "distance_from_sma_200d": P200,
        "pct_below_60d_high": over("f_adjusted_close", "f_high_60d"), "pct_below_120d_high": over("f_adjusted_close", "f_high_120d"), "close_position_20d_range": POSITION, "downside_volatility_20d": "f_downside_std_20d",
        "support_proximity_score_raw": f"greatest({band(P50, (-0.06, 0.03), (-0.16, 0.12))}, {band(_POS_F, (0.20, 0.55), (0.0, 0.90))})",
        "rebound_confirmation_score_raw": weighted((0.45, band("f_return_5d", (0.0, 0.08), (-0.10, 0.18))), (0.35, band(_POS_F, (0.25, 0.65), (0.0, 1.0))), (0.2, band(_RATIO_F, *_LIQUIDITY_BAND))),
        "liquidity_continuity_score_raw": band(_RATIO_F, *_LIQUIDITY_BAND), "trend_slope_60d": "f_slope_60d", "uptrend_r2_60d": UPTREND_R2, **AVERAGES,
    },
    _MR_LAYERS,
    keys(_MR_LAYERS),
    {
        h: _capped(weighted(*parts), "structure_cap_score", "falling_knife_cap_score", "volatility_cap_score", "drawdown_cap_score")
        for h, parts in {
            "composite": ((0.3, "oversold_quality_score"), (0.25, "support_reversion_score"), (0.2, "rebound_quality_score"), (0.25, "risk_control_score")),
            "oversold_bounce": ((0.4, "oversold_quality_score"), (0.3, "rebound_quality_score"), (0.15, "support_reversion_score"), (0.15, "risk_control_score")),
            "support_reversion": ((0.4, "support_reversion_score"), (0.25, "oversold_quality_score"), (0.2, "risk_control_score"), (0.15, "rebound_quality_score")),
        }.items()
    },
)

# ---------------------------------------------------------------- defensive compounding
_ILLIQUID = f"stale_close_days_20d > 0.0 OR zero_volume_days_20d > 0.0 OR {FADE}"
_DC_LAYERS = [
    {
        **{f"pct_return_{n}d": percentile(f"return_{n}d", "positive") for n in (60, 120, 252)}, "pct_slope": percentile("trend_slope_120d", "positive"),
        **{f"pct_low_{x}": percentile(x, "low") for x in ("volatility_60d", "volatility_120d", "downside_volatility_60d", "downside_volatility_120d")},
        "pct_drawdown_120d": percentile("max_drawdown_120d"), "pct_drawdown_252d": percentile("max_drawdown_252d"),
        "score_positive_return_persistence": "positive_21d_return_ratio_252d", "score_range_tightness": weighted((0.45, "range_tightness_20d"), (0.55, "range_tightness_60d")), "score_liquidity_stability": "liquidity_stability_score_raw",
        "trend_structure_cap_score": ladder(("price_vs_sma_200d < -0.10 OR (sma_50d_vs_sma_200d < -0.05 AND return_120d <= 0.0)", 0.35), ("price_vs_sma_200d < -0.05 OR sma_50d_vs_sma_200d < 0.0 OR trend_slope_120d <= 0.0", 0.6), ("price_vs_sma_200d < 0.0", 0.8)),
        "growth_cap_score": ladder(("return_120d < 0.03 OR return_252d < 0.06", 0.35), ("return_60d < 0.0 OR positive_21d_return_ratio_252d < 0.50", 0.75), ("return_120d < 0.06 OR return_252d < 0.10", 0.85)),
        "drawdown_cap_score": ladder(*[(f"max_drawdown_252d < -{a:.2f} OR max_drawdown_120d < -{b:.2f}", c) for a, b, c in ((0.35, 0.28, 0.3), (0.25, 0.2, 0.4), (0.18, 0.15, 0.7))]),
        "liquidity_cap_score": ladder((f"stale_close_days_20d >= 3.0 OR zero_volume_days_20d >= 2.0 OR {RATIO} < 0.50", 0.3), (_ILLIQUID, 0.35)),
        "tag_risk_flat_no_growth": tag("return_120d < 0.03 OR return_252d < 0.06"), "tag_risk_broken_long_trend": tag("price_vs_sma_200d < -0.05 OR sma_50d_vs_sma_200d < 0.0 OR (trend_slope_120d <= 0.0 AND return_120d <= 0.0)"),
        "tag_risk_large_drawdown": tag("max_drawdown_252d < -0.25 OR max_drawdown_120d < -0.20"), "tag_risk_volatility_spike": tag("volatility_20d_to_60d_ratio > 1.60 OR volatility_20d > 0.04"),
        "tag_risk_stale_or_illiquid": tag(_ILLIQUID), **WARNING,
    },
    {
        "score_steady_return": weighted((0.2, "pct_return_60d"), (0.35, "pct_return_120d"), (0.45, "pct_return_252d")),
        "score_trend_durability": weighted((0.3, "pct_slope"), (0.25, "uptrend_r2_120d"), (0.25, clamp("((price_vs_sma_200d + 0.05) / 0.45)", 0.0, 1.0)), (0.2, clamp("((sma_50d_vs_sma_200d + 0.05) / 0.35)", 0.0, 1.0))),
        "score_low_volatility": weighted((0.45, "pct_low_volatility_60d"), (0.55, "pct_low_volatility_120d")),
        "score_downside_control": weighted((0.45, "pct_low_downside_volatility_60d"), (0.55, "pct_low_downside_volatility_120d")),
        "score_drawdown_control": weighted((0.45, "pct_drawdown_120d"), (0.55, "pct_drawdown_252d")),
    },
    {
        "steady_compounder_score": weighted((0.35, "score_steady_return"), (0.25, "score_positive_return_persistence"), (0.25, "score_trend_durability"), (0.15, "score_range_tightness")),
        "downside_control_score": weighted((0.3, "score_downside_control"), (0.3, "score_drawdown_control"), (0.25, "score_low_volatility"), (0.15, "score_range_tightness")),
        "trend_quality_score": "score_trend_durability",
        "volatility_cap_score": "least("
        + ladder(("volatility_20d > 0.07 OR volatility_20d_to_60d_ratio > 2.20", 0.35), ("volatility_20d > 0.04 OR volatility_20d_to_60d_ratio > 1.60", 0.4), ("volatility_20d > 0.03 OR volatility_20d_to_60d_ratio > 1.30", 0.7)) + ", "
        + ladder(("score_low_volatility < 0.40", 0.55), ("score_low_volatility < 0.50 OR score_downside_control < 0.45", 0.7), ("score_low_volatility < 0.60 OR score_downside_control < 0.55", 0.82)) + ")",
        "tag_positive_steady_compounder": tag(
            "return_120d >= 0.10 AND return_252d >= 0.18 AND score_trend_durability >= 0.45 AND max_drawdown_120d > -0.15 AND max_drawdown_252d > -0.20 AND volatility_20d <= 0.035"
            f" AND score_range_tightness >= 0.20 AND stale_close_days_20d = 0.0 AND zero_volume_days_20d = 0.0 AND {RATIO} >= 0.75"
        ),
        "tag_positive_low_downside_volatility": tag("score_downside_control >= 0.70"), "tag_positive_drawdown_control": tag("max_drawdown_252d > -0.18 AND score_drawdown_control >= 0.60"),
    },
    {
        "risk_control_score": weighted((0.35, "downside_control_score"), (0.25, "score_drawdown_control"), (0.2, "score_liquidity_stability"), (0.2, "score_range_tightness")),
        "penalty_score": tags_penalty(flat_no_growth=0.12, broken_long_trend=0.18, large_drawdown=0.14, volatility_spike=0.12, stale_or_illiquid=0.12, data_quality_warning=0.2),
        "common_cap": "least(trend_structure_cap_score, growth_cap_score, volatility_cap_score, drawdown_cap_score, liquidity_cap_score)",
        "steady_cap": ladder(
            ("tag_positive_steady_compounder = 1.0", 1.0), ("score_low_volatility < 0.50 OR score_downside_control < 0.55 OR score_drawdown_control < 0.60", 0.45),
            ("steady_compounder_score < 0.45 OR score_steady_return < 0.25 OR score_positive_return_persistence < 0.55 OR score_trend_durability < 0.45 OR score_range_tightness < 0.10", 0.45),
            ("steady_compounder_score < 0.55 OR score_steady_return < 0.35 OR score_trend_durability < 0.55 OR score_range_tightness < 0.20", 0.65), otherwise=0.82,
        ),
    },
]


def soft_cap(raw: str, cap: str) -> str:
    """Over the cap, the score keeps nine to ten tenths of it, by how far it is over."""
    return f"CASE WHEN {raw} <= {cap} THEN {raw} WHEN {cap} <= 0.0 THEN {cap} ELSE {cap} * (0.90 + 0.10 * {clamp(f'(({raw} - {cap}) / greatest(1.0 - {cap}, 1.0e-9))', 0.0, 1.0)}) END"


_DC_PARTS = ("steady_compounder_score", "downside_control_score", "trend_quality_score", "risk_control_score")
_DC_HORIZONS = {
    "composite": (((0.4, _DC_PARTS[0]), (0.25, _DC_PARTS[1]), (0.2, _DC_PARTS[2]), (0.15, _DC_PARTS[3])), "least(common_cap, steady_cap)"),
    "steady_compounder": (((0.45, _DC_PARTS[0]), (0.25, _DC_PARTS[2]), (0.15, _DC_PARTS[1]), (0.15, _DC_PARTS[3])), "least(common_cap, steady_cap)"),
    "downside_control": (((0.45, _DC_PARTS[1]), (0.25, _DC_PARTS[3]), (0.15, _DC_PARTS[0]), (0.15, _DC_PARTS[2])), "common_cap"),
}
DEFENSIVE_COMPOUNDER_QUALITY = Profile(
    "defensive_compounder_quality_v1",
    "C",
    [
        *history(252, unique=True), *retained(252), *tradable(), *NORMAL_VOLATILITY, "f_volatility_120d > 0.0001", "f_extreme_251 <= 0.80", "f_return_120d > 0.0 AND f_return_252d > 0.0", "f_max_drawdown_252d > -0.35",
        f"{P200} >= -0.05", f"NOT ({S50} < -0.05 AND f_return_120d <= 0.0)",
    ],
    {
        **HEAD, **same("return_60d", "return_120d", "return_252d", "positive_21d_return_ratio_252d", "volatility_120d", "max_drawdown_120d", "max_drawdown_252d"),
        "trend_slope_120d": "f_slope_120d", "uptrend_r2_120d": "CASE WHEN f_slope_120d > 0.0 THEN f_r2_120d ELSE 0.0 END", "downside_volatility_60d": "f_downside_std_60d", "downside_volatility_120d": "f_downside_std_120d",
        "range_tightness_20d": tightness("f_top_20d", "f_bottom_20d", 0.18), "range_tightness_60d": tightness("f_high_60d", "f_low_60d", 0.28),
        "price_vs_sma_50d": P50, "price_vs_sma_200d": P200, "sma_50d_vs_sma_200d": S50, "liquidity_stability_score_raw": band(_RATIO_F, (0.80, 1.60), (0.45, 3.00)),
    },
    _DC_LAYERS,
    keys(_DC_LAYERS),
    {h: soft_cap(f"({weighted(*parts)} - penalty_score)", cap) for h, (parts, cap) in _DC_HORIZONS.items()},
)

SETUPS = {p.profile_id: p for p in (BASE_BREAKOUT_QUALITY, RELATIVE_STRENGTH_LEADER, MEAN_REVERSION_QUALITY, DEFENSIVE_COMPOUNDER_QUALITY)}
