"""Queries for the factor algebra and the two factor libraries."""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions.algebra import field
from barloom.plans.factors101 import factors101
from barloom.plans.factors158 import factors158
from checks.registry import add_factors

o, h, lo, c, v, t, vw = (field(n) for n in ("open", "high", "low", "close", "volume", "turnover", "vwap"))

TS = {
    "ts_delay": {"ts_delay_3": A.ts_delay(c, 3), "ts_delay_m3": A.ts_delay(c, -3)},
    "ts_min": {"ts_min_10": A.ts_min(lo, 10)},
    "ts_max": {"ts_max_10": A.ts_max(h, 10)},
    "ts_argmax": {"ts_argmax_10": A.ts_argmax(h, 10), "ts_argmax_vol": A.ts_argmax(v, 5)},
    "ts_argmin": {"ts_argmin_10": A.ts_argmin(lo, 10), "ts_argmin_vol": A.ts_argmin(v, 5)},
    "ts_rank": {"ts_rank_10": A.ts_rank(c, 10), "ts_rank_vol": A.ts_rank(v, 20)},
    "ts_sum": {"ts_sum_10": A.ts_sum(c, 10)},
    "ts_mean": {"ts_mean_10": A.ts_mean(c, 10)},
    "ts_std": {"ts_std_10": A.ts_std(c, 10)},
    "ts_slope": {"ts_slope_10": A.ts_slope(c, 10)},
    "ts_quantile": {"ts_quantile_80": A.ts_quantile(c, 10, 0.8), "ts_quantile_20": A.ts_quantile(c, 30, 0.2)},
    "ts_rsquare": {"ts_rsquare_10": A.ts_rsquare(c, 10)},
    "ts_resi": {"ts_resi_10": A.ts_resi(c, 10)},
    "ts_corr": {"ts_corr_10": A.ts_corr(c, v, 10)},
    "ts_less": {"ts_less_col": A.ts_less(o, c), "ts_less_num": A.ts_less(c, 1000.0)},
    "ts_greater": {"ts_greater_col": A.ts_greater(o, c), "ts_greater_num": A.ts_greater(c, 1000.0)},
    "ts_log": {"ts_log": A.ts_log(c), "ts_log_zero": A.ts_log(o - c)},
    "ts_abs": {"ts_abs": A.ts_abs(o - c)},
    "ts_delta": {"ts_delta_4": A.ts_delta(c, 4)},
    "ts_cov": {"ts_cov_10": A.ts_cov(c, v, 10)},
    "ts_decay_linear": {"ts_decay_10": A.ts_decay_linear(c, 10),
                        "ts_decay_newest": A.ts_decay_linear(c, 10, True)},
    "ts_product": {"ts_product_5": A.ts_product(c / 1000.0, 5)},
}
for name, factors in TS.items():
    add_factors(name, factors)

CS = {
    "cs_rank": {"cs_rank_close": A.cs_rank(c), "cs_rank_vol": A.cs_rank(v)},
    "cs_mean": {"cs_mean": A.cs_mean(c)},
    "cs_std": {"cs_std": A.cs_std(c)},
    "cs_sum": {"cs_sum": A.cs_sum(c), "cs_sum_null": A.cs_sum(A.ts_delay(c, 20))},
    "cs_scale": {"cs_scale": A.cs_scale(c - o), "cs_scale_close": A.cs_scale(c)},
    "percentile_rank": {"percentile_rank": A.percentile_rank(A.ts_delta(c, 1))},
}
for name, factors in CS.items():
    add_factors(name, factors, "week")

MATH = {
    "math_less_greater": {"less": A.less(o, c), "greater": A.greater(o, c, A.lit(500.0))},
    "math_log": {"log": A.log(v)},
    "math_abs": {"abs": abs(o - c), "neg": -c},
    "math_sign": {"sign": A.sign(o - c), "sign_null": A.sign(A.ts_delta(c, 1))},
    "math_quesval": {"quesval": A.quesval(1000.0, c, o, -1.0), "quesval_null": A.quesval(0, A.ts_delta(c, 1), 1, 2)},
    "math_quesval2": {"quesval2": A.quesval2(o, c, v, 0.0)},
    "math_pow1": {"pow1": A.pow1((o - c) / 100.0, 2.0)},
    "math_pow2": {"pow2": A.pow2((o - c) / 100.0, A.floor(v / 10.0)), "pow2_frac": A.pow2(o - c, v / 100.0)},
    "math_arithmetic": {"plus": o + c * 2, "rplus": 2 + c, "rminus": 1 - c, "rdiv": 1000 / c, "div_zero": c / (o - c)},
    "math_floor_mod": {"floordiv": c // 7.0, "mod": (o - c) % 7.0},
    "math_power": {"power": c ** 2.0},
    "math_compare": {"gt": c > o, "ge": c >= o, "lt": c < o, "le": c <= o, "eq": c == o, "ne": c != o,
                     "gt_null": A.ts_delay(c, 1) > 900.0},
    "math_cast_to_int": {"as_int": A.cast_to_int(c)},
    "math_clip": {"clip": A.clip(c, 900.0, 2000.0)},
    "math_pct_change": {"pct_change": A.pct_change(c), "running_return": c / A.first_value(c) - 1},
    "math_running": {"cum_sum": A.run_sum(v), "cum_max": A.run_max(h), "cum_count": A.run_count(c),
                     "cum_prod": A.run_product(A.coalesce(A.less(c / A.ts_delay(c, 1), 1.0001), 1.0))},
    "math_fill_forward": {"filled": A.fill_forward(A.where(v > 30.0, c, None))},
}
for name, factors in MATH.items():
    add_factors(name, factors)

CANDLES = ("kmid klen kmid_2 kup kup_2 klow klow_2 ksft ksft_2 open_0 high_0 low_0 vwap_0").split()
LIBRARY = factors158()
GROUPS = {"candles": CANDLES}
for name in LIBRARY:
    if name not in CANDLES:
        GROUPS.setdefault(name.rsplit("_", 1)[0], []).append(name)
for group, names in GROUPS.items():
    add_factors(f"f158_{group}", {n: LIBRARY[n] for n in names})

for number, factor in factors101().items():
    if number != "label":
        add_factors(f"f101_{number}", {number: factor}, "week")
add_factors("label_3_1", {"label": LIBRARY["label"]})
