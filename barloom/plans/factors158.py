"""The 158-factor library: 13 candle and price ratios and 29 rolling families over 5 windows."""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions.algebra import Factor, field

# fixed values: rolling windows, guard against zero denominators, label horizon
WINDOWS = (5, 10, 20, 30, 60)
TINY = 1e-12
LABEL_ROWS = (3, 1)


def label(close: Factor | None = None) -> Factor:
    """Return from the next row to three rows ahead."""
    close = field("close") if close is None else close
    far, near = LABEL_ROWS
    return A.ts_delay(close, -far) / A.ts_delay(close, -near) - 1


def _shares(x: Factor, w: int) -> tuple[Factor, Factor, Factor]:
    """Shares of rises and of falls in the total absolute movement, and their difference."""
    before = A.ts_delay(x, 1)
    rise, fall = A.ts_sum(A.greater(x - before, 0.0), w), A.ts_sum(A.greater(before - x, 0.0), w)
    total = A.ts_sum(abs(x - before), w) + TINY
    return rise / total, fall / total, (rise - fall) / total


def factors158(windows: tuple[int, ...] = WINDOWS, with_label: bool = True) -> dict[str, Factor]:
    o, h, lo, c, v, vwap = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))
    body_top, body_low, spread = A.greater(o, c), A.less(o, c), h - lo + TINY
    shift = c * 2 - h - lo
    out = {
        "kmid": (c - o) / o, "klen": (h - lo) / o, "kmid_2": (c - o) / spread,
        "kup": (h - body_top) / o, "kup_2": (h - body_top) / spread,
        "klow": (body_low - lo) / o, "klow_2": (body_low - lo) / spread,
        "ksft": shift / o, "ksft_2": shift / spread,
        "open_0": o / c, "high_0": h / c, "low_0": lo / c, "vwap_0": vwap / c,
    }
    before = A.ts_delay(c, 1)
    change, volume_change = c / before, A.log(v / A.ts_delay(v, 1) + 1)
    effort = abs(change - 1) * v
    for w in windows:
        top, bottom = A.ts_max(h, w), A.ts_min(lo, w)
        at_top, at_bottom = A.ts_argmax(h, w), A.ts_argmin(lo, w)
        up, down = A.ts_mean(c > before, w), A.ts_mean(c < before, w)
        price, volume = _shares(c, w), _shares(v, w)
        family = {
            "roc": A.ts_delay(c, w) / c,
            "ma": A.ts_mean(c, w) / c,
            "std": A.ts_std(c, w) / c,
            "beta": A.ts_slope(c, w) / c,
            "rsqr": A.ts_rsquare(c, w),
            "resi": A.ts_resi(c, w) / c,
            "max": top / c,
            "min": bottom / c,
            "qtlu": A.ts_quantile(c, w, 0.8) / c,
            "qtld": A.ts_quantile(c, w, 0.2) / c,
            "rank": A.ts_rank(c, w),
            "rsv": (c - bottom) / (top - bottom + TINY),
            "imax": at_top / w,
            "imin": at_bottom / w,
            "imxd": (at_top - at_bottom) / w,
            "corr": A.ts_corr(c, A.log(v + 1), w),
            "cord": A.ts_corr(change, volume_change, w),
            "cntp": up, "cntn": down, "cntd": up - down,
            "sump": price[0], "sumn": price[1], "sumd": price[2],
            "vma": A.ts_mean(v, w) / (v + TINY),
            "vstd": A.ts_std(v, w) / (v + TINY),
            "wvma": A.ts_std(effort, w) / (A.ts_mean(effort, w) + TINY),
            "vsump": volume[0], "vsumn": volume[1], "vsumd": volume[2],
        }
        out.update({f"{name}_{w}": factor for name, factor in family.items()})
    if with_label:
        out["label"] = label()
    return out
