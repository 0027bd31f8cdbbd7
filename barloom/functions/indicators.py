"""Technical indicators over whole panels, as algebra terms on the bar columns.

Definitions are the published ones: exponential averages seeded with a simple mean, Wilder
smoothing for RSI, ATR and the directional movement family. The two recurrences that are not
weighted sums of the past (adaptive average, parabolic stop) are in ``operators.folds``.
"""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions.algebra import Factor, field

SIMPLE, EXPONENTIAL, WEIGHTED = 0, 1, 2


def _bars() -> tuple[Factor, Factor, Factor, Factor, Factor]:
    return tuple(field(n) for n in ("open", "high", "low", "close", "volume"))


def _when_zero(num: Factor, den: Factor, otherwise: float = 0.0) -> Factor:
    return A.where(den == 0.0, A.where(A.not_null(num), otherwise, None), num / den)


def full_max(x: Factor, n: int) -> Factor:
    return A.where(A.ts_count(x, n) == float(n), A.ts_max(x, n), None)


def full_min(x: Factor, n: int) -> Factor:
    return A.where(A.ts_count(x, n) == float(n), A.ts_min(x, n), None)


def sma(n: int, x: Factor | None = None) -> Factor:
    return A.ts_full_mean(field("close") if x is None else x, n)


def ema(n: int, x: Factor | None = None) -> Factor:
    return A.ema(field("close") if x is None else x, n)


def wma(n: int, x: Factor | None = None) -> Factor:
    return A.ts_decay_linear(field("close") if x is None else x, n, True)


def moving_average(x: Factor, n: int, kind: int = SIMPLE) -> Factor:
    return {SIMPLE: sma, EXPONENTIAL: ema, WEIGHTED: wma}[kind](n, x)


def apo(fast: int, slow: int, kind: int = SIMPLE) -> Factor:
    c = field("close")
    return moving_average(c, fast, kind) - moving_average(c, slow, kind)


def ppo(fast: int, slow: int, kind: int = SIMPLE) -> Factor:
    return apo(fast, slow, kind) / moving_average(field("close"), slow, kind) * 100.0


def mom(n: int) -> Factor:
    return A.ts_delta(field("close"), n)


def rocr(n: int) -> Factor:
    return field("close") / A.ts_delay(field("close"), n)


def rocp(n: int) -> Factor:
    return rocr(n) - 1.0


def roc(n: int) -> Factor:
    return rocp(n) * 100.0


def rocr_100(n: int) -> Factor:
    return rocr(n) * 100.0


def _moves() -> tuple[Factor, Factor]:
    step = A.ts_delta(field("close"), 1)
    return A.clip(step, 0.0, float("1e308")), A.clip(-step, 0.0, float("1e308"))


def cmo(n: int) -> Factor:
    up, down = (A.wilder(m, n) for m in _moves())
    return _when_zero((up - down) * 100.0, up + down)


def rsi(n: int) -> Factor:
    up, down = (A.wilder(m, n) for m in _moves())
    return _when_zero(up * 100.0, up + down)


def trix(n: int) -> Factor:
    triple = A.ema(A.ema(A.ema(field("close"), n), n), n)
    return A.pct_change(triple) * 100.0


def std(n: int, deviations: float = 1.0) -> Factor:
    c = field("close")
    return A.where(A.ts_count(c, n) == float(n), A.ts_std(c, n) * deviations, None)


def obv() -> Factor:
    _, _, _, c, v = _bars()
    return A.run_sum(v * A.coalesce(A.sign(c - A.coalesce(A.ts_delay(c, 1), 0.0)), 1))


def typical() -> Factor:
    _, h, lo, c, _ = _bars()
    return (h + lo + c) / 3.0


def cci(n: int) -> Factor:
    tp = typical()
    mean = A.ts_full_mean(tp, n)
    return _when_zero(tp - mean, A.ts_absdev(tp, mean, n) * 0.015)


def trange() -> Factor:
    _, h, lo, c, _ = _bars()
    last = A.ts_delay(c, 1)
    return A.where(A.not_null(last), A.greater(h - lo, abs(h - last), abs(lo - last)), None)


def atr(n: int) -> Factor:
    return A.wilder(trange(), n)


def natr(n: int) -> Factor:
    return atr(n) / field("close") * 100.0


def boll(n: int, deviations: float) -> dict[str, Factor]:
    return {"boll_up": sma(n) + std(n, deviations), "boll_down": sma(n) - std(n, deviations)}


def keltner(n: int, deviations: float) -> dict[str, Factor]:
    width = atr(n) * deviations
    return {"keltner_up": sma(n) + width, "keltner_down": sma(n) - width}


def donchian(n: int) -> dict[str, Factor]:
    return {"donchian_up": full_max(field("high"), n), "donchian_down": full_min(field("low"), n)}


def macd(fast: int, slow: int, signal: int) -> dict[str, Factor]:
    c = field("close")
    # both averages start on the same row: the fast one is seeded with the values just before it
    late = A.where(A.run_count(c) > float(slow - fast), c, None)
    line = A.ema(late, fast) - A.ema(c, slow)
    average = A.ema(line, signal)
    line = A.where(A.not_null(average), line, None)
    return {"macd": line, "macd_signal": average, "macd_hist": line - average}


def _directional() -> tuple[Factor, Factor, Factor]:
    _, h, lo, _, _ = _bars()
    up, down = A.ts_delta(h, 1), -A.ts_delta(lo, 1)
    plus = A.where(A.both(up > down, up > 0.0), up, 0.0)
    minus = A.where(A.both(down > up, down > 0.0), down, 0.0)
    return plus, minus, A.coalesce(trange(), 0.0)


def plus_dm(n: int) -> Factor:
    return A.wilder(_directional()[0], n) * float(n)


def minus_dm(n: int) -> Factor:
    return A.wilder(_directional()[1], n) * float(n)


def _index(which: int, n: int) -> Factor:
    parts = _directional()
    ratio = _when_zero(A.wilder(parts[which], n) * 100.0, A.wilder(parts[2], n))
    return A.where(A.run_count(field("close")) > float(n), ratio, None)


def plus_di(n: int) -> Factor:
    return _index(0, n)


def minus_di(n: int) -> Factor:
    return _index(1, n)


def dx(n: int) -> Factor:
    up, down = plus_di(n), minus_di(n)
    return _when_zero(abs(up - down) * 100.0, up + down)


def adx(n: int) -> Factor:
    return A.wilder(dx(n), n)


def adxr(n: int) -> Factor:
    return (adx(n) + A.ts_delay(adx(n), n - 1)) / 2.0


def willr(n: int) -> Factor:
    _, h, lo, c, _ = _bars()
    top, bottom = full_max(h, n), full_min(lo, n)
    return _when_zero((top - c) * -100.0, top - bottom)


def ultosc(t1: int, t2: int, t3: int) -> Factor:
    _, h, lo, c, _ = _bars()
    last = A.ts_delay(c, 1)
    has = A.not_null(last)
    true_low = A.where(has, A.less(lo, last), None)
    pressure, spread = c - true_low, A.where(has, A.greater(h, last), None) - true_low
    parts = [_when_zero(A.ts_sum(pressure, t), A.ts_sum(spread, t)) for t in sorted((t1, t2, t3))]
    return (parts[0] * 4.0 + parts[1] * 2.0 + parts[2]) / 7.0 * 100.0


def aroon(n: int) -> dict[str, Factor]:
    _, h, lo, _, _ = _bars()
    return {"aroon_down": A.ts_since_low(lo, n + 1) * (-100.0 / n) + 100.0,
            "aroon_up": A.ts_since_high(h, n + 1) * (-100.0 / n) + 100.0}


def aroonosc(n: int) -> Factor:
    both = aroon(n)
    return both["aroon_up"] - both["aroon_down"]


def mfi(n: int) -> Factor:
    tp = typical()
    move = A.ts_delta(tp, 1)
    flow = tp * field("volume")
    known = A.not_null(move)
    gain = A.where(known, A.where(move > 0.0, flow, 0.0), None)
    loss = A.where(known, A.where(move < 0.0, flow, 0.0), None)
    total = A.ts_sum(gain, n) + A.ts_sum(loss, n)
    return A.where(total < 1.0, 0.0, A.ts_sum(gain, n) / total * 100.0)


def ad() -> Factor:
    _, h, lo, c, v = _bars()
    return A.run_sum(_when_zero(((c - lo) - (h - c)) * v, h - lo))


def adosc(fast: int, slow: int) -> Factor:
    line = ad()
    gap = A.smooth(line, 2.0 / (fast + 1), 1, False) - A.smooth(line, 2.0 / (slow + 1), 1, False)
    return A.where(A.run_count(field("close")) >= float(max(fast, slow)), gap, None)


def bop() -> Factor:
    o, h, lo, c, _ = _bars()
    return _when_zero(c - o, h - lo)


def stoch(fast_k: int, slow_k: int, slow_k_kind: int, slow_d: int, slow_d_kind: int) -> dict[str, Factor]:
    _, h, lo, c, _ = _bars()
    bottom = full_min(lo, fast_k)
    raw = _when_zero((c - bottom) * 100.0, full_max(h, fast_k) - bottom)
    k = moving_average(raw, slow_k, slow_k_kind)
    d = moving_average(k, slow_d, slow_d_kind)
    return {"slow_k": A.where(A.not_null(d), k, None), "slow_d": d}


def channel_breakout(entry: int, exit_: int) -> dict[str, Factor]:
    """Highest high / lowest low of the rows before the current one."""
    return {"entry_channel": A.ts_shift_max(field("high"), entry),
            "exit_channel": A.ts_shift_min(field("low"), exit_)}


def simple_range(n: int) -> dict[str, Factor]:
    """True range, high minus low where there is no previous close, and its simple mean."""
    _, h, lo, c, _ = _bars()
    last = A.ts_delay(c, 1)
    tr = A.greater(h - lo, abs(h - last), abs(lo - last))
    return {"true_range": tr, "atr_simple": A.ts_full_mean(tr, n)}
