"""The 82 enabled factors of the published 101-factor set, as algebra terms.

Numbers that need industry neutralisation or market capitalisation are absent. Ranks are raw
per-date ranks, and linear decay weighs the oldest row most (see README, semantics).
"""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions.algebra import Factor, field
from barloom.plans.factors158 import label

rank, scale, corr, cov = A.cs_rank, A.cs_scale, A.ts_corr, A.ts_cov
delay, delta, total, mean, dev = A.ts_delay, A.ts_delta, A.ts_sum, A.ts_mean, A.ts_std
low_of, high_of, place, decay = A.ts_min, A.ts_max, A.ts_rank, A.ts_decay_linear
at_high, at_low, product = A.ts_argmax, A.ts_argmin, A.ts_product
choose = A.quesval


def mix(a: Factor, b: Factor, share: float) -> Factor:
    return a * share + b * (1 - share)


def factors101(with_label: bool = True) -> dict[str, Factor]:
    o, h, lo, c, v, vw = (field(n) for n in ("open", "high", "low", "close", "volume", "vwap"))
    ret = c / delay(c, 1) - 1
    mid = (h + lo) / 2
    step = delta(c, 1)

    def adv(n: int) -> Factor:
        return mean(v, n)

    def below(a: Factor, b: Factor) -> Factor:
        """1 where a < b, else 0 (missing counts as 0)."""
        return choose(a, b, 1, 0)

    # slope change between the last ten rows and the ten before them
    bend = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    swing = (c - lo) - (h - c)
    drift = total(o, 5) * total(ret, 5)
    spread = (h - lo) / (total(c, 5) / 5)
    f: dict[int, Factor] = {}

    f[1] = rank(at_high(A.pow1(choose(0, ret, c, dev(ret, 20)), 2.0), 5)) - 0.5
    f[2] = -1 * corr(rank(delta(A.log(v), 2)), rank((c - o) / o), 6)
    f[3] = -1 * corr(rank(o), rank(v), 10)
    f[4] = -1 * place(rank(lo), 9)
    f[5] = rank(o - total(vw, 10) / 10) * (-1 * abs(rank(c - vw)))
    f[6] = -1 * corr(o, v, 10)
    f[7] = choose(adv(20), v, -1 * place(abs(delta(c, 7)), 60) * A.sign(delta(c, 7)), -1)
    f[8] = -1 * rank(drift - delay(drift, 10))
    f[9] = choose(0, low_of(step, 5), step, choose(0, high_of(step, 5), -1 * step, step))
    f[10] = rank(choose(0, low_of(step, 4), step, choose(0, high_of(step, 4), -1 * step, step)))
    f[11] = (rank(high_of(vw - c, 3)) + rank(low_of(vw - c, 3))) * rank(delta(v, 3))
    f[12] = A.sign(delta(v, 1)) * (-1 * step)
    f[13] = -1 * rank(cov(rank(c), rank(v), 5))
    f[14] = -1 * rank(delta(ret, 3)) * corr(o, v, 10)
    f[15] = -1 * total(rank(corr(rank(h), rank(v), 3)), 3)
    f[16] = -1 * rank(cov(rank(h), rank(v), 5))
    f[17] = (-1 * rank(place(c, 10)) * rank(c - 2 * delay(c, 1) + delay(c, 2))
             * rank(place(v / adv(20), 5)))
    f[18] = -1 * rank(dev(abs(c - o), 5) + (c - o) + corr(c, o, 10))
    f[19] = -1 * A.sign(delta(c, 7) + (c - delay(c, 7))) * (rank(total(ret, 250) + 1) + 1)
    f[20] = -1 * rank(o - delay(h, 1)) * rank(o - delay(c, 1)) * rank(o - delay(lo, 1))
    f[21] = choose(mean(c, 8) + dev(c, 8), mean(c, 2), -1,
                   choose(mean(c, 2), mean(c, 8) - dev(c, 8), 1, choose(1, v / adv(20), 1, -1)))
    f[22] = -1 * delta(corr(h, v, 5), 5) * rank(dev(c, 20))
    f[23] = choose(mean(h, 20), h, -1 * delta(h, 2), 0)
    f[24] = choose(0.05, delta(total(c, 100) / 100, 100) / delay(c, 100),
                   -1 * delta(c, 3), -1 * (c - low_of(c, 100)))
    f[25] = rank(-1 * ret * adv(20) * vw * (h - c))
    f[26] = -1 * high_of(corr(place(v, 5), place(h, 5), 5), 3)
    f[27] = choose(0.5, rank(mean(corr(rank(v), rank(vw), 6), 2)), -1, 1)
    f[28] = scale(corr(adv(20), lo, 5) + mid - c)
    inner = scale(A.log(total(low_of(rank(rank(-1 * rank(delta(c - 1, 5)))), 2), 1)))
    f[29] = low_of(product(rank(rank(inner)), 1), 5) + place(delay(-1 * ret, 6), 5)
    signs = sum((A.sign(delay(c, k) - delay(c, k + 1)) for k in (1, 2)), A.sign(c - delay(c, 1)))
    f[30] = (rank(signs) * -1 + 1) * total(v, 5) / total(v, 20)
    slow = decay(-1 * rank(rank(delta(c, 10))), 10)
    f[31] = (rank(rank(rank(slow))) + rank(-1 * delta(c, 3))
             + A.sign(scale(corr(adv(20), lo, 12))))
    f[32] = scale(total(c, 7) / 7 - c) + 20 * scale(corr(vw, delay(c, 5), 230))
    f[33] = rank(-1 * (o / c * -1 + 1))
    f[34] = rank((rank(dev(ret, 2) / dev(ret, 5)) * -1 + 1) + (rank(step) * -1 + 1))
    f[35] = place(v, 32) * (place(c + h - lo, 16) * -1 + 1) * (place(ret, 32) * -1 + 1)
    f[36] = (2.21 * rank(corr(c - o, delay(v, 1), 15)) + 0.7 * rank(o - c)
             + 0.73 * rank(place(delay(-1 * ret, 6), 5)) + rank(abs(corr(vw, adv(20), 6)))
             + 0.6 * rank((total(c, 200) / 200 - o) * (c - o)))
    f[37] = rank(corr(delay(o - c, 1), c, 200)) + rank(o - c)
    f[38] = -1 * rank(place(c, 10)) * rank(c / o)
    f[39] = (-1 * rank(delta(c, 7) * (rank(decay(v / adv(20), 9)) * -1 + 1))
             * (rank(total(ret, 250)) + 1))
    f[40] = -1 * rank(dev(h, 10)) * corr(h, v, 10)
    f[41] = A.pow1(h * lo, 0.5) - vw
    f[42] = rank(vw - c) / rank(vw + c)
    f[43] = place(v / adv(20), 20) * place(-1 * delta(c, 7), 8)
    f[44] = -1 * corr(h, rank(v), 5)
    f[45] = (-1 * rank(total(delay(c, 5), 20) / 20) * corr(c, v, 2)
             * rank(corr(total(c, 5), total(c, 20), 2)))
    f[46] = choose(0.25, bend, -1, choose(0, bend, -1 * step, 1))
    f[47] = ((rank(A.pow1(c, -1)) * v / adv(20)) * (h * rank(h - c)) / (total(h, 5) / 5)
             - rank(vw - delay(vw, 5)))
    f[49] = choose(-0.1, bend, -1 * step, 1)
    f[50] = -1 * high_of(rank(corr(rank(v), rank(vw), 5)), 5)
    f[51] = choose(-0.05, bend, -1 * step, 1)
    f[52] = ((-1 * low_of(lo, 5) + delay(low_of(lo, 5), 5))
             * rank((total(ret, 240) - total(ret, 20)) / 220) * place(v, 5))
    f[53] = -1 * delta(swing / (c - lo), 9)
    f[54] = -1 * ((lo - c) * A.pow1(o, 5)) / ((lo - h) * A.pow1(c, 5))
    span12 = high_of(h, 12) - low_of(lo, 12)
    f[55] = -1 * corr(rank((c - low_of(lo, 12)) / span12), rank(v), 6)
    f[57] = -1 * ((c - vw) / decay(rank(at_high(c, 30)), 2))
    f[60] = -1 * (2 * scale(rank(swing / (h - lo) * v)) - scale(rank(at_high(c, 10))))
    f[61] = below(rank(vw - low_of(vw, 16)), rank(corr(vw, adv(180), 18)))
    f[62] = (rank(corr(vw, total(adv(20), 22), 10))
             < rank((rank(o) + rank(o)) < (rank(mid) + rank(h)))) * -1
    f[64] = (rank(corr(total(mix(o, lo, 0.178404), 13), total(adv(120), 13), 17))
             < rank(delta(mix(mid, vw, 0.178404), 4))) * -1
    f[65] = (rank(corr(mix(o, vw, 0.00817205), total(adv(60), 9), 6))
             < rank(o - low_of(o, 14))) * -1
    f[66] = (rank(decay(delta(vw, 4), 7))
             + place(decay((mix(lo, lo, 0.96633) - vw) / (o - mid), 11), 7)) * -1
    f[68] = (place(corr(rank(h), rank(adv(15)), 9), 14)
             < rank(delta(mix(c, lo, 0.518371), 1))) * -1
    f[71] = A.greater(place(decay(corr(place(c, 3), place(adv(180), 12), 18), 4), 16),
                      place(decay(A.pow1(rank((lo + o) - (vw + vw)), 2), 16), 4))
    f[72] = (rank(decay(corr(mid, adv(40), 9), 10))
             / rank(decay(corr(place(vw, 4), place(v, 19), 7), 3)))
    blend = mix(o, lo, 0.147155)
    f[73] = A.greater(rank(decay(delta(vw, 5), 3)),
                      place(decay(delta(blend, 2) / blend * -1, 3), 17)) * -1
    f[74] = below(rank(corr(c, total(adv(30), 37), 15)),
                  rank(corr(rank(mix(h, vw, 0.0261661)), rank(v), 11))) * -1
    f[75] = below(rank(corr(vw, v, 4)), rank(corr(rank(lo), rank(adv(50)), 12)))
    f[77] = A.less(rank(decay((mid + h) - (vw + h), 20)), rank(decay(corr(mid, adv(40), 3), 6)))
    f[78] = A.pow2(rank(corr(total(mix(lo, vw, 0.352233), 20), total(adv(40), 20), 7)),
                   rank(corr(rank(vw), rank(v), 6)))
    chance = rank(A.pow1(rank(corr(vw, total(adv(10), 50), 8)), 4))
    f[81] = below(rank(A.log(product(chance, 15))), rank(corr(rank(vw), rank(v), 5))) * -1
    f[83] = rank(delay(spread, 2)) * rank(rank(v)) / (spread / (vw - c))
    f[84] = A.pow2(place(vw - high_of(vw, 15), 21), delta(c, 5))
    f[85] = A.pow2(rank(corr(mix(h, c, 0.876703), adv(30), 10)),
                   rank(corr(place(mid, 4), place(v, 10), 7)))
    f[86] = below(place(corr(c, total(adv(20), 15), 6), 20), rank((o + c) - (vw + o))) * -1
    f[88] = A.less(rank(decay((rank(o) + rank(lo)) - (rank(h) + rank(c)), 8)),
                   place(decay(corr(place(c, 8), place(adv(60), 21), 8), 7), 3))
    f[92] = A.less(place(decay(below(mid + c, lo + o), 15), 19),
                   place(decay(corr(rank(lo), rank(adv(30)), 8), 7), 7))
    f[94] = A.pow2(rank(vw - low_of(vw, 12)),
                   place(corr(place(vw, 20), place(adv(60), 4), 18), 3)) * -1
    f[95] = below(rank(o - low_of(o, 12)),
                  place(A.pow1(rank(corr(total(mid, 19), total(adv(40), 19), 13)), 5), 12))
    f[96] = A.greater(place(decay(corr(rank(vw), rank(v), 4), 4), 8),
                      place(decay(at_high(corr(place(c, 7), place(adv(60), 4), 4), 13), 14), 13)) * -1
    f[98] = (rank(decay(corr(vw, total(adv(5), 26), 5), 7))
             - rank(decay(place(at_low(corr(rank(o), rank(adv(15)), 21), 9), 7), 8)))
    f[99] = below(rank(corr(total(mid, 20), total(adv(60), 20), 9)), rank(corr(lo, v, 6))) * -1
    f[101] = (c - o) / ((h - lo) + 0.001)

    out = {f"alpha{n}": factor for n, factor in f.items()}
    if with_label:
        out["label"] = label(c)
    return out
