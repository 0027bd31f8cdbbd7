"""DuckDB SQL for the factor algebra: the independent side of the comparison.

Each operator has its own SQL text, written from its definition (list functions, recursion by
``list_reduce``), not from the Spark expression.
"""

from __future__ import annotations

from barloom.functions import algebra as A
from barloom.functions.algebra import Factor
from barloom.operators.evaluate import Layers

SYM = "PARTITION BY {s} ORDER BY {t}"


def _w(n: int, shift: int = 0) -> str:
    return f"({SYM} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


PAST = f"({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAY = "(PARTITION BY {t})"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {value} END"


def steady(x: str) -> str:
    return f"(({x}) * 131073.0::DOUBLE - (({x}) * 131073.0::DOUBLE - ({x})))"


def _list(x: str, n: int) -> str:
    return f"list({x}) OVER {_w(n)}"


def _lag(x: str, n: int) -> str:
    fn = "lag" if n >= 0 else "lead"
    return f"{fn}({x}, {abs(n)}) OVER ({SYM})"


def _arg(x: str, n: int, best: str) -> str:
    s = steady(x)
    return _full(x, n, f"list_position({_list(s, n)}, {best}({s}) OVER {_w(n)})::DOUBLE")


def _ols(x: str, n: int, what: str) -> str:
    lst = _list(x, n)
    mean_i = (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    sxy = f"list_sum(list_transform({lst}, lambda v, k: (v - avg({x}) OVER {_w(n)}) * (k - 1 - {mean_i})))"
    slope = f"({sxy} / {sxx})"
    if what == "slope":
        return _full(x, n, slope) if n > 1 else "NULL::DOUBLE"
    if what == "resi":
        return _full(x, n, f"{x} - avg({x}) OVER {_w(n)} - {slope} * {mean_i}")
    var = f"(var_pop({x}) OVER {_w(n)} * {n})"
    return _full(x, n, f"CASE WHEN min({x}) OVER {_w(n)} < max({x}) OVER {_w(n)} "
                       f"THEN {sxy} * {sxy} / ({sxx} * {var}) END")


def _rank(x: str, n: int) -> str:
    s = steady(x)
    lst = _list(s, n)
    return _full(x, n, f"(len(list_filter({lst}, lambda v: v < {s})) + len(list_filter({lst}, lambda v: v <= {s})) + 1)"
                       f" / {2.0 * n}::DOUBLE")


def _corr(x: str, y: str, n: int) -> str:
    ok = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    u, v = f"(CASE WHEN {ok} THEN {x} END)::DOUBLE", f"(CASE WHEN {ok} THEN {y} END)::DOUBLE"
    moving = " AND ".join(f"min({a}) OVER {_w(n)} < max({a}) OVER {_w(n)}" for a in (u, v))
    return (f"CASE WHEN {moving} THEN floor(covar_pop({u}, {v}) OVER {_w(n)} / nullif(stddev_pop({u}) OVER "
            f"{_w(n)} * stddev_pop({v}) OVER {_w(n)}, 0) * 1e8::DOUBLE + 0.5::DOUBLE) / 1e8::DOUBLE END")


def _decay(x: str, n: int, newest_first: bool = False) -> str:
    weight = "k" if newest_first else f"({n} + 1 - k)"
    return _full(x, n, f"list_sum(list_transform({_list(x, n)}, lambda v, k: v * {weight})) / {n * (n + 1) / 2.0}")


def _cs_rank(x: str) -> str:
    s = steady(x)
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {{t}} ORDER BY {s} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {{t}}, {s}) - 1) / 2.0::DOUBLE END")


def _smooth(x: str, alpha: float, n: int, seeded: bool) -> str:
    seen = f"count({x}) OVER {PAST}"
    start = n if seeded else 1
    lst = f"list_filter(list({x}) OVER {PAST}, lambda v: v IS NOT NULL)"
    first = f"list_avg(({lst})[1:{start}])"
    rest = f"({lst})[{start + 1}:]"
    return (f"CASE WHEN {seen} >= {start} THEN list_reduce(list_concat([{first}], {rest}), "
            f"lambda y, v: y + {alpha!r}::DOUBLE * (v - y)) END")


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


TEXT = {
    "ts_delay": _lag,
    "ts_min": lambda x, n: f"min({x}) OVER {_w(n)}",
    "ts_max": lambda x, n: f"max({x}) OVER {_w(n)}",
    "ts_mean": lambda x, n: f"avg({x}) OVER {_w(n)}",
    "ts_std": lambda x, n: f"stddev_pop({x}) OVER {_w(n)}",
    "ts_std_samp": lambda x, n: f"stddev_samp({x}) OVER {_w(n)}",
    "ts_count": lambda x, n: f"(count({x}) OVER {_w(n)})::DOUBLE",
    "ts_sum": lambda x, n: _full(x, n, f"list_sum({_list(x, n)})"),
    "ts_product": lambda x, n: _full(x, n, f"list_product({_list(x, n)})"),
    "ts_argmax": lambda x, n: _arg(x, n, "max"),
    "ts_argmin": lambda x, n: _arg(x, n, "min"),
    "ts_since_high": lambda x, n: _full(
        x, n, f"(list_position(list_reverse({_list(steady(x), n)}), max({steady(x)}) OVER {_w(n)}) - 1)::DOUBLE"),
    "ts_since_low": lambda x, n: _full(
        x, n, f"(list_position(list_reverse({_list(steady(x), n)}), min({steady(x)}) OVER {_w(n)}) - 1)::DOUBLE"),
    "ordinal": lambda: f"(row_number() OVER ({SYM}))::DOUBLE",
    "ts_rank": _rank,
    "ts_quantile": lambda x, n, q: _full(x, n, f"quantile_cont({x}, {q}) OVER {_w(n)}"),
    "ts_slope": lambda x, n: _ols(x, n, "slope"),
    "ts_rsquare": lambda x, n: _ols(x, n, "r2"),
    "ts_resi": lambda x, n: _ols(x, n, "resi"),
    "ts_corr": _corr,
    "ts_decay_linear": _decay,
    "ts_shift_max": lambda x, n: f"CASE WHEN count({x}) OVER {_w(n, 1)} = {n} THEN max({x}) OVER {_w(n, 1)} END",
    "ts_shift_min": lambda x, n: f"CASE WHEN count({x}) OVER {_w(n, 1)} = {n} THEN min({x}) OVER {_w(n, 1)} END",
    "ts_absdev": lambda x, m, n: _full(x, n, f"list_avg(list_transform({_list(x, n)}, lambda v: abs(v - {m})))"),
    "run_sum": lambda x: f"sum({x}) OVER {PAST}",
    "run_max": lambda x: f"max({x}) OVER {PAST}",
    "run_product": lambda x: f"product({x}) OVER {PAST}",
    "run_count": lambda x: f"(count({x}) OVER {PAST})::DOUBLE",
    "first_value": lambda x: f"first_value({x} IGNORE NULLS) OVER {PAST}",
    "fill_forward": lambda x: f"last_value({x} IGNORE NULLS) OVER {PAST}",
    "smooth": _smooth,
    "cs_rank": _cs_rank,
    "cs_count": lambda x: f"(count({x}) OVER {DAY})::DOUBLE",
    "cs_mean": lambda x: f"avg({x}) OVER {DAY}",
    "cs_std": lambda x: f"stddev_samp({x}) OVER {DAY}",
    "cs_sum": lambda x: f"coalesce(sum({x}) OVER {DAY}, 0.0)",
    "cs_median": lambda x: f"median({x}) OVER {DAY}",
    "cs_rows": lambda: f"(count(*) OVER {DAY})::DOUBLE",
    "add": lambda a, b: f"({a} + {b})",
    "sub": lambda a, b: f"({a} - {b})",
    "mul": lambda a, b: f"({a} * {b})",
    "div": _div,
    "floordiv": lambda a, b: f"floor({_div(a, b)})",
    "mod": lambda a, b: f"({a} - {b} * floor({_div(a, b)}))",
    "power": lambda a, b: f"pow({a}, {b})",
    "neg": lambda a: f"(-({a}))",
    "abs": lambda a: f"abs({a})",
    "log": lambda a: f"CASE WHEN {a} > 0 THEN ln({a}) END",
    "gt": lambda a, b: f"({a} > {b})::INT",
    "ge": lambda a, b: f"({a} >= {b})::INT",
    "lt": lambda a, b: f"({a} < {b})::INT",
    "le": lambda a, b: f"({a} <= {b})::INT",
    "eq": lambda a, b: f"({a} = {b})::INT",
    "ne": lambda a, b: f"({a} <> {b})::INT",
    "less": lambda *c: f"least({', '.join(c)})",
    "greater": lambda *c: f"greatest({', '.join(c)})",
    "sign": lambda x: f"CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 ELSE 0 END",
    "quesval": lambda t, x, a, b: f"CASE WHEN {t} < {x} THEN {a} ELSE {b} END",
    "where": lambda c, a, b: f"CASE WHEN {c} = 1 THEN {a} ELSE {b} END",
    "both": lambda a, b: f"({a} = 1 AND {b} = 1)::INT",
    "coalesce": lambda *c: f"coalesce({', '.join(c)})",
    "not_null": lambda x: f"({x} IS NOT NULL)::INT",
    "floor": lambda x: f"floor({x})",
    "cast_to_int": lambda x: f"trunc({x})::INT",
    "sqrt": lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END",
    "clip": lambda x, lo, hi: f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END",
    "pow1": lambda x, p: f"CASE WHEN {x} > 0 THEN pow({x}, {p}) WHEN {x} < 0 THEN -pow(abs({x}), {p}) ELSE 0 END",
    "pow2": lambda x, y: (f"coalesce(CASE WHEN {x} > 0 THEN pow({x}, {y}) "
                          f"WHEN {x} < 0 AND {y} = floor({y}) THEN -pow(abs({x}), {y}) END, 0)"),
}


def _lit(value) -> str:
    if value is None:
        return "NULL::DOUBLE"
    return f"({value!r})::DOUBLE" if isinstance(value, float) else f"({value})"


def _sql(node: Factor, layers: Layers, top: bool = True) -> str:
    if not top and id(node) in layers.name:
        return layers.name[id(node)]
    if node.op == "field":
        return node.params[0]
    if node.op == "lit":
        return _lit(node.params[0])
    inner = [_sql(a, layers, False) for a in node.args]
    return "(" + TEXT[node.op](*inner, *node.params) + ")"


def factor_sql(source: str, factors: dict[str, Factor], keep: list[str],
               symbol: str = "vt_symbol", time: str = "datetime") -> tuple[str, str]:
    """(CTE list, name of the last CTE) computing ``keep`` plus the factors from CTE ``source``."""
    layers = Layers(factors, expand=False)
    ctes, last = [], source
    for at, key in enumerate(sorted(layers.groups)):
        cols = ", ".join(f"{_sql(n, layers)} AS {layers.name[id(n)]}" for n in layers.groups[key])
        cols = cols.replace("{s}", symbol).replace("{t}", time)
        name = f"{source}_l{at}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, {cols} FROM {last})")
        last = name
    outs = ", ".join(f"{layers.name.get(id(r)) or _sql(r, layers)} AS {n}" for n, r in layers.roots.items())
    taken = [k for k in keep if k not in factors]
    name = f"{source}_f"
    ctes.append(f"{name} AS (SELECT {', '.join([*taken, outs])} FROM {last})")
    return ", ".join(ctes), name
