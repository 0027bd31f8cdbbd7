"""Turn factors into layers of columns on a panel.

Terms are placed by partition key: per-instrument terms in even phases, per-date terms in odd
ones. Inside a phase all windows share the partition key, hence one exchange. Every layer is a
plain ``select`` that keeps only columns still needed, so rows stay narrow through the sorts.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import algebra as A

from barloom.functions.algebra import DATE, OPERATORS, ORDINAL, ROW, SYMBOL, Factor, Windows, steady
from barloom.operators.crosssection import keys_repeat, many_ranks, wide_terms
from barloom.operators.longhistory import RUNNING, carried
from barloom.operators.rolling import FOLLOWERS, INTEGERS, ROLLED, SEQ, plain, rolled, rows_of

# Above this many rows of one instrument its history is cut into overlapping pieces, above this
# many rows of one date per-date terms avoid single-partition windows.
LONG_HISTORY = 2_000_000
WIDE_DATE = 2_000_000
# A phase with this many windows is bound by CPU, not bytes: its exchange is requested with the
# session's partition count, because adaptive coalescing would size it by bytes alone.
HEAVY_PHASE = 8
# From this many ranks in one layer on, they are computed together with one sort.
MANY_RANKS = 4
# Windows of deviations, slopes, places and ranks that re-read this many rows for each row in all are rolled over Arrow batches.
ROLLED_ROWS = 100
# Rolled terms come after all other terms of a phase, from this level on.
ROLLED_LEVEL = 1000


def measure(df: DataFrame, symbol: str, date: str) -> tuple[int, int]:
    """Largest number of rows of one instrument and of one date (two partial aggregations)."""
    per = [
        df.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("n")).withColumn("side", F.lit(k))
        for k in (symbol, date)
    ]
    found = {r["side"]: r["n"] or 0 for r in per[0].unionByName(per[1]).collect()}
    return found[symbol], found[date]


def _walk(roots: list[Factor]) -> list[Factor]:
    order: list[Factor] = []
    seen: set[int] = set()
    stack: list[tuple[Factor, bool]] = [(r, False) for r in reversed(roots)]
    while stack:
        node, ready = stack.pop()
        if ready:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack.extend((a, False) for a in reversed(node.args))
    return order


def _kind(node: Factor) -> str:
    kind = OPERATORS[node.op].kind if node.op in OPERATORS else ROW
    return SYMBOL if kind == A.MACRO else kind


def _one_count(roots: dict[str, Factor]) -> dict[str, Factor]:
    """The terms with one running count of a series, where counts that could start anywhere run over the whole history as well."""
    made: dict[int, Factor] = {}
    for node in _walk(list(roots.values())):
        made[id(node)] = Factor("run_count" if node.op == "count_so_far" else node.op, tuple(made[id(a)] for a in node.args), node.params)
    return {name: made[id(root)] for name, root in roots.items()}


class Layers:
    """Placement of every term: which layer computes it and what it is called there."""

    def __init__(self, factors: dict[str, Factor], expand: bool = True, roll: bool = False, rows: int | None = None) -> None:
        memo: dict[int, Factor] = {}
        self.roots = {n: A.expand(A.term(f), memo, rows) if expand else A.term(f) for n, f in factors.items()}
        self.order = _walk(list(self.roots.values()))
        users: dict[int, set[int]] = defaultdict(set)
        feeds_window: set[int] = set()
        for node in self.order:
            for a in node.args:
                users[id(a)].add(id(node))
                if _kind(node) != ROW:
                    feeds_window.add(id(a))
        outputs = {id(r) for r in self.roots.values()}
        self.place: dict[int, tuple[int, int, int]] = {}
        self.name: dict[int, str] = {}
        for node in self.order:
            inner = [self.place[id(a)] for a in node.args]
            phase, level, depth = max(inner, default=(0, 0, 0))
            kind = _kind(node)
            if kind in (SYMBOL, DATE):
                parity = 0 if kind == SYMBOL else 1
                if phase % 2 != parity:
                    phase, level = phase + 1, 0
                ahead = node.op == "ts_delay" and node.params[0] < 0
                if roll and node.op in ROLLED and not ahead and (node.op not in FOLLOWERS or level >= ROLLED_LEVEL):
                    level = max(level, ROLLED_LEVEL)
                elif level >= ROLLED_LEVEL:
                    # rolled rows are exchanged again for a window
                    phase, level = phase + 2, 0
                self.place[id(node)] = (phase, level + 1, 0)
                self.name[id(node)] = f"_c{len(self.name)}"
            else:
                stored = node.op not in ("field", "lit") and (
                    len(users[id(node)]) > 1 or id(node) in feeds_window or id(node) in outputs)
                self.place[id(node)] = (phase, level, depth + 1 if stored else depth)
                if stored:
                    self.name[id(node)] = f"_c{len(self.name)}"
        self.groups: dict[tuple[int, int, int], list[Factor]] = defaultdict(list)
        for node in self.order:
            if id(node) in self.name:
                self.groups[self.place[id(node)]].append(node)
        self.fields = {n.params[0] for n in self.order if n.op == "field"}
        self.has_native = any(n.op == "native" for n in self.order)
        self.needs_ordinal = any(n.op in OPERATORS and OPERATORS[n.op].ordinal for n in self.order)

    def reads(self, node: Factor) -> set[str]:
        """Names of the stored columns and fields the column of ``node`` refers to."""
        found: set[str] = set()
        stack = list(node.args)
        while stack:
            a = stack.pop()
            if id(a) in self.name:
                found.add(self.name[id(a)])
            elif a.op == "field":
                found.add(a.params[0])
            else:
                stack.extend(a.args)
        return found

    def lean(self, need: set[str], have: set[str]) -> tuple[set[str], list[Factor]]:
        """The columns to store for ``need``, of those at hand, and the row-wise terms that give the rest again, inputs first.

        A row-wise column is left out if stored ones give it; one that nothing needs is stored if it saves several.
        """
        named = {self.name[id(n)]: n for n in self.order if id(n) in self.name}
        reads = {c: self.reads(n) for c, n in named.items() if _kind(n) == ROW}

        def under(names: set[str], stored: set[str]) -> set[str]:
            """What the terms ``names`` are made of, down to stored columns or to such as are not row-wise."""
            found: set[str] = set()
            stack = [c for name in names for c in reads.get(name, ())]
            while stack:
                c = stack.pop()
                if c not in found:
                    found.add(c)
                    stack.extend(() if c in stored else reads.get(c, ()))
            return found

        def fewest(stored: set[str]) -> set[str]:
            for c in reversed(reads):
                if c in stored and all(r in stored or r in reads for r in under({c}, stored - {c})):
                    stored = stored - {c}
            return stored

        stored = fewest(need & have)
        while True:
            tries = [fewest(stored | {c}) for c in sorted((under(stored, set()) & have) - need - stored)]
            best = min(tries, key=len, default=stored)
            if len(best) >= len(stored):
                break
            stored = best
        left = need & have - stored
        again = (left | under(left, stored)) - stored
        return stored, [n for c, n in named.items() if c in again]

    def reread(self) -> int:
        """Rows that the costly windows read for each row."""
        return sum(n.params[0] for n in self.order if n.op in ROLLED and n.op not in FOLLOWERS)

    def reach(self) -> tuple[int, int] | None:
        """Rows looked back and ahead by the deepest chain; None if some term needs everything."""
        back: dict[int, tuple[int, int]] = {}
        for node in self.order:
            own: tuple[int, int] | None = (0, 0)
            if node.op == "native":
                own = (node.params[1], node.params[2])
            elif node.op in OPERATORS and OPERATORS[node.op].kind == SYMBOL:
                own = OPERATORS[node.op].span(*node.params)
            if own is None:
                return None
            inner = [back[id(a)] for a in node.args] or [(0, 0)]
            back[id(node)] = (own[0] + max(b for b, _ in inner), own[1] + max(f for _, f in inner))
        whole = [back[id(r)] for r in self.roots.values()] or [(0, 0)]
        return max(b for b, _ in whole), max(f for _, f in whole)


def _column(node: Factor, layers: Layers, w: Windows, top: bool = True) -> Column:
    if not top and id(node) in layers.name:
        return F.col(layers.name[id(node)])
    if node.op == "field":
        return F.col(node.params[0])
    if node.op == "lit":
        return F.lit(node.params[0])
    if node.op == "native":
        return node.params[0].column
    inner = [_column(a, layers, w, False) for a in node.args]
    return OPERATORS[node.op].build(w, *inner, *node.params)


def add_ordinal(df: DataFrame, symbol: str, time: str, long_history: bool) -> DataFrame:
    """Add the row number within the instrument.

    For long histories the number is built from per-month counts, so that no window has to
    hold a whole instrument: offset of the month plus row number inside the month.
    """
    if not long_history:
        spec = Window.partitionBy(symbol).orderBy(time)
        return df.withColumn(ORDINAL, F.row_number().over(spec).cast("long"))
    month = F.trunc(F.col(time).cast("date"), "month")
    df = df.withColumn("_month", month)
    counts = df.groupBy(symbol, "_month").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(symbol).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(symbol, "_month",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(symbol, "_month").orderBy(time)
    return (
        df.join(offsets, [symbol, "_month"])
        .withColumn(ORDINAL, (F.row_number().over(inside) + F.col("_offset")).cast("long"))
        .drop("_month", "_offset")
    )


def _cut(df: DataFrame, back: int, ahead: int, size: int) -> DataFrame:
    """Assign rows to pieces of ``size`` rows, repeating the border rows a piece needs."""
    at = F.col(ORDINAL) - 1
    piece, inside = F.floor(at / size), at % size
    homes = F.array(F.lit(0).cast("long"))
    steps = [F.lit(0).cast("long")]
    for k in range(1, -(-back // size) + 1):
        steps.append(F.when(inside >= k * size - back, F.lit(k).cast("long")))
    for k in range(1, -(-ahead // size) + 1):
        steps.append(F.when(inside < ahead - (k - 1) * size, F.lit(-k).cast("long")))
    homes = F.array_compact(F.array(*steps)) if len(steps) > 1 else homes
    return (
        df.withColumn("_step", F.explode(homes))
        .withColumn("_piece", piece + F.col("_step"))
    )


def _remade(frame: DataFrame, again: list[Factor], layers: Layers, w: Windows) -> DataFrame:
    """``frame`` with row-wise terms that were not stored."""
    todo: dict[tuple[int, int, int], list[Factor]] = defaultdict(list)
    for n in again:
        todo[layers.place[id(n)]].append(n)
    for key in sorted(todo):
        frame = frame.select("*", *(_column(n, layers, w).alias(layers.name[id(n)]) for n in todo[key]))
    return frame


def _pieces(frame: DataFrame, new: list[Factor], layers: Layers, w: Windows, symbol: str, time: str, long_history: int,
            paths: list[str], always: list[str], needed: set[str], follow: list[list[Factor]], later: set[str],
            done: set[str]) -> DataFrame:
    """One layer of per-instrument terms over pieces of the histories: windows repeat border rows, running terms carry values over.

    Only columns that cannot be made again from others of the row are exchanged and stored, of border rows only what windows read.
    Row-wise terms of ``follow``, the layers up to the next window, that read no running term of this one are added before its rows
    are stored, so that what only they read is not, and named in ``done``; ``later`` is needed after them.
    """
    def args(n: Factor) -> list[Column]:
        return [_column(a, layers, w, False) for a in n.args]

    def lean(need: set[str]) -> tuple[list[str], list[Factor]]:
        have = set(frame.columns)
        stored, again = (need & have, []) if layers.has_native else layers.lean(need, have)
        return [c for c in frame.columns if c in always or c in stored or layers.has_native], again

    kept = [n for n in new if n.op in RUNNING or n.op == "block_sum"]
    rest = [n for n in new if not (n.op in RUNNING or n.op == "block_sum")]
    spans = [n.params[1:3] if n.op == "native" else OPERATORS[n.op].span(*n.params) for n in rest if _kind(n) == SYMBOL]
    if spans:
        whole = any(s is None for s in spans)  # a user's term that needs a whole history at once
        back, ahead = (0, 0) if whole else (max(s[0] for s in spans), max(s[1] for s in spans))
        stored, again = lean(needed)
        frame = frame.select(*stored)
        if not whole:
            frame = _cut(frame, back, ahead, max(long_history // 2, back, ahead, 1))
            if not layers.has_native:
                read = set().union(always, *(layers.reads(n) for n in rest))
                for n in reversed(again):
                    read |= layers.reads(n) if layers.name[id(n)] in read else set()
                frame = frame.select(*(F.when(F.col("_step") == 0, F.col(c)).alias(c) if c in stored and c not in read else c for c in frame.columns))
        pieces = Windows([symbol] if whole else [symbol, "_piece"], [time], time)
        # exchanged before the terms that were not stored are made again
        frame = _remade(frame.repartition(*pieces.symbol_keys), again, layers, w)
        frame = frame.select("*", *(_column(n, layers, pieces).alias(layers.name[id(n)]) for n in rest))
        frame = frame if whole else frame.where(F.col("_step") == 0).drop("_step", "_piece")
    elif rest:
        frame = frame.select("*", *(_column(n, layers, w).alias(layers.name[id(n)]) for n in rest))
    late = {layers.name[id(n)] for n in kept}
    need = later.union(*(layers.reads(n) for n in kept))
    for group in follow:
        early = [n for n in group if not layers.reads(n) & late]
        frame = frame.select("*", *(_column(n, layers, w).alias(layers.name[id(n)]) for n in early))
        done.update(layers.name[id(n)] for n in early)
        for n in group:
            if layers.name[id(n)] not in done:
                late.add(layers.name[id(n)])
                need |= layers.reads(n)
    if kept:
        stored, again = lean(need)
        frame = carried(frame.select(*stored), {layers.name[id(n)]: (n.op, args(n)) for n in kept}, symbol, time, max(long_history // 2, 1), paths,
                        lambda rows: _remade(rows, again, layers, w))
    return frame


def _roll(frame: DataFrame, columns: list[str], new: list[Factor], layers: Layers, w: Windows) -> DataFrame:
    """One layer of rolled terms; rows that the layer before rolled are still in order."""
    if SEQ not in frame.columns:
        frame = frame.withColumn(SEQ, F.row_number().over(w.seq))
    frame = frame.select(*columns, SEQ)
    todo = {layers.name[id(n)]: (n.op, [_column(a, layers, w, False) for a in n.args], rows_of(n.op, n.params)) for n in new}
    kinds = {c: frame.select(*[a.alias(str(k)) for k, a in enumerate(args)]).dtypes for c, (_, args, _) in todo.items()}
    # an average, a deviation or a rank is a double whatever it reads
    typed = {c: kinds[c][0][1] for c, (op, _, _) in todo.items() if op in ("win_sum", "ts_max", "ts_min", "ts_delay") and kinds[c][0][1] in INTEGERS}
    other = [n for n in new if any(k not in ("double", *INTEGERS) for _, k in kinds[layers.name[id(n)]])]
    frame = frame.select("*", *(_column(n, layers, w).alias(layers.name[id(n)]) for n in other))
    if other:
        frame = frame.drop(SEQ).withColumn(SEQ, F.row_number().over(w.seq))
    todo = {c: x for c, x in todo.items() if c not in {layers.name[id(n)] for n in other}}
    if todo:
        frame = rolled(frame, todo, w.i, steady)
    return frame.withColumns({c: F.col(c).cast("long" if todo[c][0] == "win_sum" else kind) for c, kind in typed.items()}) if typed else frame


def evaluate(
    df: DataFrame,
    factors: dict[str, Factor],
    keep: list[str] | None = None,
    symbol: str = "vt_symbol",
    time: str = "datetime",
    sizes: tuple[int, int] | None = None,
    long_history: int = LONG_HISTORY,
    wide_date: int = WIDE_DATE,
    parts: int = 0,
) -> DataFrame:
    """The panel's ``keep`` columns (default: all) plus one column per factor.

    ``sizes`` = (rows of the largest instrument, rows of the largest date), or more; measured if absent.
    ``parts`` says that the rows are already exchanged by instrument, in no fewer partitions than this.
    """
    layers = Layers(factors)
    kinds = {_kind(n) for n in layers.order}
    if sizes is None:
        sizes = measure(df, symbol, time) if kinds & {SYMBOL, DATE} else (0, 0)
    rows = sizes[0] if SYMBOL in kinds and sizes[0] <= long_history else None
    layers = Layers(factors, rows=rows)
    keep = list(df.columns) if keep is None else keep
    base = list(dict.fromkeys([symbol, time, *keep, *sorted(layers.fields)]))
    frame = df if layers.has_native else df.select(*base)

    reach = layers.reach() if SYMBOL in kinds else None
    roll = layers.reread() >= ROLLED_ROWS and not layers.has_native and plain(frame.schema) and not (reach is None and sizes[0] > long_history)
    if roll:
        layers = Layers(factors, roll=True, rows=rows)
    long = SYMBOL in kinds and sizes[0] > long_history
    cut = long and reach is not None  # one cut serves all layers
    pieced = long and reach is None  # some term runs over the whole history: every layer is cut by itself
    if pieced:
        layers = Layers(_one_count(layers.roots), expand=False)
    wide = DATE in kinds and sizes[1] > wide_date
    keys = sorted(layers.groups)
    heavy: dict[int, int] = defaultdict(int)
    for key in keys:
        heavy[key[0]] += sum(_kind(n) != ROW for n in layers.groups[key]) + (HEAVY_PHASE if key[1] >= ROLLED_LEVEL else 0)
    slots = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    if heavy[0] >= HEAVY_PHASE and not long and not parts:
        frame = frame.repartition(slots, symbol)
    if (layers.needs_ordinal or long) and ORDINAL not in frame.columns:
        frame = add_ordinal(frame, symbol, time, sizes[0] > long_history)
    always = list(dict.fromkeys([symbol, time, *keep]))
    if layers.needs_ordinal or long:
        always.append(ORDINAL)
    symbol_keys = [symbol, "_piece"] if cut else [symbol]
    w = Windows(symbol_keys, [time], time)

    needed: list[set[str]] = [set() for _ in range(len(keys) + 1)]
    needed[-1] = {layers.name[id(r)] if id(r) in layers.name else r.params[0]
                  for r in layers.roots.values() if r.op != "lit"}
    for at in range(len(keys) - 1, -1, -1):
        needed[at] = needed[at + 1].union(*(layers.reads(n) for n in layers.groups[keys[at]]))
    ranked = any(sum(n.op == "cs_rank" for n in layers.groups[k]) >= MANY_RANKS for k in keys) and not wide
    repeated = ranked and keys_repeat(df, symbol, time)
    phase = None
    paths: list[str] = []  # of the history table the next layer reads
    done: set[str] = set()  # row-wise terms added before the rows of their layer were stored
    columns = list(frame.columns)

    def trimmed(at: int, extra: list[str]) -> list[str]:
        return [c for c in columns if c in always or c in extra or c in needed[at] or layers.has_native]

    for at, key in enumerate(keys):
        dated = key[0] % 2 == 1
        if phase != key[0]:
            if cut and phase is not None and phase % 2 == 0:
                frame = frame.where(F.col("_step") == 0)
            # rows are narrowed before they are exchanged; inside a phase Catalyst prunes by itself
            columns = trimmed(at, [])
            frame = frame.select(*columns)
            if cut and not dated:
                frame = _cut(frame, reach[0], reach[1], max(long_history // 2, reach[0], reach[1], 1))
                columns += ["_step", "_piece"]
            if (key[0] > 0 or cut) and heavy[key[0]] >= HEAVY_PHASE and not (wide and dated) and not (pieced and not dated):
                frame = frame.repartition(slots, *([time] if dated else symbol_keys))
            phase = key[0]
        new = layers.groups[key]
        names = [layers.name[id(n)] for n in new]
        ranks = [n for n in new if n.op == "cs_rank"]
        if wide and dated and key[2] == 0:
            todo = {layers.name[id(n)]: (n.op, [*(_column(a, layers, w, False) for a in n.args), *n.params]) for n in new}
            columns = trimmed(at + 1, []) + names
            frame = wide_terms(frame, todo, symbol, time, wide_date).select(*columns)
        elif pieced and not dated and any(_kind(n) == SYMBOL for n in new):
            end = next((k for k in range(at + 1, len(keys)) if keys[k][2] == 0), len(keys))
            follow = [layers.groups[k] for k in keys[at + 1 : end]]
            frame = _pieces(frame, new, layers, w, symbol, time, long_history, paths, always, needed[at], follow, needed[end], done)
            columns = list(frame.columns)
        elif len(ranks) >= MANY_RANKS:
            rest = [_column(n, layers, w).alias(layers.name[id(n)]) for n in new if n.op != "cs_rank"]
            frame = frame.select(*trimmed(at, []), *rest)
            inputs = {layers.name[id(n)]: _column(n.args[0], layers, w, False) for n in ranks}
            columns = trimmed(at + 1, []) + names
            frame = many_ranks(frame, inputs, symbol, time, repeated).select(*columns)
        elif roll and key[1] > ROLLED_LEVEL and key[2] == 0:
            columns = trimmed(at, ["_step", "_piece"])
            frame = _roll(frame, columns, new, layers, w)
            columns += names
        else:
            new = [n for n in new if layers.name[id(n)] not in done]
            frame = frame.select("*", *(_column(n, layers, w).alias(layers.name[id(n)]) for n in new))
            columns += [layers.name[id(n)] for n in new]
    if cut and phase is not None and phase % 2 == 0:
        frame = frame.where(F.col("_step") == 0)
    outs = []
    for name, root in layers.roots.items():
        col = F.col(layers.name[id(root)]) if id(root) in layers.name else _column(root, layers, w)
        outs.append(col.alias(name))
    taken = set(layers.roots)
    return frame.select(*(c for c in dict.fromkeys([symbol, time, *keep]) if c not in taken), *outs)
