"""Time-series windows over bars keyed by (symbol, dt)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tideline.functions.scan import Look, Steps, blocked, linear, number


def by_symbol(*order: str | Column) -> WindowSpec:
    """Rows of a symbol in order of dt: one spec for all functions, so that one sort serves them."""
    return Window.partitionBy("symbol").orderBy(*(order or ("dt",)))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(_col(c), n).over(by_symbol())


def lead(c: str | Column, n: int = 1) -> Column:
    return F.lead(_col(c), n).over(by_symbol())


def diff(c: str | Column) -> Column:
    return _col(c) - lag(c)


def rolling(f, c: str | Column, n: int, full: bool = True) -> Column:
    """f over the last n rows; null until n values are there if full, else over what there is."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    out = f(_col(c)).over(w)
    return F.when(F.count(_col(c)).over(w) == n, out) if full else out


def sma(c: str | Column, n: int, full: bool = True) -> Column:
    return rolling(F.avg, c, n, full)


def sma_or_zero(c: str | Column, n: int = 100) -> Column:
    """A moving average whose head is filled with zeros."""
    return F.coalesce(sma(c, n), F.lit(0.0))


def running(f, c: str | Column) -> Column:
    return f(_col(c)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def cumulative_product(c: str | Column) -> Column:
    """Nulls are skipped and stay null."""
    return F.when(_col(c).isNotNull(), running(F.product, c))


def forward_fill(df: DataFrame, columns: list[str], block: Column | None = None) -> DataFrame:
    """The last value known in place of nulls; with blocks (see `blocked`) a symbol's rows fall to many tasks."""
    if block is not None:
        return blocked(df, {c: ("last", c) for c in columns}, block=block)
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def week_end(c: str | Column = "dt") -> Column:
    """The Friday that labels the week Saturday to Friday."""
    return F.next_day(F.date_sub(_col(c), 1), "FRI")


def min_max(c: str | Column) -> Column:
    """(x - min) / (max - min) over the symbol's rows; null if they are all equal."""
    w = Window.partitionBy("symbol")
    low, high = F.min(_col(c)).over(w), F.max(_col(c)).over(w)
    return (_col(c) - low) / F.nullif(high - low, F.lit(0.0))


def standardized(c: str | Column, eps: float = 0.0) -> Column:
    """By mean and sample deviation of the symbol's rows; null if that is zero and eps, too."""
    w = Window.partitionBy("symbol")
    return (_col(c) - F.avg(_col(c)).over(w)) / F.nullif(F.stddev_samp(_col(c)).over(w) + eps, F.lit(0.0))


#: A column, its averages (name to alpha), and averages (name to SQL and alpha) of what some SQL
#: makes of the averages before them, which it looks up by name.
Averages = tuple[str, dict[str, float], dict[str, tuple[Callable[[Look], str], float]]]


def averages(df: DataFrame, c: str, alphas: dict[str, float], of: dict[str, tuple[Callable[[Look], str], float]] | None = None) -> DataFrame:
    """Adds exponential averages of c with y0 = x0, and averages of them; see averages_of."""
    return averages_of(df, [(c, alphas, of or {})])


def averages_of(df: DataFrame, wanted: list[Averages]) -> DataFrame:
    """Adds the averages of several columns, all in one scan.

    The first one is the first value; leading nulls give null. A null inside carries y on, and
    the weight of the past decays for each skipped row: with g rows since the last value
    y = ((1 - a)**g y' + a x) / ((1 - a)**g + a).
    """
    w, place, n = by_symbol(), "__place", "__n"
    so_far, all_rows = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = [F.col(c).cast("double") for c, _, _ in wanted]
    # One window serves all of these; the gaps to the last values need another one.
    numbered = df.withColumns({place: F.row_number().over(w), n: F.count(F.lit(1)).over(all_rows)} | {f"__{kind}{i}": count for i, v in enumerate(x) for kind, count in (("seen", F.count(v).over(so_far)), ("none", F.count(v).over(so_far) == 0))})
    gaps = {f"__gap{i}": F.col(place) - F.last(F.when(v.isNotNull(), F.col(place)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for i, v in enumerate(x)}
    numbered = numbered.withColumns(gaps)
    given = {f"__x{i}": v for i, v in enumerate(x)} | {c: F.col(c) for i in range(len(x)) for c in (f"__seen{i}", f"__gap{i}")}

    def values(v: Look) -> Steps:
        out = {}
        for i, (_, alphas, _) in enumerate(wanted):
            value, gap = v(f"__x{i}"), v(f"__gap{i}")
            for name, a in alphas.items():
                left = f"CASE WHEN {gap} = 1 THEN {number(1 - a)} ELSE pow({number(1 - a)}, {gap}) END"
                kinds = f"CASE WHEN {value} IS NULL THEN {{}} WHEN {gap} IS NULL THEN {{}} ELSE {{}} / ({left} + {number(a)}) END"
                out[name] = kinds.format("1D", "0D", left), kinds.format("0D", value, f"{value} * {number(a)}")
        return out

    def values_of(v: Look) -> Steps:
        out = {}
        for i, (_, _, of) in enumerate(wanted):
            early, fresh = f"{v(f'__seen{i}')} = 0", f"{v(f'__gap{i}')} IS NULL AND {v(f'__x{i}')} IS NOT NULL"
            for name, (f, a) in of.items():
                out[name] = f"CASE WHEN {early} OR {fresh} THEN 0D ELSE {number(1 - a)} END", f"CASE WHEN {early} THEN 0D WHEN {fresh} THEN {f(v)} ELSE ({f(v)}) * {number(a)} END"
        return out

    stages = [values, values_of] if any(of for _, _, of in wanted) else [values]
    out = linear(numbered, given, stages, places=(place, n))
    known = {name: F.when(~F.col(f"__none{i}"), F.col(name)) for i, (_, alphas, of) in enumerate(wanted) for name in [*alphas, *of]}
    return out.withColumns(known).drop(*[f"__none{i}" for i in range(len(x))])


def ema(df: DataFrame, c: str, out: str, span: float | None = None, com: float | None = None) -> DataFrame:
    """Adds out, the exponential average of c by span (alpha = 2 / (n + 1)) or com (1 / (1 + com)); see averages."""
    return averages(df, c, {out: 2 / (span + 1) if span is not None else 1 / (1 + com)})


def ema_spans(df: DataFrame, spans: tuple[int, ...], c: str = "close") -> DataFrame:
    """Adds ema<n> of c for each span n."""
    return averages(df, c, {f"ema{n}": 2 / (n + 1) for n in spans})
