"""Scans over long series: running aggregates by time blocks, and linear recurrences by composed steps.

A running window over a symbol streams the symbol through one task. `blocked` cuts a symbol
into blocks of time instead, which fall to different tasks: a first pass sums each block up
(partial aggregates, so that little is shuffled), a scan over these few rows gives what each
block starts from, and a second pass applies that to the rows of a block.

`linear` adds columns y with y = a * y' + b. Such steps compose to one of the same form, so
a block of rows becomes one step, which is applied to what the blocks before it leave; the
rows of a block are then stepped through side by side with other blocks. Nothing has to fade
away, so the time a row takes doesn't depend on how long a value lasts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Days of a block.
WIDTH = 64
#: Rows of a block of steps at least; it has the root of the number of a symbol's rows if that is more.
ROWS = 512
#: Steps whose results are gathered at a time.
CHUNK = 32

_BLOCK = "__block"


def days(order: str | Column, width: int = WIDTH) -> Column:
    """The block of so many days that a date or timestamp falls into."""
    return F.floor(F.datediff(order, F.lit("1970-01-01").cast("date")) / width)


#: For each kind: what sums a block up (of a value and the order), what sums blocks up, and how that is joined with a row's own.
_KINDS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "count": (lambda c, _: F.count(c), F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "sum": (lambda c, _: F.sum(c), F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "product": (lambda c, _: F.product(c), F.product, lambda before, own: F.coalesce(before * own, before, own)),
    "min": (lambda c, _: F.min(c), F.min, F.least),
    "max": (lambda c, _: F.max(c), F.max, F.greatest),
    "last": (lambda c, at: F.max_by(c, F.when(c.isNotNull(), at)), lambda s: F.last(s, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
    "first": (lambda c, at: F.min_by(c, F.when(c.isNotNull(), at)), lambda s: F.first(s, ignorenulls=True), lambda before, own: F.coalesce(before, own)),
    "before": (lambda c, at: F.max_by(F.struct(c.alias("v")), at), lambda s: F.last(s, ignorenulls=True), lambda before, own: F.coalesce(own, before)["v"]),
}
_OWN: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "sum": F.sum, "product": F.product, "min": F.min, "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
}


def blocked(df: DataFrame, wanted: dict[str, tuple[str, str | Column]], key: list[str] | None = None, order: str = "dt", block: Column | None = None, stored: bool = False) -> DataFrame:
    """Adds running aggregates of the rows up to each row: for out: (kind, column), kinds being the keys of _KINDS.

    first and last skip nulls; before is the value of the row before, null or not. Equal to the
    window functions over rows up to the current one (doubles but for the order in which they
    are added up). order must be unique in a key and not null; block must grow with it
    (blocks of WIDTH days if None). df is read twice; stored writes it to the checkpoint folder
    before, where it is costly to make.
    """
    df = df.checkpoint() if stored else df
    key = key or ["symbol"]
    block = days(order) if block is None else block
    named = {out: (kind, F.col(c) if isinstance(c, str) else c) for out, (kind, c) in wanted.items()}
    rows = df.withColumn(_BLOCK, block)
    sums = rows.groupBy(*key, _BLOCK).agg(*[_KINDS[kind][0](c, F.col(order)).alias(f"__carried_{out}") for out, (kind, c) in named.items()])
    before = Window.partitionBy(*key).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*key, _BLOCK, *[_KINDS[kind][1](F.col(f"__carried_{out}")).over(before).alias(f"__carried_{out}") for out, (kind, _) in named.items()])
    inside = Window.partitionBy(*key, _BLOCK).orderBy(order)

    def own(kind: str, c: Column) -> Column:
        return F.lag(F.struct(c.alias("v"))).over(inside) if kind == "before" else _OWN[kind](c).over(inside.rowsBetween(Window.unboundedPreceding, 0))

    joined = rows.join(carried, [*key, _BLOCK], "left")
    added = joined.withColumns({out: _KINDS[kind][2](F.col(f"__carried_{out}"), own(kind, c)) for out, (kind, c) in named.items()})
    return added.select(*df.columns, *[out for out in named if out not in df.columns])


Look = Callable[[str], str]
Steps = dict[str, tuple[str, str]]


def number(x: float) -> str:
    """A double in SQL."""
    return f"{float(x)!r}D"


def linear(df: DataFrame, given: dict[str, Column], stages: list[Callable[[Look], Steps]], order: Column | None = None, places: tuple[str, str] | None = None, rows: int = ROWS) -> DataFrame:
    """Adds columns y = a * y' + b of each row in a symbol's order (of dt, or by the order), from 0.

    places names columns that have a row's place from 1 and the number of the symbol's rows, where
    the caller has them; they are dropped, and so are given ones that are columns by the same name.

    A stage makes out: (a, b), neither null, as SQL of a row's given columns and of the outs of
    stages before it, all looked up by name. One shuffle by symbol serves all stages. (SQL, as
    a column object for each node of a step would take longer to build than the scan to run.)
    """
    at = F.col("dt") if order is None else order
    w = Window.partitionBy("symbol").orderBy(at)
    place, n = (F.col(c) for c in places) if places else (F.row_number().over(w), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    columns = [c for c in df.columns if c not in (places or ())]
    # With as many rows in a block as there are blocks, the scan over the blocks is linear, too.
    size = F.greatest(F.lit(rows), F.ceil(F.sqrt(n)))
    row = F.struct(at.alias("at"), F.struct(*[c for c in columns if c != "symbol" and c not in given]).alias("row"), *[c.alias(n) for n, c in given.items()])
    placed = df.select("symbol", F.floor((place - 1) / size).alias(_BLOCK), row.alias("__own"))
    blocks = placed.groupBy("symbol", _BLOCK).agg(F.sort_array(F.collect_list("__own")).alias("__own"))
    outs: list[str] = []
    for stage in stages:
        blocks, added = _stage(blocks, stage)
        kept = ["row", *(given if stage is not stages[-1] else []), *outs]
        outs += added
        fields = [*[f"'{c}', e.`{c}`" for c in kept], *[f"'{c}', s.`{c}`" for c in added]]
        blocks = blocks.select("symbol", _BLOCK, F.expr(f"zip_with(__own, __states, (e, s) -> named_struct({', '.join(fields)}))").alias("__own"))
    columns = [c for c in columns if c not in given]
    flat = [*[f"'{c}', e.row.`{c}`" for c in columns if c != "symbol"], *[f"'{c}', e.`{c}`" for c in outs]]
    # The fields come out as columns of inline: a projection to them would double what Catalyst
    # infers from a filter with each. The outer form, as no block is empty and inline would
    # fold twice, once to look whether it is.
    return blocks.selectExpr("symbol", f"inline_outer(transform(__own, e -> named_struct({', '.join(flat)})))").select(*columns, *outs)


def _stage(blocks: DataFrame, stage: Callable[[Look], Steps]) -> tuple[DataFrame, list[str]]:
    """Adds __states, the states after each row of a block, beside its rows; names of a state's fields."""
    steps = stage(lambda name: f"e.`{name}`")

    def state(field: Callable[[str], str]) -> str:
        return f"named_struct({', '.join(f"'{n}', {field(n)}" for n in steps)})"

    whole = state(lambda n: "named_struct('a', 1D, 'b', 0D)")
    composed = state(lambda n: f"named_struct('a', s.`{n}`.a * ({steps[n][0]}), 'b', s.`{n}`.b * ({steps[n][0]}) + ({steps[n][1]}))")
    blocks = blocks.withColumn("__steps", F.expr(f"aggregate(__own, {whole}, (s, e) -> {composed})"))
    before = Window.partitionBy("symbol").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__steps", F.collect_list("__steps").over(before))
    start = f"aggregate(__steps, {state(lambda n: '0D')}, (s, e) -> {state(lambda n: f'e.`{n}`.a * s.`{n}` + e.`{n}`.b')})"
    step = state(lambda n: f"({steps[n][0]}) * element_at(x, -1).`{n}` + ({steps[n][1]})")
    # Results are gathered in short arrays, as each one more copies the array that it goes to.
    chunks = f"transform(sequence(0, int(floor((size(__own) - 1) / {CHUNK}))), i -> slice(__own, i * {CHUNK} + 1, {CHUNK}))"
    inner = f"aggregate(chunk, array(element_at(element_at(done, -1), -1)), (x, e) -> concat(x, array({step})))"
    done = f"aggregate({chunks}, array(array({start})), (done, chunk) -> concat(done, array({inner})))"
    return blocks.withColumn("__states", F.expr(f"flatten(transform(slice({done}, 2, size(__own)), x -> slice(x, 2, {CHUNK})))")), list(steps)
