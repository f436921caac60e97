"""Labels and data sets for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.scan import linear
from tideline.functions.windows import by_symbol, lead


def forward_return(df: DataFrame, n: int = 5, c: str = "close") -> DataFrame:
    """Adds fwd_return (null at the end) and label, whether it is above 0."""
    df = df.withColumn("fwd_return", (lead(c, n) - F.col(c)) / F.col(c))
    return df.withColumn("label", F.when(F.col("fwd_return").isNotNull(), (F.col("fwd_return") > 0).cast("int")))


def slope_hits(df: DataFrame, histogram: str = "macd") -> DataFrame:
    """Adds hit: the histogram's next change has the sign of the forward return."""
    product = (lead(histogram) - F.col(histogram)) * F.col("fwd_return")
    return df.withColumn("hit", F.when(product.isNotNull(), (product > 0).cast("int")))


def split_by_place(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds is_train: the first int(share * n) rows of each symbol."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("is_train", F.row_number().over(by_symbol()) - 1 < F.floor(n * share))


def sliding_windows(df: DataFrame, features: list[str], label: str, length: int = 30, tail: int = 5) -> DataFrame:
    """symbol, dt (of the first row), window (length arrays of features), target: label `length` rows on; n - tail - length of them."""
    w = by_symbol()
    values = F.array(*[F.col(f).cast("double") for f in features])
    df = df.withColumns({"window": F.collect_list(values).over(w.rowsBetween(0, length - 1)), "target": F.lead(label, length).over(w), "__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return df.filter(F.col("__r") <= F.col("__n") - tail - length).select("symbol", "dt", "window", "target")


def histogram(df: DataFrame, c: str, bins: int = 100) -> DataFrame:
    """bin (from 1), n: equal widths between the column's ends, the last bin closed; empty bins are left out, nulls too."""
    ends = df.agg(F.min(c).alias("__low"), F.max(c).alias("__high"))
    placed = df.filter(F.col(c).isNotNull()).join(F.broadcast(ends))
    place = F.when(F.col("__high") > F.col("__low"), F.least(F.floor((F.col(c) - F.col("__low")) / (F.col("__high") - F.col("__low")) * bins) + 1, F.lit(bins))).otherwise(1)
    return placed.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def discounted(df: DataFrame, reward: str, out: str = "ret", gamma: float = 0.99, done: str | None = None) -> DataFrame:
    """Adds out: R_t = r_t + gamma (1 - done_t) R_t+1 in each symbol, from the end."""
    keep = F.lit(gamma) if done is None else F.when(F.col(done) == 1, 0.0).otherwise(gamma)
    order = -F.datediff("dt", F.lit("1970-01-01"))
    seen = F.count(reward).over(by_symbol(order).rowsBetween(Window.unboundedPreceding, 0))
    given = {"__r": F.col(reward).cast("double"), "__keep": keep.cast("double")}
    out_of = linear(df.withColumn("__seen", seen), given, [lambda v: {out: (f"CASE WHEN {v('__r')} IS NULL THEN 1D ELSE {v('__keep')} END", f"coalesce({v('__r')}, 0D)")}], order)
    return out_of.withColumn(out, F.when(F.col("__seen") > 0, F.col(out))).drop("__seen")


def baseline_advantage(df: DataFrame, c: str) -> DataFrame:
    """Adds advantage: the value less the mean of those after it (0 for the last)."""
    later = F.avg(c).over(by_symbol().rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("advantage", F.col(c) - F.coalesce(later, F.col(c)))


def replay_buffer(df: DataFrame, capacity: int) -> DataFrame:
    """The last `capacity` transitions of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= capacity).drop("__n")


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def epsilon(step, start: float = 1.0, end: float = 0.01, decay: float = 500.0):
    """Exploration rate after some steps, decaying exponentially."""
    return F.lit(end) + (start - end) * F.exp(-step / decay)


def greedy_action(q):
    """Place (from 0) of the greatest value of an array."""
    return F.array_position(q, F.array_max(q)) - 1


def episodes(df: DataFrame, length: int, seed: int | None = None) -> DataFrame:
    """`length` rows of each symbol in order, from the first one or, with a seed, from a random one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    df = df.withColumns({"__r": F.row_number().over(by_symbol()), "__n": n})
    offset = F.lit(0) if seed is None else F.pmod(F.xxhash64("symbol", F.lit(seed)), F.greatest(F.col("__n") - length, F.lit(1)))
    return df.filter((F.col("__r") > offset) & (F.col("__r") <= offset + length)).drop("__r", "__n")


def linear_epsilon(step, start: float = 1.0, end: float = 0.01, steps: int = 100):
    """Exploration rate that falls from start to end in so many steps and stays there."""
    return F.greatest(F.lit(end), start - (start - end) * step / steps)


def lots(capital, price, lot: int = 100):
    """The quantity in whole lots that capital buys."""
    return F.floor(capital / price / lot) * lot


def transitions(df: DataFrame, state: str) -> DataFrame:
    """symbol, dt, the state, next_<state> and done: whether the row ends its symbol (next is null there)."""
    following = F.lead(state).over(by_symbol())
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("dt").desc())) == 1
    return df.select("symbol", "dt", state, following.alias(f"next_{state}"), last.alias("done"))


def gathered(batches: list[DataFrame]) -> DataFrame:
    """The rows of the batches of several workers, by column names."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out
