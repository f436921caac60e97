"""Portfolio simulation: one sequential fold for each scenario, scenarios side by side."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

LEDGER = (
    "scenario_id string, step int, dt date, symbol string, close double, position double, available double, capital double, tot_value double, "
    "realized double, order_id int, order_type string, price double, quantity double"
)


@dataclass
class Strategy:
    """How orders fire; the defaults are the three-screen strategy."""

    capital: float = 10_000.0
    max_stake: float = 10_000_000.0
    fee: float = 1e-4
    slip: float = 0.001
    least: float = 100.0
    exit_average: str = "ema10"
    require_flat: bool = True
    intraday_close: bool = False


@dataclass
class Order:
    order_id: int
    symbol: str
    kind: str
    quantity: float
    status: str = "open"


class Book:
    """Orders, positions and cash of a scenario."""

    def __init__(self, strategy: Strategy) -> None:
        self.s, self.orders, self.count = strategy, [], 0
        self.cash, self.realized = strategy.capital, 0.0
        self.position: dict[str, float] = {}
        self.available: dict[str, float] = {}
        self.cost: dict[str, float] = {}
        self.days: list[dict[str, dict]] = []
        self.fills: dict[str, tuple[Order, float, float]] = {}

    def create(self, symbol: str, kind: str, quantity: float) -> None:
        """A new order ends those that wait after a failed trigger."""
        self.orders = [o for o in self.orders if o.status != "tracking"]
        self.orders.append(Order(self.count, symbol, kind, quantity))
        self.count += 1

    def start(self, rows: dict[str, dict]) -> None:
        self.days = [*self.days[-2:], rows]
        self.available = dict(self.position)
        self.fills = {}

    def _buy(self, o: Order) -> float | None:
        today, before = self.days[-1][o.symbol], self.days[-2].get(o.symbol)
        if o.quantity <= self.s.least or before is None:
            return None
        if not today["close" if self.s.intraday_close else "high"] > before["high"]:
            o.status = "tracking"
            return None
        price = max(before["high"], today["open"]) + self.s.slip
        lots = min(math.floor(math.floor(self.cash / price) / 100) * 100, o.quantity)
        flat = not self.s.require_flat or sum(self.position.values()) == 0
        if lots > 100 and flat and self.cash >= price * lots * (1 + self.s.fee):
            o.quantity = lots
            return price
        return None

    def _sell(self, o: Order) -> float | None:
        today, before = self.days[-1][o.symbol], [d[o.symbol] for d in self.days[:-1] if o.symbol in d][-2:]
        low = today["close" if self.s.intraday_close else "low"]
        if len(before) == 2 and self.available.get(o.symbol, 0) > 0 and low < min(b["low"] for b in before) and low < today[self.s.exit_average]:
            quantity = min(self.position.get(o.symbol, 0), o.quantity)
            if quantity > 0:
                o.quantity = quantity
                return min(before[-1]["low"], today["open"]) - self.s.slip
        elif o.kind == "sell":
            o.status = "tracking"
        return None

    def match(self) -> None:
        """Orders in order of creation, those that fills create as well; one fill a day."""
        k = 0
        pending = self.orders
        while k < len(pending):
            o = pending[k]
            k += 1
            if o.status in ("open", "tracking") and o.symbol in self.days[-1]:
                price = self._buy(o) if o.kind == "buy" else self._sell(o)
                if price is not None and not self.fills:
                    self._fill(o, price)
                    pending = pending + [x for x in self.orders if x not in pending]
        self.orders = [o for o in self.orders if o.status in ("open", "tracking")]

    def _fill(self, o: Order, price: float) -> None:
        o.status = "filled"
        have = self.position.get(o.symbol, 0.0)
        quantity = max(o.quantity, have)
        self.fills[o.symbol] = (o, price, quantity)
        amount = price * quantity
        if o.kind == "buy":
            self.create(o.symbol, "stop", quantity)
            self.cost[o.symbol] = (self.cost.get(o.symbol, 0.0) * have + amount) / (have + quantity)
            self.position[o.symbol] = have + quantity
            self.cash -= amount * (1 + self.s.fee)
        else:
            self.realized += (price - self.cost.get(o.symbol, 0.0)) * quantity
            self.position[o.symbol] = have - quantity
            self.cash += amount * (1 - self.s.fee)


def fold(days: Iterator[tuple[object, dict[str, dict], str | None]], strategy: Strategy) -> Iterator[tuple]:
    """Days are (date, rows by symbol, symbol to buy as decided at its end): ledger rows; nothing trades on the first."""
    book, decided, last = Book(strategy), None, {}
    for step, (dt, rows, candidate) in enumerate(days):
        if step == 0:
            book.days = [rows]
            last.update({s: r["close"] for s, r in rows.items()})
            for symbol, r in rows.items():
                yield step, dt, symbol, r["close"], 0.0, 0.0, book.cash, book.cash, 0.0, None, None, None, None
        else:
            if decided is not None:
                book.create(decided, "buy", strategy.max_stake)
            book.start(rows)
            book.match()
            last.update({s: r["close"] for s, r in rows.items()})
            total = book.cash + sum(n * last.get(s, 0.0) for s, n in book.position.items())
            for symbol, r in rows.items():
                o, price, quantity = book.fills.get(symbol, (None, None, None))
                yield step, dt, symbol, r["close"], book.position.get(symbol, 0.0), book.available.get(symbol, 0.0), book.cash, total, book.realized, o and o.order_id, o and o.kind, price, quantity
        decided = candidate


def backtest(features: DataFrame, scenarios: DataFrame | None = None, strategy: Strategy | None = None) -> DataFrame:
    """The ledger of every scenario: a row a day and symbol, with the fill, if any.

    features have symbol, dt, open, high, low, close, signal, force_index_close and the
    exit average. scenarios have scenario_id and any fields of Strategy as columns; each
    runs on its own, over all days in order. Decisions at a day's end are executed the
    next day; positions can be sold from the day after they were bought.
    """
    base = strategy or Strategy()
    spark = features.sparkSession
    scenarios = scenarios if scenarios is not None else spark.createDataFrame([("default",)], "scenario_id string")
    fields = [c for c in scenarios.columns if c != "scenario_id"]
    averages = [c for c in features.columns if c.startswith("ema")]
    rank = F.col("ordinal") if "ordinal" in features.columns else F.col("symbol")
    bar = F.struct(rank.alias("rank"), "symbol", "open", "high", "low", "close", *averages, "signal", F.col("force_index_close").alias("force"))
    # A day is one row of structs; scenarios are few and small, days of a scenario stream through one fold.
    days = features.groupBy("dt").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    each = days.join(F.broadcast(scenarios))

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("dt")
        own = Strategy(**{**base.__dict__, **({f: frame[f].iloc[0] for f in fields})})

        def days_of():
            for dt, bars in zip(frame["dt"], frame["bars"], strict=True):
                bars = [dict(b) for b in bars]
                wanted = min((b for b in bars if b["signal"] == 1), key=lambda b: (b["force"], b["rank"]), default=None)
                yield dt, {b["symbol"]: b for b in bars}, wanted and wanted["symbol"]

        names = [c.split()[0] for c in LEDGER.split(", ")]
        out = pd.DataFrame(list(fold(days_of(), own)), columns=names[1:])
        out.insert(0, "scenario_id", key[0])
        return out

    return each.groupBy("scenario_id").applyInPandas(run, LEDGER)
