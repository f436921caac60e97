"""Look-ups by a list of symbols that notice missing ones in the same pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


class MissingSymbols(KeyError):
    """Symbols of a list that had no row."""

    def __init__(self, missing: list[str]) -> None:
        super().__init__(f"no rows for {', '.join(missing)}")
        self.missing = missing


class Checked:
    """Rows of listed symbols, and what the action that reads them has counted."""

    def __init__(self, rows: DataFrame, symbols: list[str], observation: Observation) -> None:
        self.rows, self.symbols, self.observation = rows, symbols, observation

    def counts(self) -> dict[str, int]:
        """Rows by symbol, in the list's order; to be asked after the action."""
        found = self.observation.get if self.symbols else {}
        return {s: found[f"n{i}"] for i, s in enumerate(self.symbols)}

    def verify(self) -> None:
        """Raises MissingSymbols for symbols without rows; to be asked after the action."""
        missing = [s for s, n in self.counts().items() if not n]
        if missing:
            raise MissingSymbols(missing)

    def collected(self) -> list[T.Row]:
        """The rows, after the check."""
        out = self.rows.collect()
        self.verify()
        return out


def listed(spark: SparkSession, symbols: list[str], ordinal: str = "ordinal") -> DataFrame:
    """symbol, ordinal: a list's symbols and their places."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], f"symbol string, {ordinal} int")


def look_up(df: DataFrame, symbols: list[str], ordered: bool = True) -> Checked:
    """The rows of the listed symbols (each once, no nulls), in the list's order if ordered, with a check that each has one.

    The symbols come as a list on the driver and go to the scan as a filter; a metric a symbol is
    counted while the rows pass, so no second job looks for missing ones.
    """
    if len(set(symbols)) < len(symbols):
        raise ValueError("a symbol is listed twice")
    seen = Observation()
    rows = df.filter(F.col("symbol").isin(symbols))
    counts = [F.count(F.when(F.col("symbol") == s, 1)).alias(f"n{i}") for i, s in enumerate(symbols)]
    if ordered and symbols:
        place = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("symbol"))
        rows = rows.orderBy(place, *(["dt"] if "dt" in df.columns else []))
    # After the sort, which looks at a sample of its input first.
    rows = rows.observe(seen, *counts) if counts else rows
    return Checked(rows, symbols, seen)
