"""Windows over a session, and what is computed in them. All share one partitioning, so a chain of them needs one Exchange."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .safe import col, div


class Session:
    """The windows of sessions: whole, in order of time, the last n rows, and all rows so far."""

    def __init__(self, keys: list[str] | None = None) -> None:
        self.by = [*(["symbol"] if keys is None else keys), "session"]
        self.whole: WindowSpec = Window.partitionBy(*self.by)
        self.order: WindowSpec = self.whole.orderBy("ts")
        self.so_far: WindowSpec = self.order.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(1 - n, 0)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.order)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.order)

    def ordinal(self) -> Column:
        return F.row_number().over(self.order) - 1

    def difference(self, c: Column | str) -> Column:
        return col(c) - self.lag(c)

    def change(self, c: Column | str, n: int, pad: bool = False) -> Column:
        """Relative change over n rows; with pad, missing values repeat the last one before."""
        c = self.ffill(col(c)) if pad else col(c)
        return div(c, self.lag(c, n)) - 1

    def rolling(self, c: Column | str, n: int, how, least: int | None = None) -> Column:
        """how(c) over the last n rows, where `least` of them (all n by default) have a value."""
        least = n if least is None else least
        value = how(col(c)).over(self.last(n))
        return value if least <= 1 else F.when(F.count(col(c)).over(self.last(n)) >= least, value)

    def zscore(self, c: Column | str) -> Column:
        """Against mean and sample deviation of the whole session; it looks ahead within the session."""
        return div(col(c) - F.avg(col(c)).over(self.whole), F.stddev_samp(col(c)).over(self.whole))

    def ffill(self, c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(self.so_far)
