"""How rows form series: the columns that name a series, the order within it and the value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class SeriesSpec:
    """``keys`` may not be empty: a window without a partition would move a whole table to one task."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    value: str = "value"

    def __post_init__(self) -> None:
        if not self.keys or not self.order:
            raise ValueError("a series needs key and order columns")

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def rows(self, before: int, after: int) -> WindowSpec:
        return self.window.rowsBetween(-before, after)

    def past(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def x(self) -> Column:
        """The value with NaN as missing."""
        return F.nanvl(F.col(self.value).cast("double"), F.lit(None).cast("double"))

    def indexed(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Adds the 0-based position in the series."""
        return df.withColumn(name, (F.row_number().over(self.window) - 1).cast("long"))
