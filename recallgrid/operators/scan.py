"""Windows over groups of any size: sums and neighbours carried from range to range, so that no task holds a group.

Rows are sorted over ranges of (group, order) and written with the range they are in and their place there. A window runs inside each
range; what a range takes over from those before it comes from one row for each range that a group reaches into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder


class Ranges:
    """``rows`` in order within each group; without ``group`` all rows are one. Rows that tie in ``order`` stand as they come to lie in the
    written table. Columns named ``_rg_``... are its own."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[Column]):
        spark, keys = rows.sparkSession, [*(F.col(g) for g in group), *order]
        folder = new_folder(spark, "ranges")
        laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        laid.withColumns({"_rg_range": F.spark_partition_id(), "_rg_place": place}).write.parquet(folder)
        self.rows, self.group, self.columns = spark.read.parquet(folder), group, rows.columns

    def _carried(self, kept: dict[str, Column], taken: dict[str, Column]) -> DataFrame:
        """For each group that reaches into several ranges and each of those but its first: ``taken`` over what ``kept`` says of the ranges
        before. A range takes over one group at most, the one that it begins with."""
        by = [*self.group, "_rg_range"]
        ends = self.rows.groupBy(*by).agg(*(c.alias(f"_rg_c_{n}") for n, c in kept.items()))
        earlier = Window.partitionBy(*self.group).orderBy("_rg_range").rowsBetween(Window.unboundedPreceding, -1)
        keys = [F.col(c).alias(f"_rg_k_{c}") for c in by]
        made = ends.select(*keys, *(c.over(earlier).alias(f"_rg_c_{n}") for n, c in taken.items()), F.count("*").over(earlier).alias("_rg_n"))
        return made.where("_rg_n > 0").drop("_rg_n")

    def _joined(self, inside: DataFrame, carried: DataFrame) -> DataFrame:
        on = [F.col(c).eqNullSafe(F.col(f"_rg_k_{c}")) for c in self.group] + [F.col("_rg_range") == F.col("_rg_k__rg_range")]
        return inside.join(F.broadcast(carried), on, "left")

    def running_sums(self, **values: Column) -> DataFrame:
        """The rows with the sum of each value up to and with them; nulls add nothing."""
        w = Window.partitionBy("_rg_range", *self.group).orderBy("_rg_place").rowsBetween(Window.unboundedPreceding, 0)
        inside = self.rows.withColumns({f"_rg_v_{n}": F.sum(F.coalesce(v, F.lit(0))).over(w) for n, v in values.items()})
        before = self._carried({n: F.sum(F.coalesce(v, F.lit(0))) for n, v in values.items()}, {n: F.sum(f"_rg_c_{n}") for n in values})
        out = self._joined(inside, before)
        return out.select(*self.columns, *((F.col(f"_rg_v_{n}") + F.coalesce(F.col(f"_rg_c_{n}"), F.lit(0))).alias(n) for n in values))

    def places(self, name: str = "place") -> DataFrame:
        """The rows with their number from 1 on."""
        return self.running_sums(**{name: F.lit(1)})

    def previous(self, **columns: str) -> DataFrame:
        """The rows with columns of the row before them, null for the first."""
        w = Window.partitionBy("_rg_range", *self.group).orderBy("_rg_place")
        inside = self.rows.withColumns({f"_rg_v_{n}": F.lag(c).over(w) for n, c in columns.items()} | {"_rg_first": F.row_number().over(w) == 1})
        last = {n: F.max_by(F.struct(F.col(c).alias("x")), F.col("_rg_place")) for n, c in columns.items()}
        out = self._joined(inside, self._carried(last, {n: F.last(f"_rg_c_{n}") for n in columns}))
        return out.select(*self.columns, *(F.when(F.col("_rg_first"), F.col(f"_rg_c_{n}.x")).otherwise(F.col(f"_rg_v_{n}")).alias(n) for n in columns))
