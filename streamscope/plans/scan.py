"""Running values along an order, per key, that survive one key holding most of the rows.

There is one plan at every size. A key's order is cut into slices by a fixed rule on its leading
column (so many whole numbers, or so much time). Each (key, slice) is summarised by a map-side
combined aggregation, the summaries are scanned along the slices, and what is carried into a slice
enters it as one extra row before the others. So a window over (key, slice), one shuffle and one
sort, gives every running value, and no task holds more of a key than a slice.

Nothing is counted or sampled first. Only a value that needs another running value has the rows
settled in the shared folder in between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .durable import cut

#: Width of a slice: whole numbers, or seconds of a time column.
SLICE_NUMBERS = 1 << 13
SLICE_SECONDS = 3600

@dataclass(frozen=True)
class Running:
    kind: str
    expr: Column
    exclusive: bool = False


def running_sum(expr: Column, exclusive: bool = False) -> Running:
    return Running("sum", expr, exclusive)


def running_count(exclusive: bool = False) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), exclusive)


def running_max(expr: Column, exclusive: bool = False) -> Running:
    return Running("max", expr, exclusive)


def running_min(expr: Column, exclusive: bool = False) -> Running:
    return Running("min", expr, exclusive)


def last_value(expr: Column, exclusive: bool = False) -> Running:
    """The latest non-null value up to this row."""
    return Running("last", expr, exclusive)


def first_value(expr: Column) -> Running:
    """The earliest non-null value up to this row."""
    return Running("first", expr)


def previous(expr: Column) -> Running:
    """The value on the row before, null included."""
    return Running("prev", expr, True)


def total_of(aggregate: str, expr: Column) -> Running:
    """One aggregate (sum, max, min, count) over the whole key, on every row."""
    return Running(f"total:{aggregate}", expr)


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def slice_of(df: DataFrame, column: str, width: int | None) -> Column:
    """The slice of the leading order column, which is a number, a date or a time."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(column) / (width or 1))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.unix_seconds(F.col(column).cast("timestamp"))
        return F.floor(seconds / (width or SLICE_SECONDS))
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(column) / (width or SLICE_NUMBERS)).cast("bigint")
    raise TypeError(f"{column} has no order that can be sliced: {kind.simpleString()}")


class OrderedScan:
    """Rows of ``df`` per ``keys`` in the order of ``order`` (all columns, one direction).

    Rows equal in all of ``order`` come in any order among themselves. Rows of equal leading order
    share a slice. Nulls come first, last in descending order. ``width`` is that of a slice, in
    whole numbers, days or seconds.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str] | str,
        order: list[str] | str,
        descending: bool = False,
        width: int | None = None,
    ):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)
        self.descending = descending
        self.width = width
        self.df = df
        self._settled = True

    def select(self, **columns: Column) -> OrderedScan:
        """Row-wise columns from earlier running values."""
        self.df = self.df.withColumns(columns)
        return self

    def add(self, **running: Running) -> OrderedScan:
        """Running values; those of one call share the shuffle and the sort."""
        columns = self.df.columns
        # A later value depends on these: read them from a settled table, not by repeating the scan.
        source = self.df if self._settled else cut(self.df)
        self._settled = False
        sliced = source.withColumn("__slice", slice_of(source, self.order[0], self.width))
        at = [*self.keys, "__slice"]
        summaries = sliced.groupBy(*at).agg(
            *[self._summary(r).alias(f"__s_{n}") for n, r in running.items()]
        )
        carried = summaries.select(
            *at,
            F.lit(0).alias("__row"),
            *[self._carry(r, f"__s_{n}").alias(f"__c_{n}") for n, r in running.items()],
        )
        both = sliced.withColumn("__row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
        done = both.withColumns({n: self._complete(n, r) for n, r in running.items()})
        kept = [c for c in columns if c not in running]
        self.df = done.filter("__row = 1").select(*kept, *running)
        return self

    def _sorted(self, *columns: str) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in columns]

    def _summary(self, r: Running) -> Column:
        """What a slice hands on."""
        position = F.struct(*self.order)
        newest, oldest = (F.min_by, F.max_by) if self.descending else (F.max_by, F.min_by)
        if r.kind == "prev":
            return newest(F.struct(r.expr.alias("v")), position)
        if r.kind == "last":
            return newest(r.expr, F.when(r.expr.isNotNull(), position))
        if r.kind == "first":
            return oldest(r.expr, F.when(r.expr.isNotNull(), position))
        return _AGGREGATES[r.kind.removeprefix("total:")](r.expr)

    def _carry(self, r: Running, column: str) -> Column:
        """What all slices before hand on, or for totals all slices."""
        per_key = W.partitionBy(*self.keys)
        if r.kind.startswith("total:"):
            combine = F.sum if r.kind in ("total:sum", "total:count") else _AGGREGATES[r.kind[6:]]
            return combine(column).over(per_key)
        before = per_key.orderBy(*self._sorted("__slice")).rowsBetween(W.unboundedPreceding, -1)
        if r.kind in ("prev", "last"):
            return F.last(column, ignorenulls=True).over(before)
        if r.kind == "first":
            return F.first(column, ignorenulls=True).over(before)
        return _AGGREGATES[r.kind](column).over(before)

    def _complete(self, name: str, r: Running) -> Column:
        """The value on each row, the carried row being the slice's first."""
        carry, here = F.col(f"__c_{name}"), F.col("__row") == 0
        slice_ = W.partitionBy(*self.keys, "__slice")
        ordered = slice_.orderBy("__row", *self._sorted(*self.order))
        frame = ordered.rowsBetween(W.unboundedPreceding, -1 if r.exclusive else 0)
        if r.kind.startswith("total:"):
            return F.max(F.when(here, carry)).over(slice_)
        if r.kind == "prev":
            own = F.struct(r.expr.alias("v"))
            return F.lag(F.when(here, carry).otherwise(own), 1).over(ordered)["v"]
        value = F.when(here, carry).otherwise(r.expr)
        if r.kind == "last":
            return F.last(value, ignorenulls=True).over(frame)
        if r.kind == "first":
            return F.first(value, ignorenulls=True).over(frame)
        total = _AGGREGATES[r.kind](value).over(frame)
        return F.coalesce(total, F.lit(0)) if r.kind == "sum" and r.exclusive else total
