"""Selection by rank: the row at a position of a sorted table, without sorting the table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000  # about so many values of a column bracket a rank
FEW = 10_000  # so many rows are sorted in one heap


def _below(col: Column, value) -> Column:
    """Strictly before ``value`` in ascending order, nulls first."""
    return F.lit(False) if value is None else col.isNull() | (col < F.lit(value))


def _at(col: Column, value) -> Column:
    return col.isNull() if value is None else col.isNotNull() & (col == F.lit(value))


def _bracket(df: DataFrame, column: str, every: int, share: float) -> tuple:
    """Two values of the column that most likely enclose the given share of its rows.

    The sample takes a row in ``every`` by a hash of the row's order columns, so it is the same in every run; its size
    does not grow with the table.
    """
    drawn = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(every)) == 0) if every > 1 else df
    values = [r[0] for r in drawn.select(column).orderBy(column).collect()]
    if not values:
        return None, df.agg(F.max(column)).first()[0]
    # the rank of a sample is off by less than five deviations of it
    slack = 5 * (len(values) * share * (1 - share)) ** 0.5 + 2
    at = len(values) * share
    lo, hi = int(at - slack), int(at + slack)
    return (values[lo] if lo >= 0 else None), (values[hi] if hi < len(values) else df.agg(F.max(column)).first()[0])


def tuple_at_rank(df: DataFrame, order_by: list[str], rank: int) -> tuple | None:
    """Values of ``order_by`` in the row at ``rank`` (from 0) of the ascending order, nulls first; None behind the last row.

    One column after another is narrowed down: a bounded sample brackets the rank, rows before the bracket
    are only counted, and those inside are looked at again. Equal values are passed to the next column. Each round
    reads the rows inside, and cuts them some forty times until few are left.
    """
    rows = df.select(*order_by)
    total = rows.count()
    if not 0 <= rank < total:
        return None
    for column in order_by:
        col = F.col(column)
        while True:
            if total <= FEW:
                return tuple(rows.orderBy(*order_by).offset(rank).limit(1).first())
            lo, hi = _bracket(rows, column, -(-total // SAMPLE), rank / total)
            between = ~_below(col, lo) & ~_at(col, lo) & (_below(col, hi))
            parts: list[Callable | Column] = [_below(col, lo), _at(col, lo), between, _at(col, hi)]
            if lo == hi:
                parts = parts[:2]
            counts = rows.agg(*[F.count_if(part).alias(f"n{i}") for i, part in enumerate(parts)]).first()
            before = 0
            for i, n in enumerate(counts):
                if rank < before + n:
                    break
                before += n
            else:  # above the bracket
                i, n = len(parts), total - before
            picked = ~(_below(col, hi) | _at(col, hi)) if i == len(parts) else parts[i]
            rows, rank, total = rows.where(picked), rank - before, n
            if i in (1, 3):
                break  # one value of this column
    return tuple(rows.first())  # rows that are equal in all columns


def not_before(order_by: list[str], values: tuple) -> Column:
    """Rows at or behind ``values`` in the ascending order, nulls first."""
    tests = []
    for i, name in enumerate(order_by):
        same = [_at(F.col(c), v) for c, v in zip(order_by[:i], values)]
        after = ~_below(F.col(name), values[i]) & ~_at(F.col(name), values[i])
        tests.append(reduce(Column.__and__, [*same, after]))
    tests.append(reduce(Column.__and__, [_at(F.col(c), v) for c, v in zip(order_by, values)]))
    return reduce(Column.__or__, tests)
