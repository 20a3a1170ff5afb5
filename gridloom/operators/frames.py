"""Lowered values.

A Frame is a DataFrame (the root: key columns named by dimension ids, unique) and a column expression over it; a null is a
blank.  Values over one root combine as expressions, so chains of element-wise operators are one projection and no join.
A Scalar is a column without a DataFrame.  Blank cells are left out only where a DataFrame of cells is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_fresh = count()


def fresh(prefix: str = "v") -> str:
    return f"_{prefix}{next(_fresh)}"


@dataclass(frozen=True)
class Scalar:
    v: Column
    kind: str
    dims: tuple[str, ...] = ()


@dataclass(frozen=True)
class Frame:
    root: DataFrame
    dims: tuple[str, ...]
    v: Column
    kind: str

    def cells(self, name: str = "v") -> DataFrame:
        """Key columns and the value; blanks are gone."""
        return self.root.select(*self.dims, self.v.alias(name)).where(F.col(name).isNotNull())

    def with_v(self, v: Column, kind: str | None = None) -> Frame:
        return Frame(self.root, self.dims, v, kind or self.kind)

    def kept(self) -> tuple[DataFrame, str]:
        """The cells under a column name of their own, for joins."""
        name = fresh()
        return self.cells(name), name


def inner(a: Frame, b: Frame, fn, kind: str) -> Frame:
    """fn of both values where both have a cell; dimensions that one side lacks are filled from the other."""
    dims = tuple(dict.fromkeys(a.dims + b.dims))
    if a.root is b.root:
        return Frame(a.root, a.dims, F.when(a.v.isNotNull() & b.v.isNotNull(), fn(a.v, b.v)), kind)
    (da, va), (db, vb) = a.kept(), b.kept()
    shared = [d for d in a.dims if d in b.dims]
    # without shared dimensions the result is all pairs by definition (a 0-dimensional side has one row)
    root = da.join(db, shared) if shared else da.crossJoin(db)
    return Frame(root, dims, fn(F.col(va), F.col(vb)), kind)


def outer(a: Frame, b: Frame, fn, kind: str) -> Frame:
    """fn of both values (null where blank) where either has a cell; same dimensions."""
    if a.root is b.root:
        return Frame(a.root, a.dims, F.when(a.v.isNotNull() | b.v.isNotNull(), fn(a.v, b.v)), kind)
    (da, va), (db, vb) = a.kept(), b.kept()
    if not a.dims:
        root = da.withColumn("_one", F.lit(1)).join(db.withColumn("_one", F.lit(1)), "_one", "full_outer")
    else:
        root = da.join(db, list(a.dims), "full_outer")
    return Frame(root, a.dims, fn(F.col(va), F.col(vb)), kind)


def left(a: Frame, b: Frame) -> tuple[DataFrame, Column, Column]:
    """a's root with b's value beside it (b's dimensions are among a's); the columns of both."""
    if a.root is b.root:
        return a.root, a.v, b.v
    (da, va), (db, vb) = a.kept(), b.kept()
    shared = list(b.dims)
    root = da.join(db, shared, "left") if shared else da.withColumn("_one", F.lit(1)).join(db.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return root, F.col(va), F.col(vb)
