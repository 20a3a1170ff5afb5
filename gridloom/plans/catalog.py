"""Dimensions, properties and metrics.

A dimension's members have an immutable key (what cubes hold), a name and a display rank.  Small dimensions are lists on the
driver with int keys (for an ordered one the key is the position); large ones are tables whose key is a column of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormulaError
from .ast import Node


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows of the driver as a relation of the plan, through Arrow: an RDD of Python objects would start a Python worker for each task that reads it."""
    names, kinds = zip(*(c.rsplit(" ", 1) for c in schema.split(", ")), strict=True)
    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    if not rows or any(k not in types for k in kinds):
        return spark.createDataFrame(rows, schema)
    table = pa.table({n: pa.array([r[i] for r in rows], types[k]) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})
    return spark.createDataFrame(table, schema)


@dataclass
class Prop:
    uid: str
    name: str
    target: str
    table: DataFrame  # src, dst


@dataclass
class Dim:
    uid: str
    name: str
    ordered: bool
    members: list[tuple[int, str]] | None = None  # in order of rank
    table: DataFrame | None = None  # key, name, rank
    props: dict[str, Prop] = field(default_factory=dict)
    _frame: Any = None
    _size: int | None = None

    @property
    def size(self) -> int:
        if self.members is not None:
            return len(self.members)
        if self._size is None:
            self._size = self.table.count()
        return self._size

    @property
    def key_type(self) -> str:
        return "int" if self.members is not None else dict(self.table.dtypes)["key"]

    def frame(self, spark: SparkSession) -> DataFrame:
        """key, name, rank."""
        if self.table is not None:
            return self.table
        if self._frame is None:
            rows = [(k, n, r) for r, (k, n) in enumerate(self.members)]
            self._frame = local(spark, rows, "key int, name string, rank int")
        return self._frame

    def key(self, name: Any) -> Any:
        """The key of a member's name."""
        if self.members is not None:
            for k, n in self.members:
                if n == name:
                    return k
        else:
            row = self.table.where(F.col("name").cast("string") == str(name)).select("key").head()
            if row is not None:
                return row[0]
        raise FormulaError("unknown_member", dim=self.name, member=name)

    def label(self, key: Any) -> Any:
        return dict(self.members).get(key) if self.members is not None else key

    def changed(self) -> None:
        self._frame = None

    def copy(self) -> Dim:
        return Dim(self.uid, self.name, self.ordered, None if self.members is None else list(self.members), self.table, dict(self.props), self._frame, self._size)


@dataclass
class Metric:
    uid: str
    name: str
    dims: tuple[str, ...]
    kind: str  # number, boolean or member:<dimension uid>
    base: DataFrame | None = None  # input: key columns named by dimension uid, v
    edits: dict[tuple, Any] = field(default_factory=dict)  # written cells; None is blank
    formula: Node | None = None
    overrides: str | None = None  # uid of the hidden input of an overridable formula

    def copy(self) -> Metric:
        return Metric(self.uid, self.name, self.dims, self.kind, self.base, dict(self.edits), self.formula, self.overrides)
