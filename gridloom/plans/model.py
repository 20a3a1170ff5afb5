"""The model: a catalog on the driver over DataFrames of cells.

Formulas are checked when they are defined and lowered when they are read.  Everything a model holds is immutable DataFrames
and small Python values, so a fork is a copy of the catalog.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..functions.aggregates import aggregate
from ..operators.frames import Frame
from ..operators.lower import Lowering
from ..operators.scan import scan
from . import analyze, regions
from .analyze import bind, dense_nodes, edges, order, scan_dim
from .ast import Coalesce, Member, Node, Ref, Select, from_json, to_json
from .catalog import Dim, Metric, Prop, local
from .parser import parse
from .typecheck import Type, infer

# Parameters: written cells that a metric holds on the driver before they are merged into its table; default cell limit.
MOST_EDITS, MAX_CELLS = 10_000, 1_000_000_000
#: Updates of a kept table by regions before it is written anew.
PATCHES = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's; a local one only where both are unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "gridloom-shared")
    return found.rstrip("/")


class Conflict(ValueError):
    """A transaction expected cells that have changed since."""


class Model:
    def __init__(self, spark: SparkSession, exact: bool = True, max_cells: int | None = MAX_CELLS):
        self.spark, self.exact, self.max_cells = spark, exact, max_cells
        self.dims: dict[str, Dim] = {}
        self.metrics: dict[str, Metric] = {}
        self.props: dict[str, Prop] = {}
        self.warnings: dict[str, list[str]] = {}
        self.log: list[dict] = []  # what the open or last transaction did, in order
        self.outcomes: dict[str, int] = {}  # client_op_id: version
        self.version = 0
        self._frames: dict[str, Frame] = {}
        self._kept: dict[str, DataFrame] = {}
        self._stale: dict[str, regions.Box] = {}  # what edits may have changed in kept tables
        self._patched: dict[str, int] = {}
        self.refreshed: dict[str, tuple[regions.Box, DataFrame]] = {}  # a kept metric's last update: its region and the cells evaluated for it
        self._next = 0

    # ---------------------------------------------------------------- names

    @property
    def dim_ids(self) -> dict[str, str]:
        return {d.name: d.uid for d in self.dims.values()}

    @property
    def metric_ids(self) -> dict[str, str]:
        return {m.name: m.uid for m in self.metrics.values()}

    def _uid(self, kind: str) -> str:
        self._next += 1
        return f"{kind}{self._next}"

    def dim_named(self, name: str) -> Dim:
        uid = self.dim_ids.get(name)
        if uid is None:
            raise FormulaError("unknown_dim", name=name)
        return self.dims[uid]

    def metric_named(self, name: str) -> Metric:
        uid = self.metric_ids.get(name)
        if uid is None:
            raise FormulaError("unknown_metric", name=name)
        return self.metrics[uid]

    def _new_name(self, name: str) -> None:
        if name in self.dim_ids or name in self.metric_ids:
            raise ValueError(f"{name!r} is taken")

    def cut(self, df: DataFrame) -> DataFrame:
        """df written to the folder of spark.checkpoint.dir (a local one only where that is unset) and read again."""
        path = f"{shared_folder(self.spark)}/cells-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ---------------------------------------------------------------- definitions

    def add_dimension(self, name: str, members: Iterable[str] | DataFrame, ordered: bool = False) -> Dim:
        """members: names, or (for a large unordered dimension) a DataFrame of one column of unique keys."""
        self._new_name(name)
        dim = Dim(self._uid("d"), name, ordered)
        if isinstance(members, DataFrame):
            if ordered:
                raise ValueError("an ordered dimension is a list of members")
            key = members.columns[0]
            dim.table = members.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(key).alias("rank"))
        else:
            names = list(members)
            if len(set(names)) < len(names):
                raise ValueError(f"{name}: a member is repeated")
            dim.members = list(enumerate(names))
        self.dims[dim.uid] = dim
        self.log.append({"op": "add_dimension", "name": name, "members": None if dim.members is None else [n for _, n in dim.members], "ordered": ordered, "table": members if isinstance(members, DataFrame) else None})
        return dim

    def add_property(self, dim: str, prop: str, target: str, mapping: Mapping[Any, Any] | DataFrame, moved: regions.Box | None = None) -> Prop:
        """mapping: member names to member names, or a DataFrame (src, dst) of keys; members may be left out."""
        d, t = self.dim_named(dim), self.dim_named(target)
        if isinstance(mapping, DataFrame):
            table = mapping.select(F.col(mapping.columns[0]).alias("src"), F.col(mapping.columns[1]).alias("dst"))
        else:
            table = self.spark.createDataFrame([(d.key(a), t.key(b)) for a, b in mapping.items() if b is not None], f"src {d.key_type}, dst {t.key_type}")
        old = next((p for p in d.props.values() if p.name == prop), None)
        out = Prop(old.uid if old else self._uid("p"), prop, t.uid, table)
        d.props[out.uid] = self.props[out.uid] = out
        self._changed({out.uid: moved or {}})
        self.log.append({"op": "add_property", "dim": dim, "prop": prop, "target": target, "values": None if isinstance(mapping, DataFrame) else {str(a): b for a, b in mapping.items()}, "table": table if isinstance(mapping, DataFrame) else None})
        return out

    def set_property_values(self, dim: str, prop: str, values: Mapping[str, str | None]) -> None:
        d = self.dim_named(dim)
        p = next(p for p in d.props.values() if p.name == prop)
        t = self.dims[p.target]
        mine = self.spark.createDataFrame([(d.key(a), None if b is None else t.key(b)) for a, b in values.items()], f"src {d.key_type}, dst {t.key_type}")
        done, moved = len(self.log), {}
        if self._kept and len(values) <= regions.MOST:
            keys = frozenset(d.key(a) for a in values)
            old = {r[0] for r in p.table.where(F.col("src").isin(sorted(keys))).select("dst").distinct().collect()}
            moved = {"src": keys, "dst": frozenset(old | {t.key(b) for b in values.values() if b is not None})}
        self.add_property(dim, prop, t.name, p.table.join(F.broadcast(mine) if len(values) <= MOST_EDITS else mine, "src", "left_anti").union(mine.where("dst is not null")), moved)
        del self.log[done:]
        self.log.append({"op": "set_property_values", "dim": dim, "prop": prop, "values": dict(values)})

    def _kind(self, kind: str) -> str:
        return f"member:{self.dim_named(kind[7:]).uid}" if kind.startswith("member:") else kind

    def _shown_kind(self, kind: str) -> str:
        return f"member:{self.dims[kind[7:]].name}" if kind.startswith("member:") else kind

    def _by_name(self, m: Metric, df: DataFrame) -> DataFrame:
        """Cells with a column of keys for each dimension, under its name."""
        return df.select(*(F.col(u).alias(self.dims[u].name) for u in m.dims), "v")

    def v_type(self, kind: str) -> str:
        return {"number": "double", "boolean": "boolean"}.get(kind) or self.dims[kind[7:]].key_type

    def add_input(self, name: str, dims: Iterable[str], cells: Mapping[tuple, Any] | DataFrame | None = None, kind: str = "number", unique: bool = True) -> Metric:
        """cells: {member names: value}, or a DataFrame with a column of keys for each dimension (by name) and `v`."""
        uids = tuple(self.dim_named(d).uid for d in dims)
        if len(set(uids)) < len(uids):
            raise ValueError(f"{name}: a dimension is repeated")
        kind = self._kind(kind)
        schema = ", ".join([*(f"{u} {self.dims[u].key_type}" for u in uids), f"v {self.v_type(kind)}"])
        if isinstance(cells, DataFrame):
            base = cells.select(*(F.col(f"`{self.dims[u].name}`").cast(self.dims[u].key_type).alias(u) for u in uids), F.col("v").cast(self.v_type(kind)).alias("v"))
            base = base.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in base.columns)))
            if unique and not base.groupBy(*uids).count().where("count > 1").isEmpty():
                raise ValueError(f"{name}: a key is repeated")
        else:
            rows = [(*self._keys(uids, k if isinstance(k, tuple) else (k,)), self._value(name, kind, v)) for k, v in (cells or {}).items()]
            base = local(self.spark, rows, schema)
        old = self.metric_ids.get(name)
        if old is None:
            self._new_name(name)
        metric = Metric(old or self._uid("m"), name, uids, kind, base)
        self.metrics[metric.uid] = metric
        self._reset({metric.uid})
        self.log.append({"op": "add_input", "name": name, "dims": list(dims), "kind": self._shown_kind(kind), "cells": None if isinstance(cells, DataFrame) else [[list(k) if isinstance(k, tuple) else [k], v] for k, v in (cells or {}).items()], "table": self._by_name(metric, base) if isinstance(cells, DataFrame) else None})
        return metric

    def add_formula(self, name: str, dims: Iterable[str], formula: str | Node, kind: str = "number", overridable: bool = False) -> Metric:
        """A metric by formula; checked here: names, dimensions, kind, recursion, size."""
        uids, kind = tuple(self.dim_named(d).uid for d in dims), self._kind(kind)
        old = self.metric_ids.get(name)
        if old is None:
            self._new_name(name)
        before = dict(self.metrics)
        metric = Metric(old or self._uid("m"), name, uids, kind)
        self.metrics[metric.uid] = metric
        try:
            metric.formula = bind(parse(formula, name) if isinstance(formula, str) else formula, self)
            if overridable:
                hidden = Metric(self._uid("m"), f"__override__{name}", uids, kind, self.spark.createDataFrame([], ", ".join([*(f"{u} {self.dims[u].key_type}" for u in uids), f"v {self.v_type(kind)}"])))
                self.metrics[hidden.uid] = hidden
                metric.overrides = hidden.uid
            self._check(metric)
        except ValueError:
            self.metrics = before
            raise
        self._kept.pop(metric.uid, None)
        self._changed({metric.uid: {}})
        self.log.append({"op": "add_formula", "name": name, "dims": list(dims), "formula": formula if isinstance(formula, str) else to_json(formula), "kind": self._shown_kind(kind), "overridable": overridable})
        return metric

    def _check(self, metric: Metric) -> None:
        warned: list[str] = []
        t = infer(metric.formula, self, warned)
        names = lambda ds: [self.dims[d].name for d in ds]
        if set(t.dims) != set(metric.dims):
            raise FormulaError("formula_dims", metric=metric.name, dims=names(t.dims), declared=names(metric.dims))
        if t.kind != metric.kind:
            raise FormulaError("formula_kind", metric=metric.name, kind=t.kind, declared=metric.kind)
        formulas = {m.uid: m.formula for m in self.metrics.values() if m.formula is not None}
        group = next(g for g in order(formulas) if metric.uid in g)
        scan_dim(group, formulas, self)
        if self.max_cells is not None and (cells := dense_nodes(metric.formula, self)) > self.max_cells:
            raise FormulaError("too_many_cells", metric=metric.name, cells=cells, limit=self.max_cells)
        self.warnings[metric.name] = list(dict.fromkeys(warned))

    def remove_metric(self, name: str) -> None:
        uid = self.metric_named(name).uid
        users = [m.name for m in self.metrics.values() if m.formula is not None and m.uid != uid and any(t == uid for t, _, _ in edges(m.formula))]
        if users:
            raise ValueError(f"{name} is used by {', '.join(users)}")
        self._reset({uid})
        del self.metrics[uid]
        self.log.append({"op": "remove_metric", "name": name})

    def rename_metric(self, name: str, new: str) -> None:
        self._new_name(new)
        self.metric_named(name).name = new
        self.log.append({"op": "rename_metric", "name": name, "new": new})

    def rename_dimension(self, name: str, new: str) -> None:
        self._new_name(new)
        self.dim_named(name).name = new
        self.log.append({"op": "rename_dimension", "name": name, "new": new})

    def rename_property(self, dim: str, prop: str, new: str) -> None:
        next(p for p in self.dim_named(dim).props.values() if p.name == prop).name = new
        self.log.append({"op": "rename_property", "dim": dim, "prop": prop, "new": new})

    # ---------------------------------------------------------------- members

    def _listed(self, dim: str) -> Dim:
        d = self.dim_named(dim)
        if d.members is None:
            raise ValueError(f"{dim} is a table: change the table")
        return d

    def add_member(self, dim: str, member: str, at: int | None = None, properties: Mapping[str, str] | None = None) -> None:
        d = self._listed(dim)
        if any(n == member for _, n in d.members):
            raise ValueError(f"{dim} has {member!r}")
        if d.ordered and at is not None and at != len(d.members):
            raise ValueError(f"{dim} is ordered: a member is added at its end")
        d.members.insert(len(d.members) if at is None else at, (max((k for k, _ in d.members), default=-1) + 1, member))
        d.changed()
        done = len(self.log)
        for p, v in (properties or {}).items():
            self.set_property_values(dim, p, {member: v})
        del self.log[done:]
        self._changed({d.uid: {d.uid: frozenset({d.key(member)})}})
        self.log.append({"op": "add_member", "dim": dim, "member": member, "at": at, "properties": dict(properties or {})})

    def move_member(self, dim: str, member: str, at: int) -> None:
        """Changes the display rank only."""
        d = self._listed(dim)
        if d.ordered:
            raise ValueError(f"{dim} is ordered: its members don't move")
        d.members.insert(at, d.members.pop(next(i for i, (_, n) in enumerate(d.members) if n == member)))
        d.changed()
        self.log.append({"op": "move_member", "dim": dim, "member": member, "at": at})

    def rename_member(self, dim: str, member: str, new: str) -> None:
        d = self._listed(dim)
        if any(n == new for _, n in d.members):
            raise ValueError(f"{dim} has {new!r}")
        key = d.key(member)
        d.members = [(k, new if k == key else n) for k, n in d.members]
        d.changed()
        self.log.append({"op": "rename_member", "dim": dim, "member": member, "new": new})

    def remove_member(self, dim: str, member: str) -> None:
        """Blanks its cells and the member values that point at it; in an ordered dimension later members close up."""
        d = self._listed(dim)
        key = d.key(member)
        for m in self.metrics.values():
            if m.formula is not None and any((isinstance(n, (Member, Select)) and n.dim == d.uid and n.member == key) for n in m.formula.walk()):
                raise ValueError(f"{m.name} names {dim}.{member}")
        pointed = d.ordered or any(m.kind == f"member:{d.uid}" for m in self.metrics.values()) or any(p.target == d.uid for p in self.props.values())
        gone: dict[str, regions.Box] = {d.uid: {d.uid: frozenset({key})}}
        move = lambda c: F.when(c > key, c - 1).otherwise(c).cast("int") if d.ordered else c
        for m in self.metrics.values():
            if m.base is None or (d.uid not in m.dims and m.kind != f"member:{d.uid}"):
                continue
            df = self.input(m.uid)
            for c in [q for q in m.dims if q == d.uid] + ["v"] * (m.kind == f"member:{d.uid}"):
                df = df.where(F.col(c) != key).withColumn(c, move(F.col(c)))
            m.base, m.edits = df, {}
            gone[m.uid] = {d.uid: frozenset({key})}
        for p in self.props.values():
            if p.uid in d.props:
                gone[p.uid] = {"src": frozenset({key}), "dst": frozenset(r[0] for r in p.table.where(F.col("src") == key).select("dst").collect())}
                p.table = p.table.where(F.col("src") != key).withColumn("src", move(F.col("src")))
            if p.target == d.uid:
                p.table = p.table.where(F.col("dst") != key).withColumn("dst", move(F.col("dst")))
        if d.ordered:
            closed = lambda n: type(n)(n.child, n.dim, n.member - 1) if isinstance(n, Select) else Member(n.dim, n.member - 1)

            def fix(n: Node) -> Node:
                n = n.rebuilt(fix)
                return closed(n) if isinstance(n, (Member, Select)) and n.dim == d.uid and n.member > key else n

            for m in self.metrics.values():
                m.formula = None if m.formula is None else fix(m.formula)
        d.members = [(k - 1 if d.ordered and k > key else k, n) for k, n in d.members if k != key]
        d.changed()
        if pointed:  # keys or values elsewhere have moved
            self._frames.clear()
            self._kept.clear()
        else:
            self._changed(gone)
        self.log.append({"op": "remove_member", "dim": dim, "member": member})

    # ---------------------------------------------------------------- cells

    def _keys(self, uids: tuple[str, ...], names: tuple) -> tuple:
        if len(names) != len(uids):
            raise ValueError(f"{len(uids)} members are expected, not {names}")
        return tuple(self.dims[u].key(n) for u, n in zip(uids, names, strict=True))

    def _value(self, name: str, kind: str, value: Any) -> Any:
        if kind == "boolean":
            if not isinstance(value, bool):
                raise ValueError(f"{name} takes booleans, not {value!r}")
            return value
        if kind == "number":
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ValueError(f"{name} takes finite numbers, not {value!r}")
            return float(value)
        return self.dims[kind[7:]].key(value)

    def _target(self, name: str) -> Metric:
        m = self.metric_named(name)
        if m.formula is not None:
            if m.overrides is None:
                raise ValueError(f"{name} is a formula without overrides")
            return self.metrics[m.overrides]
        return m

    def set_cell(self, name: str, value: Any, **coords: Any) -> None:
        """Writes one cell (None: blank); for an overridable formula, its override."""
        m = self._target(name)
        by_name = {self.dims[u].name: u for u in m.dims}
        if set(coords) != set(by_name):
            raise ValueError(f"{name} has the dimensions {sorted(by_name)}")
        self.write_many(name, [(tuple(coords[self.dims[u].name] for u in m.dims), value)])

    def write_many(self, name: str, cells: Iterable[tuple[tuple, Any]] | DataFrame) -> None:
        """Writes cells by member names, the last write of a key wins; or a DataFrame of keys and `v` (null: blank) with unique keys."""
        m = self._target(name)
        if isinstance(cells, DataFrame):
            # large changes are a table of their own, which the record holds
            table = self.cut(cells.select(*(f"`{self.dims[u].name}`" for u in m.dims), "v"))
            self.log.append({"op": "write_table", "name": name, "table": table})
            edits = table.select(*(F.col(f"`{self.dims[u].name}`").cast(self.dims[u].key_type).alias(u) for u in m.dims), F.col("v").cast(self.v_type(m.kind)).alias("v"))
            box = {}
            if self._kept:
                for u in m.dims:
                    few = edits.select(u).distinct().limit(regions.MOST + 1).collect()
                    box |= {u: frozenset(r[0] for r in few)} if len(few) <= regions.MOST else {}
            now = self.input(m.uid)
            m.base, m.edits = self.cut(now.join(edits.select(*m.dims), list(m.dims), "left_anti").unionByName(edits.where("v is not null"))), {}
        else:
            written = []
            for names, value in cells:
                written.append(self._keys(m.dims, names))
                m.edits[written[-1]] = None if value is None else self._value(name, m.kind, value)
                self.log.append({"op": "set_cell", "name": name, "key": list(names), "value": value})
            if len(m.edits) > MOST_EDITS:
                m.base, m.edits = self.cut(self.input(m.uid)), {}
            if not written:
                return
            box = regions.box_of(m.dims, written)
        self._changed({m.uid: box})

    def input(self, uid: str) -> DataFrame:
        """Cells of an input with what was written since; written cells are few (MOST_EDITS), so their side is broadcast."""
        m = self.metrics[uid]
        if not m.edits:
            return m.base
        schema = ", ".join([*(f"{u} {self.dims[u].key_type}" for u in m.dims), f"v {self.v_type(m.kind)}"])
        edits = self.spark.createDataFrame([(*k, v) for k, v in m.edits.items()], schema)
        if not m.dims:
            return edits.where("v is not null")
        return m.base.join(F.broadcast(edits.select(*m.dims)), list(m.dims), "left_anti").unionByName(edits.where("v is not null"))

    def spread(self, name: str, total: float, coords: Mapping[str, Any] | None = None, how: str = "proportional", where: Mapping[str, Any] | None = None) -> int:
        """Spreads a total over the cells of a region: in the ratio of the values, evenly over the existing cells if their sum
        is 0 or how is 'even', or over all combinations if there are none.  where: {"Dim.Property": member}.  Returns the number of cells."""
        m = self.metric_named(name)
        if m.formula is not None or m.kind != "number":
            raise ValueError(f"{name}: only a number input can be spread over")
        if isinstance(total, bool) or not math.isfinite(total) or how not in ("proportional", "even"):
            raise ValueError(f"{name}: spread takes a finite total, proportionally or evenly")
        here = lambda df: self._region(df, m, coords or {}, where or {})
        region = here(self.input(m.uid))
        row = aggregate(region, [], "sum", True).collect()
        weight, n = (row[0]["v"], region.count()) if row else (0.0, 0)
        if n and not math.isfinite(weight):
            raise ValueError(f"{name}: the sum of the region isn't finite")
        if n and how == "proportional" and weight != 0:
            new = region.withColumn("v", F.lit(float(total)) * F.col("v") / F.lit(weight))
        else:
            if not n:
                region = here(Lowering(self).dense(m.dims).root.withColumn("v", F.lit(0.0)))
                n = region.count()
                if n == 0:
                    raise ValueError(f"{name}: the region has no cells")
                if self.max_cells is not None and n > self.max_cells:
                    raise FormulaError("too_many_cells", metric=name, cells=n, limit=self.max_cells)
            new = region.withColumn("v", F.lit(float(total)) / F.lit(n))
        new = self.cut(new.select(*m.dims, "v"))
        m.base, m.edits = self.cut(self.input(m.uid).join(new, list(m.dims), "left_anti").unionByName(new)), {}
        listed = lambda x: x if isinstance(x, (list, tuple, set)) else [x]
        self._changed({m.uid: {self.dim_named(d).uid: frozenset(self.dim_named(d).key(x) for x in listed(members)) for d, members in (coords or {}).items()}})
        self.log.append({"op": "spread", "name": name, "total": total, "coords": dict(coords or {}), "how": how, "where": dict(where or {}), "table": self._by_name(m, new)})
        return n

    def _region(self, df: DataFrame, m: Metric, coords: Mapping[str, Any], where: Mapping[str, Any] | None = None) -> DataFrame:
        for d, members in coords.items():
            dim = self.dim_named(d)
            if dim.uid not in m.dims:
                raise ValueError(f"{m.name} has no dimension {d}")
            df = df.where(F.col(dim.uid).isin([dim.key(x) for x in (members if isinstance(members, (list, tuple, set)) else [members])]))
        for path, value in (where or {}).items():
            d, _, p = path.partition(".")
            dim = self.dim_named(d)
            prop = next((q for q in dim.props.values() if q.name == p), None)
            if prop is None or dim.uid not in m.dims:
                raise ValueError(f"{path} is no property of a dimension of {m.name}")
            df = df.join(prop.table.where(F.col("dst") == F.lit(self.dims[prop.target].key(value))).select(F.col("src").alias(dim.uid)), dim.uid, "left_semi")
        return df

    # ---------------------------------------------------------------- evaluation

    def axis_frame(self, uid: str) -> DataFrame:
        return self.dims[uid].frame(self.spark).select(F.col("key").alias(uid))

    def empty(self, uid: str) -> Frame:
        m = self.metrics[uid]
        df = self.spark.createDataFrame([], ", ".join([*(f"{u} {self.dims[u].key_type}" for u in m.dims), f"v {self.v_type(m.kind)}"]))
        return Frame(df, m.dims, F.col("v"), m.kind)

    @contextmanager
    def standing(self, frames: dict[str, Frame]):
        """Reads some metrics from other frames for a while."""
        before = dict(self._frames)
        try:
            self._frames = {k: v for k, v in before.items() if k not in self._downstream(set(frames))} | frames
            yield
        finally:
            self._frames = before

    def formula_of(self, uid: str) -> Node:
        m = self.metrics[uid]
        return m.formula if m.overrides is None else Coalesce(Ref(m.overrides), m.formula)

    def frame(self, uid: str) -> Frame:
        if uid in self._frames:
            return self._frames[uid]
        m = self.metrics[uid]
        if uid in self._kept:
            if uid in self._stale:
                self._refresh(uid)
            self._frames[uid] = Frame(self._kept[uid], m.dims, F.col("v"), m.kind)
        else:
            self._frames[uid] = self._evaluated(uid)
        return self._frames[uid]

    def _evaluated(self, uid: str) -> Frame:
        """A metric's frame from what it is made of, whether it is kept or not."""
        m = self.metrics[uid]
        if m.formula is None:
            return Frame(self.input(uid), m.dims, F.col("v"), m.kind)
        formulas = {k: q.formula for k, q in self.metrics.items() if q.formula is not None}
        group = next(g for g in order(formulas) if uid in g)
        found = scan_dim(group, formulas, self)
        if found is None:
            return Lowering(self).formula(self.formula_of(uid), m.dims)
        got = scan(self, found[1], found[0])
        self._frames.update({k: f for k, f in got.items() if k not in self._kept})
        return got[uid]

    def _refresh(self, uid: str) -> None:
        """Evaluates the region of a kept metric that edits may have changed, and puts it in place of the old cells.

        The region's filter is part of the plan, so Catalyst reads, joins and aggregates only what it needs."""
        box = self._stale.pop(uid)
        fresh = self._evaluated(uid).cells()
        if not box:  # all of it
            self._kept[uid], self._patched[uid] = self.cut(fresh), 0
            self.refreshed[self.metrics[uid].name] = (box, self._kept[uid])
            return
        patch = self.cut(fresh.where(regions.inside(box)))
        self._kept[uid] = regions.replaced(self._kept[uid], box, patch)
        self._patched[uid] = self._patched.get(uid, 0) + 1
        if self._patched[uid] >= PATCHES:
            self._kept[uid], self._patched[uid] = self.cut(self._kept[uid]), 0
        self.refreshed[self.metrics[uid].name] = (box, patch)

    def keep(self, name: str) -> DataFrame:
        """Writes a formula's cells once; readers of it start from there.  After edits only the cells that they may have changed are evaluated again, when the metric is read."""
        uid = self.metric_named(name).uid
        self._kept[uid] = self.cut(self.frame(uid).cells())
        self._patched[uid] = 0
        for k in self._downstream({uid}):
            self._frames.pop(k, None)
        return self._kept[uid]

    def _downstream(self, changed: set[str]) -> set[str]:
        """Metrics that depend on any of the ids (metrics, properties, dimensions)."""
        out = set(changed)
        grew = True
        while grew:
            grew = False
            for m in self.metrics.values():
                if m.uid in out or m.formula is None:
                    continue
                uses = {t for t, _, _ in edges(m.formula)} | {m.overrides} | {getattr(n, "dim", None) for n in m.formula.walk()} | {getattr(n, "prop", None) for n in m.formula.walk()}
                if uses & out or set(m.dims) & out:
                    out.add(m.uid)
                    grew = True
        return out

    def _changed(self, boxes: dict[str, regions.Box]) -> None:
        """Notes what edits may have changed in kept metrics (boxes by id of metric, property or dimension)."""
        below = self._downstream(set(boxes))
        for uid in below:
            self._frames.pop(uid, None)
        if below & self._kept.keys():
            for uid, box in regions.spread_of(self, boxes).items():
                if uid in self._kept:
                    self._stale[uid] = regions.both(self._stale.get(uid), box)

    def _reset(self, ids: set[str]) -> None:
        """Drops what is kept of the metrics that depend on the ids."""
        for uid in self._downstream(ids):
            self._frames.pop(uid, None)
            self._kept.pop(uid, None)
            self._stale.pop(uid, None)

    def recalc(self) -> dict[str, DataFrame]:
        """Keeps all formula metrics, level by level (those of a level don't depend on each other); kept ones are brought up to date."""
        formulas = {k: m.formula for k, m in self.metrics.items() if m.formula is not None}
        for level in analyze.levels(formulas):
            for uid in level:
                if uid not in self._kept:
                    self.keep(self.metrics[uid].name)
                elif uid in self._stale:
                    self.frame(uid)
        return {self.metrics[u].name: self._kept[u] for u in formulas}

    # ---------------------------------------------------------------- reads

    def metric_type(self, name: str) -> Type:
        m = self.metric_named(name)
        return Type(tuple(self.dims[d].name for d in m.dims), m.kind)

    def cube(self, name: str, v: str = "v") -> DataFrame:
        """The cells of a metric: a column of keys for each dimension, under its name, and the value."""
        m = self.metric_named(name)
        return self.frame(m.uid).cells().select(*(F.col(u).alias(self.dims[u].name) for u in m.dims), F.col("v").alias(v))

    def value(self, name: str) -> dict[tuple, Any]:
        """All cells by member names; for small cubes."""
        m = self.metric_named(name)
        return self._labelled(m, self.frame(m.uid).cells().select(*m.dims, "v").collect())

    def _labelled(self, m: Metric, rows) -> dict[tuple, Any]:
        label = self.dims[m.kind[7:]].label if m.kind.startswith("member:") else lambda v: v
        return {tuple(self.dims[u].label(r[u]) for u in m.dims): label(r["v"]) for r in rows}

    def get(self, name: str, **coords: Any) -> Any:
        m = self.metric_named(name)
        if set(coords) != {self.dims[u].name for u in m.dims}:
            raise ValueError(f"{name} needs a member of each of its dimensions")
        try:
            found = self.slice(name, coords)
        except FormulaError:
            return None  # a removed member
        return next(iter(found.values()), None)

    def slice(self, name: str, coords: Mapping[str, Any]) -> dict[tuple, Any]:
        m = self.metric_named(name)
        return self._labelled(m, self._region(self.frame(m.uid).cells().select(*m.dims, "v"), m, coords).collect())

    def rows(self, name: str, coords: Mapping[str, Any] | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
        """A page of cells in the order of the dimensions' ranks, with member names, and the number of all."""
        m = self.metric_named(name)
        cells = self._region(self.frame(m.uid).cells().select(*m.dims, "v"), m, coords or {})
        df = self.with_names(cells, m.dims)
        page = df.orderBy(*(f"{u}_rank" for u in m.dims)).offset(offset).limit(limit)
        return page.select(*(F.col(f"{u}_name").alias(self.dims[u].name) for u in m.dims), "v"), cells.count()

    def with_names(self, df: DataFrame, dims: Iterable[str]) -> DataFrame:
        for u in dims:
            names = self.dims[u].frame(self.spark)
            df = df.join(names.select(F.col("key").alias(u), F.col("name").alias(f"{u}_name"), F.col("rank").alias(f"{u}_rank")), u)
        return df

    def summarize(self, name: str, keep: Iterable[str] = (), agg: str = "sum", coords: Mapping[str, Any] | None = None, v: str = "v") -> DataFrame:
        """Cells of a region aggregated to the kept dimensions; no rows without cells."""
        m = self.metric_named(name)
        if m.kind != "number" and agg != "count":
            raise FormulaError("need_kind", what=agg.upper(), want="number", got=m.kind)
        kept = [self.dim_named(d).uid for d in keep]
        out = aggregate(self._region(self.frame(m.uid).cells(), m, coords or {}), kept, agg, self.exact)
        return out.select(*(F.col(u).alias(self.dims[u].name) for u in kept), F.col("v").alias(v))

    def pivot(self, names: Iterable[str], keep: Iterable[str] = (), coords: Mapping[str, Any] | None = None, agg: str = "sum") -> DataFrame:
        """Several metrics in one table (metric, kept dimensions, value): dimensions and filters that a metric lacks are
        ignored for it, unknown metrics are skipped, metrics that aren't numbers are counted."""
        parts = []
        for d in (*keep, *(coords or {})):
            self.dim_named(d)
        for name in names:
            if name not in self.metric_ids:
                continue
            m = self.metric_named(name)
            own = {self.dims[u].name for u in m.dims}
            part = self.summarize(name, [d for d in keep if d in own], agg if m.kind == "number" else "count", {d: x for d, x in (coords or {}).items() if d in own}, "value")
            parts.append(part.withColumn("metric", F.lit(name)))
        if not parts:
            raise FormulaError("unknown_metric", name=", ".join(names))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def overrides(self, name: str, coords: Mapping[str, Any] | None = None) -> dict[tuple, Any]:
        m = self.metrics[self.metric_named(name).overrides]
        return self._labelled(m, self._region(self.frame(m.uid).cells(), m, coords or {}).collect())

    def diff(self, name: str, other: Model) -> DataFrame:
        """Cells that differ bit by bit from another version's: dimensions, old (other's), new."""
        m = self.metric_named(name)
        a, b = other.cube(name, "old"), self.cube(name, "new")
        dims = [self.dims[u].name for u in m.dims]
        both = a.join(b, dims, "full_outer") if dims else a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "full_outer").drop("_one")
        return both.where(~F.col("old").cast("string").eqNullSafe(F.col("new").cast("string")))

    def sql(self, text: str, max_cells: int | None = None) -> DataFrame:
        """Rows of a SELECT; with max_cells an error if there would be more cells (rows times columns)."""
        from .sqlread import run

        return run(self, text, max_cells)

    # ---------------------------------------------------------------- versions

    def fork(self) -> Model:
        out = Model(self.spark, self.exact, self.max_cells)
        out.dims = {k: d.copy() for k, d in self.dims.items()}
        out.metrics = {k: m.copy() for k, m in self.metrics.items()}
        out.props = {p.uid: Prop(p.uid, p.name, p.target, p.table) for p in self.props.values()}
        for d in out.dims.values():
            d.props = {k: out.props[k] for k in d.props}
        out.warnings, out.version, out.outcomes = dict(self.warnings), self.version, dict(self.outcomes)
        out._frames, out._kept, out._next = dict(self._frames), dict(self._kept), self._next
        out._stale, out._patched = dict(self._stale), dict(self._patched)
        return out

    @contextmanager
    def transaction(self, user: str | None = None, reason: str | None = None, client_op_id: str | None = None, expect: Mapping[tuple[str, tuple], Any] | None = None, journal=None):
        """All or nothing.  client_op_id: a repeated one changes nothing.  expect: {(metric, member names): value} that must still hold.
        journal: gets the record before the new version stands."""
        if client_op_id is not None and client_op_id in self.outcomes:
            yield self.fork()  # what is done to it is dropped
            return
        for (name, names), value in (expect or {}).items():
            dims = [self.dims[u].name for u in self.metric_named(name).dims]
            if self.get(name, **dict(zip(dims, names, strict=True))) != value:
                raise Conflict(f"{name}{list(names)} has changed")
        work = self.fork()
        work.log = []
        yield work
        work.version += 1
        if client_op_id is not None:
            work.outcomes[client_op_id] = work.version
        if journal is not None:
            journal.append(work.version, [self._with_old(op) for op in work.log], user, reason, client_op_id)
        self.__dict__.update(work.__dict__)

    def _with_old(self, op: Mapping[str, Any]) -> dict[str, Any]:
        """An operation on cells with what stood there before the transaction (None or null: blank)."""
        if op["op"] not in ("set_cell", "write_table", "spread") or op["name"] not in self.metric_ids:
            return dict(op)
        m = self._target(op["name"])
        if op["op"] == "set_cell":
            try:
                keys = self._keys(m.dims, tuple(op["key"]))
            except FormulaError:  # a member of this transaction
                return dict(op, old=None)
            row = self.input(m.uid).where(reduce(Column.__and__, (F.col(u) == k for u, k in zip(m.dims, keys, strict=True)), F.lit(True))).head()
            label = self.dims[m.kind[7:]].label if m.kind.startswith("member:") else lambda v: v
            return dict(op, old=None if row is None else label(row["v"]))
        names = [self.dims[u].name for u in m.dims]
        before = self._by_name(m, self.input(m.uid)).withColumnRenamed("v", "_old")
        return dict(op, table=op["table"].join(before, names, "left") if names else op["table"].crossJoin(before))

    def apply(self, ops: Iterable[Mapping[str, Any]]) -> None:
        """Does what a journal record holds; tables are DataFrames, or the folders that hold them."""
        for op in ops:
            a = dict(op)
            table = a.pop("table", None)
            table = self.spark.read.parquet(table["parquet"]) if isinstance(table, dict) else table
            match a.pop("op"):
                case "set_cell":
                    self.write_many(a["name"], [(tuple(a["key"]), a["value"])])
                case "write_table":
                    self.write_many(a["name"], table.drop("_old"))
                case "add_dimension":
                    self.add_dimension(a["name"], a["members"] if table is None else table, a["ordered"])
                case "add_input":
                    self.add_input(a["name"], a["dims"], {tuple(k): v for k, v in a["cells"] or []} if table is None else table, a["kind"], unique=False)
                case "add_formula":
                    self.add_formula(a["name"], a["dims"], a["formula"] if isinstance(a["formula"], str) else from_json(a["formula"]), a["kind"], a["overridable"])
                case "add_property":
                    self.add_property(a["dim"], a["prop"], a["target"], a["values"] if table is None else table)
                case what:
                    getattr(self, what)(**a)

    def all_members(self, dims: Iterable[str]) -> list[tuple]:
        return list(product(*([n for _, n in self.dim_named(d).members] for d in dims)))


