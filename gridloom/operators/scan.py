"""Recursive metrics: folds along an ordered dimension.

Every subtree without recursion is an operand, lowered as usual.  If what remains is element-wise, the operands are
collected to one row per key without the time dimension (an array of periods, whose length is the dimension's size) and all
rows of a batch are folded together, period by period, in numpy.  PREVIOUS + X alone is a running sum by a window.
Otherwise (an aggregation or lookup inside the recursion) periods are lowered one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.analyze import edges
from ..plans.ast import Bin, Coalesce, Const, Expand, Filter, If, IfBlank, IsBlank, Node, Not, On, Ref, Shift
from ..plans.typecheck import COMPARE, infer
from .frames import Frame, Scalar
from .lower import Lowering

ELEMENTWISE = (Bin, Not, If, Coalesce, IfBlank, IsBlank, Filter, On, Expand)


def recursive(node: Node, group: set[str]) -> bool:
    return any(t in group for t, _, _ in edges(node))


def split(node: Node, group: set[str], operands: list[Node]) -> Node | None:
    """The tree with operands as Ref('#k'); None if recursion passes a node that isn't element-wise."""
    if not recursive(node, group):
        if isinstance(node, Const):
            return node
        if node not in operands:
            operands.append(node)
        return Ref(f"#{operands.index(node)}")
    if isinstance(node, Ref) or (isinstance(node, Shift) and isinstance(node.child, Ref)):
        return node
    if not isinstance(node, ELEMENTWISE):
        return None
    if isinstance(node, (Expand, On)):
        return None
    parts = [split(c, group, operands) for c in node.children()]
    if any(p is None for p in parts):
        return None
    it = iter(parts)
    return node.rebuilt(lambda _: next(it))


def fold(trees: dict[str, Node], names: list[str], periods: int, operands: list[np.ndarray], there: list[np.ndarray], kinds: dict[str, str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values and presence (rows x periods) of each metric, evaluated for all rows at once, period by period."""
    rows = operands[0].shape[0] if operands else 0
    out = {m: (np.zeros((rows, periods)), np.zeros((rows, periods), bool)) for m in names}

    def value(n: Node, t: int) -> tuple[np.ndarray, np.ndarray]:
        match n:
            case Const(v):
                return np.full(rows, float(v)), np.ones(rows, bool)
            case Ref(m) if m.startswith("#"):
                k = int(m[1:])
                return operands[k][:, t], there[k][:, t]
            case Ref(m):
                return out[m][0][:, t], out[m][1][:, t]
            case Shift(Ref(m), _, k):
                return (out[m][0][:, t + k], out[m][1][:, t + k]) if t + k >= 0 else (np.zeros(rows), np.zeros(rows, bool))
            case Bin(op, a, b):
                (x, px), (y, py) = value(a, t), value(b, t)
                with np.errstate(all="ignore"):
                    if op == "*":
                        return x * y, px & py
                    if op == "/":
                        return x / np.where(y == 0, 1, y), px & py & (y != 0)
                    if op in COMPARE:
                        f = {"=": np.equal, "<>": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}[op]
                        return f(x, y).astype(float), px & py
                    if op == "AND":
                        no = (px & (x == 0)) | (py & (y == 0))
                        return np.where(no, 0.0, 1.0), no | (px & py)
                    if op == "OR":
                        yes = (px & (x != 0)) | (py & (y != 0))
                        return np.where(yes, 1.0, 0.0), yes | (px & py)
                    x, y = np.where(px, x, 0.0), np.where(py, y, 0.0)
                    return x + y if op == "+" else x - y, px | py
            case Not(a):
                x, p = value(a, t)
                return 1.0 - x, p
            case If(c, a, b):
                (x, p), (y, q) = value(c, t), value(a, t)
                z, r = value(b, t) if b is not None else (np.zeros(rows), np.zeros(rows, bool))
                yes = p & (x != 0)
                return np.where(yes, y, z), np.where(yes, q, r) & p
            case Filter(a, c):
                (x, p), (y, q) = value(a, t), value(c, t)
                return x, p & q & (y != 0)
            case Coalesce(a, b):
                (x, p), (y, q) = value(a, t), value(b, t)
                return np.where(p, x, y), p | q
            case IfBlank(a, b):
                (x, p), (y, _) = value(a, t), value(b, t)
                return np.where(p, x, y), np.ones(rows, bool)
            case IsBlank(a):
                _, p = value(a, t)
                return (~p).astype(float), np.ones(rows, bool)
        raise TypeError(type(n).__name__)

    for t in range(periods):
        for m in names:
            x, p = value(trees[m], t)
            out[m][0][:, t], out[m][1][:, t] = np.where(p, x, 0.0), p
    return out


def scan(model, group: list[str], dim: str) -> dict[str, Frame]:
    """The frames of a recursive group, in its order within a period."""
    formulas = {m: model.metrics[m].formula for m in group}
    operands: list[Node] = []
    trees = {m: split(model.formula_of(m), set(group), operands) for m in group}
    low, periods = Lowering(model), model.dims[dim].size
    if len(group) == 1 and model.metrics[group[0]].overrides is None:
        quick = running_sum(low, group[0], formulas[group[0]], dim)
        if quick is not None:
            return {group[0]: quick}
    same_rows = len({frozenset(model.metrics[m].dims) for m in group}) == 1
    if any(t is None for t in trees.values()) or not same_rows or any(model.metrics[m].kind.startswith("member:") for m in group):
        return by_period(low, group, dim)
    row = tuple(d for d in model.metrics[group[0]].dims if d != dim)
    types = [infer(o, model, []) for o in operands]
    whole = [k for k, t in enumerate(types) if set(row) <= set(t.dims)]
    # rows that can have a cell: those of operands at full grain, or all of them if a narrower one may add cells
    narrow_adds = any(isinstance(n, (Bin, IfBlank, IsBlank)) and (not isinstance(n, Bin) or n.op in ("+", "-", "AND", "OR")) and any(isinstance(c, Const) or (isinstance(c, Ref) and c.name.startswith("#") and not types[int(c.name[1:])].dims) for c in n.children()) for t in trees.values() for n in t.walk())
    frames = [low.frame(low.lower(o)) for o in operands]
    if (narrow_adds or not whole) and row:
        keys = low.dense(row).root
    elif row:
        keys = reduce(DataFrame.unionByName, (frames[k].cells().select(*row) for k in whole)).distinct()
    else:
        keys = model.spark.range(1).select(F.lit(1).alias("_one"))
    table = keys
    for k, (f, t) in enumerate(zip(frames, types, strict=True)):
        own = [d for d in row if d in t.dims]
        cells = f.cells("x").withColumn("x", F.col("x").cast("double"))
        at = F.col(dim) if dim in t.dims else F.lit(-1)
        cells = cells.select(*own, F.struct(at.cast("int").alias("t"), F.col("x")).alias("e")).groupBy(*own).agg(F.collect_list("e").alias(f"o{k}"))
        # an aggregation without keys is one row, also of no cells
        table = table.join(cells, own, "left") if own else table.crossJoin(F.broadcast(cells))
    kinds = {m: model.metrics[m].kind for m in group}
    n = len(operands)
    schema = ", ".join([*(f"{d} {model.dims[d].key_type}" for d in row), f"{dim} int", *(f"{m} double" for m in group)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 2048) for i in range(0, len(big), 2048)):
                rows = len(b)
                values, there = [np.zeros((rows, periods)) for _ in range(n)], [np.zeros((rows, periods), bool) for _ in range(n)]
                for k in range(n):
                    lists = b.column(f"o{k}")
                    owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                    time, x = (np.asarray(c) for c in lists.flatten().flatten())
                    whole = time < 0  # a cell without the dimension holds for all periods
                    values[k][owner[whole]], there[k][owner[whole]] = x[whole][:, None], True
                    values[k][owner[~whole], time[~whole]], there[k][owner[~whole], time[~whole]] = x[~whole], True
                got = fold(trees, group, periods, values, there, kinds)
                r, t = np.nonzero(reduce(np.logical_or, (p for _, p in got.values())))
                cols = [b.column(d).take(pa.array(r)) for d in row] + [pa.array(t.astype(np.int32))]
                cols += [pa.array(got[m][0][r, t], mask=~got[m][1][r, t]) for m in group]
                yield pa.RecordBatch.from_arrays(cols, [*row, dim, *group])

    root = table.mapInArrow(run, schema)
    return {m: Frame(root, model.metrics[m].dims, F.col(m) != 0 if kinds[m] == "boolean" else F.col(m), kinds[m]) for m in group}


def running_sum(low: Lowering, metric: str, formula: Node, dim: str) -> Frame | None:
    """PREVIOUS(dim) + X, X not recursive and of the same dimensions."""
    model = low.model
    match formula:
        case Bin("+", Shift(Ref(m), d, -1), x) | Bin("+", x, Shift(Ref(m), d, -1)) if m == metric and d == dim and not recursive(x, {metric}):
            pass
        case _:
            return None
    dims = model.metrics[metric].dims
    x = low.lower(x)
    if isinstance(x, Scalar) or set(x.dims) != set(dims):
        return None
    row = [d for d in dims if d != dim]
    cells = x.cells()
    rows = cells.select(*row).distinct() if row else model.spark.range(1).select(F.lit(1).alias("_one"))
    grid = rows.crossJoin(model.axis_frame(dim)).join(cells, list(dims), "left")
    over = Window.partitionBy(*(row or ["_one"])).orderBy(dim).rowsBetween(Window.unboundedPreceding, 0)
    return Frame(grid.select(*dims, F.sum("v").over(over).alias("v")), dims, F.col("v"), "number")


def by_period(low: Lowering, group: list[str], dim: str) -> dict[str, Frame]:
    """Periods one after another.  Each period's cells are written once, and later periods read the pieces."""
    model = low.model
    done: dict[str, list[DataFrame]] = {m: [model.empty(m).cells().select(*model.metrics[m].dims, "v")] for m in group}
    whole = lambda m: Frame(reduce(DataFrame.unionByName, done[m]), model.metrics[m].dims, F.col("v"), model.metrics[m].kind)
    for t in range(model.dims[dim].size):
        for m in group:
            metric = model.metrics[m]
            with model.standing({g: whole(g) for g in group}):
                f = Lowering(model).formula(model.formula_of(m), metric.dims)
            done[m].append(model.cut(f.cells().where(F.col(dim) == t).select(*metric.dims, "v")))
    return {m: whole(m) for m in group}
