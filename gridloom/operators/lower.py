"""Bound formula trees to Frames: one function for each family of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..plans.typecheck import COMPARE, by_metric, infer, union
from ..plans.ast import AsAxis, Bin, By, Coalesce, Const, DimRef, Expand, Filter, If, IfBlank, IsBlank, Member, Node, Not, On, Ref, Remove, Select, Shift
from .frames import Frame, Scalar, fresh, inner, left, outer


def number_op(op: str, a: Column, b: Column) -> Column:
    """Both sides have a value."""
    return {"*": lambda: a * b, "/": lambda: F.when(b != 0, a / F.when(b != 0, b)), "+": lambda: a + b, "-": lambda: a - b}[op]()


def compare_op(op: str, a: Column, b: Column, kind: str) -> Column:
    """IEEE rules for NaN on numbers: equal and ordered comparisons with it are false."""
    out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if kind != "number":
        return out
    nan = F.isnan(a) | F.isnan(b)
    return out | nan if op == "<>" else out & ~nan


def union_op(op: str, a: Column, b: Column) -> Column:
    """At least one side has a value."""
    if op == "AND":
        return a & b
    if op == "OR":
        return a | b
    zero = F.lit(0.0)
    return number_op(op, F.coalesce(a, zero), F.coalesce(b, zero))


class Lowering:
    def __init__(self, model):
        self.model, self.spark = model, model.spark

    # ---- leaves

    def lower(self, node: Node) -> Frame | Scalar:
        match node:
            case Ref(m):
                return self.model.frame(m)
            case Const(v):
                return Scalar(F.lit(v), "boolean" if isinstance(v, bool) else "number")
            case Member(d, m):
                return Scalar(F.lit(m).cast(self.model.dims[d].key_type), f"member:{d}")
            case DimRef(d):
                return self.axis(d)
            case Bin():
                return self.binary(node)
            case Not(x):
                t = self.lower(x)
                return Scalar(~t.v, t.kind) if isinstance(t, Scalar) else t.with_v(~t.v)
            case If():
                return self.choose(node)
            case Filter(x, c):
                return self.filtered(self.lower(x), self.lower(c))
            case IfBlank(x, d):
                t, default = self.lower(x), self.lower(d)
                if isinstance(t, Scalar):
                    return t
                root, _, v = left(self.dense(t.dims), t)
                return Frame(root, t.dims, F.coalesce(v, default.v), t.kind)
            case IsBlank(x):
                t = self.lower(x)
                if isinstance(t, Scalar):
                    return Scalar(F.lit(False), "boolean")
                root, _, v = left(self.dense(t.dims), t)
                return Frame(root, t.dims, v.isNull(), "boolean")
            case Expand(x, dims):
                return self.expanded(self.lower(x), tuple(dims))
            case On(x, y):
                a, b = self.lower(x), self.lower(y)
                if isinstance(b, Scalar):
                    return a
                return inner(self.frame(a), b, lambda v, _: v, a.kind)
            case Coalesce(a, b):
                fa, fb = self.frame(self.lower(a)), self.lower(b)
                if isinstance(fb, Scalar):
                    fb = self.spread(fb, fa.dims)
                return outer(fa, fb, lambda v, w: F.coalesce(v, w), fb.kind)
            case By():
                return self.by(node)
            case Remove():
                return self.removed(node)
            case Select(x, d, m):
                t = self.frame(self.lower(x))
                name = fresh()
                root = t.root.where(F.col(d) == F.lit(m)).select(*(q for q in t.dims if q != d), t.v.alias(name))
                return Frame(root, tuple(q for q in t.dims if q != d), F.col(name), t.kind)
            case Shift(x, d, n):
                return self.shifted(self.frame(self.lower(x)), d, n)
            case AsAxis(x, d):
                t = self.lower(x)
                root = t.cells("_to").withColumnRenamed("_to", d) if d not in t.dims else t.cells("_to").where(F.col("_to") == F.col(d)).drop("_to")
                return Frame(root, union(t.dims, (d,)), F.lit(1.0), "number")
        raise TypeError(type(node).__name__)

    def axis(self, d: str) -> Frame:
        """A dimension as a cube of its own members."""
        return Frame(self.model.axis_frame(d), (d,), F.col(d), f"member:{d}")

    def dense(self, dims: tuple[str, ...]) -> Frame:
        """All combinations of members (asked for by the formula, bounded by the model's cell limit)."""
        if not dims:
            return Frame(self.spark.range(1).select(F.lit(1).alias("_one")), (), F.lit(1.0), "number")
        root = reduce(DataFrame.crossJoin, (self.model.axis_frame(d) for d in dims))
        return Frame(root, dims, F.lit(1.0), "number")

    def frame(self, t: Frame | Scalar) -> Frame:
        return t if isinstance(t, Frame) else self.spread(t, ())

    def spread(self, t: Scalar, dims: tuple[str, ...]) -> Frame:
        base = self.dense(dims)
        return Frame(base.root, dims, t.v, t.kind)

    def expanded(self, t: Frame | Scalar, dims: tuple[str, ...]) -> Frame:
        if isinstance(t, Scalar):
            return self.spread(t, dims)
        if not dims:
            return t
        return inner(t, self.dense(dims), lambda v, _: v, t.kind)

    # ---- element-wise

    def binary(self, node: Bin) -> Frame | Scalar:
        op, a, b = node.op, self.lower(node.left), self.lower(node.right)
        kind = "boolean" if op in COMPARE or op in ("AND", "OR") else "number"
        if op in COMPARE:
            fn = lambda x, y: compare_op(op, x, y, a.kind)
        elif op in ("*", "/"):
            fn = lambda x, y: number_op(op, x, y)
        else:
            fn = lambda x, y: union_op(op, x, y)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            return Scalar(fn(a.v, b.v), kind)
        if op in ("+", "-", "AND", "OR"):
            # a side without dimensions stands at every combination of the other's members
            dims = union(a.dims, b.dims)
            a, b = (self.expanded(t, tuple(d for d in dims if d not in t.dims)) for t in (a, b))
            return outer(a, b, fn, kind)
        for t, other, turn in ((a, b, fn), (b, a, lambda x, y: fn(y, x))):
            if isinstance(other, Scalar):
                return t.with_v(turn(t.v, other.v), kind)
        # a dimension's own number, where the other side has that dimension, is a column of it
        for (t, n), (other, _), turn in (((a, node.left), (b, node.right), fn), ((b, node.right), (a, node.left), lambda x, y: fn(y, x))):
            if isinstance(n, DimRef) and n.dim in other.dims:
                return other.with_v(F.when(other.v.isNotNull(), turn(F.col(n.dim), other.v)), kind)
        return inner(a, b, fn, kind)

    def choose(self, node: If) -> Frame | Scalar:
        c, a = self.lower(node.cond), self.lower(node.then)
        b = self.lower(node.other) if node.other is not None else None
        parts = [(c_, t) for c_, t in ((True, a), (False, b)) if t is not None]
        if isinstance(c, Scalar):
            if all(isinstance(t, Scalar) for _, t in parts):
                return Scalar(F.when(c.v, a.v).otherwise(b.v) if b is not None else F.when(c.v, a.v), a.kind)
            c = self.spread(c, ())
        if all(isinstance(t, Scalar) or set(t.dims) <= set(c.dims) for _, t in parts):
            # every branch is at the condition's grain: one projection, with left joins where a branch has another root
            root, cv, values = c, c.v, []
            for _, t in parts:
                if isinstance(t, Scalar):
                    values.append(t.v)
                elif t.root is c.root and root is c:
                    values.append(t.v)
                else:
                    names = [fresh() for _ in values]
                    base = root.root.select(*c.dims, cv.alias("_c"), *(v.alias(n) for v, n in zip(values, names, strict=True))).where(F.col("_c").isNotNull())
                    cells, name = t.kept()
                    held = fresh("c")
                    joined = base.withColumnRenamed("_c", held)
                    joined = joined.join(cells, list(t.dims), "left") if t.dims else joined.withColumn("_one", F.lit(1)).join(cells.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
                    root, cv, values = Frame(joined, c.dims, F.col(held), "boolean"), F.col(held), [F.col(n) for n in names] + [F.col(name)]
            out = F.when(cv, values[0])
            if b is not None:
                out = out.when(~cv, values[1])
            return Frame(root.root, c.dims, out, a.kind)
        dims = union(c.dims, *(t.dims for _, t in parts))
        pieces = []
        for wanted, t in parts:
            here = c.with_v(F.when(c.v if wanted else ~c.v, F.lit(True)))
            piece = here.with_v(F.when(here.v, t.v), t.kind) if isinstance(t, Scalar) else inner(here, t, lambda _, v: v, t.kind)
            piece = self.expanded(piece, tuple(d for d in dims if d not in piece.dims))
            pieces.append(piece.cells().select(*dims, "v"))
        return Frame(reduce(DataFrame.unionByName, pieces), dims, F.col("v"), a.kind)

    def filtered(self, t: Frame | Scalar, c: Frame | Scalar) -> Frame | Scalar:
        if isinstance(c, Scalar):
            return t.with_v(F.when(c.v, t.v)) if isinstance(t, Frame) else Scalar(F.when(c.v, t.v), t.kind)
        t = self.frame(t)
        if c.root is t.root:
            return t.with_v(F.when(c.v, t.v))
        if not c.dims:
            return inner(t, c.with_v(F.when(c.v, F.lit(True))), lambda v, _: v, t.kind)
        cells, name = t.kept()
        return Frame(cells.join(c.cells().where("v").select(*c.dims), list(c.dims), "left_semi"), t.dims, F.col(name), t.kind)

    # ---- slices, shifts, groups

    def shifted(self, t: Frame, d: str, n: int) -> Frame:
        name, size = fresh(), self.model.dims[d].size
        at = F.col(d) - F.lit(n)
        root = t.root.select(*(at.cast("int").alias(d) if q == d else q for q in t.dims), t.v.alias(name)).where(F.col(d).between(0, size - 1) & F.col(name).isNotNull())
        return Frame(root, t.dims, F.col(name), t.kind)

    def grouped(self, t: Frame, dims: tuple[str, ...], agg: str, kind: str) -> Frame:
        return Frame(aggregate(t.cells(), list(dims), agg, self.model.exact), dims, F.col("v"), "number" if agg == "count" else kind)

    def removed(self, node: Remove) -> Frame:
        dims, child = [node.dim], node.child
        # a run of sums is one sum, with one rounding
        while node.agg == "sum" and isinstance(child, Remove) and child.agg == "sum":
            dims.append(child.dim)
            child = child.child
        t = self.frame(self.lower(child))
        rest = tuple(d for d in t.dims if d not in dims)
        if node.agg == "first":  # one value a group by construction
            return Frame(t.cells().drop(*dims), rest, F.col("v"), t.kind)
        return self.grouped(t, rest, node.agg, t.kind)

    def by(self, node: By) -> Frame:
        if node.prop in self.model.metrics:
            return self.lower(by_metric(node, self.model))
        prop, t = self.model.props[node.prop], self.frame(self.lower(node.child))
        if node.dim in t.dims:
            table = prop.table.select(F.col("src").alias(node.dim), F.col("dst").alias(prop.target))
            cells = t.cells().join(table, node.dim)
            dims = tuple(prop.target if d == node.dim else d for d in t.dims)
            return Frame(aggregate(cells, list(dims), node.agg or "sum", self.model.exact), dims, F.col("v"), "number" if node.agg == "count" else t.kind)
        table = prop.table.select(F.col("src").alias(node.dim), F.col("dst").alias(prop.target))
        dims = tuple(node.dim if d == prop.target else d for d in t.dims)
        return Frame(t.cells().join(table, prop.target).drop(prop.target), dims, F.col("v"), t.kind)

    def formula(self, node: Node, dims: tuple[str, ...]) -> Frame:
        t = self.lower(node)
        return self.spread(t, dims) if isinstance(t, Scalar) else t

    def type_of(self, node: Node):
        return infer(node, self.model, [])
