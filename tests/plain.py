"""Formulas over cells in dictionaries: a second, plain evaluator for the tests.

A cube is (dims, cells); a cell's key is a frozenset of (dimension, member).  Every operand is copied to all dimensions of
the result first; what a node keeps is then a matter of keys.
"""

from __future__ import annotations

from itertools import product

from gridloom.plans.ast import Bin, By, Const, Expand, Filter, If, IfBlank, IsBlank, Member, Not, On, Ref, Remove, Select, Shift
from gridloom.plans.parser import parse


class Plain:
    def __init__(self, dims: dict[str, list[str]]):
        self.dims, self.props, self.cubes, self.formulas = dims, {}, {}, {}

    def put(self, name: str, dims: list[str], cells: dict) -> None:
        self.cubes[name] = (tuple(dims), {frozenset(zip(dims, k, strict=True)): v for k, v in cells.items()})

    def define(self, name: str, dims: list[str], formula: str) -> None:
        self.formulas[name] = (tuple(dims), parse(formula, name))

    def table(self, name: str) -> dict:
        """Cells by tuples; recursive formulas are evaluated until nothing changes."""
        dims, node = self.formulas[name]
        for f, (d, _) in self.formulas.items():
            self.cubes[f] = (d, {})
        while True:
            before = {f: self.cubes[f][1] for f in self.formulas}
            for f, (d, n) in self.formulas.items():
                self.cubes[f] = (d, self.value(n)[1])
            if all(before[f] == self.cubes[f][1] for f in self.formulas):
                return {tuple(dict(k)[d] for d in dims): v for k, v in self.cubes[name][1].items()}

    def grid(self, dims) -> list[frozenset]:
        return [frozenset(zip(dims, k, strict=True)) for k in product(*(self.dims[d] for d in dims))]

    def copied(self, cube, dims) -> dict:
        own, cells = cube
        more = [d for d in dims if d not in own]
        return {k | g: v for k, v in cells.items() for g in self.grid(more)}

    def rank(self, v):
        """Members compare by place."""
        return next((ms.index(v) for ms in self.dims.values() if v in ms), v) if isinstance(v, str) else v

    def value(self, n) -> tuple[tuple, dict]:
        every = lambda *ds: tuple(dict.fromkeys(d for x in ds for d in x))
        match n:
            case Ref(m):
                return self.cubes[m] if m in self.cubes else ((m,), {frozenset({(m, x)}): x for x in self.dims[m]})
            case Const(v) | Member(_, v):
                return (), {frozenset(): v}
            case Bin(op, a, b):
                x, y = self.value(a), self.value(b)
                dims = every(x[0], y[0])
                p, q = self.copied(x, dims), self.copied(y, dims)
                out = {}
                for k in p.keys() | q.keys() if op in ("+", "-", "AND", "OR") else p.keys() & q.keys():
                    if (v := self.op(op, p.get(k), q.get(k))) is not None:
                        out[k] = v
                return dims, out
            case Not(a):
                d, x = self.value(a)
                return d, {k: not v for k, v in x.items()}
            case If(c, a, b):
                cond, yes = self.value(c), self.value(a)
                no = self.value(b) if b is not None else ((), {})
                dims = every(cond[0], yes[0], no[0])
                t, e = self.copied(yes, dims), self.copied(no, dims)
                return dims, {k: (t if v else e)[k] for k, v in self.copied(cond, dims).items() if k in (t if v else e)}
            case Filter(a, c):
                x = self.value(a)
                keep = self.copied(self.value(c), x[0])
                return x[0], {k: v for k, v in x[1].items() if keep.get(k)}
            case IfBlank(a, b):
                x = self.value(a)
                other = self.copied(self.value(b), x[0])
                return x[0], {k: x[1].get(k, other.get(k)) for k in self.grid(x[0])}
            case IsBlank(a):
                d, x = self.value(a)
                return d, {k: k not in x for k in self.grid(d)}
            case Expand(a, ds):
                x = self.value(a)
                return x[0] + tuple(ds), self.copied(x, x[0] + tuple(ds))
            case On(a, b):
                x, y = self.value(a), self.value(b)
                dims = every(x[0], y[0])
                there = self.copied(y, dims)
                return dims, {k: v for k, v in self.copied(x, dims).items() if k in there}
            case Select(a, d, m):
                dims, x = self.value(a)
                return tuple(q for q in dims if q != d), {k - {(d, m)}: v for k, v in x.items() if (d, m) in k}
            case Shift(a, d, by):
                dims, x = self.value(a)
                out = {}
                for k, v in x.items():
                    at = self.dims[d].index(dict(k)[d]) - by
                    if 0 <= at < len(self.dims[d]):
                        out[k - {(d, dict(k)[d])} | {(d, self.dims[d][at])}] = v
                return dims, out
            case Remove(a, d, agg):
                dims, x = self.value(a)
                return tuple(q for q in dims if q != d), self.grouped([(frozenset(e for e in k if e[0] != d), v) for k, v in x.items()], agg)
            case By(a, d, p, agg):
                dims, x = self.value(a)
                if (d, p) in self.props:
                    target, to = self.props[d, p]
                    table = {frozenset({(d, m)}): t for m, t in to.items()}
                    own = (d,)
                else:
                    own, table = self.cubes[p]
                    target = next(t for t, ms in self.dims.items() if set(table.values()) <= set(ms))
                if d in dims:  # to the target
                    pairs = [(frozenset(e for e in k if e[0] != d) | {(target, t)}, v) for k, v in x.items() if (t := table.get(frozenset(e for e in k if e[0] in own)))]
                    return tuple(target if q == d else q for q in dims), self.grouped(pairs, agg or "sum")
                rest = every([q for q in dims if q != target], own)
                out = {}
                for k, t in self.copied((own, table), rest).items():
                    at = frozenset(e for e in k if e[0] in dims) | {(target, t)}
                    if at in x:
                        out[k] = x[at]
                return rest, out
        raise TypeError(type(n).__name__)

    def grouped(self, pairs, agg) -> dict:
        groups: dict = {}
        for k, v in pairs:
            groups.setdefault(k, []).append(v)
        how = {"sum": sum, "avg": lambda vs: sum(vs) / len(vs), "min": min, "max": max, "count": len}[agg]
        return {k: how(vs) for k, vs in groups.items()}

    def op(self, op, x, y):
        if op in ("AND", "OR"):
            decided = op == "OR"
            return decided if decided in (x, y) else None if x is None or y is None else not decided
        if op in ("+", "-"):
            return (x or 0) + (y or 0) if op == "+" else (x or 0) - (y or 0)
        if op == "*":
            return x * y
        if op == "/":
            return x / y if y else None
        x, y = self.rank(x), self.rank(y)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
