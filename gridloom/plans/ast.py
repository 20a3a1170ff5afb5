"""Formula nodes.  Names in a parsed tree are names; in a bound tree they are ids of the catalog."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Node:
    def children(self) -> list[Node]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Node)]

    def rebuilt(self, change) -> Node:
        """The node with change() applied to each child."""
        return type(self)(*(change(v) if isinstance(v := getattr(self, f.name), Node) else v for f in fields(self)))

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()

    def _bin(self, op: str, other: Any, swap: bool = False) -> Node:
        other = other if isinstance(other, Node) else Const(other)
        return Bin(op, other, self) if swap else Bin(op, self, other)

    def __add__(self, o):
        return self._bin("+", o)

    def __radd__(self, o):
        return self._bin("+", o, True)

    def __sub__(self, o):
        return self._bin("-", o)

    def __rsub__(self, o):
        return self._bin("-", o, True)

    def __mul__(self, o):
        return self._bin("*", o)

    def __rmul__(self, o):
        return self._bin("*", o, True)

    def __truediv__(self, o):
        return self._bin("/", o)

    def __neg__(self):
        return Bin("*", Const(-1.0), self)


@dataclass(frozen=True)
class Ref(Node):
    name: str


@dataclass(frozen=True)
class Const(Node):
    value: Any


@dataclass(frozen=True)
class DimRef(Node):
    dim: str


@dataclass(frozen=True)
class Member(Node):
    dim: str
    member: Any


@dataclass(frozen=True)
class Bin(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class If(Node):
    cond: Node
    then: Node
    other: Node | None = None


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    cond: Node


@dataclass(frozen=True)
class IfBlank(Node):
    child: Node
    default: Node


@dataclass(frozen=True)
class IsBlank(Node):
    child: Node


@dataclass(frozen=True)
class Expand(Node):
    child: Node
    dims: tuple[str, ...]


@dataclass(frozen=True)
class On(Node):
    child: Node
    other: Node


@dataclass(frozen=True)
class Coalesce(Node):
    first: Node
    second: Node


@dataclass(frozen=True)
class By(Node):
    child: Node
    dim: str
    prop: str
    agg: str | None = None


@dataclass(frozen=True)
class Remove(Node):
    child: Node
    dim: str
    agg: str


@dataclass(frozen=True)
class Select(Node):
    child: Node
    dim: str
    member: Any


@dataclass(frozen=True)
class Shift(Node):
    """Value at t is the child's at t + offset."""

    child: Node
    dim: str
    offset: int


@dataclass(frozen=True)
class AsAxis(Node):
    """A member metric as a table of ones with its value as one more dimension."""

    child: Node
    dim: str


KINDS = {c.__name__: c for c in (Ref, Const, DimRef, Member, Bin, Not, If, Filter, IfBlank, IsBlank, Expand, On, Coalesce, By, Remove, Select, Shift, AsAxis)}


def to_json(node: Node) -> list:
    out: list = [type(node).__name__]
    for f in fields(node):
        v = getattr(node, f.name)
        out.append(to_json(v) if isinstance(v, Node) else list(v) if isinstance(v, tuple) else v)
    return out


def from_json(data: list) -> Node:
    kind = KINDS[data[0]]
    args = []
    for f, v in zip(fields(kind), data[1:], strict=True):
        is_node = isinstance(v, list) and v and isinstance(v[0], str) and v[0] in KINDS and f.name != "dims"
        args.append(from_json(v) if is_node else tuple(v) if isinstance(v, list) else v)
    return kind(*args)


def depth(node: Node) -> int:
    return 1 + max((depth(c) for c in node.children()), default=0)
