"""The algebra: tensors, sums, products, contractions and broadcasts.

Operands align by index name. Under a sum an index that one side lacks is broadcast; under a
product the join does that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.formats import DENSE, Format, add_formats, mul_formats
from ..tensor import SparseTensor


class Expr:
    format: Format
    dtype: str

    @property
    def indices(self) -> tuple[str, ...]:
        return self.format.indices

    def __add__(self, other: Expr) -> Expr:
        return Add(self, other)

    def __mul__(self, other: Expr) -> Expr:
        return Mul(self, other)


def _same_dtype(a: Expr, b: Expr) -> str:
    for x in (a, b):
        if not isinstance(x, Expr):
            raise TypeError(f"{x!r} is no tensor expression")
    if a.dtype != b.dtype:
        raise TypeError(f"{a.dtype} and {b.dtype} don't mix")
    return a.dtype


@dataclass(frozen=True, eq=False)
class Tensor(Expr):
    """An occurrence of a tensor, or of a name that a kernel binds later."""

    source: SparseTensor | None
    names: tuple[str, ...]
    name: str = ""
    declared: Format | None = None
    kind: str = "double"
    format: Format = field(init=False)

    def __post_init__(self):
        if self.source is None:
            form = self.declared
        else:
            if len(self.names) != len(self.source.indices):
                raise ValueError(f"{len(self.source.indices)} indices, not {len(self.names)}")
            to = dict(zip(self.source.indices, self.names))
            form = Format(tuple((to[i], f) for i, f in self.source.format.levels))
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"an index repeats in {self.names}")
        form.check()
        object.__setattr__(self, "format", form)

    @property
    def dtype(self) -> str:
        return self.source.dtype if self.source else self.kind


def declare(name: str, layout: str, *indices: str, dtype: str = "double") -> Tensor:
    """An operand to be bound by position when a kernel is called."""
    return Tensor(None, indices, name, Format.of(layout, *indices), dtype)


@dataclass(frozen=True, eq=False)
class Bc(Expr):
    index: str
    body: Expr
    format: Format = field(init=False)

    def __post_init__(self):
        if self.index in self.body.indices:
            raise ValueError(f"{self.index} is there already")
        new = (self.index, DENSE)
        levels = self.body.format.levels
        at = next((k for k, (i, _) in enumerate(levels) if i > self.index), len(levels))
        object.__setattr__(self, "format", Format((*levels[:at], new, *levels[at:])))

    @property
    def dtype(self) -> str:
        return self.body.dtype


@dataclass(frozen=True, eq=False)
class Add(Expr):
    left: Expr
    right: Expr
    format: Format = field(init=False)
    dtype: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "dtype", _same_dtype(self.left, self.right))
        for own, other in (("left", self.right), ("right", self.left)):
            side = getattr(self, own)
            for index in other.indices:
                if index not in side.indices:
                    side = Bc(index, side)
            object.__setattr__(self, own, side)
        object.__setattr__(self, "format", add_formats(self.left.format, self.right.format))


@dataclass(frozen=True, eq=False)
class Mul(Expr):
    left: Expr
    right: Expr
    format: Format = field(init=False)
    dtype: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "dtype", _same_dtype(self.left, self.right))
        object.__setattr__(self, "format", mul_formats(self.left.format, self.right.format))


@dataclass(frozen=True, eq=False)
class Sum(Expr):
    index: str
    body: Expr
    format: Format = field(init=False)

    def __post_init__(self):
        if self.index not in self.body.indices:
            raise ValueError(f"no index {self.index} to sum over in {self.body.indices}")
        object.__setattr__(self, "format", self.body.format.without(self.index))

    @property
    def dtype(self) -> str:
        return self.body.dtype


def contract(indices: str | tuple[str, ...] | list[str], body: Expr) -> Expr:
    """Sums body over one index or several, the last innermost."""
    for index in reversed([indices] if isinstance(indices, str) else list(indices)):
        body = Sum(index, body)
    return body


def bc(index: str, body: Expr) -> Expr:
    return Bc(index, body)


def operands(e: Expr) -> list[Tensor]:
    """Every occurrence, from left to right."""
    if isinstance(e, Tensor):
        return [e]
    return [t for part in (getattr(e, k) for k in ("left", "right", "body") if hasattr(e, k)) for t in operands(part)]
