"""Level formats, layouts, and the format of a sum or product.

A format only labels a relation: it decides the order of the index columns and whether a result
must be filled up with zeros, never which value a coordinate has.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class LevelFormat:
    kind: str  # dense, compressed or singleton
    unique: bool = True

    @property
    def code(self) -> str:
        return "d" if self.kind == "dense" else self.kind[0] + ("u" if self.unique else "n")

    @property
    def sparse(self) -> bool:
        return self.kind != "dense"


DENSE = LevelFormat("dense")
COMPRESSED, COMPRESSED_MANY = LevelFormat("compressed"), LevelFormat("compressed", False)
SINGLETON, SINGLETON_MANY = LevelFormat("singleton"), LevelFormat("singleton", False)
BY_CODE = {f.code: f for f in (DENSE, COMPRESSED, COMPRESSED_MANY, SINGLETON, SINGLETON_MANY)}

#: signature: layout
LAYOUTS = {"d_cu": "CSR", "cu_cu": "DCSR", "cu_cu_cu": "CSF3", "cn_su": "COO", "cn_sn_su": "COO3", "cu": "SparseVector", "d": "DenseVector", "": "Scalar"}


def register_layout(signature: str, name: str) -> None:
    """Names a signature; one name for each."""
    for code in filter(None, signature.split("_")):
        if code not in BY_CODE:
            raise ValueError(f"unknown level {code!r}")
    if LAYOUTS.get(signature, name) != name:
        raise ValueError(f"{signature!r} is {LAYOUTS[signature]} already")
    LAYOUTS[signature] = name


def add_levels(a: LevelFormat, b: LevelFormat) -> LevelFormat:
    """Dense if either is; a sum of singletons is a singleton; unique if both are."""
    if not (a.sparse and b.sparse):
        return DENSE
    kind = "singleton" if a.kind == b.kind == "singleton" else "compressed"
    return LevelFormat(kind, a.unique and b.unique)


def mul_levels(a: LevelFormat, b: LevelFormat) -> LevelFormat:
    """The sparse one of two; a product with a singleton is a singleton; unique if either is."""
    if not a.sparse or not b.sparse:
        return a if a.sparse else b
    kind = "singleton" if "singleton" in (a.kind, b.kind) else "compressed"
    return LevelFormat(kind, a.unique or b.unique)


@dataclass(frozen=True)
class Format:
    """Levels in order, each an index name with its format."""

    levels: tuple[tuple[str, LevelFormat], ...] = ()

    @classmethod
    def of(cls, layout: str, *indices: str) -> Format:
        """By a layout's name or a signature."""
        signature = next((s for s, n in LAYOUTS.items() if n == layout), layout)
        codes = signature.split("_") if signature else []
        if len(codes) != len(indices):
            raise ValueError(f"{layout} has {len(codes)} levels, not {len(indices)}")
        made = cls(tuple((i, BY_CODE[c]) for i, c in zip(indices, codes)))
        made.check()
        return made

    def check(self) -> None:
        names = self.indices
        if len(set(names)) != len(names):
            raise ValueError(f"an index repeats in {names}")
        sparse = [f for _, f in self.levels if f.sparse]
        if sparse and not sparse[-1].unique:
            raise ValueError("the last sparse level must be unique")
        for (_, f), (_, g) in zip(self.levels, self.levels[1:]):
            if not f.unique and g.kind != "singleton":
                raise ValueError("a level with repeated coordinates must be followed by a singleton")

    @property
    def indices(self) -> tuple[str, ...]:
        return tuple(i for i, _ in self.levels)

    @property
    def signature(self) -> str:
        return "_".join(f.code for _, f in self.levels)

    @property
    def name(self) -> str | None:
        return LAYOUTS.get(self.signature)

    def level(self, index: str) -> LevelFormat:
        """An index that the format lacks is broadcast: dense."""
        return dict(self.levels).get(index, DENSE)

    def _place(self, index: str) -> int:
        if index not in self.indices:
            raise ValueError(f"no level of {index} in {self.indices}")
        return self.indices.index(index)

    def next(self, index: str) -> str | None:
        """The index of the level below; none below the last."""
        at = self._place(index) + 1
        return self.indices[at] if at < len(self.levels) else None

    def previous(self, index: str) -> str | None:
        """The index of the level above; none above the first."""
        at = self._place(index)
        return self.indices[at - 1] if at else None

    @property
    def last_sparse(self) -> str | None:
        return ([None] + [i for i, f in self.levels if f.sparse])[-1]

    def without(self, index: str) -> Format:
        return Format(tuple(x for x in self.levels if x[0] != index))

    @property
    def filled(self) -> tuple[str, ...]:
        """Dense levels below the last sparse one: every coordinate of theirs is stored."""
        out: list[str] = []
        for index, f in reversed(self.levels):
            if f.sparse:
                break
            out.append(index)
        return tuple(reversed(out))


def merged_order(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """An order that keeps those of both, ties by name; where they contradict, a's order, then b's."""
    after = {i: set() for i in (*a, *b)}
    for order in (a, b):
        for x, y in zip(order, order[1:]):
            after[y].add(x)
    out: list[str] = []
    while len(out) < len(after):
        free = sorted(i for i in after if i not in out and after[i] <= set(out))
        if not free:
            return a + tuple(i for i in b if i not in a)
        out.append(free[0])
    return tuple(out)


def compatible_formats(a: Format, b: Format) -> bool:
    """Whether one order of levels keeps those of both."""
    shared = [i for i in a.indices if i in b.indices]
    return shared == [i for i in b.indices if i in a.indices]


def combine(a: Format, b: Format, levels) -> Format:
    """Formats whose orders contradict are taken in a's order, with a warning: values don't depend on it."""
    if not compatible_formats(a, b):
        warnings.warn(f"{b.indices} is taken in the order of {a.indices}", stacklevel=4)
    order = merged_order(a.indices, b.indices)
    return Format(tuple((i, levels(a.level(i), b.level(i))) for i in order))


def add_formats(a: Format, b: Format) -> Format:
    return combine(a, b, add_levels)


def mul_formats(a: Format, b: Format) -> Format:
    return combine(a, b, mul_levels)
