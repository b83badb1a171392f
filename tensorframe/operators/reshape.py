"""Operators that move, restrict or fill coordinates. Stored zeros stay unless pruned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.formats import Format
from ..plans.lower import REAL, Lowering
from ..tensor import VALUE, SparseTensor


def _with(t: SparseTensor, df, indices=None, shape=None, form=None) -> SparseTensor:
    indices = t.indices if indices is None else indices
    return SparseTensor(df, tuple(indices), t.shape if shape is None else shape, form, t.dtype)


def prune(t: SparseTensor) -> SparseTensor:
    """Without stored zeros (0.0 and -0.0); NaN stays."""
    return _with(t, t.df.where(F.col(VALUE) != 0), form=t.format)


def densify(t: SparseTensor) -> SparseTensor:
    """Every coordinate of the shape, zero where none was stored."""
    low = Lowering(t.df.sparkSession, t.shape, True, False, REAL)
    return _with(t, low.filled(t.df, t.indices, t.indices), form=Format.of("_".join("d" * len(t.indices)), *t.indices))


def permute(t: SparseTensor, *indices: str) -> SparseTensor:
    """The same tensor with its levels in another order."""
    if sorted(indices) != sorted(t.indices):
        raise ValueError(f"{indices} doesn't permute {t.indices}")
    return _with(t, t.df.select(*indices, VALUE), indices)


def transpose(t: SparseTensor) -> SparseTensor:
    """Of a matrix: the index names keep their places, the coordinates change theirs."""
    i, j = t.indices
    shape = {k: t.shape[o] for k, o in ((i, j), (j, i)) if o in t.shape}
    return _with(t, t.df.select(F.col(j).alias(i), F.col(i).alias(j), VALUE), shape=shape)


def rename(t: SparseTensor, **names: str) -> SparseTensor:
    to = [names.get(i, i) for i in t.indices]
    shape = {names.get(i, i): n for i, n in t.shape.items()}
    form = Format(tuple((names.get(i, i), f) for i, f in t.format.levels))
    return _with(t, t.df.select(*[F.col(i).alias(n) for i, n in zip(t.indices, to)], VALUE), to, shape, form)


def clip(t: SparseTensor, **sizes: int) -> SparseTensor:
    """Only coordinates below the given extents, which become the shape."""
    df = t.df
    for i, n in sizes.items():
        df = df.where(F.col(i) < n)
    return _with(t, df, shape={**t.shape, **sizes}, form=t.format)


def resize(t: SparseTensor, **sizes: int) -> SparseTensor:
    """Declares extents; coordinates stay."""
    return replace(t, shape={**t.shape, **sizes}, name="")


def shift(t: SparseTensor, by: int = 1) -> SparseTensor:
    """Every coordinate plus ``by``, at most the last; what then coincides is summed."""
    moved = t.df.select(*[F.least(F.col(i) + by, F.lit(t.shape[i] - 1)).cast("bigint").alias(i) for i in t.indices], VALUE)
    return _with(t, moved.groupBy(*t.indices).agg(F.sum(VALUE).cast(t.dtype).alias(VALUE)), form=t.format)


def flatten(t: SparseTensor, index: str = "i") -> SparseTensor:
    """A matrix as a vector, column after column."""
    i, j = t.indices
    df = t.df.select((F.col(j) * t.shape[i] + F.col(i)).alias(index), VALUE)
    return _with(t, df, (index,), {index: t.shape[i] * t.shape[j]})


def scale(t: SparseTensor, by: float) -> SparseTensor:
    scaled = lambda c: (c * F.lit(by)).cast(t.dtype)
    return replace(t, df=t.df.withColumn(VALUE, scaled(F.col(VALUE))), name="", then=t.then and (lambda c: scaled(t.then(c))))
