"""A sparse tensor as a relation: one row per stored coordinate, keyed by its index columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.formats import Format

VALUE = "v"


@dataclass
class SparseTensor:
    """df has the columns ``indices`` (bigint, unique together) and ``v``.

    shape gives the extent of an index where it is known; name is what a kernel calls its result.
    loose: the rows whose sums by coordinate, after ``then``, are those of df, where these are known.
    """

    df: DataFrame
    indices: tuple[str, ...]
    shape: dict[str, int] = field(default_factory=dict)
    format: Format | None = None
    dtype: str = "double"
    name: str = ""
    loose: DataFrame | None = None
    then: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.format is None:
            codes = {0: "", 1: "cu", 2: "cn_su"}.get(len(self.indices)) or "_".join(["cn", *["sn"] * (len(self.indices) - 2), "su"]) if self.indices else ""
            self.format = Format.of(codes, *self.indices)
        if set(self.format.indices) != set(self.indices):
            raise ValueError(f"format has {self.format.indices}, tensor has {self.indices}")

    @classmethod
    def from_df(cls, df: DataFrame, indices: dict[str, str] | list[str], value: str = VALUE, shape: dict[str, int] | None = None, format: Format | str | None = None, dtype: str = "double", unique: bool = False) -> SparseTensor:
        """indices: name of each index, or index: column. Duplicates are summed unless unique is known.

        A null coordinate or value fails the query that reads it.
        """
        names = indices if isinstance(indices, dict) else {i: i for i in indices}
        solid = lambda c, kind, what: F.coalesce(c.cast(kind), F.raise_error(F.lit(f"null {what}")).cast(kind))
        got = df.select(*[solid(F.col(c), "bigint", "coordinate").alias(i) for i, c in names.items()], solid(F.col(value), dtype, "value").alias(VALUE))
        loose = None if unique else got
        if not unique:
            got = got.groupBy(*names).agg(F.sum(VALUE).cast(dtype).alias(VALUE)) if names else got.agg(F.coalesce(F.sum(VALUE), F.lit(0.0)).cast(dtype).alias(VALUE))
        form = Format.of(format, *names) if isinstance(format, str) else format
        return cls(got, tuple(names), dict(shape or {}), form, dtype, loose=loose, then=lambda c: c.cast(dtype))

    def __getitem__(self, names) -> object:
        """a["i", "j"]: this tensor in an expression, under these index names."""
        from .plans.expr import Tensor

        names = (names,) if isinstance(names, str) else tuple(names)
        return Tensor(self, names)

    @classmethod
    def from_arrow(cls, spark, table, indices: list[str], **k) -> SparseTensor:
        """From an Arrow table with a column for each index and v; duplicates are summed. k: as for from_df."""
        return cls.from_df(spark.createDataFrame(table), indices, **k)

    def to_arrow(self):
        """Coordinates in order and values, as columns of an Arrow table on the driver: for results that fit there."""
        return self.df.orderBy(*self.indices).toArrow()

    def to_pandas(self):
        """As to_arrow, for pandas."""
        return self.to_arrow().to_pandas()
