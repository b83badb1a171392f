"""Storage layouts as nested columns, and back to coordinates.

A fibre is cut into parts of ``WIDTH`` coordinates, so that one long row never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import Format
from ..tensor import VALUE, SparseTensor

WIDTH = 1 << 16


def _fibres(df: DataFrame, keys: list[str], index: str, width: int) -> DataFrame:
    part = F.floor(F.col(index) / width).cast("bigint").alias("part")
    got = df.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct(index, VALUE))).alias("f"))
    return got.select(*keys, "part", F.col(f"f.{index}").alias("indices"), F.col(f"f.{VALUE}").alias("values"))


def to_csr(t: SparseTensor, width: int = WIDTH) -> DataFrame:
    """i, part, indices, values: the stored columns of each row; rows without any aren't listed."""
    i, j = t.indices
    return _fibres(t.df, [i], j, width)


def from_csr(df: DataFrame, i: str = "i", j: str = "j", shape: dict[str, int] | None = None, layout: str = "CSR", dtype: str = "double") -> SparseTensor:
    flat = df.select(i, F.inline(F.arrays_zip("indices", "values"))).select(F.col(i), F.col("indices").alias(j), F.col("values").alias(VALUE))
    return SparseTensor(flat, (i, j), dict(shape or {}), Format.of(layout, i, j), dtype)


#: rows that one prefix sum covers
STEP = 1 << 16


def _running(df: DataFrame, at: str, n: str, out: str) -> DataFrame:
    """df with ``out``, the sum of n over all smaller values of at: sums by block first, then inside of each."""
    block = F.floor(F.col(at) / STEP).cast("bigint")
    sized = df.withColumn("_block", block)
    whole = sized.groupBy("_block").agg(F.sum(n).alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each STEP rows
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = sized.withColumn("_inner", inner).join(F.broadcast(whole.select("_block", before.alias("_before"))), "_block")
    return got.withColumn(out, (F.col("_before") + F.col("_inner")).cast("bigint")).drop("_block", "_inner", "_before")


def csr_offsets(t: SparseTensor) -> DataFrame:
    """i, start, n: for every row of the shape where its entries start, rows that store nothing among them."""
    i, _ = t.indices
    every = t.df.sparkSession.range(t.shape[i]).select(F.col("id").alias(i))
    n = every.join(t.df.groupBy(i).agg(F.count("*").alias("n")), i, "left").select(i, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return _running(n, i, "n", "start").select(i, "start", "n")


def dcsr_offsets(t: SparseTensor) -> DataFrame:
    """p, i, start, n: the stored rows, numbered in order, and where the entries of each start."""
    i, _ = t.indices
    n = t.df.groupBy(i).agg(F.count("*").cast("bigint").alias("n"))
    got = _running(_running(n, i, "n", "start").withColumn("_one", F.lit(1)), i, "_one", "p")
    return got.select("p", i, "start", "n")


def to_dcsr(t: SparseTensor, width: int = WIDTH) -> DataFrame:
    """p, i, part, indices, values: as to_csr, with the number of each stored row."""
    i, _ = t.indices
    return to_csr(t, width).join(dcsr_offsets(t).select("p", i), i).select("p", i, "part", "indices", "values")


def from_dcsr(df: DataFrame, **k) -> SparseTensor:
    return from_csr(df, layout="DCSR", **k)


def to_coo(t: SparseTensor) -> DataFrame:
    """Sorted coordinates and values."""
    return t.df.orderBy(*t.indices)


def from_coo(df: DataFrame, indices: list[str], **k) -> SparseTensor:
    """Duplicates are summed."""
    return SparseTensor.from_df(df, indices, **k)


def to_csf3(t: SparseTensor, width: int = WIDTH) -> DataFrame:
    """i, part, kpart, fibres: for each i the j's, and for each j its k's and values, ``width`` entries at most."""
    i, j, k = t.indices
    side = max(math.isqrt(width), 1)
    low = _fibres(t.df, [i, j], k, side).withColumnRenamed("part", "kpart")
    part = F.floor(F.col(j) / side).cast("bigint").alias("part")
    inner = F.struct(F.col(j).alias("j"), "indices", "values")
    return low.groupBy(i, part, "kpart").agg(F.sort_array(F.collect_list(inner)).alias("fibres"))


def from_csf3(df: DataFrame, i: str = "i", j: str = "j", k: str = "k", shape: dict[str, int] | None = None, dtype: str = "double") -> SparseTensor:
    rows = df.select(i, F.inline("fibres")).select(i, F.col("j").alias(j), F.inline(F.arrays_zip("indices", "values")))
    flat = rows.select(i, j, F.col("indices").alias(k), F.col("values").alias(VALUE))
    return SparseTensor(flat, (i, j, k), dict(shape or {}), Format.of("CSF3", i, j, k), dtype)
