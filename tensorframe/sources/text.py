"""Matrix Market and plain coordinate text (one entry a line, coordinates from 1).

Compressed files are read as Spark reads them, by their ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import VALUE, SparseTensor

SYMMETRIES = ("general", "symmetric", "skew-symmetric")


def banner_of(line: str) -> str:
    """The symmetry that a banner declares; an error for what can't be read."""
    words = line.lower().split()
    if len(words) < 5 or words[0] != "%%matrixmarket" or words[1] not in ("matrix", "tensor"):
        raise ValueError(f"no Matrix Market banner: {line!r}")
    if words[2] != "coordinate" or words[3] != "real":
        raise ValueError(f"only real coordinates can be read: {line!r}")
    if words[4] not in SYMMETRIES:
        raise ValueError(f"unknown symmetry {words[4]!r}")
    return words[4]


def parsable(spark: SparkSession, path: str) -> bool:
    try:
        banner_of(spark.read.text(path).first()[0])
    except (ValueError, TypeError):
        return False
    return True


def _entries(lines: DataFrame, rank: int, names: list[str], dtype: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*[(parts[k].cast("bigint") - 1).alias(n) for k, n in enumerate(names)], parts[rank].cast(dtype).alias(VALUE))


def read_matrix_market(spark: SparkSession, path: str, indices: tuple[str, ...] = ("i", "j"), dtype: str = "double") -> SparseTensor:
    """A file, or the parts of one in a folder. Entries off the diagonal are mirrored as its symmetry says; duplicates are summed.

    Fewer or more entries than declared raise at once, a coordinate outside of the extents when it is read.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where(F.startswith(F.lower("value"), F.lit("%%matrixmarket"))).orderBy("file", "block", "at").first() or lines.first()
    if first is None:
        raise ValueError(f"{path} is empty")
    symmetry = banner_of(first["value"])
    body = lines.where(~F.startswith(F.ltrim("value"), F.lit("%")) & (F.trim("value") != ""))
    head = body.where(F.col("file") == first["file"]).orderBy("block", "at").first()
    if head is None:
        raise ValueError(f"{path} declares no extents")
    *sizes, declared = map(int, head["value"].split())
    if len(sizes) != len(indices):
        raise ValueError(f"{len(sizes)} extents for {len(indices)} indices")
    entries = body.where(~((F.col("file") == head["file"]) & (F.col("block") == head["block"]) & (F.col("at") == head["at"])))
    if (found := entries.count()) != declared:
        raise ValueError(f"{path} declares {declared} entries and has {found}")
    got = _entries(entries, len(sizes), list(indices), dtype)
    inside = lambda i, n: F.when((F.col(i) >= 0) & (F.col(i) < n), F.col(i)).otherwise(F.raise_error(F.lit(f"a coordinate of {i} lies outside of its extent {n}")).cast("bigint")).alias(i)
    got = got.select(*[inside(i, n) for i, n in zip(indices, sizes)], VALUE)
    if symmetry != "general":
        i, j = indices
        sign = -1.0 if symmetry == "skew-symmetric" else 1.0
        mirrored = got.where(F.col(i) != F.col(j)).select(F.col(j).alias(i), F.col(i).alias(j), (F.col(VALUE) * sign).cast(dtype).alias(VALUE))
        got = got.unionAll(mirrored)
    return SparseTensor.from_df(got, list(indices), shape=dict(zip(indices, sizes)), dtype=dtype)


def write_matrix_market(t: SparseTensor, path: str) -> None:
    """Text files in a folder that follow one another by name, the banner in the first."""
    n = t.df.count()
    spark = t.df.sparkSession
    sizes = " ".join(str(t.shape[i]) for i in t.indices)
    head = spark.createDataFrame([(0, f"%%MatrixMarket {'matrix' if len(t.indices) == 2 else 'tensor'} coordinate real general"), (1, f"{sizes} {n}")], "o long, value string")
    body = t.df.select(F.lit(2).cast("bigint").alias("o"), *t.indices, _line(t).alias("value"))
    head = head.select("o", *[F.lit(0).cast("bigint").alias(i) for i in t.indices], "value")
    head.unionAll(body).orderBy("o", *t.indices).select("value").write.text(path)


def _line(t: SparseTensor):
    return F.concat_ws(" ", *[(F.col(i) + 1).cast("string") for i in t.indices], F.col(VALUE).cast("string"))


def read_tns(spark: SparkSession, path: str, indices: tuple[str, ...], shape: dict[str, int] | None = None, dtype: str = "double", mode_order: tuple[int, ...] | None = None) -> SparseTensor:
    """Any rank; # and empty lines are skipped; mode_order names the file's mode of each index."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    rank = len(indices)
    modes = [f"m{k}" for k in range(rank)]
    got = _entries(lines, rank, modes, dtype)
    order = mode_order or tuple(range(rank))
    if sorted(order) != list(range(rank)):
        raise ValueError(f"{order} doesn't permute {rank} modes")
    got = got.select(*[F.col(modes[m]).alias(i) for m, i in zip(order, indices)], VALUE)
    return SparseTensor.from_df(got, list(indices), shape=shape, dtype=dtype)


def write_tns(t: SparseTensor, path: str, ordered: bool = True) -> None:
    """Text files that follow one another in coordinate order."""
    rows = t.df.orderBy(*t.indices) if ordered else t.df
    rows.select(_line(t).alias("value")).write.text(path)
