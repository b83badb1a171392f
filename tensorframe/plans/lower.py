"""From an expression to one lazy DataFrame.

Sums become one union and one aggregate however many terms they have; products become equi-joins
on shared indices; contractions aggregate over what is left, with partial aggregation before the
shuffle. Rewrites keep values and the set of stored coordinates:

* an index that occurs in one factor only is summed there before the join;
* factors are joined to those that they share most indices with, otherwise as written: a mask after
  the product that it covers, which it then filters row by row before the aggregate;
* with ``prefilter``, what factors share in an outer index restricts them before they meet, by
  semi-joins: a mask (a factor whose indices all stay) the others, or masks alone each other;
* a broadcast under a product is dropped where another factor has the index.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tensor import VALUE, SparseTensor
from .expr import Add, Bc, Expr, Mul, Sum, Tensor, operands

MOST_DENSE = 1 << 33

#: rows that a task makes of a dense result, about; tasks at most
DEALT, MOST_TASKS = 1 << 24, 1 << 13

#: bytes of a factor that is sent to every task of a product without shared indices
SENT = 1 << 25

#: bytes that the factors of a task read where a product expands; rows that one coordinate's product makes in a task, about
READ, CELL = 1 << 24, 1 << 20

#: coordinates of a fibre that are filled at once, as a power of two
FIBRE = 16


@dataclass(frozen=True)
class Semiring:
    """plus: aggregate of a column; times: of two columns; zero: of an empty sum."""

    plus: object = F.sum
    times: object = lambda a, b: a * b
    zero: float = 0.0


REAL = Semiring()
MIN_PLUS = Semiring(F.min, lambda a, b: a + b, float("inf"))


class Lowering:
    def __init__(self, spark: SparkSession, sizes: dict[str, int], rewrite: bool, prefilter: bool, ring: Semiring, whole: bool = False):
        self.spark, self.sizes, self.rewrite, self.prefilter, self.ring, self.whole = spark, sizes, rewrite, prefilter, ring, whole
        self.fresh = 0

    def extent(self, index: str) -> int:
        if index not in self.sizes:
            raise ValueError(f"the extent of {index} isn't known, so nothing can be broadcast along it")
        return self.sizes[index]

    def range(self, index: str) -> DataFrame:
        return self.spark.range(self.extent(index)).select(F.col("id").alias(index))

    def guard(self, stored: DataFrame, have, dense) -> None:
        """Refuses more than MOST_DENSE coordinates, unless the whole is wanted: those of ``have``, counted if an extent isn't known, times those of ``dense``."""
        if self.whole:
            return
        most = math.prod(self.sizes[i] for i in have) if all(i in self.sizes for i in have) else math.inf
        room = MOST_DENSE // max(math.prod(self.sizes[i] for i in dense), 1)
        if most > room and stored.select(*have).distinct().limit(min(room, 2**31 - 2) + 1).count() > room:
            raise ValueError(f"a dense result over {(*have, *dense)} is too large")

    def rows(self, e: Expr) -> DataFrame:
        """Columns: e's indices in order, and v; the indices are a key."""
        if isinstance(e, Tensor):
            df = e.source.df.select(*[F.col(c).alias(i) for c, i in zip(e.source.indices, e.names)], VALUE)
            return df.select(*e.indices, VALUE)
        if isinstance(e, Bc):
            body, wide = self.rows(e.body), self.range(e.index)
            self.guard(body, e.body.indices, (e.index,))
            return body.crossJoin(wide).select(*e.indices, VALUE)
        if isinstance(e, Add):
            return self.added(e)
        if isinstance(e, Mul):
            return self.product(factors(e), e.indices).select(*e.indices, VALUE)
        return self.contracted(e)

    def added(self, e: Add) -> DataFrame:
        parts = terms(e) if self.rewrite else [e.left, e.right]
        wide, rest = ([p for p in parts if isinstance(p, Bc) == k] for k in (True, False))
        if self.direct(e) and rest and len({p.index for p in wide}) == 1:
            body = self.summed([p.body for p in wide], wide[0].body.indices)
            return self.widened(self.summed(rest, e.indices), body, wide[0].index, e.indices)
        return self.summed(parts, e.indices)

    def direct(self, e: Expr) -> bool:
        """Whether a sum may be taken in any grouping of its terms."""
        return self.rewrite and self.ring is REAL and e.dtype in ("float", "double")

    def summed(self, parts: list[Expr], indices: tuple[str, ...]) -> DataFrame:
        if len(parts) == 1:
            return self.rows(parts[0]).select(*indices, VALUE)
        if self.direct(parts[0]) and indices:
            return self.together(parts, indices)
        out = None
        for term in parts:
            part = self.rows(term).select(*indices, VALUE)
            out = part if out is None else out.unionAll(part)
        if not indices:
            return out.agg(self.ring.plus(VALUE).alias(VALUE))
        return out.groupBy(*indices).agg(self.ring.plus(VALUE).alias(VALUE))

    def together(self, parts: list[Expr], indices: tuple[str, ...]) -> DataFrame:
        """A sum in one aggregate over the rows of all its terms, a column for each source of rows.

        A tensor gives its rows as they were before those of one coordinate were summed, so that no aggregate stands
        above another in a task. Products of tensors whose rows other factors or terms read as well are taken in too.
        """
        taken_in = lambda p: all(isinstance(f, Tensor) and f.source.loose is not None and set(f.indices) == set(indices) for f in factors(p))
        split = [factors(p) if isinstance(p, Mul) and taken_in(p) else [p] for p in parts]
        sources = Sources(self, indices)
        columns = [[sources.column(f) for f in term] for term in split]
        if len(sources.frames) == sum(map(len, columns)) > len(parts):
            sources = Sources(self, indices)
            columns = [[sources.column(p)] for p in parts]
        names = [f"_t{k}" for k in range(len(parts))]
        rows = sources.rows().select(*indices, *[functools.reduce(self.ring.times, c).cast("double").alias(n) for n, c in zip(names, columns)])
        total = sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0))
        return rows.where(F.coalesce(*names).isNotNull()).select(*indices, total.alias(VALUE))

    def widened(self, rest: DataFrame, body: DataFrame, index: str, indices: tuple[str, ...]) -> DataFrame:
        """rest plus body broadcast along index, where only what is stored is shuffled: along each fibre of body
        a stored coordinate is followed by the gap up to the next one, which is filled in the same task."""
        keys = [i for i in indices if i != index]
        at, extent = F.col(index), self.extent(index)
        self.guard(body, keys, (index,))
        blocks = self.spark.range(-(-extent >> FIBRE)).select((F.col("id") * (1 << FIBRE) - 1).alias(index), F.col("id").alias("_block"))
        heads = body.select(*keys, (F.col(VALUE).cast("double") + 0.0).alias("_all")).crossJoin(F.broadcast(blocks) if extent >> FIBRE < 1 << 20 else blocks)
        own = rest.select(*indices, F.shiftright(at, FIBRE).alias("_block"), F.col(VALUE).cast("double").alias("_own"), F.lit(None).cast("double").alias("_all"))
        rows = own.unionAll(heads.select(*indices, "_block", F.lit(None).cast("double").alias("_own"), "_all"))
        if tasks := tasks_for(body.count() * extent):
            rows = rows.repartition(tasks, *keys, "_block")
        along = Window.partitionBy(*keys, "_block").orderBy(index)
        past = F.coalesce(F.lead(index).over(along), (F.col("_block") + 1) * (1 << FIBRE))
        rows = rows.select(*indices, "_own", F.when(at < extent, F.first("_all").over(along)).alias("_all"), F.least(past, F.lit(extent)).alias("_past"))
        first = F.when(F.col("_own").isNull(), at + 1).otherwise(at)
        filled = F.when(F.col("_all").isNull(), F.array(at)).when(first < F.col("_past"), F.sequence(first, F.col("_past") - 1, F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        rows = rows.withColumn("_at", F.explode(filled))
        value = F.when(F.col("_at") == at, F.col("_own") + F.coalesce("_all", F.lit(0.0))).otherwise(F.col("_all"))
        return rows.select(*[F.col("_at").alias(i) if i == index else F.col(i) for i in indices], value.alias(VALUE))

    def product(self, parts: list[Expr], kept: tuple[str, ...]) -> DataFrame:
        have = {i for p in parts if not isinstance(p, Bc) for i in p.indices}
        slim = []
        for p in parts:
            while self.rewrite and isinstance(p, Bc) and p.index in have:
                p = p.body
            slim.append(p)
        parts = in_order(slim) if self.rewrite else slim
        frames = [self.rows(p) for p in parts]
        masks = [k for k, p in enumerate(parts) if is_mask(p, kept)]
        if self.prefilter and len(masks) < len(parts):
            for k, p in enumerate(parts):
                for m in masks if k not in masks else []:
                    if outer := next((i for i in p.indices if i in parts[m].indices), None):
                        frames[k] = frames[k].join(frames[m].select(outer).distinct(), outer, "left_semi")
        out, seen = None, set()
        for p, df in zip(parts, frames):
            self.fresh += 1
            own = f"_v{self.fresh}"
            shared = [i for i in p.indices if i in seen]
            if self.prefilter and len(shared) > 1 and len(masks) == len(parts):
                rows = out.select(shared[0]).distinct()
                out = out.join(df.select(shared[0]).distinct(), shared[0], "left_semi")
                df = df.join(rows, shared[0], "left_semi")
            df = df.withColumnRenamed(VALUE, own)
            if out is None:
                out = df.withColumnRenamed(own, VALUE)
            else:
                out = self.met(out, seen, df, p, shared) if shared else self.crossed(out, seen, df, p)
                out = out.withColumn(VALUE, self.ring.times(F.col(VALUE), F.col(own))).drop(own)
            seen |= set(p.indices)
        return out

    def met(self, left: DataFrame, have, right: DataFrame, p: Expr, shared: list[str]) -> DataFrame:
        """The join on shared indices. Where both sides have others too it makes more rows than it reads, so large ones are dealt
        out in tasks of READ bytes, and coordinates of more than CELL products in parts: rows of one side by hash, those of the
        other in each part. What a contraction leaves may be far less than it reads, so its join is left to Spark."""
        own, other = [i for i in sorted(have) if i not in shared], [i for i in p.indices if i not in shared]
        size = [stored(left), stored(right)] if own and other and not isinstance(p, Sum) else [0]
        tasks = min(sum(size) // READ, MOST_TASKS)
        if min(size) < READ or sum(size) >= UNKNOWN or tasks <= self.spark.sparkContext.defaultParallelism:
            return left.join(right, shared)
        side = math.isqrt(CELL)
        count = lambda df, n: df.groupBy(*shared).agg(F.count(*set(df.columns).difference(have, p.indices)).alias(n))  # noqa: E731 (of values, so that what is shuffled is what the join needs)
        heavy = count(left, "_n").join(count(right, "_m"), shared).where(F.col("_n").cast("double") * F.col("_m") > CELL)
        heavy = heavy.select(*shared, *[F.ceil(F.col(n) / side).cast("bigint").alias(to) for n, to in (("_n", "_p"), ("_m", "_q"))])
        heavy = F.broadcast(heavy) if sum(size) <= SENT * side // 4 else heavy  # a heavy coordinate has 2 * side rows at least

        def dealt(df: DataFrame, by: list[str], mine: str, parts: str, theirs: str, every: str) -> DataFrame:
            got = df.join(heavy, shared, "left").withColumn(mine, F.coalesce(F.pmod(F.xxhash64(*by), F.col(parts)), F.lit(0)))
            each = F.explode_outer(F.when(F.col(every).isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.col(every) - 1)))
            got = got.withColumn(theirs, each).withColumn(theirs, F.coalesce(theirs, F.lit(0)))
            return got.drop("_p", "_q").repartition(tasks, *shared, "_a", "_b")

        return dealt(left, own, "_a", "_p", "_b", "_q").join(dealt(right, other, "_b", "_q", "_a", "_p"), [*shared, "_a", "_b"]).drop("_a", "_b")

    def crossed(self, left: DataFrame, have, right: DataFrame, p: Expr) -> DataFrame:
        """Every row of one with every row of the other. More than MOST_DENSE, counted where an extent isn't known, are refused unless the whole is wanted.

        The larger side is dealt out, so that a task makes about DEALT rows; the other goes to every task if it is small.
        """
        many = lambda df, indices: math.prod(self.sizes[i] for i in indices) if all(i in self.sizes for i in indices) else df.count()
        n, m = many(left, have), many(right, p.indices)
        if n * m > MOST_DENSE and not self.whole:
            raise ValueError(f"the product over {(*have, *p.indices)} is too large")
        if tasks := tasks_for(n * m):
            dealt, sent = (lambda df, i: df.repartition(tasks, *i) if i else df), (lambda df, k: F.broadcast(df) if k * 8 * len(df.columns) <= SENT else df)
            left, right = (dealt(left, have), sent(right, m)) if n >= m else (sent(left, n), dealt(right, p.indices))
        return left.crossJoin(right)

    def contracted(self, e: Sum) -> DataFrame:
        gone, body = [e.index], e.body
        while isinstance(body, Sum):
            gone.append(body.index)
            body = body.body
        kept = e.indices
        if isinstance(body, Mul):
            parts = factors(body)
            if self.rewrite:
                for index in list(gone):
                    owners = [k for k, p in enumerate(parts) if index in p.indices]
                    if len(owners) == 1 and len(parts) > 1 and isinstance(parts[owners[0]], Tensor | Add | Sum):
                        parts[owners[0]] = Sum(index, parts[owners[0]])
                        gone.remove(index)
            rows = self.product(parts, kept)
            if not gone:
                return rows.select(*kept, VALUE)
        else:
            rows = self.rows(body)
        total = self.ring.plus(VALUE)
        if kept:
            return rows.groupBy(*kept).agg(total.alias(VALUE))
        return rows.agg(F.coalesce(total, F.lit(self.ring.zero)).alias(VALUE))

    def filled(self, df: DataFrame, indices: tuple[str, ...], dense: tuple[str, ...]) -> DataFrame:
        """df with a row for every coordinate of the dense indices below each stored prefix."""
        prefix = [i for i in indices if i not in dense]
        self.guard(df, prefix, dense)
        grid = df.select(*prefix).distinct() if prefix else None
        for i in dense:
            grid = self.range(i) if grid is None else grid.crossJoin(self.range(i))
        return grid.join(df, list(indices), "left").select(*indices, F.coalesce(VALUE, F.lit(self.ring.zero)).alias(VALUE))


class Sources:
    """The rows that the terms of a sum are made of; what several of them read is there once."""

    def __init__(self, low: Lowering, indices: tuple[str, ...]):
        self.low, self.indices, self.frames, self.read = low, indices, [], []

    def column(self, p: Expr) -> Column:
        """What p has at a coordinate, null where it stores none."""
        if not isinstance(p, Tensor) or p.source.loose is None:
            self.read.append(None)
            self.frames.append(self.low.rows(p).select(*self.indices, VALUE))
            return F.col(f"_s{len(self.frames) - 1}")
        loose, then = p.source.loose, p.source.then
        at = next((k for k, r in enumerate(self.read) if r and r[1] == p.names and r[0].sameSemantics(loose)), None)
        if at is None:
            at = len(self.frames)
            self.read.append((loose, p.names))
            self.frames.append(loose.select(*[F.col(c).alias(i) for c, i in zip(p.source.indices, p.names)], VALUE).select(*self.indices, VALUE))
        own = F.col(f"_s{at}")
        return F.when(own.isNotNull(), then(own))

    def rows(self) -> DataFrame:
        """A row for each coordinate that any of them stores, with the sum of each."""
        out = None
        for k, df in enumerate(self.frames):
            part = df.select(*self.indices, F.lit(k).alias("_of"), VALUE)
            out = part if out is None else out.unionAll(part)
        return out.groupBy(*self.indices).agg(*[F.sum(F.when(F.col("_of") == k, F.col(VALUE))).alias(f"_s{k}") for k in range(len(self.frames))])


#: bytes that stand for a size that isn't known
UNKNOWN = 1 << 55


def stored(df: DataFrame) -> int:
    """Bytes that df reads where its rows are stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(min(int(str(leaves.apply(k).stats().sizeInBytes())), UNKNOWN) for k in range(leaves.size()))


def tasks_for(rows: int) -> int:
    """Among how many tasks a dense result is dealt out; 0 if one is enough."""
    return min(-(-rows // DEALT), MOST_TASKS) if rows > DEALT else 0


def terms(e: Expr) -> list[Expr]:
    return terms(e.left) + terms(e.right) if isinstance(e, Add) else [e]


def factors(e: Expr) -> list[Expr]:
    return factors(e.left) + factors(e.right) if isinstance(e, Mul) else [e]


def is_mask(p: Expr, kept: tuple[str, ...]) -> bool:
    return len(p.indices) > 1 and set(p.indices) <= set(kept)


def in_order(parts: list[Expr]) -> list[Expr]:
    """The first, then always what shares most indices with those before, else as written."""
    left, out, seen = list(parts[1:]), parts[:1], set(parts[0].indices)
    while left:
        best = max(left, key=lambda p: len(seen & set(p.indices)))
        left.remove(best)
        out.append(best)
        seen |= set(best.indices)
    return out


def sizes_of(e: Expr) -> dict[str, int]:
    """Extents of the indices; operands must agree."""
    out: dict[str, int] = {}
    for t in operands(e):
        for c, i in zip(t.source.indices, t.names):
            size = t.source.shape.get(c)
            if size is not None and out.setdefault(i, size) != size:
                raise ValueError(f"{i} has extents {out[i]} and {size}")
    return out


def evaluate(e: Expr, sizes: dict[str, int] | None = None, rewrite: bool = True, prefilter: bool = False, ring: Semiring = REAL, whole: bool = False) -> SparseTensor:
    """The tensor that e denotes, lazily. sizes: extents that no operand gives. whole: a dense result of any size is wanted."""
    found = {**(sizes or {}), **sizes_of(e)}
    for i, n in (sizes or {}).items():
        if found[i] != n:
            raise ValueError(f"{i} has extents {n} and {found[i]}")
    spark = operands(e)[0].source.df.sparkSession
    low = Lowering(spark, found, rewrite, prefilter, ring, whole)
    df = low.rows(e)
    dense = e.format.filled
    if dense and all(i in found for i in dense):
        df = low.filled(df, e.indices, dense)
    kind = e.dtype
    df = df.select(*e.indices, F.col(VALUE).cast(kind).alias(VALUE))
    return SparseTensor(df, e.indices, {i: found[i] for i in e.indices if i in found}, e.format, kind)
