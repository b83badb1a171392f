"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a sample of ``SAMPLE`` vectors (iterative quantisation) turn a vector into
``BITS`` bits, cut into substrings; each substring is indexed. Codes within a Hamming radius r
differ in at most r // m bits in one of m substrings, so probing every bucket that near to the
query's substring finds all of them; the whole codes are then compared and what is left is ranked
by the inner product of the vectors, in double precision. The sample sets the radius, for
``RECALL`` at the table's size, and the length of the substrings, by which probes return fewest
rows. Every row is indexed.

Rows lie in blocks, by hash, and each block's index is built once: queries stream past it, and a
block keeps k rows a query, so a task holds one block and one batch of queries. There are
``BLOCKS`` blocks unless they would hold fewer than ``LEAST`` or more than ``MOST`` rows, so up to
BLOCKS * MOST rows what is shuffled grows as the table does; beyond that, queries meet more
blocks. A block that gives fewer than k widens the radius until it does. Of equal vectors a block
keeps the k + 1 smallest ids, as no other can be among the k nearest, so groups of copies cost little.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those whose length isn't the most common one (ties: the longer). Every other row is a
candidate of every query but itself, be its id null or shared with other rows, and every row whose
id the step divides is a query; rows that share such an id give a list each. Ties go to the
smaller id, null last. With no more than k other rows, all of them are returned; an empty table
gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, starts, trim

BITS, SAMPLE, RECALL, BATCH = 128, 4000, 0.95, 64
BLOCKS, LEAST, MOST = 16, 4096, 131_072
#: bits of a substring and the type that holds it
PARTS = ((16, np.uint16), (32, np.uint32), (64, np.uint64))


@dataclass
class Codes:
    rotation: np.ndarray  # dimension by bits
    radius: int
    part: type = np.uint16
    #: of the sample's rows, what a probe returns and what the whole code leaves
    probed: float = 1.0
    left: float = 1.0

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as substrings: a row for each vector."""
        return np.ascontiguousarray(np.packbits(x @ self.rotation > 0, axis=1)).view(self.part)


def learn(x: np.ndarray, k: int, rows: int, bits: int = BITS, recall: float = RECALL) -> Codes:
    """x: the sample; rows: of the whole table."""
    rng = np.random.default_rng(3)
    dim = x.shape[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(15):  # rotate towards the corners of the cube
            u, _, v = np.linalg.svd(np.where(unit @ r > 0, 1.0, -1.0).T @ unit)
            r = (u @ v).T
        parts.append(r)
    codes = Codes(np.concatenate(parts, 1)[:, :bits], bits)
    n = len(x)
    if n < 3:
        return codes
    probe = rng.permutation(n)[:200]
    b = np.packbits(unit @ codes.rotation > 0, axis=1)
    s = x[probe] @ x.T
    s[np.arange(len(probe)), probe] = -np.inf
    take = min(n - 1, max(1, -(-k * n // max(rows, 1))))
    near = np.argpartition(-s, take - 1, axis=1)[:, :take]
    gaps = np.bitwise_count(b[probe][:, None, :] ^ b[near]).sum(2).ravel()
    codes.radius = int(np.quantile(gaps, recall, method="higher"))
    best = None
    for size, kind in PARTS:
        c = b.view(kind)
        apart = np.bitwise_count(c[probe][:, None, :] ^ c)
        share = float((apart <= codes.radius // c.shape[1]).any(2).mean())
        if best is None or share < best:
            best, codes.part, codes.probed = share, kind, share
            codes.left = float((apart.sum(2, dtype=np.int64) <= codes.radius).mean())
    return codes


class Index:
    """Buckets of each substring over one block of rows."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int | None = None):
        """keys: of rows, each its own; ids: what is returned.

        With k, of equal vectors the k + 1 smallest ids stand for all: no other can be among the k nearest of any query.
        """
        if k is not None and len(x):
            at = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
            order = np.lexsort((keys, ids, at))
            n = np.bincount(at)
            keep = np.sort(order[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) <= k])
            keys, ids, x = keys[keep], ids[keep], x[keep]
        self.keys, self.ids, self.x, self.codes = keys, ids, x, codes
        self.code = codes.of(x)
        self.slack = 1e-14 * x.shape[1] * float(np.linalg.norm(x, axis=1).max(initial=0))
        self.buckets = []
        for t in range(self.code.shape[1]):
            order = np.argsort(self.code[:, t], kind="stable")
            values, first = np.unique(self.code[order, t], return_index=True)
            bucket = np.empty(len(order), np.int64)
            bucket[order] = np.repeat(np.arange(len(values)), np.diff(np.append(first, len(order))))
            self.buckets.append((values, bucket))

    def probe(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of each pair whose codes are within the radius."""
        near = np.zeros((len(code), len(self.keys)), bool)
        per = radius // len(self.buckets)
        for t, (values, bucket) in enumerate(self.buckets):
            near |= (np.bitwise_count(values ^ code[:, t, None]) <= per)[:, bucket]
        q, row = np.nonzero(near)
        whole = np.bitwise_count(self.code[row] ^ code[q]).sum(1, dtype=np.int64)
        return q[whole <= radius], row[whole <= radius]

    def search(self, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and inner product of the k best rows found for each of some queries, whose own keys are left out."""
        code, bits = self.codes.of(x), self.codes.rotation.shape[1]
        todo, radius, got = np.arange(len(x)), self.codes.radius, []
        while len(todo):
            q, row = self.probe(code[todo], radius)
            q = todo[q]
            other = self.keys[row] != own[q]
            q, row = q[other], row[other]
            enough = (np.bincount(q, minlength=len(x)) >= k) | (radius >= bits)
            got.append((q[enough[q]], row[enough[q]]))
            todo = todo[~enough[todo]]
            radius = min(bits, radius + 8)
        q, row = (np.concatenate(z) for z in zip(*got))
        order = np.argsort(q, kind="stable")
        row, edge = row[order], starts(np.bincount(q, minlength=len(x)))
        best = [self.ranked(x[i], row[a:b], k) for i, (a, b) in enumerate(zip(edge, edge[1:]))]
        n = [len(r) for r, _ in best]
        return np.repeat(np.arange(len(x)), n), np.concatenate([r for r, _ in best]), np.concatenate([s for _, s in best])

    def ranked(self, query: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest inner product, ties to the smaller id, and the products."""
        if len(row) > k:  # a quick product may be off by rounding: what comes near the k-th is kept
            quick = self.x[row] @ query
            least = np.partition(quick, len(row) - k)[len(row) - k]
            row = row[quick >= least - self.slack * np.linalg.norm(query)]
        score = (self.x[row] * query).sum(1)  # in one fixed order: equal vectors have equal scores
        order = np.lexsort((self.ids[row], -score))[:k]
        return row[order], score[order]


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """row (a number of its own), id, v: what takes part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return rows.where(v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k nearest others."""
    spark = vectors.sparkSession
    rows = cut(valid(vectors, key, vector), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").collect()
    codes = spark.sparkContext.broadcast(learn(np.array([r.v for r in sample], float), k, n))
    blocks = -(-n // min(max(n // BLOCKS, LEAST), MOST))
    index = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("q"), "row", "id", "v")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("q"), "row", "id", "v")
    # a block's rows come before the queries that stream past them
    line = index.unionAll(asked).repartition(blocks, "b").sortWithinPartitions("b", "q")
    last = np.iinfo(np.int64).max  # stands for a null id

    def matrix(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(float)
        return t.column("row").to_numpy(), t.column("id").fill_null(last).to_numpy(), x

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: list[pa.RecordBatch] = []
        box, block = None, None
        for batch in batches:
            b, q = batch.column("b").to_numpy(), batch.column("q").to_numpy()
            edges = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (q[1:] != q[:-1])))
            for at, to in zip(edges.tolist(), [*edges[1:].tolist(), len(b)]):
                part = batch.slice(at, to - at)
                if b[at] != block:
                    held, box, block = [], None, b[at]
                if not q[at]:
                    held.append(part)
                    continue
                if box is None:
                    if not held:
                        continue  # a block without rows
                    box, held = Index(*matrix(held), codes.value, k), []
                for i in range(0, part.num_rows, BATCH):
                    own, ids, x = matrix([part.slice(i, BATCH)])
                    who, row, score = box.search(x, own, k)
                    found = box.ids[row]
                    yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(ids[who]), pa.array(found, mask=found == last), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    found = line.mapInArrow(search, "row long, query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
