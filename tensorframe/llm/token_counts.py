"""Token counts without ids: each distinct pre-token is counted once.

A group of up to GROUP_BYTES of texts sends each of its distinct pre-tokens once, so the most
common one makes a row per group, not per document. Rows meet by pre-token, sorted;
each run of equal pre-tokens is encoded once and its number of pieces goes back to the chunks,
where the frequencies of each document are multiplied and summed.

Both readings of the input number pre-tokens alike, as they meet rows in the same order; an input
that isn't a plain scan is written first, so that this holds whatever executors are lost.

Defined cases: null text is empty and has 0 tokens; repeated rows stay; a text of any length is
counted whole; an empty table has no rows; columns besides the key and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import chunks, coded, settled, starts

#: texts of a chunk -> distinct keys, code of each occurrence, occurrences of each text
Split = Callable[[list[bytes]], tuple[list, np.ndarray, np.ndarray]]


GROUP_BYTES, GROUP_KEYS = 64 << 20, 600_000


def grouped(batches: Iterator[pa.RecordBatch], split: Split) -> Iterator[tuple]:
    """Texts in chunks whose keys are numbered alike within a group of chunks.

    Yields (group, table, texts, keys, place, codes, lens) for a chunk, where place[i] is the number
    of keys[i] in the group, and (group, all keys) at a group's end. Groups have ids that are the
    same whenever the same input split is read.
    """
    group = TaskContext.get().partitionId() << 24
    known: dict = {}
    size = 0
    for table, texts in chunks(batches, limit=4 << 20):
        keys, codes, lens = split(texts)
        place = np.fromiter((known.setdefault(k, len(known)) for k in keys), np.int64, len(keys))
        yield group, table, texts, keys, place, codes, lens
        size += sum(map(len, texts))
        if size > GROUP_BYTES or len(known) > GROUP_KEYS:
            yield group, list(known)
            known, size, group = {}, 0, group + 1
    if known:
        yield group, list(known)


def vectors(codes: np.ndarray, lens: np.ndarray, place: np.ndarray) -> pa.Array:
    """For each text the distinct keys, as gaps between their numbers, and how often each occurs."""
    size = int(place.max(initial=0)) + 1
    doc = np.repeat(np.arange(len(lens)), lens)
    key, times = np.unique(doc * np.int64(size) + place[codes], return_counts=True)
    number, n = key % size, starts(np.bincount(key // size, minlength=len(lens))).tolist()
    gap = np.diff(number, prepend=0)
    gap[[a for a, b in zip(n, n[1:]) if a < b]] = number[[a for a, b in zip(n, n[1:]) if a < b]]
    gap, times = gap.astype("<u4"), times.astype("<u4")
    press = zstandard.ZstdCompressor(level=1).compress
    # bytes of a kind lie together: the high ones are nearly all zero
    return pa.array([press(np.concatenate([gap[a:b].view(np.uint8).reshape(-1, 4).T.ravel(), times[a:b].view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes()) for a, b in zip(n, n[1:])], pa.binary())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys and how often each occurs."""
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, 4, -1)
    gap, times = (np.ascontiguousarray(y.T).view("<u4").ravel().astype(np.int64) for y in x)
    return np.cumsum(gap), times


def keys_of(split: Split):
    """For mapInArrow: group, code and key."""

    def run(batches):
        for group, *rest in grouped(batches, split):
            if len(rest) == 1:
                (keys,) = rest
                out = {"chunk": np.full(len(keys), group), "code": np.arange(len(keys), dtype=np.int32), "key": pa.array(keys).cast(pa.binary())}
                yield from pa.table(out).to_batches(max_chunksize=20_000)

    return run


def piece_split(tokenizer: str) -> Split:
    def split(texts):
        bpe = byte_bpe(tokenizer)
        parts = [bpe.pieces(t.decode("utf-8", "replace")) for t in texts]
        return *coded(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    return split


def counted(tokenizer: str):
    """For mapInArrow over rows sorted by key: the pieces of each key."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            code = batch.column("key").dictionary_encode()
            _, lens = bpe.encode_pieces([k.decode() for k in code.dictionary.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("code"), pa.array(lens[code.indices.to_numpy()], pa.int64())], ["chunk", "code", "n"])

    return run


def _summed(own: pa.Table, values: pa.Table) -> pa.Table:
    n = np.zeros(values.num_rows and int(values.column("code").to_numpy().max()) + 1, np.int64)
    n[values.column("code").to_numpy()] = values.column("n").to_numpy()
    got = []
    for raw in own.column("freqs").to_pylist():
        code, times = unpacked(raw)
        got.append(int(n[code] @ times))
    return own.select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array(got, pa.int64()))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """key, n_bytes and n_tokens of every whole text."""
    split = piece_split(tokenizer)
    kind = docs.schema[key].dataType.simpleString()
    rows = settled(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))

    def frequencies(batches):
        for group, *rest in grouped(batches, split):
            if len(rest) > 1:
                table, texts, _, place, codes, lens = rest
                size = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
                yield from pa.table({"chunk": np.full(len(texts), group), "doc_id": table.column("doc_id"), "n_bytes": size, "freqs": vectors(codes, lens, place)}).to_batches()

    own = rows.mapInArrow(frequencies, f"chunk long, doc_id {kind}, n_bytes long, freqs binary")
    keys = rows.mapInArrow(keys_of(split), "chunk long, code int, key binary")
    each = keys.repartition("key").sortWithinPartitions("key").mapInArrow(counted(tokenizer), "chunk long, code int, n long")
    return own.groupBy("chunk").cogroup(each.groupBy("chunk")).applyInArrow(_summed, f"doc_id {kind}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
