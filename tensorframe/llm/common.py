"""Helpers that the corpus operators share.

``cut`` writes an intermediate result to the folder that all executors share and reads it
back, so a lost executor costs at most the tasks that it was running. Python code works on
chunks of a few MB of text, as two of them run beside a small heap; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
CHUNK_BYTES, STEP_BYTES = 2 << 20, 4 << 20
#: the six bytes that words are cut at
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on one machine, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corpus-"))
    return "file://" + _own[0]


def cut(df: DataFrame, name: str = "step", made: list | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage, no recomputation.

    made: a list that the table is added to, for ``drop`` once nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if made is not None:
        made.append(back)
    return back


def _files(df: DataFrame):
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    return path.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()), path


def cut_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``cut`` wrote."""
    files, path = _files(df)
    return files.getContentSummary(path).getLength()


def drop(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        if getattr(df, "_cut_path", None):
            files, path = _files(df)
            files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of queries that are done: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """df itself if reading it twice gives the same rows in the same order, as a scan of files does; else a cut of it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    moves = ("Exchange", "Join", "Python", "Arrow", "Pandas", "Sample", "RDD")
    return cut(df, "settled") if any(x in plan for x in moves) else df


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, a hash of the text: both name a row wherever ids are null or repeat."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("version"))


def least_row() -> Column:
    """For an aggregate: the row with the smallest id, one without an id last; the fields id and version name it."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "version"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["id"]) & (a["version"] == b["of"])


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def trim() -> None:
    """Give memory that earlier tasks of a reused Python worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Whole rows in chunks of about ``limit`` bytes of text, with the texts as bytes."""
    trim()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = _texts(batch, column)
        lens = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        start = 0
        for i in range(batch.num_rows):
            size += int(lens[i]) + 64
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                size, start = 0, i + 1
                yield _whole(_taken(held), column)
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield _whole(_taken(held), column)


def _taken(held: list) -> list:
    """What held has; nothing holds on to it while it is worked on."""
    out = held[:]
    held.clear()
    return out


def _whole(held: list[pa.RecordBatch], column: str) -> tuple[pa.Table, list[bytes]]:
    table = pa.Table.from_batches(held).combine_chunks()
    texts = _texts(table, column)
    return table, as_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)


def _texts(rows: pa.RecordBatch | pa.Table, column: str):
    """The texts, which may be a field of the struct ``row``."""
    return rows.column(column) if "row" not in rows.schema.names else pc.struct_field(rows.column("row"), column)


def carried(docs: DataFrame, more: str = "") -> tuple[DataFrame, StructType]:
    """All columns of docs as one struct, ``row``, whatever their names; the schema of that and of ``more`` columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole, StructType([*whole.schema.fields, *(StructType.fromDDL(more).fields if more else ())])


def cut_words(texts: list[bytes], lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As words_of, with the distinct words as an Arrow array of binary; texts are cut some at a time, which bounds memory.

    With lower, A-Z are lower-cased first.
    """
    size = starts(np.fromiter(map(len, texts), np.int64, len(texts)))
    edges = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1], STEP_BYTES)), len(texts))).tolist()
    parts, lens = [], []
    for a, b in zip([0, *edges], [*edges, len(texts)]):
        if a < b:
            words, first, begin, _ = _placed([t.translate(BYTES_LOWER) for t in texts[a:b]] if lower else texts[a:b])
            parts.append(words)
            lens.append(np.diff(np.searchsorted(first, begin)))
    code = pa.chunked_array(parts, pa.large_binary()).dictionary_encode().unify_dictionaries()
    if not code.num_chunks:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    return code.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in code.chunks]).astype(np.int64), np.concatenate(lens)


def _placed(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Every word; its place in the texts, joined by line ends; where each text begins, and the end; the bytes."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    first, after = edge[::2], edge[1::2]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(starts(after - first)), pa.py_buffer(buf[inside])])
    return words, first, starts(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), buf


def placed_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; the code and the place of each word in the texts, joined by line ends; where texts begin; the bytes."""
    words, first, begin, buf = _placed(texts)
    code = words.dictionary_encode()
    return code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, begin, buf


def offsets_of(x: pa.Array) -> np.ndarray:
    """Where each value of an array of large binary or text begins among its bytes, and the end."""
    return np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)


def bytes_of(x: pa.Array) -> np.ndarray:
    """The bytes of all values, one after another."""
    at = offsets_of(x)
    return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in order, and the number of words of each text."""
    words, codes, lens = cut_words(texts)
    return words.to_pylist(), codes, lens


def coded(parts: list[list]) -> tuple[list, np.ndarray]:
    flat = pa.array(chain.from_iterable(parts), pa.large_binary() if not parts or not any(parts) or isinstance(next(filter(None, parts))[0], bytes) else pa.large_string())
    code = flat.dictionary_encode()
    return code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def starts(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], and so on; all below 2**31."""
    out = np.repeat((first - starts(n)[:-1]).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out; well spread."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a text: hashes, position of the first word, text index.

    h: a 64-bit hash of each word. Texts with fewer than n words have no run. Runs of a power of two
    are made of two halves, others of such runs.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    half, size, acc, done = h, 1, None, 0
    while True:
        if n & size:
            rest = half[done:]
            acc = half if acc is None else mix(acc[: len(rest)] * factor + rest)
            done += size
        if done == n:
            break
        half = mix(half[:-size] * factor + half[size:])
        size *= 2
    doc = np.repeat(np.arange(len(lens)), lens)
    first = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(starts(lens)[1:], lens))
    return acc[first], first, doc[first]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
