"""Packing along a space-filling curve.

A document's hashed words are summed into a few dimensions, its place on a Hilbert curve is the
sort key, and documents are laid end to end along the curve and cut every ``LENGTH`` tokens. The
last, shorter part of each partition is cut at powers of two, which need no padding.

Ids are computed once, word by word: in this tokenizer no token spans white space, so each
distinct word of a chunk is encoded once. Words that hold a special string are encoded likewise.

Defined cases: null text is empty and packs as the end id alone; repeated rows are packed each,
side by side; a text of any length is encoded whole and cut into as many pieces as it needs; an
empty table gives no pieces; columns besides the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .common import bytes_of, chunks, cut, cut_bytes, cut_words, mix, offsets_of, ranges, starts, word_hashes

LENGTH, DIMS, BITS, END = 4096, 3, 16, 2
CHUNK_BYTES, TASK_BYTES = 4 << 20, 64 << 20


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits (rows)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) > 0
            t = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(h: np.ndarray, codes: np.ndarray, lens: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of texts: each word's hash gives its weights, sums are scaled to unit variance."""
    doc = np.repeat(np.arange(len(lens)), lens)
    out = np.zeros((len(lens), dims))
    for k in range(dims):
        weight = (mix(h + np.uint64(k + 1)).astype(np.int64) / 2.0**63)[codes]
        out[:, k] = np.bincount(doc, weights=weight, minlength=len(lens)) / np.sqrt(np.maximum(lens, 1) / 3)
    return hilbert(((1 / (1 + np.exp(-out))) * (2**bits - 1)).astype(np.int64), bits)


class Words:
    """Ids of words between white space, by numpy merge rounds over a chunk's distinct words.

    For tokenizers that put text in NFC and lower case and keep what their pattern matches. Words
    of code points below U+0300 are cut here; what holds another, or may hold a special string,
    goes through the tokenizers library, whose tables of later code points nothing else has.
    """

    def __init__(self, name: str):
        import json

        import public_tokenizers

        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{name} isn't of the kind that packing knows")
        self.bpe = ByteBpe(path, split["pattern"]["Regex"])
        self.path, self.library = path, None  # the library's own copy takes 40 MB, and few words need it
        self.kind = np.uint32 if self.bpe.size > 1 << 16 else np.uint16

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words (binary, UTF-8) and the number of each."""
        text = words.cast(pa.large_string())
        late = _holds(text, LATER) | np.asarray(pc.match_substring_regex(text, "\u0130|<\\|").to_numpy(zero_copy_only=False), bool)
        part, owner, whole = self._parts(pc.utf8_lower(text.filter(pa.array(~late))))
        flat, n = self._pieces(whole)
        own = np.flatnonzero(~late)[owner]
        size = np.bincount(own, weights=n[part], minlength=len(words)).astype(np.int64)
        flat = flat[ranges(starts(n)[part], n[part])]
        if not late.any():
            return flat, size
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        more = [x.ids for x in self.library.encode_batch(text.filter(pa.array(late)).to_pylist(), add_special_tokens=False)]
        size[late] = np.fromiter(map(len, more), np.int64, len(more))
        out = np.empty(size.sum(), self.kind)
        side = np.repeat(late, size)
        out[~side], out[side] = flat, np.fromiter(chain.from_iterable(more), self.kind)
        return out, size

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """A row for each part of a word, in order: place of the part, and the word; the distinct parts.

        Marks after a letter or number are a piece of their own, so they are a part.
        """
        base = pc.utf8_rtrim(words, characters=MARKS)
        base = pc.if_else(pc.utf8_is_alnum(pc.utf8_slice_codeunits(base, -1)), base, words)
        size, cut = (np.diff(offsets_of(x)) for x in (words, base))
        held = np.arange(size.sum()) - np.repeat(starts(size)[:-1], size) >= np.repeat(cut, size)
        tail = _text(size - cut, bytes_of(words)[held]).filter(pa.array(size > cut))
        code = pa.concat_arrays([base, tail]).dictionary_encode()
        at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.append(np.arange(len(words)), np.flatnonzero(size > cut))
        order = np.argsort(owner, kind="stable")
        return at[order], owner[order], code.dictionary

    def _pieces(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the parts and the number of each; letters alone are one piece."""
        find = self.bpe.pattern.findall
        single = pc.utf8_is_alpha(parts).to_numpy(zero_copy_only=False).astype(bool)
        own = [[x.encode() for x in find(p)] for p in parts.filter(pa.array(~single)).to_pylist()]
        count = np.ones(len(parts), np.int64)
        count[~single] = np.fromiter(map(len, own), np.int64, len(own))
        letters = parts.filter(pa.array(single))
        rest = list(chain.from_iterable(own))
        data = np.append(bytes_of(letters), np.frombuffer(b"".join(rest), np.uint8))
        ids, n = self.bpe.encode_raw(data, np.append(np.diff(offsets_of(letters)), np.fromiter(map(len, rest), np.int64, len(rest))))
        # those of single pieces come first: back to the order of the parts
        first = np.empty(len(parts), np.int64)
        first[single] = np.arange(len(letters))
        first[~single] = len(letters) + starts(count[~single])[:-1]
        pick = ranges(first, count)
        at = starts(n)
        size = np.bincount(np.repeat(np.arange(len(parts)), count), weights=n[pick], minlength=len(parts)).astype(np.int64)
        return ids[ranges(at[pick], n[pick])].astype(self.kind), size


#: marks that no contraction or special string of the pattern holds
MARKS = '.,;:!?*&%$#@=+~^_()[]{}"-/'
#: the least first byte of code points from U+0300 on
LATER = 0xCC


def _text(size: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(starts(size)), pa.py_buffer(np.ascontiguousarray(data))])


def _holds(x: pa.Array, byte: int) -> np.ndarray:
    """Whether each text has a byte of at least this value."""
    at = offsets_of(x) - offsets_of(x)[0]
    return np.diff(starts((bytes_of(x) >= byte).astype(np.int64))[at]) > 0


def keyed(tokenizer: str, end: int, chunk: int = CHUNK_BYTES):
    """For mapInArrow: doc_id, the curve key, and ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Words(tokenizer)  # the task's own, so that a worker that goes on to other stages doesn't keep it
        wide = np.dtype(tok.kind).itemsize
        for table, texts in chunks(batches, limit=chunk):
            words, codes, lens = cut_words(texts)
            ids, size = tok.of(words)
            # each text's end is one more word, the last
            ids, size = np.append(ids, np.array([end], tok.kind)), np.append(size, 1)
            last = np.cumsum(lens + 1) - 1
            word = np.full(len(codes) + len(lens), len(words))
            inside = np.ones(len(word), bool)
            inside[last] = False
            word[inside] = codes
            n = size[word]
            out = ids[ranges(starts(size)[word], n)]
            at = np.append(0, np.cumsum(n)[last])
            raw = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at * wide), pa.py_buffer(out)])
            key = curve_keys(word_hashes(words.to_pylist()), codes, lens)
            yield from pa.table({"doc_id": table.column("doc_id"), "key": key, "ids": raw.cast(pa.binary())}).to_batches(max_chunksize=512)

    return run


def cutter(length: int, wide: bool):
    """For mapInArrow over a sorted partition: the pieces, in order."""
    kind = np.uint32 if wide else np.uint16
    size = np.dtype(kind).itemsize

    def row(doc, start, raw, total, sequence, offset):
        part = np.frombuffer(raw, kind).astype("<u4")
        return (doc, start, len(part), crc32(part.tobytes()), total, sequence, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        sequence, open_, used = 0, [], 0  # open_: slices of the sequence that isn't full
        kinds = None
        for batch in batches:
            rows = []
            kinds = batch.schema.field("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                total, at = len(raw) // size, 0
                while at < total:
                    take = min(total - at, length - used)
                    open_.append((doc, at, raw[at * size : (at + take) * size], total))
                    at, used = at + take, used + take
                    if used == length:
                        offset = 0
                        for d, s, r, t in open_:
                            rows.append(row(d, s, r, t, part + sequence, offset))
                            offset += len(r) // size
                        sequence, open_, used = sequence + 1, [], 0
            if rows:
                yield _pieces(rows, kinds)
        rows, room, offset, left = [], 0, 0, used
        for d, s, r, t in open_:
            while r:
                if not room:
                    sequence += bool(rows)
                    room, offset = 1 << (left.bit_length() - 1), 0
                take = min(room, len(r) // size)
                rows.append(row(d, s, r[: take * size], t, part + sequence, offset))
                r, s, room, offset, left = r[take * size :], s + take, room - take, offset + take, left - take
        if rows:
            yield _pieces(rows, kinds)

    return run


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(v, kind if i == 0 else pa.int64()) for i, v in enumerate(zip(*rows))], names)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end: int = END, partitions: int | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per piece of a document; sequence_id and offset tell where it lies.

    length is a power of two; chunk (bytes of text) bounds a worker's memory; partitions is set by the bytes of ids. Equal keys are told apart by the document, so a large group of copies spreads.
    """
    if length & (length - 1):
        raise ValueError("length is a power of two")
    kind = docs.schema[key].dataType.simpleString()
    wide = Words(tokenizer).kind is np.uint32
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ids = cut(rows.mapInArrow(keyed(tokenizer, end, chunk), f"doc_id {kind}, key long, ids binary"), "packing")
    by = ["key", F.xxhash64("doc_id"), "doc_id"]
    line = ids.repartitionByRange(partitions or 1 + cut_bytes(ids) // TASK_BYTES, *by).sortWithinPartitions(*by)
    return line.mapInArrow(cutter(length, wide), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
