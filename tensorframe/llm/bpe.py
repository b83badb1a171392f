"""Byte-level BPE in batches: encode and decode whole texts with numpy merge rounds.

The symbols of many pieces lie in one flat array. Each round takes the lowest rank of each piece
and merges all its places at once; the pairs that a merge makes are looked up by binary search
over sorted pair keys. Pieces with nothing left to merge leave the array.

Defined cases: null text is empty and has no ids; the sha256 of no ids is that of empty text;
repeated rows are encoded each; of pairs that tie the left one merges first; a text of any length
is encoded whole; an empty table has no rows; columns besides the key and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, starts

CACHE_PIECES, BLOCK = 200_000, 16_384
NEVER = np.int64(1) << 40


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.bytes_of = [b""] * self.size
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        ending = spec["model"].get("end_of_word_suffix") or ""
        #: the symbol of each byte; from 256 on, of a piece's last byte
        self.last = ending or None
        self.first = np.array([vocab[chars[b] + e] for e in ("", ending) for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], np.append(order, NEVER).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        a, b = np.divmod(np.arange(256 * 512), 512)
        self.byte_pairs = self.find(self.first[a], self.first[b]).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string is a piece of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces in order, and the number of ids of each."""
        return self.encode_raw(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def encode_raw(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for the bytes of all pieces; in blocks that stay near the processor."""
        at = starts(lens)
        got = [self._merged(data[at[i] : at[min(i + BLOCK, len(lens))]], lens[i : i + BLOCK]) for i in range(0, len(lens), BLOCK)]
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def _merged(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.astype(np.int64)
        ends = starts(lens)[1:][lens > 0] - 1
        if self.last is not None:
            raw[ends] += 256
        sym = self.first[raw]
        word = np.repeat(np.arange(len(lens)), lens)
        # of each symbol with the next: rank and what they make, updated where a merge changes them
        place = np.append(self.byte_pairs[(raw[:-1] & 255) * 512 + raw[1:]], -1) if len(raw) else np.zeros(0, np.int32)
        place[ends] = -1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = self.rank[place]  # the last one, for -1, is NEVER
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            if (low == NEVER).any():
                live = np.repeat(low < NEVER, size)
                done.append((sym[~live], word[~live]))
                sym, word, place, rank = sym[live], word[live], place[live], rank[live]
                size, low = size[low < NEVER], low[low < NEVER]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == np.repeat(low, size))
            # of a run of overlapping places, every second one from the left
            run = np.append(True, p[1:] != p[:-1] + 1)
            if not run.all():
                begin = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
                p = p[(np.arange(len(p)) - begin) % 2 == 0]
            sym[p] = self.made[place[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, word, place = sym[keep], word[keep], place[keep]
            new = p - np.arange(len(p))
            changed = np.zeros(len(sym), bool)
            changed[new] = changed[new[new > 0] - 1] = True
            at = np.flatnonzero(changed)
            last = at + 1 == len(sym)
            after = np.where(last, at, at + 1)
            place[at] = np.where(~last & (word[at] == word[after]), self.find(sym[at], sym[after]), -1)
        ids, owner = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lens))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted pair keys, by binary search; -1 if it never merges."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for pre-tokens as text; special strings have one id."""
        marked = [i for i, p in enumerate(pieces) if p in self.special] if self.special else []
        ids, lens = self.encode([b"" if p in self.special else p.encode() for p in pieces])
        if marked:
            where = starts(lens)[marked]
            ids = np.insert(ids, where, [self.special[pieces[i]] for i in marked])
            lens[marked] = 1
        return ids, lens

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k.json", pattern: str | None = None) -> ByteBpe:
    """By a path, or by a file's name among the public tokenizers."""
    import public_tokenizers

    return ByteBpe(name if "/" in name else public_tokenizers.path(name), pattern or public_tokenizers.PATTERN)


def encoder(name: str):
    """For mapInArrow: doc_id, ids digest and decoded digest of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name)
        ids_of: dict[str, str] = {}
        text_of: dict[str, bytes] = {}
        for table, texts in chunks(batches, limit=2 << 20):
            split = [bpe.pieces(t.decode("utf-8", "replace")) for t in texts]
            if len(ids_of) > CACHE_PIECES:
                ids_of.clear(), text_of.clear()
            new = list(set().union(*split) - ids_of.keys())
            ids, lens = bpe.encode_pieces(new)
            flat, cut = ids.tolist(), starts(lens).tolist()
            for i, p in enumerate(new):
                own = flat[cut[i] : cut[i + 1]]
                ids_of[p] = ",".join(map(str, own))
                text_of[p] = b"".join(map(bpe.bytes_of.__getitem__, own))
            n, a, b = [], [], []
            for own in split:
                s = ",".join(map(ids_of.__getitem__, own))
                n.append(s.count(",") + 1 if own else 0)
                a.append(hashlib.sha256(s.encode()).hexdigest())
                back = b"".join(map(text_of.__getitem__, own)).decode("utf-8", "replace")
                b.append(hashlib.sha256(back.encode()).hexdigest())
            out = table.select(["doc_id"]).append_column("n_tokens", pa.array(n, pa.int64())).append_column("ids_sha256", pa.array(a, pa.string())).append_column("decoded_sha256", pa.array(b, pa.string()))
            yield from out.to_batches()

    return run


def encode_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """key and ids (array of int) of every whole text."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for table, texts in chunks(batches, limit=2 << 20):
            split = [bpe.pieces(t.decode("utf-8", "replace")) for t in texts]
            flat = [p for own in split for p in own]
            ids, lens = bpe.encode_pieces(flat)
            ends = starts(lens)[starts(np.array([len(x) for x in split], np.int64))]
            col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield from table.select(["doc_id"]).append_column("ids", col).to_batches()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """key and text of each array of ids; a null array is empty text."""

    def run(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            text = [b"".join(map(bpe.bytes_of.__getitem__, x or [])).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoder(tokenizer), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
