"""Documents whose sets of 3-word shingles have a Jaccard similarity of at least 0.9.

PartEnum: sizes are cut into bands so that alike sets lie in the same or the next band. Alike sets
of a band differ in at most k elements, with k from the band's largest size. Elements fall by hash
into parts of two halves each, so that there are more halves than k; every half of a part is a
signature, and alike sets share each half that no difference falls into. Of those there are at
least as many as halves beyond k. In one order of all contents, the last of the shared halves has
the others before it in either set, so a set signs with its k + 1 last halves only: those with most
elements, as a half with one shingle or none is shared by many unlike sets. A set signs for its own
band and for the one below. Sets of a band with k = 0 are alike only if equal; equal sets are one
class from the start.

Defined cases: null, empty or blank text has no shingle, is linked with nothing and is its own
component; fewer than three words make one shingle; repeated rows stay and share a component;
rows that share a doc_id count as separate documents with the same id. A null doc_id takes part
and may bridge others; the component's id is the smallest that is not null. A text of any length
is one set; sizes that tie fall in the same band; an empty table has no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTES_LOWER, chunks, cut, keyed_rows, least_row, mix, release, starts, windows, word_hashes, words_of
from .linkage import linked, local_signatures, with_requests


def shingle_sets(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one after another, and how many each has."""
    words, codes, lens = words_of([t.translate(BYTES_LOWER) for t in texts])
    h = word_hashes(words)[codes]
    keys, _, doc = windows(h, lens, n)
    short = np.flatnonzero((lens > 0) & (lens < n))
    at = starts(lens)
    if len(short):
        whole = []
        for i in short:
            x = np.array([lens[i]], np.uint64)
            for k in range(at[i], at[i + 1]):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k] + np.uint64(7))
            whole.append(x[0])
        keys, doc = np.append(keys, np.array(whole, np.uint64)), np.append(doc, short)
    return distinct(keys, doc, len(texts))


def distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of each of n owners, one after another, and how many each has."""
    order = np.argsort(keys)
    own = owner[order]
    order = order[np.argsort(own.astype(np.uint16) if n <= 1 << 16 else own, kind="stable")]  # few owners sort by digits
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=n)


def classes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal for equal sets."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(sizes), np.uint64)
    np.add.at(out, doc, mix(keys + np.uint64(11)))
    return mix(out ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).astype(np.int64)


@lru_cache(maxsize=8)
def bands(largest: int, num: int, den: int) -> np.ndarray:
    """The last size of each band, from size 1, up to one that holds ``largest``."""
    ends, low = [0], 1
    while ends[-1] < largest:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends)


def signatures(keys: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the set of each."""
    ends = bands(1 << max(int(sizes.max(initial=1)), 1).bit_length(), num, den)
    band = np.searchsorted(ends, sizes)
    sig, owner = [], []
    for down in (0, 1):
        tag = np.maximum(band - down, 0)
        k = ends[tag] * (den - num) // num
        use = (sizes > 0) & (tag > 0) & (k > 0) & (den * ends[tag] >= num * sizes)
        parts = np.where(use, (k + 2) // 2 + 1 + 3 * k // 20, 0)  # of two halves each
        base = starts(2 * parts)
        e = np.repeat(use, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)[e]
        h = mix(keys[e] + np.uint64(23))
        part = (h % (2 * parts[doc]).astype(np.uint64)).astype(np.int64)
        acc = np.zeros(base[-1], np.uint64)
        np.add.at(acc, base[doc] + part, mix(h))
        own = np.repeat(np.arange(len(sizes)), 2 * parts)
        place = np.arange(len(acc)) - base[own]
        made = mix(acc ^ mix(place.astype(np.uint64) + (tag[own].astype(np.uint64) << np.uint64(32))))
        order = np.lexsort((made, np.bincount(base[doc] + part, minlength=len(acc)), own))
        last = order[place >= (2 * parts - k - 1)[own]]
        sig.append(made[last])
        owner.append(own[last])
    return np.concatenate(sig).astype(np.int64), np.concatenate(owner)


def jaccard_members(docs: DataFrame, num: int = 90, den: int = 100, shingle: int = 3) -> DataFrame:
    """doc_id, version, n_shingles and root of every row: rows that links lead to share a root; none for an empty set.

    Links where den * intersection >= num * union; version is the xxhash64 of the text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed_rows(docs)

    def members(batches):
        seen: set[int] = set()
        for table, texts in chunks(batches):
            keys, sizes = shingle_sets(texts, shingle)
            cls = classes(keys, sizes)
            # a set signs once in a task; its other rows only name it
            ids = cls.tolist()
            new = np.array([bool(n) and c not in seen and not seen.add(c) for c, n in zip(ids, sizes.tolist())], bool)
            sig, owner = signatures(keys[np.repeat(new, sizes)], sizes[new], num, den)
            sigs, met = local_signatures(sig, np.flatnonzero(new)[owner], len(ids))
            out = table.select(["doc_id", "version"]).append_column("n_shingles", pa.array(sizes, pa.int64()))
            yield from out.append_column("cls", pa.array(cls, mask=sizes == 0)).append_column("sigs", sigs).append_column("met", met).to_batches(max_chunksize=2_000)

    def items(batches):
        for table, texts in chunks(batches):
            keys, sizes = shingle_sets(texts, shingle)
            at = starts(sizes).tolist()
            yield pa.RecordBatch.from_arrays([table.column("cls").combine_chunks(), pa.array([keys[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["cls", "items"])

    release(docs.sparkSession)
    signed = cut(rows.mapInArrow(members, f"doc_id {kind}, version long, n_shingles long, cls long, sigs array<long>, met array<long>"), "signed")
    member = cut(signed.select("doc_id", "version", "n_shingles", "cls"), "members")

    def sets_of(ids: DataFrame) -> DataFrame:
        first = member.where("cls IS NOT NULL").join(ids, "cls", "left_semi").groupBy("cls").agg(least_row().alias("r"))
        wanted = cut(first.select("cls", F.col("r.id").alias("id"), F.col("r.version").alias("of")), "wanted")
        return with_requests(rows, wanted).mapInArrow(items, "cls long, items binary")

    found = linked(signed, sets_of, num, den, [signed]).withColumnRenamed("node", "cls")
    return member.join(found, "cls", "left").select("doc_id", "version", "n_shingles", F.coalesce("comp", "cls").alias("root"))


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: links where den * intersection >= num * union."""
    rooted = jaccard_members(docs, num, den, shingle)
    least = cut(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low")), "least")
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, sh FROM (
  SELECT r, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS sh FROM d WHERE len(w) >= 3
  UNION ALL SELECT r, doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
f AS (SELECT s.r, s.sh, count(*) OVER (PARTITION BY s.sh) AS df FROM s),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.r < y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(r, m) AS (SELECT r, r FROM d UNION SELECT g.b, t.m FROM t JOIN g ON g.a = t.r),
m AS (SELECT t.r, min(o.doc_id) AS component_id FROM t JOIN d o ON o.r = t.m GROUP BY t.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d JOIN m ON m.r = d.r LEFT JOIN n ON n.r = d.r
"""
