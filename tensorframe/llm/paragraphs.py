"""Repeated passages: whole texts, paragraphs by MinHash banding, and runs of words inside what is left.

Rows of equal text are one from the start; the smallest id keeps it. A paragraph is a line of at
least ``LEAST`` words, or several shorter lines that reach so many; its set is its distinct 5-word
shingles. Paragraphs that collide in a band are verified by exact Jaccard similarity (0.8 or more)
and clustered by connected components; the smallest id of a component keeps its paragraphs.

Passages that start or end inside a paragraph share none, so windows of ``WINDOW`` words, of which
the least hash of every ``SPREAD`` consecutive ones is kept, are matched exactly: any run of
WINDOW + SPREAD - 1 equal words shares one. Such a window is a seed only: all runs of ``LEAST_RUN``
words around it are matched too, so a repeated passage goes from its first word to its last. Only
windows outside of paragraphs that go already take part, so a passage that one document loses with
a paragraph stays in another. Each removed run lies whole in a document with a smaller id, where
its words stay or lie in a run that a still smaller one has, and so on: none goes everywhere.

Repeats inside one document are no concern here.

Defined cases: null or short texts have nothing to remove; a null doc_id takes no part and keeps
its text; rows that share a doc_id are one document for keeping, and each text of it has its own
runs; rows repeated in full have the same runs; ties of a hash or a similarity of exactly 0.8
count as alike; a text of any length is read whole; an empty table gives an empty result; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTES_LOWER, carried, chunks, cut, drop, keyed_rows, least_row, mix, placed_words, release, starts, windows, word_hashes, words_of
from .jaccard import classes, distinct
from .linkage import components, few, linked, local_signatures, with_requests

SHINGLE, LEAST, WINDOW, SPREAD, LEAST_RUN = 5, 20, 16, 17, 18
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tune(similarity: float, recall: float, most_bands: int = 8) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that still reach the recall."""
    best = (1, 1)
    for rows in range(1, 32):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands <= most_bands:
            best = (bands, rows)
    return best


def lines_of(texts: list[bytes]):
    """Word hashes in order; of each line with a word its words, its text, and its first word in its text; words of each text."""
    words, codes, place, begin, buf = placed_words([t.translate(BYTES_LOWER) for t in texts])
    line = np.cumsum(buf == 0x0A, dtype=np.int32)[place]
    head = np.flatnonzero(np.diff(line, prepend=-1))
    total = np.diff(np.searchsorted(place, begin))
    owner = np.searchsorted(begin, place[head], side="right") - 1
    return word_hashes(words.to_pylist())[codes], np.diff(np.append(head, len(line))), owner, head - starts(total)[owner], total


def blocks(lens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which paragraph each line belongs to, and the line that begins each paragraph.

    A line of LEAST words is one by itself; shorter ones of a text in a row are joined until they have as many.
    """
    new = np.ones(len(lens), bool)
    have, of, short = 0, -1, (lens < LEAST).tolist()
    for i, (n, o) in enumerate(zip(lens.tolist(), owner.tolist())):
        if short[i] and have and o == of:
            new[i] = False
            have += n
        else:
            have, of = (n, o) if short[i] else (0, o)
        if have >= LEAST:
            have = 0
    return np.cumsum(new) - 1, np.flatnonzero(new)


def paragraphs_of(texts: list[bytes]):
    """Word hashes in order; words and text of each paragraph; its first word in its text; words of each text."""
    h, lens, owner, first, total = lines_of(texts)
    part, head = blocks(lens, owner)
    return h, np.bincount(part, weights=lens, minlength=len(head)).astype(np.int64), owner[head], first[head], total


def line_sets(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, _, line = windows(h, lens, SHINGLE)
    use = lens[line] >= LEAST
    return distinct(keys[use], line[use], len(lens))


def band_hashes(keys: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row for each set (none empty), a column for each band."""
    at = starts(sizes)[:-1]
    out = np.zeros((len(sizes), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sizes), b + 1, np.uint64)
        for r in range(rows):
            a = mix(np.array([b * rows + r + 1], np.uint64))[0] | np.uint64(1)
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(keys * a), at))
        out[:, b] = acc
    return out.astype(np.int64)


def _slide(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over x[i : i + w] for each i."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = op(out, np.append(out[step:], np.full(min(step, len(out)), fill, out.dtype))[: len(out)])
        done += step
    return out


def winnowed(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word in its text, and text of the windows that are the least of SPREAD in a row."""
    keys, first, doc = windows(h, lens, WINDOW)
    if not len(keys):
        return keys, first, doc
    big = np.uint64(2**64 - 1)
    n = np.bincount(doc, minlength=len(lens))
    place = np.arange(len(keys)) + (doc + 1) * SPREAD
    x = np.full(len(keys) + (len(lens) + 1) * SPREAD, big)
    x[place] = keys
    low = _slide(x, SPREAD, np.minimum, big)
    # low[j] is the least of x[j : j + SPREAD]; only windows inside a text count, or all of a short text
    inside = np.zeros(len(x), bool)
    local = np.arange(len(keys)) - starts(n)[doc]
    inside[place[(local + SPREAD <= n[doc]) | (local == 0)]] = True
    low[~inside] = 0
    high = _slide(low[::-1], SPREAD, np.maximum, np.uint64(0))[::-1]
    take = high[place] == keys
    return keys[take], (first - starts(lens)[doc])[take], doc[take]


def around(h: np.ndarray, lens: np.ndarray, seeds: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word in its text, and text of the windows of LEAST_RUN words that a run with a seed can hold.

    seeds: first words of the texts' seeds; count: how many each text has. In a run of more words
    than WINDOW + SPREAD - 1, each such window lies with some seed in a stretch of that many.
    """
    keys, first, doc = windows(h, lens, LEAST_RUN)
    at, own = starts(lens), np.repeat(np.arange(len(lens)), count)
    reach = np.zeros(len(h) + 1, np.int64)
    np.add.at(reach, at[own] + np.maximum(seeds - SPREAD + 1, 0), 1)
    np.add.at(reach, np.minimum(at[own] + seeds + WINDOW + SPREAD - LEAST_RUN, at[own + 1]), -1)
    take = np.cumsum(reach)[first] > 0
    return keys[take], (first - at[doc])[take], doc[take]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and the number of words of each text."""
    words, codes, lens = words_of([t.translate(BYTES_LOWER) for t in texts])
    return word_hashes(words)[codes], lens


def outside(first: np.ndarray, doc: np.ndarray, lens: np.ndarray, gone: pa.Array, size: int) -> np.ndarray:
    """Whether each window of ``size`` words, by its first word in its text, holds no word of the text's runs ``gone``."""
    at = starts(lens)
    edge = np.zeros(at[-1] + 1, np.int64)
    for i, runs in enumerate(gone.to_pylist()):
        for r in runs or ():
            edge[at[i] + r["first"]] += 1
            edge[at[i] + r["first"] + r["n"]] -= 1
    covered = starts((np.cumsum(edge[:-1]) > 0).astype(np.int64))
    begin = at[doc] + first
    return covered[begin + size] == covered[begin]


def keepers(found: DataFrame, key: str, made: list) -> DataFrame:
    """key, keeper: the smallest document of each key that several documents have."""
    got = found.groupBy(key).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper <> other")
    return cut(got.select(key, "keeper"), "keepers", made)


def runs_of(hits: list[dict], least: int = LEAST_RUN) -> tuple[list[dict], list[int]]:
    """Merged runs of words that are long enough, and the documents that keep them."""
    runs: list[list] = []
    for x in sorted(hits, key=lambda x: (x["first"], -x["n"])):
        if runs and x["first"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x["first"] + x["n"])
            runs[-1][2].add(x["keeper"])
        else:
            runs.append([x["first"], x["first"] + x["n"], {x["keeper"]}])
    runs = [r for r in runs if r[1] - r[0] >= least]
    return [{"first": a, "n": b - a} for a, b, _ in runs], sorted(set().union(*(r[2] for r in runs)))


def strip(text: bytes, runs: list[dict]) -> bytes:
    """text without the runs of words, and without the white space after each."""
    spans = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for r in runs:
        out.append(text[at : spans[r["first"]]])
        at = spans[r["first"] + r["n"]]
    return b"".join([*out, text[at:]])


def repeated(docs: DataFrame, recall: float = 0.99) -> DataFrame:
    """doc_id, version (xxhash64 of the text), runs to remove, and keepers: only texts with a run."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed_rows(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    bands, height = tune(0.8, recall)
    made: list[DataFrame] = []
    copies = keepers(rows, "version", made)
    reps = rows.join(few(copies), "version", "left").where("keeper IS NULL OR doc_id = keeper").select("doc_id", "version", "text")

    def scanned(batches):
        seen: set[int] = set()
        for table, texts in chunks(batches):
            h, lens, owner, first, total = paragraphs_of(texts)
            keys, sizes = line_sets(h, lens)
            use = np.flatnonzero(sizes)
            ids = classes(keys, sizes)[use]
            new = np.array([c not in seen and not seen.add(c) for c in ids.tolist()], bool)
            sig = band_hashes(keys[np.repeat(new, sizes[use])], sizes[use][new], bands, height) if new.any() else np.zeros((0, bands), np.int64)
            sigs, met = local_signatures(sig.ravel(), np.repeat(np.flatnonzero(new), bands), len(use))
            own = table.select(["doc_id", "version"])

            def rows(at, **given):
                some = own.take(pa.array(at))
                for c, t in {"n_words": pa.int32(), "first": pa.int32(), "n": pa.int32(), "cls": pa.int64(), "sigs": pa.list_(pa.int64()), "met": pa.list_(pa.int64()), "hash": pa.int64()}.items():
                    some = some.append_column(c, given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(len(at), t))
                return some.to_batches(max_chunksize=20_000)

            yield from rows(np.arange(len(total)), n_words=total)
            yield from rows(owner[use], first=first[use], n=lens[use], cls=ids, sigs=sigs, met=met)
            key, place, doc = winnowed(h, total)
            yield from rows(doc, first=place, hash=key.astype(np.int64))

    def items(batches):
        for table, texts in chunks(batches):
            h, lens, owner, *_ = paragraphs_of(texts)
            keys, sizes = line_sets(h, lens)
            ids, at = classes(keys, sizes), starts(sizes)
            want = [set(w) for w in table.column("cls").to_pylist()]
            # a text's equal paragraphs are one set
            hit = list({(owner[i], ids[i]): i for i in np.flatnonzero(sizes).tolist() if ids[i] in want[owner[i]]}.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([keys[at[i] : at[i + 1]].tobytes() for i in hit], pa.binary())], ["cls", "items"])

    def extended(batches):
        for table, texts in chunks(batches):
            h, lens = hashed(texts)
            want = table.column("seeds").combine_chunks()
            key, first, doc = around(h, lens, pc.list_flatten(want).to_numpy().astype(np.int64), pc.list_value_length(want).to_numpy())
            free = outside(first, doc, lens, table.column("gone"), LEAST_RUN)
            own = table.select(["doc_id", "version"]).take(pa.array(doc[free]))
            yield from own.append_column("first", pa.array(first[free], pa.int32())).append_column("hash", pa.array(key[free].astype(np.int64))).to_batches(max_chunksize=20_000)

    scan = cut(reps.mapInArrow(scanned, f"doc_id {kind}, version long, n_words int, first int, n int, cls long, sigs array<long>, met array<long>, hash long"), "scan", made)
    member = scan.where("cls IS NOT NULL").select("doc_id", "version", "first", "n", "cls")

    def sets_of(ids: DataFrame) -> DataFrame:
        each = member.join(ids, "cls", "left_semi").groupBy("cls").agg(least_row().alias("r"))
        wanted = cut(each.groupBy(F.col("r.id").alias("id"), F.col("r.version").alias("of")).agg(F.collect_set("cls").alias("cls")), "wanted", made)
        return with_requests(reps, wanted).mapInArrow(items, "cls long, items binary")

    found = linked(scan.select("cls", "sigs", "met"), sets_of, 4, 5, small=0).withColumnRenamed("node", "cls")
    rooted = cut(member.join(found, "cls", "left").withColumn("root", F.coalesce("comp", "cls")).drop("cls", "comp"), "rooted", made)
    release(docs.sparkSession)
    lines = cut(rooted.join(keepers(rooted, "root", made), "root").where("doc_id <> keeper").select("doc_id", "version", "first", "n", "keeper"), "lines", made)
    # a document has as many runs as paragraphs, at most: these groups are bounded by a text
    gone = cut(lines.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "n")).alias("gone")), "gone", made)
    each = scan.where("hash IS NOT NULL").select("doc_id", "version", "first", "hash").join(few(gone, "size(gone)"), ["doc_id", "version"], "left")
    free = ~F.coalesce(F.exists("gone", lambda g: (F.col("first") < g["first"] + g["n"]) & (F.col("first") + WINDOW > g["first"])), F.lit(False))
    seeds = each.where(free)
    common = keepers(seeds, "hash", made).select("hash")
    near = cut(seeds.join(common, "hash", "left_semi").groupBy("doc_id", "version").agg(F.collect_set("first").alias("seeds"), F.any_value("gone").alias("gone")), "near", made)
    release(docs.sparkSession)
    found_in = reps.join(few(near, "size(seeds) div 2 + coalesce(size(gone), 0)"), ["doc_id", "version"]).mapInArrow(extended, f"doc_id {kind}, version long, first int, hash long")
    windows_near = cut(found_in, "extended", made)
    runs = windows_near.join(keepers(windows_near, "hash", made), "hash").where("doc_id <> keeper").select("doc_id", "version", "first", F.lit(LEAST_RUN).alias("n"), "keeper")
    sized = cut(scan.where("n_words IS NOT NULL").join(copies, "version").groupBy("version", "keeper").agg(F.max("n_words").alias("n")), "sized", made)
    whole = rows.select("doc_id", "version").join(few(sized), "version").where(f"doc_id <> keeper AND n >= {LEAST_RUN}").select("doc_id", "version", F.lit(0).alias("first"), "n", "keeper")
    hits = lines.unionAll(runs).unionAll(whole).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "n", "keeper")).alias("hits"))

    def merged(batches):
        struct = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            got = [runs_of(x) for x in batch.column("hits").to_pylist()]
            mask = pa.array([bool(r) for r, _ in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(mask), batch.column("version").filter(mask), pa.array([r for r, _ in got if r], struct), pa.array([k for r, k in got if r], pa.list_(batch.schema.field("doc_id").type))], ["doc_id", "version", "runs", "keepers"])

    out = cut(hits.mapInArrow(merged, f"doc_id {kind}, version long, runs array<struct<first: int, n: int>>, keepers array<{kind}>"), "runs")
    drop(*made)
    return out


def clusters(found: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest document that shared passages lead to."""
    edges = found.select(F.col("doc_id").alias("a"), F.explode("keepers").alias("b"))
    return components(edges).select(F.col("node").alias("doc_id"), F.col("comp").alias("component_id"))


def removed(docs: DataFrame, found: DataFrame, count: str = "n_removed") -> DataFrame:
    """docs, with their own columns, whose text has lost its runs; ``count``, the last column, tells how many words."""
    whole, _ = carried(docs)
    marked = whole.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("version"))
    plan = found.select("doc_id", "version", "runs")
    joined = marked.join(few(plan, "size(runs)"), ["doc_id", "version"], "left")

    @F.pandas_udf("string")
    def stripped(text, runs):
        import pandas as pd

        return pd.Series([t if t is None or r is None or not len(r) else strip(t.encode(), r).decode("utf-8", "replace") for t, r in zip(text, runs)], dtype=object)

    n = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["n"]), F.lit(0)).cast("long")
    out = joined.select("row", stripped("row.text", "runs").alias("cleaned"), n.alias("lost"))
    return out.select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("lost").alias(count))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component, the words to remove (as runs), and how many they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated(docs)
    own = found.drop("keepers")
    got = keyed_rows(docs).select("doc_id", "version").join(few(own, "size(runs)"), ["doc_id", "version"], "left").join(clusters(found), "doc_id", "left")
    n = F.aggregate("runs", F.lit(0), lambda s, r: s + r["n"])
    return got.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"), "runs")
