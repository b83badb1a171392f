"""Links between sets that are alike, and their connected components, without all pairs of a group.

Sets meet in buckets by signature. Each first meets one other: the most central member of one of
its buckets, the one it shares most buckets with. Verified links are contracted to components.
Of buckets that still hold several components, small ones are settled pair by pair. Only sets in
larger ones go on: such a set meets those of other components with which it shares one of its
rarest elements or, if both first met the same hub, one of its rarest changes against the hub.
Alike sets must share one. Nothing is capped.

Before two sets are fetched to be compared, their sketches are: a bit for each place that elements
hash to, set if an odd number of them does. Two sketches differ in no more bits than their sets do
in elements, so only pairs that can't be alike go.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, release, same_row, starts

BROADCAST_BYTES = 32 << 20
#: hashes are shuffled in so many slices at most, one after another, of so many rows at least
SLICES, SLICE_ROWS = 4, 1 << 22
#: buckets of so many sets are settled pair by pair, which makes half as many pairs a row at most
SMALL = 16


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node of edges a, b: large and small stars.

    The least neighbours are cut before edges join them, so that the join may split hot nodes.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        made = [e]
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", made)
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large", made)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low", made)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(*made)
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def alike(num: int, den: int):
    """For mapInArrow: pairs of sorted hash arrays with den * intersection >= num * union."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.searchsorted(q, p).clip(max=max(len(q) - 1, 0))] == p).sum()) if len(p) else 0
                ok.append(den * both >= num * (len(p) + len(q) - both) and both > 0)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def sketch(items: np.ndarray) -> bytes:
    """A bit for each place that elements hash to, twice as many as elements or more: set if an odd number of them does."""
    size = 1 << max(6, int(len(items)).bit_length())
    return np.packbits(np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Elements that two sets differ in at least, by their sketches; the longer one is folded."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) < len(q):
        p, q = q, p
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def possible(num: int, den: int):
    """For mapInArrow: the pairs a, b whose sizes and sketches don't rule out that they are alike."""

    def run(batches):
        for batch in batches:
            x, y, m, n = (batch.column(c).to_pylist() for c in ("x", "y", "m", "n"))
            ok = [den * min(i, j) >= num * max(i, j) and (den + num) * differing(p, q) <= (den - num) * (i + j) for p, q, i, j in zip(x, y, m, n)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, made: list) -> DataFrame:
    """Those of the pairs, a table that was cut, that are alike: written, a slice of the pairs at a time."""
    x, y = (sets.select(F.col("cls").alias(c), F.col("sketch").alias(v), F.col("n").alias(k)) for c, v, k in (("a", "x", "m"), ("b", "y", "n")))
    left = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(possible(num, den), "a long, b long"), "possible", made)
    need = sets.join(few(left.select(F.col("a").alias("cls")).unionAll(left.select(F.col("b").alias("cls"))).distinct()), "cls", "left_semi")
    x = need.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    y = need.select(F.col("cls").alias("b"), F.col("items").alias("y"))

    def links(i: int, n: int) -> DataFrame:
        within = f"pmod(xxhash64(a), {n}) = {i}"
        return cut(left.where(within).join(x.where(within), "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike(num, den), "a long, b long"), "links", made)

    return in_slices(links, left.join(sets.select(F.col("cls").alias("a"), "n"), "a").agg(F.sum("n")).first()[0])


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges: labels (node, comp) so far, edges a, b between nodes.

    Edges are first mapped to components, so that many links between two components count once.
    """
    x = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    more = cut(components(between), "labels")
    if more.isEmpty():
        return labels
    up = more.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    old = labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return cut(old.unionAll(more.join(labels, "node", "left_anti")), "labels")


def local_signatures(sig: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Of the signatures of n different sets, what each set sends to meet others, and what has met here already.

    A signature that several of the sets have is known to be shared, so two of them send it on and
    the rest needn't: a common one makes two rows a chunk of texts, however many sets have it.
    """
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1]))[: len(sig)]
    sig, owner = sig[new], owner[new]
    first, last = (np.append(True, sig[1:] != sig[:-1])[: len(sig)], np.append(sig[1:] != sig[:-1], True)[-len(sig) :] if len(sig) else np.zeros(0, bool))
    met = ~(first & last)

    def lists(take):
        at = np.argsort(owner[take], kind="stable")
        return pa.ListArray.from_arrays(pa.array(starts(np.bincount(owner[take], minlength=n)).astype(np.int32)), pa.array(sig[take][at]))

    return lists(first | last), lists(met)


def linked(member: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int, over: list[DataFrame] | tuple = (), small: int = SMALL) -> DataFrame:
    """node, comp of every set that links to another.

    member: cls, sigs, met, the signatures of a set as ``local_signatures`` gives them, in one row or
    several; sets_of: cls -> cls, items for some; over: tables to be dropped once member has been read;
    small: sets of a bucket that is settled pair by pair, 0 where alike sets may share no signature.

    What is aggregated by a key is cut before rows join it, so that the join may split hot keys.
    """
    made: list[DataFrame] = []
    own = Window.partitionBy("sig")  # at most two rows a chunk of texts
    total = member.agg(F.sum(F.size("sigs") + F.size("met"))).first()[0]

    def shared(i: int, n: int) -> DataFrame:
        within = f"pmod(sig, {n}) = {i}"
        sent = member.select(F.explode("sigs").alias("sig"), "cls").where(within).withColumn("low", F.min("cls").over(own)).withColumn("top", F.max("cls").over(own)).where("low <> top")
        return cut(sent.select("sig", "cls").unionAll(member.select(F.explode("met").alias("sig"), "cls").where(within)).distinct(), "buckets", made)

    buckets = in_slices(shared, total)
    drop(*over)
    sizes = cut(buckets.groupBy("sig").agg(F.count("*").alias("m")), "sizes", made)
    # the more others a set meets in all its buckets, the more central it is
    degrees = cut(buckets.join(sizes, "sig").groupBy("cls").agg(F.sum("m").alias("degree")), "degrees", made)
    sets = unique_sets(sets_of(degrees.select("cls")), made)
    release(buckets.sparkSession)
    ranked = buckets.join(degrees, "cls")
    hubs = cut(ranked.groupBy("sig").agg(F.max(F.struct("degree", "cls")).alias("hub")), "hubs", made)
    stars = ranked.join(hubs, "sig").where("cls <> hub.cls").groupBy("cls").agg(F.max("hub").alias("hub"))
    best = cut(stars.select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")), "pairs", made)
    labels = components(verified(best, sets, num, den, made))
    known = best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    mixed = _mixed(buckets, labels, made)
    near = _bucket_pairs(buckets, labels, mixed, small).join(known, ["a", "b"], "left_anti")
    direct = verified(cut(near, "pairs", made), sets, num, den, made)
    release(buckets.sparkSession)
    labels = joined(labels, direct)
    left = _labelled(buckets, labels).join(mixed.where(f"m > {small}"), "sig", "left_semi").select("cls", "comp").distinct()
    left = left.join(best.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "comp", F.coalesce("b", "cls").alias("hub"))
    left = cut(left.join(sets.select("cls", "n"), "cls"), "left", made)
    release(buckets.sparkSession)
    pairs = prefix_pairs(left, sets, num, den, made).unionAll(change_pairs(left, sets, num, den, made)).distinct()
    more = verified(cut(pairs.join(known, ["a", "b"], "left_anti"), "pairs", made), sets, num, den, made)
    out = joined(labels, more)
    drop(*made)
    release(buckets.sparkSession)
    return out


def unique_sets(found: DataFrame, made: list) -> DataFrame:
    """cls, items, n (elements), sketch of each set once; rows that repeat in full bring a set more often."""

    def sketched(batches):
        for batch in batches:
            items = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            more = [pa.array([len(x) for x in items], pa.int32()), pa.array([sketch(x) for x in items], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("items"), *more], ["cls", "items", "n", "sketch"])

    sets = cut(found.mapInArrow(sketched, "cls long, items binary, n int, sketch binary"), "sets", made)
    if sets.count() > sets.select("cls").distinct().count():
        sets = cut(sets.dropDuplicates(["cls"]), "sets", made)
    return sets


def in_slices(part: Callable[[int, int], DataFrame], rows: int | None) -> DataFrame:
    """The tables that ``part`` cuts of one slice of hashes after another: what is shuffled for one goes before the next.

    part gets the slice and the number of slices, SLICES at most, which follows from the number of rows.
    """
    n = min(SLICES, 1 + (rows or 0) // SLICE_ROWS)
    cuts = []
    for i in range(n):
        cuts.append(part(i, n))
        release(cuts[-1].sparkSession)
    return cuts[0] if n == 1 else cuts[0].sparkSession.read.schema(cuts[0].schema).parquet(*[x._cut_path for x in cuts])


def exploded(sets: DataFrame, made: list) -> DataFrame:
    """cls, el, place, d: elements of sets (cls, within, items) that another set within the same has too.

    place is the element's rank in its set from the rarest on, d the number of all elements of the set.
    sets is a table that was cut. Elements that no other set has come first, so they needn't be ranked, or kept.
    """

    def opened(i: int, n: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    sets = [np.frombuffer(x, np.int64) for x in part.column("items").to_pylist()]
                    el, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    if n > 1:
                        use = np.flatnonzero(el % n == i)
                        el, own = el[use], own[use]
                    columns = [part.column(c).to_numpy()[own] for c in ("cls", "within")]
                    yield from pa.table([*columns, el], names=["cls", "within", "el"]).to_batches(max_chunksize=20_000)

        return run

    size = F.expr("int(length(items) div 8)")

    def shared(i: int, n: int) -> DataFrame:
        some, own = sets.mapInArrow(opened(i, n), "cls long, within long, el long"), []
        common = cut(some.groupBy("within", "el").agg(F.count("*").alias("df")).where("df > 1"), "common", own)
        release(sets.sparkSession)
        out = cut(some.join(common, ["within", "el"]).select("cls", "el", "df"), "met", made)
        drop(*own)
        return out

    met = in_slices(shared, sets.agg(F.sum(size)).first()[0])
    own = Window.partitionBy("cls")
    ranked = met.withColumn("own", F.row_number().over(own.orderBy("df", "el"))).withColumn("common", F.count("*").over(own))
    sizes = few(sets.select("cls", size.alias("d")))
    return ranked.join(sizes, "cls").select("cls", "el", F.expr("int(d - common + own)").alias("place"), "d")


def prefix_pairs(left: DataFrame, sets: DataFrame, num: int, den: int, made: list) -> DataFrame:
    """a, b: pairs of different components and hubs that share one of their rarest elements.

    left: cls, comp, hub, n. Sets of n elements whose similarity is at least num / den share one of
    the n - ceil(num * n / den) + 1 rarest of each, in any one order of the elements; of two known
    sizes that must share t elements, one of the n - t + 1 rarest of each.
    """
    own = cut(sets.join(few(left.select("cls")), "cls", "left_semi").select("cls", F.lit(0).cast("long").alias("within"), "items"), "opened", mine := [])
    rows = exploded(own, mine).join(few(left), "cls")
    first = rows.where(f"place <= n - ({num} * n + {den - 1}) div {den} + 1").select("el", "cls", "comp", "hub", "n", "place")
    kept = in_slices(lambda i, n: cut(first.where(f"pmod(xxhash64(cls), {n}) = {i}"), "prefixes", made), sets.agg(F.sum("n")).first()[0])
    drop(*mine)
    release(sets.sparkSession)
    x, y = (kept.select("el", *[F.col(k).alias(v + c) for k, v in (("cls", ""), ("comp", "c"), ("hub", "h"), ("n", "n"), ("place", "p"))]) for c in "ab")
    share = f"({num} * (na + nb) + {num + den - 1}) div {num + den}"  # what alike sets of these sizes share at least
    return x.join(y, "el").where(f"a > b AND ca <> cb AND ha <> hb AND pa <= na - {share} + 1 AND pb <= nb - {share} + 1").select("a", "b")


def change_pairs(left: DataFrame, sets: DataFrame, num: int, den: int, made: list) -> DataFrame:
    """a, b: pairs of different components with the same hub that share a rare change against it.

    With D a set's symmetric difference to the hub, two sets differ in |Dx| + |Dy| - 2 |Dx & Dy|
    elements, of which alike sets have at most H = n (den - num) / num, n being the size of
    either. One of the two isn't linked to the hub, so some change is shared; with |Dx| <= |Dy|, x
    shares one of its H / 2 + 1 rarest changes and y one of its H + 1 rarest. A set with so many
    changes of its own meets nobody, however much of the hub it shares with others. Of two sets
    whose sizes are known, t changes must be shared, so one of the |D| - t + 1 rarest of each.
    """

    def changes(batches):
        for batch in batches:
            got = [np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True).tobytes() for x, y in zip(batch.column("items").to_pylist(), batch.column("base").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("hub"), pa.array(got, pa.binary())], ["cls", "within", "items"])

    mine: list[DataFrame] = []
    base = sets.select(F.col("cls").alias("hub"), F.col("items").alias("base"))
    several = left.groupBy("hub").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("hub")
    left = cut(left.join(several, "hub", "left_semi"), "several", mine)  # others meet nobody under their hub

    def changed(i: int, n: int) -> DataFrame:
        some = left.where(f"pmod(xxhash64(hub), {n}) = {i}")
        hubs = base.join(few(some.select("hub").distinct()), "hub", "left_semi")
        own = sets.select("cls", "items").join(few(some.select("cls", "hub")), "cls").join(hubs, "hub").select("cls", "hub", "items", "base")
        return cut(own.mapInArrow(changes, "cls long, within long, items binary"), "opened", mine)

    elements = sets.agg(F.sum("n")).first()[0]
    rows = exploded(in_slices(changed, elements), mine).join(few(left), "cls").withColumnRenamed("hub", "within")
    most = f"(n * {den - num} div {num})"
    first = rows.where(f"place <= {most} + 1").select("within", "el", "cls", "comp", "d", "n", "place", F.expr(f"place <= {most} div 2 + 1").alias("small"))
    kept = in_slices(lambda i, n: cut(first.where(f"pmod(xxhash64(cls), {n}) = {i}"), "changes", made), elements)
    drop(*mine)
    release(sets.sparkSession)
    x, y = (t.select("within", "el", *[F.col(k).alias(v + c) for k, v in (("cls", ""), ("comp", "c"), ("d", "d"), ("n", "n"), ("place", "p"))]) for c, t in (("a", kept.where("small")), ("b", kept)))
    share = f"greatest(1, (da + db - (na + nb) * {den - num} div {num + den} + 1) div 2)"
    met = f"a <> b AND da <= db AND ca <> cb AND pa <= da - {share} + 1 AND pb <= db - {share} + 1"
    return x.join(y, ["within", "el"]).where(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, cls, comp: the buckets with each set's component."""
    return buckets.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("comp", "cls").alias("comp"))


def _mixed(buckets: DataFrame, labels: DataFrame, made: list) -> DataFrame:
    """sig, m (sets) of the buckets that hold several components."""
    found = _labelled(buckets, labels).groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    return cut(found.where("x <> y").select("sig", "m"), "mixed", made)


def _bucket_pairs(buckets: DataFrame, labels: DataFrame, mixed: DataFrame, small: int) -> DataFrame:
    """a, b, a > b: the pairs of different components in mixed buckets of ``small`` sets at most."""
    each = _labelled(buckets, labels).join(mixed.where(f"m <= {small}"), "sig", "left_semi").groupBy("sig").agg(F.collect_list(F.struct("cls", "comp")).alias("s"))
    others = each.select("s", F.explode("s").alias("p")).select("p", F.explode(F.filter("s", lambda q: (q["cls"] < F.col("p.cls")) & (q["comp"] != F.col("p.comp")))).alias("q"))
    return others.select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).distinct()


def few(df: DataFrame, size: str = "0") -> DataFrame:
    """df, to be broadcast if it has BROADCAST_BYTES at most, at 64 bytes a row and 8 for each of ``size``."""
    rows, more = df.agg(F.count("*"), F.sum(F.expr(size))).first()
    return F.broadcast(df) if 64 * rows + 8 * (more or 0) <= BROADCAST_BYTES else df


def with_requests(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text, cls: the rows (doc_id, text, version) that requests (cls, id, of) name."""
    w = few(wanted, "octet_length(cast(id AS string)) div 8")
    return rows.join(w, same_row(rows, w)).select("doc_id", "text", "cls")
