"""URL filter: path rules first, then a ratio of two character language models.

Rules are literal host and path prefixes; the longest that fits decides. URLs without a rule are
judged by two variable-order Markov models over bytes, one for accepted and one for rejected
URLs, with Witten-Bell smoothing from order 0 to ``ORDER``. The score is the difference of log
likelihoods per byte; its threshold is set on a held-out part of the labelled sample.

The models are fitted on at most ``FIT_ROWS`` distinct URLs that a rule decides, the first by
hash, and ``FIT_TOTAL`` bytes of them: they reach the driver, and the models go to every executor,
as at most 2 * (ORDER + 1) * FIT_TOTAL n-grams of 28 bytes (176 MB if no two are alike; a
hundredth in practice). A whole URL is judged, with scheme, query and fragment.

Defined cases: null, or no ``://``: host and path are empty and no rule fits; the model judges the
text as it is, and a null or empty one has the score 0. A NUL byte counts as byte 1. If a class
has no URL, every score and the threshold are 0. A score at the threshold or above is allowed.
Repeated rows are judged alike; a URL of any length is judged whole; an empty table has no rows;
columns besides the key and the URL are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, lower_ascii

ORDER, FIT_ROWS, FIT_TOTAL, MAX_BYTES = 5, 40_000, 1 << 19, 512
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


class UrlModel:
    """Counts of byte n-grams of two classes as sorted keys; keys pack the order and the bytes."""

    def __init__(self, accepted: list[bytes], rejected: list[bytes], order: int = ORDER):
        if order > 6:
            raise ValueError("an order above 6 does not fit in a key")
        self.order, self.threshold = order, 0.0
        self.sides = [self._count(accepted), self._count(rejected)] if accepted and rejected else []

    def _keys(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Text of each place, and for each order the keys of context plus byte and of the context.

        Each text is preceded by zero bytes and followed by one.
        """
        pad = b"\0" * self.order
        flat = np.frombuffer(b"".join(pad + t.replace(b"\0", b"\1") + b"\0" for t in texts), np.uint8).astype(np.uint64)
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        doc = np.repeat(np.arange(len(texts)), lens)
        at = np.arange(len(doc)) + (doc + 1) * self.order
        grams, contexts, context = [], [], np.zeros(len(doc), np.uint64)
        for k in range(self.order + 1):
            if k:
                context = context | (flat[at - k] << np.uint64(8 * k))
            tag = np.uint64(k + 1) << np.uint64(8 * 7)
            grams.append(context | flat[at] | tag)
            contexts.append(context | tag)
        return doc, grams, contexts

    def _count(self, texts: list[bytes]):
        _, grams, contexts = self._keys(texts)
        grams_k, n = np.unique(np.concatenate(grams), return_counts=True)
        # every byte that follows a context: the context's count and its number of kinds
        contexts_k, total = np.unique(np.concatenate(contexts), return_counts=True)
        kinds = np.zeros(len(contexts_k), np.int64)
        np.add.at(kinds, np.searchsorted(contexts_k, grams_k & ~np.uint64(255)), 1)
        return grams_k, n.astype(np.int32), contexts_k, total.astype(np.int32), kinds.astype(np.int32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log likelihood of accepted less that of rejected, per byte."""
        texts = [t[:0] if t is None else t for t in texts]
        if not self.sides or not texts:
            return np.zeros(len(texts))
        doc, grams, contexts = self._keys(texts)
        diff = np.zeros(len(doc))
        for sign, (gk, gn, ck, cn, kinds) in zip((1, -1), self.sides):
            p = np.full(len(doc), 1 / 256)
            for g, c in zip(grams, contexts):
                i, j = np.searchsorted(ck, c).clip(max=len(ck) - 1), np.searchsorted(gk, g).clip(max=len(gk) - 1)
                seen = ck[i] == c
                n, t = np.where(seen, cn[i], 0), np.where(seen, kinds[i], 0)
                p = np.where(seen, (np.where(gk[j] == g, gn[j], 0) + t * p) / np.maximum(n + t, 1), p)
            diff += sign * np.log(p)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return np.where(lens > 0, np.bincount(doc, weights=diff, minlength=len(texts)) / np.maximum(lens + 1, 1), 0.0)


def fit(accepted: list[bytes], rejected: list[bytes]) -> UrlModel:
    """Models of four fifths of the URLs; the threshold of best balanced accuracy on the rest."""
    held = lambda t: crc32(t) % 5 == 0
    model = UrlModel([t for t in accepted if not held(t)], [t for t in rejected if not held(t)])
    a, r = model.score([t for t in accepted if held(t)]), model.score([t for t in rejected if held(t)])
    if len(a) and len(r) and model.sides:
        values = np.unique(np.concatenate([a, r]))
        edges = np.concatenate([[values[0]], (values[1:] + values[:-1]) / 2])
        good = np.searchsorted(np.sort(r), edges) / len(r) + 1 - np.searchsorted(np.sort(a), edges) / len(a)
        best = edges[good >= good.max() - 1e-12]
        model.threshold = float(best[np.argmin(np.abs(best))])
    return model


def parse(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null; equal lengths: the smaller text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(out)
    return out


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """key, host, path, rule, verdict and score of every row."""
    spark = pages.sparkSession
    host, path = parse(F.col("u"))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("u")).select("page_id", "u", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by = dict(rules)
    says = F.lit(None).cast("string")
    for rule, verdict in rules:
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    rows = rows.withColumn("says", says)
    labelled = rows.where("rule IS NOT NULL").where(F.octet_length("u") <= MAX_BYTES).select(F.col("u").alias("t"), "says").distinct()
    sample, room = [], FIT_TOTAL
    for r in labelled.orderBy(F.xxhash64("t"), "t").limit(fit_rows).collect():
        room -= len(r.t.encode())
        if room >= 0:
            sample.append(r)
    if set(by.values()) - {"allow", "block"}:
        raise ValueError("a rule allows or blocks")
    model = fit([r.t.encode() for r in sample if r.says == "allow"], [r.t.encode() for r in sample if r.says == "block"])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                score = m.score(as_bytes(batch.column("u")))
                own = np.where(score >= m.threshold, "allow", "block")
                said = batch.column("says").to_pylist()
                verdict = pa.array([s or o for s, o in zip(said, own.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), verdict, pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
