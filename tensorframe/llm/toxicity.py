"""Toxic spans with a linear-chain conditional random field.

Labels are given per document, so token labels come from them: a feature (a word, or the first
or last letters of one) marks a token of a toxic document when its rate among the tokens of
toxic documents is many times its rate in the others. The chain is fitted to these tags;
forward-backward marginals give each token's probability, which aggregate to the document's
score through a logistic curve fitted on documents that the chain has not seen. Tokens with a
probability of a half or more are the offending spans.

Fitting takes at most ``FIT_DOCS`` labelled documents of each class, of those that are there: the
first by hash of the id, texts of more than ``FIT_BYTES`` bytes last, until ``FIT_TOTAL`` bytes
are reached. Scoring reads every whole text.

Defined cases: null or empty text has no tokens and gets the curve's value there; a null label
counts for nothing; several labels of one document count as their largest; without labelled
documents of both classes every score is 0; repeated rows are scored each, alike, and fitted once;
of equal hashes the smaller id is fitted; a text of any length is scored whole; an empty table has
no rows; other columns are ignored, or carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, carried, chunks, crc_mod, cut_words, ranges, starts, trim, words_of

FIT_DOCS, FIT_BYTES, FIT_TOTAL, BUCKETS, ROUNDS = 1500, 32_768, 24 << 20, 1 << 18, 30
RATIO, LEAST_DOCS, STEP, CACHE_WORDS = 6.0, 4, 128, 150_000
ROWS, TOKENS = 1 << 15, 1 << 17
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGES = re.compile(r"^\W+|\W+$")


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of each word: the bare lower-case word, its first 3 to 8 letters and its last 3 and 4; 0 stands for none."""
    out = np.zeros((len(words), 9), np.int32)
    for i, w in enumerate(words):
        t = EDGES.sub("", w.decode("utf-8", "replace").lower())
        if not t:
            continue
        own = ["w" + t, *(f"{k}{t[:k]}" for k in range(3, min(9, len(t) + 1))), *(f"-{t[-k:]}" for k in (3, 4) if len(t) > k)]
        out[i, : len(own)] = [crc32(x.encode()) % (BUCKETS - 1) + 1 for x in own]
    return out


def _scan(e: np.ndarray, first: np.ndarray, start: np.ndarray, step) -> np.ndarray:
    """r[t] = step(r[t-1]) * e[t], and start[t] where a text begins: in columns of STEP tokens.

    Columns begin with a guess; they run again with what their neighbour ended in until none changes.
    """
    n = len(e)
    pad = -n % STEP
    grid = lambda x, v: np.ascontiguousarray(np.append(x, np.full(pad, v, x.dtype)).reshape(-1, STEP).T)
    e, first, start = grid(e, 1.0), grid(first, True), grid(start, 1.0)
    r = np.empty_like(e)
    begin = np.ones(e.shape[1])
    todo = np.arange(e.shape[1])
    while len(todo):
        now = begin[todo]
        a, b, c = (e, first, start) if len(todo) == e.shape[1] else (e[:, todo], first[:, todo], start[:, todo])
        for t in range(STEP):
            now = np.where(b[t], c[t], step(now) * a[t])
            r[t, todo] = now
        after = np.append(1.0, r[-1, :-1])
        todo = np.flatnonzero(np.abs(after - begin) > 1e-12 * np.abs(begin))
        begin = after
    return r.T.reshape(-1)[:n]


@dataclass
class Crf:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -4.0
    #: log weights of the steps 0-1, 1-0 and 1-1 against 0-0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(3))
    curve: np.ndarray | None = None
    scale: np.ndarray | None = None

    def logits(self, feats: np.ndarray) -> np.ndarray:
        out = np.empty(len(feats))
        for i in range(0, len(feats), ROWS):  # in blocks, which bounds memory
            out[i : i + ROWS] = self.weights[feats[i : i + ROWS]].sum(1)
        return out

    def marginals(self, u: np.ndarray, lens: np.ndarray):
        """Probability of tag 1 of each token; forward and backward ratios of tag 1 to tag 0."""
        a, b, c = np.exp(self.steps)
        e = np.exp(np.clip(u + self.bias, -30, 30))
        first, last = np.zeros(len(u), bool), np.zeros(len(u), bool)
        at = starts(lens)
        some = lens > 0
        first[at[:-1][some]] = last[at[1:][some] - 1] = True
        r = _scan(e, first, e, lambda x: (a + x * c) / (1 + x * b))
        # backward: q[t] = (b + c e[t+1] q[t+1]) / (1 + a e[t+1] q[t+1]); g[t] = e[t] q[t]
        g = _scan(e[::-1], last[::-1], e[::-1], lambda x: (b + c * x) / (1 + a * x))[::-1]
        q = g / e
        return r * q / (1 + r * q), r, g, first

    def summary(self, p: np.ndarray, lens: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(lens)), lens)
        total = np.bincount(doc, weights=p, minlength=len(lens))
        most = np.zeros(len(lens))
        np.maximum.at(most, doc, p)
        return np.stack([np.log1p(total), most, total / np.sqrt(lens + 1.0), np.log1p(lens)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        z = (x - self.scale[0]) / self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z @ self.curve[1:] + self.curve[0], -500, 500)))


def runs(lens: np.ndarray, most: int) -> Iterator[slice]:
    """Texts in runs of at most ``most`` tokens; a longer one alone."""
    at, first = starts(lens), 0
    while first < len(lens):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield slice(first, last)
        first = last


def fit(texts: list[bytes], toxic: np.ndarray, prior: float) -> Crf:
    """toxic: 0 or 1 of each text; prior: share of toxic documents among all that are labelled.

    It runs in the driver, so what it holds for each token of the sample is a number; all else goes some texts at a time.
    """
    model = Crf()
    seen: dict[bytes, int] = {}
    keep = [i for i, t in enumerate(texts) if seen.setdefault(t, i) == i]
    texts, toxic = [texts[i] for i in keep], toxic[keep].astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return model
    held = np.array([crc32(b"split" + t) % 4 == 0 for t in texts])
    words, codes, lens = cut_words(texts)
    codes = codes.astype(np.int32)
    feats = np.concatenate([np.zeros((0, 9), np.int32), *(features(words[i : i + ROWS].to_pylist()) for i in range(0, len(words), ROWS))])
    at = starts(lens)
    # rates of the features among the tokens of either class, at most three in a document
    docs_of, rate, tokens = np.zeros((2, BUCKETS), np.int64), np.zeros((2, BUCKETS)), [0, 0]
    for side in (0, 1):
        some = np.flatnonzero(~held & (toxic == side))
        for part in runs(lens[some], ROWS):
            mine = some[part]
            doc = np.repeat(np.arange(len(mine)), lens[mine])
            key, n = np.unique((doc[:, None] * np.int64(BUCKETS) + feats[codes[ranges(at[mine], lens[mine])]]).ravel(), return_counts=True)
            docs_of[side] += np.bincount(key % BUCKETS, minlength=BUCKETS)
            rate[side] += np.bincount(key % BUCKETS, weights=np.minimum(n, 3), minlength=BUCKETS)
            tokens[side] += len(doc)
        rate[side] = (rate[side] + 0.5) / (tokens[side] + 1)
    lexicon = (docs_of[1] >= LEAST_DOCS) & (rate[1] > RATIO * rate[0]) & (docs_of[1] > 3 * docs_of[0])
    lexicon[0] = False
    marks = np.concatenate([np.zeros(0, bool), *(lexicon[feats[i : i + ROWS]].any(1) for i in range(0, len(feats), ROWS))])

    def fitting():
        """Codes, tags, tokens of each text and places after the first of a text, of some texts at a time."""
        some = np.flatnonzero(~held)
        for part in runs(lens[some], TOKENS):
            mine = some[part]
            c, inner = codes[ranges(at[mine], lens[mine])], np.ones(int(lens[mine].sum()), bool)
            inner[starts(lens[mine])[:-1][lens[mine] > 0]] = False
            yield c, (marks[c] & np.repeat(toxic[mine] == 1, lens[mine])).astype(float), lens[mine], np.flatnonzero(inner)

    pairs, total = np.zeros(3), 0.0
    for _, y, _, i in fitting():
        pairs += [((y[i - 1] == s) & (y[i] == t)).sum() for s, t in ((0, 1), (1, 0), (1, 1))]
        total += y.sum()
    total = max(total, 1.0)
    g2, g2s, g2b = np.full(BUCKETS, 1e-6), np.full(3, 1e-6), 1e-6
    for _ in range(ROUNDS):
        told, by_word, grad, grad_s = model.logits(feats), np.zeros(len(feats)), np.zeros(BUCKETS), np.zeros(3)
        a, b, c = np.exp(model.steps)
        for own, y, n, i in fitting():
            p, r, g, _ = model.marginals(told[own], n)
            by_word += np.bincount(own, weights=p - y, minlength=len(feats))
            joint = np.stack([a * g[i], r[i - 1] * b, r[i - 1] * c * g[i]])
            grad_s += (joint / (1 + joint.sum(0))).sum(1)
        for i in range(0, len(feats), ROWS):
            grad += np.bincount(feats[i : i + ROWS].ravel(), weights=np.repeat(by_word[i : i + ROWS], feats.shape[1]), minlength=BUCKETS)
        grad = grad / total + 2e-5 * model.weights
        grad[0] = 0
        grad_s = (grad_s - pairs) / total + 1e-3 * model.steps
        grad_b = by_word.sum() / total
        g2, g2s, g2b = g2 + grad**2, g2s + grad_s**2, g2b + grad_b**2
        model.weights -= 0.5 * grad / np.sqrt(g2)
        model.steps = np.clip(model.steps - 0.2 * grad_s / np.sqrt(g2s), -4, 4)
        model.bias -= 0.3 * grad_b / np.sqrt(g2b)
    told = model.logits(feats)
    x = np.concatenate([model.summary(model.marginals(told[codes[at[k.start] : at[k.stop]]], lens[k])[0], lens[k]) for k in runs(lens, TOKENS)])
    fitted = held if 5 < toxic[held].sum() < held.sum() - 5 else np.ones(len(texts), bool)
    model.scale = np.stack([x[fitted].mean(0), x[fitted].std(0) + 1e-6])
    z = np.column_stack([np.ones(fitted.sum()), (x[fitted] - model.scale[0]) / model.scale[1]])
    t = toxic[fitted]
    weight = np.where(t == 1, prior / t.mean(), (1 - prior) / (1 - t.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps
        q = 1 / (1 + np.exp(-z @ w))
        h = (z * (weight * q * (1 - q))[:, None]).T @ z + 0.3 * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (weight * (q - t)) + 0.3 * w)
    model.curve = w
    return model


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Crf:
    """docs: doc_id, text; labels: doc_id, toxic. Rows of remainder 0 are never read for labels."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # only documents that are there; of rows that share an id the shortest text counts
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    there = docs.select("doc_id", size.alias("size")).join(own, "doc_id").groupBy("doc_id").agg(F.min("size").alias("size"), F.max("toxic").alias("toxic"))
    counts, chosen = {}, []
    for side in (0, 1):
        part = there.where(F.col("toxic") == side)
        counts[side] = part.count()
        room = FIT_TOTAL
        for r in part.orderBy(F.col("size") > FIT_BYTES, F.xxhash64("doc_id"), "doc_id").limit(fit_docs).collect():
            if room > 0:  # at least one, and no more than FIT_TOTAL before the last
                chosen.append((r.doc_id, side))
                room -= r.size
    if not counts[0] or not counts[1]:
        return Crf()
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, there.select("doc_id", "toxic").schema)
    # at most 2 * fit_docs ids
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(size.alias("size"), "text")).alias("r"))
    rows = found.select("doc_id", "toxic", "r.text").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())
    texts, toxic = as_bytes(rows.column("text")), rows.column("toxic").to_numpy()[order]
    del rows
    texts = [texts[i] for i in order]
    trim()
    model = fit(texts, toxic, counts[1] / (counts[0] + counts[1]))
    del texts
    trim()
    return model


def spans_of(text: bytes, flagged: np.ndarray) -> list[dict]:
    """Code-point offsets of the runs of flagged words."""
    places = [m.span() for m in WORD.finditer(text)]
    out = []
    for i in np.flatnonzero(flagged).tolist():
        if i and flagged[i - 1]:
            out[-1][1] = places[i][1]
        else:
            out.append([*places[i]])
    done, at, got = 0, 0, []
    for a, b in out:
        at += len(text[done:a].decode("utf-8", "replace"))
        end = at + len(text[a:b].decode("utf-8", "replace"))
        got.append({"start": at, "end": end})
        done, at = b, end
    return got


def tag(docs: DataFrame, model: Crf, carry: bool = False) -> DataFrame:
    """doc_id, score and spans (start, end of offending text) of every whole text.

    With carry, the struct ``row`` with all columns of docs takes the place of doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[bytes, float] = {}
        for table, texts in chunks(batches, limit=2 << 20):
            words, codes, lens = words_of(texts)
            if len(known) > CACHE_WORDS:
                known.clear()
            new = [w for w in words if w not in known]
            known.update(zip(new, m.logits(features(new)).tolist()))
            u = np.fromiter(map(known.__getitem__, words), float, len(words))
            p, *_ = m.marginals(u[codes], lens)
            score = m.score(m.summary(p, lens))
            at, hot = starts(lens), p >= 0.5
            some = set(np.unique(np.searchsorted(at, np.flatnonzero(hot), side="right") - 1).tolist())
            spans = [spans_of(t, hot[at[i] : at[i + 1]]) if i in some else [] for i, t in enumerate(texts)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield from table.select(["row" if carry else "doc_id"]).append_column("score", pa.array(score)).append_column("spans", pa.array(spans, kind)).to_batches()

    out = "score double, spans array<struct<start: int, end: int>>"
    if carry:
        whole, schema = carried(docs, out)
        return whole.mapInArrow(run, schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {out}")


def score_documents(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    return tag(docs, train(docs, labels), carry)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(docs, labels).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
