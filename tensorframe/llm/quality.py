"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; ``ledger`` stores the measurements and one bit for
each rule that failed. A policy is a named version with a mask of rules; applying one, or
comparing many, reads the ledger only. ``ablation`` counts over distinct bit patterns, of which
there are at most 2 to the number of rules.

Defined cases: null text has no words; a null doc_id is kept; repeated rows are judged one by one;
a value right at a rule's bound passes; a text of any length is measured whole; an empty table has
no rows; other columns are ignored, or carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, chunks, cut, mix, windows, word_hashes, words_of

SYMBOLS = b"#*$%&|<>"
#: name, SQL condition on the measurements that is true when the rule fails; the place is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("long_words", "word_chars > 24 * n_words"),
    ("dup_lines", "n_dup_lines > 0 AND 2 * n_dup_lines > n_lines"),
]
#: version: the rules that count. Earlier versions stay, so that old verdicts can be computed again.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "long_words"),
    "strict": tuple(name for name, _ in RULES),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    words, codes, lens = words_of(texts)
    n, at = len(texts), np.repeat(np.arange(len(texts)), lens)
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
    signs = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int64, len(words))
    total = lambda x: np.bincount(at, weights=x, minlength=n).astype(np.int64)
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    h, first, doc = windows(word_hashes(words)[codes], lens, 5)
    h = mix(h ^ mix(doc + 1))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 5, -1)
    return {"n_words": lens, "word_chars": total(chars[codes]), "n_symbols": total(signs[codes]), "n_lines": lines, "n_dup_lines": dups, "n_repeat_words": total(np.cumsum(edge[:-1]) > 0)}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, texts in chunks(batches):
        out = table if "row" in table.column_names else table.drop_columns(["text"])
        for k, v in measure(texts).items():
            out = out.append_column(k, pa.array(v, pa.int64()))
        yield from out.to_batches()


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, the measurements, and failed (bit i: rule i failed).

    With carry, the struct ``row`` with all columns of docs takes the place of doc_id.
    """
    if carry:
        whole, schema = carried(docs, MEASURES)
        got = whole.mapInArrow(_measured, schema)
    else:
        got = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
    bits = F.lit(0).cast("long")
    for i, (_, sql) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(1 << i)).otherwise(0).cast("long"))
    return got.withColumn("failed", bits)


def mask(policy: str, rules: list[tuple[str, str]] = RULES, policies: dict = POLICIES) -> int:
    return sum(1 << i for i, (name, _) in enumerate(rules) if name in policies[policy])


def apply_policy(book: DataFrame, policy: str, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablation(book: DataFrame, policy: str, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects."""
    m = mask(policy, rules)
    patterns = book.groupBy((F.col("failed").bitwiseAND(F.lit(m))).alias("bits")).agg(F.count("*").alias("n"))
    own = [(i, name) for i, (name, _) in enumerate(rules) if m >> i & 1]
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in own])
    return (
        patterns.select("n", "bits", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        )
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written once: policies and ablations read it and never the texts."""
    return cut(ledger(docs), "ledger")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of policy v1, with all that the ledger holds: measurements and the bits of failed rules."""
    book = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = mask("base")
    return apply_policy(book, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "n_lines", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the strictest policy, how many documents fail it, and how many fail no other."""
    return ablation(stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "strict")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i+4], ' ')) AS c FROM p),
m AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN m ON w.r = m.r),
b AS (SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(5 * n_symbols > n_words AS BIGINT)
             + 8 * CAST(word_chars > 24 * n_words AS BIGINT) + 16 * CAST(n_dup_lines > 0 AND 2 * n_dup_lines > n_lines AS BIGINT) AS failed FROM f)
"""
ABLATION_SQL = OP5_SQL + r"""
SELECT rule, CAST(sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fails, CAST(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END) AS BIGINT) AS fails_alone
FROM b CROSS JOIN (VALUES ('few_words', 1), ('repeats', 2), ('symbols', 4), ('long_words', 8), ('dup_lines', 16)) r(rule, bit) GROUP BY rule
"""
OP5_SQL += r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       failed & 15 = 0 AS kept
FROM b
"""
