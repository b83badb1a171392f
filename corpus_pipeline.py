"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents, whatever
columns these are besides doc_id and text.

Defined cases: rows without a doc_id stay until a stage rejects their text; rows with a null or
blank text go with the quality rules; texts of any length are read whole; ties are settled by the
smaller id; rows repeated in full are one group of near-duplicates; an empty table stays empty, and
without labels of both classes no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.llm import common, jaccard, packing, paragraphs, quality, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text passes policy v1 of the rules."""
    return quality.apply_policy(quality.ledger(docs, carry=True), "v1").where("kept").select("row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with a toxicity score below a half, learned from the labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score_documents(docs, labels, carry=True).where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest id, one without an id last.

    Near-duplicates have sets of five-word shingles with a Jaccard similarity of 0.8 or more. Rows
    without a word stay as they are. Of rows that tie, with one id, the smallest hash of the text
    stays, and of rows with the same id and text the greatest.
    """
    found = common.cut(jaccard.jaccard_members(docs, num=80, den=100, shingle=5), "groups")
    chosen = found.where("root IS NOT NULL").groupBy("root").agg(common.least_row().alias("r")).select("r.id", F.col("r.version").alias("of"))
    whole, _ = common.carried(docs)
    rows = whole.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("version"))
    again = rows.join(chosen, common.same_row(rows, chosen), "left_semi")
    blank = rows.where("row.text IS NULL OR NOT row.text RLIKE '[^ \\t-\\r]'").select("row")
    twice = common.cut(found.where("root IS NOT NULL").groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("version").alias("of")), "twice")
    if twice.isEmpty():
        return again.select("row").unionAll(blank).select("row.*")
    several = again.join(twice, common.same_row(again, twice), "left_semi").groupBy("doc_id", "version").agg(F.max("row").alias("row"))
    once = again.join(twice, common.same_row(again, twice), "left_anti")
    return once.select("row").unionAll(several.select("row")).unionAll(blank).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that an earlier document holds; a document left without a word goes."""
    count = "_words_lost"
    while count in docs.columns:
        count += "_"
    out = paragraphs.removed(docs, paragraphs.repeated(docs), count)
    left = out.where(F.expr(f"{count} = 0 OR text RLIKE '[^ \\t-\\r]'"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; smaller chunks, as workers still hold memory of earlier stages."""
    return packing.pack(docs, chunk=1 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack_documents),
]
#: toxicity and packing can't be told in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
