"""Odd cases through every operator and stage: long texts, clashing column names, repeated rows, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tensorframe.llm import bpe, common, jaccard, language_model, neighbours, packing, paragraphs, quality, token_counts, toxicity, urls

EXTRA = ["row", "score", "version", "hash", "n_removed", "cls", "first", "chunk", "kept", "failed", "keeper", "a.b", "id"]


def table():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = say(500_000)  # some 3 MB, above every chunk
    near = long.replace(" ", "  ", 3)
    texts = [long, near + " end", say(50), say(50), None, "", "word", say(300) + " " + long[:400], say(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[3], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    df = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(k))
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    df.repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0), (2, 0), (3, 1), (7, 1), (99, 1), (None, 1), (5, None)], "doc_id long, toxic int")


def test_every_operator(spark, docs, labels):
    n = docs.count()
    plain = docs.select("doc_id", "text")
    for run in (
        lambda d: quality.ledger(d),
        lambda d: bpe.digests(d),
        lambda d: token_counts.token_counts(d),
        lambda d: jaccard.jaccard_components(d),
        lambda d: toxicity.score_documents(d, labels),
        lambda d: language_model.lm_scores(d, fit_docs=20),
    ):
        got, want = run(docs), run(plain)
        assert got.count() == n and got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    pieces = packing.pack(docs).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in plain.collect()}
    assert sum(p.length for p in pieces if p.doc_id == 0) == next(p.doc_tokens for p in pieces if p.doc_id == 0) > 500_000
    repeated = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert repeated[4] == repeated[5]


def test_every_carrying_operator(docs, labels):
    found = paragraphs.repeated(docs)
    left = paragraphs.removed(docs, found, "lost words")
    assert left.columns == [*docs.columns, "lost words"] and left.count() == docs.count()
    by = {r.doc_id: r for r in left.select("doc_id", "text", "`lost words`", "`a.b`").collect()}
    assert by[0]["lost words"] == 0 and by[1]["lost words"] >= 499_000 and by[2]["a.b"] == EXTRA.index("a.b")
    assert by[7]["lost words"] >= 32 and by[None]["lost words"] == 0
    for book in (quality.ledger(docs, carry=True), toxicity.score_documents(docs, labels, carry=True)):
        assert book.select("row.*").columns == docs.columns and book.count() == docs.count()


def test_stages(spark, docs, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.where("toxic = 0").write.parquet(f"{tmp_path}/labels.parquet")  # so few would say little about toxicity
    now = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or now.columns == docs.columns
    assert {0, 2, 3} <= {r.doc_id for r in now.collect()} and not {1, 4, 5, 6} & {r.doc_id for r in now.collect()}


@pytest.mark.parametrize("marked", [False, True])
def test_stages_on_empty_tables(spark, labels, tmp_path, marked):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([] if marked else [(1, "some ten words that no rule rejects in this one text", "en", "s", 3)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    (labels if marked else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == (set() if marked else {1})


def test_toxic_texts_above_the_usual_size(spark, monkeypatch):
    """Where all texts of a class are long, they are fitted all the same, within the total."""
    rng = random.Random(22)
    rows, marks = [], []
    for i in range(120):
        w = [rng.choice(["aren", "tolin", "breda", "sund", "menk", "oral"]) for _ in range(400)]
        for _ in range(40 * (i % 2)):
            w[rng.randrange(400)] = "grumfel"
        rows.append((i, " ".join(w)))
        marks.append((i, i % 2))
    monkeypatch.setattr(toxicity, "FIT_BYTES", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_documents(docs, spark.createDataFrame(marks + [(500 + i, 1) for i in range(3000)], "doc_id long, toxic int")).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got) >= 110


def test_urls_are_judged_whole(spark):
    pages = [(1, "b1.net/es/spam"), (2, "http://x.org/?u=http://b1.net/es/spam"), (3, "http://x.org/"), (4, "a\0b"), (5, "http://x.org/" + "q" * 100_000), (6, ""), (7, None)]
    pages += [(100 + i, f"http://good{i}.com/page?id={i}") for i in range(40)] + [(200 + i, f"http://bad{i}.net/es/spam?u=es/spam") for i in range(40)]
    pages += [pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("u", F.lit(2)).withColumn("a.b", F.lit(3))
    got = {r.page_id: r for r in urls.url_filter(df).collect()}
    assert got[1].score < 0 and got[2].score < got[3].score and got[6].score == got[7].score == 0
    assert urls.url_filter(df).count() == len(pages) and got[5].host == "x.org"


def test_neighbours_with_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("v", F.lit(2)).withColumn("id", F.lit(0))
    got = neighbours.nearest(df).collect()
    assert len(got) == 60 and {r.query_id for r in got} == {0, 20, 40}


def test_settled_inputs(spark, docs):
    """What comes out of a shuffle is written before it is read twice."""
    assert common.settled(docs) is docs
    moved = docs.select("doc_id", "text").repartition(3)
    again = common.settled(moved)
    assert again is not moved and again.count() == docs.count()
    assert sorted(map(str, token_counts.token_counts(moved).collect())) == sorted(map(str, token_counts.token_counts(docs).collect()))


def test_the_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file:")
