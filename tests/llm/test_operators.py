"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tensorframe.llm import bpe, common, jaccard, language_model, linkage, neighbours, packing, paragraphs, quality, token_counts, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().translate(common.BYTES_LOWER).split()


def corpus():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(200), say(60)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), say(90) + " " + passage + " " + say(30), say(20) + "\n" + passage + "\n" + say(80), "", None, " \n\t", "one", "one two", "one  TWO", "x " * 300, "<|endoftext|> a\u3000b \u00a0 it's \u65e5\u672c 12 !!", "wow ### &&& " * 20]
    texts += [say(rng.randint(5, 120)) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    for r in quality.ledger(docs).join(docs.selectExpr("doc_id AS d", "text").distinct(), [common.F.col("doc_id") == common.F.col("d")]).collect():
        w = (r.text or "").encode().split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
    book = quality.apply_policy(quality.ledger(docs, carry=True), "v1")
    assert book.select("row.*").columns == docs.columns and book.count() == docs.count()
    cut = {r.rule: (r.fails, r.fails_alone) for r in quality.ablation(quality.ledger(docs), "v1").collect()}
    assert cut["few_words"][0] >= cut["few_words"][1] > 0 and quality.ledger(none).count() == 0


def test_bpe_and_counts(docs, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in bpe.digests(docs).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counts = token_counts.token_counts(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in counts) == sorted((str(r.doc_id), len(want[r.doc_id]), len(texts[r.doc_id].encode())) for r in docs.collect())
    assert {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_ids(docs)).collect()} == texts
    assert bpe.digests(none).count() == token_counts.token_counts(none).count() == 0


def test_packing(docs, none):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in docs.collect() if r.doc_id != 3]
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows}
    own, sequences = defaultdict(list), defaultdict(list)
    for p in packing.pack(docs.where("doc_id IS NULL OR doc_id <> 3"), length=64, partitions=2).collect():
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        own[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {k: sum(n for _, n in v) for k, v in own.items()} == {k: len(v) for k, v in want.items()}
    for part in [*own.values(), *sequences.values()]:
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(part))) and min(part)[0] == 0
    assert all((n := sum(x for _, x in v)) <= 64 and n & (n - 1) == 0 for v in sequences.values())
    assert packing.pack(none).count() == 0
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def closure(ids, links):
    comp = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def linked_sets(rows):
    """Component (least id that isn't null) of each row (id, words), by all pairs."""
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()) for _, w in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    root = closure(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), str(least.get(root[i]))) for i in range(len(rows))), links


def test_jaccard(docs, none):
    want, links = linked_sets([(r.doc_id, words(r.text)) for r in docs.collect()])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(docs).collect())
    assert got == want and len(links) > 2
    assert jaccard.jaccard_components(none).count() == 0


def test_rows_without_an_id_bridge_others(spark):
    """1 and 2 are linked only through a row without an id; OP10_SQL says the same."""
    import duckdb

    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    left, right = list(base), list(base)
    for k in (20, 40):
        left[k] = f"l{k}"
    for k in (120, 160):
        right[k] = f"r{k}"
    rows = [(1, " ".join(left)), (None, " ".join(base)), (2, " ".join(right)), (3, "one"), (None, "one"), (None, None)]
    want, links = linked_sets([(i, words(t)) for i, t in rows])
    assert sorted(links) == [(0, 1), (1, 2), (3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(docs).collect())
    documents = docs.toArrow()  # read by name below
    assert documents.num_rows == len(rows)
    sql = sorted((str(i), n, str(c)) for i, n, c in duckdb.sql(jaccard.OP10_SQL).fetchall())
    assert got == want == sql


@pytest.mark.parametrize("num", [90, 80])
def test_signatures(num):
    """Alike sets share a signature, at the largest difference that the similarity allows and below, down to the smallest sets."""
    rng = np.random.default_rng(num)
    pairs = 0
    for n in [*range(4, 40), *range(40, 200, 7), 400, 1000]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = int(len(x) * (100 - num) / num)  # elements added, or taken and added
            lost, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
            y = np.unique(np.append(rng.choice(x, len(x) - lost, replace=False), rng.integers(0, 2**63, new).astype(np.uint64)))
            if len(y) and 100 * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)) and (lost or new):
                sig, owner = jaccard.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), num, 100)
                assert set(sig[owner == 0]) & set(sig[owner == 1]), (n, lost, new)
                pairs += 1
    assert pairs > 150


def test_few_meet_by_chance():
    """Unlike sets hardly ever share a signature."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(150, 160, 400)
    sig, owner = jaccard.signatures(rng.integers(0, 2**63, sizes.sum()).astype(np.uint64), sizes, 80, 100)
    _, n = np.unique(sig, return_counts=True)
    assert (n > 1).sum() <= 6 and len(np.unique(owner)) == 400  # of some 36,000


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    want = closure(range(60), edges)
    got = {r.node: r.comp for r in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_paragraphs(docs, none):
    found = paragraphs.repeated(docs)
    comp = {r.doc_id: r.component_id for r in paragraphs.clusters(found).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    left = paragraphs.removed(docs, found)
    assert left.columns == [*docs.columns, "n_removed"] and left.count() == docs.count()
    seen = defaultdict(set)
    for r in left.where("doc_id IS NOT NULL").collect():
        w = words(r.text)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(r.doc_id)
    assert all(len(v) == 1 for v in seen.values())
    assert paragraphs.repeated(none).count() == 0 and paragraphs.tune(0.8, 0.99) == (7, 3)


def test_a_passage_stays_somewhere(spark):
    """A line that goes with its near copy takes a passage along; whoever else holds that keeps it."""
    rng = random.Random(15)
    say = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    line, passage = say(200), say(40)
    near = [*line[:200], *passage]
    rows = [(1, " ".join([*line, *say(3)])), (5, " ".join(near)), (9, " ".join([*say(30), *passage, *say(30)]))]
    rows += [(20, " ".join(say(60))), (21, " ".join(rows[-1][1].split()[:30] + say(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    left = {r.doc_id: r for r in paragraphs.removed(docs, paragraphs.repeated(docs)).collect()}
    assert left[5].n_removed == 240 and left[9].n_removed == 0 and left[1].n_removed == 0
    held = {tuple(w[k : k + 18]) for r in left.values() for w in [r.text.split()] for k in range(len(w) - 17)}
    assert all(tuple(passage[k : k + 18]) in held for k in range(23))


def test_versions_of_a_document(spark):
    """Rows that share an id have runs of their own texts."""
    rng = random.Random(16)
    say = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    passage = say(60)
    rows = [(1, say(20) + " " + passage), (2, passage + " " + say(40)), (2, "three words only"), (2, passage + " " + say(40)), (3, "three words only"), (4, None)]
    rows.append(rows[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated(docs)
    left = sorted((r.doc_id, (r.text or "")[:12], r.n_removed) for r in paragraphs.removed(docs, found).collect())
    assert [x[2] for x in left if x[0] == 2] == [60, 60, 60, 0] or sorted(x[2] for x in left if x[0] == 2) == [0, 60, 60, 60]
    assert all(x[2] == 0 for x in left if x[0] != 2)


def test_copies_go_whole_without_windows(spark):
    rng = random.Random(17)
    text = "\n".join(" ".join(f"c{rng.randrange(10**9)}" for _ in range(n)) for n in (3, 40, 7))
    docs = spark.createDataFrame([(k, text) for k in (7, 3, 5)] + [(9, "few words"), (8, "few words")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.text) for r in paragraphs.removed(docs, paragraphs.repeated(docs)).collect()}
    assert got == {3: (0, text), 5: (50, ""), 7: (50, ""), 8: (0, "few words"), 9: (0, "few words")}


def test_short_lines_make_paragraphs():
    lens, owner = np.array([5, 9, 8, 30, 4, 4, 25, 10, 10, 10]), np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 2])
    part, head = paragraphs.blocks(lens, owner)
    assert part.tolist() == [0, 0, 0, 1, 2, 2, 3, 4, 4, 5] and head.tolist() == [0, 3, 4, 6, 7, 9]


def test_lines_against_all_pairs(spark):
    """Clusters of lines by banding are those of all pairs with a similarity of 0.8 or more."""
    rng = random.Random(18)
    texts = []
    for _ in range(12):
        base = [f"l{rng.randrange(10**9)}" for _ in range(rng.randint(60, 120))]
        texts.append(base)
        for changes in (1, 2, 3, 12):
            other = list(base)
            for _ in range(changes):
                other[rng.randrange(len(other))] = f"l{rng.randrange(10**9)}"
            texts.append(other)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = closure(range(len(texts)), links)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in paragraphs.removed(docs, paragraphs.repeated(docs)).collect() if not r.text}
    assert gone >= {i for i, c in want.items() if c != i} and len(links) > 15


def test_passages_go_whole(spark):
    """Any 32 equal words or more are removed from the later text, with no word left over and none too many."""
    rng, at, rows = random.Random(12), 0, []
    say = lambda n: [str(rng.randrange(10**9)) for _ in range(n)]
    want = {}
    for n in (16, 17, *([32] * 12), *([33, 34, 35, 40, 51, 60, 150] * 3)):
        passage = say(n)
        for late in (0, 1):
            before = rng.randint(1, 60)
            rows.append((at, " ".join([*say(before), *passage, *say(rng.randint(1, 60))])))
            want[at] = [(before, n)] if late and n >= 32 else []
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in paragraphs.repeated(docs).collect()}
    assert {i: got.get(i, []) for i in want} == want


def test_language_model(docs, none):
    got = language_model.lm_scores(docs, fit_docs=20).collect()
    held = lambda i: crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in docs.collect() if not held(r.doc_id) for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = [*words(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r.score < 0
    assert language_model.lm_scores(none).count() == 0


class Letters:
    """Stands for a vocabulary of eight letters, space among them, and the end."""

    size = 9

    def encode_raw(self, data, lens):
        return np.array([0 if c == 32 else 1 + c % 7 for c in data.tolist()]), lens


def little(seed, texts=6):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)).encode() for n in [0, 1, 150, 40, 77, *[rng.randint(5, 90) for _ in range(texts)]]]
    return language_model.split_words(texts)


def test_spelling_is_a_distribution():
    words_, codes, lens = little(1)
    _, spelling = language_model.begin(Letters(), words_, codes, lens, steps=2)
    n = spelling.size + 1
    for before in range(n):
        p = spelling.spare[before] * spelling.single.sum(0)
        p = p + spelling.told[spelling.keys // n == before].sum(0)
        np.testing.assert_allclose(p, 1, rtol=1e-4)
    some = language_model.Spelling.of(9, spelling.keys[:5], np.ones((5, 8)), np.ones(8), np.full(8, 9.0), np.full((n, 8), 2.0), np.full((n, 8), 1.0), np.full((n, 8), 3.0))
    for before in range(n):  # pairs that aren't kept leave their mass to single subwords
        np.testing.assert_allclose(some.spare[before] * some.single.sum(0) + some.told[some.keys // n == before].sum(0), 1, rtol=1e-4)


def test_scores_against_loops():
    """Each token's probability from the definition: attention over its window, mixtures that spell its word."""
    words_, codes, lens = little(2)
    bpe, lm = Letters(), language_model
    model, spelling = lm.begin(bpe, words_, codes, lens, steps=4)
    model.distance = np.linspace(1, -1, lm.WIDTH).astype(np.float32)
    ids, n = lm.subwords(bpe, words_)
    got = lm.score(model, (ids, n, *lm.likely(spelling.logs(ids, n))), codes, lens)
    assert lm.WIDTH >= 64 and len(got) == len(codes) + len(lens)
    at = common.starts(n)
    subs = [ids[a:b].tolist() for a, b in itertools.pairwise(at)]
    pair = {k: p for k, p in zip(spelling.keys.tolist(), spelling.told.astype(float))}

    def spelled(word):
        if word == len(subs) - 1:
            return spelling.end.astype(float)
        p = 1 - spelling.end.astype(float)
        for x, y in itertools.pairwise([spelling.size, *subs[word], spelling.size]):
            p = p * (pair.get(x * (spelling.size + 1) + y, 0) + spelling.spare[x].astype(float) * spelling.single[y])
        return p

    d, done = lm.MIXES, 0
    vec = [model.table[x].astype(float).mean(0) for x in subs]
    for a, b in itertools.pairwise(common.starts(lens)):
        text = [*codes[a:b].tolist(), len(subs) - 1]
        inputs = [len(subs) - 1, *text[:-1]]
        for t, word in enumerate(text):
            first = max(0, t // lm.STRIDE * lm.STRIDE - (lm.WIDTH - lm.STRIDE))
            assert t - first >= min(t, lm.WIDTH - lm.STRIDE)  # each sees half a window
            q = vec[inputs[t]][:d]
            w = [math.exp(q @ vec[inputs[j]][d : 2 * d] + model.distance[t - j]) for j in range(first, t + 1)]
            h = vec[inputs[t]][3 * d :] + sum(x * vec[inputs[j]][2 * d : 3 * d] for x, j in zip(w, range(first, t + 1))) / sum(w)
            z = np.exp(h @ model.mixing + model.offset)
            assert math.isclose(got[done], math.log10(z @ spelled(word) / z.sum()), rel_tol=1e-3, abs_tol=1e-3)
            done += 1


def test_learning_raises_the_likelihood():
    words_, codes, lens = little(3, 40)
    bpe, lm = Letters(), language_model
    model, spelling = lm.begin(bpe, words_, codes, lens, steps=0)
    ids, n = lm.subwords(bpe, words_)
    told = (ids, n, *lm.likely(spelling.logs(ids, n)))
    learner = lm.Learner(model, spelling)
    before = lm.score(model, told, codes, lens).sum()
    share = sum(learner.read(told, codes, lens, 1) for _ in range(1))
    np.testing.assert_allclose(share.sum(), len(codes) + len(lens), rtol=1e-4)
    for _ in range(20):
        learner.read(told, codes, lens, 1)
    assert lm.score(learner.m, told, codes, lens).sum() > before
    learner.add(ids, n, share)
    keys, counts = learner.counts()
    new = lm.Spelling.of(9, keys, counts, learner.ends, learner.tokens)
    assert math.isclose(counts.sum(), share[:-1].sum(1) @ (n[:-1] + 1), rel_tol=1e-4)
    assert lm.score(model, (ids, n, *lm.likely(new.logs(ids, n))), codes, lens).sum() > before - 1e-3 * abs(before)
    mean = lm.mean_of([(p, x) for p, x in lm.blobs(learner.m, 3.0)], model)
    np.testing.assert_allclose(mean.table, learner.m.table, rtol=1e-5, atol=1e-7)


def test_pairs_beyond_the_limit(spark):
    names = [f"n{k}" for k in range(language_model.MIXES)]
    rows = [(k, *[float(k % 5 + 1)] * len(names)) for k in range(40)] + [(-1, *[2.0] * len(names)), (-2, *[9.0] * len(names))]
    pairs = spark.createDataFrame(rows, "pair long, " + ", ".join(f"{x} double" for x in names)).withColumn("all", sum(common.F.col(x) for x in names))
    for most in (1000, 10):
        got = language_model.spelled(pairs, names, 9, most)
        assert len(got.keys) == min(most, 40) and (most > 40 or got.keys.tolist() == [4, 9, 14, 19, 24, 29, 34, 39, 3, 8] or set(got.keys) == {4, 9, 14, 19, 24, 29, 34, 39, 3, 8})
        for before in range(4):
            np.testing.assert_allclose(got.spare[before] * got.single.sum(0) + got.told[got.keys // 10 == before].sum(0), 1, rtol=1e-4)


def test_toxicity(spark, none):
    rng = random.Random(6)
    clean = ["aren", "tolin", "breda", "sund", "menk", "oral", "pist", "vard"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        w = [rng.choice(clean) for _ in range(40)]
        for _ in range(4 * bad):
            w[rng.randrange(40)] = "Grumf" + rng.choice(clean)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "aren")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [i for i, _ in labels if crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.5
    assert all(rows[i][1][s.start : s.end].startswith("Grumf") for i in held for s in got[i].spans[:1])
    assert toxicity.score_documents(none, marks.limit(0)).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, marks.where("toxic = 1")).collect()} == {0.0}


def test_marginals():
    m = toxicity.Crf()
    m.steps, m.bias = np.array([0.3, -0.7, 1.9]), -0.4
    rng = np.random.default_rng(1)
    lens = np.array([4, 0, 1, 6])
    u = rng.normal(size=lens.sum())
    p, *_ = m.marginals(u, lens)
    step = {(0, 0): 0.0, (0, 1): 0.3, (1, 0): -0.7, (1, 1): 1.9}
    at = 0
    for n in lens:
        total, hit = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(t * (u[at + k] + m.bias) for k, t in enumerate(tags)) + sum(step[x] for x in itertools.pairwise(tags)))
            total, hit = total + w, hit + w * np.array(tags)
        np.testing.assert_allclose(p[at : at + n], hit / total if n else [], rtol=1e-9)
        at += n
    long = rng.normal(size=1000)
    np.testing.assert_allclose(m.marginals(long, np.array([1000]))[0][300:700], m.marginals(long[100:900], np.array([800]))[0][200:600], rtol=1e-6)


def test_urls(spark):
    pages = [(1, "http://A.Com/x?y"), (2, "https://www.example.com/en/1"), (3, "https://m.example.com/en/1#t"), (4, "http://x.net/fr/2"), (5, "nothing"), (6, None), (7, "http://www.example.com"), (8, "ftp://com/"), (9, "http://telecom/"), (None, "http://b.org/z://q")]
    pages += [(100 + i, f"http://good{i}.com/page") for i in range(40)] + [(200 + i, f"http://bad{i}.net/es/spam") for i in range(40)]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == len(pages)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("www.example.com/en/", "allow", "example.com/en/", "block")
    assert got[4].rule == "net/fr/" and got[5].host == got[6].host == got[6].path == "" and got[6].rule is None
    assert got[7].rule is None and got[8].rule == "com/" and got[9].rule is None and got[None].path == "/z://q"
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    m = urls.UrlModel([b"ab"] * 3, [b"zz"], 2)
    assert m.score([b"ab"])[0] > 0 > m.score([b"zz"])[0] and m.score([b""])[0] == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[41].tolist()), (5, x[5].tolist()), (None, (x[0] * 2).tolist())]
    odd = [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0]), (780, [None] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)).collect()
    every = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    hit = total = 0
    for own, (q, v) in enumerate(rows):
        if q is None or q % 20 or q == 40:
            continue
        s = (every * v).sum(1)
        best = sorted((-s[i], ids[i] is None, ids[i]) if ids[i] is not None else (-s[i], True, 0) for i in range(len(rows)) if i != own)[:20]
        found = [(i, score) for _, i, score in sorted(by[q])]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))
        assert all(any(score == s[j] for j, k in enumerate(ids) if k == i) for i, score in found)
        hit += len({i for i, _ in found} & {None if none else i for _, none, i in best})
        total += 20
    assert hit >= 0.9 * total
    assert len(by[40]) == 40 and by[0][0][1] in (None, 0) or (1, None) in [(r, i) for r, i, _ in by[0]]
    few = neighbours.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_equal_vectors_tie_wherever_they_lie():
    """Copies at the end of a block of matrix products can come out an ulp apart; the smaller ids must win."""
    rng = np.random.default_rng(11)
    for trial in range(30):
        x = rng.normal(size=(1000 + trial, 64))
        copies = rng.choice(len(x), 200, replace=False)
        copies[:60] = len(x) - 1 - np.arange(60)
        copies = np.unique(copies)
        x[copies] = x[copies[0]]
        ids = rng.permutation(len(x))
        codes = neighbours.learn(x, 20, len(x))
        box = neighbours.Index(np.arange(len(x)), ids, x, codes)
        _, row, score = box.search(x[copies[:1]] * 1.5, np.array([-1]), 20)
        assert ids[row].tolist() == sorted(ids[copies].tolist())[:20] and len(set(score.tolist())) == 1
        few = neighbours.Index(np.arange(len(x)), ids, x, codes, 20)
        assert len(few.keys) == len(x) - len(copies) + 21
        for own in (-1, copies[np.argmin(ids[copies])], copies[np.argmax(ids[copies])]):
            _, row, score = few.search(x[copies[:1]], np.array([own]), 20)
            assert few.ids[row].tolist() == sorted(i for c, i in zip(copies.tolist(), ids[copies].tolist()) if c != own)[:20]


def test_probing_returns_every_code_within_the_radius():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 32))
    codes = neighbours.learn(x, 20, len(x))
    for _, kind in neighbours.PARTS:
        codes.part = kind
        box = neighbours.Index(np.arange(len(x)), np.arange(len(x)), x, codes)
        code = codes.of(x[:40])
        for radius in (0, 17, 40, 128):
            q, row = box.probe(code, radius)
            whole = np.bitwise_count(code[:, None, :] ^ box.code).sum(2, dtype=int)
            assert sorted(zip(q.tolist(), row.tolist())) == sorted(map(tuple, np.argwhere(whole <= radius).tolist()))


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        assert k == 4 or now.columns == docs.columns
    assert 13 not in kept[0] and 11 not in kept[0] and 7 not in kept[0] and {0, 1, 2, 3, 4} <= kept[0] == kept[1]
    assert {1, 2} & kept[2] == set() and {0, 3, 4} <= kept[2] == kept[3] == kept[4]
    assert pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_near_copies(spark, tmp_path):
    """Four changed words of 200: similarity 0.815 by five-word shingles, 0.886 by three-word ones."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    near, far = list(base), list(base)
    for k in (30, 80, 120, 170):
        near[k] = f"near{k}"
    for k in range(10, 200, 25):
        far[k] = f"far{k}"
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 2}


def test_chain_is_fitted_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    toxic = np.arange(240) % 2
    texts = [b" ".join(b"w%d" % x for x in rng.integers(2000, size=3000)) + (b" vile%d" % (i % 3)) * (9 * t) for i, t in enumerate(toxic.tolist())]
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, toxic, 0.1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 70_000_000  # of some 720,000 tokens
    for size in (1 << 12, 1 << 21):  # whatever is taken at a time
        monkeypatch.setattr(toxicity, "TOKENS", size)
        again = toxicity.fit(texts, toxic, 0.1)
        assert np.allclose(again.weights, model.weights) and np.allclose(again.curve, model.curve)
    assert [list(range(5))[x] for x in toxicity.runs(np.array([3, 0, 9, 1, 1]), 4)] == [[0, 1], [2], [3, 4]]


def test_jaccard_shuffles_a_slice_at_a_time(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(12):  # families whose members are alike, or nearly so
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(5):
            own = base[:]
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert len(set(least)) < len(texts) and any(sets[a] & sets[b] and least[a] != least[b] for a, b in itertools.combinations(range(len(texts)), 2))
    monkeypatch.setattr(linkage, "SLICE_ROWS", 1, raising=False)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = lambda: {(s := found.apply(i)).stageId(): s.shuffleWriteRecords() for found in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for i in range(found.size())}
    before = stages()
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 80, 100, 5).collect()} == dict(enumerate(least))
    written = max(n for s, n in stages().items() if s not in before)
    assert written < 0.4 * sum(map(len, sets)), (written, sum(map(len, sets)))


def test_pairs_beyond_the_limit_are_told(spark, monkeypatch):
    from functools import partial

    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.choice('abcdefg')}{rng.choice(['lo', 'mi', 'ster'])}{rng.randrange(60)}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).localCheckpoint()
    scores = lambda: {r.doc_id: r.score for r in language_model.lm_scores(docs, fit_docs=10).collect()}
    whole = scores()
    monkeypatch.setattr(language_model, "spelled", partial(language_model.spelled, most=20))
    some = scores()
    assert len(some) == 60 and max(abs(some[i] / whole[i] - 1) for i in whole) < 1e-4


def test_few_meet_by_one_shared_shingle():
    """Sets that share one element needn't meet by it, though many have it."""
    rng = np.random.default_rng(6)
    sets = [np.unique(np.append(rng.integers(0, 2**63, 199).astype(np.uint64), np.uint64(5))) for _ in range(500)]
    sig, owner = jaccard.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 80, 100)
    _, n = np.unique(sig, return_counts=True)
    assert (n > 1).sum() <= 3 and len(np.unique(owner)) == 500  # of some 52,000


def families(spark, rng):
    """Sets, and a table of them in families of five, some alike and others not; every pair of links."""
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 100)
        for _ in range(5):
            sets.append(np.unique(np.append(base[rng.choice(100, rng.integers(70, 100), replace=False)], rng.integers(0, 2**63, rng.integers(1, 20)))))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    return sets, links, spark.createDataFrame([(i, bytearray(s.astype(np.uint64).tobytes())) for i, s in enumerate(sets)], "cls long, items binary")


def test_small_buckets_are_settled_pair_by_pair(spark, monkeypatch):
    """Nobody of a small bucket goes on to be told by its rarest elements, and no link is lost."""
    sets, links, table = families(spark, np.random.default_rng(2))
    member = spark.createDataFrame([(i, [i // 5, 100 + i // 5 * 5 + i % 2], []) for i in range(len(sets))], "cls long, sigs array<long>, met array<long>")
    gone_on = []
    prefixes = linkage.prefix_pairs
    monkeypatch.setattr(linkage, "prefix_pairs", lambda left, *rest: gone_on.append(left.count()) or prefixes(left, *rest))
    got = {r.node: r.comp for r in linkage.linked(member, lambda ids: table.join(ids, "cls", "left_semi"), 80, 100).collect()}
    least = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: got.get(i, i) for i in range(len(sets))} == dict(enumerate(least)) and 5 < len(set(least)) < len(sets)
    assert gone_on == [0]


def test_sketches_rule_out_unlike_pairs_only(spark):
    """No two sets differ in fewer elements than their sketches say, and most unlike pairs go."""
    sets, links, _ = families(spark, np.random.default_rng(9))
    keys = [s.astype(np.uint64) for s in [*sets, np.zeros(0), np.arange(3), np.arange(2000) * 977]]
    for x, y in itertools.combinations(keys, 2):
        assert linkage.differing(linkage.sketch(x), linkage.sketch(y)) <= len(np.setxor1d(x, y))
    pairs = list(itertools.combinations(range(len(sets)), 2))
    batch = pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "x": [linkage.sketch(keys[a]) for a, _ in pairs], "y": [linkage.sketch(keys[b]) for _, b in pairs], "m": [len(keys[a]) for a, _ in pairs], "n": [len(keys[b]) for _, b in pairs]}).to_batches()[0]
    left = {(a, b) for out in linkage.possible(80, 100)([batch]) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert set(links) <= left and len(left) < 200 < len(pairs)
