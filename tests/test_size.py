"""Forms that keep what one task holds small, on tables that are small themselves."""

import random

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tensorframe.operators import reshape
from tensorframe.plans import lower
from tensorframe.plans.expr import bc, contract
from tensorframe.plans.lower import MIN_PLUS, evaluate
from tensorframe.tensor import SparseTensor

from .test_algebra import cells, make


def executed(t):
    """The plan of a run that hasn't begun."""
    return t.df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [0, 1 << 25])
def test_a_whole_outer_product_is_dealt_out(spark, monkeypatch, sent):
    """Beyond the bound it is refused, unless the whole is wanted; then each task makes a part."""
    monkeypatch.setattr(lower, "MOST_DENSE", 1000)
    monkeypatch.setattr(lower, "DEALT", 100)
    monkeypatch.setattr(lower, "SENT", sent)
    a, x = make(spark, {(i, 1): i for i in range(40)}), make(spark, {(k,): k for k in range(30)}, "k")
    for e in (a["i", "j"] * x["k"], x["k"] * a["i", "j"]):
        with pytest.raises(ValueError):
            evaluate(e)
        got = evaluate(e, whole=True)
        assert "REPARTITION_BY_NUM" in executed(got)
        assert cells(got) == {tuple({"i": i, "j": 1, "k": k}[n] for n in got.indices): float(i * k) for i in range(40) for k in range(30)}


@pytest.mark.parametrize("fibre", [1, 16])
def test_a_broadcast_under_a_sum_shuffles_what_is_stored(spark, monkeypatch, fibre):
    """Only stored rows meet; beyond the extent, and where the broadcast has none, they stay as they are."""
    monkeypatch.setattr(lower, "FIBRE", fibre)
    a = make(spark, {(0, 1): 2, (3, 1): 4, (4, 1): -7, (6, 1): 1, (7, 1): 5, (9, 1): 6, (-1, 1): 3, (2, 2): 8, (5, 3): 9}, shape={"i": 7})
    b = make(spark, {(3, 1): 1, (1, 2): 1})
    x, y = make(spark, {(1,): 10, (2,): 20, (4,): 40}, "j"), make(spark, {(2,): 1}, "j")
    s = {1: 10.0, 2: 21.0, 4: 40.0}
    want = {(i, j): v for i in range(7) for j, v in s.items()}
    for t in (a, b):
        for at, v in cells(t).items():
            want[at] = want.get(at, 0.0) + v
    for e in (a["i", "j"] + x["j"] + b["i", "j"] + bc("i", y["j"]), y["j"] + b["i", "j"] + (a["i", "j"] + x["j"])):
        for dealt in (1 << 24, 2):
            monkeypatch.setattr(lower, "DEALT", dealt)
            got = evaluate(e)
            assert cells(got) == want == cells(evaluate(e, rewrite=False))
            assert "Window" in executed(got)
    v, three = make(spark, {(2,): 5, (3,): 1}, "i", {"i": 4}), contract("j", make(spark, {(1,): 1, (5,): 2}, "j")["j"])
    assert cells(evaluate(v["i"] + bc("i", three))) == {(0,): 3.0, (1,): 3.0, (2,): 8.0, (3,): 4.0}
    with pytest.raises(ValueError):
        evaluate(b["i", "j"] + x["j"])
    f = make(spark, {(0, 1): 0.1}, shape={"i": 2}, dtype="float")
    got = evaluate(f["i", "j"] + make(spark, {(1,): 0.2}, "j", dtype="float")["j"])
    assert got.df.schema["v"].dataType.simpleString() == "float" and set(cells(got)) == {(0, 1), (1, 1)}
    monkeypatch.setattr(lower, "MOST_DENSE", 20)
    with pytest.raises(ValueError):
        evaluate(a["i", "j"] + x["j"])
    assert len(cells(evaluate(a["i", "j"] + x["j"], whole=True))) == 25


def aggregates(t):
    return executed(t).count("HashAggregate")


def test_a_sum_is_one_aggregate_over_loose_rows(spark):
    """Duplicates within terms and terms over one coordinate are summed at once; before, an aggregate stood above another in a task."""
    rows = [(0, 1, 2.0), (0, 1, 3.0), (2, 2, -1.0)], [(0, 1, 4.0), (5, 5, 1.5), (5, 5, 1.5)], [(2, 2, 1.0), (7, 0, -0.0)]
    for dtype in ("double", "float"):
        a, b, c = (make(spark, r, dtype=dtype) for r in rows)
        got = evaluate(a["i", "j"] + b["i", "j"] + c["i", "j"])
        assert cells(got) == {(0, 1): 9.0, (2, 2): 0.0, (5, 5): 3.0, (7, 0): 0.0} == cells(evaluate(a["i", "j"] + b["i", "j"] + c["i", "j"], rewrite=False))
        assert aggregates(got) == 2 and got.df.schema["v"].dataType.simpleString() == dtype
        turned = evaluate(a["i", "j"] + b["j", "i"])
        assert cells(turned) == {(0, 1): 5.0, (1, 0): 4.0, (2, 2): -1.0, (5, 5): 3.0}
    third = make(spark, [(0, 0, 1 / 3), (0, 0, 1 / 3)], dtype="float")
    tenth = make(spark, [(0, 0, 0.1)] * 3, dtype="float")
    e = third["i", "j"] + tenth["i", "j"]
    assert cells(evaluate(e)) == cells(evaluate(e, rewrite=False))
    gone = evaluate(a["i", "j"] + reshape.scale(a, -1.0)["i", "j"])
    assert cells(gone) == {(0, 1): 0.0, (2, 2): 0.0} and executed(gone).count("Scan") == 1


def test_products_under_a_sum_read_their_rows_once(spark):
    """a and b are read once each, though each occurs twice; where no rows are shared, products stay joins."""
    rows = [(0, 1, 2.0), (0, 1, 3.0), (2, 2, 4.0), (3, 3, 4.0), (8, 8, float("nan"))], [(0, 1, 4.0), (5, 5, 1.0), (3, 3, 4.0), (8, 8, 1.0)]
    a, b = (make(spark, r) for r in rows)
    one = lambda t: replace(t, df=t.df.select("i", "j", F.lit(1.0).alias("v")), then=lambda _: F.lit(1.0))
    e = a["i", "j"] * one(b)["i", "j"] + reshape.scale(b, -1.0)["i", "j"] * one(a)["i", "j"]
    got = evaluate(e)
    assert aggregates(got) == 2 and "Join" not in executed(got) and executed(got).count("Scan") == 2
    known = lambda t: {k: v for k, v in cells(t).items() if k != (8, 8)}
    assert known(got) == {(0, 1): 1.0, (3, 3): 0.0} == known(evaluate(e, rewrite=False)) and (8, 8) in cells(got)
    c, d = make(spark, [(0, 1, 7.0)]), make(spark, [(0, 1, 3.0), (3, 3, 2.0)])
    apart = evaluate(a["i", "j"] * c["i", "j"] + b["i", "j"] * d["i", "j"])
    assert "Join" in executed(apart) and cells(apart) == {(0, 1): 47.0, (3, 3): 8.0}
    wide = make(spark, {(0,): 2, (3,): 1}, "i")
    assert known(evaluate(a["i", "j"] * wide["i"] + a["i", "j"])) == {(0, 1): 15.0, (2, 2): 4.0, (3, 3): 8.0}


def kept(spark, folder, rows, indices, dtype="double"):
    """A tensor over a stored table, so that its size is known."""
    schema = ", ".join(f"{i} long" for i in indices) + ", v double"
    spark.createDataFrame([(*at, float(v)) for at, v in rows.items()], schema).write.parquet(str(folder))
    return SparseTensor.from_df(spark.read.parquet(str(folder)), list(indices), dtype=dtype)


def test_an_expanding_product_is_dealt_out(spark, monkeypatch, tmp_path):
    """By bytes, and coordinates with many products in parts; no row is lost or made twice."""
    rng = random.Random(4)
    x = {(i, 0): rng.randint(1, 9) for i in range(50)} | {(i, j): rng.randint(1, 9) for i in range(12) for j in range(1, 5)} | {(60, 7): 2}
    y = {(0, k): rng.randint(1, 9) for k in range(40)} | {(j, 3 * j): rng.randint(1, 9) for j in range(1, 6)} | {(8, 1): 2}
    a, b = kept(spark, tmp_path / "a", x, "ij"), kept(spark, tmp_path / "b", y, "jk")
    want, least = {}, {}
    for (i, j), v in x.items():
        for (j2, k), w in y.items():
            if j == j2:
                want[i, k] = want.get((i, k), 0.0) + v * w
                least[i, k] = min(least.get((i, k), 1e9), v + w)
    e = contract("j", a["i", "j"] * b["j", "k"])
    assert "REPARTITION_BY_NUM" not in executed(evaluate(e))
    tasks = (lower.stored(a.df) + lower.stored(b.df)) // 100
    assert tasks > spark.sparkContext.defaultParallelism
    monkeypatch.setattr(lower, "READ", 100)
    for cell in (1 << 20, 16, 1):
        monkeypatch.setattr(lower, "CELL", cell)
        for rewrite in (True, False):
            got = evaluate(e, rewrite=rewrite)
            assert executed(got).count(f", {tasks}), REPARTITION_BY_NUM") == 2
            assert cells(got) == want
    assert cells(evaluate(e, ring=MIN_PLUS)) == least
    loop = {}
    for (i, j), v in x.items():
        for (k, j2), w in x.items():
            if j == j2:
                loop[i, k] = loop.get((i, k), 0.0) + v * w
    assert cells(evaluate(contract("j", a["i", "j"] * a["k", "j"]))) == loop
    pairs = evaluate(a["i", "j"] * b["j", "k"])
    assert len(cells(pairs)) == sum(1 for _, j in x for j2, _ in y if j == j2)
    assert "REPARTITION_BY_NUM" not in executed(evaluate(a["i", "j"] * b["i", "j"]))
    p, q = ({(i, j, k): rng.randint(1, 9) for i in range(6) for j in range(2) for k in range(3)} for _ in range(2))
    c, d = kept(spark, tmp_path / "c", p, "ijk"), kept(spark, tmp_path / "d", q, "jkl")
    want = {}
    for (i, j, k), v in p.items():
        for (j2, k2, m), w in q.items():
            if (j, k) == (j2, k2):
                want[i, m] = want.get((i, m), 0.0) + v * w
    got = evaluate(contract(("j", "k"), c["i", "j", "k"] * d["j", "k", "l"]))
    assert cells(got) == want and "REPARTITION_BY_NUM" in executed(got)
