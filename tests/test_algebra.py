"""The algebra against dictionaries, on small random tensors, and the cases at its edges."""

import itertools
import math
import random

import pytest

from tensorframe.functions.formats import BY_CODE, Format, add_formats, add_levels, mul_formats, mul_levels, register_layout
from tensorframe.kernels import Kernel, main, select
from tensorframe.operators import layouts, reshape
from tensorframe.plans.expr import Add, Bc, Mul, Sum, bc, contract, declare
from tensorframe.plans.lower import MIN_PLUS, evaluate
from tensorframe.tensor import SparseTensor


def make(spark, cells, indices="ij", shape=None, layout=None, dtype="double"):
    schema = ", ".join(f"{i} long" for i in indices) + ", v double"
    rows = [(*k, float(v)) for k, v in cells.items()] if isinstance(cells, dict) else cells
    return SparseTensor.from_df(spark.createDataFrame(rows, schema), list(indices), shape=shape, format=layout, dtype=dtype)


def cells(t):
    out = {tuple(r[i] for i in t.indices): r["v"] for r in t.df.collect()}
    assert len(out) == t.df.count()
    return out


def rand(rng, sizes, n):
    return {tuple(rng.randrange(s) for s in sizes): float(rng.randint(-4, 4)) for _ in range(n)}


def plus(a, b):
    return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in a.keys() | b.keys()}


def times(a, b):
    return {k: a[k] * b[k] for k in a.keys() & b.keys()}


def test_level_tables():
    order = ["d", "cu", "cn", "su", "sn"]
    add = "d d d d d|d cu cn cu cn|d cn cn cn cn|d cu cn su sn|d cn cn sn sn"
    mul = "d cu cn su sn|cu cu cu su su|cn cu cn su sn|su su su su su|sn su sn su sn"
    for table, f in ((add, add_levels), (mul, mul_levels)):
        for a, row in zip(order, table.split("|")):
            for b, want in zip(order, row.split()):
                assert f(BY_CODE[a], BY_CODE[b]).code == want, (a, b)


def test_formats():
    csr, coo, dcsr = (Format.of(n, "i", "j") for n in ("CSR", "COO", "DCSR"))
    assert add_formats(csr, coo).name == "CSR" and mul_formats(csr, coo).name == "COO"
    assert add_formats(csr, dcsr).name == "CSR" and mul_formats(csr, dcsr).name == "DCSR"
    assert mul_formats(dcsr, coo).signature == "cu_su" and mul_formats(dcsr, coo).name is None
    assert Format.of("d", "i").filled == ("i",) and csr.filled == () and Format.of("cu_d", "i", "j").filled == ("j",)
    for bad in (("cn", "i"), ("cn_cu", "i", "j"), ("CSR", "i"), ("CSR", "i", "i")):
        with pytest.raises(ValueError):
            Format.of(*bad)
    with pytest.raises(ValueError):
        register_layout("d_cu", "other")
    assert add_formats(Format.of("CSR", "i", "j"), Format.of("CSR", "j", "i")).indices == ("i", "j")


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    a, b, c = rand(rng, (6, 5), 12), rand(rng, (6, 5), 12), rand(rng, (5, 4), 9)
    x, y, z = make(spark, a), make(spark, b), make(spark, c)
    assert cells(evaluate(x["i", "j"] + y["i", "j"])) == plus(a, b) == cells(evaluate(y["i", "j"] + x["i", "j"]))
    assert cells(evaluate(x["i", "j"] * y["i", "j"])) == times(a, b)
    want = {}
    for (i, j), v in a.items():
        for (j2, k), w in c.items():
            if j == j2:
                want[i, k] = want.get((i, k), 0.0) + v * w
    assert cells(evaluate(contract("j", x["i", "j"] * z["j", "k"]))) == want
    mask = rand(rng, (6, 4), 8)
    m = make(spark, mask, "ik")
    e = contract("j", x["i", "j"] * z["j", "k"] * m["i", "k"])
    for rewrite, prefilter in itertools.product((True, False), (True, False)):
        assert cells(evaluate(e, rewrite=rewrite, prefilter=prefilter)) == times(want, mask)
    least = {}
    for (i, j), v in a.items():
        for (j2, k), w in c.items():
            if j == j2:
                least[i, k] = min(least.get((i, k), math.inf), v + w)
    assert cells(evaluate(contract("j", x["i", "j"] * z["j", "k"]), ring=MIN_PLUS)) == least


def test_support(spark):
    a = make(spark, {(0, 0): 1, (1, 2): -2})
    minus = reshape.scale(a, -1.0)
    gone = evaluate(a["i", "j"] + minus["i", "j"])
    assert cells(gone) == {(0, 0): 0.0, (1, 2): 0.0} and cells(reshape.prune(gone)) == {}
    nan = make(spark, [(5, 5, float("nan"))])
    assert cells(evaluate(nan["i", "j"] * a["i", "j"])) == {}
    empty = make(spark, [])
    assert cells(evaluate(empty["i", "j"] + a["i", "j"])) == cells(a) and cells(evaluate(empty["i", "j"] * a["i", "j"])) == {}
    assert cells(evaluate(contract(("i", "j"), empty["i", "j"] * a["i", "j"]))) == {(): 0.0}
    assert cells(make(spark, [(1, 1, 2.0), (1, 1, 3.0)])) == {(1, 1): 5.0}
    assert cells(evaluate(contract("j", a["i", "j"] * a["k", "j"]))) == {(0, 0): 1.0, (1, 1): 4.0}


def test_broadcast_and_fill(spark):
    a = make(spark, {(0, 1): 2}, shape={"i": 2, "j": 3})
    x = make(spark, {(1,): 5, (2,): 7}, "j", {"j": 3})
    want = {(i, j): v for i in range(2) for j, v in ((1, 5.0), (2, 7.0))}
    want[0, 1] += 2
    assert cells(evaluate(a["i", "j"] + x["j"])) == want == cells(evaluate(a["i", "j"] + bc("i", x["j"])))
    assert cells(evaluate(a["i", "j"] * bc("i", x["j"]))) == {(0, 1): 10.0} == cells(evaluate(a["i", "j"] * x["j"], rewrite=False))
    assert cells(evaluate(bc("k", x["j"]), sizes={"k": 2})) == {(j, k): v for (j,), v in cells(x).items() for k in range(2)}
    csr = make(spark, {(0, 1): 2}, shape={"i": 3, "j": 3}, layout="CSR")
    assert cells(evaluate(contract("j", csr["i", "j"]))) == {(0,): 2.0, (1,): 0.0, (2,): 0.0}
    assert len(cells(reshape.densify(csr))) == 9
    with pytest.raises(ValueError):
        evaluate(bc("k", x["j"]))
    with pytest.raises(ValueError):
        evaluate(bc("k", x["j"]), sizes={"k": 1 << 40})


def test_errors(spark):
    a, f = make(spark, {(0, 0): 1}), make(spark, {(0, 0): 1}, dtype="float")
    for bad in (lambda: Add(a["i", "j"], f["i", "j"]), lambda: Mul(a["i", "j"], f["i", "j"]), lambda: Add(a["i", "j"], 3)):
        with pytest.raises(TypeError):
            bad()
    for bad in (lambda: Sum("k", a["i", "j"]), lambda: Bc("i", a["i", "j"]), lambda: a["i"], lambda: a["i", "i"]):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        evaluate(make(spark, {(0, 0): 1}, shape={"i": 2})["i", "j"] + make(spark, {(0, 0): 1}, shape={"i": 3})["i", "j"])
    for row in ((None, 0, 1.0), (0, 0, None)):
        with pytest.raises(Exception, match="null"):
            make(spark, [row]).df.collect()
    assert evaluate(f["i", "j"] + f["i", "j"]).df.schema["v"].dataType.simpleString() == "float"


def plan(t):
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def test_plans(spark):
    a, b, c = (make(spark, {(0, 0): n}) for n in (1, 2, 3))

    def exchanges(t):
        return t.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    fused = evaluate(a["i", "j"] + b["i", "j"] + c["i", "j"])
    assert exchanges(fused) <= exchanges(evaluate(a["i", "j"] + b["i", "j"] + c["i", "j"], rewrite=False))


def test_recursive_partitioning_restricts_rows(spark):
    """The switch adds a semi-join on the outer index to each side, and changes no value."""
    rng = random.Random(9)
    x, y = rand(rng, (30, 6), 40), rand(rng, (30, 6), 40)
    a, b = make(spark, x), make(spark, y)
    on, off = (Kernel.registry[n](a, b) for n in ("dcsr_mul", "dcsr_mul_without_recursive_partitioning"))
    assert plan(on).count("LeftSemi") == 2 and "LeftSemi" not in plan(off)
    assert cells(on) == cells(off) == times(x, y)


def test_a_mask_restricts_the_product(spark):
    """Factors are joined where they share most; prefiltering restricts both sides by the mask."""
    rng = random.Random(10)
    x, y, m = rand(rng, (9, 8), 30), rand(rng, (8, 9), 30), rand(rng, (9, 9), 12)
    a, b, c = make(spark, x), make(spark, y, "jk"), make(spark, m, "ik")
    from tensorframe.plans.lower import factors, in_order

    e = contract("j", a["i", "j"] * b["j", "k"] * c["i", "k"])
    assert [p.names for p in in_order(factors(e.body))] == [("i", "j"), ("j", "k"), ("i", "k")]
    assert [p.names for p in in_order(factors((a["i", "j"] * c["k", "l"] * b["j", "k"])))] == [("i", "j"), ("j", "k"), ("k", "l")]
    want = {}
    for (i, j), v in x.items():
        for (j2, k), w in y.items():
            if j == j2 and (i, k) in m:
                want[i, k] = want.get((i, k), 0.0) + v * w * m[i, k]
    pre = evaluate(e, prefilter=True)
    assert cells(pre) == cells(evaluate(e)) == cells(evaluate(e, rewrite=False)) == want
    assert plan(pre).count("LeftSemi") == 2


def test_reshape_and_layouts(spark):
    a = make(spark, {(0, 1): 2, (2, 0): 3, (2, 1): 4}, shape={"i": 3, "j": 2})
    assert cells(reshape.transpose(a)) == {(1, 0): 2.0, (0, 2): 3.0, (1, 2): 4.0}
    assert cells(reshape.shift(a)) == {(1, 1): 2.0, (2, 1): 7.0}
    assert cells(reshape.flatten(a)) == {(3,): 2.0, (2,): 3.0, (5,): 4.0}
    assert cells(reshape.clip(a, i=1)) == {(0, 1): 2.0}
    for width in (1, 100):
        assert cells(layouts.from_csr(layouts.to_csr(a, width))) == cells(a) == cells(layouts.from_dcsr(layouts.to_dcsr(a, width)))
    t = make(spark, rand(random.Random(5), (4, 3, 5), 20), "ijk")
    for width in (2, 100):
        assert cells(layouts.from_csf3(layouts.to_csf3(t, width))) == cells(t)
    assert cells(layouts.from_coo(layouts.to_coo(t), ["i", "j", "k"])) == cells(t)


def test_offsets(spark, monkeypatch):
    monkeypatch.setattr(layouts, "STEP", 2)
    a = make(spark, {(1, 0): 1, (1, 3): 2, (4, 2): 3, (6, 0): 4, (6, 1): 5}, shape={"i": 8, "j": 4})
    csr = {r.i: (r.start, r.n) for r in layouts.csr_offsets(a).collect()}
    assert csr == {0: (0, 0), 1: (0, 2), 2: (2, 0), 3: (2, 0), 4: (2, 1), 5: (3, 0), 6: (3, 2), 7: (5, 0)}
    assert sorted(tuple(r) for r in layouts.dcsr_offsets(a).collect()) == [(0, 1, 0, 2), (1, 4, 2, 1), (2, 6, 3, 2)]
    assert {(r.p, r.i) for r in layouts.to_dcsr(a).collect()} == {(0, 1), (1, 4), (2, 6)}


def test_arrow(spark):
    a = make(spark, {(0, 1): 2, (2, 0): 3})
    t = a.to_arrow()
    assert t.column_names == ["i", "j", "v"] and t.to_pydict() == {"i": [0, 2], "j": [1, 0], "v": [2.0, 3.0]}
    assert cells(SparseTensor.from_arrow(spark, t, ["i", "j"])) == cells(a) and a.to_pandas().shape == (2, 3)


def test_dense_results_are_counted(spark):
    from tensorframe.plans import lower

    a, x = make(spark, {(i, 0): 1 for i in range(40)}), make(spark, {(k,): 1 for k in range(30)}, "k")
    for bad in (lambda: evaluate(bc("k", a["i", "j"]), sizes={"k": 1 << 32}), lambda: evaluate(a["i", "j"] * make(spark, {(k,): 1 for k in range(3)}, "k", {"k": 1 << 32})["k"])):
        with pytest.raises(ValueError):
            bad()
    most, lower.MOST_DENSE = lower.MOST_DENSE, 1000
    try:
        with pytest.raises(ValueError):
            evaluate(a["i", "j"] * x["k"])
    finally:
        lower.MOST_DENSE = most


def test_level_navigation():
    f = Format.of("d_cu_cu", "i", "j", "k")
    assert (f.next("i"), f.next("k"), f.previous("j"), f.previous("i"), f.last_sparse) == ("j", None, "i", None, "k")
    assert Format.of("d", "i").last_sparse is None
    with pytest.raises(ValueError):
        f.next("x")
    with pytest.warns(UserWarning):
        mul_formats(Format.of("CSR", "i", "j"), Format.of("CSR", "j", "i"))


def test_kernel_names(spark, tmp_path, capsys):
    import json

    from tensorframe.kernels import function

    a, b = declare("a", "CSR", "i", "j"), declare("b", "CSR", "i", "j")
    k = Kernel("named").expr(a + b).result_name("C").python_name("cpu", "plus").targets(["cpu"]).emit()
    x, y = make(spark, {(0, 1): 2}), make(spark, {(0, 1): 5, (1, 1): 1})
    assert function("plus") is k and cells(function("plus")(x, y)) == {(0, 1): 7.0, (1, 1): 1.0} and k(x, y).name == "C"
    k.bindings(False).emit()
    with pytest.raises(KeyError):
        function("plus")
    with pytest.raises(ValueError):
        Kernel("other").expr(a + b).python_name("cpu", "cpu_csr_add_f32").emit()
    del Kernel.registry["named"]
    main(["--kernels", "csr_add,sssmm", "--output-dir", str(tmp_path / "out")])
    said = json.loads((tmp_path / "out" / "sssmm.json").read_text())
    assert said["expression"] == "sum(j, ((a(i,j) * b(j,k)) * c(i,k)))" and [o["name"] for o in said["operands"]] == ["a", "b", "c"]
    for bad in (["--nothing"], ["a.mtx"], ["--kernels", "csr_add", "--output-dir", str(tmp_path), "one.tns"]):
        with pytest.raises(SystemExit):
            main(bad)
    (tmp_path / "a.tns").write_text("1 2 3\n")
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 2 4\n")
    main(["--kernels", "csr_add", "--output-dir", str(tmp_path / "run"), str(tmp_path / "a.tns"), str(tmp_path / "b.mtx")])
    assert "".join(p.read_text() for p in (tmp_path / "run" / "csr_add.tns").glob("part-*")).split() == ["1", "2", "7.0"]
    capsys.readouterr()


def test_kernels(spark, capsys):
    assert len(select()) == 15
    main(["--kernels", "csr_add,inner_prod"])
    assert "cpu_csr_add_f32" in capsys.readouterr().out
    with pytest.raises(KeyError):
        select("nothing")
    a, b = declare("a", "CSR", "i", "j"), declare("b", "CSR", "j", "k")
    k = Kernel("mine").expr(contract("j", a * b)).operand_ordering(["b", "a"]).result_name("C").python_name("cpu", "mine")
    x, y = make(spark, {(0, 1): 2}), make(spark, {(1, 0): 5})
    assert cells(k(y, x)) == {(0, 0): 10.0} and k.names[0] == "mine"
    with pytest.raises(ValueError):
        Kernel("bad").expr(a * b).operand_ordering(["a"]).emit()
    with pytest.raises(TypeError):
        k(x)
