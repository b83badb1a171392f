"""Named kernels: an expression over declared operands, called with tensors by position."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from .plans.expr import Add, Bc, Expr, Tensor, contract, declare, operands
from .plans.lower import REAL, Semiring, evaluate
from .sources import text
from .tensor import SparseTensor

CPU, GPU = "cpu", "gpu"


class Kernel:
    """Kernel("csr_add").expr(a + b).emit() gives a callable and registers it."""

    registry: dict[str, Kernel] = {}
    #: what each kernel can be called by, unless its bindings are off
    callables: dict[str, Kernel] = {}

    def __init__(self, name: str):
        self.name, self._expr, self._order = name, None, None
        self._targets, self._result, self._prefilter, self._bind = (CPU, GPU), "Z", False, True
        self._python: dict[str, str] = {}

    def expr(self, e: Expr) -> Kernel:
        self._expr = e
        return self

    def targets(self, targets) -> Kernel:
        """Kept for its names: there is one engine."""
        if not set(targets) <= {CPU, GPU}:
            raise ValueError(f"unknown target in {targets}")
        self._targets = tuple(targets)
        return self

    def result_name(self, name: str) -> Kernel:
        """The name of the tensor that a call returns."""
        self._result = name
        return self

    def operand_ordering(self, names) -> Kernel:
        """The order of a call's operands; by name otherwise."""
        self._order = list(names)
        return self

    def python_name(self, target: str, name: str) -> Kernel:
        """The name that ``function`` finds the kernel by, in place of the target's own."""
        self._python[target] = name
        return self

    def bindings(self, on: bool) -> Kernel:
        """Whether the kernel can be called by name."""
        self._bind = on
        return self

    def recursive_partitioning(self, on: bool) -> Kernel:
        """Whether what operands share in an outer index restricts them before they meet in the inner ones."""
        self._prefilter = on
        return self

    @property
    def names(self) -> list[str]:
        return [self._python.get(t, f"{t}_{self.name}_f32") for t in self._targets] if self._bind else []

    def declared(self) -> dict[str, Tensor]:
        if self._expr is None:
            raise ValueError(f"{self.name} has no expression")
        out: dict[str, Tensor] = {}
        for t in operands(self._expr):
            if out.setdefault(t.name, t).format != t.format:
                raise ValueError(f"{t.name} is declared twice")
        return out

    def order(self) -> list[str]:
        known = self.declared()
        order = self._order or sorted(known)
        if sorted(order) != sorted(known):
            raise ValueError(f"{order} doesn't order {sorted(known)}")
        return order

    def emit(self) -> Kernel:
        self.order()
        taken = [n for n in self.names if Kernel.callables.get(n, self).name != self.name]
        if taken:
            raise ValueError(f"{', '.join(taken)} is another kernel's name")
        Kernel.callables = {n: k for n, k in Kernel.callables.items() if k.name != self.name} | dict.fromkeys(self.names, self)
        Kernel.registry[self.name] = self
        return self

    def __call__(self, *tensors: SparseTensor, rewrite: bool = True, prefilter: bool | None = None, ring: Semiring = REAL) -> SparseTensor:
        order = self.order()
        if len(tensors) != len(order):
            raise TypeError(f"{self.name} takes {len(order)} tensors: {', '.join(order)}")
        given = dict(zip(order, tensors))
        for n, t in given.items():
            want = self.declared()[n]
            if len(t.indices) != len(want.names):
                raise ValueError(f"{n} has {len(want.names)} indices, not {len(t.indices)}")
        got = evaluate(self._bound(self._expr, given), rewrite=rewrite, prefilter=self._prefilter if prefilter is None else prefilter, ring=ring)
        got.name = self._result
        return got

    def described(self) -> dict:
        """Names, operands in order with their layouts, the expression and the result."""
        known = self.declared()
        form = lambda f: f.name or f.signature
        return {"kernel": self.name, "names": self.names, "targets": list(self._targets), "operands": [{"name": n, "indices": list(known[n].names), "layout": form(known[n].format), "dtype": known[n].dtype} for n in self.order()], "expression": written(self._expr), "result": {"name": self._result, "indices": list(self._expr.indices), "layout": form(self._expr.format)}, "recursive_partitioning": self._prefilter}

    def _bound(self, e: Expr, given: dict[str, SparseTensor]) -> Expr:
        if isinstance(e, Tensor):
            t = given[e.name]
            form = type(e.declared)(tuple((c, f) for c, (_, f) in zip(t.indices, e.declared.levels)))
            return Tensor(replace(t, format=form, name=""), e.names, e.name)
        if hasattr(e, "left"):
            return type(e)(self._bound(e.left, given), self._bound(e.right, given))
        return type(e)(e.index, self._bound(e.body, given))


def written(e: Expr) -> str:
    """An expression as text."""
    if isinstance(e, Tensor):
        return f"{e.name}({','.join(e.names)})"
    if hasattr(e, "left"):
        return f"({written(e.left)} {'+' if isinstance(e, Add) else '*'} {written(e.right)})"
    return f"{'bc' if isinstance(e, Bc) else 'sum'}({e.index}, {written(e.body)})"


def function(name: str) -> Kernel:
    """The kernel that is called by this name."""
    if name not in Kernel.callables:
        raise KeyError(f"no kernel is called {name}")
    return Kernel.callables[name]


def select(names: str | None = None) -> dict[str, Kernel]:
    """Kernels by a comma-separated list; all without one."""
    if not names:
        return dict(Kernel.registry)
    unknown = [n for n in names.split(",") if n not in Kernel.registry]
    if unknown:
        raise KeyError(f"no kernel {', '.join(unknown)}")
    return {n: Kernel.registry[n] for n in names.split(",")}


def _shipped() -> None:
    matrix: Callable = lambda n, layout, *ij: declare(n, layout, *(ij or ("i", "j")))
    cube = lambda n, layout: declare(n, layout, "i", "j", "k")
    for kind in ("csr", "coo", "dcsr"):
        a, b = (matrix(n, kind.upper()) for n in "ab")
        Kernel(f"{kind}_add").expr(a + b).emit()
        Kernel(f"{kind}_mul").expr(a * b).recursive_partitioning(kind == "dcsr").emit()
    a, b, c = (matrix(n, "CSR") for n in "abc")
    Kernel("csr_add_3").expr(a + b + c).emit()
    Kernel("coo_csr_add").expr(matrix("a", "CSR") + matrix("b", "COO")).emit()
    Kernel("dcsr_mul_without_recursive_partitioning").expr(matrix("a", "DCSR") * matrix("b", "DCSR")).recursive_partitioning(False).emit()
    Kernel("csf_add").expr(cube("a", "CSF3") + cube("b", "CSF3")).emit()
    Kernel("coo3d_add").expr(cube("a", "COO3") + cube("b", "COO3")).emit()
    Kernel("inner_prod").expr(contract(("i", "j", "k"), cube("a", "CSF3") * cube("b", "CSF3"))).emit()
    Kernel("inner_prod_coo").expr(contract(("i", "j", "k"), cube("a", "COO3") * cube("b", "COO3"))).emit()
    a, b, c = matrix("a", "CSR", "i", "j"), matrix("b", "CSR", "j", "k"), matrix("c", "CSR", "i", "k")
    Kernel("spgemm").expr(contract("j", a * b)).targets([GPU]).emit()
    Kernel("sssmm").expr(contract("j", a * b * c)).targets([GPU]).emit()


_shipped()


def load(spark, path: str, indices: tuple[str, ...]) -> SparseTensor:
    """An operand: Matrix Market text by its ending, else coordinate text."""
    return text.read_matrix_market(spark, path, indices) if path.rstrip("/").endswith((".mtx", ".mtx.gz")) else text.read_tns(spark, path, indices)


def main(args: list[str] | None = None) -> None:
    """Lists kernels; with an output folder, describes each there, or runs it on operands in files."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--kernels", help="comma-separated names; all by default")
    p.add_argument("--output-dir", help="gets KERNEL.json for each kernel, or KERNEL.tns with operands")
    p.add_argument("operands", nargs="*", help="files of each operand in order: .mtx, or text of coordinates and values")
    given = p.parse_args(args)
    chosen = select(given.kernels)
    if given.operands and not given.output_dir:
        p.error("operands need --output-dir")
    for name, k in chosen.items():
        print(name, *k.order(), "->", k._expr.format.name or k._expr.format.signature, *k.names)
        if given.operands:
            from pyspark.sql import SparkSession

            if len(given.operands) != len(k.order()):
                p.error(f"{name} takes {len(k.order())} operands")
            spark = SparkSession.builder.getOrCreate()
            tensors = [load(spark, f, k.declared()[n].names) for n, f in zip(k.order(), given.operands)]
            text.write_tns(k(*tensors), f"{given.output_dir}/{name}.tns")
        elif given.output_dir:
            Path(given.output_dir).mkdir(parents=True, exist_ok=True)
            (Path(given.output_dir) / f"{name}.json").write_text(json.dumps(k.described(), indent=1))


if __name__ == "__main__":
    main()
