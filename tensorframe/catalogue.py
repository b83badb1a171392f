"""The named tensor queries, each through the public algebra, and the SQL for the same rows.

Operands come from lineitem: quantities by supplier and part of one return flag (R, A, N), the
same by supplier, part modulo 100 and year (R3, A3), and by order and part.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formats import BY_CODE, Format, add_formats, add_levels, mul_formats, mul_levels
from .kernels import Kernel
from .operators import layouts, reshape
from .plans.expr import bc, contract, declare
from .plans.lower import MIN_PLUS, evaluate
from .sources import text
from .tensor import SparseTensor


class Data:
    """Tensors over one folder of tables, each read with the columns that it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def size(self, table: str, key: str) -> int:
        return self.table(table).agg(F.max(key)).first()[0] + 1

    @property
    def suppliers(self) -> int:
        return self.size("supplier", "s_suppkey")

    @property
    def parts(self) -> int:
        return self.size("part", "p_partkey")

    def flag(self, flag: str, layout: str = "CSR", i: str = "l_suppkey", j: str = "l_partkey") -> SparseTensor:
        rows = self.table("lineitem").where(F.col("l_returnflag") == flag)
        return SparseTensor.from_df(rows, {"i": i, "j": j}, "l_quantity", format=layout)

    def turned(self, flag: str) -> SparseTensor:
        return self.flag(flag, "CSR", "l_partkey", "l_suppkey")

    def cube(self, flag: str, layout: str = "CSF3", k: int | None = None) -> SparseTensor:
        rows = self.table("lineitem").where(F.col("l_returnflag") == flag)
        rows = rows.select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).alias("j"), (F.year("l_shipdate") - 1995).alias("k"), "l_quantity")
        if k is not None:
            rows = rows.where(F.col("k") == k)
        return SparseTensor.from_df(rows, ["i", "j", "k"], "l_quantity", format=layout)

    def mask(self) -> SparseTensor:
        """Pairs of suppliers of one nation."""
        s = self.table("supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("n"))
        rows = s.join(s.withColumnRenamed("i", "k"), "n").select("i", "k", F.lit(1.0).alias("v"))
        return SparseTensor.from_df(rows, ["i", "k"], format="CSR", unique=True)

    def sizes(self) -> SparseTensor:
        """p_size by part."""
        return SparseTensor.from_df(self.table("part"), {"j": "p_partkey"}, "p_size", format="cu")

    def nations(self) -> SparseTensor:
        """Nation number plus one, by supplier."""
        rows = self.table("supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).alias("v"))
        return SparseTensor.from_df(rows, ["i"], format="cu")


R, A, N = (f"(SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2)" for f in "RAN")
AT = "(SELECT l_partkey AS j, l_suppkey AS k, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"
R3, A3 = (f"(SELECT l_suppkey AS i, l_partkey % 100 AS j, CAST(year(l_shipdate) - 1995 AS BIGINT) AS k, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2, 3)" for f in "RA")
SIZE = "(SELECT p_partkey AS j, CAST(SUM(p_size) AS DOUBLE) AS v FROM part GROUP BY 1)"
NATION = "(SELECT s_suppkey AS i, CAST(SUM(s_nationkey + 1) AS DOUBLE) AS v FROM supplier GROUP BY 1)"
MASK = "(SELECT x.s_suppkey AS i, y.s_suppkey AS k, 1.0 AS v FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey)"


def _union(*parts: str, keys: str = "i, j") -> str:
    arms = " UNION ALL ".join(f"SELECT {keys}, v FROM {p}" for p in parts)
    return f"SELECT {keys}, SUM(v) AS v FROM ({arms}) GROUP BY {keys}"


def _join(a: str, b: str, keys: str = "i, j") -> str:
    return f"SELECT {keys}, a.v * b.v AS v FROM {a} a JOIN {b} b USING ({keys})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(make: Callable[[Data], SparseTensor | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = make(Data(spark, sf_dir))
            return got.df if isinstance(got, SparseTensor) else got

        QUERIES[name], ORACLES[name] = run, sql
        return make

    return add


def _kernel(name: str, sql: str, make: Callable[[Data], tuple]) -> None:
    query(name, sql)(lambda d: Kernel.registry[name](*make(d)))


for _kind in ("csr", "coo", "dcsr"):
    _kernel(f"{_kind}_add", _union(R, A), lambda d, k=_kind: (d.flag("R", k.upper()), d.flag("A", k.upper())))
    _kernel(f"{_kind}_mul", _join(R, A), lambda d, k=_kind: (d.flag("R", k.upper()), d.flag("A", k.upper())))
_kernel("csr_add_3", _union(R, A, N), lambda d: (d.flag("R"), d.flag("A"), d.flag("N")))
_kernel("coo_csr_add", _union(R, A), lambda d: (d.flag("R"), d.flag("A", "COO")))
_kernel("dcsr_mul_without_recursive_partitioning", _join(R, A), lambda d: (d.flag("R", "DCSR"), d.flag("A", "DCSR")))
_kernel("csf_add", _union(R3, A3, keys="i, j, k"), lambda d: (d.cube("R"), d.cube("A")))
_kernel("coo3d_add", _union(R3, A3, keys="i, j, k"), lambda d: (d.cube("R", "COO3"), d.cube("A", "COO3")))
_inner = f"SELECT COALESCE(SUM(a.v * b.v), 0.0) AS v FROM {R3} a JOIN {A3} b USING (i, j, k)"
_kernel("inner_prod", _inner, lambda d: (d.cube("R"), d.cube("A")))
_kernel("inner_prod_coo", _inner, lambda d: (d.cube("R", "COO3"), d.cube("A", "COO3")))
_kernel("spgemm", f"SELECT a.i, b.k, SUM(a.v * b.v) AS v FROM {R} a JOIN {AT} b USING (j) GROUP BY 1, 2", lambda d: (d.flag("R"), d.turned("A")))
_kernel("sssmm", f"SELECT i, k, SUM(a.v * b.v * c.v) AS v FROM {R} a JOIN {AT} b USING (j) JOIN {MASK} c USING (i, k) GROUP BY i, k", lambda d: (d.flag("R"), d.turned("A"), d.mask()))

query("x_inner_prod_disjoint", "SELECT CAST(0.0 AS DOUBLE) AS v")(lambda d: Kernel.registry["inner_prod"](d.cube("R", k=0), d.cube("A", k=1)))
query("x_cancel", f"SELECT i, j, CAST(0.0 AS DOUBLE) AS v FROM {R}")(lambda d: evaluate(d.flag("R")["i", "j"] + reshape.scale(d.flag("R"), -1.0)["i", "j"]))
query("x_sssmm_prefilter", ORACLES["sssmm"])(lambda d: Kernel.registry["sssmm"](d.flag("R"), d.turned("A"), d.mask(), prefilter=True))
query("x_coo_spgemm", ORACLES["spgemm"])(lambda d: evaluate(contract("j", d.flag("R", "COO")["i", "j"] * d.flag("A", "COO", "l_partkey", "l_suppkey")["j", "k"])))
query("x_spmv", f"SELECT a.i, SUM(a.v * b.v) AS v FROM {R} a JOIN {SIZE} b USING (j) GROUP BY 1")(lambda d: evaluate(contract("j", d.flag("R", "DCSR")["i", "j"] * d.sizes()["j"])))
query("x_row_dot", f"SELECT i, SUM(a.v * b.v) AS v FROM {R} a JOIN {A} b USING (i, j) GROUP BY i")(lambda d: evaluate(contract("j", d.flag("R", "DCSR")["i", "j"] * d.flag("A", "DCSR")["i", "j"])))
query("x_row_sum", f"SELECT i, SUM(v) AS v FROM {R} GROUP BY i")(lambda d: evaluate(contract("j", d.flag("R", "DCSR")["i", "j"])))
query("x_total", f"SELECT COALESCE(SUM(v), 0.0) AS v FROM {R}")(lambda d: evaluate(contract(("i", "j"), d.flag("R")["i", "j"])))
query("x_scale_rows", f"SELECT i, j, a.v * b.v AS v FROM {R} a JOIN {NATION} b USING (i)")(lambda d: evaluate(d.flag("R")["i", "j"] * d.nations()["i"]))
query("x_scale_sum", f"SELECT i, SUM(a.v * b.v) AS v FROM {R} a JOIN {NATION} b USING (i) GROUP BY i")(lambda d: evaluate(contract("j", d.flag("R", "DCSR")["i", "j"] * d.nations()["i"])))
query("x_vector_add", f"SELECT i, SUM(v) AS v FROM (SELECT i, v FROM {NATION} UNION ALL SELECT j, v FROM {SIZE}) GROUP BY i")(lambda d: evaluate(d.nations()["i"] + reshape.rename(d.sizes(), j="i")["i"]))
query("x_outer", f"SELECT a.i, b.j, a.v * b.v AS v FROM {NATION} a CROSS JOIN {SIZE} b")(lambda d: evaluate(d.nations()["i"] * d.sizes()["j"], whole=True))
query("x_add_bc", f"SELECT i, j, SUM(v) AS v FROM (SELECT i, j, v FROM {R} UNION ALL SELECT i, j, v FROM range((SELECT MAX(s_suppkey) + 1 FROM supplier)) r(i) CROSS JOIN {SIZE}) GROUP BY i, j")(lambda d: evaluate(reshape.resize(d.flag("R", "DCSR"), i=d.suppliers)["i", "j"] + bc("i", d.sizes()["j"]), whole=True))
query("x_factored", f"SELECT i, j, a.v * b.v AS v FROM ({_union(R, A)}) a JOIN {N} b USING (i, j)")(lambda d: evaluate((d.flag("R")["i", "j"] + d.flag("A")["i", "j"]) * d.flag("N")["i", "j"]))
query("x_nested_sum", f"SELECT i, SUM(v) AS v FROM (SELECT i, v FROM {NATION} UNION ALL SELECT i, SUM(v) AS v FROM {R} GROUP BY i) GROUP BY i")(lambda d: evaluate(d.nations()["i"] + contract("j", d.flag("R", "DCSR")["i", "j"])))
query("x_self_product", f"SELECT a.i, b.i AS k, SUM(a.v * b.v) AS v FROM {R} a JOIN {R} b USING (j) GROUP BY 1, 2")(lambda d: evaluate(contract("j", (t := d.flag("R", "DCSR"))["i", "j"] * t["k", "j"])))
query("x_transpose", f"SELECT j AS i, i AS j, v FROM {R}")(lambda d: reshape.transpose(d.flag("R")))
query("x_permute3", f"SELECT k, i, j, v FROM {R3}")(lambda d: reshape.permute(d.cube("R", "COO3"), "k", "i", "j"))
query("x_ttv", f"SELECT i, k, SUM(a.v * b.v) AS v FROM {R3} a JOIN {SIZE} b USING (j) GROUP BY i, k")(lambda d: evaluate(contract("j", d.cube("R")["i", "j", "k"] * d.sizes()["j"])))
query("x_mttkrp", f"SELECT a.i, b.k AS r, SUM(a.v * b.v * c.v) AS v FROM {R3} a JOIN (SELECT i AS j, k, SUM(v) AS v FROM {R3} GROUP BY 1, 2) b USING (j) JOIN (SELECT j AS q, k, SUM(v) AS v FROM {R3} GROUP BY 1, 2) c ON c.q = a.k AND c.k = b.k GROUP BY 1, 2")(
    lambda d: evaluate(contract(("j", "k"), (t := d.cube("R"))["i", "j", "k"] * contract("y", t["j", "y", "r"]) * contract("x", t["x", "k", "r"])))
)
query("x_densify", f"SELECT r.i, COALESCE(s.v, 0.0) AS v FROM range((SELECT MAX(s_suppkey) + 1 FROM supplier)) r(i) LEFT JOIN (SELECT i, SUM(v) AS v FROM {R} GROUP BY i) s ON s.i = r.i")(lambda d: evaluate(contract("j", reshape.resize(d.flag("R", "CSR"), i=d.suppliers)["i", "j"])))
query("x_prune", f"SELECT i, j, a.v - b.v AS v FROM {R} a JOIN {A} b USING (i, j) WHERE a.v <> b.v")(lambda d: reshape.prune(evaluate(d.flag("R")["i", "j"] * _one(d.flag("A"))["i", "j"] + reshape.scale(d.flag("A"), -1.0)["i", "j"] * _one(d.flag("R"))["i", "j"])))
query("x_clip", f"SELECT i, j, v FROM {R} WHERE i < 20 AND j < 50")(lambda d: reshape.clip(d.flag("R", "DCSR"), i=20, j=50))
query("x_shift", f"WITH s AS (SELECT MAX(s_suppkey) + 1 AS m FROM supplier), p AS (SELECT MAX(p_partkey) + 1 AS m FROM part) SELECT LEAST(i + 1, s.m - 1) AS i, LEAST(j + 1, p.m - 1) AS j, SUM(v) AS v FROM {R}, s, p GROUP BY 1, 2")(lambda d: reshape.shift(reshape.resize(d.flag("R"), i=d.suppliers, j=d.parts)))
query("x_flatten", f"SELECT j * (SELECT MAX(s_suppkey) + 1 FROM supplier) + i AS i, v FROM {R}")(lambda d: reshape.flatten(reshape.resize(d.flag("R"), i=d.suppliers, j=d.parts)))
query("x_csr_roundtrip", f"SELECT i, j, v FROM {R}")(lambda d: layouts.from_csr(layouts.to_csr(d.flag("R"), 100)))
query("x_csf3_roundtrip", f"SELECT i, j, k, v FROM {R3}")(lambda d: layouts.from_csf3(layouts.to_csf3(d.cube("R"), 10)))
query("x_min_plus", f"SELECT a.i, b.k, MIN(a.v + b.v) AS v FROM {R} a JOIN {AT} b USING (j) GROUP BY 1, 2")(lambda d: Kernel.registry["spgemm"](d.flag("R"), d.turned("A"), ring=MIN_PLUS))



def _scratch(spark: SparkSession) -> str:
    """A new place in the folder that all executors share; on one machine, where none is set, in one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{found or 'file://' + tempfile.mkdtemp(prefix='tensors-')}/{uuid.uuid4().hex}"


def _mtx(d: Data) -> SparseTensor:
    path = _scratch(d.spark)
    text.write_matrix_market(reshape.resize(d.flag("R"), i=d.suppliers, j=d.parts), path)
    return text.read_matrix_market(d.spark, path)


def _symmetric(d: Data, sign: str) -> SparseTensor:
    """The strictly lower part of R by supplier and part modulo suppliers, read with a symmetry."""
    n, path = d.suppliers, _scratch(d.spark)
    rows = d.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % n).alias("j"), "l_quantity").where("i > j")
    t = SparseTensor.from_df(rows, ["i", "j"], "l_quantity", shape={"i": n, "j": n})
    text.write_matrix_market(t, path)
    lines = d.spark.read.text(path)
    lines.select(F.when(F.startswith("value", F.lit("%%")), F.replace("value", F.lit("general"), F.lit(sign))).otherwise(F.col("value")).alias("value")).write.text(path + "-s")
    return text.read_matrix_market(d.spark, path + "-s")


def _tns(d: Data, order: tuple[int, ...] | None = None) -> SparseTensor:
    path = _scratch(d.spark)
    text.write_tns(d.cube("R", "COO3"), path)
    return text.read_tns(d.spark, path, ("i", "j", "k"), mode_order=order)


def _halves(d: Data, flag: str, *, turned: bool = False) -> SparseTensor:
    """Tenths of quantities, in single precision."""
    i, j = ("l_partkey", "l_suppkey") if turned else ("l_suppkey", "l_partkey")
    rows = d.table("lineitem").where(F.col("l_returnflag") == flag).select(i, j, (F.col("l_quantity") / 10).alias("q"))
    return SparseTensor.from_df(rows, {"i": i, "j": j} if not turned else {"j": i, "k": j}, "q", format="CSR", dtype="float")


def _levels(d: Data) -> DataFrame:
    """The format of a sum and a product of every two levels."""
    codes = list(BY_CODE)
    return d.spark.createDataFrame([(a, b, add_levels(BY_CODE[a], BY_CODE[b]).code, mul_levels(BY_CODE[a], BY_CODE[b]).code) for a in codes for b in codes], "a string, b string, plus string, times string")


def _layouts(d: Data) -> DataFrame:
    """The layout of a sum and a product of every two named matrix layouts."""
    rows = []
    for a in ("CSR", "DCSR", "COO"):
        for b in ("CSR", "DCSR", "COO"):
            x, y = (Format.of(n, "i", "j") for n in (a, b))
            rows.append((a, b, add_formats(x, y).signature, mul_formats(x, y).signature))
    return d.spark.createDataFrame(rows, "a string, b string, plus string, times string")


_low = "(SELECT l_suppkey AS i, l_partkey % (SELECT MAX(s_suppkey) + 1 FROM supplier) AS j, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"
R_F, A_F = (f"(SELECT l_suppkey AS i, l_partkey AS j, CAST(SUM(CAST(l_quantity / 10 AS FLOAT)) AS FLOAT) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2)" for f in "RA")
query("x_mtx_roundtrip", f"SELECT i, j, v FROM {R}")(_mtx)
query("x_mtx_symmetric", f"SELECT i, j, v FROM {_low} WHERE i > j UNION ALL SELECT j, i, v FROM {_low} WHERE i > j")(lambda d: _symmetric(d, "symmetric"))
query("x_mtx_skew", f"SELECT i, j, v FROM {_low} WHERE i > j UNION ALL SELECT j, i, -v FROM {_low} WHERE i > j")(lambda d: _symmetric(d, "skew-symmetric"))
query("x_tns_roundtrip", f"SELECT i, j, k, v FROM {R3}")(_tns)
query("x_tns_modes", f"SELECT k AS i, i AS j, j AS k, v FROM {R3}")(lambda d: _tns(d, (2, 0, 1)))
query("x_coo", f"SELECT i, j, v FROM {R}")(lambda d: layouts.to_coo(d.flag("R", "COO")))
query("x_coo3", f"SELECT i, j, k, v FROM {R3}")(lambda d: layouts.to_coo(d.cube("R", "COO3")))
query("x_from_coo", f"SELECT l_suppkey AS i, l_partkey AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2")(lambda d: layouts.from_coo(d.table("lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), ["i", "j"]))
query("x_csr_offsets", f"SELECT r.i, CAST(COALESCE(SUM(n) OVER (ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, COALESCE(n, 0) AS n FROM range((SELECT MAX(s_suppkey) + 1 FROM supplier)) r(i) LEFT JOIN (SELECT i, COUNT(*) AS n FROM {R} GROUP BY i) c ON c.i = r.i")(lambda d: layouts.csr_offsets(reshape.resize(d.flag("R"), i=d.suppliers)))
query("x_dcsr_offsets", f"SELECT ROW_NUMBER() OVER (ORDER BY i) - 1 AS p, i, CAST(COALESCE(SUM(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM (SELECT i, COUNT(*) AS n FROM {R} GROUP BY i)")(lambda d: layouts.dcsr_offsets(d.flag("R", "DCSR")))
query("x_dcsr_roundtrip", f"SELECT i, j, v FROM {R}")(lambda d: layouts.from_dcsr(layouts.to_dcsr(d.flag("R", "DCSR"), 100)))
query("x_operand_order", ORACLES["spgemm"])(lambda d: Kernel("swapped").expr(contract("j", declare("a", "CSR", "i", "j") * declare("b", "CSR", "j", "k"))).operand_ordering(["b", "a"])(d.turned("A"), d.flag("R")))
query("x_arrow_roundtrip", f"SELECT i, v FROM {NATION}")(lambda d: SparseTensor.from_arrow(d.spark, d.nations().to_arrow(), ["i"]))
query("x_f32_add", f"SELECT i, j, CAST(SUM(v) AS FLOAT) AS v FROM (SELECT * FROM {R_F} UNION ALL SELECT * FROM {A_F}) GROUP BY 1, 2")(lambda d: evaluate(_halves(d, "R")["i", "j"] + _halves(d, "A")["i", "j"]))
query("x_f32_mul", f"SELECT i, j, CAST(a.v * b.v AS FLOAT) AS v FROM {R_F} a JOIN {A_F} b USING (i, j)")(lambda d: evaluate(_halves(d, "R")["i", "j"] * _halves(d, "A")["i", "j"]))
query("x_f32_spgemm", f"SELECT a.i, b.i AS k, CAST(SUM(CAST(CAST(a.v * b.v AS FLOAT) AS DOUBLE)) AS FLOAT) AS v FROM {R_F} a JOIN {A_F} b USING (j) GROUP BY 1, 2")(lambda d: evaluate(contract("j", _halves(d, "R")["i", "j"] * _halves(d, "A", turned=True)["j", "k"])))
_one_of = "(VALUES ('d'), ('cu'), ('cn'), ('su'), ('sn'))"
query("x_level_tables", f"SELECT a, b, CASE WHEN a = 'd' OR b = 'd' THEN 'd' ELSE (CASE WHEN a LIKE 's%' AND b LIKE 's%' THEN 's' ELSE 'c' END) || (CASE WHEN a LIKE '%u' AND b LIKE '%u' THEN 'u' ELSE 'n' END) END AS plus, CASE WHEN a = 'd' THEN b WHEN b = 'd' THEN a ELSE (CASE WHEN a LIKE 's%' OR b LIKE 's%' THEN 's' ELSE 'c' END) || (CASE WHEN a LIKE '%u' OR b LIKE '%u' THEN 'u' ELSE 'n' END) END AS times FROM {_one_of} x(a) CROSS JOIN {_one_of} y(b)")(_levels)
query("x_layout_tables", "SELECT * FROM (VALUES ('CSR', 'CSR', 'd_cu', 'd_cu'), ('CSR', 'DCSR', 'd_cu', 'cu_cu'), ('CSR', 'COO', 'd_cu', 'cn_su'), ('DCSR', 'CSR', 'd_cu', 'cu_cu'), ('DCSR', 'DCSR', 'cu_cu', 'cu_cu'), ('DCSR', 'COO', 'cn_cu', 'cu_su'), ('COO', 'CSR', 'd_cu', 'cn_su'), ('COO', 'DCSR', 'cn_cu', 'cu_su'), ('COO', 'COO', 'cn_su', 'cn_su')) t(a, b, plus, times)")(_layouts)


def _one(t: SparseTensor) -> SparseTensor:
    """The stored coordinates of t, each with 1."""
    return replace(t, df=t.df.select(*t.indices, F.lit(1.0).alias("v")), name="", then=lambda _: F.lit(1.0))
