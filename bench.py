"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then REPEATS times; the time is the mean without the fastest and
the slowest. Results go to a sink that computes every row and keeps none. "naive" has the times of
plain Spark forms of some of them, under the same protocol: full outer joins for sums, and
products as they are written, without a rewrite.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.catalogue import QUERIES, Data
from tensorframe.kernels import Kernel
from tensorframe.plans.expr import contract
from tensorframe.plans.lower import evaluate

HEADLINE = ["csr_add", "csr_add_3", "csr_mul", "coo_add", "coo_mul", "coo_csr_add", "dcsr_add", "dcsr_mul", "dcsr_mul_without_recursive_partitioning", "csf_add", "coo3d_add", "inner_prod", "inner_prod_coo", "spgemm", "sssmm", "x_sssmm_prefilter", "x_spmv", "x_factored", "x_scale_sum", "x_mttkrp"]
REPEATS = int(os.environ.get("BENCH_REPEATS", "4"))


def outer(*tensors) -> DataFrame:
    """A sum by full outer joins."""
    out = None
    for k, t in enumerate(tensors):
        df = t.df.withColumnRenamed("v", f"v{k}")
        out = df if out is None else out.join(df, list(t.indices), "full_outer")
    total = sum((F.coalesce(f"v{k}", F.lit(0.0)) for k in range(1, len(tensors))), F.coalesce("v0", F.lit(0.0)))
    return out.select(*tensors[0].indices, total.alias("v"))


NAIVE = {
    "csr_add": lambda d: outer(d.flag("R"), d.flag("A")),
    "csr_add_3": lambda d: outer(d.flag("R"), d.flag("A"), d.flag("N")),
    "csf_add": lambda d: outer(d.cube("R"), d.cube("A")),
    "sssmm": lambda d: Kernel.registry["sssmm"](d.flag("R"), d.turned("A"), d.mask(), rewrite=False).df,
    "x_factored": lambda d: outer(d.flag("R"), d.flag("A")).join(d.flag("N").df.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")),
    "x_scale_sum": lambda d: evaluate(contract("j", d.flag("R", "DCSR")["i", "j"] * d.nations()["i"]), rewrite=False).df,
}


def timed(make) -> float:
    took = []
    for _ in range(REPEATS + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    kept = sorted(took[1:])[1:-1] or took[1:]
    return round(sum(kept) / len(kept), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    naive = {name: timed(lambda make=make: make(Data(spark, sf_dir))) for name, make in NAIVE.items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "naive": naive, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
