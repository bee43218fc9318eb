"""Exact quantiles by ranks equal Spark's own percentile."""

import random

from pyspark.sql import functions as F

from netweir.operators.quantiles import group_quantiles

QS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.999, "p100": 1.0}


def expected(rows, keys, value):
    return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in QS.items()])


def test_quantiles_equal_percentile(spark):
    rng = random.Random(3)
    data = [(rng.choice((1, 6, 17, None)), rng.choice(("a", None)), rng.choice((None, rng.randint(-9, 9), rng.randint(0, 10**12)))) for _ in range(5000)]
    data += [(99, "one", 5), (98, "none", None), (98, "none", None), (97, "two", 1), (97, "two", 2)]
    rows = spark.createDataFrame(data, "k int, t string, v long").repartition(6)
    for keys in (["k"], ["k", "t"]):
        got, want = group_quantiles(rows, keys, "v", QS), expected(rows, keys, "v")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert group_quantiles(rows.limit(0), ["k"], "v", QS).count() == 0


def test_no_task_holds_a_whole_group(spark):
    """A single group of many different values is dealt over ranges; percentile keeps all its values in one task's buffer."""
    rows = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = group_quantiles(rows, ["k"], "v", QS)
        plan = got._jdf.queryExecution().executedPlan().toString()
        parts = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "percentile" not in plan and len(parts) == 4 and max(r["count"] for r in parts) < 100_000
    assert sorted(map(str, got.collect())) == sorted(map(str, expected(rows, ["k"], "v").collect()))


def test_the_query_keeps_no_percentile_buffer(spark):
    from netweir.catalog import load
    from netweir.catalog.registry import QUERIES

    load()

    class C:
        li = {"flows": spark.createDataFrame([(6, 10, 2), (6, 30, 1), (17, 5, 1)], "protocol int, bytes long, sampling_rate int").withColumn("packets", F.lit(1))}

    df = QUERIES["FUN-07_quantiles"](C())
    assert "percentile" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(6, 25.0, 29.5), (17, 5.0, 5.0)]
