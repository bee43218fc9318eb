import pytest

from netweir.plans import sizing


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, master, conf):
        self.conf = Conf(conf)
        self.sparkContext = type("SC", (), {"master": master})


def test_scratch_uses_the_shared_folder_and_refuses_a_cluster_without_one():
    assert sizing.scratch_dir(Fake("yarn", {"spark.checkpoint.dir": "hdfs:///scratch/"}), "a").startswith("hdfs:///scratch/a-")
    assert "netweir-" in sizing.scratch_dir(Fake("local[2]", {}), "a")
    with pytest.raises(RuntimeError):
        sizing.scratch_dir(Fake("spark://host:7077", {}), "a")


def test_bounds(spark):
    small, big = spark.range(5), spark.range(50)
    assert sizing.is_bounded(small, 5) and not sizing.is_bounded(big, 5)
    assert sizing.broadcast_if_bounded(big, 5) is big
    with pytest.raises(ValueError):
        sizing.config_rows(big, 5)
    assert sorted(r.id for r in sizing.pin_if_small(small).collect()) == list(range(5))


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id * 2 AS x")
    back = sizing.materialize(df, "m")
    assert back.agg({"x": "sum"}).first()[0] == 90 and "FileScan" in back._jdf.queryExecution().executedPlan().toString()
