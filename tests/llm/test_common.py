from types import SimpleNamespace

import pytest

from tessera.llm.common import Scratch, components
from tessera.session import shared_dir


def fake(master, at=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: at or d), sparkContext=SimpleNamespace(master=master))


def test_no_local_folder_on_a_cluster():
    for master in ("spark://a:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(fake(master))
        assert shared_dir(fake(master, "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(fake("local[4]")).endswith("/checkpoints") and shared_dir(fake("local"))


def test_tables_that_nothing_reads_are_deleted(spark):
    s = Scratch(spark, "test")
    kept = s.table(spark.range(3), "a")
    s.table(spark.range(4), "b")
    s.only("a")
    assert kept.count() == 3 and s.held == ["a"]
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.root}/b")


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
