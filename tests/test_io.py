"""Intermediate tables: where they lie and when they go."""

import os

import pytest

from kennelflow import io


class Session:
    def __init__(self, **conf):
        self.conf = self
        self.values = conf

    def get(self, key, default=None):
        return self.values.get(key.rsplit(".", 2)[-2] if key.startswith("spark.checkpoint") else key.rsplit(".", 1)[-1], default)

    def set(self, key, value):
        self.values["checkpoint"] = value


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "k8s://h", "local-cluster[3,2,1000]", ""])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_dir(Session(master=master))
    assert io.shared_dir(Session(master=master, checkpoint="hdfs://x/shared/")) == "hdfs://x/shared"


def test_one_process_may_go_without():
    assert io.shared_dir(Session(master="local[4]")).startswith("file:///")


def test_tables_are_kept_and_released(spark):
    kept = [io.cut_lineage(spark.range(n)) for n in (3, 5)]
    assert [k.count() for k in kept] == [3, 5]
    at = [k._kept_at.removeprefix("file://") for k in kept]
    io.release(kept[0], None, spark.range(1))
    assert [os.path.exists(p) for p in at] == [False, True]
    io.release_all(spark)
    assert not os.path.exists(at[1])


def test_latest_rows_take_the_greater_on_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 9, "q")], "k string, v int, t string")
    assert {(r.k, r.t) for r in io.latest_rows(df, "k", "v", ["t"]).collect()} == {("a", "z"), ("b", "n")}
