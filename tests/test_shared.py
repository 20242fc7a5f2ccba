"""The shared folder with and without the cluster's setting."""

from types import SimpleNamespace

import pytest

from lodestone.plans import shared
from lodestone.plans.components import components


def fake(setting, master):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda key: setting)))


def test_the_cluster_names_the_folder():
    assert shared.shared_dir(fake("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared.shared_dir(fake(None, "yarn"))


def test_local_sessions_get_one_folder_each(spark, monkeypatch):
    local = fake(None, "local[2]")
    assert shared.shared_dir(local) == shared.shared_dir(local) != shared.shared_dir(fake(None, "local[3]"))
    monkeypatch.setattr(shared, "shared_dir", lambda s, d=shared.shared_dir(local): d)
    assert shared.materialise(spark.range(5), "five").count() == 5


def test_tables_are_released_once_they_are_read(spark):
    first = shared.materialise(spark.range(5), "first")
    second = shared.materialise(first.selectExpr("id + 1 as id"), "second")
    path = first._held_at
    assert shared.exists(spark, path)
    shared.release(first, first, spark.range(3), second.where("id > 1"))
    assert not shared.exists(spark, path) and path not in shared.HELD
    assert second.count() == 5 and second._held_at in shared.HELD


def test_rounds_leave_no_tables_behind(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    held = set(shared.HELD)
    found = components(edges)
    left = set(shared.HELD) - held
    assert len(left) == 2 and {r.component for r in found.collect()} == {0}
    assert found.count() == 61  # read again after the rounds' tables have gone
