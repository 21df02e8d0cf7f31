"""Session helpers: cluster settings never override a job's own settings;
bounded intermediate results are checkpointed under spark.checkpoint.dir."""

import os

import pytest

from workload_audit.session import CLUSTER_CONF, apply_cluster_conf, checkpoint_dir


def test_apply_cluster_conf_keeps_explicit_settings(spark):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "8")
        apply_cluster_conf(spark)
        assert spark.conf.get(key) == "8"  # explicit job setting wins
        apply_cluster_conf(spark, {key: "16"})
        assert spark.conf.get(key) == "16"  # explicit override
    finally:
        spark.conf.set(key, old)
    assert all(k.startswith("spark.") for k in CLUSTER_CONF)


def test_checkpoints_go_to_the_named_folder(spark):
    named = checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir", named) == named
    own = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")  # Spark's own folder below the named one
    listed = lambda: set(os.listdir(own)) if os.path.isdir(own) else set()
    before = listed()
    df = spark.range(10).orderBy("id").limit(3).checkpoint()
    assert [r.id for r in df.collect()] == [0, 1, 2]
    assert listed() - before  # the checkpoint was written there


def test_no_named_folder_is_an_error():
    class Nothing:
        isDefined = staticmethod(lambda: False)  # noqa: N815

    class Context:
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Nothing)}))})

    session = type("Session", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": Context})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)
