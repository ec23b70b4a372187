from types import SimpleNamespace

import pytest

from figloom import workspace


def session(master, folder=None, known=None):
    """What shared_dir asks of a session."""
    checkpoint = SimpleNamespace(isDefined=lambda: known is not None, get=lambda: known)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: checkpoint))
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}, _jsc=jsc)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)


def test_a_cluster_must_name_a_shared_folder():
    assert workspace.shared_dir(session("spark://host:7077", "hdfs://x")) == "hdfs://x"
    assert workspace.shared_dir(session("yarn", known="hdfs://y")) == "hdfs://y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            workspace.shared_dir(session(master))


def test_written_tables_are_cleared(spark):
    t = workspace.materialize(spark.range(5), "numbers")
    assert t.count() == 5
    workspace.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t._figloom_path).count()
