from types import SimpleNamespace

import pytest

from sedimenta.plans import workspace as W


def test_tables_come_and_go(spark):
    ws = W.Workspace(spark, "test")
    for name in ("a", "b", "c"):
        assert ws.write(spark.range(3), name).count() == 3
    ws.keep("b")
    assert ws.names == {"b"} and ws.read("id long", "b").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ws.read("id long", "a").count()
    ws.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ws.read("id long", "b").count()


def test_a_cluster_needs_a_shared_folder():
    for master, ok in (("local[4]", True), ("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        folder = {"at": None}
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda f=folder: f["at"], setCheckpointDir=lambda x, f=folder: f.update(at=x))
        if ok:
            assert W.shared_dir(SimpleNamespace(sparkContext=sc)).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                W.shared_dir(SimpleNamespace(sparkContext=sc))
    sc.getConf = lambda: SimpleNamespace(get=lambda *_: "hdfs://shared/x/")
    assert W.shared_dir(SimpleNamespace(sparkContext=sc)) == "hdfs://shared/x"
