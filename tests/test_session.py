from types import SimpleNamespace

import pytest

from scanlytics.session import scratch_path, shared_folder


class Context:
    def __init__(self, master, named=None):
        self.master = master
        self.named = named
        self.folder = None

    def getConf(self):
        return SimpleNamespace(get=lambda key: self.named)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, named=None):
    context = Context(master, named)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_named_folder_is_used():
    spark = session("spark://x", "hdfs://shared/")
    assert shared_folder(spark) == "hdfs://shared"
    assert spark.sparkContext.folder == "hdfs://shared/"
    assert scratch_path(spark, "t") != scratch_path(spark, "t")


def test_local_session_gets_one_folder():
    spark = session("local[2]")
    assert shared_folder(spark) == shared_folder(spark) == spark.sparkContext.folder


def test_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_real_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
