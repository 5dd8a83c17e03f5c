import pytest

from cvebeacon import session as S


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, setting=None):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.checkpoint.dir": setting}


def test_the_cluster_setting_decides():
    spark = FakeSession("yarn", "hdfs://shared/work/")
    assert S.shared_folder(spark, "x").startswith("hdfs://shared/work/x-")
    assert S.shared_folder(spark, "x") != S.shared_folder(spark, "x")


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(ValueError):
        S.shared_folder(FakeSession("yarn"), "x")


def test_only_a_local_master_gets_a_temporary_folder():
    spark = FakeSession("local[2]")
    first = S.shared_folder(spark, "x")
    assert first.rsplit("/", 1)[0] == S.shared_folder(spark, "y").rsplit("/", 1)[0]


def test_materialize_and_state_session(spark):
    stored = S.materialize(spark.range(5), "numbers")
    assert stored.count() == 5 and len(stored.inputFiles()) > 0
    streams = S.state_session(spark)
    assert int(streams.conf.get("spark.sql.shuffle.partitions")) <= spark.sparkContext.defaultParallelism
