"""Where intermediate data may go."""

import pytest

from pelagia.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):  # noqa: N802
        return self.dir

    def setCheckpointDir(self, path):  # noqa: N802
        self.dir = path


class Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": configured}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session(master))


def test_setting_is_used_and_local_masters_get_a_folder():
    assert ensure_checkpoint_dir(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert ensure_checkpoint_dir(Session("local[4]")).startswith("/tmp/spark-")
