"""The shared folder."""

import pytest

from guardlake.session import shared_folder


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master=master))
    assert shared_folder(Session(spark_master=master, **{"spark_checkpoint_dir": "hdfs://n/x/"})
                         ) == "hdfs://n/x"


def test_temporary_folder_on_a_local_master():
    session = Session(spark_master="local[8]")
    assert shared_folder(session) == session.conf["spark.checkpoint.dir"]
