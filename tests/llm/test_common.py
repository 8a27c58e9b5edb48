"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from seatwise.llm.common import shared_folder


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named), sparkContext=SimpleNamespace(
        master=master, getCheckpointDir=lambda: None))


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(session("spark://one:7077", "hdfs:///scratch/")) == "hdfs:///scratch"
    for master in ("yarn", "spark://one:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
