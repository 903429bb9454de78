import pytest

from caselens import scratch


class Session:
    """Only what is asked of a session."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: folder)})


def test_the_shared_folder_is_used():
    path = scratch.scratch_path(Session("yarn", "hdfs://shared/"), "pages")
    assert path.startswith("hdfs://shared/caselens/pages-")
    assert path != scratch.scratch_path(Session("yarn", "hdfs://shared/"), "pages")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session("yarn", None), "pages")


def test_a_local_session_does_not():
    assert scratch.scratch_path(Session("local[4]", None), "pages").startswith("/tmp/run-")
