"""The shared folder comes from the session, with a fallback for local masters only."""

from types import SimpleNamespace

import pytest

from plumbline.session import settle, shared_folder


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_configured_folder_wins():
    assert shared_folder(fake("yarn", "s3a://bucket/tmp/")) == "s3a://bucket/tmp"


def test_cluster_without_setting_is_refused():
    with pytest.raises(ValueError):
        shared_folder(fake("yarn"))


def test_local_fallback_is_kept():
    first = shared_folder(fake("local[2]"))
    assert first and shared_folder(fake("local[2]")) == first


def test_settled_frame_is_read_from_the_folder(spark):
    stored = settle(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert stored.count() == 10 and all(shared_folder(spark) in path for path in stored.inputFiles())
