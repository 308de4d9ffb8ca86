import pytest

from lexiweave import session


class Unset:
    """A session whose checkpoint folder is not set."""

    def __init__(self, spark, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": spark.sparkContext.applicationId + master})


def test_scratch_is_the_sessions_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = session.scratch_root(spark)
    assert root == configured.rstrip("/") if configured else root == session.scratch_root(spark)


def test_scratch_without_a_setting(spark):
    local = Unset(spark, "local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)
    with pytest.raises(ValueError):
        session.scratch_root(Unset(spark, "spark://host:7077"))


def test_finished(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert session.finished(spark, str(tmp_path / "t")) and session.has_files(spark, str(tmp_path / "t"), "*.parquet")
    (tmp_path / "u").mkdir()
    assert not session.finished(spark, str(tmp_path / "u")) and not session.has_files(spark, str(tmp_path / "u"), "*.parquet")


def test_spread(spark):
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
