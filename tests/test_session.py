"""The shared folder and written intermediates."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cartwise import session
from tests.conftest import rows


def test_cluster_without_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in session.shared_dir(spark)
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))


def test_materialized_rows_do_not_change(spark):
    df = spark.range(50).withColumn("r", F.rand()).repartition(3)
    stored = session.materialize(df)
    assert stored.dtypes == df.dtypes
    assert rows(stored) == rows(stored) and stored.count() == 50
