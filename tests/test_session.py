"""Session defaults fill only what is unset; building a plan runs nothing."""

import os
import subprocess
import sys

import pytest

from corpusdelta.session import ensure_checkpoint_dir, get_spark, spread
from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_submit_settings_survive():
    code = ("from corpusdelta.session import get_spark; s = get_spark(); "
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.session.timeZone'))")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS":
                        "--master local[2] --conf spark.sql.shuffle.partitions=200 --conf spark.ui.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200).stdout
    assert "GOT local[2] 200 UTC" in out


def test_active_session_is_kept(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert get_spark(shuffle_partitions=3) is spark
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_spread_starts_no_job(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        out = spread(docs.join(labels.hint("merge"), "doc_id"), "doc_id")
        assert len(tracker.getJobIdsForGroup("spread")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == labels.count()


def test_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_workers_elsewhere_get_the_package(tmp_path):
    """A driver that knows the package by its own path alone."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            f"print('GOT', E.queries()['cluster_target_senses'](s, {SF_SMALL!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "GOT 500" in out.stdout, out.stderr[-2000:]
