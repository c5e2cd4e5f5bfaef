"""The folder for lineage cuts where ``spark.checkpoint.dir`` is not set: a session of its own process."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from alertweave.session import cut_lineage, stored

SCRIPT = """
from alertweave.session import cut_lineage, local_session, shared_folder

spark = local_session("2", partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_folder(spark)
assert folder == shared_folder(spark) == spark.sparkContext.getCheckpointDir()
print(sorted(row.id for row in cut_lineage(spark.range(3)).collect()))
"""


def test_runs_without_the_setting(tmp_path):
    root = Path(__file__).resolve().parent.parent
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root), "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=180)
    assert run.stdout.strip().endswith("[0, 1, 2]"), run.stderr[-2000:]


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {file.name for folder in folders for file in Path(folder).rglob("shuffle_*.data")}


def test_no_shuffle_stays_behind_a_kept_step(spark):
    """What a step shuffled goes when its result is kept as files; a frame that runs again gives the same rows."""
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("key")).agg(F.count("*").alias("n")).repartition("n")
    before = shuffle_files(spark)
    kept = [step(frame) for step in (cut_lineage, lambda rows: stored(rows, "kept"))]
    assert shuffle_files(spark) <= before
    want = sorted(map(tuple, frame.collect()))
    assert shuffle_files(spark) - before
    assert [sorted(map(tuple, rows.collect())) for rows in (*kept, frame)] == [want] * 3 and len(want) == 7
