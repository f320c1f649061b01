"""What stays on disk."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quarrylog.llm import common


def test_materialize_leaves_no_shuffle_files(spark):
    """What a write shuffled goes with its end; what it wrote goes when it is discarded."""
    jvm = spark.sparkContext._jvm
    folders = [Path(d) for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for d in folders for p in d.glob("*/shuffle_*")}
    before, setting = files(), spark.conf.get(common._CLEANUP, None)
    df = common.materialize(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "test")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._CLEANUP, None) == setting
    assert df.count() == 10 and np.sum([r["count"] for r in df.collect()]) == 1000
    path = Path(df._written.removeprefix("file://"))
    assert path.exists()
    common.discard(df)
    assert not path.exists()
