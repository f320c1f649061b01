"""A stream of log lines that keeps a cumulative table of error patterns.

Each micro-batch is parsed and deduplicated like a batch, and rows of new keys are appended
to a Parquet table as ``batch=<id>``. A batch that is tried again overwrites its own folder
and does not look at it, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup, detail, parse
from ..schemas import DATABASE_KEY, DETAIL

SCHEMA = T.StructType([*DETAIL.fields, T.StructField("seq", T.LongType()), T.StructField("batch", T.LongType())])


def append_batch(lines: DataFrame, batch: int, table: str) -> None:
    spark: SparkSession = lines.sparkSession
    records = dedup.dedup_structured(parse.parse_records(lines))
    rows = detail.detail_rows(records)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if exists:
        known = spark.read.schema(SCHEMA).parquet(table).where(F.col("batch") != batch)
        rows = dedup.append_new(known, rows, DATABASE_KEY)
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def start(lines: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``lines``: a stream of (source_name, seq, line); a record must not be split over micro-batches."""
    writer = lines.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, table)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
