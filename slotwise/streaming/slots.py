"""Count-based slots and clamped timestamps of a stream, batch by batch, into a sink that survives retries.

A request's number and the largest timestamp so far depend on all requests before it. Within a batch both are found as in the batch
operators, in parallel; from batch to batch two numbers are handed on, in a row that is written beside the batch's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.operators.requests import clamp_time
from slotwise.sources.trace import number_rows, with_slots

_STATE = "next_seq long, last_ts double"


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def slot_batch(requests: DataFrame, batch: int, path: str, slot_size: int, raw: str = "raw_ts") -> None:
    """Number, clamp and write one batch: {path}/slots/batch=N/slot=S, and what the next batch goes on from: {path}/state/batch=N.

    The batch's number is in both paths and both are overwritten, so a batch that is run again after a failure, or twice, leaves each of its
    requests once. What came before is read from the batch before, never from what this one may have left.
    """
    spark = requests.sparkSession
    seq, last = 0, None
    if batch > 0:
        seq, last = spark.read.schema(_STATE).parquet(f"{path}/state/batch={batch - 1}").first()
    numbered = number_rows(requests, "place").withColumn("seq", F.col("seq") + seq)
    out = clamp_time(with_slots(numbered, slot_size), raw, last)
    out.write.mode("overwrite").partitionBy("slot").json(f"{path}/slots/batch={batch}")
    if _exists(spark, f"{path}/slots/batch={batch}/_SUCCESS"):
        schema = out.select("seq", "ts").schema
        ends = spark.read.schema(schema).json(f"{path}/slots/batch={batch}").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"))  # ts never falls
    else:
        ends = out.agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"))
    state = ends.select(F.coalesce(F.col("seq") + 1, F.lit(seq)).cast("long").alias("next_seq"), F.coalesce(F.col("ts"), F.lit(last).cast("double")).alias("last_ts"))
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={batch}")


def write_slots(requests: DataFrame, path: str, slot_size: int, raw: str = "raw_ts", checkpoint: str | None = None) -> StreamingQuery:
    """A stream of requests (place: a unique integer that rises from batch to batch, raw, any others) into {path}, a slot's requests as JSON lines.

    Late requests are lifted to the largest timestamp, a missing one is the one before plus 1; none is dropped. The query takes what is there and
    ends; started again over the same checkpoint it goes on where it was.
    """

    def run(batch: DataFrame, number: int) -> None:
        slot_batch(batch, number, path, slot_size, raw)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()


def read_slots(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What was written, with seq, slot and ts. columns: those of the requests, as a schema."""
    return spark.read.schema(f"{columns}, seq long, ts double, batch int, slot int").json(f"{path}/slots").drop("batch")
