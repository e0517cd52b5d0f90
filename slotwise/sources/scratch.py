"""Tables that a driver loop reads again and again, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folder of each local application whose session names none; the setting itself can't be changed in a running one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder under a local master, else an error: executors' disks are not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="slotwise-"))
    return found.rstrip("/")


def new_table(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df from a table of its own. by: a folder for each value, so that a read of one value opens only its files; rows of a value that very
    many rows hold are spread over tasks."""
    path = new_table(df.sparkSession, label)
    if by:
        rest = [c for c in df.columns if c != by]
        df.repartitionByRange(by, *rest[:1]).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
