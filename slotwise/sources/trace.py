"""Request traces: readers with an explicit order, and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.formats import latex_table, markdown_table
from slotwise.sources.archive import register_archives

#: Rows that a stretch of the order holds on average; one task numbers it.
STRETCH = 65_536


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """df with seq: 0, 1, ... in ascending order of `order`, a unique integer column.

    The order is cut into as many equal stretches of its values as it takes for STRETCH rows each, and a stretch that holds more, because
    values lie close there and far apart elsewhere, once more between its own ends. A stretch is numbered in one window; the stretches' counts
    are summed up in a window of one row a stretch.
    """
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    width = 1 if not ends.n else max(1, -(-(ends.high - ends.low + 1) * STRETCH // ends.n))
    stretched = df.withColumn("_stretch", F.floor((F.col(order) - F.lit(ends.low or 0)) / width))
    full = stretched.groupBy("_stretch").agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    widths = full.select("_stretch", "_low", F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / STRETCH)).alias("_width"))
    cut = stretched.join(widths, "_stretch").withColumn("_cut", F.floor((F.col(order) - F.col("_low")) / F.col("_width")))
    before = Window.orderBy("_stretch", "_cut")
    counts = cut.groupBy("_stretch", "_cut").agg(F.count("*").alias("_n"))
    shifts = counts.select("_stretch", "_cut", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_stretch", "_cut").orderBy(order))
    numbered = cut.withColumn("_in", within).join(shifts, ["_stretch", "_cut"])
    return numbered.withColumn("seq", F.col("_before") + F.col("_in") - 1).select(*df.columns, "seq")


def with_slots(trace: DataFrame, slot_size: int) -> DataFrame:
    """Count-based tumbling slots from 1; the last one may be short."""
    return trace.withColumn("slot", (F.floor(F.col("seq") / slot_size) + 1).cast("int"))


def cap_rows(trace: DataFrame, max_rows: int | None) -> DataFrame:
    return trace if max_rows is None else trace.where(F.col("seq") < max_rows)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order: by file, then by place in it. A gzip file is one partition, read front to back."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with seq, in order of file and place. Places rise by one from line to line of a partition of the reader, but lines may
    have been left out since; so a stretch of places is ranked at a time, and the counts of stretches before are added."""
    stretch = F.floor(F.col("place") / STRETCH)
    counts = lines.groupBy("file", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    before = counts.select("file", "stretch", (F.sum("n").over(Window.orderBy("file", "stretch")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "stretch").orderBy("place")) - 1
    return lines.withColumn("stretch", stretch).withColumn("r", rank).join(before, ["file", "stretch"]).withColumn("seq", F.col("before") + F.col("r")).drop("stretch", "r", "before", "place", "file")


def read_spaced_requests(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """`id ts url... flag` lines: seq, unique_id, timestamp, object_id, is_update. A short line or a bad number is an error."""
    tokens = F.split(F.trim("value"), r"\s+")
    lines = _numbered_lines(_lines(spark, path).where(F.trim("value") != ""))
    parsed = lines.select("seq", tokens.alias("t"))
    checked = F.when(F.size("t") < 4, F.raise_error(F.concat(F.lit("fewer than 4 fields in line "), F.col("seq").cast("string")))).otherwise(F.element_at("t", 2))
    out = parsed.select("seq", F.col("t")[0].alias("unique_id"), checked.cast("double").alias("timestamp"), F.array_join(F.slice("t", 3, F.greatest(F.size("t") - 3, F.lit(0))), " ").alias("object_id"), F.element_at("t", -1).alias("is_update"))
    return cap_rows(out, max_rows)


def read_sized_requests(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """`time id size ...` lines: seq, object_id, timestamp, size. Lines that can't be parsed are skipped and take no number."""
    tokens = F.split(F.trim("value"), r"\s+")
    fields = _lines(spark, path).select("file", "place", tokens[0].try_cast("long").alias("time"), F.get(tokens, F.lit(1)).alias("object_id"), F.get(tokens, F.lit(2)).try_cast("int").alias("size"))
    good = fields.where("time is not null and object_id is not null and size is not null")
    numbered = _numbered_lines(good.withColumn("value", F.struct("time", "object_id", "size")).select("value", "file", "place"))
    return cap_rows(numbered.select("seq", F.col("value.object_id").alias("object_id"), F.col("value.time").cast("double").alias("timestamp"), F.col("value.size").alias("size")), max_rows)


def read_sized_archive(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """The same from the first member ending in .tr of tar.gz archives: of one, or of all of a folder in order of their names.

    Each archive is a partition of a Spark data source, which streams it from wherever its file system is (see ArchiveSource).
    """
    register_archives(spark)
    rows = spark.read.format("sized_archive").option("path", path).option("maxRows", -1 if max_rows is None else max_rows).load()
    counts = rows.groupBy("archive").agg(F.count("*").alias("n"))
    before = counts.select("archive", (F.sum("n").over(Window.orderBy("archive")) - F.col("n")).alias("before"))  # a row an archive
    numbered = rows.join(before, "archive").withColumn("seq", F.col("seq") + F.col("before"))
    return cap_rows(numbered.select("seq", "object_id", "timestamp", "size"), max_rows)


# The columns of a Parquet trace.
PARQUET_COLUMNS = {"unique_id", "timestamp", "requested_url", "is_update"}


def read_parquet_requests(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Files by name, rows in file order; the columns must be exactly PARQUET_COLUMNS."""
    raw = spark.read.parquet(path)
    if set(raw.columns) != PARQUET_COLUMNS:
        raise ValueError(f"a Parquet trace has the columns {sorted(PARQUET_COLUMNS)}, not {sorted(raw.columns)}")
    placed = raw.select(F.struct(*raw.columns).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = placed.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    joined = placed.join(F.broadcast(before), "file")
    out = joined.select((F.col("before") + F.col("row")).alias("seq"), F.col("value.unique_id").cast("string").alias("unique_id"), F.col("value.timestamp").cast("double").alias("timestamp"), F.col("value.requested_url").alias("object_id"), F.col("value.is_update").cast("string").alias("is_update"))
    return cap_rows(out, max_rows)


def read_trace(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """By suffix, in this order: .tar.gz, wiki2018.gz, other .gz, else a folder of Parquet files."""
    if path.endswith(".tar.gz"):
        return read_sized_archive(spark, path, max_rows)
    if path.endswith("wiki2018.gz"):
        return read_sized_requests(spark, path, max_rows)
    if path.endswith(".gz"):
        return read_spaced_requests(spark, path, max_rows)
    if "." in path.rstrip("/").rsplit("/", 1)[-1] and not path.endswith(".parquet"):
        raise ValueError(f"no trace format for {path}")
    return read_parquet_requests(spark, path, max_rows)


def read_spliced(spark: SparkSession, spec: str, max_rows: int | None = None) -> DataFrame:
    """`pathA::N1||pathB::N2`: the first N1 requests of A, then the first N2 of B, numbered on."""
    out, before = None, 0
    for part in spec.split("||"):
        path, _, rows = part.partition("::")
        piece = read_trace(spark, path, int(rows) if rows else None).select("seq", "object_id", "timestamp")
        n = piece.count()
        piece = piece.withColumn("seq", F.col("seq") + before)
        out, before = piece if out is None else out.unionByName(piece), before + n
    return cap_rows(out, max_rows)


def event_trace(spark: SparkSession, sf_dir: str, slots: int = 10) -> DataFrame:
    """The events table as a trace: seq, ts (epoch seconds), object_id, slot and value, in order of event_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = max(1, events.count() // slots)
    columns = events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("object_id"), "value")
    return with_slots(number_rows(columns, "event_id"), size)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; with append beside what is there, so that a slot's rows can be written when the slot is over."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_slot_logs(log: DataFrame, path: str) -> None:
    """A folder for each run (variant, capacity), its slots in order."""
    runs = log.repartition("variant", "capacity").sortWithinPartitions("variant", "capacity", "slot")
    runs.write.mode("overwrite").partitionBy("variant", "capacity").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON file, of as many rows as there are runs."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_text(df: DataFrame, style: str = "markdown") -> str:
    """A small table of results as Markdown or LaTeX, in the order of its rows."""
    render = {"markdown": markdown_table, "latex": latex_table}[style]
    return render(df.columns, [tuple(r) for r in df.collect()])


def next_run_number(spark: SparkSession, folder: str) -> int:
    """One more than the greatest number that a name in the folder starts with (NNN_...); 1 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return max((int(m[1]) for n in names if (m := re.match(r"([0-9]+)_", n))), default=0) + 1


def write_parquet_chunks(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def convert_lines(spark: SparkSession, source: str, path: str, max_rows: int | None = None) -> None:
    """The first lines of text files as gzip text, in order."""
    numbered = cap_rows(_numbered_lines(_lines(spark, source)), max_rows)
    numbered.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def four_fields(lines: DataFrame) -> DataFrame:
    """unique_id, timestamp, requested_url, is_update of lines (column value) cut at their first three blanks; others go."""
    parts = F.split(F.trim("value"), " ", 4)
    cut = lines.select(parts.alias("p")).where(F.size("p") == 4)
    return cut.select(*[F.col("p")[i].alias(c) for i, c in enumerate(("unique_id", "timestamp", "requested_url", "is_update"))])


def convert_web_trace(spark: SparkSession, source: str, path: str, max_rows: int | None = None, rows: int = 100_000) -> None:
    """Text lines of four fields as Parquet files of so many rows, in order."""
    kept = _lines(spark, source).where(F.size(F.split(F.trim("value"), " ", 4)) == 4)
    numbered = cap_rows(_numbered_lines(kept), max_rows).repartitionByRange("seq").sortWithinPartitions("seq")
    write_parquet_chunks(four_fields(numbered), path, rows)


def validate_parquet(spark: SparkSession, path: str, samples: int = 10) -> dict:
    """Whether the columns are those of a trace, the rows, the distinct objects, and a few rows."""
    raw = spark.read.parquet(path)
    if set(raw.columns) != PARQUET_COLUMNS:
        return {"valid": False, "missing": sorted(PARQUET_COLUMNS - set(raw.columns)), "unknown": sorted(set(raw.columns) - PARQUET_COLUMNS)}
    sums = raw.agg(F.count("*").alias("n"), F.countDistinct("requested_url").alias("urls")).first()
    return {"valid": True, "rows": sums.n, "objects": sums.urls, "samples": [r.asDict() for r in raw.limit(samples).collect()]}


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def header_reasons(first_line: str | None) -> list[str]:
    """Why the first line of a file may be a header: fields 1 and 2 of data are numbers."""
    if first_line is None or not first_line.strip():
        return ["no first line"]
    found = []
    for name, field in zip(("unique_id", "timestamp"), first_line.split()):
        try:
            float(field)
        except ValueError:
            found.append(f"{name} is not a number")
    return found


def read_slot_logs(spark: SparkSession, path: str, phase: str = "cache") -> DataFrame:
    return spark.read.json(path).where(F.col("phase") == phase)


def read_summaries(spark: SparkSession, glob: str) -> DataFrame:
    """Run summaries without those of all sizes; of one (model, cache_size_objects) the last file counts."""
    raw = spark.read.option("multiLine", True).json(glob).withColumn("_file", F.col("_metadata.file_path")).where(~F.col("_file").contains("_all_sizes"))
    last = Window.partitionBy("model", "cache_size_objects").orderBy(F.desc("_file"))
    return raw.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_file")


def profile_lines(lines: DataFrame) -> DataFrame:
    """Histogram of the number of fields in lines (column value)."""
    return lines.groupBy(F.size(F.split(F.trim("value"), r"\s+")).alias("fields")).agg(F.count("*").alias("n_lines"))
