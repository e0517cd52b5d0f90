"""Token-ID output: documents as Simple-8b coded ids in files, and back.

The format: a folder of Parquet files as containers. A row is a segment of whole documents:
part (number of the range of keys), position (ids of the part before this segment), n_ids,
doc_ids and doc_lengths (the directory), payload (little-endian 64-bit Simple-8b words) and
block_words: where in the payload each block of BLOCK ids starts, in words. Blocks are coded
apart, so that each can be decoded alone, all words at once. Files are in ascending key order by
part, rows within a part by position. Spark's committer writes the files, so a lost executor
leaves no half file, and any store that Spark can write will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm import simple8b
from slotwise.llm.common import shuffle_width
from slotwise.llm.tokens import tokenizer

BLOCK = 8192
#: Ids after which a segment is closed.
SEGMENT = 65_536
SCHEMA = "part int, position long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary, block_words array<long>"


def pack_blocks(ids: np.ndarray) -> tuple[bytes, list[int]]:
    words, starts, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        words.append(simple8b.encode(ids[i : i + BLOCK]))
        starts.append(at)
        at += len(words[-1])
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)).astype("<u8").tobytes(), starts


def unpack_blocks(payload: bytes, starts, n: int) -> np.ndarray:
    words = np.frombuffer(payload, dtype="<u8")
    ends = [*starts[1:], len(words)]
    parts = [simple8b.decode(words[a:b], min(BLOCK, n - i * BLOCK)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, chunks: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of docs, end_id after each, in ascending order of id_col (nulls first).

    A null or empty text is just end_id. Rows of equal id are ordered by text, equal rows are all
    kept. Other columns are ignored. An empty table gives a folder without rows.
    The range partitioning adds a hash of the text to the key, so that one id with very many rows is
    dealt over several parts too.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, position = tokenizer(tokenizer_path, chunks), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        names, lengths, held, size = [], [], [], 0
        types = pa.schema([("part", pa.int32()), ("position", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("block_words", pa.list_(pa.int64()))])

        def close() -> pa.RecordBatch:
            payload, starts = pack_blocks(np.frombuffer(b"".join(held), dtype="<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "position": position, "n_ids": size, "doc_ids": names, "doc_lengths": lengths, "payload": payload, "block_words": starts}], schema=types)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(ids, texts, strict=True):
                held.append(encoder.encode([text or ""])[0] + end)
                names.append(key)
                lengths.append(len(held[-1]) // 4)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield close()
                    position += size
                    names, lengths, held, size = [], [], [], 0
        if names:
            yield close()

    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ordered = keyed.repartitionByRange(shuffle_width(docs.sparkSession), "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on demand, ids.

    Two-level prefix sums: a segment knows its position within its part, and the table of part totals
    has a row for each part, of which there are as many as the writer had tasks; that bound is
    why it may be broadcast and summed in one window.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_blocks(row["payload"], row["block_words"], row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["doc_lengths"]).tolist()
                begins = [0, *ends[:-1]]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array([row["before"] + row["position"] + b for b in begins], pa.int64()),
                    "n_tokens": pa.array(row["doc_lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].tolist() for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    joined = files.join(F.broadcast(before), "part")
    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
