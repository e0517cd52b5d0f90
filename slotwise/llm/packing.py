"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's ids beyond whole windows
go to the window where least room is left over (best fit); when none has room and no further window
may open, the fullest window is filled up with the first ids and emitted, and the rest looks again.
Documents may be cut, so an emitted window is full. What is still open at a partition's end is
merged in rounds over ever fewer partitions; the very last ids are cut into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import materialize
from slotwise.llm.tokens import tokenizer

_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = _FIELDS + ", open boolean, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("open", pa.bool_()), ("ids", pa.binary())])


class Packer:
    """The windows of one partition. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, size: int, windows: int, first_sequence: int, keep_ids: bool):
        self.size, self.windows, self.next, self.keep_ids = size, windows, first_sequence, keep_ids
        self.open: list[tuple[int, list]] = []  # (room, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset, is_open, ids if is_open or self.keep_ids else None))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        whole = 4 * self.size
        while len(ids) >= whole:
            self.emit([(doc, start, ids[:whole], total)])
            start, ids = start + self.size, ids[whole:]
        while ids:
            n = len(ids) // 4
            fit = min(((room, i) for i, (room, _) in enumerate(self.open) if room >= n), default=None)
            if fit:
                room, i = fit
                pieces = self.open[i][1]
                pieces.append((doc, start, ids, total))
                if room == n:
                    self.open.pop(i)
                    self.emit(pieces)
                else:
                    self.open[i] = (room - n, pieces)
                return
            if len(self.open) < self.windows:
                self.open.append((self.size - n, [(doc, start, ids, total)]))
                return
            room, i = min((room, i) for i, (room, _) in enumerate(self.open))
            pieces = self.open.pop(i)[1]
            pieces.append((doc, start, ids[: 4 * room], total))
            self.emit(pieces)
            start, ids = start + room, ids[4 * room :]

    def leave(self) -> None:
        """Hand over the open windows to the next round."""
        for _, pieces in self.open:
            self.emit(pieces, True)
        self.open = []

    def finish(self) -> None:
        """Close all: what the open windows hold, in a row, cut into powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda x: x[0]) for p in pieces]
        self.open = []
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            want = min(self.size, 1 << (left.bit_length() - 1))
            left -= want
            pieces = []
            while want:
                doc, start, ids, total = rest.pop(0)
                n = min(want, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.insert(0, (doc, start + n, ids[4 * n :], total))
                want -= n
            self.emit(pieces)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            self.rows = []


def pack_documents(docs: DataFrame, tokenizer_path: str, chunks: str, end_id: int, size: int = 2048, windows: int = 16, fan_in: int = 32, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit).

    A null or empty text is end_id alone. Null, equal or repeated ids are kept as they are: each row
    is a document of its own. Other columns are ignored; an empty table gives no pieces.
    windows: open windows of a partition, the memory bound. fan_in: so many partitions' leftovers
    meet in one task of the next round, at most windows * size ids from each.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokenizer(tokenizer_path, chunks), Packer(size, windows, TaskContext.get().partitionId() << 32, keep_ids)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode([text or ""])[0] + end
                packer.add(key, 0, ids, len(ids) // 4)
                if len(packer.rows) >= 4096:
                    yield from packer.drain()
        packer.leave()
        yield from packer.drain()

    def later(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(size, windows, (level << 56) + (TaskContext.get().partitionId() << 32), keep_ids)
            for batch in batches:
                for r in batch.to_pylist():
                    packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
                yield from packer.drain()
            packer.finish() if last else packer.leave()
            yield from packer.drain()

        return merge

    packed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, _SCHEMA), "pack")
    parts = packed.where("open").agg(F.max(F.shiftright("sequence_id", 32)).alias("n")).first().n
    parts, level, done = 0 if parts is None else parts + 1, 1, [packed.where("not open")]
    while parts:
        parts = -(-parts // fan_in)
        left = packed.where("open").repartitionByRange(parts, "sequence_id")
        packed = materialize(left.sortWithinPartitions("sequence_id", "offset").mapInArrow(later(level, parts == 1), _SCHEMA), "pack")
        done.append(packed.where("not open"))
        parts, level = 0 if parts == 1 else parts, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open") if keep_ids else out.drop("open", "ids")
